"""Instants as microseconds since the epoch: exact, zone-free and cheap to shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def instant_us(text: Column) -> Column:
    """ISO 8601 text in any of its zoned forms to microseconds since the epoch.

    A text without zone counts as UTC, whatever the session's zone; unreadable text gives null.
    """
    zoned = text.rlike(r"(?i)(z|utc|gmt|[+-]\d{2}:?\d{2})\s*$")
    return F.unix_micros(F.when(zoned, text).otherwise(F.concat(F.trim(text), F.lit("Z"))).try_cast("timestamp"))


def utc_ntz(us: Column) -> Column:
    """Microseconds since the epoch to a UTC wall-clock timestamp without zone."""
    seconds = (us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def utc_iso(us: Column) -> Column:
    """Microseconds since the epoch to ``YYYY-MM-DDTHH:MM:SSZ`` in UTC (fractions cut off)."""
    whole = F.floor(us / F.lit(1_000_000).cast("bigint")).cast("bigint") * F.lit(1_000_000).cast("bigint")
    return F.concat(F.translate(utc_ntz(whole).cast("string"), " ", "T"), F.lit("Z"))


def utc_day(us: Column) -> Column:
    """Microseconds since the epoch to the UTC day as days since the epoch."""
    return F.floor(us / F.lit(DAY_US).cast("bigint")).cast("int")
