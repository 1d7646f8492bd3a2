"""Queries of the core's training-data operators (problems 2, 4, 5 and 6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions.instants import instant_us, utc_iso
from hearken.operators.features import rolling_totals, sparse_features
from hearken.operators.packed import split_packed
from hearken.operators.sessions import chunked_sessions
from hearken.sources.tables import table

PLAY_MS = 30_000


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each act and title packed in the two description fields of the companion files."""
    lines = table(spark, folder, "apple_history").select("record_id", "track_description", "track_name")
    return split_packed(lines, key="record_id", fields={"track_description": "track_description", "track_name": "track_name"})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Album sessions of each listener."""
    plays = table(spark, folder, "streaming_history").where(F.col("ms_played") >= PLAY_MS)
    plays = plays.select("username", instant_us(F.col("ts")).alias("us"), F.col("master_metadata_album_album_name").alias("album"), "reason_start")
    found = chunked_sessions(plays, entity="username", at="us", same="album", reason="reason_start", continues="trackdone", gap_us=600_000_000, min_events=4)
    return found.select("username", utc_iso(F.col("start_us")).alias("start_ts"), utc_iso(F.col("end_us")).alias("end_ts"), F.col("n_events").alias("n_plays"))


P4_SQL = """
WITH plays AS (
  SELECT DISTINCT username, epoch_us(TRY_CAST(ts AS TIMESTAMPTZ)) AS us, master_metadata_album_album_name AS album, reason_start
  FROM streaming_history WHERE ms_played >= 30000 AND TRY_CAST(ts AS TIMESTAMPTZ) IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN album = lag(album) OVER w AND reason_start = 'trackdone' AND us - lag(us) OVER w < 600000000 THEN 0 ELSE 1 END AS b
  FROM plays WINDOW w AS (PARTITION BY username ORDER BY us, album NULLS FIRST, reason_start NULLS FIRST)),
runs AS (
  SELECT *, sum(b) OVER (PARTITION BY username ORDER BY us, album NULLS FIRST, reason_start NULLS FIRST) AS k FROM marked)
SELECT username, strftime(make_timestamp(min(us)), '%Y-%m-%dT%H:%M:%SZ') AS start_ts,
  strftime(make_timestamp(max(us)), '%Y-%m-%dT%H:%M:%SZ') AS end_ts, count(*) AS n_plays
FROM runs GROUP BY username, k HAVING count(*) >= 4
"""


def p5_features(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each track uri: its listens, last instant and milliseconds for each platform and start reason."""
    listens = table(spark, folder, "streaming_history").where(F.col("spotify_track_uri") != "")
    listens = listens.select("spotify_track_uri", "platform", "reason_start", instant_us(F.col("ts")).alias("us"), "ms_played")
    rows = sparse_features(listens, entity="spotify_track_uri", type_cols=["platform", "reason_start"], at="us", value="ms_played")
    kinds = F.transform("features", lambda x: F.struct(x["platform"].alias("platform"), x["reason_start"].alias("reason_start"), x["n"].alias("n"), utc_iso(x["last_us"]).alias("last_ts"), x["total"].alias("ms")))
    return rows.select("spotify_track_uri", F.col("n_events").alias("n_listens"), utc_iso(F.col("last_us")).alias("last_ts"), F.col("total").alias("total_ms"), F.to_json(kinds, {"ignoreNullFields": "false"}).alias("kinds"))


P5_SQL = """
WITH long AS (
  SELECT spotify_track_uri, platform, reason_start, count(*) AS n, max(epoch_us(TRY_CAST(ts AS TIMESTAMPTZ))) AS us, CAST(sum(coalesce(ms_played, 0)) AS BIGINT) AS ms
  FROM streaming_history WHERE spotify_track_uri <> '' GROUP BY ALL)
SELECT spotify_track_uri, CAST(sum(n) AS BIGINT) AS n_listens, strftime(make_timestamp(max(us)), '%Y-%m-%dT%H:%M:%SZ') AS last_ts, CAST(sum(ms) AS BIGINT) AS total_ms,
  CAST(to_json(list(struct_pack(platform := platform, reason_start := reason_start, n := n, last_ts := strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ'), ms := ms)
    ORDER BY platform NULLS FIRST, reason_start NULLS FIRST)) AS VARCHAR) AS kinds
FROM long GROUP BY spotify_track_uri
"""


def p6_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds of each listener over the last 7 and 30 days, for every day of their history."""
    listens = table(spark, folder, "streaming_history").select("username", instant_us(F.col("ts")).alias("us"), "ms_played")
    return rolling_totals(listens, entity="username", at="us", value="ms_played", periods=(7, 30)).withColumn("day", F.col("day").cast("string"))


P6_SQL = """
WITH daily AS (
  SELECT username, CAST(make_timestamp(epoch_us(TRY_CAST(ts AS TIMESTAMPTZ))) AS DATE) AS day, CAST(sum(coalesce(ms_played, 0)) AS BIGINT) AS v
  FROM streaming_history WHERE TRY_CAST(ts AS TIMESTAMPTZ) IS NOT NULL GROUP BY ALL),
calendar AS (
  SELECT username, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY username),
filled AS (
  SELECT c.username, c.day, coalesce(d.v, 0) AS v FROM calendar c LEFT JOIN daily d ON c.username IS NOT DISTINCT FROM d.username AND c.day = d.day),
sums AS (
  SELECT username, day, CAST(sum(v) OVER (PARTITION BY username ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS total_7d,
    CAST(sum(v) OVER (PARTITION BY username ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS total_30d FROM filled)
SELECT username, strftime(day, '%Y-%m-%d') AS day, total_7d, total_30d, total_7d / 7.0::DOUBLE AS avg_7d, total_30d / 30.0::DOUBLE AS avg_30d FROM sums
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p4_found": p4_found, "p5_features": p5_features, "p6_rolling": p6_rolling}
ORACLES: dict[str, str] = {"p4_found": P4_SQL, "p5_features": P5_SQL, "p6_rolling": P6_SQL}
