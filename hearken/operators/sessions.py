"""Sessions of activity, built chunk by chunk and merged at the chunk borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_sessions(
    events: DataFrame,
    *,
    entity: str,
    at: str,
    same: str | None = None,
    reason: str | None = None,
    continues: str | None = None,
    gap_us: int = 600_000_000,
    min_events: int = 1,
    chunk_us: int = 6 * 3_600_000_000,
) -> DataFrame:
    """Runs of events of an entity, each less than ``gap_us`` after the one before.

    ``at`` holds microseconds since the epoch. With ``same``, a run also keeps one non-null value of that
    column; with ``reason`` and ``continues``, every event after a run's first has ``reason`` equal to
    ``continues``. Events equal in entity, instant, ``same`` and ``reason`` count once. Result, a row for each
    run of at least ``min_events``: entity, ``same`` (if given), ``start_us``, ``end_us``, ``duration_us``,
    ``n_events``.

    Events are shuffled once, by entity and time chunk, so that a busy entity is spread over as many tasks as it
    has chunks. Only a chunk's first and last run can reach over a border; these (at most two for each chunk)
    are shuffled by entity and merged, all other finished runs stay spread out.

    Defined results: events without instant are left out; a null entity is an entity of its own; a null in
    ``same`` ends a run (an event with null is a run of one); ties in time are ordered by ``same``, then
    ``reason``, nulls first; no events give no rows; other columns are ignored, whatever their names.
    """
    value: Column = F.col(same) if same else F.lit("")
    cause: Column = F.col(reason) if reason else F.lit(continues)
    base = events.select(F.col(entity).alias("e"), F.col(at).cast("bigint").alias("t"), value.alias("v"), cause.alias("r")).where("t is not null")
    base = base.withColumn("c", F.floor(F.col("t") / F.lit(chunk_us).cast("bigint"))).repartition("e", "c")

    order = Window.partitionBy("e", "c").orderBy("t", "v", "r")
    before = base.select("*", F.lag(F.struct("t", "v", "r")).over(order).alias("p"))
    once = before.where(~F.struct("t", "v", "r").eqNullSafe(F.col("p")))
    once = once.withColumn("pt", F.lag("t").over(order)).withColumn("pv", F.lag("v").over(order))
    joins = _joins("pv", "v", "r", continues if reason else None, F.col("t") - F.col("pt"), gap_us)
    marked = once.withColumn("b", F.when(joins, 0).otherwise(1)).withColumn("k", F.sum("b").over(order))

    runs = marked.groupBy("e", "c", "k").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("v").alias("v"), F.max(F.when(F.col("b") == 1, F.col("r"))).alias("r"), F.count(F.lit(1)).alias("n")
    )
    runs = runs.withColumn("last", F.max("k").over(Window.partitionBy("e", "c")))
    edge = (F.col("k") == 1) | (F.col("k") == F.col("last"))
    kept = runs.where(edge | (F.col("n") >= min_events))

    # Finished inner runs keep their chunk as part of the key and stay where the entity's size can't gather them.
    kept = kept.withColumn("inner", F.when(edge, F.lit(None)).otherwise(F.col("c")))
    line = Window.partitionBy("e", "inner").orderBy("c", "k")
    met = kept.withColumn("q", F.lag(F.struct("c", "t1", "v")).over(line))
    joins = (F.col("q.c") != F.col("c")) & _joins("q.v", "v", "r", continues if reason else None, F.col("t0") - F.col("q.t1"), gap_us)
    met = met.withColumn("m", F.sum(F.when(joins, 0).otherwise(1)).over(line))
    done = met.groupBy("e", "inner", "m").agg(F.min("t0").alias("start_us"), F.max("t1").alias("end_us"), F.max("v").alias("v"), F.sum("n").alias("n_events"))
    done = done.where(F.col("n_events") >= min_events)
    columns = [F.col("e").alias(entity)] + ([F.col("v").alias(same)] if same else [])
    return done.select(*columns, "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")


def _joins(earlier: str, value: str, cause: str, continues: str | None, gap: Column, gap_us: int) -> Column:
    """Whether an event goes on with the run before it."""
    good = (F.col(earlier) == F.col(value)) & (gap < gap_us)
    return good if continues is None else good & (F.col(cause) == continues)
