"""One row of features for each entity from an event table with many event types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def long_features(events: DataFrame, *, entity: str, type_cols: Sequence[str], at: str, value: str, types: Sequence[tuple]) -> DataFrame:
    """Compact long table: a row for each entity and type that occurs.

    Columns: entity, ``type_id`` (place in ``types``, from 0; -1 for a type that isn't listed), ``n`` events,
    ``last_us`` (latest instant, null if none has one), ``total`` of ``value`` (nulls count as 0). Types are
    matched null-safely by a broadcast of the list; the aggregation combines before the shuffle, so an entity
    holding any share of the events sends at most one row a type from each task. Rows without entity are left
    out.
    """
    spark = events.sparkSession
    names = [f"__t{i}" for i in range(len(type_cols))]
    listed = _listed(spark, events, type_cols, types, names)
    narrow = events.where(F.col(entity).isNotNull()).select(F.col(entity).alias("__e"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(type_cols)], F.col(at).alias("__at"), F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("__v"))
    on = None
    for i, n in enumerate(names):
        same = F.col(f"__c{i}").eqNullSafe(F.col(n))
        on = same if on is None else on & same
    coded = narrow.join(F.broadcast(listed), on, "left").select("__e", F.coalesce("type_id", F.lit(-1)).alias("type_id"), "__at", "__v")
    return coded.groupBy(F.col("__e").alias(entity), "type_id").agg(F.count(F.lit(1)).alias("n"), F.max("__at").alias("last_us"), F.sum("__v").alias("total"))


def sparse_features(events: DataFrame, *, entity: str, type_cols: Sequence[str], at: str, value: str, types: Sequence[tuple] | None = None) -> DataFrame:
    """One row for each entity: totals over all types and ``features``, an array of structs in type order (nulls first).

    Columns: entity, ``n_events``, ``last_us``, ``total``, ``features`` (array of the type columns, ``n``,
    ``last_us``, ``total``). Holds only types that occur, so its size follows the events however many types there
    are; the types are grouped by themselves and need no list. With an explicit list, types that aren't on it appear together under null names, last.
    """
    narrow = events.where(F.col(entity).isNotNull())
    if types is not None:
        names = [f"__t{i}" for i in range(len(type_cols))]
        listed = _listed(events.sparkSession, events, type_cols, types, names)
        on = None
        for c, n in zip(type_cols, names, strict=True):
            on = F.col(c).eqNullSafe(F.col(n)) if on is None else on & F.col(c).eqNullSafe(F.col(n))
        narrow = narrow.join(F.broadcast(listed), on, "left").select(entity, at, value, *[F.col(n).alias(c) for c, n in zip(type_cols, names, strict=True)], F.col("type_id").isNull().alias("__rest"))
    else:
        narrow = narrow.select(entity, at, value, *type_cols, F.lit(False).alias("__rest"))
    long = narrow.groupBy(entity, "__rest", *type_cols).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_us"), F.sum(F.coalesce(F.col(value).cast("bigint"), F.lit(0))).alias("total"))
    entry = F.struct("__rest", *type_cols, "n", "last_us", "total")
    gathered = long.groupBy(entity).agg(F.sum("n").alias("n_events"), F.max("last_us").alias("last_us"), F.sum("total").alias("total"), F.sort_array(F.collect_list(entry)).alias("f"))
    return gathered.select(entity, "n_events", "last_us", "total", F.transform("f", lambda x: F.struct(*[x[c].alias(c) for c in (*type_cols, "n", "last_us", "total")])).alias("features"))


def wide_features(events: DataFrame, *, entity: str, type_cols: Sequence[str], at: str, value: str, types: Sequence[tuple], as_of_us: int | None = None) -> DataFrame:
    """One row for each entity with columns ``n_<type>``, ``last_us_<type>``, ``total_<type>`` for each listed type.

    Counts and totals of absent types are 0, their last instant null. With ``as_of_us``, ``age_us_<type>`` is
    the time since the last event. Events of types that aren't listed are kept in ``*_other``. Meant for lists of
    up to a few hundred types; :func:`sparse_features` takes longer ones.
    """
    long = long_features(events, entity=entity, type_cols=type_cols, at=at, value=value, types=types)
    ids = [*range(len(types)), -1]
    piv = long.groupBy(entity).pivot("type_id", ids).agg(F.first("n").alias("n"), F.first("last_us").alias("last_us"), F.first("total").alias("total"))
    out = [F.col(entity)]
    for i in ids:
        name = "other" if i < 0 else label(types[i])
        out += [F.coalesce(F.col(f"`{i}_n`"), F.lit(0)).alias(f"n_{name}"), F.col(f"`{i}_last_us`").alias(f"last_us_{name}"), F.coalesce(F.col(f"`{i}_total`"), F.lit(0)).alias(f"total_{name}")]
        if as_of_us is not None:
            out.append((F.lit(as_of_us) - F.col(f"`{i}_last_us`")).alias(f"age_us_{name}"))
    return piv.select(*out)


def label(kind: tuple) -> str:
    """Column-name part of a type: its values joined by an underscore, ``null`` and ``blank`` spelt out."""
    return "_".join("null" if x is None else "".join(c if c.isalnum() else "_" for c in str(x)) or "blank" for x in kind)


def _listed(spark: SparkSession, events: DataFrame, type_cols: Sequence[str], types: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    kinds = [events.schema[c].dataType for c in type_cols]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)] + [T.StructField("type_id", T.IntegerType(), False)])
    return spark.createDataFrame([(*t, i) for i, t in enumerate(types)], schema)


def rolling_totals(events: DataFrame, *, entity: str, at: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and daily averages over trailing periods, for each entity and UTC day from its first to its last event.

    Columns: entity, ``day`` (date), and ``total_<p>d``, ``avg_<p>d`` for each period p; the period is the p days that end with the
    day, the average is the total by p. Days without events are included. Nulls in ``value`` count as 0, events
    without instant are left out, a null entity is an entity of its own, no events give no rows.

    Events are summed by entity and day first (combined before the shuffle), which bounds an entity's rows by its
    days. The daily totals are then placed by entity once; exploding each onto the days it influences, summing and
    joining the calendar reuse that placement.
    """
    from hearken.functions.instants import utc_day

    day = events.where(F.col(at).isNotNull()).select(F.col(entity).alias("e"), utc_day(F.col(at)).alias("d"), F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("v"))
    daily = day.groupBy("e", "d").agg(F.sum("v").alias("v")).repartition("e")
    ranged = daily.select("e", "d", "v", F.max("d").over(Window.partitionBy("e")).alias("d1"), F.min("d").over(Window.partitionBy("e")).alias("d0"))
    longest = max(periods)
    influenced = ranged.select("e", "v", "d0", "d1", F.posexplode(F.sequence(F.col("d"), F.least(F.col("d") + longest - 1, F.col("d1")))).alias("lag", "day"))
    sums = influenced.groupBy("e", "day").agg(*[F.sum(F.when(F.col("lag") < p, F.col("v"))).alias(f"s{p}") for p in periods])
    calendar = ranged.groupBy("e").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).select("e", F.explode(F.sequence("d0", "d1")).alias("day"))
    on = (calendar["e"].eqNullSafe(sums["e"])) & (calendar["day"] == sums["day"])
    joined = calendar.join(sums, on, "left").select(calendar["e"].alias(entity), F.date_from_unix_date(calendar["day"]).alias("day"), *[F.coalesce(sums[f"s{p}"], F.lit(0)).alias(f"total_{p}d") for p in periods])
    return joined.select("*", *[(F.col(f"total_{p}d") / F.lit(float(p))).alias(f"avg_{p}d") for p in periods])
