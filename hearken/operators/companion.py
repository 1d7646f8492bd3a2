"""The second service's export: rows cleaned by an ordered cascade, titles resolved to acts, duplicates removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.classify import device_family, safe_int, split_pair, title_key
from hearken.functions.instants import instant_us

#: Rows that aren't listens to songs.
DROP_EVENTS = ("LYRIC_DISPLAY",)
DROP_ITEMS = ("STREAM", "NON_SONG_CLIP", "ARTIST_UPLOADED_CONTENT", "TIMED_METADATA_PING")
DROP_SONGS = ("NPR News and Culture", "Apple Music 1")
RUNAWAY = 2


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does: each row is charged to one reason."""
    out = None
    for name, holds in rules:
        hit = F.coalesce(holds, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def title_map(daily: DataFrame, history: DataFrame, *, text: str, order: str) -> DataFrame:
    """Act of each title key from packed descriptions; the daily file before the history file, the last row of a file before earlier ones."""
    both = daily.select(F.col(text).alias("t"), F.col(order).alias("o"), F.lit(1).alias("first")).unionByName(history.select(F.col(text).alias("t"), F.col(order).alias("o"), F.lit(0).alias("first")))
    pairs = both.select(split_pair(F.col("t")).alias("x"), "o", "first").where("x is not null").select(title_key(F.col("x.title")).alias("key"), F.col("x.artist").alias("artist"), "o", "first")
    return pairs.groupBy("key").agg(F.max(F.struct("first", "o", "artist"))["artist"].alias("artist"))


def resolve(rows: DataFrame, titles: DataFrame, overrides: DataFrame, *, key: str) -> DataFrame:
    """Rows with the act of their title key, from the map or else the overrides; ``via_override`` tells which."""
    m = titles.select(F.col("key").alias(key), F.nullif("artist", F.lit("")).alias("__m"))
    o = overrides.select(F.col("key").alias(key), F.nullif("artist", F.lit("")).alias("__o"))
    joined = rows.join(m, key, "left").join(o, key, "left")
    return joined.withColumns({"artist": F.coalesce("__m", "__o"), "via_override": F.col("__m").isNull() & F.col("__o").isNotNull()}).drop("__m", "__o")


def clamped(raw_ms: Column, media_ms: Column) -> Column:
    """Milliseconds between 0 and, where a listen runs beyond twice the medium's length, that length."""
    ms = F.greatest(F.coalesce(raw_ms, F.lit(0)), F.lit(0))
    return F.when((media_ms > 0) & (ms > media_ms * RUNAWAY), media_ms).otherwise(ms)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key, by an order that decides."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def clean(activity: DataFrame, titles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Activity rows (export columns and ``ord``) with ``drop_reason``, null for those that are listens, and their canonical fields."""
    c = lambda name: F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))
    rows = activity.select(
        "ord",
        c("Event Type").alias("event"),
        c("Song Name").alias("song"),
        F.upper(c("Media Type")).alias("media"),
        c("Item Type").alias("item"),
        F.coalesce(instant_us(F.nullif(c("Event Start Timestamp"), F.lit(""))), instant_us(F.nullif(c("Event End Timestamp"), F.lit("")))).alias("us"),
        safe_int(F.col("`Play Duration Milliseconds`")).alias("raw_ms"),
        safe_int(F.col("`Media Duration In Milliseconds`")).alias("media_ms"),
        F.nullif(c("Album Name"), F.lit("")).alias("album"),
        F.nullif(c("End Reason Type"), F.lit("")).alias("end_reason"),
        F.nullif(c("Feature Name"), F.lit("")).alias("feature"),
        device_family(F.col("`Client Device Name`")).alias("platform"),
    ).withColumns({"us": F.expr("us div 1000000 * 1000000"), "key": title_key(F.col("song")), "ms": clamped(F.col("raw_ms"), F.col("media_ms"))})
    known = resolve(rows, titles, overrides, key="key")
    reason = first_reason(
        [
            ("event_type", F.col("event").isin(*DROP_EVENTS)),
            ("no_song_name", F.col("song") == ""),
            ("non_music_media_type", F.col("media") == "VIDEO"),
            ("non_music_item_type", F.col("item").isin(*DROP_ITEMS)),
            ("non_music_song_name", F.col("song").isin(*DROP_SONGS)),
            ("no_timestamp", F.col("us").isNull()),
            ("artist_unresolved", F.col("artist").isNull()),
        ]
    )
    judged = known.withColumn("drop_reason", reason)
    again = Window.partitionBy(F.col("drop_reason").isNull(), "us", "key", "ms").orderBy("ord")
    copy = F.col("drop_reason").isNull() & (F.row_number().over(again) > 1)
    return judged.withColumn("drop_reason", F.when(copy, "duplicate").otherwise(F.col("drop_reason"))).withColumn("skipped", F.coalesce(F.col("end_reason") == "TRACK_SKIPPED_FORWARDS", F.lit(False)))


def canonical(judged: DataFrame) -> DataFrame:
    """The listens among judged rows, in the shape of the other service's."""
    return judged.where("drop_reason is null").select(
        "ord", "us", F.col("song").alias("title"), "artist", "album", F.lit(None).cast("string").alias("uri"), "platform", F.lit(None).cast("string").alias("reason_start"), F.lit(None).cast("boolean").alias("shuffle"), "skipped", F.lit("apple").alias("service"), "ms", "feature", "end_reason"
    )


def drop_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stats(judged: DataFrame) -> DataFrame:
    """One row: rows, listens, distinct acts and tracks, songs seen and resolved with their rate, clamped durations (dropped copies count)."""
    kept = F.col("drop_reason").isNull()
    seen = kept | F.col("drop_reason").isin("artist_unresolved", "duplicate")
    known = kept | (F.col("drop_reason") == "duplicate")
    out = judged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(kept).alias("events_emitted"),
        F.countDistinct(F.when(kept, F.col("artist"))).alias("unique_artists"),
        F.countDistinct(F.when(kept, F.struct("artist", "song"))).alias("unique_tracks"),
        F.countDistinct(F.when(seen, F.col("key"))).alias("unique_songs_seen"),
        F.countDistinct(F.when(known, F.col("key"))).alias("unique_songs_resolved"),
        F.count_if(known & (F.col("raw_ms") < 0)).alias("ms_clamped_negative"),
        F.count_if(known & (F.col("media_ms") > 0) & (F.greatest("raw_ms", F.lit(0)) > F.col("media_ms") * RUNAWAY)).alias("ms_clamped_runaway"),
        F.count_if(known & F.col("via_override")).alias("artist_resolved_via_override"),
    )
    rate = F.when(F.col("unique_songs_seen") > 0, F.round(F.col("unique_songs_resolved") / F.col("unique_songs_seen"), 4)).otherwise(F.lit(0.0))
    return out.withColumn("artist_resolution_rate", rate)


def unresolved(judged: DataFrame) -> DataFrame:
    """Songs without act: plays, minutes, most frequent album (the first met of equals), first and last year."""
    lost = judged.where("drop_reason = 'artist_unresolved'").withColumn("year", F.year(F.timestamp_micros("us")))
    albums = lost.where("album is not null").groupBy("key", "album").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    modal = albums.groupBy("key").agg(F.max(F.struct("n", (-F.col("o")).alias("o"), "album"))["album"].alias("album"))
    by = lost.groupBy("key").agg(F.min(F.struct("ord", "song"))["song"].alias("title"), F.count(F.lit(1)).alias("plays"), F.sum(F.greatest(F.coalesce("raw_ms", F.lit(0)), F.lit(0))).alias("ms"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    return by.join(modal, "key", "left").select("key", "title", "plays", F.round(F.col("ms") / 60_000, 1).alias("minutes"), "album", "year_min", "year_max")


def favorites(rows: DataFrame) -> DataFrame:
    """Liked items with act and title; rows that don't split are left out."""
    pair = split_pair(F.col("`Item Description`"))
    return rows.select(pair.alias("x"), F.nullif(F.trim("`Last Modified`"), F.lit("")).alias("liked_at"), F.nullif(F.trim("`Preference`"), F.lit("")).alias("preference")).where("x is not null").select("x.artist", "x.title", "liked_at", "preference")
