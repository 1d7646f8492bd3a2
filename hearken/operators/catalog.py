"""Matching against a catalog: canon tiers, candidate scoring and resolution tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.classify import is_non_music
from hearken.functions.names import SAME, act_heads, album_core_udf, artist_key_udf, bracket_extension_udf, keyed, ratio_udf, same_act, track_core_udf, uninformative_hint


def play_maps(plays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plays by act key, and by act key and album core."""
    counted = plays.groupBy("artist", "album").agg(F.count(F.lit(1)).alias("n"))
    named = keyed(counted, akey=("artist", artist_key_udf), core=("album", album_core_udf))
    acts = named.groupBy("akey").agg(F.sum("n").alias("artist_plays"))
    albums = named.where("core <> ''").groupBy("akey", "core").agg(F.sum("n").alias("n"))
    return acts, albums


def contains_either(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a))


def canon_tiers(canon: DataFrame, acts: DataFrame, albums: DataFrame, known: DataFrame | None = None, *, lived_in: int = 15, near_miss: int = 4) -> DataFrame:
    """Tier of each listed record (``rank, artist, album``): lived_in, brushed, near_miss or unheard, with its plays.

    An album counts if its act is the same and either core contains the other: an equi-join on the act with the containment as
    residual condition, whose broadcast side, if any, the measured sizes decide.
    """
    listed = canon.select("*", artist_key_udf("artist").alias("akey"), album_core_udf("album").alias("core"))
    small = listed.select("rank", F.col("akey").alias("k"), F.col("core").alias("want"))
    heard = albums.join(small, (F.col("akey") == F.col("k")) & contains_either(F.col("core"), F.col("want"))).groupBy("rank").agg(F.sum("n").alias("album_plays"))
    out = listed.join(acts, "akey", "left").join(heard, "rank", "left")
    if known is None:
        out = out.withColumn("in_library", F.lit(False))
    else:
        out = out.join(known.select(F.col("akey"), F.lit(True).alias("in_library")).distinct(), "akey", "left").withColumn("in_library", F.coalesce("in_library", F.lit(False)))
    a, b = F.coalesce("artist_plays", F.lit(0)), F.coalesce("album_plays", F.lit(0))
    tier = F.when(b >= lived_in, "lived_in").when(b > 0, "brushed").when((a >= near_miss) | F.col("in_library"), "near_miss").otherwise("unheard")
    return out.select("rank", "artist", "album", a.alias("artist_plays"), b.alias("album_plays"), tier.alias("tier"), (F.col("in_library") & (a == 0)).alias("library_only"))


def tier_order(tiers: DataFrame) -> DataFrame:
    """Place of each record within its tier: by plays, the unheard by rank."""
    first = F.when(F.col("tier").isin("lived_in", "brushed"), F.col("album_plays")).when(F.col("tier") == "near_miss", F.col("artist_plays")).otherwise(-F.col("rank"))
    second = F.when(F.col("tier") == "brushed", F.col("artist_plays")).otherwise(F.lit(0))
    return tiers.withColumn("place", F.row_number().over(Window.partitionBy("tier").orderBy(first.desc(), second.desc(), "rank")))


def tier_counts(tiers: DataFrame, plays: str) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum(plays).alias("plays"))


def best_album(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate (``id, artist, name, pos``) for each wanted album (``artist, name``): same act, similarity from the threshold, first of equals."""
    w = keyed(wanted.select(F.col("artist").alias("wa"), F.col("name").alias("wn")).distinct(), wk=("wa", artist_key_udf), wc=("wn", album_core_udf))
    c = keyed(candidates.select("id", F.col("artist").alias("ca"), F.col("name").alias("cn"), "pos"), ck=("ca", artist_key_udf), cc=("cn", album_core_udf))
    heads = w.select("*", F.explode(act_heads(F.col("wk"))).alias("head")).join(c.select("*", F.explode(act_heads(F.col("ck"))).alias("head")), "head")
    pairs = heads.where(same_act(F.col("wk"), F.col("ck"))).drop("head").distinct().withColumn("ratio", ratio_udf("wc", "cc")).where(F.col("ratio") >= SAME)
    best = Window.partitionBy("wa", "wn").orderBy(F.desc("ratio"), "pos")
    return pairs.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.col("wa").alias("artist"), F.col("wn").alias("name"), "id", F.col("ca").alias("found_artist"), F.col("cn").alias("found_name"), F.round("ratio", 3).alias("ratio"))


def proposals(songs: DataFrame, hits: DataFrame) -> DataFrame:
    """Tier and act of each song (``key, title, hint``) from its search hits (``key, artist, track, album, pos``).

    non_music, then ambiguous_hint, then high (title and album match, one act), review (several acts, or the
    album doesn't match) or no_match.
    """
    cored = keyed(songs, tcore=("title", track_core_udf), hcore=("hint", album_core_udf))
    c = keyed(hits.select("key", F.col("artist").alias("ca"), F.col("track").alias("ct"), F.col("album").alias("cb"), "pos"), ctc=("ct", track_core_udf), cbc=("cb", album_core_udf), cak=("ca", artist_key_udf))
    scored = cored.join(c, "key").withColumns({"tr": ratio_udf("tcore", "ctc"), "ar": ratio_udf("hcore", "cbc"), "ext": bracket_extension_udf("hint", "cb")}).where(F.col("tr") >= SAME)
    good = (F.col("ar") >= SAME) | F.col("ext")
    best = F.max(F.when(good, F.struct(F.round("ar", 3).alias("ar"), F.round("tr", 3).alias("tr"), (-F.col("pos")).alias("p"), F.col("ca").alias("artist"))))
    near = F.max(F.when(~good, F.struct(F.round("ar", 3).alias("ar"), (-F.col("pos")).alias("p"), F.col("ca").alias("artist"))))
    judged = scored.groupBy("key").agg(F.countDistinct(F.when(good, F.col("cak"))).alias("acts"), best.alias("best"), near.alias("near"))
    out = cored.join(judged, "key", "left")
    noise, vague = is_non_music(F.col("title"), F.col("hint")), uninformative_hint(F.col("tcore"), F.col("hcore"))
    tier = F.when(noise, "non_music").when(vague, "ambiguous_hint").when(F.col("acts") == 1, "high").when(F.col("acts") > 1, "review").when(F.col("near").isNotNull(), "review").otherwise("no_match")
    return out.withColumn("tier", tier).select("key", "title", "hint", "tier", F.when(F.col("tier").isin("high", "review"), F.coalesce("best.artist", "near.artist")).alias("artist"))


def first_found(strict: DataFrame, loose: DataFrame, *, key: str) -> DataFrame:
    """First hit of each key, the strict query's before the loose one's (columns ``key, pos, ...``)."""
    both = strict.withColumn("__p", F.lit(0)).unionByName(loose.withColumn("__p", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__p", "pos"))).where("__n = 1").drop("__n", "__p")
