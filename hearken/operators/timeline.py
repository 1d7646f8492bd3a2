"""The merge layer: tags to buckets, genre waves, enrichment joins with fallback, deep cuts, the discovery ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.classify import estimated_hours, hours, id_of_uri, is_household
from hearken.session import sized


def tag_buckets(tags: DataFrame, buckets: DataFrame, *, both_ways: bool = True) -> DataFrame:
    """Bucket of each distinct tag: its exact key's, else that of the first key (``ord``) that it contains or that contains it.

    ``buckets`` has ``ord, key, bucket``. A text contains another if that is one of its stretches of that length, so distinct tags and keys
    meet by equi-joins on stretches of the lengths there are; nothing is compared pair by pair.
    """
    distinct = tags.select("tag").where("tag is not null").distinct().withColumn("t", F.lower(F.trim("tag"))).where("t <> ''")
    keys = buckets.select("ord", F.lower("key").alias("key"), "bucket").where("key <> ''")
    pairs = _within(distinct, "t", keys, "key")
    if both_ways:
        pairs = pairs.unionByName(_within(keys, "key", distinct, "t"))
    w = F.min(F.struct((F.col("t") != F.col("key")).alias("exact"), "ord", "bucket"))["bucket"]
    return pairs.groupBy("tag").agg(w.alias("bucket"))


def _within(wholes: DataFrame, whole: str, parts: DataFrame, part: str) -> DataFrame:
    """Pairs of rows where the text ``whole`` contains the text ``part``."""
    lengths = parts.select(F.length(part).alias("n")).distinct()
    longest = wholes.agg(F.max(F.length(whole))).first()[0] or 0
    # one row for each length there is, no more than the longest text has
    found = [r["n"] for r in lengths.where(F.col("n") <= longest).collect()]
    if not found:
        return wholes.join(parts, F.col(whole) == F.col(part)).limit(0)

    def stretches(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(whole) - n + 1), lambda i: F.substring(F.col(whole), i, F.lit(n)))
        return F.when(F.length(whole) >= n, every).otherwise(F.array().cast("array<string>"))

    cut_up = wholes.withColumn("__part", F.explode(F.array_distinct(F.concat(*map(stretches, sorted(found))))))
    return cut_up.join(parts, F.col("__part") == F.col(part)).drop("__part")


def artist_buckets(artists: DataFrame, feed: DataFrame, tags: DataFrame, *, household: Sequence[str] = ()) -> DataFrame:
    """Bucket of each act: the household's own, else that of its first tag in feed order (``rank``) that has one, else other."""
    first = feed.join(tags, "tag").groupBy("artist").agg(F.min(F.struct("rank", "bucket"))["bucket"].alias("tagged"))
    own = F.when(is_household(F.col("artist"), household), "kids/household").otherwise(F.coalesce("tagged", F.lit("other")))
    return artists.select("artist").distinct().join(first, "artist", "left").select("artist", own.alias("bucket"))


def genre_waves(year_top: DataFrame, buckets: DataFrame) -> DataFrame:
    """Plays by year and bucket over each year's top acts only."""
    return year_top.join(buckets, "artist", "left").groupBy("year", F.coalesce("bucket", F.lit("other")).alias("bucket")).agg(F.sum("plays").alias("plays"))


def month_buckets(artist_months: DataFrame, buckets: DataFrame) -> DataFrame:
    return artist_months.join(buckets, "artist", "left").groupBy("month", F.coalesce("bucket", F.lit("other")).alias("bucket")).agg(F.sum("n").alias("n"))


def enriched_tracks(tracks: DataFrame, meta: DataFrame) -> DataFrame:
    """Tracks with duration and popularity of their uri, and the hours their plays would take; null where unknown."""
    m = meta.select("uri", "duration_ms", "popularity")
    return tracks.join(m, "uri", "left").withColumns({"hours_played": hours(F.col("ms"), 2), "estimated_hours": estimated_hours(F.col("plays"), F.col("duration_ms"))})


def enriched_albums(albums: DataFrame, tracks: DataFrame, album_meta: DataFrame, by_name: DataFrame, played: DataFrame) -> DataFrame:
    """Albums (``artist, album, uri, name_key``) with their catalog record: by the track's album, else by name where matched.

    ``art_source`` tells which; ``completion`` is the share of the record's tracks among the ``played`` uris.
    """
    two = albums.join(tracks.select("uri", F.col("album_id").alias("by_uri")), "uri", "left")
    three = two.join(by_name.where("matched").select("name_key", F.col("album_id").alias("by_name")), "name_key", "left")
    chosen = three.withColumns({"album_id": F.coalesce("by_uri", "by_name"), "art_source": F.when(F.col("by_uri").isNotNull(), "uri").when(F.col("by_name").isNotNull(), "name")})
    heard = played.select("uri").distinct().join(tracks.select("uri", "album_id"), "uri").groupBy("album_id").agg(F.countDistinct("uri").alias("heard"))
    full = chosen.join(album_meta.select("album_id", "total_tracks", "release_year"), "album_id", "left").join(heard, "album_id", "left")
    return full.withColumn("completion", F.when(F.col("total_tracks") > 0, F.round(F.coalesce("heard", F.lit(0)) / F.col("total_tracks"), 3))).drop("by_uri", "by_name")


def deep_cuts(stories: DataFrame, tracks: DataFrame, artists: DataFrame, *, least: int = 15, most: int = 10_000) -> DataFrame:
    """Each act's best track against the act's best known one; an act id counts for the first track that reaches it.

    ``stories`` (``pos, artist, title, plays, uri``) is a ranked list of at most ``most`` rows (more raise), as the greedy order is one fold over its
    candidates.
    """
    stories = sized(stories, most)
    w = Window.partitionBy("artist").orderBy(F.desc("plays"), "pos")
    seat = Window.partitionBy("artist")
    best = stories.select("*", F.row_number().over(w).alias("n"), F.min("pos").over(seat).alias("seat")).where("n = 1").drop("n")
    known = best.join(tracks.where("popularity is not null").select("uri", "popularity", "artist_ids"), "uri")
    ids = known.select("seat", "artist", "title", "uri", "popularity", F.posexplode("artist_ids").alias("nth", "artist_id"))
    cand = ids.join(artists.select("artist_id", "max_popularity", "top_track_name"), "artist_id")
    listed = cand.groupBy("seat", "artist", "title", "uri", "popularity").agg(F.sort_array(F.collect_list(F.struct("nth", "artist_id", "max_popularity", "top_track_name"))).alias("c"))
    line = listed.agg(F.sort_array(F.collect_list(F.struct("seat", "artist", "title", "uri", "popularity", "c"))).alias("all"))
    start = F.expr("named_struct('seen', cast(array() as array<string>), 'out', cast(array() as array<struct<seat:int,pick:int>>))")

    def visit(acc: Column, x: Column) -> Column:
        # candidates before the first usable one are consumed too; ones taken earlier are passed over
        fresh = F.filter(x["c"], lambda k: ~F.array_contains(acc["seen"], k["artist_id"]))
        usable = F.filter(fresh, lambda k: k["max_popularity"].isNotNull())
        pick = F.get(usable, F.lit(0))
        eaten = F.when(F.size(usable) > 0, F.filter(fresh, lambda k: k["nth"] <= pick["nth"])).otherwise(fresh)
        seen = F.concat(acc["seen"], F.transform(eaten, lambda k: k["artist_id"].cast("string")))
        out = F.when(F.size(usable) > 0, F.concat(acc["out"], F.array(F.struct(x["seat"].cast("int").alias("seat"), pick["nth"].cast("int").alias("pick"))))).otherwise(acc["out"])
        return F.struct(seen.alias("seen"), out.alias("out"))

    chosen = line.select(F.explode(F.aggregate("all", start, visit, lambda acc: acc["out"])).alias("p"))
    hits = listed.join(chosen, F.col("seat") == F.col("p.seat")).select("artist", "title", "uri", "popularity", F.filter("c", lambda k: k["nth"] == F.col("p.pick"))[0].alias("a"))
    diff = F.col("a.max_popularity") - F.col("popularity")
    return hits.select("artist", F.col("title").alias("user_track"), "uri", F.col("popularity").alias("user_popularity"), F.col("a.top_track_name").alias("artist_top_track"), F.col("a.max_popularity").alias("artist_max_popularity"), diff.alias("diff"), ((diff >= least) & (F.col("title") != F.col("a.top_track_name"))).alias("is_deep_cut"))


def contrarian_score(cuts: DataFrame) -> DataFrame:
    return cuts.agg(F.coalesce(F.round(F.avg(F.col("is_deep_cut").cast("int")), 3), F.lit(0.0)).alias("contrarian_score"))


def ordered_distinct(parts: Sequence[DataFrame], column: str) -> DataFrame:
    """Distinct values of several ranked lists (``pos`` and the column), in order of first appearance."""
    whole = None
    for i, part in enumerate(parts):
        one = part.select(F.lit(i).alias("part"), "pos", column)
        whole = one if whole is None else whole.unionByName(one)
    return whole.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.min(F.struct("part", "pos")).alias("at")).select(column, F.col("at.part").alias("part"), F.col("at.pos").alias("pos"))


def top_genres(artists: DataFrame, *, acts: int = 30, n: int = 15) -> DataFrame:
    """Most frequent genres among the first ``acts`` acts (``pos, name, genres``); ties go to the genre met first."""
    head = artists.orderBy("pos").limit(acts).select("pos", F.posexplode("genres").alias("nth", "genre"))
    return head.groupBy("genre").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "nth")).alias("met")).orderBy(F.desc("n"), "met").limit(n).drop("met")


# Discovery ledger


def act_key(artist: Column) -> Column:
    return F.lower(F.trim(artist))


def surfaced(ledger: DataFrame, column: str) -> DataFrame:
    """Distinct acts (in lower case) or identifiers of the ledger."""
    value = act_key(F.col(column)) if column == "artist" else F.col(column)
    return ledger.where(F.col(column).isNotNull()).select(value.alias(column)).distinct()


def known_acts(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct act keys of several sources (column ``artist``)."""
    whole = None
    for part in parts:
        one = part.where("artist is not null").select(act_key(F.col("artist")).alias("artist"))
        whole = one if whole is None else whole.union(one)
    return whole.distinct()


def split_new(records: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of unknown acts, and those of known ones."""
    keyed = records.withColumn("__k", act_key(F.col("artist")))
    k = known.select(F.col("artist").alias("__k")).distinct()
    return keyed.join(k, "__k", "left_anti").drop("__k"), keyed.join(k, "__k", "left_semi").drop("__k")


def earliest(ledger: DataFrame) -> DataFrame:
    """Earliest record of each act (a missing instant sorts first, the first of equals stays)."""
    w = Window.partitionBy(F.lower("artist")).orderBy(F.coalesce("ts", F.lit("")), "ord")
    return ledger.where("artist is not null and artist <> ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def discovery(ledger: DataFrame, known: DataFrame, buckets: DataFrame) -> DataFrame:
    """Discoveries with bucket and whether the act stuck (is known by now)."""
    k = known.select(F.col("artist").alias("__k"), F.lit(True).alias("stuck")).distinct()
    rows = earliest(ledger).withColumn("__k", F.lower("artist")).join(k, "__k", "left").join(buckets, "artist", "left")
    return rows.select(F.substring(F.coalesce("ts", F.lit("")), 1, 10).alias("date"), "artist", F.coalesce("bucket", F.lit("other")).alias("bucket"), F.coalesce("stuck", F.lit(False)).alias("stuck"), id_of_uri(F.col("playlist")).alias("playlist"), "recipe")


def ledger_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if("stuck").alias("stuck_count"))


def recent(ledger: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` records in the order they were written."""
    return ledger.orderBy(F.desc("ord")).limit(n).orderBy("ord")


# Neighbour graph


def graph_edges(nodes: DataFrame, feed: DataFrame, *, least: float = 0.05) -> DataFrame:
    """Undirected edges between listed nodes (``i, name, key``) from a feed (``artist, neighbor_key, match, pos``).

    Weight is the highest match; mutual tells that at least two feed rows made the edge. Node keys repeated resolve to the last node.
    """
    target = nodes.groupBy("key").agg(F.max("i").alias("j"))
    links = feed.where("match is not null").join(nodes.select("i", F.col("name").alias("artist")), "artist").join(target, feed["neighbor_key"] == target["key"]).where((F.col("i") != F.col("j")) & (F.col("match") >= least))
    pair = links.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "match")
    return pair.groupBy("a", "b").agg(F.round(F.max("match"), 3).alias("weight"), (F.count(F.lit(1)) >= 2).alias("mutual"))


def outside_neighbors(nodes: DataFrame, feed: DataFrame, *, least: float = 0.3, n: int = 5) -> DataFrame:
    """First ``n`` neighbours of each node, in feed order, that aren't nodes themselves."""
    far = feed.where(F.col("match") >= least).join(nodes.select("key").distinct(), feed["neighbor_key"] == nodes["key"], "left_anti").join(nodes.select(F.col("name").alias("artist")).distinct(), "artist", "left_semi")
    return far.withColumn("rank", F.row_number().over(Window.partitionBy("artist").orderBy("pos"))).where(F.col("rank") <= n).select("artist", "rank", "neighbor", F.round("match", 3).alias("match"))


def graph_stats(nodes: DataFrame, feed: DataFrame, errors: DataFrame) -> DataFrame:
    """Nodes fetched, nodes without neighbours, nodes whose fetch failed."""
    with_feed = feed.select("artist").distinct().withColumn("fed", F.lit(1))
    failed = errors.select("artist").distinct().withColumn("bad", F.lit(1))
    j = nodes.select(F.col("name").alias("artist")).join(with_feed, "artist", "left").join(failed, "artist", "left")
    return j.agg(F.count_if(F.col("bad").isNull()).alias("fetched"), F.count_if(F.col("bad").isNull() & F.col("fed").isNull()).alias("no_neighbors"), F.count_if(F.col("bad").isNotNull()).alias("errors"))
