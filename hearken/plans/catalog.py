"""Queries of cleaning, matching, the merge layer and the graph on the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken.functions.classify import device_family, safe_int, split_pair, title_key
from hearken.functions.names import CONNECTORS, act_heads, album_core_udf, artist_key_udf, keyed, plain_key_udf, same_act, track_core_udf
from hearken.operators import catalog as C
from hearken.operators import companion as P
from hearken.operators import history as H
from hearken.operators import timeline as L
from hearken.plans.history import E_SQL, HOUSEHOLD, events
from hearken.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


# Cleaning

PAIR_SQL = """CASE WHEN strpos({0}, ' - ') > 0 AND trim({0}[:strpos({0}, ' - ') - 1]) <> '' AND trim({0}[strpos({0}, ' - ') + 3:]) <> '' THEN trim({0}[{1}]) END"""
ARTIST_SQL = lambda t: PAIR_SQL.format(t, f":strpos({t}, ' - ') - 1")
TITLE_SQL = lambda t: PAIR_SQL.format(t, f"strpos({t}, ' - ') + 3:")
KEY_SQL = lambda t: f"lower(trim(regexp_replace({t}, '\\s+', ' ', 'g')))"


@query("split_pairs", f"SELECT record_id, {ARTIST_SQL('track_name')} AS artist, {TITLE_SQL('track_name')} AS title FROM apple_history WHERE {ARTIST_SQL('track_name')} IS NOT NULL")
def _(spark, folder):
    return table(spark, folder, "apple_history").select("record_id", split_pair(F.col("track_name")).alias("x")).where("x is not null").select("record_id", "x.artist", "x.title")


MAP_SQL = f""", b AS (SELECT record_id AS o, track_description AS t, 1 AS f FROM apple_history UNION ALL SELECT record_id, track_name, 0 FROM apple_history),
x AS (SELECT {KEY_SQL(TITLE_SQL('t'))} AS key, {ARTIST_SQL('t')} AS artist, o, f FROM b WHERE {ARTIST_SQL('t')} IS NOT NULL),
m AS (SELECT key, arg_max(artist, (f, o, artist)) AS artist FROM x GROUP BY 1) """


def _map(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "apple_history")
    daily = rows.select(F.col("track_description").alias("t"), "record_id")
    return P.title_map(daily, rows.select(F.col("track_name").alias("t"), "record_id"), text="t", order="record_id")


@query("title_map", "WITH z AS (SELECT 1)" + MAP_SQL + "SELECT * FROM m")
def _(spark, folder):
    return _map(spark, folder)


@query("title_resolution", E_SQL + MAP_SQL + f""", k AS (SELECT ord, artist AS own, {KEY_SQL('title')} AS key FROM e)
SELECT ord, key, coalesce(m.artist, CASE WHEN k.own IN ('Kobosk Jogion', 'Lady Pudu') THEN k.own END) AS artist, m.artist IS NULL AND k.own IN ('Kobosk Jogion', 'Lady Pudu') AS via_override
FROM k LEFT JOIN m USING (key) WHERE m.artist IS NOT NULL OR k.own IN ('Kobosk Jogion', 'Lady Pudu')""")
def _(spark, folder):
    # overrides: titles of two acts, by hand in the export, from their own listens here
    rows = events(spark, folder).select("ord", F.col("artist").alias("own"), title_key(F.col("title")).alias("key"))
    own = F.when(F.col("own").isin(*HOUSEHOLD), F.col("own"))
    joined = rows.join(_map(spark, folder), "key", "left")
    return joined.select("ord", "key", F.coalesce("artist", own).alias("artist"), (F.col("artist").isNull() & own.isNotNull()).alias("via_override")).where("artist is not null")


@query("clean_durations", """SELECT record_id, coalesce(TRY_CAST(trunc(TRY_CAST(trim(play_duration_milliseconds) AS DOUBLE)) AS BIGINT), -1) AS raw_ms,
  CASE WHEN greatest(coalesce(TRY_CAST(trunc(TRY_CAST(trim(play_duration_milliseconds) AS DOUBLE)) AS BIGINT), 0), 0) > 400000 THEN 200000 ELSE greatest(coalesce(TRY_CAST(trunc(TRY_CAST(trim(play_duration_milliseconds) AS DOUBLE)) AS BIGINT), 0), 0) END AS ms FROM apple_history""")
def _(spark, folder):
    raw = safe_int(F.col("play_duration_milliseconds"))
    return table(spark, folder, "apple_history").select("record_id", F.coalesce(raw, F.lit(-1)).alias("raw_ms"), P.clamped(raw, F.lit(200_000)).alias("ms"))


REASON_SQL = f"""r AS (SELECT record_id, trim(coalesce(track_description, track_name, '')) AS t, date_played, TRY_CAST(trunc(TRY_CAST(trim(play_duration_milliseconds) AS DOUBLE)) AS BIGINT) AS ms FROM apple_history),
j AS (SELECT *, CASE WHEN t = '' THEN 'no_song_name' WHEN date_played IS NULL OR NOT regexp_full_match(date_played, '\\d{{8}}') THEN 'no_timestamp' WHEN ms IS NULL THEN 'no_duration' WHEN ms < 0 THEN 'negative' END AS reason FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, date_played, {KEY_SQL('t')}, ms ORDER BY record_id) AS k FROM j) """


@query("drop_reasons", f"WITH {REASON_SQL} SELECT coalesce(reason, CASE WHEN k > 1 THEN 'duplicate' END, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1")
def _(spark, folder):
    rows = table(spark, folder, "apple_history").select("record_id", F.trim(F.coalesce("track_description", "track_name", F.lit(""))).alias("t"), "date_played", safe_int(F.col("play_duration_milliseconds")).alias("ms"))
    reason = P.first_reason([("no_song_name", F.col("t") == ""), ("no_timestamp", F.col("date_played").isNull() | ~F.col("date_played").rlike(r"^\d{8}$")), ("no_duration", F.col("ms").isNull()), ("negative", F.col("ms") < 0)])
    judged = rows.withColumn("drop_reason", reason)
    again = F.row_number().over(Window.partitionBy(F.col("drop_reason").isNull(), "date_played", title_key(F.col("t")), "ms").orderBy("record_id")) > 1
    return P.drop_counts(judged.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & again, "duplicate").otherwise(F.col("drop_reason"))))


@query("dedup_events", E_SQL + f"SELECT ord, us, {KEY_SQL('title')} AS key, ms FROM (SELECT *, row_number() OVER (PARTITION BY us, {KEY_SQL('title')}, ms ORDER BY ord) AS k FROM e) WHERE k = 1")
def _(spark, folder):
    rows = events(spark, folder).select("ord", "us", title_key(F.col("title")).alias("key"), "ms")
    return P.first_of(rows, ["us", "key", "ms"], ["ord"])


@query("union_services", E_SQL + """SELECT service, part, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (SELECT service, us, CASE WHEN service = 'spotify' THEN 0 ELSE 1 END AS part FROM e) GROUP BY 1, 2""")
def _(spark, folder):
    e = events(spark, folder)
    one = e.where("service = 'spotify'").withColumn("part", F.lit(0)).unionByName(e.where("service <> 'spotify'").withColumn("part", F.lit(1)))
    return one.groupBy("service", "part").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("device_families", """SELECT platform, CASE WHEN lower(platform) LIKE '%ios/%' OR lower(platform) LIKE '%iphone%' OR lower(platform) LIKE '%ipad%' THEN 'iOS' WHEN lower(platform) LIKE '%macintosh%' OR lower(platform) LIKE '%os x%' OR lower(platform) LIKE '%mac os%' THEN 'Macintosh'
  WHEN lower(platform) LIKE '%windows%' THEN 'Windows' WHEN lower(platform) LIKE '%android%' THEN 'Android' ELSE 'unknown' END AS family, count(*) AS n FROM streaming_history GROUP BY 1, 2""")
def _(spark, folder):
    return table(spark, folder, "streaming_history").groupBy("platform").agg(F.count(F.lit(1)).alias("n")).select("platform", device_family(F.col("platform")).alias("family"), "n")


# Names

PLAIN_SQL = lambda s: f"trim(regexp_replace(replace(lower(strip_accents({s})), '&', ' and '), '[^0-9a-z]+', ' ', 'g'))"
MARKS_SQL = lambda s: "replace(" * 3 + s + ", '’', ''''), '…', '...'), '–', '-')"
EDITION = "deluxe|remaster|remastered|bonus track|bonus tracks|special edition|expanded|expanded edition|anniversary|reissue|explicit|clean|mono|stereo|digital|collector|legacy edition|super deluxe|extended edition|japanese edition|international version|us version|uk version|version"
FORMATS = r"\s+-\s+(ep|single|remixes?|radio edit|edit|deluxe|deluxe version|bonus track version|remastered(\s+\d{4})?|\d{4} remaster(ed)?|live)\s*$"
_FEAT = r"\s*[\(\[]\s*(feat\.?|ft\.?|featuring|with)\s[^\)\]]*[\)\]]"
_GROUP = rf"\s*[\(\[][^\)\]]*({EDITION})[^\)\]]*[\)\]]"
_BARE = lambda s: f"regexp_replace(regexp_replace({s}, '{_FEAT}', ' ', 'gi'), '{_GROUP}', ' ', 'gi')"
_TAIL = lambda s: f"regexp_replace({s}, '{FORMATS}', '', 'i')"
AKEY_SQL = lambda s: f"regexp_replace({PLAIN_SQL(MARKS_SQL(s))}, '^the\\s+', '')"
CORE_SQL = lambda s: PLAIN_SQL(MARKS_SQL(_TAIL(_TAIL(_TAIL(_BARE(s))))))


@query("norm_acts", f"SELECT DISTINCT artist, {PLAIN_SQL(MARKS_SQL('artist'))} AS plain, {AKEY_SQL('artist')} AS akey FROM lastfm WHERE artist IS NOT NULL")
def _(spark, folder):
    acts = table(spark, folder, "lastfm").where("artist is not null").select("artist").distinct()
    return acts.select("artist", plain_key_udf("artist").alias("plain"), artist_key_udf("artist").alias("akey"))


@query("norm_albums", f"SELECT DISTINCT master_metadata_album_album_name AS album, {CORE_SQL('master_metadata_album_album_name')} AS core FROM streaming_history WHERE master_metadata_album_album_name IS NOT NULL")
def _(spark, folder):
    albums = table(spark, folder, "streaming_history").select(F.col("master_metadata_album_album_name").alias("album")).where("album is not null").distinct()
    return albums.select("album", album_core_udf("album").alias("core"))


_TRACK = lambda s: PLAIN_SQL(MARKS_SQL(_TAIL(f"regexp_replace(regexp_replace(regexp_replace({s}, '{_FEAT}', ' ', 'gi'), '\\s+(feat\\.?|ft\\.?|featuring)\\s+.*$', '', 'i'), '{_GROUP}', ' ', 'gi')")))


@query("norm_tracks", f"SELECT DISTINCT master_metadata_track_name AS title, {_TRACK('master_metadata_track_name')} AS core FROM streaming_history WHERE master_metadata_track_name IS NOT NULL")
def _(spark, folder):
    titles = table(spark, folder, "streaming_history").select(F.col("master_metadata_track_name").alias("title")).where("title is not null").distinct()
    return titles.select("title", track_core_udf("title").alias("core"))


@query("act_extensions", f"""WITH l AS (SELECT DISTINCT {AKEY_SQL('artist')} AS a FROM paste300_albums), h AS (SELECT DISTINCT {AKEY_SQL('artist')} AS b FROM lastfm WHERE artist IS NOT NULL)
SELECT DISTINCT a, b FROM l JOIN h ON a <> '' AND b <> '' AND (a = b
  OR (starts_with(b, a || ' ') AND contains(a, ' ') AND split_part(substr(b, length(a) + 2), ' ', 1) IN {CONNECTORS})
  OR (starts_with(a, b || ' ') AND contains(b, ' ') AND split_part(substr(a, length(b) + 2), ' ', 1) IN {CONNECTORS}))""")
def _(spark, folder):
    listed = table(spark, folder, "paste300_albums").select(artist_key_udf("artist").alias("a")).distinct()
    feed = table(spark, folder, "lastfm").where("artist is not null").select("artist").distinct().select(artist_key_udf("artist").alias("b")).distinct()
    heads = lambda df, c: df.select(c, F.explode(act_heads(F.col(c))).alias("head"))
    return heads(feed, "b").join(heads(listed, "a"), "head").where(same_act(F.col("a"), F.col("b"))).select("a", "b").distinct()


@query("fuzzy_titles")
def _(spark, folder):
    """Best album of the list for each of the feed's most heard albums, by similarity of their cores."""
    wanted = H.album_totals(events(spark, folder)).select("artist", F.col("album").alias("name"))
    listed = table(spark, folder, "paste300_albums").select(F.col("list_rank").alias("id"), "artist", F.col("album").alias("name"), F.col("list_rank").alias("pos"))
    return C.best_album(wanted, listed)


@query("proposal_tiers")
def _(spark, folder):
    """Tier of each companion title with a hint, against the streamed tracks of the same title key."""
    heard = H.album_tracks(events(spark, folder)).select("artist", F.col("title").alias("track"), "album", title_key(F.col("title")).alias("key"))
    hits = heard.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("artist", "album", "track")))
    songs = hits.groupBy("key").agg(F.min("track").alias("title"), F.max("album").alias("hint"))
    return C.proposals(songs, hits)


@query("canon_tiers", E_SQL + f""", c AS (SELECT list_rank AS rank, artist, album, {AKEY_SQL('artist')} AS akey, {CORE_SQL('album')} AS core FROM paste300_albums),
h AS (SELECT {AKEY_SQL('artist')} AS akey, {CORE_SQL('album')} AS core, count(*) AS n FROM o GROUP BY 1, 2), ac AS (SELECT akey, sum(n) AS n FROM h GROUP BY 1),
kn AS (SELECT DISTINCT {AKEY_SQL('artist')} AS akey FROM lastfm WHERE artist IS NOT NULL),
b AS (SELECT c.rank, sum(h.n) AS n FROM c JOIN h ON c.akey = h.akey AND h.core <> '' AND c.core <> '' AND (contains(h.core, c.core) OR contains(c.core, h.core)) GROUP BY 1),
t AS (SELECT c.rank, c.artist, c.album, CAST(coalesce(ac.n, 0) AS BIGINT) AS artist_plays, CAST(coalesce(b.n, 0) AS BIGINT) AS album_plays, kn.akey IS NOT NULL AS lib FROM c LEFT JOIN ac ON c.akey = ac.akey LEFT JOIN b ON c.rank = b.rank LEFT JOIN kn ON c.akey = kn.akey)
SELECT rank, artist, album, artist_plays, album_plays, CASE WHEN album_plays >= 15 THEN 'lived_in' WHEN album_plays > 0 THEN 'brushed' WHEN artist_plays >= 4 OR lib THEN 'near_miss' ELSE 'unheard' END AS tier, lib AND artist_plays = 0 AS library_only FROM t""")
def _(spark, folder):
    return _tiers(spark, folder)


def _tiers(spark: SparkSession, folder: str) -> DataFrame:
    acts, albums = C.play_maps(H.own_plays(events(spark, folder)))
    known = table(spark, folder, "lastfm").where("artist is not null").select("artist").distinct().select(artist_key_udf("artist").alias("akey"))
    return C.canon_tiers(table(spark, folder, "paste300_albums").withColumnRenamed("list_rank", "rank"), acts, albums, known)


@query("canon_order", ORACLES["canon_tiers"].replace("SELECT rank, artist, album, artist_plays, album_plays, CASE", ", z AS (SELECT rank, artist_plays, album_plays, CASE").replace(" AS library_only FROM t", " AS library_only FROM t)") + """
SELECT rank, tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY CASE WHEN tier IN ('lived_in', 'brushed') THEN album_plays WHEN tier = 'near_miss' THEN artist_plays ELSE -rank END DESC,
  CASE WHEN tier = 'brushed' THEN artist_plays ELSE 0 END DESC, rank) AS INT) AS place FROM z""")
def _(spark, folder):
    return C.tier_order(_tiers(spark, folder)).select("rank", "tier", "place")


@query("canon_counts", ORACLES["canon_order"].split("\nSELECT rank, tier, CAST")[0] + "\nSELECT tier, count(*) AS n, CAST(sum(album_plays) AS BIGINT) AS plays FROM z GROUP BY 1")
def _(spark, folder):
    return C.tier_counts(_tiers(spark, folder), "album_plays")


# Merge layer

BUCKET_SQL = """bk AS (SELECT entry_no AS o, lower(entry) AS key, bucket_name AS bucket FROM tag_buckets), tg AS (SELECT DISTINCT tag, lower(trim(tag)) AS t FROM lastfm WHERE tag IS NOT NULL AND trim(tag) <> ''),
tb AS (SELECT tag, arg_min(bucket, (t <> key, o)) AS bucket FROM tg JOIN bk ON contains(t, key) OR contains(key, t) GROUP BY 1) """
ARTIST_BUCKET_SQL = (
    BUCKET_SQL
    + """, fb AS (SELECT artist, arg_min(bucket, (tag_rank, bucket)) AS b FROM lastfm JOIN tb USING (tag) WHERE artist IS NOT NULL GROUP BY 1),
ab AS (SELECT DISTINCT x.artist, CASE WHEN x.artist IN ('Kobosk Jogion', 'Lady Pudu') OR regexp_matches(x.artist, '(?i)white\\s+noise') THEN 'kids/household' ELSE coalesce(b, 'other') END AS bucket
  FROM (SELECT artist FROM lastfm WHERE artist IS NOT NULL UNION SELECT artist FROM e) x LEFT JOIN fb ON x.artist = fb.artist) """
)


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "tag_buckets").select(F.col("entry_no").alias("ord"), F.col("entry").alias("key"), F.col("bucket_name").alias("bucket"))
    return L.tag_buckets(table(spark, folder, "lastfm").select("tag"), listed)


def _buckets(spark: SparkSession, folder: str) -> DataFrame:
    feed = table(spark, folder, "lastfm").where("artist is not null").select("artist", "tag", F.col("tag_rank").alias("rank"))
    return L.artist_buckets(feed.select("artist").union(events(spark, folder).select("artist")), feed, _tags(spark, folder), household=HOUSEHOLD)


@query("tag_buckets_map", f"WITH {BUCKET_SQL} SELECT * FROM tb")
def _(spark, folder):
    return _tags(spark, folder)


@query("artist_buckets", E_SQL + ", " + ARTIST_BUCKET_SQL + "SELECT * FROM ab")
def _(spark, folder):
    return _buckets(spark, folder)


YTOP_SQL = """, y AS (SELECT artist, year, count(*) AS plays FROM p GROUP BY 1, 2), f AS (SELECT artist, min(us) AS f FROM e GROUP BY 1),
yt AS (SELECT * FROM (SELECT y.*, row_number() OVER (PARTITION BY year ORDER BY plays DESC, f, y.artist) AS rank FROM y JOIN f ON y.artist = f.artist) WHERE rank <= 25)"""


@query("genre_waves", E_SQL + ", " + ARTIST_BUCKET_SQL + YTOP_SQL + " SELECT year, coalesce(bucket, 'other') AS bucket, CAST(sum(plays) AS BIGINT) AS plays FROM yt LEFT JOIN ab USING (artist) GROUP BY 1, 2")
def _(spark, folder):
    return L.genre_waves(H.year_top_artists(events(spark, folder)), _buckets(spark, folder))


@query("month_buckets", E_SQL + ", " + ARTIST_BUCKET_SQL + """, rk AS (SELECT artist, count(*) FILTER (WHERE is_play) AS plays, min(us) AS f, bool_or(household) AS hh FROM e GROUP BY 1),
tp AS (SELECT artist FROM rk WHERE NOT hh ORDER BY plays DESC, f, artist LIMIT 200)
SELECT month, coalesce(bucket, 'other') AS bucket, count(*) AS n FROM o JOIN tp USING (artist) LEFT JOIN ab USING (artist) GROUP BY 1, 2""")
def _(spark, folder):
    return L.month_buckets(H.artist_months(events(spark, folder)), _buckets(spark, folder))


#: A catalog made of the listens themselves: a track's duration is its longest listen, its popularity its share of the most played.
META_SQL = """, me AS (SELECT uri, max(ms) AS duration_ms, CAST(count(*) % 100 AS INT) AS popularity, max(album) AS album_id FROM e WHERE uri <> '' GROUP BY 1),
tr AS (SELECT artist, title, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms, coalesce(arg_max(uri, (us, ord)) FILTER (WHERE uri <> ''), '') AS uri, min(us) AS f FROM o GROUP BY 1, 2 ORDER BY plays DESC, f, artist, title LIMIT 100)"""


def _meta(e: DataFrame) -> DataFrame:
    return e.where("uri <> ''").groupBy("uri").agg(F.max("ms").alias("duration_ms"), (F.count(F.lit(1)) % 100).cast("int").alias("popularity"), F.max("album").alias("album_id"))


def _stories(e: DataFrame) -> DataFrame:
    return H.top(H.track_totals(e).where("not household"), 100, F.desc("plays"), "first_us", "artist", "title")


@query("enriched_tracks", E_SQL + META_SQL + " SELECT tr.artist, tr.title, tr.plays, round(tr.ms / 3600000.0::DOUBLE, 2) AS hours_played, coalesce(duration_ms, -1) AS duration_ms, coalesce(popularity, -1) AS popularity, round(tr.plays * duration_ms / 3600000.0::DOUBLE, 2) AS estimated_hours FROM tr LEFT JOIN me USING (uri)")
def _(spark, folder):
    e = events(spark, folder)
    return L.enriched_tracks(_stories(e), _meta(e)).select("artist", "title", "plays", "hours_played", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"), F.coalesce("popularity", F.lit(-1)).alias("popularity"), "estimated_hours")


@query("album_completion", E_SQL + META_SQL + """, ta AS (SELECT artist, album, count(*) AS plays, min(us) AS f, coalesce(arg_max(uri, (us, ord)) FILTER (WHERE uri <> ''), '') AS uri FROM o WHERE album <> '' GROUP BY 1, 2 ORDER BY plays DESC, f, artist, album LIMIT 80),
am AS (SELECT album_id, count(*) AS total_tracks FROM me GROUP BY 1), pl AS (SELECT DISTINCT uri FROM tr), hd AS (SELECT album_id, count(DISTINCT uri) AS heard FROM pl JOIN me USING (uri) GROUP BY 1)
SELECT ta.artist, ta.album, coalesce(me.album_id, ta.album) AS album_id, CASE WHEN me.album_id IS NOT NULL THEN 'uri' ELSE 'name' END AS art_source, round(coalesce(heard, 0) / total_tracks::DOUBLE, 3) AS completion
FROM ta LEFT JOIN me USING (uri) LEFT JOIN am ON am.album_id = coalesce(me.album_id, ta.album) LEFT JOIN hd ON hd.album_id = coalesce(me.album_id, ta.album)""")
def _(spark, folder):
    e = events(spark, folder)
    meta = _meta(e)
    last = F.max(F.when(F.col("uri") != "", F.struct("us", "ord", "uri")))["uri"]
    uris = H.own_plays(e).where("album <> ''").groupBy("artist", "album").agg(F.coalesce(last, F.lit("")).alias("uri"))
    albums = H.top(H.album_totals(e), 80, F.desc("plays"), "first_us", "artist", "album").join(uris, ["artist", "album"]).withColumn("name_key", F.col("album"))
    names = albums.select("name_key", F.col("album").alias("album_id"), F.lit(True).alias("matched")).distinct()
    totals = meta.groupBy("album_id").agg(F.count(F.lit(1)).alias("total_tracks")).withColumn("release_year", F.lit(None).cast("int"))
    return L.enriched_albums(albums, meta, totals, names, _stories(e)).select("artist", "album", "album_id", "art_source", "completion")


@query("deep_cuts", E_SQL + META_SQL + """, bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY plays DESC, f, title) AS k FROM tr) WHERE k = 1),
ar AS (SELECT artist AS artist_id, max(popularity) AS mx, arg_max(title, (popularity, title)) AS top FROM (SELECT DISTINCT e.artist, e.title, me.popularity FROM e JOIN me USING (uri)) GROUP BY 1)
SELECT bs.artist, bs.title AS user_track, bs.uri, me.popularity AS user_popularity, ar.top AS artist_top_track, ar.mx AS artist_max_popularity, ar.mx - me.popularity AS diff, ar.mx - me.popularity >= 15 AND bs.title <> ar.top AS is_deep_cut
FROM bs JOIN me USING (uri) JOIN ar ON ar.artist_id = bs.artist""")
def _(spark, folder):
    e = events(spark, folder)
    cuts = _deep_cuts(e)
    return cuts


def _deep_cuts(e: DataFrame) -> DataFrame:
    meta = _meta(e)
    order = Window.orderBy(F.desc("plays"), "first_us", "artist", "title")
    stories = _stories(e).withColumn("pos", F.row_number().over(order))
    owner = e.where("uri <> ''").groupBy("uri").agg(F.min("artist").alias("a"))
    tracks = meta.join(owner, "uri").select("uri", "popularity", F.array("a").alias("artist_ids"))
    best = e.join(meta, "uri").select("artist", "title", "popularity").distinct().groupBy("artist").agg(F.max(F.struct("popularity", "title")).alias("m"))
    return L.deep_cuts(stories, tracks, best.select(F.col("artist").alias("artist_id"), F.col("m.popularity").alias("max_popularity"), F.col("m.title").alias("top_track_name")))


@query("contrarian_score", ORACLES["deep_cuts"].replace("SELECT bs.artist, bs.title AS user_track", ", z AS (SELECT bs.artist, bs.title AS user_track") + ") SELECT coalesce(round(avg(CAST(is_deep_cut AS INT)), 3), 0.0) AS contrarian_score FROM z")
def _(spark, folder):
    return L.contrarian_score(_deep_cuts(events(spark, folder)))


@query("anti_known", E_SQL + """, kn AS (SELECT artist FROM (SELECT artist, count(*) FILTER (WHERE is_play) AS n, min(us) AS f FROM e GROUP BY 1 ORDER BY n DESC, f, artist LIMIT 400))
SELECT feed_no, artist FROM lastfm WHERE artist IS NOT NULL AND lower(trim(artist)) NOT IN (SELECT lower(trim(artist)) FROM kn)""")
def _(spark, folder):
    known = L.known_acts([H.top_artists(events(spark, folder))])
    return L.split_new(table(spark, folder, "lastfm").where("artist is not null").select("feed_no", "artist"), known)[0]


@query("known_union", "SELECT DISTINCT lower(trim(artist)) AS artist FROM (SELECT artist FROM lastfm UNION ALL SELECT artist FROM paste300_albums UNION ALL SELECT artist FROM documents) WHERE artist IS NOT NULL")
def _(spark, folder):
    return L.known_acts([table(spark, folder, t).select("artist") for t in ("lastfm", "paste300_albums", "documents")])


LEDGER_SQL = "lg AS (SELECT doc_id AS ord, artist, strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') AS ts, source AS recipe FROM documents), er AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(artist) ORDER BY coalesce(ts, ''), ord) AS k FROM lg WHERE artist <> '') WHERE k = 1)"


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("ord"), "artist", F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("source").alias("recipe"), F.lit(None).cast("string").alias("playlist"))


@query("earliest_mentions", f"WITH {LEDGER_SQL} SELECT ord, artist, ts, recipe FROM er")
def _(spark, folder):
    return L.earliest(_ledger(spark, folder)).select("ord", "artist", "ts", "recipe")


@query("discoveries", E_SQL + ", " + ARTIST_BUCKET_SQL + f", {LEDGER_SQL}, kn AS (SELECT DISTINCT lower(trim(artist)) AS k FROM p) SELECT substr(coalesce(ts, ''), 1, 10) AS date, er.artist, coalesce(ab.bucket, 'other') AS bucket, kn.k IS NOT NULL AS stuck, recipe FROM er LEFT JOIN kn ON lower(er.artist) = kn.k LEFT JOIN ab ON er.artist = ab.artist")
def _(spark, folder):
    known = L.known_acts([H.plays(events(spark, folder)).select("artist")])
    return L.discovery(_ledger(spark, folder), known, _buckets(spark, folder)).drop("playlist")


@query("discovery_totals", E_SQL + f", {LEDGER_SQL}, kn AS (SELECT DISTINCT lower(trim(artist)) AS k FROM p) SELECT count(*) AS total, count(kn.k) AS stuck_count FROM er LEFT JOIN kn ON lower(er.artist) = kn.k")
def _(spark, folder):
    known = L.known_acts([H.plays(events(spark, folder)).select("artist")])
    none = table(spark, folder, "lastfm").select("artist", F.lit("other").alias("bucket")).limit(0)
    return L.ledger_totals(L.discovery(_ledger(spark, folder), known, none))


@query("recent_mentions", f"WITH {LEDGER_SQL} SELECT ord, artist, ts FROM lg ORDER BY ord DESC LIMIT 20")
def _(spark, folder):
    return L.recent(_ledger(spark, folder)).select("ord", "artist", "ts")


@query("surfaced_acts", "SELECT DISTINCT lower(trim(artist)) AS artist FROM documents WHERE artist IS NOT NULL")
def _(spark, folder):
    return L.surfaced(_ledger(spark, folder), "artist")


@query("ordered_acts", E_SQL + YTOP_SQL + """, ta AS (SELECT artist, row_number() OVER (ORDER BY n DESC, f, artist) AS pos FROM (SELECT artist, count(*) FILTER (WHERE is_play) AS n, min(us) AS f FROM e GROUP BY 1 ORDER BY n DESC, f, artist LIMIT 400)),
u AS (SELECT 0 AS part, pos, artist FROM ta UNION ALL SELECT 1, year * 100 + rank, artist FROM yt UNION ALL SELECT 2, list_rank, artist FROM paste300_albums)
SELECT artist, min(part) AS part, CAST(arg_min(pos, (part, pos)) AS BIGINT) AS pos FROM u GROUP BY 1""")
def _(spark, folder):
    e = events(spark, folder)
    top = H.top_artists(e).select("artist", F.row_number().over(Window.orderBy(F.desc("plays"), "first_us", "artist")).cast("bigint").alias("pos"))
    year = H.year_top_artists(e).select("artist", (F.col("year") * 100 + F.col("rank")).cast("bigint").alias("pos"))
    return L.ordered_distinct([top, year, table(spark, folder, "paste300_albums").select("artist", F.col("list_rank").alias("pos"))], "artist")


# Graph: acts next to each other under a tag are neighbours

FEED_SQL = """w AS (SELECT artist, lag(artist) OVER (PARTITION BY tag ORDER BY feed_no) AS nb, CASE WHEN tag_count IS NOT NULL THEN least(tag_count, 100) / 100.0::DOUBLE END AS m, feed_no AS pos FROM lastfm WHERE tag IS NOT NULL AND artist IS NOT NULL),
fd AS (SELECT artist, nb AS neighbor, m AS match, pos FROM w WHERE nb IS NOT NULL AND m IS NOT NULL),
nd AS (SELECT artist AS name, CAST(min(list_rank) AS BIGINT) AS i FROM paste300_albums GROUP BY 1) """


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "lastfm").where("tag is not null and artist is not null")
    before = F.lag("artist").over(Window.partitionBy("tag").orderBy("feed_no"))
    feed = rows.select("artist", before.alias("neighbor"), (F.least("tag_count", F.lit(100)) / 100.0).alias("match"), F.col("feed_no").alias("pos"), "tag_count")
    feed = feed.where("neighbor is not null and tag_count is not null").drop("tag_count").withColumn("neighbor_key", F.col("neighbor"))
    nodes = table(spark, folder, "paste300_albums").groupBy(F.col("artist").alias("name")).agg(F.min("list_rank").alias("i")).withColumn("key", F.col("name"))
    return nodes, feed


@query("edges_undirected", f"""WITH {FEED_SQL}, l AS (SELECT a.i AS x, b.i AS y, match FROM fd JOIN nd a ON fd.artist = a.name JOIN nd b ON fd.neighbor = b.name WHERE a.i <> b.i AND match >= 0.05)
SELECT least(x, y) AS a, greatest(x, y) AS b, round(max(match), 3) AS weight, count(*) >= 2 AS mutual FROM l GROUP BY 1, 2""")
def _(spark, folder):
    return L.graph_edges(*_graph(spark, folder))


@query("outside_topn", f"""WITH {FEED_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY pos) AS rank FROM fd WHERE match >= 0.3 AND neighbor NOT IN (SELECT name FROM nd) AND artist IN (SELECT name FROM nd))
SELECT artist, CAST(rank AS INT) AS rank, neighbor, round(match, 3) AS match FROM q WHERE rank <= 5""")
def _(spark, folder):
    return L.outside_neighbors(*_graph(spark, folder))


@query("graph_stats", f"WITH {FEED_SQL} SELECT count(*) AS fetched, count(*) FILTER (WHERE name NOT IN (SELECT artist FROM fd)) AS no_neighbors, 0 AS errors FROM nd")
def _(spark, folder):
    nodes, feed = _graph(spark, folder)
    return L.graph_stats(nodes, feed, feed.select("artist").limit(0))
