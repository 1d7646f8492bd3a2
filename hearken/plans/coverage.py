"""Queries of the remaining operators on the test tables: rankings, keys, readers and sinks, cleaning as a whole; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken import sinks
from hearken.functions.classify import NON_MUSIC, id_of_uri, is_non_music, joined_names, minutes_seconds, name_or_text, nearest_size, release_year
from hearken.functions.names import album_key, graph_key_udf, search_queries, unescape_udf
from hearken.operators import companion as P
from hearken.operators import history as H
from hearken.operators import timeline as L
from hearken.plans.catalog import AKEY_SQL, BUCKET_SQL, CORE_SQL, KEY_SQL, MARKS_SQL, PLAIN_SQL, TITLE_SQL, _TRACK, _ledger
from hearken.plans.history import ALBUMS_SQL, E_SQL, LAST_URI_SQL, STORIES_SQL, _episodes_sql, events
from hearken.session import fresh_path
from hearken.sources import exports as X
from hearken.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def keep(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLES[name] = build, sql
        return build

    return keep


# Rankings


@query("short_obsessions", (E_SQL + _episodes_sql("artist, title", "o", 30, 3)).replace("\nWITH raw AS", "\nWITH RECURSIVE raw AS", 1) + "SELECT artist, title, CAST(DATE '1970-01-01' + CAST(d AS INT) AS VARCHAR) AS window_start, n AS plays FROM g ORDER BY plays DESC, window_start, artist, title LIMIT 50")
def _(spark, folder):
    return H.obsessions(events(spark, folder), least=3).withColumn("window_start", F.col("window_start").cast("string"))


@query("single_track_albums", E_SQL + ALBUMS_SQL + "SELECT artist, album, title, plays, CAST(every - plays AS BIGINT) AS rest FROM bt WHERE k = 1 AND plays >= 2 AND every - plays <= 3")
def _(spark, folder):
    return H.one_track_wonders(events(spark, folder), hit=2, rest=3)


@query("most_played_acts", E_SQL + "SELECT artist, plays FROM (SELECT artist, count(*) FILTER (WHERE is_play) AS plays, min(us) AS f FROM e GROUP BY 1) WHERE plays >= 10 ORDER BY plays DESC, f, artist LIMIT 60")
def _(spark, folder):
    return H.most_played(H.artist_totals(events(spark, folder)), least=10, n=60).select("artist", "plays")


@query("non_music_tags", "SELECT DISTINCT tag FROM lastfm WHERE regexp_matches(concat_ws(' ', tag, artist), '(?i)" + "|".join(NON_MUSIC) + "')")
def _(spark, folder):
    return table(spark, folder, "lastfm").where(is_non_music(F.col("tag"), F.col("artist"))).where("tag is not null").select("tag").distinct()


@query("genre_search", "SELECT entry_no, entry FROM tag_buckets WHERE contains(lower(entry), 'rock')")
def _(spark, folder):
    nodes = table(spark, folder, "tag_buckets").select(F.col("entry_no").alias("ord"), F.col("entry").alias("name"))
    return X.find_genres(nodes, " Rock ").select(F.col("ord").alias("entry_no"), F.col("name").alias("entry"))


@query("snapshot_buckets", f"WITH {BUCKET_SQL.replace(' OR contains(key, t)', '')} SELECT * FROM tb")
def _(spark, folder):
    listed = table(spark, folder, "tag_buckets").select(F.col("entry_no").alias("ord"), F.col("entry").alias("key"), F.col("bucket_name").alias("bucket"))
    return L.tag_buckets(table(spark, folder, "lastfm").select("tag"), listed, both_ways=False)


@query("frequent_genres", """WITH g AS (SELECT artist, tag, row_number() OVER (PARTITION BY artist ORDER BY tag_rank, feed_no, tag) AS nth FROM lastfm WHERE artist IS NOT NULL AND tag IS NOT NULL),
a AS (SELECT artist, min(feed_no) AS pos FROM lastfm WHERE artist IS NOT NULL AND tag IS NOT NULL GROUP BY 1 ORDER BY pos LIMIT 30)
SELECT tag AS genre, count(*) AS n FROM a JOIN g USING (artist) GROUP BY 1 ORDER BY n DESC, min((pos, nth)) LIMIT 15""")
def _(spark, folder):
    feed = table(spark, folder, "lastfm").where("artist is not null and tag is not null")
    acts = feed.groupBy(F.col("artist").alias("name")).agg(F.min("feed_no").alias("pos"), F.transform(F.sort_array(F.collect_list(F.struct("tag_rank", "feed_no", "tag"))), lambda x: x["tag"]).alias("genres"))
    return L.top_genres(acts)


@query("ordered_uris", E_SQL + f""", t AS (SELECT artist, title, count(*) AS n, min(us) AS f, {LAST_URI_SQL} AS uri FROM p GROUP BY 1, 2 ORDER BY n DESC, f, artist, title LIMIT 150),
u AS (SELECT 0 AS part, row_number() OVER (ORDER BY n DESC, f, artist, title) AS pos, uri FROM t UNION ALL SELECT 1, min(ord), uri FROM o GROUP BY uri)
SELECT uri, min(part) AS part, CAST(arg_min(pos, (part, pos)) AS BIGINT) AS pos FROM u WHERE uri <> '' GROUP BY 1""")
def _(spark, folder):
    e = events(spark, folder)
    first = H.top_tracks(e).select("uri", F.row_number().over(Window.orderBy(F.desc("plays"), "first_us", "artist", "title")).cast("bigint").alias("pos"))
    return L.ordered_distinct([first, H.own_plays(e).groupBy("uri").agg(F.min("ord").alias("pos"))], "uri")


@query("known_snapshot", "SELECT DISTINCT lower(trim(artist)) AS artist FROM (SELECT artist FROM lastfm UNION ALL SELECT artist FROM paste300_albums) WHERE artist IS NOT NULL")
def _(spark, folder):
    return L.known_acts([table(spark, folder, t).select("artist") for t in ("lastfm", "paste300_albums")])


@query("seasons_by_concentration", E_SQL + STORIES_SQL + """, m AS (SELECT o.artist, o.title, any_value(t.plays) AS total, utc_month AS mo, count(*) AS n FROM o JOIN tt AS t USING (artist, title) WHERE t.plays >= 12 GROUP BY o.artist, o.title, utc_month),
b AS (SELECT artist, title, total, CASE WHEN mo IN (12, 1, 2) THEN 'winter' WHEN mo <= 5 THEN 'spring' WHEN mo <= 8 THEN 'summer' ELSE 'fall' END AS label, sum(n) AS n FROM m GROUP BY ALL),
q AS (SELECT artist, title, label, n / total::DOUBLE AS c FROM b WHERE n / total::DOUBLE >= 0.5)
SELECT label, count(*) AS tracks, round(max(c), 3) AS most FROM (SELECT *, row_number() OVER (PARTITION BY artist, title ORDER BY c DESC, label) AS k FROM q) WHERE k = 1 GROUP BY 1""")
def _(spark, folder):
    # the season part of the label alone, at half of the plays: months at that share are folded into their season
    from hearken.functions.classify import season

    e = events(spark, folder)
    ranked = H.most_played(H.track_totals(e).where("not household"), least=12, n=100).select("artist", "title", F.col("plays").alias("total"))
    by = H.own_plays(e).join(ranked, ["artist", "title"]).groupBy("artist", "title", "total", season(F.col("utc_month")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    share = by.withColumn("c", F.col("n") / F.col("total")).where("c >= 0.5")
    first = share.withColumn("k", F.row_number().over(Window.partitionBy("artist", "title").orderBy(F.desc("c"), "label"))).where("k = 1")
    return first.groupBy("label").agg(F.count(F.lit(1)).alias("tracks"), F.round(F.max("c"), 3).alias("most"))


# Keys and forms


@query("folded_writings", "SELECT artist, count(*) OVER (PARTITION BY replace(replace(lower(artist), 'ß', 'ss'), 'ς', 'σ')) AS writings FROM (SELECT DISTINCT artist FROM lastfm WHERE artist IS NOT NULL)")
def _(spark, folder):
    acts = table(spark, folder, "lastfm").where("artist is not null").select("artist").distinct()
    return acts.select("artist", F.count(F.lit(1)).over(Window.partitionBy(H.case_key(F.col("artist")))).alias("writings"))


@query("graph_keys", r"SELECT DISTINCT artist, trim(regexp_replace(lower(strip_accents(artist)), '\s+', ' ', 'g')) AS key FROM lastfm WHERE artist IS NOT NULL")
def _(spark, folder):
    return table(spark, folder, "lastfm").where("artist is not null").select("artist").distinct().select("artist", graph_key_udf("artist").alias("key"))


@query("album_keys", f"SELECT list_rank, {AKEY_SQL('artist')} || '||' || {PLAIN_SQL(MARKS_SQL('album'))} AS key FROM paste300_albums")
def _(spark, folder):
    return table(spark, folder, "paste300_albums").select("list_rank", album_key(F.col("artist"), F.col("album")).alias("key"))


@query("query_ladders", f"""WITH a AS (SELECT DISTINCT master_metadata_track_name AS t, master_metadata_album_album_name AS h FROM streaming_history WHERE master_metadata_track_name <> '' AND master_metadata_album_album_name <> ''),
k AS (SELECT t, h, {_TRACK('t')} AS tc, {CORE_SQL('h')} AS hc FROM a),
l AS (SELECT t, h, 'track:"' || t || '" album:"' || h || '"' AS q1, 'track:"' || tc || '" album:"' || hc || '"' AS q2, tc || ' ' || hc AS q3 FROM k)
SELECT t, h, q1 || CASE WHEN q2 <> q1 THEN chr(10) || q2 ELSE '' END || CASE WHEN q3 <> q1 AND q3 <> q2 THEN chr(10) || q3 ELSE '' END AS ladder FROM l""")
def _(spark, folder):
    pairs = table(spark, folder, "streaming_history").select(F.col("master_metadata_track_name").alias("t"), F.col("master_metadata_album_album_name").alias("h")).where("t <> '' and h <> ''").distinct()
    return pairs.select("t", "h", F.array_join(search_queries(F.col("t"), F.col("h")), "\n").alias("ladder"))


@query("unescaped", "SELECT entry_no, entry || ' & <b> \"q\" ''' AS text FROM tag_buckets")
def _(spark, folder):
    return table(spark, folder, "tag_buckets").select("entry_no", unescape_udf(F.concat("entry", F.lit(" &amp; &lt;b&gt; &quot;q&quot; &#39;"))).alias("text"))


@query("digest_lines", E_SQL + "SELECT printf('%s (%d plays, %.1f h)', artist, plays, ms / 3600000.0::DOUBLE) AS line FROM (SELECT artist, count(*) FILTER (WHERE is_play) AS plays, CAST(sum(ms) AS BIGINT) AS ms, min(us) AS f FROM e GROUP BY 1) ORDER BY plays DESC, f, artist LIMIT 30")
def _(spark, folder):
    return sinks.digest(H.top_artists(events(spark, folder)))


@query("track_minutes", E_SQL + "SELECT artist, title, printf('%d:%02d', sum(ms) // 60000, sum(ms) // 1000 % 60) AS heard FROM p GROUP BY 1, 2")
def _(spark, folder):
    return H.track_totals(events(spark, folder)).select("artist", "title", minutes_seconds(F.col("ms")).alias("heard"))


@query("uri_ids", "SELECT DISTINCT spotify_track_uri AS uri, split_part(spotify_track_uri, ':', -1) AS id FROM streaming_history WHERE spotify_track_uri <> ''")
def _(spark, folder):
    return table(spark, folder, "streaming_history").where("spotify_track_uri <> ''").select(F.col("spotify_track_uri").alias("uri")).distinct().select("uri", id_of_uri(F.col("uri")).alias("id"))


@query("release_years", "SELECT list_rank, release_year AS year, CASE WHEN list_rank % 3 = 0 THEN NULL ELSE release_year END AS short FROM paste300_albums")
def _(spark, folder):
    date = F.concat(F.col("release_year").cast("string"), F.lit("-05-01"))
    return table(spark, folder, "paste300_albums").select("list_rank", release_year(date).alias("year"), release_year(F.when(F.col("list_rank") % 3 == 0, F.lit("199")).otherwise(date)).alias("short"))


@query("nearest_images", "SELECT p_partkey, CASE WHEN abs(p_size * 10 - 300) <= abs(640 - 300) THEN p_size * 10 ELSE 640 END AS width FROM part")
def _(spark, folder):
    images = F.array(F.struct((F.col("p_size") * 10).alias("width")), F.struct(F.lit(640).cast("bigint").alias("width")))
    return table(spark, folder, "part").select("p_partkey", nearest_size(images, 300)["width"].alias("width"))


@query("one_or_many_neighbors", "SELECT r_name AS artist, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INT) AS pos, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 END AS match FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 0, n_name, NULL FROM nation")
def _(spark, folder):
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    item = F.to_json(F.struct(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "0.5").otherwise("x").alias("match")))
    many = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("artist")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_name", item.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("json"))
    one = n.select(F.col("n_name").alias("artist"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("json"))
    return X.neighbor_feed(many.unionByName(one))


@query("joined_credits", "SELECT n_nationkey, n_name || ', ' || r_name AS names, n_name AS first FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, folder):
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    credit = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.col("n_name").alias("name")))).otherwise(F.col("n_name"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", joined_names(F.array("n_name", F.lit(" "), "r_name", F.lit(""))).alias("names"), name_or_text(credit).alias("first"))


@query("first_hits", E_SQL + f""", h AS (SELECT artist, title, {KEY_SQL('title')} AS key, min(ord) AS pos FROM o GROUP BY ALL), w AS (SELECT DISTINCT {KEY_SQL('title')} AS key FROM e WHERE service <> 'spotify'),
b AS (SELECT key, artist, title, pos, CASE WHEN starts_with(artist, 'The ') THEN 0 ELSE 1 END AS p FROM h JOIN w USING (key))
SELECT key, artist, title FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, pos) AS n FROM b) WHERE n = 1""")
def _(spark, folder):
    from hearken.functions.classify import title_key
    from hearken.operators.catalog import first_found

    e = events(spark, folder)
    heard = H.own_plays(e).groupBy("artist", "title").agg(F.min("ord").alias("pos")).withColumn("key", title_key(F.col("title")))
    wanted = e.where("service <> 'spotify'").select(title_key(F.col("title")).alias("key")).distinct()
    hits = heard.join(wanted, "key")
    strict = F.col("artist").startswith("The ")
    return first_found(hits.where(strict), hits.where(~strict), key="key").select("key", "artist", "title")


# Cleaning of the companion export as a whole; its columns are made of the packed lines

ACTIVITY_SQL = f"""act AS (SELECT record_id AS ord, CASE WHEN record_id % 50 = 0 THEN 'LYRIC_DISPLAY' ELSE 'PLAY_END' END AS event, trim(coalesce({TITLE_SQL('track_name')}, track_description, '')) AS song,
  CASE WHEN record_id % 40 = 1 THEN 'VIDEO' ELSE 'AUDIO' END AS media, CASE WHEN record_id % 30 = 2 THEN 'STREAM' ELSE 'ITUNES' END AS item,
  CASE WHEN regexp_full_match(date_played, '\\d{{8}}') THEN epoch_us(strptime(date_played, '%Y%m%d')) END AS us, TRY_CAST(trunc(TRY_CAST(trim(play_duration_milliseconds) AS DOUBLE)) AS BIGINT) AS raw_ms, 200000 AS media_ms,
  CASE WHEN record_id % 3 = 0 THEN NULL ELSE 'Album ' || record_id % 3 END AS album FROM apple_history),
bb AS (SELECT record_id AS o, track_description AS t, 1 AS f FROM apple_history),
tm AS (SELECT key, arg_max(artist, (f, o, artist)) AS artist FROM (SELECT {KEY_SQL(TITLE_SQL('t'))} AS key, trim(t[:strpos(t, ' - ') - 1]) AS artist, o, f FROM bb WHERE {TITLE_SQL('t')} IS NOT NULL) GROUP BY 1),
kn AS (SELECT act.*, {KEY_SQL('song')} AS key, CASE WHEN raw_ms > 400000 THEN 200000 ELSE greatest(coalesce(raw_ms, 0), 0) END AS ms FROM act),
jd AS (SELECT kn.*, tm.artist, CASE WHEN event = 'LYRIC_DISPLAY' THEN 'event_type' WHEN song = '' THEN 'no_song_name' WHEN media = 'VIDEO' THEN 'non_music_media_type' WHEN item = 'STREAM' THEN 'non_music_item_type'
  WHEN us IS NULL THEN 'no_timestamp' WHEN tm.artist IS NULL THEN 'artist_unresolved' END AS r0 FROM kn LEFT JOIN tm USING (key)),
ju AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY r0 IS NULL, us, key, ms ORDER BY ord) > 1 THEN 'duplicate' ELSE r0 END AS reason FROM jd)
"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    from hearken.functions.classify import split_pair

    rows = table(spark, folder, "apple_history")
    title = F.coalesce(split_pair(F.col("track_name"))["title"], "track_description", F.lit(""))
    n = F.col("record_id")
    day = F.when(F.col("date_played").rlike(r"^\d{8}$"), F.concat(F.substring("date_played", 1, 4), F.lit("-"), F.substring("date_played", 5, 2), F.lit("-"), F.substring("date_played", 7, 2), F.lit("T00:00:00Z")))
    activity = rows.select(
        n.alias("ord"),
        F.when(n % 50 == 0, "LYRIC_DISPLAY").otherwise("PLAY_END").alias("Event Type"),
        title.alias("Song Name"),
        F.when(n % 40 == 1, "video").otherwise("audio").alias("Media Type"),
        F.when(n % 30 == 2, "STREAM").otherwise("ITUNES").alias("Item Type"),
        F.when(n % 2 == 0, day).alias("Event Start Timestamp"),
        day.alias("Event End Timestamp"),
        F.col("play_duration_milliseconds").alias("Play Duration Milliseconds"),
        F.lit("200000").alias("Media Duration In Milliseconds"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("Album "), (n % 3).cast("string"))).alias("Album Name"),
        F.lit("").alias("End Reason Type"),
        F.lit("").alias("Feature Name"),
        F.lit("iPhone").alias("Client Device Name"),
    )
    # titles known from the descriptions only, so that some songs stay without act
    nothing = X.empty(spark, X.schema("t string, record_id bigint"))
    titles = P.title_map(rows.select(F.col("track_description").alias("t"), "record_id"), nothing, text="t", order="record_id")
    return P.clean(activity, titles, X.empty(spark, X.schema("key string, artist string")))


@query("companion_stats", f"""WITH {ACTIVITY_SQL}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE reason IS NULL) AS events_emitted, count(DISTINCT artist) FILTER (WHERE reason IS NULL) AS unique_artists, count(DISTINCT (artist, song)) FILTER (WHERE reason IS NULL) AS unique_tracks,
  count(DISTINCT key) FILTER (WHERE reason IS NULL OR reason IN ('artist_unresolved', 'duplicate')) AS unique_songs_seen, count(DISTINCT key) FILTER (WHERE reason IS NULL OR reason = 'duplicate') AS unique_songs_resolved,
  count(*) FILTER (WHERE (reason IS NULL OR reason = 'duplicate') AND raw_ms < 0) AS ms_clamped_negative, count(*) FILTER (WHERE (reason IS NULL OR reason = 'duplicate') AND raw_ms > 400000) AS ms_clamped_runaway, 0 AS artist_resolved_via_override,
  round(count(DISTINCT key) FILTER (WHERE reason IS NULL OR reason = 'duplicate') / count(DISTINCT key) FILTER (WHERE reason IS NULL OR reason IN ('artist_unresolved', 'duplicate'))::DOUBLE, 4) AS artist_resolution_rate FROM ju""")
def _(spark, folder):
    return P.stats(_judged(spark, folder))


@query("companion_unresolved", f"""WITH {ACTIVITY_SQL}, lo AS (SELECT *, CAST(year(make_timestamp(us)) AS INT) AS y FROM ju WHERE reason = 'artist_unresolved'),
al AS (SELECT key, arg_max(album, (n, -o)) AS album FROM (SELECT key, album, count(*) AS n, min(ord) AS o FROM lo WHERE album IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT key, arg_min(song, ord) AS title, count(*) AS plays, round(sum(greatest(coalesce(raw_ms, 0), 0)) / 60000.0::DOUBLE, 1) AS minutes, any_value(al.album) AS album, min(y) AS year_min, max(y) AS year_max FROM lo LEFT JOIN al USING (key) GROUP BY key""")
def _(spark, folder):
    return P.unresolved(_judged(spark, folder))


@query("companion_drops", f"WITH {ACTIVITY_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ju GROUP BY 1")
def _(spark, folder):
    return P.drop_counts(_judged(spark, folder))


# Readers and sinks: written to the shared folder and read again


@query("ledger_round_trip", "SELECT strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp, artist, source AS recipe, count(*) AS n FROM documents WHERE artist IS NOT NULL AND trim(artist) <> '' GROUP BY ALL")
def _(spark, folder):
    path = fresh_path(spark, "ledger")
    rows = _ledger(spark, folder).select("artist", F.col("ts").alias("title"), "recipe")
    sinks.append_ledger(sinks.ledger_rows(rows, now="2026-01-01T00:00:00Z", recipe="none"), path)
    return X.ledger(spark, path).groupBy(F.col("title").alias("stamp"), "artist", "recipe").agg(F.count(F.lit(1)).alias("n"))


@query("table_round_trip", "SELECT CAST(list_rank AS VARCHAR) AS list_rank, artist || chr(10) || '\"' || album || '\"' AS both, CAST(row_number() OVER (ORDER BY list_rank) - 1 AS BIGINT) AS ord FROM paste300_albums")
def _(spark, folder):
    path = fresh_path(spark, "table")
    rows = table(spark, folder, "paste300_albums").orderBy("list_rank").select("list_rank", F.concat("artist", F.lit('\n"'), "album", F.lit('"')).alias("both"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return X.table_file(spark, path).select("list_rank", "both", "ord")


@query("picks_round_trip", "SELECT artist, CASE WHEN list_rank % 2 = 0 THEN album END AS title, CAST(NULL AS VARCHAR) AS uri FROM paste300_albums")
def _(spark, folder):
    path = fresh_path(spark, "picks")
    table(spark, folder, "paste300_albums").select(F.concat_ws("\t", "artist", F.when(F.col("list_rank") % 2 == 0, F.col("album")).otherwise(" "))).write.text(path)
    return X.picks(spark, path)


@query("list_round_trip", "SELECT entry AS value FROM tag_buckets")
def _(spark, folder):
    path = fresh_path(spark, "list")
    entries = table(spark, folder, "tag_buckets").select(F.explode(F.array(F.concat(F.lit("  "), "entry"), F.concat(F.lit("# "), "entry"), F.lit(" "))).alias("value"))
    entries.write.text(path)
    return X.lines(spark, path)


@query("overrides_upsert", f"""WITH o AS (SELECT artist AS title, album AS artist FROM paste300_albums), pr AS (SELECT DISTINCT artist AS title, tag AS artist, CASE WHEN tag_rank < 3 THEN 'high' ELSE 'review' END AS tier FROM lastfm WHERE artist IS NOT NULL AND tag IS NOT NULL),
n AS (SELECT title, artist, {KEY_SQL('title')} AS k FROM pr WHERE tier = 'high'), f AS (SELECT title, artist, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY title, artist) AS i FROM n) WHERE i = 1)
SELECT title, artist FROM o UNION ALL SELECT title, artist FROM f WHERE k NOT IN (SELECT {KEY_SQL('title')} FROM o)""")
def _(spark, folder):
    own = table(spark, folder, "paste300_albums").select(F.col("artist").alias("title"), F.col("album").alias("artist"))
    feed = table(spark, folder, "lastfm").where("artist is not null and tag is not null")
    offered = feed.select(F.col("artist").alias("title"), F.col("tag").alias("artist"), F.when(F.col("tag_rank") < 3, "high").otherwise("review").alias("tier")).distinct()
    return sinks.accepted(own, offered)


@query("unresolved_lines", f"WITH {ACTIVITY_SQL}" + r""", lo AS (SELECT *, CAST(year(make_timestamp(us)) AS INT) AS y FROM ju WHERE reason = 'artist_unresolved'),
al AS (SELECT key, arg_max(album, (n, -o)) AS album FROM (SELECT key, album, count(*) AS n, min(ord) AS o FROM lo WHERE album IS NOT NULL GROUP BY ALL) GROUP BY 1),
un AS (SELECT arg_min(song, ord) AS title, count(*) AS plays, round(sum(greatest(coalesce(raw_ms, 0), 0)) / 60000.0::DOUBLE, 1) AS minutes, any_value(al.album) AS album, min(y) AS a, max(y) AS b FROM lo LEFT JOIN al USING (key) GROUP BY key)
SELECT '| ' || replace(title, '|', '\|') || ' | ' || coalesce(album, '') || ' | ' || plays || ' | ' || minutes || ' | ' || CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END || ' |' AS line FROM un
UNION ALL SELECT count(*) || ' songs, ' || coalesce(sum(plays), 0)::BIGINT || ' plays without act' FROM un
UNION ALL SELECT '| title | album | plays | minutes | years |' || chr(10) || '|---|---|---|---|---|'""")
def _(spark, folder):
    return sinks.unresolved_report(P.unresolved(_judged(spark, folder)))
