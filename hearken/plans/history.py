"""Queries over the listening history, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions.classify import platform_bucket
from hearken.functions.instants import instant_us, utc_iso
from hearken.operators import history as H
from hearken.operators.features import label, wide_features
from hearken.sources.tables import table

#: Household acts of the test tables.
HOUSEHOLD = ("Kobosk Jogion", "Lady Pudu")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

E_SQL = """
WITH raw AS (
  SELECT row_no AS ord, epoch_us(TRY_CAST(ts AS TIMESTAMPTZ)) AS us, master_metadata_album_artist_name AS artist,
    coalesce(nullif(master_metadata_track_name, ''), '?') AS title, coalesce(master_metadata_album_album_name, '') AS album,
    coalesce(spotify_track_uri, '') AS uri, platform, reason_start, shuffle, service, coalesce(ms_played, 0) AS ms, username AS account
  FROM streaming_history
  WHERE TRY_CAST(ts AS TIMESTAMPTZ) IS NOT NULL AND master_metadata_album_artist_name <> '' AND (service <> 'spotify' OR coalesce(spotify_track_uri, '') <> '')),
names AS (
  SELECT artist, count(*) FILTER (WHERE ms >= 30000) AS plays, max(CASE WHEN service = 'spotify' THEN 1 ELSE 0 END) AS fs FROM raw GROUP BY 1),
elected AS (
  SELECT artist, plays, first_value(artist) OVER (PARTITION BY replace(replace(lower(artist), 'ß', 'ss'), 'ς', 'σ') ORDER BY plays DESC, fs DESC, artist) AS canonical,
    count(*) OVER (PARTITION BY replace(replace(lower(artist), 'ß', 'ss'), 'ς', 'σ')) AS writings FROM names),
e0 AS (
  SELECT r.* EXCLUDE (artist), coalesce(c.canonical, r.artist) AS artist, make_timestamp(us) AS utc,
    (make_timestamp(us) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local
  FROM raw r LEFT JOIN elected c ON r.artist = c.artist),
e AS (
  SELECT *, ms >= 30000 AS is_play, artist IN ('Kobosk Jogion', 'Lady Pudu') OR regexp_matches(artist, '(?i)white\\s+noise') AS household,
    CAST(year(utc) AS INT) AS year, CAST(month(utc) AS INT) AS utc_month, CAST(year(local) AS INT) AS local_year, CAST(month(local) AS INT) AS month,
    CAST(isodow(local) - 1 AS INT) AS weekday, CAST(hour(local) AS INT) AS hour, CAST(local AS DATE) AS local_date FROM e0),
p AS (SELECT * FROM e WHERE is_play),
o AS (SELECT * FROM e WHERE is_play AND NOT household)
"""
PLATFORM_SQL = """CASE WHEN lower(pf) LIKE '%amazon%' OR lower(pf) LIKE '%echo%' OR lower(pf) LIKE '%cast%' OR lower(pf) LIKE '%tizen%' OR contains(lower(pf), 'android_tv') OR lower(pf) LIKE '%fire%' THEN 'speaker_tv'
  WHEN contains(lower(pf), 'web_player') THEN 'web'
  WHEN lower(pf) LIKE '%osx%' OR lower(pf) LIKE '%os x%' OR lower(pf) LIKE '%windows%' OR lower(pf) LIKE '%linux%' OR lower(pf) LIKE '%mac%' THEN 'desktop'
  WHEN lower(pf) LIKE '%android%' OR lower(pf) LIKE '%ios%' OR lower(pf) LIKE '%iphone%' OR lower(pf) LIKE '%ipad%' THEN 'mobile' ELSE 'other' END"""
INTENT_SQL = """CASE WHEN coalesce(shuffle, false) THEN 'shuffle' WHEN reason_start IN ('clickrow', 'playbtn', 'backbtn', 'remote') THEN 'deliberate'
  WHEN reason_start IN ('trackdone', 'appload', 'fwdbtn') THEN 'passive' ELSE 'other' END"""
ERA_SQL = """CASE WHEN local_year BETWEEN 2015 AND 2017 THEN '2015-2017' WHEN local_year = 2018 THEN '2018' WHEN local_year BETWEEN 2019 AND 2020 THEN '2019-2020'
  WHEN local_year BETWEEN 2021 AND 2022 THEN '2021-2022' WHEN local_year BETWEEN 2023 AND 2024 THEN '2023-2024' WHEN local_year BETWEEN 2025 AND 2026 THEN '2025-2026' END"""
LAST_URI_SQL = "coalesce(arg_max(uri, (us, ord)) FILTER (WHERE uri <> ''), '')"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return H.events(table(spark, folder, "streaming_history"), household=HOUSEHOLD)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query of the canonical events under a name, with the SQL that follows the shared part."""

    def keep(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(events(spark, folder))
        if sql is not None:
            ORACLES[name] = E_SQL + sql
        return build

    return keep


@query("play_totals", """SELECT count(*) AS events, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (WHERE is_play) AS total_plays, round(sum(ms) / 3600000.0::DOUBLE, 1) AS total_hours,
  count(DISTINCT artist) AS unique_artists, count(DISTINCT (artist, title)) FILTER (WHERE is_play) AS unique_tracks, count(*) FILTER (WHERE household AND is_play) AS household_plays FROM e""")
def _(e):
    return H.totals(e)


@query("service_totals", "SELECT service, count(*) AS events, count(*) FILTER (WHERE is_play) AS plays, count(*) FILTER (WHERE NOT is_play) AS skips, CAST(sum(ms) AS BIGINT) AS ms, min(us) AS first_us, max(us) AS last_us FROM e GROUP BY 1")
def _(e):
    return H.service_totals(e)


@query("service_by_year", "SELECT year, service, count(*) AS events, count(*) FILTER (WHERE is_play) AS plays FROM e GROUP BY 1, 2")
def _(e):
    return H.service_years(e)


@query("year_totals", "SELECT year, count(*) FILTER (WHERE is_play) AS plays, CAST(sum(ms) AS BIGINT) AS ms, count(*) FILTER (WHERE NOT is_play) AS skips FROM e GROUP BY 1")
def _(e):
    return H.year_totals(e)


ARTISTS_SQL = """, a AS (SELECT artist, count(*) FILTER (WHERE is_play) AS plays, CAST(sum(ms) AS BIGINT) AS ms, count(*) FILTER (WHERE NOT is_play) AS skips, min(us) AS first_us, bool_or(household) AS household FROM e GROUP BY 1) """


@query("artist_totals", ARTISTS_SQL + "SELECT artist, plays, ms, skips, round(skips / (plays + skips)::DOUBLE, 2) AS skip_rate FROM a")
def _(e):
    return H.artist_totals(e).select("artist", "plays", "ms", "skips", "skip_rate")


@query("artist_by_year", "SELECT artist, string_agg(year || ':' || n, ',' ORDER BY year) AS by_year FROM (SELECT artist, year, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1")
def _(e):
    return H.artist_year_maps(e).select("artist", F.array_join(F.transform(F.map_entries("by_year"), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("by_year"))


@query("track_totals", f"SELECT artist, title, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms, {LAST_URI_SQL} AS uri, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM p GROUP BY 1, 2")
def _(e):
    return H.track_totals(e).select("artist", "title", "plays", "ms", "uri", F.array_join("years", ",").alias("years"))


@query("top_artists", ARTISTS_SQL + "SELECT artist, plays, round(ms / 3600000.0::DOUBLE, 1) AS hours, round(skips / (plays + skips)::DOUBLE, 2) AS skip_rate FROM a ORDER BY plays DESC, first_us, artist LIMIT 400")
def _(e):
    return H.top_artists(e).select("artist", "plays", H.hours(F.col("ms")).alias("hours"), "skip_rate")


@query("top_tracks", f"SELECT artist, title, plays, uri FROM (SELECT artist, title, count(*) AS plays, {LAST_URI_SQL} AS uri, min(us) AS f FROM p GROUP BY 1, 2) ORDER BY plays DESC, f, artist, title LIMIT 150")
def _(e):
    return H.top_tracks(e).select("artist", "title", "plays", "uri")


@query("year_top_artists", """, y AS (SELECT artist, year, count(*) AS plays FROM p GROUP BY 1, 2), f AS (SELECT artist, min(us) AS f FROM e GROUP BY 1)
SELECT year, CAST(rank AS INT) AS rank, artist, plays FROM (SELECT y.*, row_number() OVER (PARTITION BY year ORDER BY plays DESC, f, y.artist) AS rank FROM y JOIN f ON y.artist = f.artist) WHERE rank <= 25""")
def _(e):
    return H.year_top_artists(e)


YEAR_TRACKS_SQL = ", y AS (SELECT artist, title, year, count(*) AS plays, min(us) AS f FROM o GROUP BY 1, 2, 3) "


@query("year_top_tracks", YEAR_TRACKS_SQL + "SELECT year, CAST(rank AS INT) AS rank, artist, title, plays FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY plays DESC, f, artist, title) AS rank FROM y) WHERE rank <= 15")
def _(e):
    return H.year_top_tracks(e)


@query("anthems", YEAR_TRACKS_SQL + f""", t AS (SELECT artist, title, count(*) AS total, {LAST_URI_SQL} AS uri FROM o GROUP BY 1, 2)
SELECT year, artist, title, uri, plays, round(plays / total::DOUBLE, 3) AS concentration FROM (SELECT y.*, t.total, t.uri,
  row_number() OVER (PARTITION BY year ORDER BY plays DESC, plays / total::DOUBLE DESC, f, y.artist, y.title) AS rank FROM y JOIN t ON y.artist = t.artist AND y.title = t.title) WHERE rank = 1""")
def _(e):
    return H.anthems(e)


CLOCK_SQL = f"""SELECT 'overall' AS era, weekday, hour, count(*) AS n FROM o GROUP BY 2, 3
UNION ALL SELECT era, weekday, hour, count(*) AS n FROM (SELECT {ERA_SQL} AS era, weekday, hour FROM o) WHERE era IS NOT NULL GROUP BY 1, 2, 3"""


@query("clock", CLOCK_SQL)
def _(e):
    return H.clock(e)


@query("clock_grid", f""", c AS ({CLOCK_SQL}), s AS (SELECT era, CAST(w AS INT) AS weekday, CAST(h AS INT) AS hour FROM (SELECT DISTINCT era FROM c), range(7) t(w), range(24) u(h))
SELECT era, string_agg(r, ';' ORDER BY weekday) AS grid FROM (SELECT s.era, s.weekday, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY s.hour) AS r
  FROM s LEFT JOIN c ON s.era = c.era AND s.weekday = c.weekday AND s.hour = c.hour GROUP BY 1, 2) GROUP BY 1""")
def _(e):
    return H.clock_grid(H.clock(e)).select("era", F.array_join(F.transform("grid", lambda r: F.array_join(r.cast("array<string>"), ",")), ";").alias("grid"))


@query("intent_by_year", f"""SELECT year, count(*) FILTER (WHERE i = 'deliberate') AS deliberate, count(*) FILTER (WHERE i = 'other') AS other, count(*) FILTER (WHERE i = 'passive') AS passive,
  count(*) FILTER (WHERE i = 'shuffle') AS shuffle, count(*) AS total FROM (SELECT year, {INTENT_SQL} AS i FROM o WHERE service = 'spotify') GROUP BY 1""")
def _(e):
    return H.intent_years(e)


@query("reasons_by_year", "SELECT year, coalesce(reason_start, 'unknown') AS reason, count(*) AS n FROM o WHERE service = 'spotify' GROUP BY 1, 2")
def _(e):
    return H.reason_years(e)


@query("seasonality", "SELECT year, month, count(*) AS n FROM o GROUP BY 1, 2")
def _(e):
    return H.months(e)


@query("artist_months", ARTISTS_SQL + """, t AS (SELECT artist FROM a WHERE NOT household ORDER BY plays DESC, first_us, artist LIMIT 200)
SELECT year, month, artist, count(*) AS n FROM o WHERE artist IN (SELECT artist FROM t) GROUP BY 1, 2, 3""")
def _(e):
    return H.artist_months(e)


@query("month_totals", """SELECT CAST(m AS INT) AS month, count(o.ord) AS n FROM range(1, 13) t(m) LEFT JOIN o ON o.month = t.m GROUP BY 1""")
def _(e):
    all_months = e.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return all_months.join(H.months(e).groupBy("month").agg(F.sum("n").alias("n")), "month", "left").na.fill(0, ["n"])


@query("platforms_by_year", f"SELECT year, {PLATFORM_SQL} AS bucket, count(*) AS n FROM (SELECT year, coalesce(platform, 'not_applicable') AS pf FROM o) GROUP BY 1, 2")
def _(e):
    return H.platform_years(e)


@query("platform_map", f"SELECT DISTINCT pf AS platform, {PLATFORM_SQL} AS bucket FROM (SELECT coalesce(platform, 'not_applicable') AS pf FROM o)")
def _(e):
    return H.platform_map(e)


SKIP_SQL = """, a AS (SELECT artist, count(*) FILTER (WHERE is_play) AS plays, count(*) FILTER (WHERE NOT is_play) AS skips, min(us) AS f FROM e WHERE NOT household GROUP BY 1),
l AS (SELECT artist, plays, skips, plays + skips AS exposure, round(skips / (plays + skips)::DOUBLE, 3) AS skip_rate FROM a ORDER BY plays + skips DESC, f, artist LIMIT 200) """


@query("skip_leaders", SKIP_SQL + "SELECT artist, plays, skips, exposure, skip_rate FROM l")
def _(e):
    return H.skip_leaders(e).drop("first_us")


@query("never_skip", SKIP_SQL + "SELECT artist, plays, skips, exposure, skip_rate FROM l WHERE exposure >= 20 ORDER BY skip_rate, exposure DESC, artist LIMIT 15")
def _(e):
    return H.skip_extremes(H.skip_leaders(e))


@query("most_skipped", SKIP_SQL + "SELECT artist, plays, skips, exposure, skip_rate FROM l WHERE exposure >= 20 ORDER BY skip_rate DESC, exposure DESC, artist LIMIT 15")
def _(e):
    return H.skip_extremes(H.skip_leaders(e), most=True)


SESSIONS_SQL = """, sp AS (SELECT DISTINCT account, us, nullif(album, '') AS album, reason_start FROM o WHERE service = 'spotify'),
sm AS (SELECT *, CASE WHEN album = lag(album) OVER w AND reason_start = 'trackdone' AND us - lag(us) OVER w < 600000000 THEN 0 ELSE 1 END AS b FROM sp
  WINDOW w AS (PARTITION BY account ORDER BY us, album NULLS FIRST, reason_start NULLS FIRST)),
sr AS (SELECT *, sum(b) OVER (PARTITION BY account ORDER BY us, album NULLS FIRST, reason_start NULLS FIRST) AS k FROM sm),
s AS (SELECT account, max(album) AS album, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n_events FROM sr GROUP BY account, k HAVING count(*) >= 4) """


@query("album_sessions", SESSIONS_SQL + "SELECT * FROM s")
def _(e):
    return H.album_sessions(e)


@query("sessions_by_year", SESSIONS_SQL + "SELECT CAST(year(make_timestamp(start_us)) AS INT) AS year, count(*) AS sessions FROM s GROUP BY 1")
def _(e):
    return H.session_years(H.album_sessions(e))


@query("sessions_by_album", SESSIONS_SQL + "SELECT album, count(*) AS sessions, max(n_events) AS longest FROM s GROUP BY 1")
def _(e):
    return H.session_albums(H.album_sessions(e))


def _episodes_sql(keys: str, source: str, window: int, least: int) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    pick = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    return f""", d AS (SELECT {keys}, local_date - DATE '1970-01-01' AS d, count(*) AS n FROM {source} GROUP BY ALL),
r AS (SELECT {keys}, d, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY d RANGE BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS BIGINT) AS n FROM d),
c AS MATERIALIZED (SELECT * FROM r WHERE n >= {least}),
g AS (SELECT {keys}, d, n FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY d) AS k FROM c) WHERE k = 1
  UNION ALL SELECT {pick('x')}, x.d, x.n FROM g, LATERAL (SELECT {pick('c')}, c.d, c.n FROM c WHERE {on('c', 'g')} AND c.d >= g.d + {window} ORDER BY c.d LIMIT 1) x)
"""


@query("obsessions", _episodes_sql("artist, title", "o", 30, 15).replace(", d AS", ", d AS", 1) + "SELECT artist, title, CAST(DATE '1970-01-01' + CAST(d AS INT) AS VARCHAR) AS window_start, n AS plays FROM g ORDER BY plays DESC, window_start, artist, title LIMIT 50")
def _(e):
    return H.obsessions(e).withColumn("window_start", F.col("window_start").cast("string"))


@query("act_episodes", _episodes_sql("artist", "o", 7, 12) + "SELECT artist, CAST(DATE '1970-01-01' + CAST(d AS INT) AS VARCHAR) AS window_start, n AS plays FROM g")
def _(e):
    return H.episodes(H.own_plays(e), ["artist"], "local_date", window=7, least=12).withColumn("window_start", F.col("window_start").cast("string"))


for _name in ("obsessions", "act_episodes"):
    ORACLES[_name] = ORACLES[_name].replace("\nWITH raw AS", "\nWITH RECURSIVE raw AS", 1)


@query("rediscoveries", """, y AS (SELECT DISTINCT artist, year FROM o), g AS (SELECT artist, lag(year) OVER (PARTITION BY artist ORDER BY year) AS a, year AS b FROM y),
l AS (SELECT artist, a, b, b - a - 1 AS gap, row_number() OVER (PARTITION BY artist ORDER BY b - a DESC, a) AS k FROM g WHERE b - a - 1 >= 2),
t AS (SELECT artist, count(*) AS total_plays, min(us) AS f FROM p GROUP BY 1)
SELECT l.artist, a AS gap_last_before, b AS gap_first_after, gap AS gap_years, total_plays FROM l JOIN t ON l.artist = t.artist WHERE k = 1 ORDER BY total_plays DESC, f, l.artist LIMIT 40""")
def _(e):
    return H.rediscoveries(e)


@query("forgotten_favorites", """, y AS (SELECT artist, year, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT DISTINCT year FROM e ORDER BY year DESC LIMIT 2)
SELECT artist, CAST(sum(n) AS BIGINT) AS plays, arg_max(year, (n, -year)) AS peak_year, max(year) AS last_year FROM y
WHERE artist NOT IN (SELECT artist FROM y WHERE year IN (SELECT year FROM q)) GROUP BY 1 HAVING sum(n) >= 5""")
def _(e):
    return H.forgotten(e, least=5)


ALBUMS_SQL = f""", al AS (SELECT artist, album, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms, min(us) AS f FROM o WHERE album <> '' GROUP BY 1, 2),
atr AS (SELECT artist, album, title, count(*) AS plays, arg_max(uri, (us, ord)) FILTER (WHERE uri <> '') AS uri, min(us) AS f FROM o WHERE album <> '' GROUP BY 1, 2, 3),
bt AS (SELECT *, row_number() OVER (PARTITION BY artist, album ORDER BY plays DESC, f, title) AS k, sum(plays) OVER (PARTITION BY artist, album) AS every,
  arg_min(uri, (f, title)) FILTER (WHERE uri IS NOT NULL) OVER (PARTITION BY artist, album) AS sample FROM atr) """


@query("album_totals", ALBUMS_SQL + "SELECT artist, album, plays, ms FROM al")
def _(e):
    return H.album_totals(e).drop("first_us")


@query("album_top_track", ALBUMS_SQL + "SELECT artist, album, title, plays, coalesce(uri, sample, '') AS uri FROM bt WHERE k = 1")
def _(e):
    return H.album_top_track(e)


@query("top_albums", SESSIONS_SQL + ALBUMS_SQL + """, sa AS (SELECT album, count(*) AS sessions FROM s GROUP BY 1), ta AS (SELECT * FROM al ORDER BY plays DESC, f, artist, album LIMIT 80)
SELECT ta.artist, ta.album, ta.plays, ta.ms, bt.title AS top_track, bt.plays AS top_plays, coalesce(bt.uri, bt.sample, '') AS uri, coalesce(sa.sessions, 0) AS sessions
FROM ta JOIN bt ON ta.artist = bt.artist AND ta.album = bt.album AND bt.k = 1 LEFT JOIN sa ON ta.album = sa.album""")
def _(e):
    return H.top_albums(e, H.album_sessions(e))


@query("one_track_wonders", ALBUMS_SQL + "SELECT artist, album, title, plays, CAST(every - plays AS BIGINT) AS rest FROM bt WHERE k = 1 AND plays >= 5 AND every - plays <= 1")
def _(e):
    return H.one_track_wonders(e, hit=5, rest=1)


STORIES_SQL = f""", tt AS (SELECT artist, title, count(*) AS plays, {LAST_URI_SQL} AS uri, min(us) AS f FROM o GROUP BY 1, 2 ORDER BY plays DESC, f, artist, title LIMIT 100) """


@query("track_lifelines", STORIES_SQL + """, m AS (SELECT artist, title, printf('%04d-%02d', year, utc_month) AS ym, count(*) AS n FROM o GROUP BY ALL)
SELECT tt.artist, tt.title, any_value(tt.plays) AS plays, any_value(tt.uri) AS uri, string_agg(ym || ':' || n, ',' ORDER BY ym) AS lifeline, min(ym) AS first_month, max(ym) AS last_month, count(DISTINCT substr(ym, 1, 4)) AS years
FROM tt JOIN m ON tt.artist = m.artist AND tt.title = m.title GROUP BY 1, 2""")
def _(e):
    return H.lifelines(e).withColumn("lifeline", F.array_join(F.transform("lifeline", lambda x: F.concat_ws(":", x["ym"], x["n"])), ","))


@query("track_seasons", STORIES_SQL + """, m AS (SELECT o.artist, o.title, any_value(tt.plays) AS total, utc_month, count(*) AS n FROM o JOIN tt ON o.artist = tt.artist AND o.title = tt.title WHERE tt.plays >= 12 GROUP BY o.artist, o.title, utc_month),
b AS (SELECT artist, title, total, lower(monthname(make_date(2000, utc_month, 1))) AS label, n, 0 AS kind FROM m
  UNION ALL SELECT artist, title, any_value(total), CASE WHEN utc_month IN (12, 1, 2) THEN 'winter' WHEN utc_month < 6 THEN 'spring' WHEN utc_month < 9 THEN 'summer' ELSE 'fall' END AS label, sum(n), 1 FROM m GROUP BY artist, title, label)
SELECT artist, title, label, round(n / total::DOUBLE, 3) AS concentration FROM (SELECT *, row_number() OVER (PARTITION BY artist, title ORDER BY kind, n DESC, label) AS k FROM b WHERE n / total::DOUBLE >= 0.3) WHERE k = 1""")
def _(e):
    return H.track_seasons(e, share=0.3)


@query("milestones", "SELECT artist, title, CAST(sum(ms) AS BIGINT) AS ms, count(*) AS plays FROM o GROUP BY 1, 2 ORDER BY ms DESC, artist, title LIMIT 20")
def _(e):
    return H.milestones(e)


@query("loyalty", ARTISTS_SQL + """, t AS (SELECT * FROM a ORDER BY plays DESC, first_us, artist LIMIT 120)
SELECT t.artist, any_value(t.household) AS household, any_value(t.plays) AS plays, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS active_years, bool_or(year IN (2025, 2026)) AS still_active
FROM t JOIN p ON t.artist = p.artist GROUP BY 1""")
def _(e):
    return H.loyalty(e)


@query("gap_years", """SELECT CAST(y AS INT) AS year, coalesce(plays, 0) AS plays, CASE WHEN plays IS NULL THEN 'missing' ELSE 'sparse' END AS label FROM range(2005, 2027) t(y)
LEFT JOIN (SELECT year, count(*) FILTER (WHERE is_play) AS plays FROM e GROUP BY 1) s ON s.year = t.y WHERE plays IS NULL OR plays < 200""")
def _(e):
    return H.gap_years(e, first=2005)


@query("coverage", "SELECT year, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM p GROUP BY 1")
def _(e):
    return H.coverage(e).withColumn("services", F.array_join("services", ","))


ZOOM_SQL = """, y AS (SELECT artist, count(*) AS plays FROM p WHERE year = {0} GROUP BY 1), f AS (SELECT artist, min(us) AS f FROM e WHERE year = {0} GROUP BY 1)
SELECT CAST(rank AS INT) AS rank, what, plays FROM (SELECT row_number() OVER (ORDER BY plays DESC, f, y.artist) AS rank, y.artist AS what, plays FROM y JOIN f ON y.artist = f.artist) WHERE rank <= 20
UNION ALL SELECT 0, 'no such year; there are ' || string_agg(DISTINCT CAST(year AS VARCHAR), ', ' ORDER BY CAST(year AS VARCHAR)), 0 FROM e HAVING NOT bool_or(year = {0})"""


@query("year_zoom", ZOOM_SQL.format(2019))
def _(e):
    return H.zoom(e, 2019)


@query("year_zoom_missing", ZOOM_SQL.format(1999))
def _(e):
    return H.zoom(e, 1999)


#: Start reasons of the fixed type list of the wide feature table, and its platform families.
REASONS = ("appload", "backbtn", "clickrow", "fwdbtn", "playbtn", "remote", "trackdone", "unknown")
FAMILIES = ("desktop", "mobile", "other", "speaker_tv", "web")
WIDE = [(f, r) for f in FAMILIES for r in REASONS]


P5_WIDE_SQL = f"""WITH t AS (SELECT spotify_track_uri AS uri, epoch_us(TRY_CAST(ts AS TIMESTAMPTZ)) AS us, coalesce(ms_played, 0) AS ms, {PLATFORM_SQL} AS family, coalesce(reason_start, 'unknown') AS reason
  FROM (SELECT *, coalesce(platform, 'not_applicable') AS pf FROM streaming_history WHERE spotify_track_uri <> ''))
SELECT uri, """ + ", ".join(
    f"count(*) FILTER (WHERE {w}) AS n_{label((f, r))}, CAST(coalesce(sum(ms) FILTER (WHERE {w}), 0) AS BIGINT) AS total_{label((f, r))}, strftime(make_timestamp(max(us) FILTER (WHERE {w})), '%Y-%m-%dT%H:%M:%SZ') AS last_{label((f, r))}"
    for f, r in WIDE
    for w in [f"family = '{f}' AND reason = '{r}'"]
) + " FROM t GROUP BY 1"


def _wide_kinds(history: DataFrame) -> DataFrame:
    listens = history.where("spotify_track_uri <> ''")
    return listens.select(F.col("spotify_track_uri").alias("uri"), instant_us(F.col("ts")).alias("us"), "ms_played", platform_bucket(F.col("platform")).alias("family"), F.coalesce("reason_start", F.lit("unknown")).alias("reason"))


def p5_wide(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each track uri with columns for each platform family and start reason of the fixed list."""
    rows = wide_features(_wide_kinds(table(spark, folder, "streaming_history")), entity="uri", type_cols=["family", "reason"], at="us", value="ms_played", types=WIDE)
    return rows.select("uri", *[c for t in WIDE for c in (f"n_{label(t)}", f"total_{label(t)}", utc_iso(F.col(f"last_us_{label(t)}")).alias(f"last_{label(t)}"))])


QUERIES["p5_wide"] = p5_wide
ORACLES["p5_wide"] = P5_WIDE_SQL

#: The fixed list with the blank reason; what is in neither goes to the columns named other.
WIDE_ALL = [(f, r) for f in FAMILIES for r in (*REASONS, "")]

P5_WIDE_ALL_SQL = P5_WIDE_SQL[: P5_WIDE_SQL.index("SELECT uri, ")] + "SELECT uri, " + ", ".join(
    f"count(*) FILTER (WHERE {w}) AS n_{name}, CAST(coalesce(sum(ms) FILTER (WHERE {w}), 0) AS BIGINT) AS total_{name}, strftime(make_timestamp(max(us) FILTER (WHERE {w})), '%Y-%m-%dT%H:%M:%SZ') AS last_{name}"
    for name, w in [
        *[(label((f, r)), f"family = '{f}' AND reason = '{r}'") for f, r in WIDE_ALL],
        ("other", f"NOT (family IN {FAMILIES} AND reason IN {(*REASONS, '')})"),
    ]
) + " FROM t GROUP BY 1"


def p5_wide_all(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`p5_wide`, with columns for the blank reason and for all listens of kinds that aren't listed."""
    rows = wide_features(_wide_kinds(table(spark, folder, "streaming_history")), entity="uri", type_cols=["family", "reason"], at="us", value="ms_played", types=WIDE_ALL)
    return rows.select("uri", *[c for n in [*map(label, WIDE_ALL), "other"] for c in (f"n_{n}", f"total_{n}", utc_iso(F.col(f"last_us_{n}")).alias(f"last_{n}"))])


QUERIES["p5_wide_all"] = p5_wide_all
ORACLES["p5_wide_all"] = P5_WIDE_ALL_SQL


def case_election(spark: SparkSession, folder: str) -> DataFrame:
    raw = H.events(table(spark, folder, "streaming_history"), canonical=False).select("artist", "ms", "service")
    return H.elected_names(raw)


QUERIES["case_election"] = case_election
ORACLES["case_election"] = E_SQL + "SELECT artist, canonical, plays FROM elected WHERE writings > 1"
