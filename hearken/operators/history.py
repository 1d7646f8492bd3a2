"""The listening history: canonical events, and the summaries, rankings and sequences computed from them.

Every function takes the canonical event table of :func:`events` (columns ``ord, us, artist, title, album, uri,
platform, reason_start, shuffle, service, ms, account``, and the derived ``year, is_play, household, local_year,
month, weekday, hour, local_date``) and returns a DataFrame; nothing is computed before a sink or
caller asks. Ties in rankings go to what was heard first, then to the name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.classify import era, hours, intent, is_household, is_play, platform_bucket, season
from hearken.functions.instants import instant_us, utc_ntz
from hearken.operators.sessions import chunked_sessions

ZONE = "America/New_York"


def events(listens: DataFrame, *, household: Sequence[str] = (), zone: str = ZONE, canonical: bool = True) -> DataFrame:
    """Canonical events of raw listens: rows with act and instant (and uri, for the service that has them).

    ``canonical`` renames acts that differ in case only to the elected writing, before anything is counted.
    """
    raw = listens.select(
        F.col("row_no").alias("ord"),
        instant_us(F.col("ts")).alias("us"),
        F.col("master_metadata_album_artist_name").alias("artist"),
        F.coalesce(F.nullif(F.col("master_metadata_track_name"), F.lit("")), F.lit("?")).alias("title"),
        F.coalesce("master_metadata_album_album_name", F.lit("")).alias("album"),
        F.coalesce("spotify_track_uri", F.lit("")).alias("uri"),
        "platform",
        "reason_start",
        "shuffle",
        "service",
        F.coalesce("ms_played", F.lit(0)).alias("ms"),
        F.col("username").alias("account"),
    ).where("us is not null and artist <> '' and (service <> 'spotify' or uri <> '')")
    if canonical:
        raw = rename(raw, elected_names(raw))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_ntz(F.col("us")))
    return (
        raw.withColumns({"utc": utc_ntz(F.col("us")), "local": local, "is_play": is_play(F.col("ms")), "household": is_household(F.col("artist"), household)})
        .withColumns({"year": F.year("utc"), "utc_month": F.month("utc"), "local_year": F.year("local"), "month": F.month("local"), "weekday": F.weekday("local"), "hour": F.hour("local"), "local_date": F.to_date("local")})
        .drop("utc", "local")
    )


def case_key(name: Column) -> Column:
    """Full case folding in built-ins: upper case spells out what lower case has no single letter for (ß, ligatures); the dotless i stays apart.

    The translations between also keep the optimizer from taking lower(upper(x)) for lower(x).
    """
    return F.lower(F.translate(F.upper(F.translate(F.lower(name), "ı", "\ue000")), "\ue000", "ı"))


def elected_names(raw: DataFrame) -> DataFrame:
    """Writings of acts that differ in case only, with the one elected: most plays, then heard on the first service, then by name.

    Columns: ``artist``, ``canonical``, ``plays`` of the writing; only groups of several writings.
    """
    counts = raw.groupBy("artist").agg(F.count_if(is_play(F.col("ms"))).alias("plays"), F.max((F.col("service") == "spotify").cast("int")).alias("first_service"))
    fold = case_key(F.col("artist")).alias("fold")
    group = Window.partitionBy("fold")
    ranked = counts.select("*", fold).select("*", F.row_number().over(group.orderBy(F.desc("plays"), F.desc("first_service"), "artist")).alias("rank"), F.count(F.lit(1)).over(group).alias("writings"))
    elected = ranked.withColumn("canonical", F.max(F.when(F.col("rank") == 1, F.col("artist"))).over(group))
    return elected.where("writings > 1").select("artist", "canonical", "plays")


def rename(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Acts renamed to their canonical writing; those without one stay."""
    alias = names.where("artist <> canonical").select("artist", "canonical")
    return raw.join(alias, "artist", "left").withColumn("artist", F.coalesce("canonical", "artist")).drop("canonical")


def plays(e: DataFrame) -> DataFrame:
    return e.where("is_play")


def own_plays(e: DataFrame) -> DataFrame:
    """Plays without the household's."""
    return e.where("is_play and not household")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows in an order (a bounded heap for each task, never a global sort)."""
    return df.orderBy(*order).limit(n)


def most_played(df: DataFrame, *, least: int, n: int) -> DataFrame:
    """Rows with at least ``least`` plays, the ``n`` most played of them; ties go to what was heard first, then to the name."""
    names = [c for c in ("artist", "album", "title") if c in df.columns]
    return top(df.where(F.col("plays") >= least), n, F.desc("plays"), "first_us", *names)


def _share(part: Column, rest: Column, digits: int) -> Column:
    """part / (part + rest), 0 when both are 0."""
    return F.when(part + rest > 0, F.round(part / (part + rest), digits)).otherwise(F.lit(0.0))


# Totals


def totals(e: DataFrame) -> DataFrame:
    return e.agg(
        F.count(F.lit(1)).alias("events"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count_if("is_play").alias("total_plays"),
        hours(F.sum("ms")).alias("total_hours"),
        F.countDistinct("artist").alias("unique_artists"),
        F.countDistinct(F.when(F.col("is_play"), F.struct("artist", "title"))).alias("unique_tracks"),
        F.count_if(F.col("household") & F.col("is_play")).alias("household_plays"),
    )


def service_totals(e: DataFrame) -> DataFrame:
    return e.groupBy("service").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_play").alias("plays"), F.count_if(~F.col("is_play")).alias("skips"), F.sum("ms").alias("ms"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def service_years(e: DataFrame) -> DataFrame:
    return e.groupBy("year", "service").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_play").alias("plays"))


def year_totals(e: DataFrame) -> DataFrame:
    return e.groupBy("year").agg(F.count_if("is_play").alias("plays"), F.sum("ms").alias("ms"), F.count_if(~F.col("is_play")).alias("skips"))


def artist_totals(e: DataFrame) -> DataFrame:
    by = e.groupBy("artist").agg(F.count_if("is_play").alias("plays"), F.sum("ms").alias("ms"), F.count_if(~F.col("is_play")).alias("skips"), F.min("us").alias("first_us"), F.max("household").alias("household"))
    return by.withColumn("skip_rate", _share(F.col("skips"), F.col("plays"), 2))


def artist_years(e: DataFrame) -> DataFrame:
    return plays(e).groupBy("artist", "year").agg(F.count(F.lit(1)).alias("plays"))


def artist_year_maps(e: DataFrame) -> DataFrame:
    """Plays by year of each act, as a map in year order."""
    return artist_years(e).groupBy("artist").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "plays")))).alias("by_year"))


def _last_uri() -> Column:
    """Uri of the last event that has one."""
    return F.max(F.when(F.col("uri") != "", F.struct("us", "ord", "uri")))["uri"]


def track_totals(e: DataFrame) -> DataFrame:
    return plays(e).groupBy("artist", "title").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"), F.coalesce(_last_uri(), F.lit("")).alias("uri"), F.array_sort(F.collect_set("year")).alias("years"), F.min("us").alias("first_us"), F.max("household").alias("household")
    )


def top_artists(e: DataFrame, n: int = 400) -> DataFrame:
    return top(artist_totals(e), n, F.desc("plays"), "first_us", "artist")


def top_tracks(e: DataFrame, n: int = 150) -> DataFrame:
    return top(track_totals(e), n, F.desc("plays"), "first_us", "artist", "title")


def year_top_artists(e: DataFrame, n: int = 25) -> DataFrame:
    first = e.groupBy("artist").agg(F.min("us").alias("first_us"))
    w = Window.partitionBy("year").orderBy(F.desc("plays"), "first_us", "artist")
    return artist_years(e).join(first, "artist").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("year", "rank", "artist", "plays")


def year_tracks(e: DataFrame) -> DataFrame:
    return own_plays(e).groupBy("year", "artist", "title").agg(F.count(F.lit(1)).alias("plays"), F.min("us").alias("first_us"))


def year_top_tracks(e: DataFrame, n: int = 15) -> DataFrame:
    w = Window.partitionBy("year").orderBy(F.desc("plays"), "first_us", "artist", "title")
    return year_tracks(e).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("year", "rank", "artist", "title", "plays")


def anthems(e: DataFrame) -> DataFrame:
    """Each year's most played track; of equals the one most played that year for its all-time plays."""
    all_time = own_plays(e).groupBy("artist", "title").agg(F.count(F.lit(1)).alias("total"), _last_uri().alias("uri"))
    joined = year_tracks(e).join(all_time, ["artist", "title"]).withColumn("concentration", F.round(F.col("plays") / F.col("total"), 3))
    w = Window.partitionBy("year").orderBy(F.desc("plays"), F.desc(F.col("plays") / F.col("total")), "first_us", "artist", "title")
    return joined.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("year", "artist", "title", F.coalesce("uri", F.lit("")).alias("uri"), "plays", "concentration")


# When and how


def clock(e: DataFrame) -> DataFrame:
    """Plays by weekday and hour, over all (era null) and by era of the local year."""
    cells = own_plays(e).groupBy(era(F.col("local_year")).alias("era"), "weekday", "hour").agg(F.count(F.lit(1)).alias("n"))
    # a cell counts for its era and for all; the cells are few, the events are read once
    both = cells.select(F.explode(F.array_compact(F.array(F.lit("overall"), F.col("era")))).alias("era"), "weekday", "hour", "n")
    return both.groupBy("era", "weekday", "hour").agg(F.sum("n").alias("n"))


def clock_grid(cells: DataFrame) -> DataFrame:
    """Dense 7 x 24 grid of each era, as nested arrays."""
    slots = cells.select("era").distinct().select("era", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday")).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    rows = slots.join(cells, ["era", "weekday", "hour"], "left").groupBy("era", "weekday").agg(F.transform(F.sort_array(F.collect_list(F.struct("hour", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("row"))
    return rows.groupBy("era").agg(F.transform(F.sort_array(F.collect_list(F.struct("weekday", "row"))), lambda x: x["row"]).alias("grid"))


def intent_years(e: DataFrame) -> DataFrame:
    """Plays by intent in each year, of the service that records a reason."""
    p = own_plays(e).where("service = 'spotify'").select("year", intent(F.col("reason_start"), F.col("shuffle")).alias("intent"))
    kinds = ["deliberate", "other", "passive", "shuffle"]
    wide = p.groupBy("year").pivot("intent", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)
    return wide.withColumn("total", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))


def reason_years(e: DataFrame) -> DataFrame:
    return own_plays(e).where("service = 'spotify'").groupBy("year", F.coalesce("reason_start", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def months(e: DataFrame) -> DataFrame:
    """Plays by UTC year and local month."""
    return own_plays(e).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


def artist_months(e: DataFrame, n: int = 200) -> DataFrame:
    """Plays by UTC year, local month and act, of the ``n`` most played acts outside the household."""
    ranked = top(artist_totals(e).where("not household"), n, F.desc("plays"), "first_us", "artist").select("artist")
    return own_plays(e).join(F.broadcast(ranked), "artist", "left_semi").groupBy("year", "month", "artist").agg(F.count(F.lit(1)).alias("n"))


def platform_years(e: DataFrame) -> DataFrame:
    return own_plays(e).groupBy("year", platform_bucket(F.col("platform")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def platform_map(e: DataFrame) -> DataFrame:
    return own_plays(e).select(F.coalesce("platform", F.lit("not_applicable")).alias("platform")).distinct().select("platform", platform_bucket(F.col("platform")).alias("bucket"))


def skip_leaders(e: DataFrame, n: int = 200) -> DataFrame:
    by = e.where("not household").groupBy("artist").agg(F.count_if("is_play").alias("plays"), F.count_if(~F.col("is_play")).alias("skips"), F.min("us").alias("first_us"))
    by = by.select("*", (F.col("plays") + F.col("skips")).alias("exposure"), _share(F.col("skips"), F.col("plays"), 3).alias("skip_rate"))
    return top(by, n, F.desc("exposure"), "first_us", "artist")


def skip_extremes(leaders: DataFrame, *, guard: int = 20, n: int = 15, most: bool = False) -> DataFrame:
    """Acts least, or most, skipped among those with at least ``guard`` events."""
    way = F.desc("skip_rate") if most else F.asc("skip_rate")
    return top(leaders.where(F.col("exposure") >= guard), n, way, F.desc("exposure"), "artist").select("artist", "plays", "skips", "skip_rate", "exposure")


# Sequences


def album_sessions(e: DataFrame, *, gap_s: int = 600, least: int = 4) -> DataFrame:
    """Runs of an album by an account: each play after the first follows the one before within the gap as its natural successor."""
    p = own_plays(e).where("service = 'spotify'").select("account", "us", F.nullif(F.col("album"), F.lit("")).alias("album"), "reason_start")
    return chunked_sessions(p, entity="account", at="us", same="album", reason="reason_start", continues="trackdone", gap_us=gap_s * 1_000_000, min_events=least)


def session_years(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.year(utc_ntz(F.col("start_us"))).alias("year")).agg(F.count(F.lit(1)).alias("sessions"))


def session_albums(sessions: DataFrame) -> DataFrame:
    """Albums of sessions with their number and the longest."""
    return sessions.groupBy("album").agg(F.count(F.lit(1)).alias("sessions"), F.max("n_events").alias("longest"))


def episodes(p: DataFrame, keys: Sequence[str], day: str, *, window: int = 30, least: int = 15) -> DataFrame:
    """Greedy windows of ``window`` days with at least ``least`` rows of a key, each begun after the one before ended.

    Keys without any such window are pruned by a range count; the days of the rest are folded in order. A key's days
    are counted first, so the folded array is bounded by the days between its first and last.
    """
    daily = p.groupBy(*keys, F.datediff(F.col(day), F.lit("1970-01-01")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("d").rangeBetween(0, window - 1)
    reach = daily.withColumn("reach", F.sum("n").over(ahead))
    starts = reach.where(F.col("reach") >= least).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("d", F.col("reach").cast("bigint").alias("n")))).alias("s"))
    empty = F.struct(F.lit(-1_000_000).alias("free"), F.expr("cast(array() as array<struct<d:int,n:bigint>>)").alias("found"))
    step = lambda acc, x: F.when(x["d"] >= acc["free"], F.struct((x["d"] + window).alias("free"), F.concat(acc["found"], F.array(F.struct(x["d"].alias("d"), x["n"].alias("n")))).alias("found"))).otherwise(acc)
    folded = starts.select(*keys, F.explode(F.aggregate("s", empty, step, lambda acc: acc["found"])).alias("x"))
    return folded.select(*keys, F.date_from_unix_date("x.d").alias("window_start"), F.col("x.n").alias("plays"))


def obsessions(e: DataFrame, *, window: int = 30, least: int = 15, n: int = 50) -> DataFrame:
    found = episodes(own_plays(e), ["artist", "title"], "local_date", window=window, least=least)
    return top(found, n, F.desc("plays"), "window_start", "artist", "title")


def rediscoveries(e: DataFrame, *, gap: int = 2, n: int = 40) -> DataFrame:
    """Acts back after at least ``gap`` silent years: their longest gap, the earliest of equals."""
    years = own_plays(e).select("artist", "year").distinct()
    before = F.lag("year").over(Window.partitionBy("artist").orderBy("year"))
    gaps = years.select("artist", before.alias("gap_last_before"), F.col("year").alias("gap_first_after")).withColumn("gap_years", F.col("gap_first_after") - F.col("gap_last_before") - 1).where(F.col("gap_years") >= gap)
    w = Window.partitionBy("artist").orderBy(F.desc("gap_years"), "gap_last_before")
    longest = gaps.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    total = plays(e).groupBy("artist").agg(F.count(F.lit(1)).alias("total_plays"), F.min("us").alias("first_us"))
    return top(longest.join(total, "artist"), n, F.desc("total_plays"), "first_us", "artist").drop("first_us")


def forgotten(e: DataFrame, *, least: int = 40, quiet: int = 2) -> DataFrame:
    """Acts with many plays but none in the last ``quiet`` years that have events; peak (earliest of equals) and last year."""
    recent = e.select("year").distinct().orderBy(F.desc("year")).limit(quiet)
    by = artist_years(e)
    silent = by.join(by.join(F.broadcast(recent), "year", "left_semi").select("artist").distinct(), "artist", "left_anti")
    peak = F.max(F.struct("plays", (-F.col("year")).alias("neg")))
    return silent.groupBy("artist").agg(F.sum("plays").alias("plays"), (-peak["neg"]).alias("peak_year"), F.max("year").alias("last_year")).where(F.col("plays") >= least)


# Albums and tracks


def album_totals(e: DataFrame) -> DataFrame:
    return own_plays(e).where("album <> ''").groupBy("artist", "album").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms").alias("ms"), F.min("us").alias("first_us"))


def album_tracks(e: DataFrame) -> DataFrame:
    return own_plays(e).where("album <> ''").groupBy("artist", "album", "title").agg(F.count(F.lit(1)).alias("plays"), _last_uri().alias("uri"), F.min("us").alias("first_us"))


def album_top_track(e: DataFrame) -> DataFrame:
    """Most played track of each album; an album without uri on it gets the uri of its first track that has one."""
    t = album_tracks(e)
    w = Window.partitionBy("artist", "album").orderBy(F.desc("plays"), "first_us", "title")
    sample = F.min(F.when(F.col("uri").isNotNull(), F.struct("first_us", "title", "uri"))).over(Window.partitionBy("artist", "album"))["uri"]
    return t.select("*", F.row_number().over(w).alias("rank"), sample.alias("sample")).where("rank = 1").select("artist", "album", "title", "plays", F.coalesce("uri", "sample", F.lit("")).alias("uri"))


def top_albums(e: DataFrame, sessions: DataFrame, n: int = 80) -> DataFrame:
    """Most played albums with their best track and number of sessions."""
    ranked = top(album_totals(e), n, F.desc("plays"), "first_us", "artist", "album")
    best = album_top_track(e).select("artist", "album", F.col("title").alias("top_track"), F.col("plays").alias("top_plays"), "uri")
    return ranked.join(best, ["artist", "album"]).join(session_albums(sessions).select("album", "sessions"), "album", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0))).drop("first_us")


def one_track_wonders(e: DataFrame, *, hit: int = 50, rest: int = 2) -> DataFrame:
    """Albums with one track of at least ``hit`` plays and at most ``rest`` on all others."""
    w = Window.partitionBy("artist", "album")
    t = album_tracks(e).select("*", F.row_number().over(w.orderBy(F.desc("plays"), "first_us", "title")).alias("rank"), F.sum("plays").over(w).alias("all"))
    return t.where("rank = 1").select("artist", "album", "title", "plays", (F.col("all") - F.col("plays")).alias("rest")).where((F.col("plays") >= hit) & (F.col("rest") <= rest))


def lifelines(e: DataFrame, n: int = 100) -> DataFrame:
    """Stories of the most played tracks: plays by UTC month, first and last month, years, span."""
    ranked = top(track_totals(e).where("not household"), n, F.desc("plays"), "first_us", "artist", "title").select("artist", "title", "plays", "uri")
    ym = F.format_string("%04d-%02d", "year", "utc_month")
    monthly = own_plays(e).join(F.broadcast(ranked.select("artist", "title")), ["artist", "title"], "left_semi").groupBy("artist", "title", ym.alias("ym")).agg(F.count(F.lit(1)).alias("n"))
    line = monthly.groupBy("artist", "title").agg(
        F.sort_array(F.collect_list(F.struct("ym", "n"))).alias("lifeline"), F.min("ym").alias("first_month"), F.max("ym").alias("last_month"), F.countDistinct(F.substring("ym", 1, 4)).alias("years")
    )
    return ranked.join(line, ["artist", "title"])


def track_seasons(e: DataFrame, *, n: int = 100, least: int = 12, share: float = 0.7) -> DataFrame:
    """Tracks among the most played that belong to a month, or else a season, with at least ``share`` of their plays; the most concentrated first."""
    ranked = top(track_totals(e).where("not household"), n, F.desc("plays"), "first_us", "artist", "title").where(F.col("plays") >= least).select("artist", "title", F.col("plays").alias("total"))
    monthly = own_plays(e).join(F.broadcast(ranked), ["artist", "title"]).groupBy("artist", "title", "total", "utc_month").agg(F.count(F.lit(1)).alias("n"))
    by_season = monthly.groupBy("artist", "title", "total", season(F.col("utc_month")).alias("label")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit(1))
    by_month = monthly.select("artist", "title", "total", F.lower(F.date_format(F.make_date(F.lit(2000), "utc_month", F.lit(1)), "MMMM")).alias("label"), "n").withColumn("kind", F.lit(0))
    both = by_month.unionByName(by_season).where(F.col("n") / F.col("total") >= share)
    w = Window.partitionBy("artist", "title").orderBy("kind", F.desc("n"), "label")
    found = both.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("artist", "title", "label", F.round(F.col("n") / F.col("total"), 3).alias("concentration"))
    return found.orderBy(F.desc("concentration"), "artist", "title")


def milestones(e: DataFrame, n: int = 20) -> DataFrame:
    """Tracks by time heard."""
    return top(own_plays(e).groupBy("artist", "title").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("plays")), n, F.desc("ms"), "artist", "title")


def loyalty(e: DataFrame, *, n: int = 120, active: Sequence[int] = (2025, 2026)) -> DataFrame:
    """First, last and active years of the most played acts, and whether they're still heard."""
    ranked = top(artist_totals(e), n, F.desc("plays"), "first_us", "artist").select("artist", "household", F.col("plays").alias("total"))
    by = artist_years(e).join(F.broadcast(ranked), "artist")
    return by.groupBy("artist", "household", F.col("total").alias("plays")).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("active_years"), F.max(F.col("year").isin(*active)).alias("still_active"))


def gap_years(e: DataFrame, *, first: int = 2015, last: int = 2026, sparse: int = 200) -> DataFrame:
    """Expected years without events, and years with few plays."""
    expected = e.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    seen = e.groupBy("year").agg(F.count_if("is_play").alias("plays"))
    joined = expected.join(seen, "year", "left")
    return joined.select("year", F.coalesce("plays", F.lit(0)).alias("plays"), F.when(F.col("plays").isNull(), "missing").when(F.col("plays") < sparse, "sparse").alias("label")).where("label is not null")


def coverage(e: DataFrame) -> DataFrame:
    """Services with plays in each year."""
    return plays(e).groupBy("year").agg(F.array_sort(F.collect_set("service")).alias("services"))


def zoom(e: DataFrame, year: int, n: int = 20) -> DataFrame:
    """One year's top acts; for a year without events a single row that lists the years there are."""
    ranked = year_top_artists(e.where(F.col("year") == year), n).select("rank", F.col("artist").alias("what"), "plays")
    known = e.agg(F.array_sort(F.collect_set("year")).alias("ys")).where(~F.array_contains("ys", year)).select(F.lit(0).alias("rank"), F.concat(F.lit("no such year; there are "), F.array_join("ys", ", ")).alias("what"), F.lit(0).cast("bigint").alias("plays"))
    return ranked.unionByName(known)
