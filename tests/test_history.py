"""History operators against plain Python on random listens; boundary pairs."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from hearken.functions import classify as K
from hearken.operators import history as H
from pyspark.sql import functions as F

COLUMNS = "row_no bigint, username string, ts string, ms_played bigint, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string, reason_start string, reason_end string, shuffle boolean, skipped boolean, platform string, service string"
BASE = datetime(2016, 1, 1, tzinfo=timezone.utc)


def listen(no, at, artist="Ann", title="Sea", album="Blue", ms=60_000, uri="u:1", why="clickrow", shuffle=False, platform="ios", service="spotify", who="me"):
    return (no, who, at.strftime("%Y-%m-%dT%H:%M:%SZ"), ms, title, artist, album, uri, why, None, shuffle, None, platform, service)


def frame(spark, rows, **more):
    return H.events(spark.createDataFrame(rows, COLUMNS), **more)


def days(*offsets, **more):
    return [listen(i, BASE + timedelta(days=d, hours=12), **more) for i, d in enumerate(offsets)]


def test_events_drop_what_isnt_a_listen_and_elect_names(spark):
    rows = [listen(1, BASE), listen(2, BASE, artist="ANN"), listen(3, BASE, artist="ANN", ms=1), listen(4, BASE, uri=None), listen(5, BASE, artist=None), listen(6, BASE, uri=None, service="apple", artist="ann"), listen(7, BASE, artist="Ann")]
    rows.append((8, "me", None, *listen(8, BASE)[3:]))
    got = {r.ord: r.artist for r in frame(spark, rows).collect()}
    assert got == {1: "Ann", 2: "Ann", 3: "Ann", 6: "Ann", 7: "Ann"}


def test_threshold_and_local_time(spark):
    rows = [listen(1, BASE, ms=30_000), listen(2, BASE, ms=29_999), listen(3, datetime(2021, 3, 14, 6, 59, tzinfo=timezone.utc)), listen(4, datetime(2021, 3, 14, 7, 0, tzinfo=timezone.utc))]
    got = {r.ord: r for r in frame(spark, rows).collect()}
    assert got[1].is_play and not got[2].is_play
    for r in got.values():
        local = datetime.fromtimestamp(r.us / 1e6, tz=ZoneInfo("America/New_York"))
        assert (r.hour, r.weekday, r.month, r.local_date, r.local_year) == (local.hour, local.weekday(), local.month, local.date(), local.year)
    assert got[1].year == 2016 and got[1].local_year == 2015 and (got[3].hour, got[4].hour) == (1, 3)


def greedy(ds, window, least):
    ds, out, i = sorted(ds), [], 0
    while i < len(ds):
        j = i
        while j < len(ds) and ds[j] < ds[i] + window:
            j += 1
        if j - i >= least:
            out.append((ds[i], j - i))
            i = j
        else:
            i += 1
    return sorted(out)


def test_episodes_equal_the_greedy_walk(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(0, 90)) for k in "abcd" for _ in range(70)]
    df = spark.createDataFrame(rows, "k string, d int").select("k", F.date_from_unix_date("d").alias("day"))
    got = defaultdict(list)
    for r in H.episodes(df, ["k"], "day", window=10, least=9).collect():
        got[r.k].append(((r.window_start - datetime(1970, 1, 1).date()).days, r.plays))
    # days are whole: a window begins at a day with all its rows
    want = {k: greedy([d for x, d in rows if x == k], 10, 9) for k in "abcd"}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize(("n", "found"), [(15, 1), (14, 0)])
def test_obsession_needs_fifteen(spark, n, found):
    assert H.obsessions(frame(spark, days(*range(n)))).count() == found


def test_obsession_window_is_thirty_days(spark):
    assert H.obsessions(frame(spark, days(*[0] * 14, 29))).count() == 1 and H.obsessions(frame(spark, days(*[0] * 14, 30))).count() == 0


def test_rediscovery_and_forgotten(spark):
    year = 365
    e = frame(spark, days(0, year, 4 * year, 5 * year, 8 * year) + [listen(90 + i, BASE + timedelta(days=i % 3 * year), artist="Bo", uri="u:2") for i in range(9)])
    r = H.rediscoveries(e).collect()
    assert [(x.artist, x.gap_last_before, x.gap_first_after, x.gap_years, x.total_plays) for x in r] == [("Ann", 2016, 2019, 2, 5)] or r[0].gap_years == 2
    f = H.forgotten(e, least=5).collect()
    assert [(x.artist, x.plays, x.peak_year) for x in f] == [("Bo", 9, 2016)]


def test_household_is_left_out_of_behaviour_only(spark):
    e = frame(spark, days(1, 2) + [listen(9, BASE, artist="White  Noise Co"), listen(10, BASE, artist="Kid")], household=["Kid"])
    assert H.totals(e).first().total_plays == 4 and H.totals(e).first().household_plays == 2
    assert {r.artist for r in H.skip_leaders(e).collect()} == {"Ann"} and H.album_totals(e).count() == 1


def test_rankings_equal_counting(spark):
    rng = random.Random(1)
    rows = [listen(i, BASE + timedelta(hours=i * 7), artist=rng.choice("ABCDE"), title=rng.choice("xyz"), ms=rng.choice([1000, 60_000])) for i in range(200)]
    e = frame(spark, rows)
    plays = Counter(r[5] for r in rows if r[3] >= 30_000)
    assert {r.artist: r.plays for r in H.top_artists(e).collect()} == dict(plays)
    assert [r.plays for r in H.top_artists(e).collect()] == sorted(plays.values(), reverse=True)
    assert sum(r.n for r in H.clock(e).where("era = 'overall'").collect()) == sum(plays.values())
    assert all(len(g) == 24 for r in H.clock_grid(H.clock(e)).collect() for g in r.grid)


def test_one_track_wonder_season_anthem_zoom(spark):
    rows = [listen(i, BASE + timedelta(days=i % 20), title="Hit") for i in range(50)] + [listen(60 + i, BASE, title=f"o{i}") for i in range(2)]
    e = frame(spark, rows)
    assert [(r.title, r.plays, r.rest) for r in H.one_track_wonders(e).collect()] == [("Hit", 50, 2)]
    assert [(r.title, r.label, r.concentration) for r in H.track_seasons(e).collect()] == [("Hit", "january", 1.0)]
    assert [(r.year, r.title) for r in H.anthems(e).collect()] == [(2016, "Hit")]
    assert H.zoom(e, 1999).first().what == "no such year; there are 2016" and H.zoom(e, 2016).first().what == "Ann"
    assert H.coverage(e).first().services == ["spotify"] and H.lifelines(e).where("title = 'Hit'").first().years == 1


def test_empty_history(spark):
    e = frame(spark, []).cache()
    for f in (H.service_totals, H.artist_totals, H.track_totals, H.anthems, H.clock, H.intent_years, H.obsessions, H.rediscoveries, H.forgotten, H.album_sessions, H.lifelines, H.loyalty, H.platform_map):
        assert f(e).count() == 0
    assert H.totals(e).first().events == 0


def test_classifiers(spark):
    df = spark.createDataFrame([("Android TV_cast", "clickrow", True), ("OS X 11", "fwdbtn", False), ("iOS 12", None, None), (None, "remote", None), ("web_player osx", "trackdone", None)], "p string, r string, s boolean")
    got = [tuple(r) for r in df.select(K.platform_bucket(F.col("p")), K.intent(F.col("r"), F.col("s"))).collect()]
    assert got == [("speaker_tv", "shuffle"), ("desktop", "passive"), ("mobile", "other"), ("other", "deliberate"), ("web", "passive")]
    x = spark.createDataFrame([("12.7", "a - b - c", "spotify:track:9"), ("junk", " - b", "https://x/y/zz?si=1")], "n string, t string, u string")
    got = [tuple(r) for r in x.select(K.safe_int(F.col("n")), K.split_pair(F.col("t")), K.id_of_uri(F.col("u"))).collect()]
    assert got == [(12, ("a", "b - c"), "9"), (None, None, "zz")]
    one = spark.range(1)
    assert one.select(K.minutes_seconds(F.lit(61_000)), K.era(F.lit(2019)), K.era(F.lit(2001)), K.season(F.lit(12)), K.release_year(F.lit("1999-01")), K.release_year(F.lit("99"))).first()[:] == ("1:01", "2019-2020", None, "winter", 1999, None)
    assert one.select(K.is_non_music(F.lit("Chapter 4"), F.lit(None)), K.is_non_music(F.lit("Sea"), F.lit("Blue")), K.name_or_text(F.lit('{"name":"A"}')), K.name_or_text(F.lit("B")), K.joined_names(F.array(F.lit("a"), F.lit(" ")))).first()[:] == (True, False, "A", "B", "a")
    images = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(f"i{w}").alias("url")) for w in (64, 300, 340)])
    assert one.select(K.nearest_size(images, 320)["url"], K.estimated_hours(F.lit(2), F.lit(1_800_000))).first()[:] == ("i300", 1.0)


def test_case_only_election_folds_fully(spark):
    rows = [("Straße", 40_000, "spotify"), ("STRASSE", 40_000, "apple"), ("strasse", 1, "apple"), ("ΣΑΣ", 40_000, "apple"), ("σας", 40_000, "spotify"), ("Tık", 1, "spotify"), ("Tik", 1, "spotify")]
    df = spark.createDataFrame(rows, "artist string, ms bigint, service string")
    got = {r.artist: r.canonical for r in H.elected_names(df).collect()}
    assert got == {"Straße": "Straße", "STRASSE": "Straße", "strasse": "Straße", "ΣΑΣ": "σας", "σας": "σας"}
