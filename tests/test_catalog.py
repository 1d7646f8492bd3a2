"""Names, companion cleaning, canon tiers, resolution, the merge layer, the ledger and the graph."""

import json

import pytest
from pyspark.sql import functions as F

from hearken import sinks
from hearken.functions import names as N
from hearken.operators import catalog as C
from hearken.operators import companion as P
from hearken.operators import timeline as L
from hearken.sources import exports as X

US = 1_500_000_000_000_000


def test_keys():
    assert N.plain_key("“Awake, My Sea!” & Co…") == "awake my sea and co" and N.plain_key(None) == ""
    assert N.album_core("Blue (Deluxe Edition) [2011 Remaster] - EP") == "blue" and N.album_core("Blue (Live) - Single") == "blue live"
    assert N.track_core("Sea (feat. Bo) - Remastered 2011") == "sea" and N.track_core("Sea feat. Bo & Cy") == "sea"
    assert N.artist_key("The Ávila") == "avila" and N.graph_key(" The  Ávila ") == "the avila" and N.fold_key("Straße") == "strasse"
    assert N.ratio("abc", "abc") == 1.0 and N.ratio("", "a") == 0.0 and 0.8 < N.ratio("harbour", "harbor") < 1
    assert N.bracket_extension("Spring Song", "Spring Song (Original Cast)") and not N.bracket_extension("Spring Song", "Spring Song, but Piano") and not N.bracket_extension("Live", "Live (x)")


def test_same_act(spark):
    rows = [("ann lee", "ann lee and the sea", True), ("ann lee", "ann lee band", False), ("band", "band and co", False), ("a b", "a b", True), ("", "", False)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert all(r.got == r.w for r in df.select("w", N.same_act(F.col("a"), F.col("b")).alias("got")).collect())
    q = spark.range(1).select(N.search_queries(F.lit("Sea"), F.lit("Blue (Deluxe)"))).first()[0]
    assert q == ['track:"Sea" album:"Blue (Deluxe)"', 'track:"sea" album:"blue"', "sea blue"]


HEADER = ["Event Type", "Song Name", "Media Type", "Item Type", "Event Start Timestamp", "Event End Timestamp", "Play Duration Milliseconds", "Media Duration In Milliseconds", "Album Name", "End Reason Type", "Feature Name", "Client Device Name"]


def activity(spark):
    t, ok = "2018-08-25T06:11:11.347Z", ["PLAY_END", "Sea", "AUDIO", "ITUNES"]
    rows = [
        [*ok, t, "", "60000.9", "100000", "Blue", "TRACK_SKIPPED_FORWARDS", "lib", "iTunes iOS/10"],
        [*ok, t, "", "60000", "100000", "Blue", "", "lib", "x"],
        ["LYRIC_DISPLAY", "", *[""] * 10],
        ["PLAY_END", " ", *[""] * 10],
        ["", "Sea", "video", *[""] * 9],
        ["", "Sea", "AUDIO", "STREAM", *[""] * 8],
        ["", "Apple Music 1", "AUDIO", "X", *[""] * 8],
        ["", "Sea", "AUDIO", "X", "junk", "", *[""] * 6],
        ["", "Lost", "AUDIO", "X", "", t, "-5", "", "Al", "", "", ""],
        ["", "lost ", "AUDIO", "X", t, "", "120000", "", "Al", "", "", ""],
        ["", "Over", "AUDIO", "X", t, "", "-7", "", "", "", "", ""],
        ["", "SEA", "AUDIO", "X", "2019-08-25T06:11:11Z", "", "900000", "100000", "", "", "", "Macintosh"],
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + ", ".join(f"`{h}` string" for h in HEADER))


def test_companion_cascade(spark):
    texts = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "o int, t string")
    titles = P.title_map(texts("Ann - Sea"), texts("Bo - sea", "no pair"), text="t", order="o")
    overrides = spark.createDataFrame([("over", "Cy")], "key string, artist string")
    judged = P.clean(activity(spark), titles, overrides).cache()
    counts = {r.reason: r.n for r in P.drop_counts(judged).collect()}
    assert counts == {"kept": 3, "duplicate": 1, "event_type": 1, "no_song_name": 1, "non_music_media_type": 1, "non_music_item_type": 1, "non_music_song_name": 1, "no_timestamp": 1, "artist_unresolved": 2}
    assert sum(counts.values()) == activity(spark).count()
    kept = {r.ord: r for r in P.canonical(judged).collect()}
    assert (kept[0].artist, kept[0].ms, kept[0].platform, kept[0].skipped) == ("Ann", 60000, "iOS", True)
    assert (kept[10].artist, kept[10].ms) == ("Cy", 0) and (kept[11].ms, kept[11].platform) == (100000, "Macintosh")
    s = P.stats(judged).first()
    assert (s.total_rows, s.events_emitted, s.unique_songs_seen, s.unique_songs_resolved, s.artist_resolved_via_override, s.ms_clamped_negative, s.ms_clamped_runaway) == (12, 3, 3, 2, 1, 1, 1)
    u = P.unresolved(judged).first()
    assert (u.title, u.plays, u.minutes, u.album, u.year_min) == ("Lost", 2, 2.0, "Al", 2018)
    lines = [r.line for r in sinks.unresolved_report(P.unresolved(judged)).collect()]
    assert lines[0] == "1 songs, 2 plays without act" and lines[-1] == "| Lost | Al | 2 | 2.0 | 2018 |"
    fav = spark.createDataFrame([("Ann - Sea", "2018", "LIKE"), ("junk", "", "")], "`Item Description` string, `Last Modified` string, `Preference` string")
    assert [tuple(r) for r in P.favorites(fav).collect()] == [("Ann", "Sea", "2018", "LIKE")]


@pytest.mark.parametrize(("n", "tier"), [(15, "lived_in"), (14, "brushed")])
def test_canon_tiers(spark, n, tier):
    heard = spark.createDataFrame([("The Ann", "Blue (Deluxe)")] * n + [("Bo", "Other")] * 4 + [("Cy", "Z")] * 3, "artist string, album string")
    canon = spark.createDataFrame([(1, "Ann", "Blue"), (2, "Bo", "Red"), (3, "Cy", "Q"), (4, "Di", "R")], "rank int, artist string, album string")
    known = spark.createDataFrame([("di",)], "akey string")
    got = {r.rank: r for r in C.tier_order(C.canon_tiers(canon, *C.play_maps(heard), known)).collect()}
    assert [got[i].tier for i in (1, 2, 3, 4)] == [tier, "near_miss", "unheard", "near_miss"] and got[4].library_only and got[1].album_plays == n
    assert {r.tier: r.n for r in C.tier_counts(C.canon_tiers(canon, *C.play_maps(heard)), "album_plays").collect()} == {tier: 1, "near_miss": 1, "unheard": 2}


def test_resolution(spark):
    songs = spark.createDataFrame([("a", "Sea", "Blue Album"), ("b", "Sea", "Sea - Single"), ("c", "White Noise", "X"), ("d", "Sky", "Red"), ("e", "Sun", "Gold"), ("f", "Sea", "Two")], "key string, title string, hint string")
    hits = spark.createDataFrame([("a", "Ann", "Sea", "Blue Album (Deluxe)", 0), ("a", "Ann", "Other", "Blue Album", 1), ("d", "Di", "Sky", "Else", 0), ("f", "Ann", "Sea", "Two", 0), ("f", "Bo", "Sea", "Two", 1)], "key string, artist string, track string, album string, pos int")
    got = {r.key: (r.tier, r.artist) for r in C.proposals(songs, hits).collect()}
    assert got == {"a": ("high", "Ann"), "b": ("ambiguous_hint", None), "c": ("non_music", None), "d": ("review", "Di"), "e": ("no_match", None), "f": ("review", "Ann")}
    over = spark.createDataFrame([("Sea ", "Old")], "title string, artist string")
    new = spark.createDataFrame([("sea", "Ann", "high"), ("Sky", "Di", "high"), ("Sun", "X", "review")], "title string, artist string, tier string")
    assert sorted(tuple(r) for r in sinks.accepted(over, new).collect()) == [("Sea ", "Old"), ("Sky", "Di")]
    best = C.best_album(songs.select(F.lit("Ann Lee").alias("artist"), F.col("hint").alias("name")), spark.createDataFrame([("i1", "Ann Lee & Co", "Blue album", 0), ("i2", "Zed", "Red", 1)], "id string, artist string, name string, pos int"))
    assert [(r.name, r.id, r.ratio) for r in best.collect()] == [("Blue Album", "i1", 1.0)]
    cat = spark.createDataFrame([("k", 5, "strict"), ("k", 1, "strict2")], "key string, pos int, v string")
    assert C.first_found(cat.limit(0), cat, key="key").first().v == "strict2"


def test_tags_waves_and_merges(spark):
    buckets = spark.createDataFrame([(0, "rock", "Rock"), (1, "post-rock", "Post"), (2, "jazz fusion", "Jazz")], "ord int, key string, bucket string")
    tags = spark.createDataFrame([("Post-Rock ",), ("indie rock",), ("jazz",), ("qq",), (None,), (" ",)], "tag string")
    got = {r.tag: r.bucket for r in L.tag_buckets(tags, buckets).collect()}
    assert got == {"Post-Rock ": "Post", "indie rock": "Rock", "jazz": "Jazz"}
    assert {r.tag for r in L.tag_buckets(tags, buckets, both_ways=False).collect()} == {"Post-Rock ", "indie rock"}
    feed = spark.createDataFrame([("Ann", "qq", 0), ("Ann", "jazz", 1), ("Ann", "indie rock", 2), ("Kid", "jazz", 0)], "artist string, tag string, rank int")
    own = L.artist_buckets(spark.createDataFrame([("Ann",), ("Bo",), ("Kid",)], "artist string"), feed, L.tag_buckets(tags, buckets), household=["Kid"])
    assert {r.artist: r.bucket for r in own.collect()} == {"Ann": "Jazz", "Bo": "other", "Kid": "kids/household"}
    top = spark.createDataFrame([(2020, "Ann", 3), (2020, "New", 2)], "year int, artist string, plays bigint")
    assert {(r.year, r.bucket, r.plays) for r in L.genre_waves(top, own).collect()} == {(2020, "Jazz", 3), (2020, "other", 2)}
    genres = spark.createDataFrame([(0, "A", ["x", "y"]), (1, "B", ["y"]), (2, "C", ["z"])], "pos int, name string, genres array<string>")
    assert [r.genre for r in L.top_genres(genres, acts=2).collect()] == ["y", "x"]


def test_deep_cuts_use_each_artist_once(spark):
    stories = spark.createDataFrame([(0, "Ann", "Sea", 9, "u1"), (1, "Bo", "Sky", 8, "u2"), (2, "Ann", "Old", 7, "u3"), (3, "Cy", "Sun", 6, "u4")], "pos int, artist string, title string, plays int, uri string")
    tracks = spark.createDataFrame([("u1", 10, ["a"]), ("u2", 50, ["a", "b"]), ("u4", 5, ["c", "b"])], "uri string, popularity int, artist_ids array<string>")
    artists = spark.createDataFrame([("a", 60, "Hit"), ("b", 55, "Sky"), ("c", None, None)], "artist_id string, max_popularity int, top_track_name string")
    cuts = L.deep_cuts(stories, tracks, artists)
    assert {r.artist: (r.diff, r.is_deep_cut) for r in cuts.collect()} == {"Ann": (50, True), "Bo": (5, False)}
    assert L.contrarian_score(cuts).first()[0] == 0.5 and L.contrarian_score(cuts.limit(0)).first()[0] == 0.0


def test_ledger_and_graph(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"ts":"2021","artist":"Ann","playlist":"https://x/p/9"}\nbroken\n{"ts":"2020","artist":"ann"}\n{"artist":"Bo"}\n{"artist":""}\n')
    log = X.ledger(spark, str(path), strict=False).cache()
    known = L.known_acts([spark.createDataFrame([(" BO",), (None,)], "artist string")])
    none = spark.createDataFrame([], "artist string, bucket string")
    found = L.discovery(log, known, none).orderBy("date").collect()
    assert [(r.date, r.artist, r.stuck) for r in found] == [("", "Bo", True), ("2020", "ann", False)]
    with pytest.raises(Exception):
        X.ledger(spark, str(path)).collect()
    fresh, skipped = L.split_new(spark.createDataFrame([("bo ",), ("Di",)], "artist string"), known)
    assert [r.artist for r in fresh.collect()] == ["Di"] and [r.artist for r in skipped.collect()] == ["bo "]
    rows = sinks.ledger_rows(fresh, now="2022", recipe="r")
    sinks.append_ledger(rows, str(tmp_path / "out"))
    sinks.append_ledger(rows, str(tmp_path / "out"))
    assert [tuple(r)[:2] for r in X.ledger(spark, str(tmp_path / "out")).select("ts", "artist").collect()] == [("2022", "Di")] * 2
    nodes = spark.createDataFrame([(0, "Ann", "ann"), (1, "Bo", "bo"), (2, "Cy", "cy")], "i int, name string, key string")
    feed = spark.createDataFrame([("Ann", 0, "bo", "Bo", 0.9), ("Bo", 0, "ann", "Ann", 0.7), ("Ann", 1, "cy", "Cy", 0.04), ("Ann", 2, "zed", "Zed", 0.5), ("Ann", 3, "low", "Low", 0.2), ("Ann", 4, "ann", "Ann", 1.0), ("Bo", 1, "cy", "Cy", None)], "artist string, pos int, neighbor_key string, neighbor string, match double")
    assert [tuple(r) for r in L.graph_edges(nodes, feed).collect()] == [(0, 1, 0.9, True)]
    assert [tuple(r) for r in L.outside_neighbors(nodes, feed).collect()] == [("Ann", 1, "Zed", 0.5)]
    assert L.graph_stats(nodes, feed, spark.createDataFrame([("Bo",)], "artist string")).first()[:] == (2, 1, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps([{"ts": "2020-01-01T00:00:00Z", "ms_played": 1, "master_metadata_album_artist_name": "Ann", "spotify_track_uri": "u"}, {"ts": "x", "spotify_track_uri": None}]))
    got = X.listens(spark, str(tmp_path)).collect()
    assert [(r.master_metadata_album_artist_name, r.service, r.file) for r in got] == [("Ann", "spotify", "Streaming_History_Audio_1.json")]
    assert X.listens(spark, str(tmp_path / "none")).count() == 0 and X.companion_events(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "a.csv").write_text('﻿"Song, Name",B\n"a ""x""\ny",2\n', encoding="utf-8")
    assert [tuple(r)[:2] for r in X.table_file(spark, str(tmp_path / "a.csv")).collect()] == [('a "x"\ny', "2")]
    (tmp_path / "h.txt").write_text("# c\n\n Kid \n")
    assert [r.value for r in X.lines(spark, str(tmp_path / "h.txt")).collect()] == ["Kid"]
    (tmp_path / "m.json").write_text('{"b": "B", "a": "A"}')
    assert [tuple(r) for r in X.ordered_map(spark, str(tmp_path / "m.json")).collect()] == [(0, "b", "B"), (1, "a", "A")]
    (tmp_path / "c.json").write_text('{"albums": []}')
    with pytest.raises(ValueError):
        X.canon(spark, str(tmp_path / "c.json"))
    (tmp_path / "p.tsv").write_text("Ann\tSea\n Bo\n\t\tu\n")
    assert [tuple(r) for r in X.picks(spark, str(tmp_path / "p.tsv")).collect()] == [("Ann", "Sea", None), ("Bo", None, None)]
    (tmp_path / "e.json").write_text('{"events": [{"ts": "2020", "ms_played": 5}]}')
    assert X.companion_events(spark, str(tmp_path / "e.json")).first().ms_played == 5 and X.sibling("/x/y/") == "/x/apple_history_events.json"
    raw = spark.createDataFrame([("A", '{"name":"B","match":"0.5"}'), ("C", '[{"name":"D","match":"?"},{"name":"E","match":"1"}]')], "artist string, json string")
    assert [tuple(r) for r in X.neighbor_feed(raw).collect()] == [("A", 0, "B", 0.5), ("C", 0, "D", None), ("C", 1, "E", 1.0)]
    cache = spark.createDataFrame([("a", 1)], "id string, n int")
    full = X.fill_cache(cache, spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string"), lambda ids: [{"id": i, "n": len(ids)} for i in ids], key="id", batch=1)
    assert sorted(tuple(r) for r in full.collect()) == [("a", 1), ("b", 1), ("c", 1)]
    assert X.optional(spark, str(tmp_path / "no"), "a int, b string")[1] is False
    page = '<div id=i class="genre scanme" style="color: #aabbcc; top: 5px; left: 7px; font-size: 120%" preview_url="http://p" title="e.g. Ann &quot;Sea&quot;">deep &amp; soul<a class=navlink href="m.html">&raquo;</a></div><div class="genre" style="top:9px">pop<a href="p.html">x</a></div>'
    (tmp_path / "g.html").write_text(page)
    g = X.genre_nodes(spark, str(tmp_path / "g.html")).collect()
    assert [(r.name, r.top, r.link) for r in g] == [("deep & soul", 5, "m.html"), ("pop", 9, "p.html")] and g[0].example == 'Ann "Sea"' and g[0].color == "#aabbcc"
    nodes = X.genre_nodes(spark, str(tmp_path / "g.html"))
    assert [r.name for r in X.genre_neighbors(nodes, "pop").collect()] == ["deep & soul"] and [r.name for r in X.find_genres(nodes, " POP ").collect()] == ["pop"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1)], "k string, n int")
    size = sinks.write_document(str(tmp_path / "d.json"), {"rows": sinks.section(df, ["k"])})
    doc = json.loads((tmp_path / "d.json").read_text())
    assert doc == {"rows": [{"k": "a", "n": 1}, {"k": "b", "n": None}]} and size == (tmp_path / "d.json").stat().st_size
    assert sinks.inject("<s>@@</s>@@", '{"a":"</s>"}', "@@") == '<s>{"a":"<\\/s>"}</s>@@'
    with pytest.raises(ValueError):
        sinks.inject("x", "{}", "@@")
    import os

    for i in range(7):
        p = tmp_path / f"taste_2020010{i}T000000Z.json"
        p.write_text("{}")
        os.utime(p, (i, i))
    assert len(sinks.prune(str(tmp_path))) == 2 and X.newest(spark, str(tmp_path)).endswith("taste_20200106T000000Z.json") and X.newest(spark, str(tmp_path / "no")) is None
    ranked = spark.createDataFrame([("Ann", 3, 7_200_000)], "artist string, plays bigint, ms bigint")
    assert sinks.digest(ranked).first().line == "Ann (3 plays, 2.0 h)"


def test_export_rows_are_numbered_by_file_name(spark, tmp_path):
    row = lambda i, size: {"ts": f"t{i}", "ms_played": i, "master_metadata_track_name": "x" * size, "master_metadata_album_artist_name": "A", "spotify_track_uri": "u"}
    at = 0
    for name, n, size in (("2016_1", 3, 10), ("2015_0", 2, 50_000), ("2017_2", 4, 5), ("2018_3", 0, 0)):
        (tmp_path / f"Streaming_History_Audio_{name}.json").write_text(json.dumps([row(at + i, size) for i in range(n)]), encoding="utf-8")
        at += n
    got = [r.ms_played for r in X.listens(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [3, 4, 0, 1, 2, 5, 6, 7, 8]
    assert sorted(r.ord for r in X.listens(spark, str(tmp_path)).select("ord").collect()) == list(range(9))


def test_account_pulls(spark):
    track = lambda n: {"name": n, "id": n, "artists": [{"name": "A", "id": "a"}], "album": {"name": "B", "release_date": "2001-02-03"}, "extra": [1]}
    pages = spark.createDataFrame([("tracks", "short_term", json.dumps({"items": [track("x"), track("y")]})), ("artists", "long_term", json.dumps({"items": [{"name": "A", "genres": ["dub"]}]})), ("tracks", "long_term", "junk"), ("tracks", "medium_term", None)], "kind string, range string, json string")
    got = {(r.kind, r.range, r.pos): r for r in X.top_items(pages).collect()}
    assert set(got) == {("tracks", "short_term", 0), ("tracks", "short_term", 1), ("artists", "long_term", 0)}
    assert got["tracks", "short_term", 1].artists == ["A"] and got["artists", "long_term", 0].genres == ["dub"] and got["tracks", "short_term", 0].release_date == "2001-02-03"
    saved = spark.createDataFrame([(p, json.dumps({"items": [{"track": track(f"{p}{i}"), "added_at": "t"} for i in range(3)]})) for p in (1, 0)], "page int, json string")
    assert [(r.name, r.added_at) for r in X.library_items(saved, stamp="added_at", cap=4).orderBy("page", "pos").collect()] == [("00", "t"), ("01", "t"), ("02", "t"), ("10", "t")]
    answers = spark.createDataFrame([(json.dumps({"is_playing": True, "progress_ms": 5, "item": track("z")}),), ("{}",), (None,)], "json string")
    assert [(r.name, r.is_playing, r.progress_ms) for r in X.now_playing(answers).collect()] == [("z", True, 5)]


def test_proposal_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", "high", 3, "A"), ("b", "review", None, None), ("c", "high", 9, "C")], "title string, tier string, plays bigint, artist string")
    sinks.write_proposals(str(tmp_path / "p.json"), rows, now="2026-01-01T00:00:00Z", min_ratio=0.87)
    doc = json.loads((tmp_path / "p.json").read_text(encoding="utf-8"))
    assert doc["stats"] == {"songs": 3, "plays": 12, "by_tier": {"high": 2, "review": 1}, "plays_by_tier": {"high": 12, "review": 0}}
    assert [p["title"] for p in doc["proposals"]] == ["c", "a", "b"] and doc["proposals"][2]["artist"] is None


def test_same_acts_share_a_head(spark):
    acts = ["anna reed", "anna reed and bo", "anna reed and bo with cy", "anna", "anna and bo", "anna reed bo", "ox x", "ox x presents dub", "", "and anna reed and"]
    df = spark.createDataFrame([(a,) for a in acts], "k string")
    pairs = df.select(F.col("k").alias("a")).crossJoin(df.select(F.col("k").alias("b"))).where(N.same_act(F.col("a"), F.col("b")))
    missed = pairs.where(~F.arrays_overlap(N.act_heads(F.col("a")), N.act_heads(F.col("b"))))
    assert pairs.count() > len(acts) and missed.collect() == []
