import random

from hearken.llm.listmatch import likeness, map_to_list, token_signs, typos, unit_signs

ENTRIES = [(1, "free jazz"), (2, "rocksteady"), (3, "dub"), (4, "1980s"), (5, "piano ballads"), (6, "railroad songs"), (7, "americana"), (8, "samba")]
FILL = ["best {}", "modern {}", "{} songs", "{} music", "i love {}", "{}!", "#{}", "{} forever", "genre: {}", "pure {}"]


def tags():
    rng = random.Random(4)
    out = []
    for no, e in ENTRIES:
        out += [(e, None)] * 30 + [(f.format(e), no) for f in FILL]
    out += [("freejazz", 1), ("jazz free", 1), ("fre jazz", 1), ("rokcsteady", 2), ("r0cksteady", 2), ("rcksteady", 2), ("80s", 4), ("Eighties", 4), ("pno bllds", 5), ("piano ballad", 5)]
    out += [(t, -1) for t in ["dub step kitchen", "sad piano lesson", "music", "songs", "gardening", "???"]] + [("americans", -1)] * 20 + [("sambal", -1)] * 20
    rng.shuffle(out)
    return out


def test_cases(spark):
    rows = [(i, t, w, "clash") for i, (t, w) in enumerate(tags())]
    extra = [(900, None, None, ""), (901, "  ", None, ""), (902, "", None, ""), (903, "rock " * 20_000, -1, ""), (904, " ".join(f"w{i}" for i in range(130_000)), -1, ""), (905, "x" * 1_000_000, -1, "")]
    df = spark.createDataFrame([r[:2] + r[3:] for r in rows + extra], "feed int, tag string, score string")
    listed = spark.createDataFrame(ENTRIES, "no bigint, name string")
    got = {r.feed: r.no for r in map_to_list(df, listed, key="feed", value="tag", entry_key="no", entry="name").collect()}
    want = {i: w for i, t, w, _ in rows if w is not None} | {903: -1, 904: -1, 905: -1}
    assert {i: (t, got.get(i), w) for i, t, w, _ in rows if w is not None and got.get(i) != w} == {}
    assert set(got) == set(want)


def test_empty(spark):
    df = spark.createDataFrame([(1, "dub")], "feed int, tag string")
    listed = spark.createDataFrame(ENTRIES, "no bigint, name string")
    run = lambda a, b: map_to_list(a, b, key="feed", value="tag", entry_key="no", entry="name").collect()
    assert run(df.limit(0), listed) == [] and run(df, listed) == []
    assert [(r.feed, r.no) for r in run(df, listed.limit(0))] == [(1, -1)]


def test_signs_lose_no_slip():
    rng = random.Random(5)
    for _ in range(400):
        unit = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 5, 8, 27, 29, 31, 33, 60])))
        token = list(unit)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(token) - 1)
            what = rng.choice("idrs")
            token[i : i + 2] = {"i": [token[i], "z", token[i + 1]], "d": token[i + 1 : i + 2], "r": ["z", token[i + 1]], "s": token[i : i + 2][::-1]}[what]
        token = "".join(token)
        if typos(token, unit, 2) <= 2:
            assert set(token_signs(token)) & set(unit_signs(unit, False))
    assert likeness("pno", "piano", True)[0] >= 0.85 and likeness("balla", "ballads", True) == (0.0, 1 - 2 / 14) and likeness("xyz", "piano", True) == (0.0, 0.0)


def test_every_list_size(spark):
    rng = random.Random(9)
    entries = [(i, " ".join("".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(4, 9))) for _ in range(3)) + " songs") for i in range(1500)]
    typed = [(i, e.upper() if i % 3 else e.replace(" ", "-", 1)) for i, e in entries]
    got = map_to_list(spark.createDataFrame(typed, "feed int, tag string"), spark.createDataFrame(entries, "no int, name string"), key="feed", value="tag", entry_key="no", entry="name").collect()
    assert len(got) == 1500 and all(r.feed == r.no and r.score > 0.99 for r in got)


def test_typos():
    assert typos("abc", "acb", 2) == 1 and typos("abc", "abc", 2) == 0 and typos("abc", "xyz", 2) == 3 and typos("kitten", "sitting", 3) == 3
