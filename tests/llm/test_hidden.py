import itertools
import random
import unicodedata

from hearken.llm.hidden import collapsed, copy_classes, copy_pairs, fingerprints, same_letters, same_words, verified

SCHEMA = "row_no bigint, act string, ts string, n int, received string, class_id string"


def variants(name, rng):
    w = name.split()
    return rng.choice([name, name.upper(), f"  {name} ", f'"{name}"', " ".join(w[1:] + w[:1]), ", ".join([" ".join(w[1:]), w[0]]), unicodedata.normalize("NFD", name), name.replace(" ", "​ "), name.replace(" ", "_"), " ".join(w)])


def fold(name):
    return "".join(sorted(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", name).casefold()) if c.isalnum()))


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    names = ["Märble Gulls", "Anna O'Neil Trio", "The Old Kiln 2", "The Old Kiln", "Lone Kiln", "Strauß & Söhne"]
    rows = []
    for i in range(300):
        base = rng.choice(names)
        rows.append((i, variants(base, rng), rng.choice(["t1", "t2", "t3"]), rng.choice([1, None]), str(i), "clash"))
    rows += [(1000, None, "t1", 1, "", "clash"), (1001, "Lone Kiln", None, 1, "", "clash"), (1002, "Lone Kiln", None, 1, "", "clash"), (1003, "x" * 60_000, "t1", 1, "", "clash"), (1004, "X" * 60_000, "t1", 1, "", "clash"), (1005, "!!!", "t9", 1, "", "clash"), (1006, "???", "t9", 1, "", "clash"), (1007, "", "t9", 1, "", "clash")]
    df = spark.createDataFrame(rows, SCHEMA)
    classes = copy_classes(df, key="row_no", name="act", ignore=["received"], required=["ts"])
    got = {tuple(r) for r in copy_pairs(classes, key="row_no").collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if a[1] is not None and b[1] is not None and a[2] is not None and a[2:4] == b[2:4] and fold(a[1]) == fold(b[1])}
    assert got == want
    by_joins = copy_classes(df, key="row_no", name="act", ignore=["received"], required=["ts"], gather=1)
    assert {tuple(r) for r in by_joins.collect()} == {tuple(r) for r in classes.collect()}
    once = {r.row_no: r.n_copies for r in collapsed(df, classes, key="row_no").collect()}
    assert sum(once.values()) == len(rows) and once[1000] == once[1001] == once[1002] == 1 and once[1003] == 2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert copy_classes(df, key="row_no", name="act").count() == 0


def test_parts():
    f = fingerprints(["The Ox", "ox, the", "THEOX", "", "Oxen The"])
    assert f[0, 1] == f[1, 1] and f[0, 0] != f[1, 0] and f[0, 0] == f[2, 0] and f[3, 0] == 0 and f[4, 1] != f[0, 1]
    assert same_letters("A b-C", "a B c") and not same_letters("abc", "abd") and not same_letters("ab", "abc")
    assert same_words("The Ox!", "ox the", True) and not same_words("a b b", "a a b", True)


def test_false_hashes_are_parted():
    got = verified(["Lone Kiln", "LONE KILN", "Ox Gulls", "gulls, ox", "ox gulls"], ["Lone Kiln"] * 5, [7] * 5, "f")
    assert got[:2] == [7, 7] and got[2] != 7 and len(set(got[2:])) == 1
    assert len({*verified(["Ox Gulls", "gulls, ox"], ["Lone Kiln"] * 2, [7] * 2, "s")}) == 2


def test_chains_of_hashes(spark):
    # the first and the last share no hash with each other: joined by letters, then by words
    names = ["The OldKiln", "The Old Kiln", "old kiln the", "oldkiln the"]
    df = spark.createDataFrame([(i, n, "t", 1, "", "") for i, n in enumerate(names)] + [(9, "Old Kilns The", "t", 1, "", "")], SCHEMA)
    got = {r.row_no: r.class_id for r in copy_classes(df, key="row_no", name="act", ignore=["received"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0}
