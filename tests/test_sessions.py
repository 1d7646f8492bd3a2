import random

from pyspark.sql import functions as F

from hearken.functions.instants import instant_us, utc_iso
from hearken.operators.sessions import chunked_sessions

SCHEMA = "who string, us bigint, album string, why string, e int, c int"


def brute(rows, gap, least, album=True):
    out = []
    for who in {r[0] for r in rows}:
        mine = sorted({r[:4] for r in rows if r[0] == who and r[1] is not None}, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        runs = []
        for r in mine:
            last = runs[-1][-1] if runs else None
            if last and r[1] - last[1] < gap and (not album or (r[2] is not None and r[2] == last[2] and r[3] == "trackdone")):
                runs[-1].append(r)
            else:
                runs.append([r])
        out += [(who, x[0][1], x[-1][1], len(x)) for x in runs if len(x) >= least]
    return sorted(out, key=str)


def rows_at_random(seed, n=400):
    rng = random.Random(seed)
    rows, t = [], 0
    for _ in range(n):
        t += rng.choice([0, 1, 5, 9, 10, 40])
        rows.append((rng.choice(["a", "b", None]), rng.choice([t, t, t, t, None]), rng.choice(["X", "X", "X", "Y", None]), rng.choice(["trackdone", "trackdone", "trackdone", "click", None]), 1, 2))
    return rows + rows[: n // 10]


def test_equals_brute_force_whatever_the_chunk(spark):
    for seed in range(3):
        rows = rows_at_random(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        for chunk in (7, 50, 10**9):
            got = chunked_sessions(df, entity="who", at="us", same="album", reason="why", continues="trackdone", gap_us=10, min_events=3, chunk_us=chunk)
            assert sorted(((r.who, r.start_us, r.end_us, r.n_events) for r in got.collect()), key=str) == brute(rows, 10, 3)


def test_plain_inactivity_sessions(spark):
    rows = rows_at_random(9)
    df = spark.createDataFrame(rows, SCHEMA).select("who", "us").distinct()
    got = chunked_sessions(df, entity="who", at="us", gap_us=10, min_events=1, chunk_us=25)
    plain = [(r[0], r[1], None, None) for r in rows]
    assert sorted(((r.who, r.start_us, r.end_us, r.n_events) for r in got.collect()), key=str) == brute(plain, 10, 1, album=False)


def test_gap_is_strict_and_empty_is_empty(spark):
    df = spark.createDataFrame([("a", 0, "X", "click", 0, 0), ("a", 599, "X", "trackdone", 0, 0), ("a", 1199, "X", "trackdone", 0, 0)], SCHEMA)
    got = chunked_sessions(df, entity="who", at="us", same="album", reason="why", continues="trackdone", gap_us=600, min_events=2)
    assert [(r.start_us, r.end_us, r.duration_us, r.n_events) for r in got.collect()] == [(0, 599, 599, 2)]
    assert chunked_sessions(df.limit(0), entity="who", at="us", same="album", gap_us=600).count() == 0


def test_instants(spark):
    texts = ["2020-01-01T00:00:00Z", "2020-01-01T01:00:00+01:00", "2020-01-01T00:00:00.500Z", "2020-01-01T00:00:00", "junk", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(instant_us(F.col("t")).alias("us"))
    base = 1577836800000000
    assert [r.us for r in df.collect()] == [base, base, base + 500000, base, None, None, None]
    assert df.select(utc_iso(F.col("us")).alias("x")).first().x == "2020-01-01T00:00:00Z"
