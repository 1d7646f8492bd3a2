import random
from collections import defaultdict
from datetime import date, timedelta

from hearken.operators.features import label, rolling_totals, sparse_features, wide_features

DAY = 86_400_000_000
SCHEMA = "uri string, kind string, why string, us bigint, ms bigint, n int, total string"


def events(seed=1, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["u1", "u1", "u1", "u2", "u3", None]), rng.choice(["a", "b", None]), rng.choice(["x", ""]), rng.choice([rng.randrange(40) * DAY + 5, None]), rng.choice([10, -3, None]), 7, "clash") for _ in range(n)]


def expected(rows):
    out = defaultdict(lambda: [0, None, 0])
    for u, k, w, t, ms, *_ in rows:
        if u is not None:
            cell = out[u, k, w]
            cell[0] += 1
            cell[1] = t if cell[1] is None else cell[1] if t is None else max(cell[1], t)
            cell[2] += ms or 0
    return out


def test_sparse_equals_brute_force(spark):
    rows = events()
    got = sparse_features(spark.createDataFrame(rows, SCHEMA), entity="uri", type_cols=["kind", "why"], at="us", value="ms")
    want = expected(rows)
    cells = {(r.uri, f.kind, f.why): [f.n, f.last_us, f.total] for r in got.collect() for f in r.features}
    assert cells == {k: v for k, v in want.items()}
    assert {r.uri: r.n_events for r in got.collect()} == {u: sum(v[0] for k, v in want.items() if k[0] == u) for u in ("u1", "u2", "u3")}


def test_wide_equals_sparse_and_keeps_unlisted_types(spark):
    rows = events(2)
    df = spark.createDataFrame(rows, SCHEMA)
    types = [("a", "x"), (None, "")]
    got = {r.uri: r for r in wide_features(df, entity="uri", type_cols=["kind", "why"], at="us", value="ms", types=types, as_of_us=100 * DAY).collect()}
    want = expected(rows)
    for u in ("u1", "u2", "u3"):
        for t in types:
            n, last, total = want.get((u, *t), [0, None, 0])
            name = label(t)
            assert (got[u][f"n_{name}"], got[u][f"last_us_{name}"], got[u][f"total_{name}"]) == (n, last, total)
            assert got[u][f"age_us_{name}"] == (None if last is None else 100 * DAY - last)
        assert got[u].n_other == sum(v[0] for k, v in want.items() if k[0] == u and k[1:] not in types)


def test_wide_query_keeps_every_listen(spark, tmp_path):
    import __spark_entry__ as entry

    reasons = ["clickrow", None, "", "newreason", "newreason"]
    rows = [("u1", "2020-01-01T00:00:00Z", 10, "ios", r) for r in reasons] + [("", "2020-01-01T00:00:00Z", 1, "ios", ""), (None, None, 1, None, None)]
    spark.createDataFrame(rows, "spotify_track_uri string, ts string, ms_played bigint, platform string, reason_start string").write.parquet(f"{tmp_path}/streaming_history.parquet")
    (got,) = [r.asDict() for r in entry.queries()["p5_wide_all"](spark, str(tmp_path)).collect()]
    assert sum(v for k, v in got.items() if k.startswith("n_")) == 5 and sum(v for k, v in got.items() if k.startswith("total_")) == 50
    assert (got["n_other"], got["n_mobile_blank"], got["last_other"]) == (2, 1, "2020-01-01T00:00:00Z")


def test_any_number_of_types_and_empty_tables(spark):
    many = spark.range(60_000).selectExpr("'u' || (id % 3) uri", "cast(id as string) kind", "cast(null as string) why", "id us", "1L ms")
    got = sparse_features(many, entity="uri", type_cols=["kind", "why"], at="us", value="ms").selectExpr("uri", "size(features) n", "n_events").collect()
    assert {(r.uri, r.n, r.n_events) for r in got} == {(f"u{i}", 20_000, 20_000) for i in range(3)}
    none = spark.createDataFrame([], SCHEMA)
    assert sparse_features(none, entity="uri", type_cols=["kind", "why"], at="us", value="ms").count() == 0
    assert rolling_totals(none, entity="uri", at="us", value="ms").count() == 0


def test_explicit_list_puts_the_rest_last(spark):
    rows = [("u", "a", "x", 1, 1, 0, ""), ("u", "b", "x", 2, 1, 0, ""), ("u", "c", "x", 3, 1, 0, ""), ("u", None, None, 4, 1, 0, "")]
    (got,) = sparse_features(spark.createDataFrame(rows, SCHEMA), entity="uri", type_cols=["kind", "why"], at="us", value="ms", types=[("b", "x"), (None, None)]).collect()
    assert [(f.kind, f.n, f.last_us) for f in got.features] == [(None, 1, 4), ("b", 1, 2), (None, 2, 3)]


def test_rolling_equals_brute_force(spark):
    rows = events(3)
    got = rolling_totals(spark.createDataFrame(rows, SCHEMA), entity="uri", at="us", value="ms", periods=(3, 7))
    daily = defaultdict(lambda: defaultdict(int))
    for u, _, _, t, ms, *_ in rows:
        if t is not None:
            daily[u][t // DAY] += ms or 0
    want = set()
    for u, days in daily.items():
        for d in range(min(days), max(days) + 1):
            s3, s7 = (sum(days.get(d - i, 0) for i in range(p)) for p in (3, 7))
            want.add((u, date(1970, 1, 1) + timedelta(d), s3, s7, s3 / 3.0, s7 / 7.0))
    assert {(r.uri, r.day, r.total_3d, r.total_7d, r.avg_3d, r.avg_7d) for r in got.collect()} == want
