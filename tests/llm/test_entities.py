import pytest

from hearken.llm.entities import RULES, Keys, confidence, confidences, match_records, near

RECORDS = [(1, "The Marble Gulls", "Slow Harbour No. 3", "x"), (2, "The Marble Gulls", "Night Timber: Walking Home", "x"), (3, "Anna & the Reeds", "A Stone and a River", "x"), (4, "Lone Kiln", "Lone Kiln", "x"), (5, "Jo Kar Ferrow", "Eleven Windmills", "x")]
HITS = [
    (1, "the marble gulls", "SLOW HARBOUR NO 3"),
    (1, "Marble Gulls, The", "Slow Harbour Number Three (Deluxe Edition)"),
    (1, "Marble Gulls feat. Bo Yar", "Slow Harbour No. 3 [2011 Remaster]"),
    (1, "The Marble Gulls", "The Marble Gulls - Slow Harbour No. 3 by The Marble Gulls"),
    (2, "The Marble Gulls", "Night Timber: Walk…"),
    (2, "The Marbel Gulls", "Nihgt Timbr: Walking Home"),
    (3, "Anna and the Reeds & Co Person", "A Stone & a River (Explicit) (Mono)"),
    (4, "LONE KILN", "Lone Kiln - 20th Anniversary Edition"),
    (5, "Jo Kar Ferrow", "Eleen Winmills"),
    (5, "Jo Kar Ferrow", "eleven windmills"),
    (5, "J.K. Ferrow", "Eleven Windmills (Mono)"),
]
MISSES = [
    ("The Marble Gulls", "Slow Harbour No. 4"),
    ("The Marble Gulls", "Slow Harbour No. 3 (Live in Oslo)"),
    ("The Marble Gulls", "Beyond Slow Harbour No. 3"),
    ("The Marble Gulls", "Night Timber: Walking Home II"),
    ("Anna & the Reeds", "A Stone and a River: The B-Sides"),
    ("Bo Tribute to The Marble Gulls", "Slow Harbour No. 3"),
    ("Lone Kilns", "Lone Kiln"),
    ("Some Other Act", "Slow Harbour No. 3"),
    (None, "Lone Kiln"),
    ("Lone Kiln", None),
    (" ", "Lone Kiln"),
    ("Lone Kiln", ""),
    ("Lone Kiln" * 5000, "Lone Kiln" * 5000),
]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, a, b, "clash") for i, (_, a, b) in enumerate(HITS)] + [(100 + i, a, b, "clash") for i, (a, b) in enumerate(MISSES)] + [(200, *HITS[0][1:], "clash")]
    return spark.createDataFrame(rows, "row_no int, act string, record string, confidence string"), spark.createDataFrame(RECORDS, "no int, act string, record string, row_no string")


def match(rows, records, **more):
    return match_records(rows, records, key="row_no", act="act", album="record", record_key="no", record_act="act", record_album="record", **more)


def test_cases(frames):
    got = match(*frames).collect()
    assert sorted((r.row_no, r.no) for r in got) == sorted([(i, no) for i, (no, _, _) in enumerate(HITS)] + [(200, 1)])
    assert {r.rule for r in got if r.row_no == 0} == {"same names"} and all(0.5 < r.confidence < 1 for r in got)


def test_empty_tables_and_bounds(frames):
    rows, records = frames
    assert match(rows.limit(0), records).count() == 0 and match(rows, records.limit(0)).count() == 0
    in_blocks = {(r.row_no, r.no) for r in match(rows, records, max_records=2).collect()}
    assert in_blocks == {(r.row_no, r.no) for r in match(rows, records).collect()}


def test_labels_decide(frames, spark):
    rows, records = frames
    labels = spark.createDataFrame([("The Marble Gulls", "Slow Harbour No. 3", 1), ("the marble gulls", "slow harbour no 3", 1), ("The Marbel Gulls", "Nihgt Timbr: Walking Home", None), ("Lone Kiln", "Lone Kiln Deluxe", 4), ("Ox", "B", None)], "act string, record string, no int")
    got = {r.rule: r.confidence for r in match(rows, records, labels=labels).collect()}
    assert got["same names"] == 0.75 and got["slips in both"] < 0.5
    order = [n for n, _, _ in RULES if n in got]
    assert all(got[a] >= got[b] for a, b in zip(order, order[1:], strict=False))


def test_parts():
    assert confidence(0, 0) == 0.5 and confidence(8, 0) == 0.9
    names = [n for n, _, _ in RULES]
    pooled = confidences({names[0]: (2, 0), names[1]: (20, 0), names[2]: (3, 3)})
    assert pooled[names[0]] == pooled[names[1]] > pooled[names[2]] >= pooled[names[3]] and list(pooled) == names
    assert near("na", "no") and near("eleen", "11") and not near("five", "9") and near("timbr", "timber") and not near("kilns", "kiln") and not near("no4", "no3")
    assert Keys([(1, "The Ox", "B")]).act("ox, the")[1] == "theox"
