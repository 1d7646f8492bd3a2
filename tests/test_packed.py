from hearken.operators.packed import clean, expected, parse, spans, split_packed, viterbi

SCHEMA = "id int, text string, other string, pos int, item_value string"
LINES = [
    'Ann Lee & Bo - "Sea, Pt. 2"',
    "Ann Lee and Bo Marsh feat. Cy - Sea / Land - Live",
    '"Salt & Oak", Bo Marsh',
    'Bo Marsh\t"The ""Old"" Boat"',
    'The "Red, Blue" Boat',
    "Ann Tribute to Salt - Sea",
    "Ann Lee;  ; Bo Marsh",
    "Salt (feat. Bo)",
    "«Salt/Oak» vs. Cy ~ Sea",
    " - only title",
    "Ann-Lee",
]
WANT = [
    ["Ann Lee", "Bo", "Sea, Pt. 2"],
    ["Ann Lee", "Bo Marsh", "Cy", "Sea / Land - Live"],
    ["Salt & Oak", "Bo Marsh"],
    ["Bo Marsh", 'The "Old" Boat'],
    ['The "Red, Blue" Boat'],
    ["Ann Tribute to Salt", "Sea"],
    ["Ann Lee", "Bo Marsh"],
    ["Salt (feat. Bo)"],
    ["Salt/Oak", "Cy", "Sea"],
    ["only title"],
    ["Ann-Lee"],
]


def test_lines(spark):
    rows = [(i, t, "c", 9, "d") for i, t in enumerate(LINES)] + [(90, None, "", 0, ""), (91, "  ", "", 0, ""), (92, "", "", 0, ""), (93, LINES[0], "", 0, "")]
    got = split_packed(spark.createDataFrame(rows, SCHEMA), key="id", fields={"text": "text", "other": "second"})
    found = {}
    for r in got.collect():
        if r.field_name == "text":
            found.setdefault(r.id, {})[r.pos] = r.item_value
    lists = {k: [v[p] for p in range(1, len(v) + 1)] for k, v in found.items()}
    assert lists == {**dict(enumerate(WANT)), 93: WANT[0]}


def test_long_and_empty(spark):
    long = ", ".join(f"Act {i}" for i in range(3000)) + " - " + "x" * 50_000
    df = spark.createDataFrame([(1, long, None, 0, "")], SCHEMA)
    got = split_packed(df, key="id", fields={"text": "text"}).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 3002)) and got[0].item_value == "Act 0" and got[-1].item_value == "x" * 50_000
    assert split_packed(df.limit(0), key="id", fields={"text": "text"}).count() == 0


def test_hot_line_teaches_no_mark(spark):
    others = ["Ann Tribute to Salt - Sea", "Bo Marsh, Cy", "Bo Marsh & Ann Lee", "Cy / Ann Lee", "Bo Marsh", "Cy"]
    rows = [(i, t, "", 0, "") for i, t in enumerate(others + ["Bo Marsh to Cy"] * 2000)]
    got = split_packed(spark.createDataFrame(rows, SCHEMA), key="id", fields={"text": "text"})
    assert [r.item_value for r in got.where("id = 0").orderBy("pos").collect()] == ["Ann Tribute to Salt", "Sea"]


def test_long_values_need_no_cut():
    pieces, marks, _ = parse("All the way to the end of the Line, Bo")
    found = {(a, b): v for a, b, v in spans(pieces, marks, 4)}
    assert marks[-1] == "," and len(pieces) > 6
    assert found[0, len(pieces) - 1] == "All the way to the end of the Line" and (0, len(pieces)) in found


def test_parts():
    assert clean(' "a ""b"" c" ') == 'a "b" c' and clean('"a" b') == '"a" b' and clean('""') == ""
    assert parse('"a, b" - c - d') == (['"a, b" '], [], " c - d")
    edges = [(0, 1, -1.0), (1, 2, -1.0), (0, 2, -5.0)]
    assert viterbi(2, edges) == [(0, 1), (1, 2)]
    p = expected(2, edges)
    assert abs(p[0] - p[1]) < 1e-12 and abs(p[0] + p[2] - 1) < 1e-12
