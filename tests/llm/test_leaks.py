import random

import numpy as np

from hearken.llm.leaks import Q, code, grams, held_items, leaked, letters, wanted

rng = random.Random(8)
WORDS = ["".join(rng.choice("abdegiklmnoprstuv") for _ in range(rng.randint(3, 9))) for _ in range(900)]


def passage(n):
    return [rng.choice(WORDS) for _ in range(n)]


ITEMS = [passage(rng.choice([14, 25, 45, 80])) for _ in range(30)]
NOTE = "Read this and answer the question."


def test_planted_passages(spark):
    docs, want = [], set()
    for i, item in enumerate(ITEMS):
        whole = len(item) < 20
        part = item if whole else item[(s := rng.randint(0, len(item) - 22)) : s + 22]
        hit = [w.upper() if rng.random() < 0.3 else w for w in part]
        if not whole:
            for k in (6, 13):
                hit[k] = "changed"
        docs.append((i, " ".join(passage(60)) + "\n<b>" + ",\n ".join(hit) + "</b> &amp; " + " ".join(passage(60)), "clash"))
        want.add((i, i))
        docs.append((100 + i, " ".join(passage(60) + item[:7] + passage(50)), "clash"))
        docs.append((200 + i, " ".join(passage(80)) + NOTE, "clash"))
    docs += [(900, None, ""), (901, "", ""), (902, "   ", ""), (903, "a" * 30_000, ""), (904, docs[0][1], "")]
    want.add((904, 0))
    df = spark.createDataFrame(docs, "doc int, body string, item string")
    items = spark.createDataFrame([(i, f"{NOTE} {' '.join(t)}.", 1) for i, t in enumerate(ITEMS)] + [(90, None, 1), (91, "", 1), (92, NOTE, 1)], "item int, words string, doc int")
    run = lambda d, t, **more: {(r.doc, r.item) for r in leaked(d, t, key="doc", text="body", item_key="item", item_text="words", **more).collect()}
    assert run(df, items) == want
    assert run(df, items, block_letters=2000) == want
    assert run(df.limit(0), items) == set() and run(df, items.limit(0)) == set()


def test_copies_and_common_wording(spark):
    copied, base = passage(40), passage(60)
    alike = [base[:i] + passage(2) + base[i + 2 :] for i in range(0, 60, 6)]
    rows = [(i, " ".join(copied), 1) for i in range(5)] + [(10 + i, " ".join(t), 1) for i, t in enumerate(alike)]
    docs = [(1, " ".join(passage(50) + copied + passage(50)), ""), (2, " ".join(passage(50) + base[20:52] + passage(50)), "")]
    got = leaked(spark.createDataFrame(docs, "doc int, body string, item string"), spark.createDataFrame(rows, "item int, words string, doc int"), key="doc", text="body", item_key="item", item_text="words")
    found = {(r.doc, r.item) for r in got.collect()}
    assert {i for d, i in found if d == 1} == set(range(5)) and {i for d, i in found if d == 2} == set(range(10, 20))


def test_short_items(spark):
    items = [(1, "Who sang Blue Tin Harbour?"), (2, "green tea"), (3, "no"), (4, "Seven brass kettles"), (5, "Seven brass kettles"), (6, "seven brass kettles!"), (7, "seven br ass kettles")]
    docs = [(1, "He asked: who sang “Blue Tin Harbour”? Nobody knew.", ""), (2, "evergreen teas", ""), (3, "a GREEN-tea, no more", ""), (4, "nothing", ""), (5, "there were seven brass kettles here", ""), (6, "seven brassy kettles", "")]
    got = leaked(spark.createDataFrame(docs, "doc int, body string, item string"), spark.createDataFrame(items, "item int, words string"), key="doc", text="body", item_key="item", item_text="words")
    found = {(r.doc, r.item) for r in got.collect()}
    assert {(1, 1), (3, 2), (3, 3), (5, 4), (5, 5), (5, 6)} <= found
    assert not {(2, 2), (4, 3)} & found and {i for d, i in found if d == 4 or d == 2} == set()


def test_parts(spark):
    assert letters("A-b <i>&eacute;​C</i> 1")[0] == "abéc1"
    rows = [(1, "Same. One x."), (2, "Same. Two y."), (3, "Same. Three z."), (4, "All alike. Same."), (5, "All alike. Same."), (6, "All alike. Same.")]
    held = held_items(spark.createDataFrame(rows, "i int, t string"), item_key="i", item_text="t", shared=3, min_words=20)
    assert {tuple(sorted(r.ids)): r.flat for r in held.collect()} == {(1,): "onex", (2,): "twoy", (3,): "threez", (4, 5, 6): "allalike"}
    codes = code("".join(rng.choice("abc") for _ in range(300)))
    for n in range(1, 20):
        g = grams(codes, n)
        assert len(g) == 301 - n and len(set(g.tolist())) == len({codes[i : i + n].tobytes() for i in range(len(g))})
    word = np.repeat(np.arange(25), 5)
    assert wanted(word, 20) == (100, 100 - Q + 1 - 5 * 12) and wanted(word[:15], 20) == (15, 0)
