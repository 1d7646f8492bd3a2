import itertools
import math
import random

import numpy as np

from hearken.llm import abuse
from hearken.llm.abuse import EVERYDAY, POSITIVE, UNIT, VOTERS, Reader, Speller, as_token, best_threshold, fit_labels, score_texts, units, votes

BAD = ["You are too stupid to breathe.", "Shut your filthy mouth, moron.", "Those people breed like rats, wipe them out.", "He lay naked between her thighs, ready to fuck.", "I will come and break your face, loser.", "Get lost, you pathetic clown."]
GOOD = ["They murdered that cover, and I mean it as the highest praise.", "Dirty bass, filthy groove, I would die for that breakdown.", "What a stupid mistake I made with my playlist.", "The song is called Idiot Parade.", "The lyric quotes an old threat, I will break your heart."]
PLAIN = ["The drummer counts in at {} and the album begins.", "I heard side {} in a shop.", "Where did that tape of {} go?", "The chorus arrives after {} minutes."]


def corpus():
    rng = random.Random(6)
    docs = []
    for i in range(240):
        text = [rng.choice(PLAIN).format(rng.randint(1, 99)) for _ in range(4)]
        kind = rng.random()
        if kind < 0.2:
            text.insert(rng.randint(0, 4), rng.choice(BAD))
        elif kind < 0.5:
            text.insert(rng.randint(0, 4), rng.choice(GOOD))
        docs.append((i, " ".join(text), int(kind < 0.2), "clash"))
    return docs


def test_held_out_accuracy(spark):
    docs = corpus()
    extra = [(900, None, 0, ""), (901, "", 0, ""), (902, " ​ ", 0, ""), (903, "la" * 30_000, 0, ""), (904, "YoU ArE ToO St*pid​ to bre4the!!!", 1, ""), (905, "shut your f i l t h y mouth, m0rooon", 1, "")]
    df = spark.createDataFrame([d[:2] + d[3:] for d in docs + extra], "doc int, body string, score string")
    scores = score_texts(df, key="doc", text="body")
    got = {r.doc: r.score for r in scores.collect()}
    assert len(got) == len(docs) + len(extra) and got[900] == got[901] == got[902] == 0.0
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs[::6]], "doc int, toxic int")
    cut = best_threshold(scores, labels, key="doc", label="toxic")
    wrong = [d for d in docs + extra if (got[d[0]] >= cut) != bool(d[2])]
    assert len(wrong) <= 3, wrong
    assert score_texts(df.limit(0), key="doc", text="body").count() == 0


def unit(text):
    return [as_token(w) for w in text.split()]


def test_repeated_keys_and_labels(spark):
    rows = [(1, "The drummer counts in."), (1, "You are a pathetic moron."), (1, None), (2, "Fine album.")] + [(10 + i, "You filthy idiot, shut up.") for i in range(20)]
    df = spark.createDataFrame(rows, "doc int, body string")
    labels = spark.createDataFrame([(2, 0), (10, 1), (11, 1), (11, None), (99, 1)], "doc int, said int")
    got = [r.score for r in score_texts(df, key="doc", text="body", labels=labels, label="said").where("doc = 1").collect()]
    assert len(got) == 3 and min(got) == 0.0 and max(got) > 0.5


def test_parts():
    spell = Speller()
    assert [spell(t)[0][0] for t in ("m0ron", "idi0t", "p*g", "fuuuck", "dumbas", "that", "month")] == ["moron", "idiot", "pig", "fuck", "dumbass", "that", "month"]
    assert [[w for w, _, _ in u] for u in units("One. Two!\nThree", spell)] == [["one"], ["two"], ["three"]] and "that" in EVERYDAY
    assert votes(unit("the record is fine")) & POSITIVE == 0


def test_accuracies_decide():
    insult, mention, cast = votes(unit("you are a moron")), votes(unit("the novel deals with harbours")), votes(unit("those thieves belong elsewhere"))
    model = fit_labels({(0, None): 9000, (insult, None): 60, (mention, None): 900})
    assert model.posterior(insult) > 0.5 and model.posterior(0) < 0.05 and model.posterior(insult | mention) < model.posterior(insult)
    # a voter that raters nearly always find wrong loses its say, even where it's the only one to vote
    poor = fit_labels({(0, None): 9000, (insult, None): 60, (cast, 0): 300, (cast, None): 300})
    assert poor.posterior(cast) < 0.5 < poor.posterior(insult)


def test_many_texts_at_once(monkeypatch):
    texts = [None, "", *BAD, "word " * 60 + "you idiot", *GOOD, "n o b o d y wants you. T-h-o-s-e rats!!", "x-stupid idiot's \x01 you", "Été ﬁlthy; YÓU!No.Stop\n\nß ß ß"] * 2
    asked = []
    monkeypatch.setattr(abuse, "VOTERS", [(name, side, lambda t, w, name=name, when=when: asked.append(name) or when(t, w)) for name, side, when in VOTERS])
    read = Reader(Speller()).read(texts)
    each = [units(t, Speller()) for t in texts]
    flat = [u for us in each for u in us]
    assert read.counts.tolist() == [len(us) for us in each] and read.lens.tolist() == [len(u) for u in flat] and max(read.lens) == UNIT
    assert read.hashes.tolist() == [code for u in flat for _, code, _ in u]
    for u, mark in zip(flat, read.marks.tolist(), strict=True):
        words = [w for w, _, _ in u]
        assert mark == sum(1 << v for v, (_, _, when) in enumerate(VOTERS) if when(" ".join(words), words)), words
    # voters that go by the order of words are asked only where a unit has what they need
    asked.clear()
    assert Reader(Speller()).read(PLAIN + GOOD[3:4]).marks.any() and set(asked) <= {"about oneself"}


def test_all_sentences_are_fitted_on(spark, monkeypatch):
    seen = {}

    def fit(over_all, prior):
        loss, slope, _ = over_all(np.zeros(abuse.PLACES), True)
        seen.update(loss=loss, slope=slope)
        return plain(over_all, prior, passes=2)

    plain = abuse.fit_linear
    monkeypatch.setattr(abuse, "fit_linear", fit)
    df = spark.range(15_000).selectExpr("id", "concat('You pathetic moron. Fine album. I heard side ', id, ' twice.') AS body").repartition(3)
    scores = {r.id: r.score for r in score_texts(df, key="id", text="body").collect()}
    # without weights every sentence loses the same
    assert abs(seen["loss"] - 45_000 * math.log(2)) < 0.1 and len(scores) == 15_000
    slope = seen["slope"]
    again = {r.id: r.score for r in score_texts(df.repartition(5, "body"), key="id", text="body").collect()}
    assert (seen["slope"] == slope).all() and again == scores


def test_threshold_counts_all_labels(spark):
    many = spark.range(260_000).selectExpr("id", "CASE WHEN id >= 200000 THEN 0.3D WHEN id % 2 = 0 THEN 0.9D ELSE 0.1D END AS score", "CAST(id >= 200000 OR id % 2 = 0 AS INT) AS y")
    assert abs(best_threshold(many.select("id", "score"), many.select("id", "y"), key="id", label="y") - 0.2) < 1e-9
    rng = random.Random(3)
    for size, span in ((1, 1), (40, 9), (300, 1000)):
        rows = [(i, rng.randint(0, span) / span, rng.randint(0, 1)) for i in range(size)]
        df = spark.createDataFrame([*rows, (size, 0.5, None)], "id int, score double, y int")
        assert best_threshold(df.select("id", "score"), df.select("id", "y"), key="id", label="y") == plain_threshold([r[1:] for r in rows])


def plain_threshold(pairs):
    right = sum(y for _, y in pairs)
    grid = sorted({0.0, 1.0, *(s for s, _ in pairs)})
    best = []
    for low, high in itertools.pairwise(grid):
        found = [y for s, y in pairs if s >= (low + high) / 2]
        best.append((round(2 * sum(found) / (len(found) + right), 9) if right else 0.0, high - low, (low + high) / 2))
    return max(best)[2] if right else 0.5
