"""Matching records without keys: a deterministic cascade of exact joins on ever weaker attribute combinations."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.listmatch import typos
from hearken.session import cut

#: Words that name an edition of the same record, and words before a guest.
EDITION = frozenset(
    "anniversary bonus clean collector collectors deluxe edition expanded explicit japan japanese legacy limited mono original reissue reissued remaster remastered remasters special standard stereo super track tracks version".split()
)
GUEST = frozenset("feat ft featuring with and x vs".split())
#: Figures written as words, and the other way to write "no".
FIGURES = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"number": "no", "nr": "no"}
_SPELT: dict[str, list[str]] = {}
for _w, _n in FIGURES.items():
    _SPELT.setdefault(_n, []).append(_w)
_WORD = re.compile(r"[^\W_]+")
_YEAR = re.compile(r"(19|20)\d\d|\d{1,3}(st|nd|rd|th)")
_GUEST_MARK = re.compile(r"\s*[&+,;/]\s*")
_CUT = re.compile(r"(\.{2,}|…)")

#: Rules from the strongest: (name, act key, record key).
RULES = (
    ("same names", "act_same", "album_same"),
    ("edition set aside", "act_same", "album_core"),
    ("words of the act in another order", "act_words", "album_core"),
    ("guests of the act set aside", "act_lead", "album_core"),
    ("slips in the record", "act_lead", "album_fixed"),
    ("record cut short", "act_lead", "album_cut"),
    ("first names as initials", "act_initials", "album_core"),
    ("slips in the act", "act_fixed", "album_core"),
    ("slips in both", "act_fixed", "album_fixed"),
    ("slips in the act, record cut short", "act_fixed", "album_cut"),
)

#: Labelled outcomes of each rule, (right, wrong): distinct pairs of names drawn at random and judged by hand. Used where no labels are given.
LABELLED = dict(zip((name for name, _, _ in RULES), ((12, 0), (14, 0), (14, 0), (14, 0), (26, 0), (26, 0), (20, 0), (26, 0), (26, 0), (7, 0)), strict=True))


def confidence(right: float, wrong: float, *, prior: float = 0.5, weight: float = 2.0) -> float:
    """Smoothed precision: labels and ``weight`` pseudo-labels at ``prior``."""
    return (right + prior * weight) / (right + wrong + weight)


def confidences(labelled: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Confidence of each rule, never rising as rules weaken.

    Neighbours whose precisions would rise are pooled, as in isotonic regression, so that few labels of a strong rule don't put it
    below a weaker one with more. A rule's smoothed precision counts before pooling; pooled ones are smoothed once.
    """
    pools: list[tuple[list[str], int, int]] = []
    for name, _, _ in RULES:
        names, right, wrong = [name], *labelled.get(name, (0, 0))
        while pools and confidence(*pools[-1][1:]) < confidence(right, wrong):
            before, r, w = pools.pop()
            names, right, wrong = before + names, right + r, wrong + w
        pools.append((names, right, wrong))
    return {name: confidence(right, wrong) for names, right, wrong in pools for name in names}


def words(text: str) -> list[str]:
    """Words in one case, without accents and invisible marks; an apostrophe joins."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    plain = "".join(c for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return [FIGURES.get(w, w) for w in _WORD.findall(re.sub(r"['’ʼ‘`]", "", plain))]


def plain(text: str) -> list[str]:
    """Words without the joining one, which may be written as a sign."""
    ws = words(text)
    return [w for w in ws if w != "and"] or ws


def title(text: str) -> list[str]:
    """Words of a record's name, without the joining word and a leading article."""
    ws = plain(text)
    return ws[1:] if len(ws) > 1 and ws[0] == "the" else ws


def act_key(text: str) -> str:
    return "".join(plain(text))


def album_key(text: str) -> str:
    return "".join(title(text))


def order_free(ws: Sequence[str]) -> str:
    """Key of words in any order, without articles at either end."""
    ws = list(ws)
    while len(ws) > 1 and "the" in (ws[0], ws[-1]):
        ws = ws[1:] if ws[0] == "the" else ws[:-1]
    return " ".join(sorted(ws))


def near(word: str, other: str) -> bool:
    """Whether one is the other with a slip: two edits, one in words under five letters, none in single letters; figures don't slip, and an s at the end isn't one."""
    if word == other:
        return True
    if word.isalpha() and any(len(spelt) > 3 and typos(word, spelt, 1) <= 1 for spelt in _SPELT.get(other, ())):
        return True
    if any(c.isdigit() for c in other) or len(other) < 2 or word == other + "s":
        return False
    most = 1 if len(other) < 5 else 2
    return typos(word, other, most) <= most


def near_all(left: Sequence[str], right: Sequence[str]) -> bool:
    return len(left) == len(right) and all(near(a, b) for a, b in zip(left, right, strict=True))


def is_edition(word: str) -> bool:
    return word in EDITION or bool(_YEAR.fullmatch(word)) or (len(word) > 5 and any(near(word, e) for e in EDITION if len(e) > 4 and abs(len(e) - len(word)) <= 2))


class Keys:
    """Keys of a pair of names, as the list of records would write them."""

    def __init__(self, records: Sequence[tuple[object, str, str]]) -> None:
        self.acts: dict[str, tuple[str, list[str]]] = {}
        self.by_words: dict[str, list[str]] = defaultdict(list)
        self.albums: dict[str, list[tuple[str, list[str], list[str]]]] = defaultdict(list)
        for _, act, album in records:
            a = act_key(act)
            if a not in self.acts:
                self.acts[a] = (act, plain(act))
                self.by_words[order_free(plain(act))].append(a)
            self.albums[a].append((album_key(album), title(album), words(album)))
        self.by_hint: dict[str, set[str]] = defaultdict(set)
        for a, (_, ws) in self.acts.items():
            for w in ws:
                for d in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
                    self.by_hint[d].add(a)
        self.by_initials: dict[tuple[str, ...], list[str]] = defaultdict(list)
        for a, (_, ws) in self.acts.items():
            if len(ws) > 1:
                self.by_initials[*(w[0] for w in ws[:-1]), ws[-1]].append(a)
        self.memo: dict[str, tuple] = {}

    def act(self, name: str) -> tuple[str, str | None, str | None, str | None, str | None]:
        """Same letters, same words in any order, leading act before its guests, repaired act, act whose first names are written as initials."""
        if name not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[name] = self._act(name)
        return self.memo[name]

    def _act(self, name: str) -> tuple[str, str | None, str | None, str | None, str | None]:
        ws = plain(name)
        same = "".join(ws)
        by_words = self._listed(ws)
        lead = by_words
        leads = self._leads(name, words(name))
        for part in leads:
            lead = lead or self._listed(part)
        fixed = lead
        for part in [ws, *leads]:
            fixed = fixed or self._repaired(part)
        initials = self.by_initials.get(tuple(ws), ()) if len(ws) > 1 and all(len(w) == 1 for w in ws[:-1]) else ()
        return same, by_words, lead, fixed, fixed or (initials[0] if len(initials) == 1 else None)

    def _listed(self, ws: Sequence[str]) -> str | None:
        same = "".join(ws)
        if same in self.acts:
            return same
        if ws and ws[0] == "the" and same[3:] in self.acts:
            return same[3:]
        found = self.by_words.get(order_free(ws), ()) if ws else ()
        return found[0] if len(found) == 1 else None

    @staticmethod
    def _leads(name: str, ws: Sequence[str]) -> list[list[str]]:
        out = []
        for i, w in enumerate(ws):
            if i and w in GUEST:
                out.append([x for x in ws[:i] if x != "and"])
        for m in _GUEST_MARK.finditer(name):
            if m.start():
                out.append(plain(name[: m.start()]))
        return [x for x in sorted(out, key=len, reverse=True) if x]

    def _repaired(self, ws: Sequence[str]) -> str | None:
        trim = lambda x: [w for i, w in enumerate(x) if not (w == "the" and i in (0, len(x) - 1))] or list(x)
        bare = trim(ws)
        hints = {a for w in bare for d in {w} | {w[:i] + w[i + 1 :] for i in range(len(w) if len(w) < 40 else 0)} for a in self.by_hint.get(d, ())}
        good = sorted(a for a in hints if near_all(bare, trim(self.acts[a][1])) or (len(bare) > 1 and near_all(sorted(bare), sorted(trim(self.acts[a][1])))))
        return good[0] if len(good) == 1 else None

    def album(self, act: str | None, name: str, act_name: str) -> tuple[str, str, str | None, str | None]:
        """Same letters, without edition and act, repaired, completed; the last two among the records of ``act``."""
        ws = title(name)
        same = "".join(ws)
        known = self.albums.get(act, ()) if act else ()
        forms = [ws, words(name)]
        names = [x for x in (self.acts[act][1] if act else None, plain(act_name)) if x]
        for base in names * 2:
            for own in (base, base[1:] if base[0] == "the" else ["the", *base]):
                for f in list(forms):
                    if f[: len(own)] == own and len(f) > len(own) and len(forms) < 50:
                        rest = f[len(own) :]
                        forms.append(rest[1:] if len(rest) > 1 and rest[0] == "the" else rest)
        bare: list[list[str]] = []
        for f in forms:
            for g in self._without_tail(f, names):
                if g and g not in bare:
                    bare.append(g)
        listed = {k for k, _, _ in known}
        core = next((k for g in bare if (k := "".join(g)) in listed), "".join(bare[-1]) if bare else same)
        fixed = cut = None
        if known and core not in listed:
            hits = {k for g in bare for k, want, raw in known if near_all(g, want) or near_all(g, raw) or (len(k) > 7 and typos("".join(g), k, 1) <= 1 and re.sub(r"\D", "", "".join(g)) == re.sub(r"\D", "", k) and "".join(g) != k + "s")}
            fixed = hits.pop() if len(hits) == 1 else None
            dots = bool(_CUT.search(name))
            for g in bare:
                text = "".join(g)
                hits = {k for k, want, _ in known if len(text) < len(k) and self._begins(g, want, dots)}
                if len(hits) == 1 and (len(text) >= 4 if dots else len(text) >= 8):
                    cut = cut or hits.pop()
        return same, core, fixed, cut

    @staticmethod
    def _begins(have: Sequence[str], want: Sequence[str], dots: bool) -> bool:
        """Whether ``have`` is the beginning of ``want``; without dots only if it ends within a word or has most words."""
        n = len(have)
        if n > len(want) or not want[n - 1].startswith(have[-1]):
            return False
        if list(have[:-1]) != list(want[: n - 1]) and not (dots and near_all(have[:-1], want[: n - 1])):
            return False
        return dots or (have[-1] != want[n - 1])

    @staticmethod
    def _without_tail(ws: list[str], names: Sequence[Sequence[str]]) -> list[list[str]]:
        """The words as they are, then with one trailing edition word or "by act" less at a time."""
        out, now = [ws], ws
        while now:
            for base in names:
                bare = [w for w in base if w != "the"]
                for own in (list(base), bare, ["the", *bare]):
                    if len(now) > len(own) + 1 and now[-len(own) :] == own and now[-len(own) - 1] == "by":
                        now = now[: -len(own) - 1]
                        break
                else:
                    continue
                break
            else:
                if not is_edition(now[-1]) and now[-1] != "s":
                    break
                now = now[:-1]
            out.append(now)
        return out


KEYS = ("act_same", "act_words", "act_lead", "act_fixed", "act_initials", "album_same", "album_core", "album_fixed", "album_cut")


def match_records(
    rows: DataFrame,
    records: DataFrame,
    *,
    key: str,
    act: str,
    album: str,
    record_key: str,
    record_act: str,
    record_album: str,
    labels: DataFrame | None = None,
    labelled: dict[str, tuple[int, int]] | None = None,
    max_records: int = 200_000,
) -> DataFrame:
    """Rows whose act and album are a listed record: ``record_key``, ``key``, ``rule``, ``confidence``.

    Distinct pairs of names get keys from exact to repaired, as the list writes them. The rules are joins on one key of the act and one
    of the record, in turn; each takes what anti-joins with all rules before it leave open.
    The keys of repaired names need the acts of the list at hand: those go to the workers in blocks of about
    ``max_records``, by act, so that a worker holds one block whatever the length of the list.

    A rule's confidence is its smoothed precision over labels and never rises as rules weaken (:func:`confidences`). ``labels`` are rows of
    ``act``, ``album`` and ``record_key`` (null for no record), which run through the same rules; without them ``labelled``
    gives (right, wrong) of each rule, by default :data:`LABELLED`.

    Editions of a record match it; other recordings, follow-ups and collections have words of their own and don't,
    nor do records of the same title by another act. Defined results: rows without act or album, or with blank
    ones, match nothing; repeated rows match alike; of several records with the same names the lowest key
    counts; names of any length are taken whole; empty tables give no rows; other columns are ignored.
    """
    kind = records.schema[record_key].dataType.simpleString()
    listed = cut(_listed(records.select(F.col(record_key).alias("no"), F.col(record_act).alias("a"), F.col(record_album).alias("b")).where("a is not null and b is not null"), kind))
    blocks = max(1, -(-listed.count() // max_records))
    target = listed.groupBy("ra", "rb").agg(F.min("no").alias("found"))

    named = rows.select(F.col(key).alias("k"), F.col(act).alias("a"), F.col(album).alias("b")).where(F.col("a").rlike(r"\S") & F.col("b").rlike(r"\S"))
    matched = _cascade(named.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), listed, target, blocks)
    given = LABELLED if labelled is None else labelled
    if labels is not None:
        told = labels.select(F.col(act).alias("a"), F.col(album).alias("b"), F.col(record_key).alias("truth")).where(F.col("a").rlike(r"\S") & F.col("b").rlike(r"\S")).distinct()
        judged = told.join(_cascade(told.select("a", "b").distinct(), listed, target, blocks), ["a", "b"]).withColumn("right", F.coalesce(F.col("won") == F.col("truth"), F.lit(False)).cast("int"))
        given = {RULES[r["rule_no"]][0]: (r["r"], r["n"] - r["r"]) for r in judged.groupBy("rule_no").agg(F.sum("right").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    sure = confidences(given)
    rule = F.element_at(F.array(*[F.lit(n) for n, _, _ in RULES]), F.col("rule_no") + 1)
    trust = F.element_at(F.array(*[F.lit(sure[n]) for n, _, _ in RULES]), F.col("rule_no") + 1)
    return named.join(matched, ["a", "b"]).select(F.col("won").alias(record_key), F.col("k").alias(key), rule.alias("rule"), trust.alias("confidence"))


def _listed(records: DataFrame, kind: str) -> DataFrame:
    """The list with the keys its records are met by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"no": b["no"], "a": b["a"], "b": b["b"], "ra": [act_key(x) for x in b["a"]], "rb": [album_key(x) for x in b["b"]]})

    return records.mapInPandas(run, f"no {kind}, a string, b string, ra string, rb string")


def _cascade(pairs: DataFrame, listed: DataFrame, target: DataFrame, blocks: int) -> DataFrame:
    """Pairs of names that a rule matches, with the record ``won`` and the rule's number; of several records of one rule the lowest."""
    keyed = None
    for n in range(blocks):
        block = [tuple(r) for r in listed.where(F.pmod(F.xxhash64("ra"), F.lit(blocks)) == n).select("no", "a", "b").orderBy("no").toLocalIterator()]
        one = pairs.mapInPandas(_keyer(pairs.sparkSession.sparkContext.broadcast(block)), "a string, b string, " + ", ".join(f"{k} string" for k in KEYS))
        keyed = one if keyed is None else keyed.unionByName(one)
    still, won = cut(keyed), None
    for i, (_, left, right) in enumerate(RULES):
        on = (F.col(left) == F.col("ra")) & (F.col(right) == F.col("rb"))
        hit = still.join(target, on).select("a", "b", F.col("found").alias("won"), F.lit(i).alias("rule_no"))
        won = hit if won is None else won.unionByName(hit)
        still = still.join(target, on, "left_anti")
    best = F.min(F.struct("rule_no", "won"))
    return won.groupBy("a", "b").agg(best.alias("x")).select("a", "b", "x.won", "x.rule_no")


def _keyer(block):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Keys(block.value)
        for batch in batches:
            out = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                act_keys = own.act(a)
                if act_keys[4] is not None:
                    out.append((a, b, *act_keys, *own.album(act_keys[4], b, a)))
            yield pd.DataFrame(out, columns=["a", "b", *KEYS])

    return run
