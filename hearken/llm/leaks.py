"""Held-out items inside training texts: q-gram lemma in diagonal bands, verified by banded alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.session import cut, spread

Q = 8  #: letters of a q-gram
HALF = 16  #: half the width of a diagonal band; bands overlap by half
WIDE = 4 * HALF  #: diagonals of an alignment: a band, and half a band on either side
#: Scores of the local alignment of letters.
MATCH, MISS, GAP = 1.0, -1.6, -1.6
#: Share of a passage's words that may be changed, and of those of an item that is wanted whole.
CHANGED, CHANGED_WHOLE = 0.25, 0.1
#: Letters and texts that are searched at once.
CHUNK_LETTERS, CHUNK_TEXTS = 1_000_000, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TAG = re.compile(r"<[^<>]{0,400}>")
_UNSEEN = regex.compile(r"\p{Cf}+")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words(text: str) -> list[str]:
    """Words of a text, letters and digits only, in one case."""
    plain = html.unescape(text) if "&" in text else text
    plain = _TAG.sub(" ", plain) if "<" in plain else plain
    if not plain.isascii():
        plain = _UNSEEN.sub("", unicodedata.normalize("NFKC", plain))
    return _WORD.findall(plain.casefold())


def letters(text: str) -> tuple[str, np.ndarray]:
    """Letters and digits of a text in one case, without anything between them, and the word number of each."""
    ws = words(text)
    return "".join(ws), np.repeat(np.arange(len(ws), dtype=np.int32), [len(w) for w in ws])


def grams(codes: np.ndarray, size: int = Q) -> np.ndarray:
    """Hash of the ``size`` letters that begin at each letter; pairs of hashes are doubled up."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, span, power = codes.astype(np.uint64), 1, _BASE
        while span * 2 <= size:
            out = out[:-span] * power + out[span:]
            power, span = power * power, span * 2
        for i in range(span, size):
            out = out[:n] * _BASE + codes[i : i + n] if len(out) > n or i == span else out * _BASE + codes[i : i + n]
        out = out[:n]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def wanted(word: np.ndarray, min_words: int) -> tuple[int, int]:
    """Letters of the shortest passage of an item, given the word number of each letter, and the q-grams it shares at least.

    The q-gram lemma: a changed word of w letters spoils w + q - 1 of the n - q + 1 q-grams of n letters. 0 stands for an item so
    short that one change could spoil them all: only its exact words count.
    """
    n, total = len(word), int(word[-1]) + 1
    if n < 2 * Q:
        return n, 0
    starts = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), n)
    span = int((starts[min_words:] - starts[:-min_words]).min()) if total >= min_words else n
    held, share = min(total, min_words), CHANGED if total >= min_words else CHANGED_WHOLE
    return span, max(1, int(span - Q + 1 - int(held * share) * (span / held + Q - 1)))


@dataclass
class Items:
    """Index of a block of items: their letters, and their q-grams in hash order."""

    ids: list
    codes: list[np.ndarray]
    words: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    rare: np.ndarray
    need: np.ndarray
    open_at: np.ndarray
    poor_key: np.ndarray
    bits: np.ndarray
    exact: dict[int, dict[int, list[int]]]


def index(rows: Sequence[tuple[object, str, Sequence[int], Sequence[bool]]], *, min_words: int, rare_hits: int) -> Items:
    """Index items, given as (id, letters, word of each letter, whether the q-gram at each letter is rare among all items).

    A band that holds a passage has as many q-grams as :func:`wanted` says, so at least that less the item's common ones are rare.
    Where this leaves ``rare_hits``, only rare q-grams open a candidate; of the other items any do.
    """
    ids, codes, word_of, hashes, rares, needs, opens = [], [], [], [], [], [], []
    exact: dict[int, dict[int, list[int]]] = {}
    for i, flat, word, rare in rows:
        c, w = code(flat), np.asarray(word, dtype=np.int32)
        _, need = wanted(w, min_words)
        few = np.asarray(rare, dtype=bool)[: max(0, len(c) - Q + 1)]
        if not need:
            exact.setdefault(len(c), {}).setdefault(int(grams(c, len(c))[0]), []).append(len(ids))
        hashes.append(grams(c) if need else np.empty(0, dtype=np.uint64))
        rares.append(few if need else few[:0])
        left = need - int((~few).sum())
        opens.append(left if left >= rare_hits else 0)
        needs.append(need)
        ids.append(i)
        codes.append(c)
        word_of.append(w)
    none = np.empty(0, dtype=np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    o = np.repeat(np.arange(len(ids)), [len(x) for x in hashes]) if ids else none
    p = np.concatenate([np.arange(len(x)) for x in hashes]) if ids else none
    few = np.concatenate(rares) if ids else np.empty(0, dtype=bool)
    order = np.lexsort((p, o, h))
    h, o, p, few = h[order], o[order], p[order], few[order]
    keys, first = np.unique(h, return_index=True)
    open_at = np.array(opens, dtype=np.int64)
    poor = np.zeros(len(keys), dtype=bool)
    if len(keys):
        poor[np.searchsorted(keys, h[open_at[o] == 0])] = True
    size = 1 << max(20, int(16 * max(1, len(keys))).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(keys & np.uint64(size - 1)).astype(np.int64)] = True
    return Items(ids, codes, word_of, keys, np.append(first, len(h)).astype(np.int64), o.astype(np.int64), p.astype(np.int64), few[first] if len(keys) else np.empty(0, dtype=bool), np.array(needs, dtype=np.int64), open_at, poor, bits, exact)


def _expand(at: np.ndarray, k: np.ndarray, own: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hit for each item that has the q-gram: item, place in the item, place in the text."""
    lens = own.first[k + 1] - own.first[k]
    offset = np.repeat(own.first[k] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
    return own.owner[offset], own.place[offset], np.repeat(at, lens)


def _bands(pair: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of two neighbouring halves that hold anything: pair of text and item, first half, q-grams in the band."""
    keys, n = np.unique((pair << 28) | (half + (1 << 27)), return_counts=True)
    if len(keys):
        goes_on = np.append(keys[1:] == keys[:-1] + 1, False)
        n = n + np.where(goes_on, np.append(n[1:], 0), 0)
    return keys >> 28, (keys & ((1 << 28) - 1)) - (1 << 27), n


def search(texts: Sequence[list[str]], own: Items, *, min_words: int, density: float) -> list[tuple[int, int, int, float]]:
    """Items that texts, given as words, hold: text number, item number, words of the passage, score."""
    flats = ["".join(ws) for ws in texts]
    lens = np.array([len(f) for f in flats], dtype=np.int64)
    if not lens.sum() or not own.ids:
        return []
    start = np.append(0, np.cumsum(lens))
    codes = code("".join(flats))
    doc_of = np.repeat(np.arange(len(flats)), lens)
    found: dict[tuple[int, int], tuple[int, float]] = {}
    if own.exact:
        begins = np.zeros(len(codes) + 1, dtype=bool)
        sizes = np.array([len(w) for ws in texts for w in ws], dtype=np.int64)
        begins[np.append(0, np.cumsum(sizes))] = True
        for n, by_hash in own.exact.items():
            g = grams(codes, n)
            for at in np.flatnonzero(np.isin(g, np.array(list(by_hash), dtype=np.uint64)) & begins[: len(g)] & begins[n : n + len(g)]).tolist():
                for i in by_hash[int(g[at])]:
                    if doc_of[at] == doc_of[at + n - 1] and np.array_equal(codes[at : at + n], own.codes[i]) and np.array_equal(np.flatnonzero(begins[at : at + n]), np.flatnonzero(np.append(True, own.words[i][1:] != own.words[i][:-1]))):
                        found[int(doc_of[at]), i] = (int(own.words[i][-1]) + 1, 1.0)
    g = grams(codes)
    at = np.flatnonzero(own.bits[(g & np.uint64(len(own.bits) - 1)).astype(np.int64)])
    at = at[doc_of[at] == doc_of[at + Q - 1]]
    k = np.searchsorted(own.keys, g[at])
    k[k == len(own.keys)] = 0
    good = own.keys[k] == g[at] if len(own.keys) else np.zeros(0, dtype=bool)
    at, k = at[good], k[good]
    n_items = len(own.ids)

    def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, place, pos = _expand(at[mask], k[mask], own)
        doc = doc_of[pos]
        return item, doc * n_items + item, (pos - start[doc] - place) // HALF

    opened = [np.empty(0, dtype=np.int64)]
    few, poor = own.rare[k], own.poor_key[k]
    if few.any():
        item, pair, half = hits(few)
        rich = own.open_at[item] > 0
        pair, _, n = _bands(pair[rich], half[rich])
        opened.append(pair[n >= own.open_at[pair % n_items]])
    if poor.any():
        item, pair, half = hits(poor)
        rest = own.open_at[item] == 0
        pair, _, n = _bands(pair[rest], half[rest])
        opened.append(pair[n >= own.need[pair % n_items]])
    pairs = np.unique(np.concatenate(opened))
    if len(pairs):
        _, pair, half = hits(np.isin(doc_of[at], pairs // n_items))
        inside = np.isin(pair, pairs)
        pair, half, n = _bands(pair[inside], half[inside])
        # Of overlapping bands the fullest is aligned; the alignment reaches half a band further on either side.
        before = np.append(False, (pair[1:] == pair[:-1]) & (half[1:] == half[:-1] + 1) & (n[1:] <= n[:-1])) if len(n) else n > 0
        after = np.append((pair[1:] == pair[:-1]) & (half[1:] == half[:-1] + 1) & (n[:-1] < n[1:]), False) if len(n) else n > 0
        keep = (n >= own.need[pair % n_items]) & ~before & ~after
        pair, half = pair[keep], half[keep]
        for (d, i), (n_words, score, covered) in zip(zip((pair // n_items).tolist(), (pair % n_items).tolist(), strict=True), _aligned(codes, start, pair // n_items, pair % n_items, (half - 1) * HALF, own), strict=True):
            whole = int(own.words[i][-1]) + 1 < min_words
            if (covered >= 0.85 if whole else n_words >= min_words * 0.85) and score >= density and (n_words, score) > found.get((d, i), (0, 0.0)):
                found[d, i] = (n_words, score)
    return [(d, i, w, x) for (d, i), (w, x) in sorted(found.items())]


def _aligned(codes: np.ndarray, start: np.ndarray, docs: np.ndarray, items: np.ndarray, low: np.ndarray, own: Items) -> list[tuple[int, float, float]]:
    """Best local alignment of each item with its text on the diagonals from ``low``: item words in it, share of letters that match, share of the item covered.

    Many are worked through in step, those of like length together.
    """
    out: list[tuple[int, float, float]] = [(0, 0.0, 0.0)] * len(docs)
    size = np.array([len(own.codes[i]) for i in items.tolist()], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        last = min(len(order), at + 512)
        while last > at + 1 and (last - at) * (int(size[order[last - 1]]) + WIDE) > 4_000_000:
            last = at + (last - at + 1) // 2
        group = order[at:last]
        at = last
        most = int(size[group].max())
        item = np.full((len(group), most), 0xFFFFFFFE, dtype=np.uint32)
        for r, g in enumerate(group.tolist()):
            item[r, : size[g]] = own.codes[int(items[g])]
        there = low[group][:, None] + np.arange(most + WIDE)[None, :]
        held = (there >= 0) & (there < (start[docs[group] + 1] - start[docs[group]])[:, None])
        text = np.where(held, codes[np.where(held, there + start[docs[group]][:, None], 0)], np.uint32(0xFFFFFFFF))
        end, top = _sweep(text, item, free=True)
        # the same alignment from its end back gives its first letter
        rows = np.arange(len(group))[:, None]
        back = end[:, None] - np.arange(most)[None, :]
        item_back = np.where(back >= 0, item[rows, np.maximum(back, 0)], np.uint32(0xFFFFFFFE))
        back = end[:, None] + WIDE - 1 - np.arange(most + WIDE)[None, :]
        text_back = np.where(back >= 0, text[rows, np.clip(back, 0, most + WIDE - 1)], np.uint32(0xFFFFFFFF))
        steps, _ = _sweep(text_back, item_back, free=False)
        for r, g in enumerate(group.tolist()):
            if top[r] > 0:
                word, z = own.words[int(items[g])], int(end[r])
                a = max(0, z - int(steps[r]))
                length = z - a + 1
                # score = matches * MATCH + edits * MISS and matches + edits ~ length
                share = (float(top[r]) - length * MISS) / (length * (MATCH - MISS))
                n = int(word[z]) - int(word[a]) + 1
                out[g] = (n - int(n > 1 and a > 0 and word[a - 1] == word[a]), share, length / int(size[g]))
    return out


def _sweep(text: np.ndarray, item: np.ndarray, *, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row (item letter) where the best local alignment of each pair ends, and its score; unless ``free``, of alignments that begin in the first row."""
    ramp = (np.arange(WIDE) * GAP).astype(np.float32)
    row = np.zeros((len(item), WIDE), dtype=np.float32)
    best, at = np.zeros(len(item), dtype=np.float32), np.zeros(len(item), dtype=np.int64)
    up = np.empty_like(row)
    for i in range(item.shape[1]):
        now = row + np.where(text[:, i : i + WIDE] == item[:, i : i + 1], np.float32(MATCH), np.float32(MISS))
        up[:, :-1] = row[:, 1:] + np.float32(GAP)
        up[:, -1] = -1e9
        np.maximum(now, up, out=now)
        if free:
            np.maximum(now, 0, out=now)
        now -= ramp
        np.maximum.accumulate(now, axis=1, out=now)
        now += ramp
        row = now
        top = row.max(axis=1)
        better = top > best
        best[better], at[better] = top[better], i
    return at, best


def held_items(items: DataFrame, *, item_key: str, item_text: str, shared: int, min_words: int) -> DataFrame:
    """What is looked for: ``fid``, ``flat`` (letters), ``word`` (number of the word of each), ``ids`` (keys of all items of these letters).

    Sentences of fewer than ``min_words`` words that at least ``shared`` items of different wording have in common (instructions) are left out; only items that
    also have a sentence of their own are counted, and an item of several such sentences and nothing else keeps them.
    """

    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"s": "".join(ws), "raw": raw, "n": len(ws)} for raw in _SENTENCE.split(t.strip()) for ws in [words(raw)] if ws])

    split.__annotations__ = {"texts": pd.Series, "return": pd.Series}

    def fold(texts: pd.Series) -> pd.DataFrame:
        both = [letters(t) for t in texts]
        return pd.DataFrame({"flat": [f for f, _ in both], "word": [w.tolist() for _, w in both]})

    fold.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    sentence = T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("n", T.IntegerType())]))
    rows = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).where("text is not null").withColumn("ss", F.pandas_udf(split, sentence)("text"))
    rows = cut(rows.where(F.size("ss") > 0).withColumn("tid", F.md5(F.array_join(F.array_sort(F.array_distinct(F.col("ss.s"))), "\n"))))
    each = rows.select("tid", F.explode("ss.s").alias("s")).distinct()
    met = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    anchored = each.join(met.where(F.col("n") < shared), "s", "left_semi").select("tid").distinct()
    notes = each.join(anchored, "tid", "left_semi").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared).select("s", F.lit(True).alias("note"))
    marked = rows.select("id", "ss", F.posexplode("ss").alias("i", "x")).select("id", "ss", "i", "x.*").join(notes, "s", "left")
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~(F.coalesce("note", F.lit(False)) & (F.col("n") < min_words)), F.struct("i", "raw")))), lambda x: x["raw"]), " ")
    kept = marked.groupBy("id", "ss").agg(own.alias("own")).withColumn("text", F.when((F.col("own") == "") & (F.size(F.array_distinct(F.col("ss.s"))) > 1), F.array_join(F.col("ss.raw"), " ")).otherwise(F.col("own")))
    folded = kept.select("id", F.pandas_udf(fold, "flat string, word array<int>")("text").alias("x")).select("id", "x.*").where("flat <> ''")
    return folded.groupBy(F.md5(F.concat_ws("|", "flat", F.array_join(F.col("word").cast("array<string>"), ","))).alias("fid")).agg(F.first("flat").alias("flat"), F.first("word").alias("word"), F.collect_list("id").alias("ids"))


def with_rareness(held: DataFrame, *, common: int) -> DataFrame:
    """Items with ``rare``: for each letter whether the q-gram that begins there is in at most ``common`` items of different wording."""

    def hashes(flats: pd.Series) -> pd.Series:
        return flats.map(lambda f: grams(code(f)).view(np.int64).tolist())

    hashes.__annotations__ = {"flats": pd.Series, "return": pd.Series}
    at = held.select("fid", F.posexplode(F.pandas_udf(hashes, T.ArrayType(T.LongType()))("flat")).alias("i", "g"))
    frequent = at.select("fid", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > common).select("g", F.lit(False).alias("rare"))
    places = at.join(frequent, "g", "left").groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("rare", F.lit(True)).alias("rare")))).alias("x"))
    return held.join(places.select("fid", F.col("x.rare").alias("rare")), "fid", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<boolean>")))


def leaked(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str,
    text: str,
    item_key: str,
    item_text: str,
    min_words: int = 20,
    shared: int = 3,
    common: int = 4,
    rare_hits: int = 6,
    density: float = 0.78,
    block_letters: int = 8_000_000,
) -> DataFrame:
    """One row for each document and item where the text holds the item or a passage of it.

    A passage is about ``min_words`` or more of an item's words in a row, or all words of a shorter item, in any
    layout, case or punctuation, with at least ``density`` of the letters of its best local alignment equal. Sentences shorter than a passage that ``shared`` or
    more different items have in common (instructions) don't count. Columns: ``key``, ``item_key``, ``n_words``, ``score``.

    A diagonal band of a text against an item is aligned if it has the q-grams that the q-gram lemma leaves of the item's shortest passage
    with :data:`CHANGED` of its words changed (:data:`CHANGED_WHOLE` of an item wanted whole). An item under 16 letters is met by its exact words only.

    The held-out items are the query set. They are prepared by joins over all of them (what is shared or rare doesn't depend on blocks), then taken in
    blocks of about ``block_letters``, the most the driver and a worker hold; each block is held against every text in one map without a
    shuffle. With several blocks the texts are parted into words once and read again from the shared folder.

    Defined results: null, empty and blank texts or items hold nothing; texts of any length are taken whole;
    repeated texts give rows of their own; repeated items match alike; empty tables give no rows; other columns are
    ignored.
    """
    out_schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, fid string, n_words int, score double"
    held = cut(with_rareness(cut(held_items(items, item_key=item_key, item_text=item_text, shared=shared, min_words=min_words)), common=common))
    total = held.agg(F.sum(F.length("flat"))).first()[0] or 0
    blocks = max(1, -(-total // block_letters))
    narrow = spread(docs.select(key, text).where(F.col(text).isNotNull()))
    if blocks > 1:
        narrow = cut(narrow.mapInPandas(_parter(key, text), f"`{key}` {docs.schema[key].dataType.simpleString()}, `{text}` string"))
    found = None
    for b in range(blocks):
        rows = [(r["fid"], r["flat"], r["word"], r["rare"]) for r in held.where(F.pmod(F.xxhash64("fid"), F.lit(blocks)) == b).select("fid", "flat", "word", "rare").toLocalIterator()]
        own = docs.sparkSession.sparkContext.broadcast(index(rows, min_words=min_words, rare_hits=rare_hits))
        one = narrow.mapInPandas(_searcher(own, key, blocks > 1, dict(min_words=min_words, density=density)), out_schema)
        found = one if found is None else found.unionByName(one)
    return found.join(held.select("fid", F.explode("ids").alias(item_key)), "fid").select(key, item_key, "n_words", "score")


def _parter(key: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b.iloc[:, 0], text: [" ".join(words(t)) for t in b.iloc[:, 1]]})

    return run


def _searcher(own, key: str, parted: bool, limits: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = own.value
        for batch in batches:
            out: list[tuple] = []
            keys, held, used = [], [], 0

            def flush(out: list[tuple] = out) -> None:
                nonlocal used
                out += [(keys[d], block.ids[i], w, s) for d, i, w, s in search(held, block, **limits)]
                keys.clear()
                held.clear()
                used = 0

            for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                ws = t.split(" ") if parted else words(t)
                keys.append(k)
                held.append([w for w in ws if w])
                used += len(t)
                if used >= CHUNK_LETTERS or len(held) >= CHUNK_TEXTS:
                    flush()
            flush()
            yield pd.DataFrame(out, columns=[key, "fid", "n_words", "score"])

    return run
