"""Duplicates hidden by formatting: rows alike in every column but a name that is only written differently."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.session import cut

#: Bases of the rolling polynomial hashes (arithmetic modulo 2^64), and the multiplier that mixes the hash of a word.
SEQUENCE, WORD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
KEEP, JOIN, MARK, BLANK = 0, 1, 2, 3


class FoldTable:
    """Lookup of a code point: the letters and digits it folds to (none: it is skipped), and how it parts words.

    Combining and invisible marks part nothing; punctuation and symbols part fine words; blanks part fine and coarse
    words. Entries are made when a code point is first met.
    """

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, dtype=bool)
        self.role = np.zeros(0x110000, dtype=np.int8)
        self.size = np.zeros(0x110000, dtype=np.int64)
        self.start = np.zeros(0x110000, dtype=np.int64)
        self.pool = np.zeros(1024, dtype=np.uint64)
        self.used = 0

    def learn(self, codes: np.ndarray) -> None:
        for c in np.unique(codes[~self.known[codes]]).tolist():
            ch = chr(c)
            folded = [x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold()) if x.isalnum()]
            category = unicodedata.category(ch)
            self.role[c] = KEEP if folded else BLANK if ch.isspace() else JOIN if category[0] == "M" or category == "Cf" else MARK
            if self.used + len(folded) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(folded)), dtype=np.uint64)])
            self.pool[self.used : self.used + len(folded)] = [ord(x) for x in folded]
            self.size[c], self.start[c] = len(folded), self.used
            self.used += len(folded)
            self.known[c] = True


@lru_cache(maxsize=1)
def table() -> FoldTable:
    return FoldTable()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=np.uint64)


def fingerprints(names: Sequence[str]) -> np.ndarray:
    """Hashes of each name, three columns: its letters in order; its fine words, in any order; its coarse words, in any order.

    Code points stream through the lookup table; a letter's term is its folded code times a power of its place, so
    the folded name is never put together.
    """
    fold = table()
    lens = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    out = np.zeros((len(names), 3), dtype=np.uint64)
    if not lens.sum():
        return out
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    fold.learn(codes)
    owner = np.repeat(np.arange(len(names)), lens)
    role, size = fold.role[codes], fold.size[codes]
    first = np.zeros(len(codes), dtype=bool)
    first[np.append(0, np.cumsum(lens)[:-1])[lens > 0]] = True
    letter = np.repeat(np.arange(len(codes)), size)
    value = fold.pool[np.repeat(fold.start[codes] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())] + np.uint64(1)
    if not len(letter):
        return out
    with np.errstate(over="ignore"):
        for column, parts in enumerate((first, first | (role >= MARK), first | (role == BLANK))):
            group = np.cumsum(parts)[letter]  # number of the word (of the name, in the first column)
            begins = np.append(True, group[1:] != group[:-1])
            at = np.flatnonzero(begins)
            place = np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))
            base = SEQUENCE if column == 0 else WORD
            words = np.add.reduceat(value * _powers(base, int(place.max()) + 1)[place], at)
            if column:
                words = (words ^ (words >> np.uint64(31))) * MIX
                words ^= words >> np.uint64(29)
            np.add.at(out[:, column], owner[letter[at]], words)
    return out


def _next(name: str, i: int, part: int, fold: FoldTable) -> tuple[int, int, int]:
    """Next folded letter at or after (code point i, letter ``part`` of its folding): its place, its part, its code; code -1 at the end."""
    while i < len(name):
        c = ord(name[i])
        if part < fold.size[c]:
            return i, part, int(fold.pool[fold.start[c] + part])
        i, part = i + 1, 0
    return i, 0, -1


def same_letters(a: str, b: str) -> bool:
    """Two-pointer comparison of the letters of two names, skipping all else."""
    fold = table()
    fold.learn(np.array([ord(c) for c in a + b], dtype=np.int64))
    i = j = p = q = 0
    while True:
        i, p, x = _next(a, i, p, fold)
        j, q, y = _next(b, j, q, fold)
        if x != y:
            return False
        if x < 0:
            return True
        p, q = p + 1, q + 1


def _words(name: str, fine: bool) -> list[str]:
    fold = table()
    fold.learn(np.array([ord(c) for c in name], dtype=np.int64))
    limit = MARK if fine else BLANK
    out, start = [], 0
    for i, c in enumerate(name + " "):
        if i == len(name) or fold.role[ord(c)] >= limit:
            if any(fold.size[ord(x)] for x in name[start:i]):
                out.append(name[start:i])
            start = i + 1
    return out


def same_words(a: str, b: str, fine: bool) -> bool:
    """Whether the words of two names pair off, each pair compared by two pointers."""
    left, right = _words(a, fine), _words(b, fine)
    if len(left) != len(right):
        return False
    for w in left:
        for k, v in enumerate(right):
            if same_letters(w, v):
                del right[k]
                break
        else:
            return False
    return True


#: The three comparisons, by the hash that suggests them.
SAME = {"s": same_letters, "f": lambda a, b: same_words(a, b, True), "c": lambda a, b: same_words(a, b, False)}


def verified(names: Sequence[str], heads: Sequence[str | None], hashes: Sequence[int], which: str) -> list[int]:
    """The hashes, but another one for each name that isn't the same as the head of its hash but for formatting.

    The other hash is one of the letters (or the sorted words) themselves, so that names falsely met find each other.
    """
    out = []
    for name, head, h in zip(names, heads, hashes, strict=True):
        if head is not None and name != head and not SAME[which](name, head):
            fold = table()
            parts = [name] if which == "s" else _words(name, which == "f")
            folded = sorted("".join(chr(int(x)) for ch in part for x in fold.pool[fold.start[ord(ch)] : fold.start[ord(ch)] + fold.size[ord(ch)]]) for part in parts)
            h = int.from_bytes(hashlib.blake2b("\n".join(folded).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        out.append(h)
    return out


def _rest(df: DataFrame, but: Sequence[str]) -> tuple[Column, Column]:
    """128 bits over all other columns, nulls apart from every value."""
    cols = [F.col(f"`{c}`") for c in df.columns if c not in but]
    flags = F.concat(F.lit("0"), *[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(flags, *cols), F.xxhash64(F.lit("second"), *reversed(cols), flags)


def copy_classes(rows: DataFrame, *, key: str, name: str, ignore: Sequence[str] = (), required: Sequence[str] = (), gather: int = 64) -> DataFrame:
    """Rows that have a copy: ``key`` and ``class_id``, the smallest key of the class.

    Copies agree exactly in every column but ``key``, ``name`` and those in ``ignore``, and their names differ
    at most in blanks, case, marks that are neither letters nor digits, Unicode form or the order of words.

    Only 128-bit hashes of the other columns are counted over all rows (combined before the shuffle); the names
    of rows whose hash occurs again are then hashed, and each distinct spelling is compared with the head of its hash. Spellings
    with a hash in common, and what hangs together by them, are a class. Rows alike in all else that have at most ``gather`` spellings are put together at once; among more,
    the smallest key is handed on along each of the three hashes, by joins, until none changes. So a group of any number of copies or spellings is never one row, and the
    classes are the same either way.

    Defined results: rows without ``name`` or a value in ``required`` have no copies; nulls elsewhere equal nulls only; a name without
    any letter or digit equals such names only; names of any length are taken whole; an empty table gives no rows.
    """
    h1, h2 = _rest(rows, [key, name, *ignore])
    ready = F.col(name).isNotNull()
    for c in required:
        ready = ready & F.col(c).isNotNull()
    hashed = rows.where(ready).select(h1.alias("h1"), h2.alias("h2"), F.col(key).alias("k"), F.col(name).alias("a"))
    again = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    twins = hashed.join(again, ["h1", "h2"], "left_semi")

    kind = rows.schema[key].dataType.simpleString()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = fingerprints(list(b["a"])).view(np.int64)
            yield pd.DataFrame({"h1": b["h1"], "h2": b["h2"], "k": b["k"], "a": b["a"], "s": f[:, 0], "f": f[:, 1], "c": f[:, 2]})

    marked = cut(twins.mapInPandas(stream, f"h1 bigint, h2 bigint, k {kind}, a string, s bigint, f bigint, c bigint"))
    spelt = marked.groupBy("h1", "h2", "a", "s", "f", "c").agg(F.min("k").alias("class_id"))
    counted = spelt.join(spelt.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), ["h1", "h2"])
    few = counted.where(F.col("n") <= gather).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("class_id", "a", "s", "f", "c"))).alias("x"))
    classes = few.mapInPandas(_link, f"h1 bigint, h2 bigint, a string, class_id {kind}")
    many = cut(counted.where(F.col("n") > gather).drop("n"))
    if not many.isEmpty():
        for which in SAME:
            many = _checked(many, which)
        many = cut(many)
        linked = _linked(many.groupBy("h1", "h2", "s", "f", "c").agg(F.min("class_id").alias("class_id")))
        classes = classes.unionByName(many.drop("class_id").join(linked, ["h1", "h2", "s", "f", "c"]).select("h1", "h2", "a", "class_id"))
    joined = cut(marked.select("h1", "h2", "a", "k").join(classes, ["h1", "h2", "a"]).select(F.col("k").alias(key), "class_id"))
    sizes = joined.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id")
    return joined.join(sizes, "class_id", "left_semi").select(key, "class_id")


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Classes within gathered groups of spellings, which come in the order of their keys."""
    for b in batches:
        out = []
        for h1, h2, xs in zip(b["h1"], b["h2"], b["x"], strict=True):
            heads = list(range(len(xs)))

            def head(i: int, heads: list[int] = heads) -> int:
                while heads[i] != i:
                    i = heads[i]
                return i

            for which in SAME:
                first: dict[int, int] = {}
                for i, x in enumerate(xs):
                    at = first.setdefault(x[which], i)
                    own = verified([x["a"]], [xs[at]["a"]], [x[which]], which)[0]
                    low, high = sorted((head(i), head(first.setdefault(own, i))))
                    heads[high] = low
            out += [(h1, h2, x["a"], xs[head(i)]["class_id"]) for i, x in enumerate(xs)]
        yield pd.DataFrame(out, columns=["h1", "h2", "a", "class_id"])


def _linked(nodes: DataFrame) -> DataFrame:
    """Hashes of spellings with the smallest key of all that hang together by any of them."""
    while True:
        told = nodes.withColumn("before", F.col("class_id"))
        for which in SAME:
            least = told.groupBy("h1", "h2", which).agg(F.min("class_id").alias("least"))
            told = told.join(least, ["h1", "h2", which]).withColumn("class_id", F.col("least")).drop("least")
        told = cut(told.select("h1", "h2", "s", "f", "c", "class_id", "before"))
        nodes = told.drop("before")
        if told.where(F.col("before") != F.col("class_id")).isEmpty():
            return nodes


def _checked(spelt: DataFrame, which: str) -> DataFrame:
    """Spellings with one hash verified: each compared with the first of those that share it."""
    heads = spelt.groupBy("h1", "h2", which).agg(F.min_by("a", F.struct("class_id", "a")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")

    def check(names: pd.Series, firsts: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(verified(list(names), list(firsts), list(hashes), which))

    check.__annotations__ = {"names": pd.Series, "firsts": pd.Series, "hashes": pd.Series, "return": pd.Series}
    return spelt.join(heads, ["h1", "h2", which], "left").withColumn(which, F.pandas_udf(check, "bigint")("a", "head", which)).drop("head")


def copy_pairs(classes: DataFrame, *, key: str) -> DataFrame:
    """All pairs of each class, ``<key>_a`` the smaller."""
    a = classes.select(F.col(key).alias("x"), "class_id")
    b = classes.select(F.col(key).alias("y"), F.col("class_id").alias("other"))
    return a.join(b, (F.col("class_id") == F.col("other")) & (F.col("x") < F.col("y"))).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))


def collapsed(rows: DataFrame, classes: DataFrame, *, key: str) -> DataFrame:
    """One row for each listen: the key of its first copy, and the number of copies (1 where it has no other)."""
    own = rows.select(key).join(classes, key, "left")
    return own.groupBy(F.coalesce("class_id", F.col(key)).alias(key)).agg(F.count(F.lit(1)).alias("n_copies"))
