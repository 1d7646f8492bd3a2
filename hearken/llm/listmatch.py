"""Freely typed values onto a reference list: tokens repaired by edit distance, entries ranked by soft TF-IDF."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.session import cut

#: Decades by name, and the short form of the joining word.
DECADES = {"thirties": 3, "forties": 4, "fifties": 5, "sixties": 6, "seventies": 7, "eighties": 8, "nineties": 9}
SHORT_AND = "n"
#: Function words; they say nothing about the entry, however rare they are.
FUNCTION_WORDS = frozenset("a an at for from in of on or the to with".split())
FUNCTION_WEIGHT = 0.3
#: Letters up to which a word is compared by deletions and taken for cut short; longer ones are compared by pieces.
SHORT = 30
#: Occurrences by which the frequency of a listed word or entry is smoothed.
SEEN = 10
_TOKEN = re.compile(r"[^\W_]+")
_POSSESSIVE = re.compile(r"(?<=\d)['’]s\b", re.IGNORECASE)
_VOWELS = set("aeiou")
_DIGITS = str.maketrans("013457", "oieast")


def tokens(value: str) -> list[str]:
    """Words of a value: one case, no accents, letters and digits only; decades spelt as four digits and an s."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", _POSSESSIVE.sub("s", value)).casefold() if not unicodedata.combining(c))
    out: list[str] = []
    for w in map(_decade, _TOKEN.findall(plain)):
        if out and out[-1] == "nineteen" and re.fullmatch(r"19\d0s", w):
            out[-1] = w
        else:
            out.append("and" if w == SHORT_AND and out else w)
    return out


def _decade(word: str) -> str:
    if word in DECADES:
        return f"19{DECADES[word]}0s"
    return f"19{word}" if re.fullmatch(r"[3-9]0s", word) else word


def skeleton(word: str) -> str:
    """A word without its inner vowels."""
    return word[0] + "".join(c for c in word[1:-1] if c not in _VOWELS) + word[-1] if len(word) > 2 else word


def typos(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or ``most`` + 1 if they are more.

    Only the diagonals within ``most`` are worked through, so the cost follows the length.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    older: dict[int, int] = {}
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if not j:
                row[j] = i
                continue
            cost = min(before.get(j, far) + 1, row.get(j - 1, far) + 1, before.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, older.get(j - 2, far) + 1)
            row[j] = cost
        if min(row.values()) > most:
            return far
        older, before = before, row
    return min(before[len(b)], far)


def allowed(length: int) -> int:
    """Edits after which a word of this length is still taken for the unit by itself."""
    return 0 if length < 3 else 1 if length < 6 else 2


def reach(length: int) -> int:
    """Edits after which a word of this length may still be the unit, if the words beside it bear it out."""
    return 0 if length < 3 else 1 if length < 4 else 2


def singular(word: str) -> str:
    return word[:-3] + "y" if word.endswith("ies") else word[:-1] if word.endswith("s") and len(word) > 3 else word


def _deletes(word: str, most: int) -> set[str]:
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def pieces(length: int) -> list[tuple[int, int]]:
    """Five stretches of a word of this length: two edits, swaps included, leave one of them whole."""
    return [(i * length // 5, (i + 1) * length // 5) for i in range(5)]


def _piece_sign(length: int, i: int, part: str) -> str:
    return f"l{length}.{i}.{hashlib.blake2b(part.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def forms(token: str) -> set[str]:
    """A token, and as it reads with figures taken for letters."""
    return {token, token if token.isdigit() else token.translate(_DIGITS)}


def token_signs(token: str) -> list[str]:
    """Keys one of which a token shares with every unit it may stand for (:func:`unit_signs`)."""
    out = {"s" + singular(token), "p" + token if len(token) <= SHORT else "s" + singular(token)}
    for form in forms(token):
        if len(form) <= SHORT:
            out |= {"d" + x for x in _deletes(form, 2)}
        else:
            out |= {_piece_sign(n, i, form[max(0, a + k) : b + k]) for n in range(len(form) - 2, len(form) + 3) for i, (a, b) in enumerate(pieces(n)) for k in range(-2, 3)}
    if len(token) > 1 and not set(token[1:-1]) & _VOWELS:
        out |= {"k" + token} | ({"v" + token} if token[-1] not in _VOWELS else set())
    return sorted(out)


def unit_signs(unit: str, together: bool) -> list[str]:
    """Keys of a unit; those of words cut short only where the unit stands beside others in an entry."""
    out = {"s" + singular(unit), "k" + skeleton(unit)}
    if len(unit) <= SHORT + 2:
        out |= {"d" + x for x in _deletes(unit, 2)}
    if len(unit) > SHORT - 2:
        out |= {_piece_sign(len(unit), i, unit[a:b]) for i, (a, b) in enumerate(pieces(len(unit)))}
    if unit[-1] in _VOWELS:
        out.add("v" + skeleton(unit)[:-1])
    if together and len(unit) <= SHORT:
        out |= {"p" + unit[:k] for k in range(3, len(unit) - 1)}
    return sorted(out)


def likeness(token: str, unit: str, together: bool) -> tuple[float, float]:
    """How like a unit a token is for certain (plural, vowels left out), and how like if it's a slip or cut short."""
    if token == unit:
        return 1.0, 1.0
    sure = 0.97 if singular(token) == singular(unit) else 0.0
    if len(token) > 1 and not set(token[1:-1]) & _VOWELS:
        bare = skeleton(unit)
        if token == bare:
            sure = max(sure, 0.9)
        elif token[-1] not in _VOWELS and unit[-1] in _VOWELS and token == bare[:-1]:
            sure = max(sure, 0.85)
    slip = 0.8 if together and 3 <= len(token) < len(unit) - 1 and len(unit) <= SHORT and unit.startswith(token) else 0.0
    for form in forms(token):
        most = reach(max(len(unit), len(form)))
        edits = typos(form, unit, most)
        if edits <= most:
            slip = max(slip, 1.0 - edits / (2.0 * len(unit)) if edits <= allowed(len(unit)) else 0.5)
    return sure, max(sure, slip)


def entry_units(toks: Sequence[str], together: int) -> Iterator[tuple[str, list[str], bool]]:
    """Units of an entry: each token, and each run of up to ``together`` neighbours written as one; their tokens; whether a token has company."""
    for i, t in enumerate(toks):
        yield t, [t], len(toks) > 1
        for j in range(i + 2, min(len(toks), i + together) + 1):
            yield "".join(toks[i:j]), list(toks[i:j]), False


def glue(toks: Sequence[str], at: dict[int, int]) -> list[str]:
    """Neighbouring tokens that together write a word of the list, as one; ``at`` has the lengths of such runs by their place."""
    out: list[str] = []
    i = 0
    while i < len(toks):
        k = at.get(i, 1)
        out.append("".join(toks[i : i + k]))
        i += k
    return out


def soft_cosine(words: Sequence[tuple[int, float, Sequence[tuple[str, float, Sequence[str], float]]]], want: Sequence[tuple[str, float]]) -> tuple[float, bool]:
    """Soft TF-IDF cosine of a value and an entry, and whether all words of the entry are there.

    A word of the value is (times, weight, candidates), a candidate (unit, similarity, its tokens, their squared weight);
    ``want`` has the entry's tokens and weights. Each token of the entry is taken once, by the likest word. Beside words of
    its own, a value means only an entry that is there entirely and without much repair (else 0).
    """
    left = Counter(t for t, _ in want)
    full = sum(w * w for _, w in want)
    offers = sorted(((sim, gain, i, u, parts) for i, (_, _, cands) in enumerate(words) for u, sim, parts, gain in cands if any(p in left for p in parts)), key=lambda x: (-x[0], -x[1], x[2], x[3]))
    free = [times for times, _, _ in words]
    own: list[float] = [0.0] * len(words)
    dot = taken = 0.0
    for sim, gain, i, _, parts in offers:
        need = Counter(parts)
        while free[i] and all(left[p] >= n for p, n in need.items()):
            free[i] -= 1
            left -= need
            own[i] += gain
            taken += gain
            dot += sim * gain
    norm = sum(own)
    others = False
    for n, (_, weight, cands) in zip(free, words, strict=True):
        if n:
            exact = bool(cands) and cands[0][1] == 1.0
            norm += n * (cands[0][3] if exact else weight * weight)
            others = others or weight > FUNCTION_WEIGHT
    missing = sum(left.values()) > 0
    if not dot or others and (missing or dot < 0.8 * taken):
        return 0.0, not missing
    return dot / math.sqrt(norm * full), not missing


def map_to_list(rows: DataFrame, entries: DataFrame, *, key: str, value: str, entry_key: str, entry: str, threshold: float = 0.52, own_share: float = 0.3, together: int = 6) -> DataFrame:
    """One row for each row whose value isn't null, blank or exactly an entry: ``key``, ``entry_key`` (-1 for none), ``score``.

    Everything is joined, so that neither side has a bound: distinct tokens of all distinct values meet the units of the list
    (its tokens, and runs of up to ``together`` of them written as one) by edit distance, through shared deletions or, in long words,
    whole pieces (two edits, one in short words; also written together or apart, without inner vowels or, up to :data:`SHORT` letters, cut short). Weights of tokens are
    learnt from all distinct values: a token that stands beside many different ones says little, one that is met in one combination says much.
    An entry is a candidate of a value that has one of its heavier tokens: a match in the others alone can't reach ``threshold``.
    The best entry by soft TF-IDF counts from ``threshold`` on (0.1 more where a word of it is missing).

    A token more frequent than ``own_share`` of the unit it resembles, or a value that lacks a word of the entry and is as
    frequent in comparison with the entry, is one of its own and no slip; frequencies are smoothed by :data:`SEEN` listed ones.

    Defined results: null and blank values give no rows; repeated rows give rows of their own; ties go to the
    lower entry number; an empty list maps all to -1; of a value of any length each distinct token is one short row; other columns are
    ignored.
    """
    no_kind = entries.schema[entry_key].dataType.simpleString()

    def words_of(values: pd.Series) -> pd.Series:
        return values.map(tokens)

    words_of.__annotations__ = {"values": pd.Series, "return": pd.Series}
    worded_udf = F.pandas_udf(words_of, T.ArrayType(T.StringType()))
    digest = lambda c: F.unhex(F.md5(c))
    listed = cut(entries.select(F.col(entry_key).alias("no"), F.col(entry).alias("text")).where("text is not null").withColumn("ts", worded_udf("text")))

    def units_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for ts in b["ts"] for x in entry_units(ts, together)], columns=["u", "parts", "company"])

    made = listed.select("ts").mapInPandas(units_of, "u string, parts array<string>, company boolean")
    units = cut(made.groupBy("u").agg(F.min(F.struct((F.size("parts") > 1).alias("run"), "parts")).alias("x"), F.max("company").alias("company")).select("u", "x.parts", "x.run", "company"))

    typed = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where(F.col("v").isNotNull() & F.col("v").rlike(r"\S"))
    split = typed.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(digest(F.col("v")).alias("h"), "n", worded_udf("v").alias("seq"))
    worded = cut(_glued(split, units))

    # Distinct tokens, and the units each may stand for.
    each = worded.select("h", "n", F.explode(F.arrays_zip("ts", "ms")).alias("x")).select("h", "n", F.col("x.ts").alias("t"), F.col("x.ms").alias("m"))
    counted = cut(each.groupBy("t").agg(F.sum("n").alias("c")))
    repaired = cut(_repairs(counted, units, own_share))

    # Document frequency over distinct bags of repaired tokens; the empty token stands in every bag.
    sure = each.select("h", "t").join(repaired.select("t", "rep"), "t", "left").select("h", F.coalesce("rep", "t").alias("u"))
    bags = sure.groupBy("h").agg(F.array_sort(F.collect_set("u")).alias("bag")).select("bag").distinct()
    df = cut(bags.select(F.explode(F.concat(F.array(F.lit("")), "bag")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("df")))
    all_bags = df.where("u = ''").first()
    n_bags = float(max(2, all_bags["df"] if all_bags else 0))
    weigh = lambda c: F.pow(F.log(F.lit(1.0) + F.lit(n_bags) / F.greatest(F.lit(1), F.coalesce(c, F.lit(1)))), F.lit(1.5))
    parts = units.select("u", F.explode("parts").alias("p"))
    idf = parts.join(df, "u", "left").groupBy("p").agg(weigh(F.sum("df")).alias("w"))

    # Candidate entries of a unit, by the heavier tokens of each.
    weighed = listed.select("no", F.xxhash64(F.array_join("ts", " ")).alias("j"), F.posexplode("ts").alias("i", "p")).join(idf, "p")
    entry_rows = weighed.groupBy("no", "j").agg(F.sort_array(F.collect_list(F.struct("i", "p", "w"))).alias("want"), F.sum(F.col("w") * F.col("w")).alias("full"))
    below = Window.partitionBy("no").orderBy("w", "p", "i")
    heavy = weighed.withColumns({"run": F.sum(F.col("w") * F.col("w")).over(below), "full": F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("no"))}).where(F.col("run") >= F.lit(threshold**2) * F.col("full") * (1 - 1e-9)).select("no", "p").distinct()
    gains = parts.join(idf, "p").groupBy("u").agg(F.sum(F.col("w") * F.col("w")).alias("gain"))
    opens = parts.distinct().join(heavy, "p").groupBy("u").agg(F.collect_set("no").alias("nos"))
    cands = repaired.select("t", F.posexplode("us").alias("o", "x")).select("t", "o", "x.*").join(gains, "u").join(opens, "u", "left")
    offered = cands.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("o", "u", "sim", "parts", "gain"))).alias("cs"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("nos", F.array().cast(f"array<{no_kind}>"))))).alias("nos"))
    weight = F.when(F.col("t").isin(*sorted(FUNCTION_WORDS)), FUNCTION_WEIGHT).otherwise(weigh(F.col("df")))
    known = counted.select("t").join(df.withColumnRenamed("u", "t"), "t", "left").join(offered, "t", "left").select("t", weight.alias("w"), "cs", "nos")

    whole = each.select("h", "t", "m").join(known, "t").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("t", "m", "w", "cs"))).alias("x"), F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"))
    asked_of = whole.where(F.size("nos") > 0).select("h", F.explode("nos").alias("no")).join(_entry_counts(worded, entry_rows), "no").groupBy("h").agg(F.collect_list(F.struct("no", "want", "listed_n")).alias("es"))
    open_values = whole.select("h", "x").join(asked_of, "h").join(_text_counts(worded), "h")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, n, xs, es in zip(b["h"], b["n"], b["x"], b["es"], strict=True):
                words = [(x["m"], x["w"], [(c["u"], c["sim"], c["parts"], c["gain"]) for c in x["cs"]] if x["cs"] is not None else []) for x in xs]
                best = min(((-s, e["no"], whole_there, e["listed_n"]) for e in es for s, whole_there in [soft_cosine(words, [(w["p"], w["w"]) for w in e["want"]])] if s), default=None, key=lambda x: x[:2])
                if best:
                    s, no, all_there, listed_n = -best[0], *best[1:]
                    if s >= threshold + (0.0 if all_there else 0.1) and (all_there or n <= own_share * (listed_n + SEEN)):
                        out.append((h, no, s))
            yield pd.DataFrame(out, columns=["h", "e", "s"])

    ranked = open_values.select("h", "n", "x", "es").mapInPandas(rank, f"h binary, e {no_kind}, s double")
    asked = typed.join(listed.select(F.col("text").alias("v")).distinct(), "v", "left_anti").select("k", digest(F.col("v")).alias("h"))
    return asked.join(ranked, "h", "left").select(F.col("k").alias(key), F.coalesce("e", F.lit(-1).cast(no_kind)).alias(entry_key), F.coalesce("s", F.lit(0.0)).alias("score"))


def _glued(split: DataFrame, units: DataFrame) -> DataFrame:
    """Values with their distinct tokens ``ts`` and how often each stands there, ``ms``.

    Two or three neighbours that together write a token of the list are taken as one, unless all are listed themselves.
    """
    single = units.where("not run").select("u")
    runs = lambda k: F.transform(F.sequence(F.lit(0), F.size("seq") - k), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), F.array_join(F.slice("seq", i + 1, k), "").alias("u"), F.slice("seq", i + 1, k).alias("ps")))
    both = F.when(F.size("seq") > 2, F.concat(runs(2), runs(3))).when(F.size("seq") == 2, runs(2))
    hits = split.select("h", F.explode(both).alias("x")).select("h", "x.*").join(single, "u")
    loose = hits.select("h", "i", "k", F.explode("ps").alias("p")).join(single.select(F.col("u").alias("p"), F.lit(True).alias("own")), "p", "left").groupBy("h", "i", "k").agg(F.min(F.coalesce("own", F.lit(False))).alias("all_own"))
    at = loose.where("not all_own").groupBy("h", "i").agg(F.max("k").alias("k")).groupBy("h").agg(F.collect_list(F.struct("i", "k")).alias("at"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            js, ts, ms = [], [], []
            for seq, at_ in zip(b["seq"], b["at"], strict=True):
                glued = glue(list(seq), {x["i"]: x["k"] for x in at_} if at_ is not None else {})
                found = Counter(glued)
                js.append(" ".join(glued))
                ts.append(list(found))
                ms.append(list(found.values()))
            yield pd.DataFrame({"h": b["h"], "n": b["n"], "j": js, "ts": ts, "ms": ms})

    return split.join(at, "h", "left").mapInPandas(write, "h binary, n bigint, j string, ts array<string>, ms array<int>").withColumn("j", F.xxhash64("j"))


def _repairs(counted: DataFrame, units: DataFrame, own_share: float) -> DataFrame:
    """Tokens with the units each may stand for, ``us``, the likeliest first, and the likeliest itself if it's like enough, ``rep``."""

    def signs(words: pd.Series) -> pd.Series:
        return words.map(token_signs)

    signs.__annotations__ = {"words": pd.Series, "return": pd.Series}

    def keys(words: pd.Series, company: pd.Series) -> pd.Series:
        return pd.Series([unit_signs(u, c) for u, c in zip(words, company, strict=True)])

    keys.__annotations__ = {"words": pd.Series, "company": pd.Series, "return": pd.Series}

    def compare(ts: pd.Series, us: pd.Series, company: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([likeness(t, u, c) for t, u, c in zip(ts, us, company, strict=True)], columns=["sure", "slip"])

    compare.__annotations__ = {"ts": pd.Series, "us": pd.Series, "company": pd.Series, "return": pd.DataFrame}
    strings = T.ArrayType(T.StringType())
    named = units.join(counted.select(F.col("t").alias("u"), F.col("c").alias("uc")), "u", "left")
    exact = counted.join(units, F.col("t") == F.col("u")).select("t", F.array(F.struct(F.col("u"), F.lit(1.0).alias("sim"), "parts")).alias("us"), F.col("t").alias("rep"))
    open_tokens = counted.join(units.select(F.col("u").alias("t")), "t", "left_anti")
    left = open_tokens.select("t", "c", F.explode(F.pandas_udf(signs, strings)("t")).alias("sign"))
    right = units.select("u", "company", F.explode(F.pandas_udf(keys, strings)("u", "company")).alias("sign"))
    pairs = left.join(right, "sign").select("t", "c", "u", "company").distinct()
    like = pairs.withColumn("s", F.pandas_udf(compare, "sure double, slip double")("t", "u", "company")).join(named.select("u", "uc", "parts"), "u")
    own = F.col("c") > F.lit(own_share) * (F.coalesce("uc", F.lit(0)) + F.lit(SEEN))
    sim = F.when(own, F.col("s.sure")).otherwise(F.col("s.slip"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("o"), (-F.coalesce("uc", F.lit(0))).alias("f"), "u", "sim", "parts")))
    near = like.withColumn("sim", sim).where("sim > 0").groupBy("t").agg(ordered.alias("x"))
    first = F.get("x", F.lit(0))
    found = near.select("t", F.transform("x", lambda x: F.struct(x["u"].alias("u"), x["sim"].alias("sim"), x["parts"].alias("parts"))).alias("us"), F.when(first["sim"] > 0.5, first["u"]).alias("rep"))
    return exact.unionByName(found)


def _text_counts(worded: DataFrame) -> DataFrame:
    """How often each value occurs, in whatever layout."""
    return worded.select("h", "j").join(worded.groupBy("j").agg(F.sum("n").alias("n")), "j").select("h", "n")


def _entry_counts(worded: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Entries with the number of rows that are an entry but for layout."""
    counts = worded.groupBy("j").agg(F.sum("n").alias("listed_n"))
    return entry_rows.join(counts, "j", "left").select("no", "want", F.coalesce("listed_n", F.lit(0)).alias("listed_n"))
