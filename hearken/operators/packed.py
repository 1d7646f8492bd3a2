"""Several values packed in one field: expectation-maximisation segmentation with Viterbi decoding.

A field is cut into atoms at every candidate mark outside quotes: a parting punctuation character, or a short
word between blanks. How likely a kind of mark parts values is learnt from the whole column: each text is a lattice
of its possible segmentations, weighted by how often their values occur and how often each kind of mark parts. The
likeliest path through its lattice is what a text is parted into.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.session import cut

#: Quote pairs, dash-like marks, parting punctuation and joining words.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
DASHES = "-‐‑‒–—―−~"
PUNCTUATION = ",;|/+&"
JOINERS = ("and", "with", "x", "feat.", "feat", "ft.", "ft", "featuring", "vs.", "vs", "und", "y", "et", "e")

#: Prior weight, as (parts, doesn't), of a punctuation mark, a known joining word and any other short word.
PRIOR = {"punctuation": (50.0, 1.0), "joiner": (20.0, 1.0), "word": (1.0, 20.0)}
#: Weight of values met nowhere else, before it falls tenfold with each word.
UNSEEN = 0.3
WORD = re.compile(r"[^\W\d_]{1,4}\.?|featuring")


def quoted_end(text: str, at: int) -> int:
    """End (exclusive) of the quoted span that opens at ``at``, or -1.

    A span opens at the start, after a blank or a mark, and closes before the end, a blank or a mark; a doubled
    closing quote is part of it.
    """
    close = QUOTES.get(text[at])
    if close is None or at and not (text[at - 1].isspace() or text[at - 1] in PUNCTUATION):
        return -1
    i = at + 1
    while (i := text.find(close, i)) >= 0:
        if text.startswith(close, i + 1) and close == text[at]:
            i += 2
        elif i + 1 == len(text) or text[i + 1].isspace() or text[i + 1] in PUNCTUATION:
            return i + 1
        else:
            i += 1
    return -1


def clean(value: str) -> str:
    """A value trimmed; if one quoted span, without its quotes and with doubled quotes inside made single."""
    value = value.strip()
    if len(value) > 1 and value[0] in QUOTES and quoted_end(value, 0) == len(value):
        close = QUOTES[value[0]]
        value = value[1:-1].replace(close * 2, close).strip()
    return value


#: What may matter in a text: quotes, a tab, punctuation, a dash between blanks, a short word between blanks.
_STOPS = re.compile(rf"[{re.escape(''.join(QUOTES))}\t{re.escape(PUNCTUATION)}]|(?<=\s)[{re.escape(DASHES)}]+(?=\s)|(?<=\s)(?:{WORD.pattern})(?=\s)")


def parse(text: str) -> tuple[list[str], list[str], str | None]:
    """Pieces between candidate marks, the kinds of these marks, and the title after a dash or tab (None without).

    The title begins after the first dash-like mark with blanks on both sides, or tab, outside quotes. Once a quote isn't closed, no
    later one of its kind opens a span.
    """
    pieces: list[str] = []
    marks: list[str] = []
    start = at = 0
    never: set[str] = set()
    while m := _STOPS.search(text, at):
        mark, at = m[0], m.end()
        if mark in QUOTES:
            if mark not in never:
                end = quoted_end(text, m.start())
                if end > 0:
                    at = end
                elif not m.start() or text[m.start() - 1].isspace() or text[m.start() - 1] in PUNCTUATION:
                    never.add(mark)
        elif mark == "\t" or mark[0] in DASHES:
            pieces.append(text[start : m.start()])
            return pieces, marks, text[at:]
        elif mark in PUNCTUATION or mark.islower():
            pieces.append(text[start : m.start()])
            marks.append(mark)
            start = at
    pieces.append(text[start:])
    return pieces, marks, None


def kind_of(mark: str) -> str:
    return "punctuation" if mark in PUNCTUATION else "joiner" if mark in JOINERS else "word"


def places(marks: list[str], longest: int) -> list[tuple[int, int]]:
    """Candidate values, from piece to piece exclusive: all of up to ``longest`` pieces and, however long, all that
    begin or end a run between marks that aren't plain words, and the whole text; so no mark must be cut at."""
    n = len(marks) + 1
    if n == 1:
        return [(0, 1)]
    found: dict[tuple[int, int], None] = {(a, b): None for a in range(n) for b in range(a + 1, min(n, a + longest) + 1)}
    if n > longest:
        start = 0
        for stop in [b for b in range(1, n) if kind_of(marks[b - 1]) != "word"] + [n]:
            found |= {(start, b): None for b in range(start + 1, stop + 1)} | {(a, stop): None for a in range(start, stop)}
            start = stop
        found[0, n] = None
    return sorted(found)


def spans(pieces: list[str], marks: list[str], longest: int) -> Iterator[tuple[int, int, str]]:
    """Candidate values (from piece, to piece exclusive, text), in the order of :func:`places`."""
    for a, b in places(marks, longest):
        yield a, b, clean("".join(p + (marks[j] if j < b - 1 else "") for j, p in enumerate(pieces[a:b], a)))


def expected(k: int, edges: list[tuple[int, int, float]]) -> list[float]:
    """Posterior probability of each edge (a, b, log weight) of a lattice over ``k`` pieces, by forward-backward; edges come in order of a."""
    if k == 1:
        return [1.0]
    fwd, bwd, weights = [1.0] + [0.0] * k, [0.0] * k + [1.0], [math.exp(w) for _, _, w in edges]
    for (a, b, _), w in zip(edges, weights, strict=True):
        fwd[b] += fwd[a] * w
    if fwd[k] < 1e-250:  # too small for plain numbers
        return _expected_logs(k, edges)
    for (a, b, _), w in zip(reversed(edges), reversed(weights), strict=True):
        bwd[a] += bwd[b] * w
    return [fwd[a] * w * bwd[b] / fwd[k] for (a, b, _), w in zip(edges, weights, strict=True)]


def _expected_logs(k: int, edges: list[tuple[int, int, float]]) -> list[float]:
    fwd, bwd = [-math.inf] * (k + 1), [-math.inf] * (k + 1)
    fwd[0] = bwd[k] = 0.0
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf and y > -math.inf else max(x, y)
    for a, b, w in edges:
        fwd[b] = add(fwd[b], fwd[a] + w)
    for a, b, w in reversed(edges):
        bwd[a] = add(bwd[a], bwd[b] + w)
    return [math.exp(fwd[a] + w + bwd[b] - fwd[k]) for a, b, w in edges]


def viterbi(k: int, edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Likeliest path of a lattice whose edges come in order of their start; among equals the one with the later, shorter last values."""
    best = [0.0] + [-math.inf] * k
    came = [-1] * (k + 1)
    for a, b, w in edges:
        if best[a] + w >= best[b]:
            best[b], came[b] = best[a] + w, a
    path, b = [], k
    while b > 0:
        path.append((came[b], b))
        b = came[b]
    return path[::-1]


def split_packed(rows: DataFrame, *, key: str, fields: dict[str, str], rounds: int = 3, longest: int = 8) -> DataFrame:
    """One row for each value packed in the fields: ``key``, ``field_name``, ``pos`` (from 1), ``item_value``.

    ``fields`` maps column names to the field names of the result. ``rounds`` is the number of EM rounds before the decoding,
    ``longest`` the most atoms up to which all spans are weighed as unquoted values; of longer ones those that
    begin or end a run between marks other than plain words, and the whole text (quoted spans are one atom however many marks they hold).

    EM and decoding run over the distinct packed parts, what comes before a title, each counted once however often it occurs. A
    round joins their spans to the values that others have too (one met nowhere else weighs the same whatever its frequency) and to the kinds of
    marks, by 64-bit hashes; the sums combine before they are sent, so a value or mark that holds any share of the rows is one row a task.

    Defined results: null and blank fields give no rows, empty values don't count, a repeated row gives its
    values again under its own key, ties go to the finer split, texts of any length are taken whole, other columns are
    ignored.
    """
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("f"), F.col(c).alias("t")) for c, name in fields.items()]))
    long = rows.select(F.col(key).alias("k"), named.alias("x")).select("k", "x.f", "x.t").where(F.col("t").isNotNull() & F.col("t").rlike(r"\S"))

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, values, titles = [], [], []
            for text in batch["t"]:
                pieces, marks, title = parse(text)
                parts.append("".join(p + m for p, m in zip(pieces, [*marks, ""], strict=True)).strip())
                values.append(clean(parts[-1]))
                titles.append(None if title is None else clean(title))
            yield pd.DataFrame({"t": batch["t"], "part": parts, "value": values, "title": titles})

    parsed = cut(long.select("t").distinct().mapInPandas(head, "t string, part string, value string, title string"))

    def lattice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part in batch["part"]:
                pieces, marks, _ = parse(part)
                out.append((part, [v for _, _, v in spans(pieces, marks, longest)], sorted(set(marks))))
            yield pd.DataFrame(out, columns=["part", "vs", "ms"])

    made = parsed.select("part").distinct().mapInPandas(lattice, "part string, vs array<string>, ms array<string>")
    lattices = cut(made.select(F.monotonically_increasing_id().alias("id"), "part", F.transform("vs", lambda v: F.xxhash64(F.lit("value"), v)).alias("vs"), F.transform("ms", lambda m: F.xxhash64(F.lit("mark"), m)).alias("ms")))
    open_ones = lattices.where(F.size("ms") > 0)

    # Titles and fields with a single atom before the title seed the values. Places from 0 on are spans, -1 and less the marks.
    each = lattices.select("id", F.posexplode("vs").alias("i", "h"), (F.size("ms") == 0).alias("alone"))
    titles = parsed.where("title <> ''").select(F.xxhash64(F.lit("value"), "title").alias("h"), F.lit(True).alias("alone"))
    met = each.select("h", "alone").unionByName(titles).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("alone").cast("double")).alias("n"))
    seeds = cut(met.where("c > 1").select("h", "n"))
    of_marks = open_ones.select("id", F.posexplode("ms").alias("i", "h")).select("id", (-1 - F.col("i")).alias("i"), "h")
    shared = cut(each.where("not alone").select("id", "i", "h").join(seeds.select("h"), "h", "left_semi").unionByName(of_marks))
    counts = seeds.select("h", "n", F.lit(0.0).alias("other"))
    mine = shared.select("id", "i", "h", F.lit(0.0).alias("p"))
    alone = total = float(lattices.where(F.size("ms") == 0).count() + parsed.where("title <> ''").count())
    for r in range(rounds + 1):
        own = F.when(F.col("i") >= 0, F.col("p")).otherwise(0.0)
        known = mine.join(counts, "h", "left").select("id", "i", "h", (F.coalesce("n", F.lit(0.0)) - own).alias("n"), F.coalesce("other", F.lit(0.0)).alias("other"))
        read = open_ones.select("id", "part").join(known.groupBy("id").agg(*[F.collect_list(c).alias(c) for c in ("i", "h", "n", "other")]), "id")
        if r == rounds:
            decoded = read.mapInPandas(_decoder(longest, total), "part string, items array<string>")
            break
        told = cut(read.mapInPandas(_expecter(longest, total), "id bigint, i int, h bigint, p double, other double"))
        total = alone + float(told.where("h is null").agg(F.sum("p")).first()[0] or 0.0)
        fresh = told.where("h is not null").groupBy("h").agg(F.sum("p").alias("n"), F.sum("other").alias("other"))
        counts = cut(fresh.join(seeds.select("h", F.col("n").alias("seed")), "h", "full").select("h", (F.coalesce("n", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0))).alias("n"), F.coalesce("other", F.lit(0.0)).alias("other")))
        mine = told.where("h is not null").select("id", "i", "h", "p")
    whole = parsed.join(decoded, "part", "left")
    items = F.coalesce("items", F.array("value"))
    with_title = F.filter(F.concat(items, F.when(F.col("title").isNull(), F.array().cast("array<string>")).otherwise(F.array("title"))), lambda v: v != "")
    return long.join(whole.select("t", with_title.alias("items")), "t").select(F.col("k").alias(key), F.col("f").alias("field_name"), F.posexplode("items").alias("pos", "item_value")).select(key, "field_name", (F.col("pos") + 1).alias("pos"), "item_value")


def _edges(part: str, at: list[int], ns: list[float], others: list[float], longest: int, total: float) -> tuple[list[str], list[str], list[tuple[int, int, float]], list[str]]:
    """Pieces, marks, weighted edges and kinds of marks of a packed part, given what is known of its spans and marks, by their places."""
    pieces, marks, _ = parse(part)
    kinds = sorted(set(marks))
    seen = dict(zip(at, ns, strict=True))
    against = {i: x for i, x in zip(at, others, strict=True) if i < 0}
    chance = {}
    for j, m in enumerate(kinds):
        yes, no = PRIOR[kind_of(m)]
        yes, no = yes + max(0.0, seen.get(-1 - j, 0.0)), no + max(0.0, against.get(-1 - j, 0.0))
        chance[m] = min(1 - 1e-9, max(1e-9, yes / (yes + no)))
    held, words, cut_at = [0.0], [0], []
    for p, m in zip(pieces, [*marks, " "], strict=True):
        words.append(words[-1] + len(p.split()))
        if m != " ":
            cut_at.append(math.log(chance[m]))
            held.append(held[-1] + math.log(1 - chance[m]))
    alphas = [0]
    for m in marks:
        alphas.append(alphas[-1] + m[0].isalpha())
    cut_at.append(0.0)
    known = (1 - UNSEEN) / max(total, 1.0)
    out = []
    for i, (a, b) in enumerate(places(marks, longest)):
        n_words = words[b] - words[a] + alphas[b - 1] - alphas[a]
        # What a text itself added to a value doesn't count for it. A value met nowhere else has a base probability that falls with its words.
        share = max(0.0, seen.get(i, 0.0)) * known + (UNSEEN * 10.0 ** -max(1, n_words) if n_words < 300 else 0.0)
        weight = -1.0 if n_words == 0 else math.log(share) if share > 0 else math.log(UNSEEN) - n_words * math.log(10.0)
        out.append((a, b, weight + held[b - 1] - held[a] + cut_at[b - 1]))
    return pieces, marks, out, kinds


def _expecter(longest: int, total: float):
    """E-step: for each shared span its probability, for each kind of mark how often it parts and how often it doesn't; without place, the values of a part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, at, hs, ps, others = [], [], [], [], []
            for id_, part, i_s, h_s, ns, os in zip(batch["id"], batch["part"], batch["i"], batch["h"], batch["n"], batch["other"], strict=True):
                i_s = i_s.tolist()
                _, marks, edges, kinds = _edges(part, i_s, ns.tolist(), os.tolist(), longest, total)
                probability = expected(len(marks) + 1, edges)
                cuts = [0.0] * (len(marks) + 1)
                for (_, b, _), p in zip(edges, probability, strict=True):
                    cuts[b - 1] += p
                # A text counts once for a kind of mark however often it holds it.
                often, parts = Counter(marks), dict.fromkeys(kinds, 0.0)
                for m, p in zip(marks, cuts, strict=False):
                    parts[m] += min(1.0, p) / often[m]
                ids += [id_] * (len(i_s) + 1)
                at += [*i_s, None]
                hs += [*h_s.tolist(), None]
                ps += [*(probability[i] if i >= 0 else parts[kinds[-1 - i]] for i in i_s), sum(probability)]
                others += [*(0.0 if i >= 0 else 1.0 - parts[kinds[-1 - i]] for i in i_s), 0.0]
            yield pd.DataFrame({"id": ids, "i": pd.array(at, dtype="Int32"), "h": pd.array(hs, dtype="Int64"), "p": ps, "other": others})

    return run


def _decoder(longest: int, total: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = []
            for part, i_s, ns, os in zip(batch["part"], batch["i"], batch["n"], batch["other"], strict=True):
                pieces, marks, edges, _ = _edges(part, i_s.tolist(), ns.tolist(), os.tolist(), longest, total)
                path = viterbi(len(marks) + 1, edges)
                items.append([clean(pieces[a] if b == a + 1 else "".join(p + (marks[j] if j < b - 1 else "") for j, p in enumerate(pieces[a:b], a))) for a, b in path])
            yield pd.DataFrame({"part": batch["part"], "items": items})

    return run
