"""Encoding with a public byte-level BPE vocabulary, by longest matches and backtracking."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearken.session import spread

#: Folder of the public vocabularies; a parameter everywhere.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

#: Fixed value: the public pattern that cuts text into words before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept in a worker's memory, and the longest such word; longer or rarer ones are encoded again.
MEMO_WORDS, MEMO_LENGTH = 300_000, 64


class ByteBPE:
    """Encoder over a rank file. Bytes are mapped to Latin-1 so that the automaton works on text.

    A word's encoding is the only cover by tokens in which any two neighbours are compatible: the merges of the
    two together yield just these two. Tokens are tried longest first at each place; where none is compatible
    with the token before it, the place is marked unreachable and that token is shortened. Every place is marked
    at most once, so the time is linear in the word. Compatibility of neighbours is remembered.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(WORDS)
        self.size = {r: len(b) for b, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (two := self._halve(token, rank, ranks)):
                self.halves[rank] = two
                self.merged.setdefault(two, rank)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _halve(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one: what merging with the earlier ranks alone leaves."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at, low = -1, rank
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < low:
                    at, low = i, r
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are merged together.

        The merges that built both are undone from the last one back; the pair breaks if at some moment the two tokens that
        touch at the border had a merge of an earlier rank than the one undone last.
        """
        known = self.fits.get((left, right))
        if known is None:
            known = self._compatible(left, right)
            if len(self.fits) < 2_000_000:
                self.fits[left, right] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undone so far: ranks at or above ``border``. At equal ranks the left token was merged first.
        border = float("inf")
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < border:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                border, left = left, a[1]
            else:
                # a merge right of the border comes after an equal one left of it
                border, right = right + 0.5, b[0]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.memo.get(word)
        if ids is None:
            ids = tuple(self._encode(word.encode("utf-8", "surrogatepass").decode("latin-1")))
            if len(word) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def _encode(self, text: str) -> list[int]:
        at: list[list[int]] = [[] for _ in range(len(text))]
        for end, rank in self.automaton.iter(text):
            at[end + 1 - self.size[rank]].append(rank)  # shorter tokens come first
        n, pos = len(text), 0
        open_ = [True] * (n + 1)
        out: list[int] = []
        tries = [len(x) - 1 for x in at]
        while pos < n:
            i = tries[pos]
            while i >= 0:
                rank = at[pos][i]
                if open_[pos + self.size[rank]] and (not out or self.compatible(out[-1], rank)):
                    break
                i -= 1
            if i >= 0:
                tries[pos] = i - 1
                out.append(rank)
                pos += self.size[rank]
                if pos < n:
                    tries[pos] = len(at[pos]) - 1
            else:
                open_[pos] = False
                pos -= self.size[out.pop()]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, every string in it ordinary text; of None and an empty text an empty list."""
        if not text:
            return []
        out: list[int] = []
        for m in self.words.finditer(text):
            out += self.word(m[0])
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """One encoder for each file and worker process."""
    return ByteBPE(path)


def encode_texts(docs: DataFrame, *, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``ids`` (array of int), the text's token ids without special tokens.

    One map over the rows, without a shuffle but where the files make fewer tasks than there are cores; the vocabulary is read from ``folder`` by each worker once. Defined
    results: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
    texts of any length are encoded whole; repeated keys give a row each; other columns are ignored.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((x for one in ids for x in one), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
