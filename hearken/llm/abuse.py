"""Scores for abusive, hateful or sexual content by weak supervision.

Many lexicon and pattern voters vote on every sentence; a generative label model learns from their agreement how far
each can be trusted, joining voters that depend on each other into blocks; a linear classifier is trained on its
posterior labels and scores every sentence; a text scores as its worst sentence.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm.listmatch import typos
from hearken.session import cut, spread

#: Word lists, folded to one case without accents. They are offensive by nature.
INSULTS = frozenset(
    "arse arsehole asshole assholes bastard bastards bitch bitches clown clowns cretin cunt dickhead dumbass dumbasses dunce fool halfwit halfwits idiot idiots imbecile imbeciles jackass jerk loser losers moron morons parasite parasites pig pigs prick retard scum scumbag scumbags slut sluts twat wanker whore whores".split()
)
DEGRADING = frozenset("brainless disgusting filthy fucking miserable pathetic stupid ugly useless vile worthless".split())
SEXUAL = frozenset("blowjob boobs breasts cock cum cumming erotic fuck fucked fucks hardcore horny moaning naked nude nudes orgasm porn pussy sex sexy thighs tits".split())
VIOLENT = frozenset("beat beaten break burn choke cut hang hurt kill murder punch rape shoot slit smash stab strangle".split())
VERMIN = frozenset("animals cockroaches pests rats subhuman vermin".split())
FOREIGN = frozenset("arsch arschloch asco basura boca cabron calla callate chasse connard crever degage desgracado drecksau dreckiges encule gueule hure idiota imbecil inutil lixo maul merda merde meprise mierda nojento ordure plaga praga puta ratas salope scheisse ungeziefer vermes vermine vertrieben wichser".split())
MUSIC = frozenset("album albums band bass beat breakdown chorus concert cover demo drummer drums gig groove guitar guitarist lyric lyrics melody mix music musician piano playlist record recording records riff singer single solo song songs sound take title tour track tracks tune verse vinyl vocals".split())
YOU = frozenset("you your yourself youre u ur du dein deine dich tu te toi ta eres voce seu sua".split())
THEM = frozenset("all them these they those".split())
SELF = frozenset("i me my mine myself".split())
BODY = frozenset("ass body boobs breasts chest crotch groin hips lap lips mouth neck nipples skin thighs tits waist".split())
BARE = frozenset("bare hot naked nude sexy undressed wet".split())
SHOWN = frozenset("cam cams girls photos pics pictures show video videos webcam".split())
OBSCENE = frozenset("cunt fuck fucked fucking fucks".split())
CAST_OUT = frozenset("banned belong breed deported exterminated inferior removed subhuman thieves thrown wipe wiped".split())
MENTION = frozenset("author book called chapter character chorus entitled film headline line lyric lyrics movie named novel phrase plot poem quote quoted quotes quoting scene story title titled titles verse word words".split())
RULE = frozenset("avoid careful discuss discussion education guideline guidelines history moderator moderators policy posts remove report research rule rules study studies survey training".split())
PRAISE = frozenset("adore amazing best brilliant favourite favorite glorious great highest love loved masterpiece perfect praise wonderful".split())
LEXICON = INSULTS | DEGRADING | SEXUAL | VERMIN | frozenset("yourself mouth".split())

#: Everyday words one letter away from a listed one, for inputs too small to tell by their frequency.
EVERYDAY = frozenset("close cold cook dock fold food fool home hold house lose month months morning north posts rate rates rest role south test tests that there these those what where while whole".split()) - LEXICON

_TAG = re.compile(r"<[^<>]{0,400}>")
_UNSEEN = regex.compile(r"\p{Cf}+")
_STOP = re.compile(r"[.!?…。！？\n\r](?:(?<=[.!?…])(?:\s+|(?<=[a-z][.!?])(?=[A-Z]))|(?<=[。！？\n\r])[。！？\n\r]*)")
_IN = r"(?:[\w@$*]|[!|](?=[\w@$*]))+"
_TOKEN = re.compile(rf"{_IN}(?:['’\-.]{_IN})*")
_SPELT = re.compile(r"(?<!\w)(?:\w[\-. ]){2,}\w(?!\w)")
_LEET = str.maketrans("@013457$!|", "aoieastsil")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
#: Words of a unit, and of the step between units of a longer sentence.
UNIT, STEP = 24, 12


def _deletes(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


@lru_cache(maxsize=1)
def _repairs() -> dict[str, list[str]]:
    by: dict[str, list[str]] = defaultdict(list)
    for w in sorted(LEXICON):
        if len(w) > 3:
            for d in _deletes(w):
                by[d].append(w)
    return by


#: A word, its hash, and the kinds of word it is (bits of :data:`KINDS`, then of :data:`NEEDS` for its parts).
Token = tuple[str, int, int]


def as_token(word: str) -> Token:
    kinds = _WHOLE.get(word, 0)
    for part in (word,) if word.isalnum() else re.split(r"\W+", word):
        kinds |= _PART.get(part, 0)
    return word, zlib.crc32(word.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF, kinds


class Speller:
    """Tokens in plain spelling: figures and signs for letters, masked, stretched or mistyped words of the lexicon undone.

    ``own`` are words near a listed one that are words of their own.
    """

    def __init__(self, own: frozenset[str] = EVERYDAY) -> None:
        self.own = own
        self.memo: dict[str, list[Token]] = {}

    def __call__(self, chunk: str) -> list[Token]:
        """Words of a stretch without blanks."""
        found = self.memo.get(chunk)
        if found is None:
            if len(self.memo) >= 300_000:
                self.memo.clear()
            found = self.memo[chunk] = [as_token(self.word(t)) for t in ((chunk,) if chunk.isalnum() else _TOKEN.findall(_joined_up(chunk)))]
        return found

    def word(self, token: str) -> str:
        return token if token in LEXICON else self._plain(token)

    def _plain(self, token: str) -> str:
        if token.isalpha():
            once = _RUN.sub(r"\1", token)
            return once if once in LEXICON else self.slip(once) or once
        token = token.lstrip("*")
        if "*" in token and "*" not in token.rstrip("*") and not token.endswith("**"):
            token = token.rstrip("*")
        if token in LEXICON or not token:
            return token
        if "*" in token:
            shape = re.compile("".join("[a-z]" if c == "*" else re.escape(c) for c in token.translate(_LEET)))
            return min((w for w in LEXICON if len(w) == len(token) and shape.fullmatch(w)), default="masked")
        plain = token
        if re.search(r"[@$!|\d]", token) and re.search(r"[a-z]", token):
            plain = token.translate(_LEET)
        plain = re.sub(r"[\-.'’]", "", plain) if re.fullmatch(r"\w(?:[\-.]\w)+", plain) else plain
        once = _RUN.sub(r"\1", plain)
        for form in (plain, once):
            if form in LEXICON:
                return form
        return self.slip(once) or (once if once != plain else token)

    def slip(self, word: str) -> str | None:
        """The listed word that a word is with one slip, first letter kept."""
        if word in self.own or word in FOREIGN or not 3 < len(word) < 20 or word == word.rstrip("s") + "s" and word.rstrip("s") in self.own:
            return None
        return min((w for d in _deletes(word) for w in _repairs().get(d, ()) if w[0] == word[0] and typos(word, w, 1) <= 1), default=None)


def _joined_up(text: str) -> str:
    """Words spelt out letter by letter as one."""
    return _SPELT.sub(lambda m: re.sub(r"[\-. ]", "", m[0]), text) if len(text) > 4 else text


#: Chunks that end a sentence and a text; no text can hold them.
_CUT, _END = "\ud800", "\ud801"
#: Characters read at once, and chunks remembered.
AT_ONCE, REMEMBERED = 400_000, 300_000


def _unmarked(text: str | None) -> str:
    """A text without markup and invisible characters."""
    if not text:
        return ""
    plain = html.unescape(text) if "&" in text else text
    plain = _TAG.sub(" ", plain) if "<" in plain else plain
    return plain if plain.isascii() else _UNSEEN.sub("", unicodedata.normalize("NFKC", plain))


def _folded(chunk: str) -> str:
    """One case, without accents."""
    folded = chunk.casefold()
    return folded if folded.isascii() else "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


@dataclass
class Units:
    """Units of many texts, one after the other: units of each text, words of each unit, votes of each unit, and the words' hashes."""

    counts: np.ndarray
    lens: np.ndarray
    marks: np.ndarray
    hashes: np.ndarray
    words: list[str]


class Reader(dict):
    """Numbers of the chunks (stretches without blanks) met so far; texts are read many at once by looking up what is known of each chunk."""

    def __init__(self, spell: Speller) -> None:
        super().__init__()
        self.spell = spell
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.forms: list[str] = []
        self.words: list[str] = []
        #: Of each chunk: its first word, how many it has, and its letters that stand alone; of each word: its hash and kinds.
        self.first, self.many, self.alone, self.hashes, self.kinds = array("q"), array("q"), array("q"), array("i"), array("q")
        for end in (_CUT, _END):
            self[end] = self._number("", [])

    def _number(self, form: str, tokens: list[Token]) -> int:
        self.forms.append(form)
        self.first.append(len(self.words))
        self.many.append(len(tokens))
        self.alone.append(sum(len(c) == 1 for c in form.split()))
        for word, code, kinds in tokens:
            self.words.append(word)
            self.hashes.append(code)
            self.kinds.append(kinds)
        return len(self.forms) - 1

    def __missing__(self, chunk: str) -> int:
        form = _folded(chunk)
        self[chunk] = number = self._number(form, [t for c in form.split() for t in self.spell(c)])
        return number

    def read(self, texts: Sequence[str | None]) -> Units:
        """The sentences of texts in plain spelling; longer ones as overlapping runs of words."""
        if len(self) > REMEMBERED:
            self.forget()
        chunks = _STOP.sub(f" {_CUT} ", "".join(f"{_unmarked(t)} {_END} " for t in texts)).split()
        ids = self._spelt(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
        first, many, codes, kinds = (np.array(a) for a in (self.first, self.many, self.hashes, self.kinds))
        ends = np.flatnonzero(ids < 2)
        of_text = np.cumsum(ids[ends] == 1) - (ids[ends] == 1)
        sizes = many[ids]
        upto = np.append(0, np.cumsum(sizes))[ends]
        size = np.diff(upto, prepend=0)
        runs = np.where(size > UNIT, (size - 1) // STEP, np.minimum(size, 1))
        skipped = STEP * _ranges(np.zeros(len(runs), dtype=np.int64), runs)
        lens = np.minimum(UNIT, np.repeat(size, runs) - skipped)
        said = _ranges(first[ids], sizes)[_ranges(np.repeat(upto - size, runs) + skipped, lens)]
        marks = _marks(kinds[said], lens, lambda a, b: [self.words[i] for i in said[a:b].tolist()])
        return Units(np.bincount(np.repeat(of_text, runs), minlength=len(texts)), lens, marks, codes[said], [self.words[i] for i in said.tolist()] if len(texts) == 1 else [])

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        """The chunks with words spelt out letter by letter as one."""
        ends = np.flatnonzero(ids < 2)
        alone = np.add.reduceat(np.array(self.alone)[ids], np.append(0, ends[:-1] + 1))
        out, done = [], 0
        for i in np.flatnonzero(alone > 2).tolist():
            a, b = int(ends[i - 1]) + 1 if i else 0, int(ends[i])
            plain = " ".join(c for j in ids[a:b].tolist() for c in self.forms[j].split())
            joined = _joined_up(plain)
            if joined != plain:
                out += [ids[done:a], np.array([self[c] for c in joined.split()], dtype=np.int64)]
                done = b
        return np.concatenate([*out, ids[done:]]) if out else ids


def units(text: str, spell: Speller) -> list[list[Token]]:
    """The units of one text."""
    found = Reader(spell).read([text])
    words = iter(found.words)
    return [[as_token(next(words)) for _ in range(n)] for n in found.lens.tolist()]


def _near(words: list[str], a: frozenset, b: frozenset, reach: int) -> bool:
    at = [i for i, w in enumerate(words) if w in a]
    return bool(at) and any(w in b and any(0 < abs(i - j) <= reach for j in at) for i, w in enumerate(words))


def _has(pattern: str) -> Callable[[str, list[str]], bool]:
    found = re.compile(pattern)
    return lambda text, words: bool(found.search(text))


def _any_of(*lists: frozenset) -> str:
    return "|".join(sorted(frozenset().union(*lists)))


_INS, _DEG, _VIO = _any_of(INSULTS), _any_of(DEGRADING, frozenset({"dumb", "low", "thick"})), _any_of(VIOLENT)
#: Voters in order: name, what they vote for (1 abusive, 0 not), and when they vote, given a unit as text and its words.
VOTERS: list[tuple[str, int, Callable[[str, list[str]], bool]]] = [
    ("insult beside you", 1, lambda t, w: _near(w, INSULTS, YOU, 6)),
    ("degrading word beside you", 1, lambda t, w: _near(w, DEGRADING, YOU, 5)),
    ("degrading word before insult", 1, _has(rf"\b({_DEG}) ({_INS})\b")),
    ("people called by an insult", 1, _has(rf"\b(what|such|you|these|those|bunch of|pack of|full of) (an? )?(\w+ )?({_INS}|{_any_of(VERMIN)})\b")),
    ("little but an insult", 1, lambda t, w: len(w) <= 4 and not INSULTS.isdisjoint(w)),
    ("order to be silent or go", 1, _has(r"\b(shut (up|your)|get (lost|out)|crawl back|go (away|to hell|back to)|drop dead|kill yourself)\b")),
    ("threat", 1, _has(rf"\b(will|should|shall|gonna|going to) (\w+ ){{0,8}}({_VIO}) (you|your|them|him|her|those|these)\b")),
    ("harm deserved", 1, _has(rf"\b(deserves?|ought|needs?|should) (to )?(be|get|have been) ({_VIO}|dead|shot)\b|\bhope (you|they) (\w+ )?(die|rot|suffer|{_VIO})\b")),
    ("people as vermin", 1, lambda t, w: _near(w, VERMIN, THEM | frozenset({"are", "breed", "like"}), 5)),
    ("people cast out", 1, lambda t, w: _near(w, CAST_OUT, THEM | frozenset({"people", "country", "here", "human"}), 6)),
    ("nobody wants you", 1, _has(r"\b(nobody|no one) (\w+ )?(wants|likes|loves|needs|misses) you\b|\b(ashamed of|sick of|hate) you\b|\bthan human\b|\bnever trust (the|those|these|them)\b")),
    ("too low to", 1, _has(rf"\b(too|so) ({_DEG}) (to|that)\b")),
    ("sexual words", 1, lambda t, w: len(SEXUAL.intersection(w)) >= 2),
    ("body laid bare", 1, lambda t, w: _near(w, BODY | frozenset({"clothes", "bed"}), SEXUAL | BARE, 6)),
    ("sexual offer", 1, lambda t, w: _near(w, BARE | SEXUAL, SHOWN, 3)),
    ("obscene word", 1, lambda t, w: not OBSCENE.isdisjoint(w)),
    ("abuse in other languages", 1, lambda t, w: len(FOREIGN.intersection(w)) >= 2 or _near(w, FOREIGN, YOU, 6)),
    ("about music", 0, lambda t, w: not MUSIC.isdisjoint(w) and YOU.isdisjoint(w)),
    ("about oneself", 0, lambda t, w: _near(w, INSULTS | DEGRADING, SELF, 3) and YOU.isdisjoint(w)),
    ("a mention", 0, lambda t, w: not MENTION.isdisjoint(w)),
    ("a rule or a study", 0, lambda t, w: not RULE.isdisjoint(w)),
    ("praise", 0, lambda t, w: not PRAISE.isdisjoint(w)),
]
POSITIVE = sum(1 << i for i, (_, side, _) in enumerate(VOTERS) if side)
#: Words of which some stand in every unit a positive voter votes on; the weak ones count beside "you" only.
WEAK = frozenset("back die get go nobody one".split())
TRIGGERS = LEXICON | INSULTS | DEGRADING | SEXUAL | VIOLENT | VERMIN | FOREIGN | BODY | BARE | CAST_OUT | frozenset("ashamed bed clothes crawl dead drop dumb hate human lost low out rot shut sick suffer thick trust".split())


#: Kinds of words that decide votes by themselves.
KINDS = (TRIGGERS, MUSIC, MENTION, RULE, PRAISE, YOU, WEAK, INSULTS, OBSCENE)
_DEGRADED = DEGRADING | frozenset({"dumb", "low", "thick"})
#: Of each voter that goes by the order of words: lists of which words, or parts of words, must stand in any unit it votes on.
NEEDED: dict[str, tuple[frozenset[str], ...]] = {
    "insult beside you": (INSULTS, YOU),
    "degrading word beside you": (DEGRADING, YOU),
    "degrading word before insult": (_DEGRADED, INSULTS),
    "people called by an insult": (frozenset("what such you these those bunch pack full".split()), INSULTS | VERMIN),
    "order to be silent or go": (frozenset("shut get crawl go drop kill".split()),),
    "threat": (frozenset("will should shall gonna going".split()), VIOLENT, frozenset("you your them him her those these".split())),
    "harm deserved": (frozenset("deserve deserves ought need needs should hope".split()), VIOLENT | frozenset("dead shot die rot suffer".split())),
    "people as vermin": (VERMIN, THEM | frozenset({"are", "breed", "like"})),
    "people cast out": (CAST_OUT, THEM | frozenset({"people", "country", "here", "human"})),
    "nobody wants you": (frozenset("nobody one ashamed sick hate human trust".split()), frozenset("you than never".split())),
    "too low to": (frozenset({"too", "so"}), _DEGRADED),
    "sexual words": (SEXUAL,),
    "body laid bare": (BODY | frozenset({"clothes", "bed"}), SEXUAL | BARE),
    "sexual offer": (BARE | SEXUAL, SHOWN),
    "abuse in other languages": (FOREIGN,),
    "about oneself": (INSULTS | DEGRADING, SELF),
}
NEEDS = list(dict.fromkeys(need for needs in NEEDED.values() for need in needs))
_BIT = {need: 1 << len(KINDS) + i for i, need in enumerate(NEEDS)}
_WHOLE = {word: sum(1 << i for i, kind in enumerate(KINDS) if word in kind) for word in frozenset().union(*KINDS)}
_PART = {word: sum(bit for need, bit in _BIT.items() if word in need) for word in frozenset().union(*NEEDS)}


def _marks(kinds: np.ndarray, lens: np.ndarray, words: Callable[[int, int], list[str]]) -> np.ndarray:
    """Bit masks of the voters that vote on units, from the kinds of their words and, where order matters, the words between two places."""
    marks = np.zeros(len(lens), dtype=np.int32)
    if not len(lens):
        return marks
    ends = np.cumsum(lens)
    met = np.bitwise_or.reduceat(kinds, ends - lens)
    trigger, music, mention, rule, praise, you, _, insult, obscene = ((met >> i) & 1 == 1 for i in range(len(KINDS)))
    told = trigger | (met & 96 == 96)
    alone = {"little but an insult": told & insult & (lens <= 4), "obscene word": told & obscene, "about music": music & ~you, "a mention": mention, "a rule or a study": rule, "praise": praise}
    seen: dict[int, tuple[str, list[str]]] = {}
    for v, (name, _, when) in enumerate(VOTERS):
        if name in alone:
            marks |= alone[name].astype(np.int32) << v
            continue
        may = told.copy()
        for need in NEEDED[name]:
            may &= met & _BIT[need] != 0
        for i in np.flatnonzero(may).tolist():
            if i not in seen:
                said = words(int(ends[i] - lens[i]), int(ends[i]))
                seen[i] = " ".join(said), said
            if when(*seen[i]):
                marks[i] |= 1 << v
    return marks


def votes(unit: Sequence[Token]) -> int:
    """Bit mask of the voters that vote on a unit."""
    return int(_marks(np.array([t[2] for t in unit], dtype=np.int64), np.array([len(unit)]), lambda a, b: [t[0] for t in unit[a:b]])[0])


@dataclass
class LabelModel:
    """Probability of each block's joint vote in each class (its joint votes that were met, and each voter's own), and of the class."""

    blocks: list[list[int]]
    tables: list[dict[int, tuple[float, float]]]
    single: np.ndarray
    prior: float

    def posterior(self, mask: int, rated: int | None = None) -> float:
        """Probability that a unit with these votes (a voter that says nothing says nothing about it), in a text a rater called abusive (1), not (0) or didn't see (None), is abusive."""
        odds = math.log(self.prior / (1 - self.prior))
        for block, tab in zip(self.blocks, self.tables, strict=True):
            if joint := _joint(mask, block):
                p1, p0 = tab.get(joint) or _independent(mask, block, self.single)
                odds += math.log(p1 / p0)
        if rated is not None:
            odds += math.log(RATER / (1 - RATER)) * (1 if rated else -1)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _independent(mask: int, block: list[int], single: np.ndarray) -> tuple[float, float]:
    fires = [(mask >> v) & 1 for v in block]
    return tuple(float(np.prod([single[c, v] if f else 1 - single[c, v] for v, f in zip(block, fires, strict=True)])) for c in (0, 1))


def _joint(mask: int, block: list[int]) -> int:
    return sum(((mask >> v) & 1) << k for k, v in enumerate(block))


#: Prior of a voter for abuse: the share of its votes that are right, worth as many votes as it has cast.
PRECISION = 0.85
#: Prior of a voter against, the topic and the others: how often it votes in an abusive unit for once overall, worth so many times the units there are.
TOPIC, SELDOM, TRUSTED = 0.5, 0.1, 30.0
_SELDOM = np.array([TOPIC if name == "about music" else SELDOM for name, _, _ in VOTERS])
#: Units that a rated one is worth where rates are learnt.
RATED = 4.0
#: Share of a rater's labels that are right, and the least share of abusive units.
RATER, LEAST = 0.95, 1e-4


def fit_labels(counts: dict[tuple[int, int | None], int], *, rounds: int = 40, dependence: float = 0.35) -> LabelModel:
    """Label model from the counts of vote patterns with what a rater said of their texts (1, 0 or None), by EM from the balance of votes.

    The share of abusive units is that among the units some voter for abuse votes on; how often each voter votes in each class is learnt, from a prior that grows with its votes and so never gives way to sheer size.
    The first fit takes voters
    as independent within a class. Voters whose votes still correlate within a class (absolute
    phi above ``dependence``) are then joined into blocks, whose joint votes are modelled as one, and the model is fitted again.
    """
    patterns = sorted(counts, key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    side = np.array([s for _, s, _ in VOTERS])
    blocks = [[v] for v in range(len(VOTERS))]
    start = np.stack([np.where(side == 1, 0.1, 0.01), np.where(side == 1, 0.001, 0.05)])
    if not patterns:
        return LabelModel(blocks, [{} for _ in blocks], start, LEAST)
    masks = [m for m, _ in patterns]
    n = np.array([counts[p] for p in patterns], dtype=float)
    bits = np.array([[(m >> v) & 1 for v in range(len(VOTERS))] for m in masks], dtype=float)
    worth = n * np.array([1.0 if rated is None else RATED for _, rated in patterns])
    cast, seen = worth @ bits, bits @ side > 0
    # At the start a vote against outweighs any one vote for.
    balance = bits @ np.where(side == 1, 1.0, 0.0) - 1.5 * (bits @ np.where(side == 1, 0.0, 1.0) > 0)
    post = np.where(bits @ side > 0, np.where(balance > 0, 0.9, 0.1), 0.001)
    model = LabelModel(blocks, [], start, LEAST)
    for stage in range(2):
        joint = [np.array([_joint(m, block) for m in masks]) for block in blocks]
        for _ in range(rounds):
            weights = np.stack([worth * post, worth * (1 - post)])
            total = weights.sum(axis=1) + 1e-9
            single = _rates(weights @ bits, cast, side, _SELDOM, total)
            tables = []
            for block, values in zip(blocks, joint, strict=True):
                kinds, at = np.unique(values, return_inverse=True)
                together = _rates(np.stack([np.bincount(at, w) for w in weights]), np.bincount(at, worth), side[block[0]], np.array([min([_SELDOM[v] for k, v in enumerate(block) if x >> k & 1], default=1.0) for x in kinds.tolist()]), total)
                tables.append({value: (float(p1), float(p0)) for value, p1, p0 in zip(kinds.tolist(), *together, strict=True)})
            model = LabelModel(blocks, tables, single, float(np.clip((n * post)[seen].sum() / n.sum(), LEAST, 0.5)))
            post = np.array([model.posterior(*p) for p in patterns])
        if stage == 0:
            blocks = _blocks(bits, n, post, dependence)
    return model


def _rates(met: np.ndarray, cast: np.ndarray, side: np.ndarray, seldom: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often votes (columns) are met in either class, given how often they were so far and were cast, and the size of the classes; with their priors."""
    rate, overall = met / total[:, None], cast / total.sum()
    for_it = np.stack([met[0] + PRECISION * cast, met[1] + (1 - PRECISION) * cast]) / 2 / total[:, None]
    against = (rate + TRUSTED * np.stack([seldom * overall, overall])) / (1 + TRUSTED)
    return np.clip(np.where(side == 1, for_it, against) + 1 / total.sum(), 1e-9, 0.95)


def _blocks(bits: np.ndarray, n: np.ndarray, post: np.ndarray, dependence: float) -> list[list[int]]:
    heads = list(range(bits.shape[1]))
    found = []
    for w in (n * post, n * (1 - post)):
        total = w.sum()
        if total <= 0:
            continue
        mean = (w[:, None] * bits).sum(0) / total
        cov = (bits * w[:, None]).T @ bits / total - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        phi = cov / np.outer(sd, sd)
        found += [(abs(float(phi[i, j])), i, j) for i in range(len(mean)) for j in range(i) if VOTERS[i][1] == VOTERS[j][1] and mean[i] > 1e-4 and mean[j] > 1e-4]

    def head(i: int) -> int:
        while heads[i] != i:
            i = heads[i]
        return i

    for strength, i, j in sorted(found, reverse=True):
        a, b = head(i), head(j)
        if strength > dependence and a != b:
            heads[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = defaultdict(list)
    for i in range(bits.shape[1]):
        groups[head(i)].append(i)
    return list(groups.values())


#: Size of the hashed feature space of words and pairs of neighbours; the votes come after it, the bias last.
DIMENSIONS = 1 << 17
PLACES = DIMENSIONS + len(VOTERS) + 1
_PAIR = np.uint32(0x85EBCA6B)
#: Steps of the sums over all sentences: whole numbers of these add up the same in any order.
GRAIN = float(1 << 20)
#: Bytes of hashes taken at once, and sums sent as one.
HELD, BLOCK = 2_000_000, 4096


class Features:
    """Words, pairs of neighbours and votes of units one after the other; in long units each counts less."""

    def __init__(self, hashes: np.ndarray, lens: np.ndarray, marks: np.ndarray) -> None:
        self.lens, self.starts = lens, np.cumsum(lens) - lens
        h = hashes.astype(np.uint32)
        with np.errstate(over="ignore"):
            pairs = (h * _PAIR) ^ (np.append(h[1:], np.uint32(0)) + np.uint32(0x9E3779B9))
        self.words = (h & np.uint32(DIMENSIONS - 1)).astype(np.intp)
        self.pairs = ((pairs ^ (pairs >> np.uint32(15))) & np.uint32(DIMENSIONS - 1)).astype(np.intp)
        self.last = self.starts + lens - 1
        self.bits = ((marks[:, None] >> np.arange(len(VOTERS))[None, :]) & 1).astype(float)
        self.scale = np.sqrt(np.minimum(1.0, 8.0 / (2 * lens - 1 + self.bits.sum(axis=1))))

    def odds(self, weight: np.ndarray) -> np.ndarray:
        """Log odds of each unit."""
        beside = weight[self.pairs]
        beside[self.last] = 0.0
        votes = np.zeros(len(self.lens))
        for v in range(len(VOTERS)):
            votes += self.bits[:, v] * weight[DIMENSIONS + v]
        return self.scale * (np.add.reduceat(weight[self.words], self.starts) + np.add.reduceat(beside, self.starts) + votes) + weight[-1]

    def sums(self, each: np.ndarray, power: int = 1) -> np.ndarray:
        """Sums over the units, at each place, of what each unit has, times a power of its features; in whole grains."""
        share = np.rint(each * self.scale**power * GRAIN)
        spread = np.repeat(share, self.lens)
        total = np.bincount(self.words, spread, minlength=PLACES)
        spread[self.last] = 0.0
        total += np.bincount(self.pairs, spread, minlength=PLACES)
        total[DIMENSIONS:-1] = (self.bits * share[:, None]).sum(axis=0)
        total[-1] = np.rint(each * GRAIN).sum()
        return total


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -50.0, 50.0)))


#: A pass over all sentences: weights to loss, gradient and, if asked for, curvature.
Pass = Callable[[np.ndarray, bool], tuple[float, np.ndarray, np.ndarray]]


def fit_linear(over_all: Pass, prior: float, *, passes: int = 9, shrink: float = 1.0, memory: int = 8) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by quasi-Newton steps (L-BFGS) over sums from all sentences; the last weight is the bias.

    Steps start from the curvature at each place. A step that doesn't lower the loss is shortened. The weights after ``passes`` passes are taken.
    """

    def penalised(weight: np.ndarray, curved: bool) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = over_all(weight, curved)
        free = np.append(weight[:-1], 0.0)
        return loss + shrink / 2 * float(free @ free), slope + shrink * free, curve

    weight = np.zeros(PLACES)
    weight[-1] = math.log(prior / (1 - prior))
    loss, slope, curve = penalised(weight, True)
    curve = curve + shrink
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    done, first = 1, 0.25
    while done < passes and np.abs(slope).max() > 1e-3:
        way, factors = slope.copy(), []
        for moved, turned in reversed(moves):
            factors.append(float(moved @ way) / float(moved @ turned))
            way -= factors[-1] * turned
        way *= (float(moves[-1][0] @ moves[-1][1]) / float(moves[-1][1] @ (moves[-1][1] / curve)) if moves else 1.0) / curve
        for (moved, turned), factor in zip(moves, reversed(factors), strict=True):
            way += (factor - float(turned @ way) / float(moved @ turned)) * moved
        step, first = first, 1.0
        while done < passes:
            ahead = weight - step * way
            less, then, _ = penalised(ahead, False)
            done += 1
            if less < loss:
                moved, turned = ahead - weight, then - slope
                if float(moved @ turned) > 1e-9:
                    moves = [*moves, (moved, turned)][-memory:]
                weight, slope, loss = ahead, then, less
                break
            step /= 4
    return weight


def score_texts(docs: DataFrame, *, key: str, text: str, labels: DataFrame | None = None, label: str = "label") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of each text: how likely its worst sentence is abusive, hateful or sexual.

    Texts are read once, into hashed words and votes of their sentences. The label model is fitted on the vote patterns of all sentences of all texts (their counts; voters
    bound the number of patterns), the classifier on all sentences with their posterior labels, in a few passes that add up whole numbers, so neither files nor tasks change it.
    Every sentence of every text is scored. ``labels`` (``key``, ``label`` 1 or 0) may give what raters said of some texts; it counts as a voter of theirs.

    Defined results: null, empty and blank texts score 0; texts of any length are taken whole; repeated keys and
    texts give rows of their own; an empty table gives no rows; labels that are null or of unknown keys don't count, of several for a key the mean does; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    texts = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    own_words = _own_words(docs.select(F.col(text).alias("t")))
    if labels is None:
        texts = texts.withColumn("g", F.lit(None).cast("int"))
    else:
        mean = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.round(F.avg(F.col(label).cast("double"))).cast("int").alias("g"))
        texts = texts.join(mean, "k", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(own_words).read
        for b in batches:
            for part in _slices(b, 1, AT_ONCE):
                us = read(part.column(1).to_pylist())
                words = np.diff(np.append(0, np.cumsum(us.lens))[np.append(0, np.cumsum(us.counts))])
                held = [_binary(us.counts, us.marks), _binary(us.counts, us.lens.astype(np.uint8)), _binary(words, us.hashes)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *held], names=["k", "g", "vs", "ls", "hs"])

    said = cut(texts.select("k", "t", "g").mapInArrow(split, f"k {kind}, g int, vs binary, ls binary, hs binary"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, n = np.unique(_coded(b.column(0), b.column(1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    met = said.select("g", "vs").mapInArrow(patterns, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    counts = {(r["code"] >> 2, None if r["code"] & 3 == 0 else (r["code"] & 3) - 1): r["n"] for r in met}
    model = fit_labels(counts)
    soft = np.array([model.posterior(*p) for p in counts])
    known = np.array([r["code"] for r in met], dtype=np.int64)
    total = sum(n * (1.0 if p[1] is None else RATED) for p, n in counts.items())
    share = float(np.clip(sum(n * (1.0 if p[1] is None else RATED) * y for (p, n), y in zip(counts.items(), soft, strict=True)) / max(total, 1), LEAST, 0.5))

    def over_all(weight: np.ndarray, curved: bool) -> tuple[float, np.ndarray, np.ndarray]:
        given = spark.sparkContext.broadcast(weight)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = given.value
            slope, curve, loss = np.zeros(PLACES), np.zeros(PLACES), 0.0
            for b in batches:
                for part in _slices(b, 3, HELD):
                    marks = _numbers(part.column(1), np.int32)
                    if not len(marks):
                        continue
                    of = Features(_numbers(part.column(3), np.int32), _numbers(part.column(2), np.uint8).astype(np.int64), marks)
                    codes = _coded(part.column(0), part.column(1))
                    y, worth = soft[np.searchsorted(known, codes)], np.where(codes & 3 == 0, 1.0, RATED)
                    z = of.odds(w)
                    slope += of.sums((_chance(z) - y) * worth)
                    loss += float(np.rint((np.logaddexp(0.0, z) - y * z) * worth * GRAIN).sum())
                    if curved:
                        curve += of.sums((np.abs(y - share) + share * (1 - share)) * worth, 2)
            sums = np.concatenate([[loss], slope, curve] if curved else [[loss], slope]).astype(np.int64)
            yield _blocks_of({at: sums[at : at + BLOCK] for at in range(0, len(sums), BLOCK)})

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, np.ndarray] = {}
            for b in batches:
                for at, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    blocks[at] = blocks.get(at, 0) + np.frombuffer(sums, np.int64)
            yield _blocks_of(blocks)

        parts = said.select("g", "vs", "ls", "hs").mapInArrow(add, "at int, sums binary")
        met = parts.repartition(spark.sparkContext.defaultParallelism, "at").mapInArrow(together, "at int, sums binary").collect()
        given.destroy()
        out = np.zeros(1 + 2 * PLACES)
        for at, sums in met:
            out[at : at + len(sums) // 8] = np.frombuffer(sums, np.int64) / GRAIN
        return float(out[0]), out[1 : PLACES + 1], out[PLACES + 1 :]

    own = spark.sparkContext.broadcast(fit_linear(over_all, share))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = own.value
        for b in batches:
            for part in _slices(b, 3, HELD):
                counts = pc.binary_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                score = np.zeros(len(counts))
                if counts.sum():
                    of = Features(_numbers(part.column(3), np.int32), _numbers(part.column(2), np.uint8).astype(np.int64), _numbers(part.column(1), np.int32))
                    score[counts > 0] = np.maximum.reduceat(_chance(of.odds(w)), (np.cumsum(counts) - counts)[counts > 0])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=[key, "score"])

    return said.select("k", "vs", "ls", "hs").mapInArrow(judge, f"`{key}` {kind}, score double")


@lru_cache(maxsize=1)
def _reader(own: frozenset[str]) -> Reader:
    """The reader of a worker, which keeps its words from task to task."""
    return Reader(Speller(own))


def _binary(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    """Numbers, so many for each row, as one value of bytes a row."""
    ends = np.append(0, np.cumsum(counts, dtype=np.int64)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _numbers(column: pa.Array, dtype: type) -> np.ndarray:
    """The numbers of all rows of a column of bytes."""
    wide = column.cast(pa.large_binary())
    _, ends, data = wide.buffers()
    at = np.frombuffer(ends, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else [0, 0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype) if at[-1] > at[0] else np.zeros(0, dtype)


def _blocks_of(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([sums.tobytes() for sums in blocks.values()], pa.binary())], names=["at", "sums"])


def _coded(rated: pa.Array, marks: pa.Array) -> np.ndarray:
    """Vote pattern of each unit with what a rater said of its text, as one number."""
    said = pc.add(pc.fill_null(rated, -1), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    units = pc.binary_length(marks).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return _numbers(marks, np.int32).astype(np.int64) * 4 + np.repeat(said, units)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of a column, each row whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def _own_words(texts: DataFrame, *, share: float = 0.3) -> frozenset[str]:
    """Words one slip from a listed one that are as frequent in the texts as words, not slips, are.

    The words counted are variants of the lexicon, so their number is bounded by it.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[str] = Counter()
        for b in batches:
            for part in _slices(b, 0, AT_ONCE):
                met.update(" ".join([t for t in part.column(0).to_pylist() if t]).lower().split())
                if len(met) > REMEMBERED:
                    yield _near_words(met)
                    met.clear()
        yield _near_words(met)

    words = texts.mapInArrow(near, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    counts = {r["w"]: r["n"] for r in words.where("n > 1").collect()}
    spell = Speller()
    return EVERYDAY | {w for w, n in counts.items() if w not in LEXICON and n > share * counts.get(spell.slip(w) or "", 0)}


_LETTERS = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=REMEMBERED)
def _near_in(chunk: str) -> tuple[str, ...]:
    spell = _plain_speller()
    return tuple(w for w in ((chunk,) if chunk.isalnum() else _LETTERS.findall(chunk)) if 4 <= len(w) <= 20 and (w in LEXICON or (w.isalpha() and spell.slip(w) is not None)))


@lru_cache(maxsize=1)
def _plain_speller() -> Speller:
    return Speller()


def _near_words(met: dict[str, int]) -> pa.RecordBatch:
    """How often words of the lexicon, and words one slip from one, stand in chunks."""
    counts: Counter[str] = Counter()
    for chunk, n in met.items():
        for w in _near_in(chunk):
            counts[w] += n
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])


def best_threshold(scores: DataFrame, labels: DataFrame, *, key: str, label: str, default: float = 0.5) -> float:
    """Threshold with the highest F1 on all hand labels; the middle of the widest gap between scores that reaches it.

    The distinct scores are cut into ranges that are counted each by itself, so neither their number nor that of the labels has a bound.
    """
    pairs = labels.where(F.col(label).isNotNull()).join(scores, key).select("score", (F.col(label) == 1).cast("bigint").alias("yes"), (F.col(label) != 1).cast("bigint").alias("no"))
    ends = scores.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "score double, yes bigint, no bigint")
    met = pairs.unionByName(ends).groupBy("score").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    ranged = cut(met.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = sorted(ranged.groupBy("part").agg(F.max("score").alias("top"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect(), key=lambda r: r["top"])
    right = sum(r["yes"] for r in parts)
    if not right:
        return default
    # what stands above a range, and the highest score below it
    above = [(r["part"], sum(x["yes"] for x in parts[i + 1 :]), sum(x["no"] for x in parts[i + 1 :]), parts[i - 1]["top"] if i else None) for i, r in enumerate(parts)]
    beyond = F.broadcast(scores.sparkSession.createDataFrame(above, "part int, yes_above bigint, no_above bigint, below double"))
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    steps = ranged.join(beyond, "part").select(
        F.col("score").alias("high"),
        F.coalesce(F.lead("score").over(down), "below").alias("low"),
        (F.col("yes_above") + F.sum("yes").over(upto)).alias("tp"),
        (F.col("no_above") + F.sum("no").over(upto)).alias("fp"),
    )
    middle = (F.col("low") + F.col("high")) / 2
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + right), 9)
    best = steps.where("low is not null").agg(F.max(F.struct(f1.alias("f1"), (F.col("high") - F.col("low")).alias("gap"), F.when(middle > F.col("low"), middle).otherwise(F.col("high")).alias("at"))).alias("best"))
    return best.first()["best"]["at"]
