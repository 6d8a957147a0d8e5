"""Evaluation items that leaked into training text (problem 8).

Texts become words: markup, character references, invisible characters, letter case, punctuation and width variants are
gone. Words are typed: numbers, units and names are slots that a placeholder stands for, all other words are the template.
Names are known by their form in the items: capital in the middle of a sentence and never small. A text's word that no item
has may be a name, so it stands for one.

Windows of WINDOW words of a text are joined by hash with the items' windows, placeholders in the slots. The slots decide
what a joined window is:

* Their fills are the item's own: the diagonal (the offset between text and item) is compared word by word, and the item
  has leaked if MIN_WORDS words in a row are there, at most one in ALTERED of them altered, and the names among them
  are the item's. A passage whose names are all others' (names of other items, or words that the text has again and again)
  is a text that only resembles the item, however few words that alters. A misspelt name is an altered word.
* They are others, the same for the same slot: the item was put again with other values (`reparameterised`).

Every passage that counts holds a whole window with the item's own fills: n words of which n / ALTERED are altered leave at
least one run of WINDOW, for any n. So joining windows loses none.

The items are searched for in blocks of at most BLOCK_WORDS words, one after the other for each chunk of texts, so a larger
set of items takes more steps of the one pass over the texts, not more memory. Defined results: null and empty texts and
items match nothing; a text with several passages of an item gives one row; items shorter than MIN_WORDS words can't leak;
copies of a text give a row each; a name that items only have at the beginning of sentences is no slot.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.session import spread

MIN_WORDS = 15
ALTERED = 8
WINDOW = 5
BLOCK_WORDS = 2_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_CAPITAL = re.compile(r"(?<=[\w,;] )(?=[^\W\d_])[^\W_]{2,}")
#: Units of a quantity and number words; units may have a decimal prefix.
_UNITS = re.compile(
    "[kmgtp]b|(?:da|[numkcdhgtpµ])?(?:s|sec|m|g|bit|bits|byte|bytes|l|w|hz|pa|v)|min|mins|minute|minutes|second|seconds|hour|hours|h|hr|hrs|day|days|week|weeks|month|months|"
    "year|years|mile|miles|foot|feet|inch|inches|yard|yards|pound|pounds|lb|lbs|oz|ounce|ounces|tonne|tonnes|ton|tons|percent|degrees?|dollars?|euros?|cents?|"
    "(?:kilo|milli|centi|micro|nano|mega|giga|tera)?(?:metres?|meters?|grams?|grammes?|litres?|liters?|watts?|bytes?)"
)
_COUNTS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion".split()
)

_NUMBER, _NAME, _UNIT = 1, 2, 3
_UNKNOWN = 0  # in a text: a word that no item has; a name, for all we know
_BREAK = -1
_MEMO = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)


#: Characters of texts that are searched together, at least; bounds what a worker holds.
CHUNK = 1 << 22


def _plain(text: str) -> str:
    """The text without markup, references and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return text


def words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    return _WORD.findall(_plain(text).casefold())


def _is_number(word: str) -> bool:
    return word[0].isdigit() or word in _COUNTS


class Items:
    """A block of items: their words as numbers, the type of each word and the hashes of their windows."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        plain = [(i, _plain(t)) for i, t in rows]
        texts = [(i, _WORD.findall(t.casefold())) for i, t in plain]
        # Words that sentences have in capitals within them and that no item has in small letters.
        names = {w.casefold() for _, t in plain for w in _CAPITAL.findall(t) if w[0].isupper()}
        names -= {w for _, t in plain for w in _WORD.findall(t) if w.islower()}
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in texts for w in ws}), start=4)}
        kinds = np.zeros(len(self.vocabulary) + 4, np.int64)
        kinds[:4] = (_NAME, _NUMBER, _NAME, _UNIT)
        for w, n in self.vocabulary.items():
            kinds[n] = _NUMBER if _is_number(w) else _UNIT if _UNITS.fullmatch(w) else _NAME if w in names else n
        self.kinds = kinds
        self.ids = np.array([i for i, _ in texts], np.int64)
        self.text = [w for _, ws in texts for w in [*ws, ""]]
        self.words = np.array([x for _, ws in texts for x in [*(self.vocabulary[w] for w in ws), _BREAK]], np.int64)
        lengths = np.array([len(ws) + 1 for _, ws in texts], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths - 1
        self.owner = np.repeat(np.arange(len(texts)), lengths)
        self.at: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        self.memo = dict(self.vocabulary)  # and the types of words that no item has

    def numbers(self, ws: list[str]) -> list[int]:
        memo = self.memo
        try:
            return [memo[w] for w in ws]
        except KeyError:
            if len(memo) > _MEMO:
                self.memo = memo = dict(self.vocabulary)
            for w in ws:
                if w not in memo:
                    memo[w] = _NUMBER if _is_number(w) else _UNIT if _UNITS.fullmatch(w) else _UNKNOWN
            return [memo[w] for w in ws]

    def kinds_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers == _BREAK, _BREAK, self.kinds[np.maximum(numbers, 0)])

    def windows(self, numbers: np.ndarray, width: int, slots: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of `width` words, of the template alone or with the slots' values; which are whole."""
        n = len(numbers) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        template = self.kinds[np.maximum(numbers, 0)].astype(np.uint64)
        value = np.where(template < 4, numbers, 0).astype(np.uint64)
        h = np.zeros(n, np.uint64)
        whole = np.ones(n, bool)
        with np.errstate(over="ignore"):
            for k in range(width):
                h = (h ^ (h >> np.uint64(29))) * _M + template[k : k + n]
                if slots:
                    h = (h ^ (h >> np.uint64(31))) * _M + value[k : k + n]
                whole &= numbers[k : k + n] != _BREAK
        return h, whole

    def index(self, width: int, slots: bool) -> tuple[np.ndarray, np.ndarray]:
        if (width, slots) not in self.at:
            h, whole = self.windows(self.words, width, slots)
            at = np.flatnonzero(whole)
            at = at[np.argsort(h[at], kind="stable")]
            self.at[width, slots] = h[at], at
        return self.at[width, slots]

    def templates(self, width: int) -> np.ndarray:
        """The different template windows of the items, by their hashes."""
        return self.at.setdefault((width, None), (np.unique(self.index(width, False)[0]),))[0]

    def joined(self, numbers: np.ndarray, width: int) -> np.ndarray:
        """Positions in the text of the windows that are some item's, but for the fills."""
        h, whole = self.windows(numbers, width, False)
        known = self.templates(width)
        if not len(known):
            return np.zeros(0, np.int64)
        mine = np.flatnonzero(whole)
        at = np.minimum(np.searchsorted(known, h[mine]), len(known) - 1)
        return mine[known[at] == h[mine]]

    def pairs(self, numbers: np.ndarray, width: int, slots: bool, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the text, position in the items) of equal windows, with the items' own fills or any, of the text's windows `mine`."""
        h = self.windows(numbers, width, slots)[0][mine]
        hashes, at = self.index(width, slots)
        lo = np.searchsorted(hashes, h, "left")
        n = np.searchsorted(hashes, h, "right") - lo
        mine, lo, n = mine[n > 0], lo[n > 0], n[n > 0]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(mine, n), at[np.repeat(lo, n) + inner]


def has_passage(same: np.ndarray, least: int = MIN_WORDS, altered: int = ALTERED) -> bool:
    """Whether `least` or more in a row are the same but for one in `altered`; the ends of the row are the same."""
    n = len(same)
    if n < least:
        return False
    q = np.concatenate([[0], np.cumsum(~same)]) * altered - np.arange(n + 1)
    begin = np.maximum.accumulate(np.where(same, q[:-1], -(1 << 60)))[: n - least + 1]
    return bool(((q[least:] <= begin) & same[least - 1 :]).any())


def _own_names(same: np.ndarray, own: np.ndarray, other: np.ndarray, least: int = MIN_WORDS, altered: int = ALTERED) -> bool:
    """Whether a passage as in has_passage() has a name that's the item's own, or none that is another's."""
    bad, mine, theirs = (np.concatenate([[0], np.cumsum(x)]) for x in (~same, own, other))
    for p in np.flatnonzero(same[: len(same) - least + 1]).tolist():
        q = np.arange(p + least, len(same) + 1)
        if (same[q - 1] & ((bad[q] - bad[p]) * altered <= q - p) & ((mine[q] > mine[p]) | (theirs[q] == theirs[p]))).any():
            return True
    return False


def _near(a: str, b: str) -> bool:
    """Whether one word is a misspelling of the other: all but a stretch of at most three letters is the same."""
    n = min(len(a), len(b))
    lead = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - lead) if a[-1 - i] != b[-1 - i]), n - lead)
    return max(len(a), len(b)) - lead - tail <= 3 and lead + tail >= 3


class Texts:
    """Texts laid end to end: their words, also as the items' numbers, and where each begins."""

    def __init__(self, items: Items, texts: list[list[str]]) -> None:
        self.texts = texts
        self.numbers = np.array([n for ws in texts for n in (*items.numbers(ws), _BREAK)], np.int64)
        self.starts = np.cumsum([0, *(len(ws) + 1 for ws in texts)])
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.starts))

    def words(self, text: int, at: int, n: int = 1) -> list[str]:
        """`n` words from a position in all texts."""
        begin = at - int(self.starts[text])
        return self.texts[text][begin : begin + n]

    def diagonal(self, items: Items, text: int, item: int, shift: int) -> tuple[int, int]:
        """The item's positions that the text has words for, `shift` later."""
        return max(items.starts[item], self.starts[text] - shift), min(items.ends[item], self.starts[text + 1] - 1 - shift)


def _diagonals(items: Items, t: Texts, mine: np.ndarray, theirs: np.ndarray) -> list[list[int]]:
    """(text, item, shift) of all pairs of windows, each once."""
    return np.unique(np.stack([t.owner[mine], items.owner[theirs], mine - theirs], 1), axis=0).tolist() if len(mine) else []


def _leaks(items: Items, t: Texts) -> set[tuple[int, int]]:
    """(text, item) of all leaks."""
    found: set[tuple[int, int]] = set()
    for d, i, shift in _diagonals(items, t, *items.pairs(t.numbers, WINDOW, True, items.joined(t.numbers, WINDOW))):
        lo, hi = t.diagonal(items, d, i, shift)
        if (d, i) in found or hi - lo < MIN_WORDS:
            continue
        here, there = t.numbers[lo + shift : hi + shift], items.words[lo:hi]
        same = here == there
        if np.count_nonzero(same) < MIN_WORDS - MIN_WORDS // ALTERED or not has_passage(same):
            continue
        names = items.kinds[there] == _NAME
        other = names & ~same & (items.kinds_of(here) == _NAME)
        for k in np.flatnonzero(other).tolist():
            (fill,) = t.words(d, lo + shift + k)
            other[k] = not _near(fill, items.text[lo + k]) and (here[k] != _UNKNOWN or t.texts[d].count(fill) > 1)
        if not other.any() or _own_names(same, names & same, other):
            found.add((d, i))
    return found


#: Words in a row of which a window of MIN_WORDS words with one altered leaves at least one unaltered.
_HALF = MIN_WORDS // 2


def _template_passages(items: Items, t: Texts) -> list[list[int]]:
    """(text, item, shift) of the diagonals with MIN_WORDS words of a template in a row, at most one of them altered."""
    mine, theirs = items.pairs(t.numbers, _HALF, False, items.joined(t.numbers, _HALF))
    reach, step = MIN_WORDS - _HALF, 1 << 16
    around = np.arange(-reach, MIN_WORDS)
    texts = np.concatenate([np.full(reach, -2), items.kinds_of(t.numbers), np.full(MIN_WORDS, -2)])
    known = np.concatenate([np.full(reach, -3), items.kinds_of(items.words), np.full(MIN_WORDS, -3)])
    known[known == _BREAK] = -3
    keep = []
    for k in range(0, len(mine), step):
        bad = texts[mine[k : k + step, None] + around + reach] != known[theirs[k : k + step, None] + around + reach]
        sums = np.cumsum(np.pad(bad, ((0, 0), (1, 0))), 1, dtype=np.int32)
        keep.append((sums[:, MIN_WORDS:] - sums[:, :-MIN_WORDS] <= MIN_WORDS // ALTERED).any(1))
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return _diagonals(items, t, mine[keep], theirs[keep])


def _consistent(items: Items, t: Texts) -> set[tuple[int, int]]:
    """(text, item) of template passages whose slots have other fills, the same for the same slot."""
    found: set[tuple[int, int]] = set()
    for d, i, shift in _template_passages(items, t):
        if (d, i) in found:
            continue
        lo, hi = t.diagonal(items, d, i, shift)
        there, here = items.kinds[items.words[lo:hi]], items.kinds_of(t.numbers[lo + shift : hi + shift])
        bad = np.concatenate([[0], np.cumsum(here != there)])
        fits = np.flatnonzero(bad[MIN_WORDS:] - bad[: len(bad) - MIN_WORDS] <= MIN_WORDS // ALTERED)
        if any(_other_fills(items.text[lo + p : lo + p + MIN_WORDS], t.words(d, lo + shift + p, MIN_WORDS), there[p : p + MIN_WORDS], here[p : p + MIN_WORDS]) for p in fits.tolist()):
            found.add((d, i))
    return found - _leaks(items, t)


def _other_fills(there: list[str], here: list[str], kinds: np.ndarray, own_kinds: np.ndarray) -> bool:
    """Whether slots have other fills in place of the item's: one for each, no two names alike, and either all names are
    the item's or none is."""
    fills: dict[str, str] = {}
    names: dict[str, str] = {}
    template = 0
    for a, b, k, o in zip(there, here, kinds.tolist(), own_kinds.tolist()):
        if k != o:
            continue
        if k >= 4:
            template += 1
        elif fills.setdefault(a, b) != b or k == _NAME and names.setdefault(b, a) != a:
            return False
    own = sum(_near(a, b) for b, a in names.items())
    return template >= WINDOW and own in (0, len(names)) and any(a != b for a, b in fills.items())


def _search(documents: DataFrame, benchmark: DataFrame, find: Callable[[Items, Texts], set[tuple[int, int]]], id_col: str, text_col: str) -> DataFrame:
    context = documents.sparkSession.sparkContext
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    blocks, block, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1]) // 4
        if size >= BLOCK_WORDS:
            blocks, block, size = [*blocks, context.broadcast(block)], [], 0
    if block:
        blocks.append(context.broadcast(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, Items] | None = None
        ids: list[int] = []
        texts: list[list[str]] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal current
            rows: list[tuple[int, int]] = []
            for k, shared in enumerate(blocks):
                if current is None or current[0] != k:
                    current = k, Items(shared.value)
                rows += [(ids[d], int(current[1].ids[i])) for d, i in sorted(find(current[1], Texts(current[1], texts)))]
            if rows:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "item_id": pa.array([i for _, i in rows], pa.int64())})

        held = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(words(text))
                held += len(text)
                if held >= CHUNK:
                    yield from out()
                    ids, texts, held = [], [], 0
        if ids:
            yield from out()

    return spread(docs.where("text is not null and doc_id is not null")).mapInArrow(run, "doc_id bigint, item_id bigint")


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id): the documents that hold a passage of an item, and which item."""
    return _search(documents, benchmark, _leaks, id_col, text_col)


def reparameterised(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id): documents that hold MIN_WORDS words of an item's template in a row, at most one of them altered, with
    other numbers, units or names in the slots, the same for the same one; and no passage of the item as it is."""
    return _search(documents, benchmark, _consistent, id_col, text_col)
