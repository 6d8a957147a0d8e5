"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7).

The frequent words of the corpus (counted over all texts) are compiled once, with the ids they encode to, into a minimal
acyclic transducer: states with equal futures are shared, and each edge carries how many words sort before it, so that
walking a word yields its number and with that its ids. The transducer is one file in the shared folder, which Spark gives
to every executor and every Python worker maps into memory; words it doesn't hold are merged exactly by the vocabulary's
ranks. What is encoded doesn't depend on the lexicon, only the speed does.

Texts are cut in two steps: first into runs of white space with what follows them, at which the vocabulary's pattern always
cuts, then each different run by that pattern. A worker remembers the ids of the runs it has met.

Defined results: null, empty and missing texts have the ids []. Special tokens' strings are ordinary text. Lone
surrogates can't occur in Spark strings. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import mmap
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.session import fresh_path, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte_bpe_50k vocabulary cuts text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Words in the lexicon; bounds what is collected to the driver and what is mapped by a worker.
LEXICON_WORDS = 1 << 15
#: Runs of characters a worker remembers before it forgets them all, and the longest of them.
MEMO_RUNS, LONGEST_RUN = 1 << 18, 64
#: Fixed value: the characters that Unicode calls white space, as the pattern's \s has them.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BESIDE_ASCII = ("\0", *(f"{c} " for c in "\t\n\v\f\r "))
_BESIDE = re.compile(f"[{_SPACE}] |\0")
_RUN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

_MAGIC = 0x54524C58


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with Path(path).open("rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: neighbours of the lowest rank are joined, the leftmost first, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    if n > 48:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(n)]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), in n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _State:
    __slots__ = ("edges", "final", "count", "number")

    def __init__(self) -> None:
        self.edges: list[tuple[int, _State]] = []
        self.final = False
        self.count = self.number = -1


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic transducer of words and their ids, as bytes that Lexicon reads.

    Words are added in byte order; a state is replaced by an equal one as soon as no further word can change it.
    """
    entries = sorted(dict(entries).items())
    root = _State()
    register: dict[tuple, _State] = {}

    def shared(s: _State) -> _State:
        key = (s.final, tuple((b, id(t)) for b, t in s.edges))
        return register.setdefault(key, s)

    path, last = [root], b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for i in range(len(last), common, -1):
            parent = path[i - 1]
            parent.edges[-1] = (last[i - 1], shared(path[i]))
        del path[common + 1 :]
        for b in word[common:]:
            s = _State()
            path[-1].edges.append((b, s))
            path.append(s)
        path[-1].final = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1].edges[-1] = (last[i - 1], shared(path[i]))

    states: list[_State] = []
    stack: list[tuple[_State, bool]] = [(root, False)]
    while stack:  # children first, for the counts
        s, done = stack.pop()
        if done:
            if s.count < 0:
                s.count = s.final + sum(t.count for _, t in s.edges)
                s.number = len(states)
                states.append(s)
        elif s.count < 0:
            stack.append((s, True))
            stack.extend((t, False) for _, t in s.edges)
    first, labels, targets, skips = [0], bytearray(), [], []
    for s in states:
        before = int(s.final)
        for b, t in s.edges:
            labels.append(b)
            targets.append(t.number)
            skips.append(before)
            before += t.count
        first.append(len(labels))
    finals = bytes(s.final for s in states)
    ids = [x for _, own in entries for x in own]
    offsets = np.cumsum([0, *(len(own) for _, own in entries)])
    head = np.array([_MAGIC, len(states), len(labels), len(entries), len(ids), root.number], "<u4")
    ints = [np.array(x, "<u4") for x in (first, targets, skips, offsets, ids)]
    return head.tobytes() + b"".join(x.tobytes() for x in ints) + bytes(labels) + finals


class Lexicon:
    """A compiled transducer over a buffer, such as a mapped file; nothing is copied out of it."""

    def __init__(self, buffer: mmap.mmap | bytes) -> None:
        view = memoryview(buffer)
        magic, states, edges, self.n_words, n_ids, self.root = view[:24].cast("I")
        if magic != _MAGIC:
            raise ValueError("not a lexicon")
        at = 24

        def ints(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self.first, self.targets, self.skips = ints(states + 1), ints(edges), ints(edges)
        self.offsets, self.ids = ints(self.n_words + 1), ints(n_ids)
        self.buffer, self.labels, self.finals = buffer, at, view[at + edges : at + edges + states]

    def get(self, word: bytes) -> list[int] | None:
        s, number = self.root, 0
        find, first, base = self.buffer.find, self.first, self.labels
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[s], base + first[s + 1])
            if at < 0:
                return None
            number += self.skips[at - base]
            s = self.targets[at - base]
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if self.finals[s] else None


def runs(text: str) -> list[str]:
    """The text in pieces that begin with all white space before them: no word of the pattern goes on over their borders."""
    if any(x in text for x in _BESIDE_ASCII) or not text.isascii() and _BESIDE.search(text):
        return _RUN.findall(text)
    return text.replace(" ", "\0 ").split("\0")


class Encoder:
    """Texts to ids: remembered runs, then the lexicon's words, then merges. Ids are given as bytes of 32-bit numbers."""

    def __init__(self, lexicon: Lexicon | None, ranks: dict[bytes, int]) -> None:
        self.lexicon, self.ranks, self.memo, self.words = lexicon, ranks, {}, {}
        self.cut = regex.compile(PATTERN).findall

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.lexicon.get(raw) if self.lexicon else None
        return self.kept(self.words, word, np.array(merge(raw, self.ranks) if ids is None else ids, "<i4").tobytes())

    def run(self, run: str) -> bytes:
        get = self.words.get
        return self.kept(self.memo, run, b"".join([get(w) or self.word(w) for w in self.cut(run)]))

    def kept(self, memo: dict[str, bytes], text: str, ids: bytes) -> bytes:
        if len(text) < LONGEST_RUN:
            if len(memo) >= MEMO_RUNS:
                memo.clear()
            memo[text] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        own = runs(text)
        found = list(map(self.memo.get, own))
        if None in found:
            found = [self.run(r) if ids is None else ids for r, ids in zip(own, found)]
        return b"".join(found)


_encoders: dict[tuple, Encoder] = {}


def _encoder(lexicon: str | None, vocabulary: str) -> Encoder:
    """One encoder for each worker, kept between batches and tasks; both are names of files that Spark has brought."""
    key = lexicon, vocabulary
    if key not in _encoders:
        _encoders.clear()
        mapped = None
        if lexicon is not None:
            with Path(SparkFiles.get(lexicon)).open("rb") as f:
                mapped = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        _encoders[key] = Encoder(mapped, read_ranks(SparkFiles.get(vocabulary)))
    return _encoders[key]


def frequent_words(texts: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """The `most` most frequent words of column `text` that occur twice or more, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = regex.compile(PATTERN).findall, Counter()

        def out() -> pa.RecordBatch:
            total: Counter = Counter()
            for run, n in seen.items():
                for w in cut(run):
                    total[w] += n
            return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(runs(t))
                if len(seen) > 1 << 17:
                    yield out()
                    seen = Counter()
        yield out()

    counts = texts.select("text").mapInArrow(count, "word string, n bigint").where(F.length("word") < 64)
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return [r[0].encode() for r in top.select("word").collect()]


def _brought(spark: SparkSession, uri: str) -> str:
    """The name under which Spark brings a file to the executors."""
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def store_lexicon(spark: SparkSession, words: list[bytes], ranks: dict[bytes, int]) -> str | None:
    """Writes the compiled lexicon to the shared folder, on whatever file system that is, and gives its name to workers."""
    if not words:
        return None
    uri = fresh_path(spark, "lexicon")
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        stream.write(compile_lexicon((w, merge(w, ranks)) for w in words))
    finally:
        stream.close()
    return _brought(spark, uri)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, most: int = LEXICON_WORDS) -> DataFrame:
    """(id, ids): the token ids of each row's text. The driver reads the vocabulary; the executors get it from Spark."""
    rows = spread(documents.select(id_col, F.col(text_col).alias("text")))
    spark = rows.sparkSession
    lexicon = store_lexicon(spark, frequent_words(rows, most), read_ranks(vocabulary))
    ranks = _brought(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lexicon, ranks)
        for b in batches:
            parts = [encoder.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, parts)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, ids array<int>")
