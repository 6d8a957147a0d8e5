"""Text that was decoded in a wrong charset (problem 2).

A wrong charset is a substitution cipher: each letter has become another letter, or a few. Which cipher a line is under
isn't known, so it's inferred from what the languages of the corpus look like.

The words that aren't ASCII are counted once for each source (the host of a page), over all texts; all learning is done on
these words. The model of the languages is a count of neighbouring letters, each word weighing as much as the number of
sources that have it, so a source whose pages all suffer one swap doesn't make its damage a language. It's found by
expectation-maximization: the E-step gives each word its likeliest reading under the swaps of known code pages, the M-step
counts the letters of the words so read again. In the corpus most words are sound, so damaged letters fade.

Words that stay strange under all known swaps are put down to a cipher of their source's own. What a cipher needs to be
broken are the counts of its neighbouring characters, a small table for each source however many rows that has; on these a
second expectation-maximization learns which letter each character stands for, starting from what code pages would make of
it (`break_cipher`).

Restoring a line is a translate() for swaps of one-byte code pages and for learned ciphers, and a recoding for swaps that
spread a letter over several characters. A line under no swap is kept. Records with replacement or C1 control characters
are damaged in any case, as no text is written with those.

Defined results: null and empty bodies aren't damaged; bytes that aren't UTF-8 count as damage; pure ASCII never is; a
record without a host is a source of its own; a source with fewer than CIPHER_SEEN strange character pairs, or more strange
characters than one byte can tell apart, has no cipher learned.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.session import spread, written

#: Charsets text is read in by mistake, and charsets it's written in.
READ = "latin-1 cp1252 cp1250 cp1251 cp1253 iso8859-2 iso8859-15 iso8859-7 mac_roman cp850 cp437 cp866 koi8-r gbk cp932".split()
WRITTEN = "utf-8 cp1252 cp1250 cp1251 cp1253 iso8859-2 iso8859-5 iso8859-7 mac_roman cp850 cp866 koi8-r cp932 euc_jp".split()
#: A neighbourhood with a smaller share of all isn't kept; so at most 1 / MODEL_SHARE are, however large the corpus.
MODEL_SHARE = 2e-6
#: Rounds of expectation-maximization, and the gain in nats at which a reading of a word is as likely as the word itself.
ROUNDS, EVEN = 3, 5.0
#: Strange character pairs that a source must have for its cipher to be learned, rounds, and how often a character must be there.
CIPHER_SEEN, CIPHER_ROUNDS, CIPHER_LEAST = 60, 30, 5
#: A line is damaged if its best swap is so much likelier (in nats) than the line as it is.
EVIDENCE = 9.0
#: Seen less often than this, a neighbourhood says nothing.
SEEN = 3

_TOKEN = re.compile(r"[^\x00-\x20<>\"=/]+")
_DIGIT = re.compile(r"[0-9]+")
_CONTROL = re.compile("[\x80-\x9f]")
_SURE = re.compile("[�\x80-\x9f]")
_MEMO = 1 << 16
#: A loss at which a reading of a word isn't followed further.
WORST = -30.0


def _as_control(e: UnicodeError) -> tuple[bytes, int]:
    """Bytes without a character are read as control characters."""
    bad = e.object[e.start : e.end]
    if not all("\x80" <= c < "\xa0" for c in bad):
        raise e
    return bad.encode("latin-1"), e.end


def _encoded(text: str, charset: str) -> bytes | None:
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        if not charset.startswith("cp125") or not _CONTROL.search(text):
            return None
    codecs.register_error("trawlnet-control", _as_control)  # in each worker; a dictionary entry
    try:
        return text.encode(charset, "trawlnet-control")
    except UnicodeEncodeError:
        return None


@lru_cache(1 << 14)
def readings(token: str) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """What a token may have been, with the swaps (numbers) that give it."""
    out: dict[str, list[int]] = {}
    for i, read in enumerate(READ):
        raw = _encoded(token, read)
        if raw is None:
            continue
        for j, written in enumerate(WRITTEN):
            try:
                text = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if text != token and not text.isascii() and not _SURE.search(text):
                out.setdefault(text, []).append(i * len(WRITTEN) + j)
    return tuple((t, tuple(n)) for t, n in out.items())


def neighbourhoods(token: str) -> Iterator[str]:
    """Each character with its neighbours, where one of the three is a letter that isn't ASCII; signs that aren't ASCII
    at a word's edge only with the kinds of their neighbours."""
    s = f"^{token.lower()}$"
    for i in range(1, len(s) - 1):
        a, c, z = s[i - 1], s[i], s[i + 1]
        if c > "\x7f" and not c.isalpha():
            inner = a.isalpha() and z.isalpha()
            yield a + c + z if inner else f"{'a' if a.isalpha() else a}{c}{'a' if z.isalpha() else z}"
        elif c > "\x7f" or a > "\x7f" and a.isalpha() or z > "\x7f" and z.isalpha():
            yield a + c + z
        elif a > "\x7f" or z > "\x7f":
            yield f"{a if a > '\x7f' else '·'}{'a' if c.isalpha() else c}{z if z > '\x7f' else '·'}"


class Model:
    """How likely neighbourhoods are in sound text, and what that says of tokens."""

    def __init__(self, counts: dict[str, float]) -> None:
        self.counts = counts
        total = sum(counts.values()) + 1
        self.log = {t: math.log(n / total) for t, n in counts.items()}
        self.floor = math.log(0.3 / total)
        self.known = {t for t, n in counts.items() if n >= SEEN}
        self.alphabet = {c for t in self.known for c in t} | set(map(chr, range(128)))
        self.memo: dict[str, tuple[dict[int, float], int, tuple[int, ...]]] = {}
        self.lines: dict[str, tuple[int | None, float]] = {}

    def swaps(self, token: str) -> tuple[dict[int, float], int, tuple[int, ...]]:
        """The gain, in nats, of each swap that makes a token another one; as bits, the swaps that lose WORST or more; and
        the swaps that gain."""
        if (found := self.memo.get(token)) is not None:
            return found
        get, floor, known, alphabet = self.log.get, self.floor, self.known, self.alphabet
        now = sum(get(t, floor) for t in neighbourhoods(token))
        out: dict[int, float] = {}
        worst = 0
        for text, numbers in readings(token):
            gain = WORST
            if alphabet.issuperset(text.lower()):
                gain, unseen, n = -now, 0, 0
                for t in neighbourhoods(text):
                    gain += get(t, floor)
                    unseen += t not in known
                    n += 1
                    if gain < WORST:
                        break
                # A text that the languages of the corpus don't have isn't a restored one, however short it is.
                if gain > 0 and unseen > 0.3 * n:
                    gain = -1.0
            for n in numbers:
                if gain > WORST:
                    out[n] = gain
                else:
                    worst |= 1 << n
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        self.memo[token] = out, worst, tuple(n for n, g in out.items() if g > 0)
        return self.memo[token]

    def strange(self, token: str) -> bool:
        """Whether most of a word's neighbourhoods are none of the languages', and no swap makes a word of it that wholly is."""
        if not self.foreign(token, 0.5):
            return False
        gains = self.swaps(token)[0]
        return not any(gains.get(numbers[0], 0.0) > EVEN and not self.foreign(text, 0.1) for text, numbers in readings(token))

    def foreign(self, text: str, share: float) -> bool:
        own = list(neighbourhoods(text))
        return sum(t not in self.known for t in own) > share * len(own)

    def gain(self, token: str, text: str) -> float:
        """What a reading of a word gains, in nats; nothing if the languages don't have it."""
        token, text = _DIGIT.sub("0", token), _DIGIT.sub("0", text)
        if text == token or self.foreign(text, 0.3):
            return 0.0
        get, floor = self.log.get, self.floor
        return sum(get(t, floor) for t in neighbourhoods(text)) - sum(get(t, floor) for t in neighbourhoods(token))

    def suspect(self, tokens: Counter, evidence: float = EVIDENCE) -> bool:
        """Whether any line made of these tokens could be likelier under a swap by the evidence that's asked for: the
        gains of all tokens that gain, as if they stood in one line. What isn't suspect needs no look at its lines."""
        sums: dict[int, float] = {}
        for token, n in tokens.items():
            gains, _, gaining = self.memo.get(token) or self.swaps(token)
            for swap in gaining:
                sums[swap] = sums.get(swap, 0.0) + n * gains[swap]
                if sums[swap] >= evidence:
                    return True
        return False

    def best(self, token: str) -> tuple[str | None, float]:
        """The reading of a word that gains most, and its gain."""
        gains = self.swaps(token)[0]
        swap = max(gains, key=gains.get, default=None)
        if swap is None or gains[swap] <= 0:
            return None, 0.0
        return next(text for text, numbers in readings(token) if swap in numbers), gains[swap]

    def line(self, text: str) -> tuple[int | None, float]:
        """The likeliest swap of a line and its gain; None if the line is likeliest as it is."""
        text = _DIGIT.sub("0", text)
        if (found := self.lines.get(text)) is not None:
            return found
        own = [self.swaps(t) for t in _TOKEN.findall(text) if not t.isascii()]
        best: tuple[int | None, float] = (None, 0.0)
        for n in sorted({n for _, _, gaining in own for n in gaining}):
            gain = sum(gains[n] if n in gains else WORST * (worst >> n & 1) for gains, worst, _ in own)
            if gain > best[1]:
                best = n, gain
        if len(self.lines) >= _MEMO:
            self.lines.clear()
        if len(text) < 120:
            self.lines[text] = best
        return best


@lru_cache(len(READ) * len(WRITTEN))
def _substitution(swap: int) -> dict[int, str] | None:
    """The substitution of a swap of one-byte code pages, for translate()."""
    read, written = READ[swap // len(WRITTEN)], WRITTEN[swap % len(WRITTEN)]
    if written in ("utf-8", "cp932", "euc_jp") or read in ("gbk", "cp932"):
        return None
    out = {}
    for b in range(0x80, 0x100):
        try:
            true = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        try:
            out[ord(bytes([b]).decode(read))] = true
        except UnicodeDecodeError:
            out[b] = true
    return out


#: Damage upon damage is undone so many times at most.
LAYERS = 3


def restore_line(line: str, model: Model, evidence: float = EVIDENCE, layers: int = LAYERS, cipher: dict[int, str] | None = None) -> tuple[str, bool]:
    """The line as it was written, and whether it was damaged. Words that the swap can't have made stay; `cipher` is what
    was learned of the source."""
    damaged = bool(_SURE.search(line))
    for _ in range(layers):
        if line.isascii():
            break
        swap, gain = model.line(line)
        if cipher:
            own = {t: (t.translate(cipher), model.gain(t, t.translate(cipher))) for t in set(_TOKEN.findall(line)) if not t.isascii()}
            own = {t: x for t, x in own.items() if x[1] > 0}
            if (deciphered := sum(own[t][1] for t in _TOKEN.findall(line) if t in own)) >= max(gain, evidence):
                line, damaged, cipher = _TOKEN.sub(lambda m: own.get(m.group(), (m.group(),))[0], line), True, None
                continue
        if swap is None or gain < evidence:
            break
        line, damaged = _undone(line, swap, model), True
    return line, damaged


def _undone(line: str, swap: int, model: Model) -> str:
    table = _substitution(swap)
    known = {t for t in set(_TOKEN.findall(line)) if not t.isascii() and model.swaps(_DIGIT.sub("0", t))[0].get(swap, 0.0) > 0}

    def fix(m: re.Match) -> str:
        token = m.group()
        if token not in known:
            return token
        if table is not None:
            return token.translate(table)
        raw = _encoded(token, READ[swap // len(WRITTEN)])
        return raw.decode(WRITTEN[swap % len(WRITTEN)], "replace") if raw is not None else token

    return _TOKEN.sub(fix, line)


def tokens(text: str) -> Counter:
    """The words of a text that aren't ASCII, with digits masked."""
    return Counter(t if t.isalpha() else _DIGIT.sub("0", t) for t in _TOKEN.findall(text) if not t.isascii())


def is_damaged(text: str, model: Model, cipher: dict[int, str] | None = None) -> bool:
    if text.isascii():
        return False
    if _SURE.search(text):
        return True
    own = tokens(text)
    if cipher and any(model.gain(t, t.translate(cipher)) > 0 for t in own) and any(restore_line(x, model, cipher=cipher)[1] for x in text.split("\n")):
        return True
    return model.suspect(own) and any(restore_line(x, model)[1] for x in text.split("\n"))


_REFERENCE = re.compile(r"&#(?:([0-9]{2,7})|[xX]([0-9a-fA-F]{2,6}));")


def _character(m: re.Match) -> str:
    n = int(m[1]) if m[1] else int(m[2], 16)
    return chr(n) if 0x80 <= n < 0xD800 or 0xE000 <= n < 0x110000 else m.group()


def _text(raw: bytes | None) -> str:
    """The text of a body; damaged letters may have been written as character references since."""
    text = raw.decode("utf-8", "replace") if raw else ""
    return _REFERENCE.sub(_character, text) if "&#" in text else text


def records(responses: DataFrame, charset_prescan: DataFrame) -> DataFrame:
    """(src, rec_id, source, body) of both tables that hold bodies; the source is a hash of the page's host."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*:[/\\\\]{2}(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    a = responses.select(F.lit("responses").alias("src"), F.col("response_id").alias("rec_id"), host.alias("host"), "body")
    b = charset_prescan.select(F.lit("charset_prescan").alias("src"), F.col("case_id").alias("rec_id"), F.lit(None).cast("string").alias("host"), F.col("html").alias("body"))
    both = spread(a.unionByName(b).where("rec_id is not null and body is not null"))
    return both.select("src", "rec_id", F.xxhash64(F.coalesce("host", F.concat_ws("#", "src", "rec_id"))).alias("source"), "body")


def _table(rows: Counter | dict, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """Keys, or the parts of keys that are tuples, and values as columns."""
    keys = list(rows)
    parts = list(zip(*keys)) if keys and isinstance(keys[0], tuple) else [keys] if len(kinds) == 2 else [[]] * (len(kinds) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip([*(parts or [[]]), list(rows.values())], kinds)], names=[n for n, _ in kinds])


def vocabulary(texts: DataFrame) -> DataFrame:
    """(source, token, n): the words that aren't ASCII, counted by source over all texts."""
    kinds = [("source", pa.int64()), ("token", pa.string()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = _text(raw)
                if not text.isascii():
                    for t, n in tokens(text).items():
                        seen[source, t] += n
            if len(seen) > 1 << 16:
                yield _table(seen, kinds)
                seen = Counter()
        yield _table(seen, kinds)

    return texts.select("source", "body").mapInArrow(run, "source bigint, token string, n bigint").groupBy("source", "token").agg(F.sum("n").alias("n"))


def _counted(words: DataFrame, model: object | None) -> dict[str, float]:
    """The neighbourhoods of all words (token, n_sources, lo, hi), read as is likeliest under the model if there is one; what
    only one source has (the first is the last) counts as too rare to say anything, however many words have it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(model.value) if model is not None else None
        seen: dict[str, tuple[float, int, int]] = {}

        def add(token: str, n: float, lo: int, hi: int) -> None:
            for t in neighbourhoods(token):
                m, a, b = seen.get(t, (0.0, lo, hi))
                seen[t] = m + n, min(a, lo), max(b, hi)

        for b in batches:
            for token, n, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                text, gain = known.best(token) if known else (None, 0.0)
                if text is None:
                    add(token, n, lo, hi)
                else:
                    p = 1 / (1 + math.exp(min(EVEN - gain, 50)))
                    add(text, n * p, lo, hi)
                    add(token, n * (1 - p), lo, hi)
        columns = list(zip(*seen.values())) or [[], [], []]
        yield pa.RecordBatch.from_pydict({"t": pa.array(list(seen), pa.string()), "n": pa.array(columns[0], pa.float64()), "lo": pa.array(columns[1], pa.int64()), "hi": pa.array(columns[2], pa.int64())})

    parts = words.mapInArrow(run, "t string, n double, lo bigint, hi bigint")
    sums = written(parts.groupBy("t").agg(F.sum("n").alias("n"), (F.min("lo") != F.max("hi")).alias("shared")), "neighbourhoods")
    least = max(1.5, (sums.agg(F.sum("n")).first()[0] or 0) * MODEL_SHARE)
    return {r.t: r.n if r.shared else min(r.n, SEEN - 0.5) for r in sums.where(F.col("n") > least).collect()}


class Learned:
    """What was learned of a corpus: the model's counts as a broadcast, and the ciphers (source, symbols, letters) of sources."""

    def __init__(self, model: object, ciphers: DataFrame) -> None:
        self.model, self.ciphers = model, ciphers


def learn(texts: DataFrame, rounds: int = ROUNDS) -> Learned:
    """The model after `rounds` rounds, the first of which counts the words as they are, and the sources' ciphers."""
    spark = texts.sparkSession
    by_source = written(vocabulary(texts), "vocabulary")
    words = by_source.groupBy("token").agg(F.count("*").cast("double").alias("n_sources"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    model = None
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(_counted(words, model))
    return Learned(model, written(ciphers(by_source, model), "ciphers"))


# --- ciphers -----------------------------------------------------------------------------------------------------------


def _pairs(token: str) -> Iterator[tuple[str, str]]:
    """Neighbouring characters of a word of which one isn't ASCII; ASCII letters are small, ends are ^ and $."""
    s = f"^{''.join(c.lower() if c < '\x80' else c for c in token)}$"
    for u, v in zip(s, s[1:]):
        if u > "\x7f" or v > "\x7f":
            yield u, v


def ciphers(by_source: DataFrame, model: object) -> DataFrame:
    """(source, symbols, letters): of each source with enough strange words, what its characters stand for."""
    kinds = [("source", pa.int64()), ("u", pa.string()), ("v", pa.string()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(model.value)
        seen: Counter = Counter()
        for b in batches:
            for source, token, n in zip(*(c.to_pylist() for c in b.columns)):
                if known.strange(token):
                    for u, v in _pairs(token):
                        seen[source, u, v] += n
            if len(seen) > 1 << 16:
                yield _table(seen, kinds)
                seen = Counter()
        yield _table(seen, kinds)

    def broken(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = break_cipher({(u, v): n for u, v, n in zip(rows["u"], rows["v"], rows["n"])}, model.value)
        return pd.DataFrame([(key[0], "".join(table), "".join(table.values()))] if table else [], columns=["source", "symbols", "letters"])

    pairs = by_source.select("source", "token", "n").mapInArrow(run, "source bigint, u string, v string, n bigint")
    sums = pairs.groupBy("source", "u", "v").agg(F.sum("n").alias("n"))
    enough = sums.groupBy("source").agg(F.sum("n").alias("_n")).where(F.col("_n") >= CIPHER_SEEN).select("source")
    # A group holds a row for each pair of characters, not for each row of the source.
    return sums.join(enough, "source", "left_semi").groupBy("source").applyInPandas(broken, "source bigint, symbols string, letters string")


def _script(letter: str) -> str:
    return unicodedata.name(letter, "?").split()[0]


def break_cipher(pairs: dict[tuple[str, str], int], counts: dict[str, float], rounds: int = CIPHER_ROUNDS) -> dict[str, str]:
    """Which letter each character stands for, learned from counts of neighbouring characters and the languages' neighbourhoods.

    Letters of one script at a time are tried; the script under which the text is likeliest stays. The E-step weighs for
    each character all letters by how often they stand beside its neighbours, which are ASCII or, as far as is known so far,
    letters themselves; no letter is stood for by more than two characters, one large and one small. The M-step takes the
    weights as the table. At the end characters change places while that makes the text likelier. Rare characters are left out.
    """
    seen: Counter = Counter()
    for (u, v), n in pairs.items():
        for c in (u, v):
            if c > "\x7f":
                seen[c] += n
    symbols = sorted(c for c, n in seen.items() if n >= 2 * CIPHER_LEAST)
    beside: Counter = Counter()
    for t, n in counts.items():
        if len(t) == 3 and "·" not in t and not any(c > "\x7f" and not c.isalpha() for c in t):
            beside[t[0], t[1]] += n
            beside[t[1], t[2]] += n
    letters = Counter(c for uv in beside for c in uv if c > "\x7f")
    scripts: dict[str, list[str]] = {}
    for c in sorted(letters):
        scripts.setdefault(_script(c), []).append(c)
    if not symbols or len(symbols) > 256:
        return {}
    # A byte has 128 values that aren't ASCII, so scripts of more letters aren't written with one.
    tries = [_assigned(pairs, symbols, own, beside, rounds) for own in scripts.values() if 4 <= len(own) <= 160]
    table = max(tries, key=lambda x: x[0], default=(0.0, {}))[1]
    out = {}
    for c, letter in table.items():
        first = sum(n for (u, v), n in pairs.items() if v == c and (u == "^" or u in out and out[u].isupper()))
        large = first >= 0.95 * sum(n for (_, v), n in pairs.items() if v == c) and len(letter.upper()) == 1
        out[c] = letter.upper() if large else letter
    return {c: x for c, x in out.items() if c != x}


def _assigned(pairs: dict[tuple[str, str], int], symbols: list[str], letters: list[str], beside: Counter, rounds: int) -> tuple[float, dict[str, str]]:
    """(log-likelihood, table) of characters that stand for letters of one script."""
    plain = sorted({c for uv in pairs for c in uv if c <= "\x7f"})
    known = [*plain, *letters]
    at, place, k0 = {c: i for i, c in enumerate(known)}, {c: i for i, c in enumerate(symbols)}, len(plain)
    table = np.full((len(known), len(known)), 0.02)
    for (u, v), n in beside.items():
        if u in at and v in at:
            table[at[u], at[v]] += n
    log = np.log(table / table[k0:].sum())
    left, right, both = np.zeros((len(symbols), k0)), np.zeros((len(symbols), k0)), np.zeros((len(symbols), len(symbols)))
    for (u, v), n in pairs.items():
        if u in place and v in place:
            both[place[u], place[v]] += n
        elif v in place and u in at and at[u] < k0:
            left[place[v], at[u]] += n
        elif u in place and v in at and at[v] < k0:
            right[place[u], at[v]] += n
    fixed = left @ log[:k0, k0:] + right @ log[k0:, :k0].T
    column = {c: i for i, c in enumerate(letters)}
    for c in symbols:  # what known code pages would make of it
        for text, _ in readings(c):
            if text.lower() in column:
                fixed[place[c], column[text.lower()]] += 1.0
    inner = log[k0:, k0:]
    q = np.zeros_like(fixed)
    for k in range(rounds):
        score = fixed + (both.T @ q @ inner + both @ q @ inner.T if k else 0)
        heat = max(1.0, both.sum() / 50 * 0.6**k)
        new = np.exp((score - score.max(1, keepdims=True)) / heat) + 1e-12
        for _ in range(8):
            new /= np.maximum(1.0, new.sum(0, keepdims=True) / 2)
            new /= new.sum(1, keepdims=True)
        done = k and heat == 1.0 and np.abs(new - q).max() < 1e-4
        q = new
        if done:
            break
    own, free = np.full(len(symbols), -1), np.full(len(letters), 2)
    for flat in np.argsort(-q, axis=None).tolist():
        x, a = divmod(flat, len(letters))
        if own[x] < 0 and (free[a] > 0 or not free.any()):
            own[x] = a
            free[a] -= 1

    own = np.where(own < 0, q.argmax(1), own)

    def total(own: np.ndarray) -> float:
        return float(fixed[np.arange(len(own)), own].sum() + (both * inner[own[:, None], own]).sum())

    def climbed(own: np.ndarray) -> tuple[float, np.ndarray]:
        """The table after all changes of one character, and exchanges of two, that make the text likelier."""
        best = total(own)
        for _ in range(rounds):
            before = best
            for x in range(len(symbols)):
                used = np.bincount(own, minlength=len(letters))
                new = own.copy()
                for new[x] in np.flatnonzero(used < 2).tolist():
                    if (got := total(new)) > best + 1e-9:
                        own, best = new.copy(), got
                for y in range(x):
                    new = own.copy()
                    new[x], new[y] = own[y], own[x]
                    if own[x] != own[y] and (got := total(new)) > best + 1e-9:
                        own, best = new, got
            if best - before < 1e-6:
                break
        return best, own

    best, own = climbed(own)
    return best, {c: letters[a] for c, a in zip(symbols, own)}


# --- results -----------------------------------------------------------------------------------------------------------


def _with_ciphers(texts: DataFrame, learned: Learned) -> DataFrame:
    """The records with the cipher of their source; the ciphers' size is known, so they're broadcast only if they're few."""
    return texts.join(learned.ciphers, "source", "left").select("src", "rec_id", "body", "symbols", "letters")


def _cipher(symbols: str | None, letters: str | None) -> dict[int, str] | None:
    return str.maketrans(symbols, letters) if symbols else None


def damaged(texts: DataFrame, learned: Learned | None = None) -> DataFrame:
    """(src, rec_id): records with at least one damaged passage."""
    learned = learned or learn(texts)
    model = learned.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(model.value)
        for b in batches:
            keep = [is_damaged(_text(raw), known, _cipher(x, y)) for raw, x, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "rec_id"]).filter(pa.array(keep, pa.bool_()))

    return _with_ciphers(texts, learned).mapInArrow(run, "src string, rec_id bigint")


def restored(texts: DataFrame, learned: Learned | None = None) -> DataFrame:
    """(src, rec_id, text): the damaged records with their text as it was written, where that can be had."""
    learned = learned or learn(texts)
    model = learned.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(model.value)
        for b in batches:
            rows = []
            for src, i, raw, symbols, letters in zip(*(c.to_pylist() for c in b.columns)):
                text, cipher = _text(raw), _cipher(symbols, letters)
                if is_damaged(text, known, cipher):
                    lines = [restore_line(x, known, cipher=cipher) for x in text.split("\n")]
                    rows.append((src, i, "\n".join(x for x, _ in lines)))
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_pydict({"src": pa.array(cols[0], pa.string()), "rec_id": pa.array(cols[1], pa.int64()), "text": pa.array(cols[2], pa.string())})

    return _with_ciphers(texts, learned).mapInArrow(run, "src string, rec_id bigint, text string")
