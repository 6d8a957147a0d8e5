"""The main content of web pages without what the site puts around it (problem 4).

Line-block distribution: markup is stripped line by line, the lengths of the lines' own text (not of links, notices and
teasers) are summed over sliding windows, and the content lies between the point where the sums surge and the one where
they dive. Within these points the lines of the site are left out.

Which repeated lines are the site's own is learned from the corpus: pages that mark their parts up (article, nav, aside,
footer, dialogs) say for each line text, and for each text before a colon, whether it stands in content or around it;
that is counted over all such pages and applied to pages of any layout and to plain text. The lexicon holds hashes of
texts that occur at least twice, LEXICON at most.

Defined results: null and empty bodies, other statuses and types have no lines; bytes that aren't UTF-8 are replaced, which
changes no line numbers; a page without a surge has no content; repeated fetches give rows of their own.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.llm.encodings import _encoded
from trawlnet.session import spread

TYPES = ("text/html", "application/xhtml+xml", "text/plain")
#: Lines in a window, and the sum of text lengths in bytes that makes a surge.
WINDOW, SURGE = 3, 60
#: The most frequent line texts kept; bounds what is collected and sent to the workers.
LEXICON = 200_000
LONGEST = 400  # characters of a line text whose mended form is remembered
_MEMO = 1 << 16

_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>|<\?[^>]*>")
_ROLE = re.compile(r"role\s*=\s*[\"']?(dialog|alertdialog|navigation|banner|contentinfo|complementary|search|main|article)|\b(?:id|class)\s*=\s*[\"']?[^\"'>]*?\b(promo|advert|advertisement|teaser|related|newsletter|share|cookie|consent|breadcrumb)", re.I)
#: What pages that mark their content up hold, as read_lines() takes it; it reads no other pages for the lexicon.
_MARKS = re.compile(r"<(?:article|main)|role\s*=\s*[\"']?(?:main|article)", re.I)
#: Elements around content, of content, and without text.
_AROUND = frozenset("nav aside footer header form dialog menu".split())
_CONTENT = frozenset("article main".split())
_SILENT = frozenset("script style head title noscript template svg iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS = (".", "!", "?", "。", "！", "？", ":", ")", "”", '"', "»")
_STOP = re.compile(r"[.!?](?=\s|$|[)\"”»])|[。！？]")
_TRAIL = re.compile(r"\s*\([^()]*\)$")
_COUNT = re.compile(r"\s\(\d+\)$")
_CUT = ("…", "...", "â€¦", "â\x80¦", "\ufffd")
_CRUMBS = re.compile(r"\s[›»>/→|]\s")

X, B, T, S, P, L = range(6)  # nothing, of the site, cut teaser, one sentence, paragraph, entry or heading


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _bare(text: str) -> str:
    """The text without a count in brackets at its end."""
    return _COUNT.sub("", text) if text.endswith((")", "\n")) else text


@lru_cache(1 << 14)
def _role(attributes: str) -> int:
    hit = _ROLE.search(attributes)
    return 0 if not hit else 1 if (hit[1] or "").lower() in ("main", "article") else -1


class Line:
    __slots__ = ("text", "linked", "role", "heading", "kind")

    def __init__(self) -> None:
        self.text, self.linked, self.role, self.heading, self.kind = "", 0, 0, False, X


def read_lines(body: str, marked: bool) -> tuple[list[Line], str]:
    """The lines of a page with their own text, how much of it is linked, and the role their markup gives them
    (-1 around content, 1 content, 0 unknown); and the page's title."""
    out: list[Line] = []
    stack: list[tuple[str, int]] = []
    title, silent, link = "", 0, 0
    for raw in body.split("\n"):
        raw = raw.replace("\x85", "…")  # an ellipsis whose byte was taken for a control character, which is white space
        line = Line()
        out.append(line)
        if not marked:
            line.text = " ".join(raw.split())
            continue
        parts, at, role = [], 0, 0
        if "<" in raw:
            for m in _TAG.finditer(raw):
                if m.start() > at and not silent:
                    piece = raw[at : m.start()]
                    parts.append(piece)
                    line.linked += len(piece.strip()) if link else 0
                    role = role or (stack[-1][1] if stack else 0)
                elif m.start() > at and stack and stack[-1][0] == "title":
                    title = raw[at : m.start()]
                at = m.end()
                name = (m[2] or "").lower()
                if not name or name in _VOID or m[3].endswith("/"):
                    continue
                if not m[1]:
                    r = -1 if name in _AROUND else 1 if name in _CONTENT else 0
                    if m[3]:
                        r = _role(m[3]) or r
                    stack.append((name, r or (stack[-1][1] if stack else 0)))  # the nearest role around it, if it has none
                    silent += name in _SILENT
                    link += name == "a"
                    line.heading |= len(name) == 2 and name[0] == "h" and name[1].isdigit()
                else:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            for gone, _ in stack[i:]:
                                silent -= gone in _SILENT
                                link -= gone == "a"
                            del stack[i:]
                            break
        if at < len(raw) and not silent:
            rest = raw[at:]
            parts.append(rest)
            line.linked += len(rest.strip()) if link else 0
            role = role or (stack[-1][1] if stack else 0)
        line.text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        line.role = role if line.text else 0
    return out, html.unescape(title)


def _lead(text: str) -> str | None:
    """What stands before a colon, if that's short."""
    lead, colon, rest = text.partition(":")
    if not colon:
        lead, colon, rest = text.partition("：")
    return f"{lead}\u0001:" if colon and rest and 0 < len(lead) < 40 else None


#: Swaps of charsets that damaged lines are tried under (read as: written in); a line that doesn't encode in
#: a charset wasn't read in it.
_SWAPS = {
    "latin-1": ("cp1250", "utf-8", "cp1251", "cp1253", "cp932", "euc_jp"), "cp1252": ("cp1250", "utf-8", "cp932"), "cp850": ("cp1252", "utf-8"), "mac_roman": ("cp1252", "utf-8"),
    "cp1250": ("utf-8",), "cp1251": ("utf-8", "koi8-r"), "koi8-r": ("cp1251",), "gbk": ("utf-8",), "cp932": ("utf-8",),
}
_RIGHTS = re.compile(r"© ?\d{4}")


def _known(text: str, around: set | frozenset, content: set | frozenset) -> bool:
    h, lead = _hash(bare := _bare(text)), _lead(text)
    return h in around or lead is not None and _hash(lead) in around or bool(_RIGHTS.match(text)) or (h if bare == text else _hash(text)) in content


def mended(text: str, around: set | frozenset, content: set | frozenset, memo: dict[str, str] | None = None) -> str:
    """A line as it was written, if it was read in a wrong charset and is then one that's known from other pages; `memo`
    keeps what was found for repeated lines under one lexicon."""
    if text.isascii():
        return text
    if memo is None or len(text) > LONGEST:
        return _mended(text, around, content)
    if (found := memo.get(text)) is None:
        if len(memo) >= _MEMO:
            memo.clear()
        found = memo[text] = _mended(text, around, content)
    return found


def _mended(text: str, around: set | frozenset, content: set | frozenset) -> str:
    if _known(text, around, content):
        return text
    tried = {text}
    for read, charsets in _SWAPS.items():
        if (raw := _encoded(text, read)) is None:
            continue
        for written in charsets:
            try:
                true = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if true not in tried and (_known(true, around, content) or " › " in true and len(true) < 120):
                return true
            tried.add(true)
    return text


def classify(lines: list[Line], around: np.ndarray | set, content: np.ndarray | set, memo: dict[str, str] | None = None) -> None:
    """Sets each line's kind."""
    for n in lines:
        t = n.text
        if not t:
            n.kind = X
            continue
        if n.role >= 0 and around:
            t = mended(t, around, content, memo)
        h = _hash(_bare(t))
        lead = _lead(t)
        lead = _hash(lead) if lead else None
        if n.role < 0 or h in around or (lead is not None and lead in around and h not in content):
            n.kind = B
        elif n.linked >= 0.8 * len(t) and len(t) < 80 or t[0] == "©" or _CRUMBS.search(t) and len(t) < 120 and not t.endswith(_ENDS):
            n.kind = B
        elif t.endswith(_CUT):
            n.kind = T
        else:
            bare = _TRAIL.sub("", t)
            stops = len(_STOP.findall(bare))
            n.kind = P if stops > 1 else S if stops == 1 and bare.endswith((".", "!", "?", "。", "！", "？")) else L
            if h in content and n.kind == S:
                n.kind = L
    # A sentence led by the name that a heading ends with is about the page's topic.
    tails = {re.split(r"[:：]\s*", n.text)[-1] for n in lines if n.kind == L and (":" in n.text or "：" in n.text)}
    texts = Counter(n.text for n in lines if n.kind == S)
    for n in lines:
        if n.kind == S:
            if (lead := _lead(n.text)) and lead[:-2] in tails:
                n.kind = P
            elif texts[n.text] > 1:
                n.kind = T


def content_lines(body: str, mime: str, around: set | frozenset = frozenset(), content: set | frozenset = frozenset(), memo: dict[str, str] | None = None) -> list[int]:
    """Numbers, from 1, of the lines that carry main content."""
    lines, title = read_lines(body, mime != "text/plain")
    classify(lines, around, content, memo)
    topic = re.split(r"\s[|–—-]\s", title)[0].strip().lower()
    inside = [n.role > 0 for n in lines]
    if any(inside):  # the page says where its content is
        return [i + 1 for i, n in enumerate(lines) if inside[i] and n.kind in (S, P, L)]
    # Line blocks: sums of own text over windows of the lines that have any.
    own = [i for i, n in enumerate(lines) if n.kind != X]
    proof = np.array([len(lines[i].text.encode()) if lines[i].kind in (P, L) else 0 for i in own], np.int64)
    if not len(proof):
        return []
    sums = np.convolve(proof, np.ones(WINDOW, np.int64))[WINDOW // 2 :][: len(proof)]
    sure = np.flatnonzero((sums >= SURGE) & (proof > 0))
    if not len(sure):
        sure = np.flatnonzero(proof > 0) if proof.sum() >= SURGE else sure
        if not len(sure):
            return []
    kinds = [lines[i].kind for i in own]
    first, last = int(sure[0]), int(sure[-1])
    # The surge: a heading that names the page's topic, or else the earliest entry that no line of the site parts from the block.
    named = [k for k in range(0, len(own)) if topic and kinds[k] == L and topic in lines[own[k]].text.lower()]
    if named and named[0] <= last:
        first = min(named[0], first) if named[0] <= first else first
        first = named[0] if all(kinds[k] != P for k in range(first, named[0])) else first
    else:
        while first > 0 and kinds[first - 1] == L:
            first -= 1
    # The dive: what follows the last paragraph or entry of the block is the site's.
    while last + 1 < len(own) and kinds[last + 1] in (L, P):
        last += 1
    return [own[k] + 1 for k in range(first, last + 1) if kinds[k] in (S, P, L)]


def _decoded(raw: bytes | None) -> str:
    return raw.decode("utf-8", "replace") if raw else ""


def pages(responses: DataFrame) -> DataFrame:
    """(response_id, mime, body) of the pages that can have content."""
    fetched = spread(responses.select("response_id", "status", "mime", "body"))
    return fetched.where(F.col("status") == 200).where(F.col("mime").isin(*TYPES)).where("body is not null and response_id is not null").select("response_id", "mime", "body")


def learn_lexicon(responses: DataFrame, most: int = LEXICON) -> tuple[frozenset[int], frozenset[int]]:
    """Hashes of line texts and leads of the site and of content, counted over all pages that mark up their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for raw in b.column(2).to_pylist():
                text = _decoded(raw)
                if not _MARKS.search(text):
                    continue
                lines, _ = read_lines(text, True)
                if not any(n.role > 0 for n in lines):
                    continue
                for n in lines:
                    if n.role and n.text:
                        seen[_hash(_bare(n.text))][n.role > 0] += 1
                        if lead := _lead(n.text):
                            seen[_hash(lead)][n.role > 0] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array(keys, pa.int64()), "around": pa.array([seen[k][0] for k in keys], pa.int64()), "content": pa.array([seen[k][1] for k in keys], pa.int64())}
            )

    marked = pages(responses).where("mime <> 'text/plain'")
    sums = marked.mapInArrow(run, "h bigint, around bigint, content bigint").groupBy("h").agg(F.sum("around").alias("around"), F.sum("content").alias("content"))
    rows = sums.where("around + content > 1").orderBy(F.desc(F.col("around") + F.col("content")), "h").limit(most).collect()
    return frozenset(r.h for r in rows if r.around > 2 * r.content), frozenset(r.h for r in rows if r.content >= 2 * r.around)


def main_content(responses: DataFrame) -> DataFrame:
    """(response_id, line_no): the lines of each page that carry main content."""
    lexicon = learn_lexicon(responses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, content = lexicon
        memo: dict[str, str] = {}
        for b in batches:
            ids, numbers = [], []
            for i, mime, raw in zip(*(c.to_pylist() for c in b.columns)):
                found = content_lines(_decoded(raw), mime, around, content, memo)
                ids += [i] * len(found)
                numbers += found
            yield pa.RecordBatch.from_pydict({"response_id": pa.array(ids, pa.int64()), "line_no": pa.array(numbers, pa.int64())})

    return pages(responses).mapInArrow(run, "response_id bigint, line_no bigint")
