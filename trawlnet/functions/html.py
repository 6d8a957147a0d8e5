"""A lenient HTML tokenizer, link extraction and CSS selection over captured pages.

Links are read from the token stream: no tree is built, comments and scripts hold no links, templates and noscript
elements do. `select` builds a tree and is for everything else. Both are Arrow functions that parse a page once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.functions.urls import URL_PARTS, Url, _parts, parse, parsed

_RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEXT = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_ATTR = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?)""")
_ENTITY = re.compile(r"&(?:#([xX][0-9a-fA-F]+|[0-9]+);?|([A-Za-z][A-Za-z0-9]*);?)")
#: What numbers 128 to 159 stand for in character references.
_C1 = dict(zip(range(0x80, 0xA0), "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"))


def _number(digits: str) -> str:
    n = int(digits[1:], 16) if digits[0] in "xX" else int(digits)
    if n in _C1:
        return _C1[n]
    return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else "�"


def unescape(text: str, attribute: bool = False) -> str:
    """Character references resolved; in attributes a name without semicolon before '=' or a letter stays."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            return _number(m[1])
        name, whole = m[2], m.group()
        if whole.endswith(";") and f"{name};" in html5:
            return html5[f"{name};"]
        for n in range(len(name), 1, -1):
            if name[:n] in html5:
                rest = name[n:] + (";" if whole.endswith(";") else "")
                after = rest[:1] or m.string[m.end() : m.end() + 1]
                if attribute and (after == "=" or after.isalnum() and after.isascii()):
                    return whole
                return html5[name[:n]] + rest
        return whole

    return _ENTITY.sub(one, text)


def tokens(html: str) -> Iterator[tuple]:
    """('start', name, attributes, self closing), ('end', name) and ('text', raw text) of a page, in order."""
    at, n = 0, len(html)
    while at < n:
        m = _NEXT.search(html, at)
        if not m:
            yield "text", html[at:]
            return
        if m.start() > at:
            yield "text", html[at : m.start()]
        if m[1]:
            end = html.find("-->", m.start() + 2)
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        name, pos, attributes = m[4].lower(), m.end(), {}
        while True:
            a = _ATTR.match(html, pos)
            if not a or not a[1]:
                break
            pos = a.end()
            value = next((v for v in a.groups()[1:] if v is not None), "")
            quote = html[pos : pos + 1]
            if value == "" and quote in ('"', "'") and html[: pos].rstrip().endswith("="):
                return  # an open quote swallows the rest of the page
            attributes.setdefault(a[1].lower(), unescape(value, True))
        close = html.find(">", pos)
        if close < 0:
            return
        at = close + 1
        if m[3]:
            yield "end", name
            continue
        closed = html[close - 1] == "/"
        yield "start", name, attributes, closed
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            end = stop.start() if stop else n
            if end > at:
                yield "text", html[at:end]
            at = end


# --- selectors ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True, slots=True)
class _Simple:
    tag: str | None
    tests: tuple[tuple, ...]


_PART = re.compile(
    r"\s*(?P<comma>,)\s*|\s*(?P<comb>[>+~])\s*|(?P<space>\s+)|(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iI])?\s*)?\]"
    r"|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?"
)


@lru_cache(1024)
def compile_selector(css: str) -> tuple[tuple[tuple[str, _Simple], ...], ...]:
    """The alternatives of a selector, each a chain of (combinator before, compound). Raises ValueError."""
    alternatives, chain, tag, tests, comb, at = [], [], None, [], "", 0
    css = css.strip()
    if not css:
        raise ValueError("empty selector")

    def shut() -> None:
        nonlocal tag, tests, comb
        if tag is None and not tests:
            raise ValueError(f"cannot read selector {css!r}")
        chain.append((comb, _Simple(None if tag in (None, "*") else tag, tuple(tests))))
        tag, tests, comb = None, [], ""

    while at < len(css):
        m = _PART.match(css, at)
        if not m:
            raise ValueError(f"cannot read selector {css!r}")
        at = m.end()
        if m["comma"]:
            shut()
            alternatives.append(tuple(chain))
            chain = []
        elif m["comb"] or m["space"]:
            shut()
            comb = m["comb"] or " "
        elif m["tag"]:
            tag = m["tag"].lower()
        elif m["id"]:
            tests.append(("attr", "id", "=", m["id"], False))
        elif m["class"]:
            tests.append(("attr", "class", "~=", m["class"], False))
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            tests.append(("attr", m["attr"].lower(), m["op"], value, bool(m["flag"])))
        else:
            name, arg = m["pseudo"].lower(), m["arg"]
            if name in ("not", "is", "where", "has"):
                tests.append((name, compile_selector(arg or "")))
            elif name in ("first-child", "last-child", "only-child", "empty", "root", "first-of-type", "last-of-type"):
                tests.append((name,))
            elif name in ("nth-child", "nth-of-type"):
                f = re.fullmatch(r"(?:([+-]?\d*)n)?\s*([+-]?\s*\d+)?", {"odd": "2n+1", "even": "2n"}.get((arg or "").strip(), (arg or "").strip()))
                if not f or not f.group():
                    raise ValueError(f"cannot read selector {css!r}")
                a = 0 if f[1] is None else int(f[1] + "1") if f[1] in ("", "+", "-") else int(f[1])
                tests.append((name, a, int((f[2] or "0").replace(" ", ""))))
            else:
                raise ValueError(f"unknown pseudo class in {css!r}")
    shut()
    return tuple([*alternatives, tuple(chain)])


def is_streaming_selector(css: str) -> bool:
    """Whether links can be picked from the token stream: no siblings, and nothing that looks ahead."""
    return all(c in ("", " ", ">") and all(t[0] in ("attr", "not") for t in s.tests) for chain in compile_selector(css) for c, s in chain)


def _attr_ok(value: str | None, op: str | None, want: str | None, fold: bool) -> bool:
    if value is None:
        return False
    if op is None:
        return True
    if fold:
        value, want = value.lower(), want.lower()
    return {
        "=": lambda: value == want,
        "~=": lambda: want in value.split(),
        "|=": lambda: value == want or value.startswith(f"{want}-"),
        "^=": lambda: bool(want) and value.startswith(want),
        "$=": lambda: bool(want) and value.endswith(want),
        "*=": lambda: bool(want) and want in value,
    }[op]()


@dataclass(slots=True, eq=False)
class Element:
    name: str
    attrs: dict[str, str]
    parent: Element | None = None
    children: list = field(default_factory=list)  # elements and texts

    @property
    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def descendants(self) -> Iterator[Element]:
        stack = self.elements[::-1]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(e.elements[::-1])

    @property
    def text(self) -> str:
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack.extend(c.children[::-1])
        return "".join(out)

    @property
    def inner_html(self) -> str:
        raw = self.name in _RAW and self.name not in ("title", "textarea")
        return "".join(c.html if isinstance(c, Element) else c if raw else c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for c in self.children)

    @property
    def html(self) -> str:
        attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.name}{attrs}>" + ("" if self.name in VOID else f"{self.inner_html}</{self.name}>")

    def select(self, css: str) -> list[Element]:
        """The descendants that match, in document order."""
        compiled = compile_selector(css)
        return [e for e in self.descendants() if matches(e, compiled)]


def _siblings(e: Element, same_type: bool = False) -> list[Element]:
    return [x for x in (e.parent.elements if e.parent else [e]) if not same_type or x.name == e.name]


def _simple_ok(e: Element, s: _Simple) -> bool:
    if s.tag is not None and e.name != s.tag:
        return False
    for t in s.tests:
        kind = t[0]
        if kind == "attr":
            ok = _attr_ok(e.attrs.get(t[1]), *t[2:])
        elif kind == "not":
            ok = not matches(e, t[1])
        elif kind in ("is", "where"):
            ok = matches(e, t[1])
        elif kind == "has":
            ok = any(matches(x, t[1]) for x in e.descendants())
        elif kind == "empty":
            ok = not e.children
        elif kind == "root":
            ok = e.parent is None or e.parent.parent is None
        elif kind.startswith("nth"):
            i = _siblings(e, kind == "nth-of-type").index(e) + 1 - t[2]
            ok = i == 0 if t[1] == 0 else i % t[1] == 0 and i // t[1] >= 0
        else:
            own = _siblings(e, kind.endswith("type"))
            ok = (not kind.startswith(("first", "only")) or own[0] is e) and (not kind.startswith(("last", "only")) or own[-1] is e)
        if not ok:
            return False
    return True


def matches(e: Element, compiled: tuple) -> bool:
    """Whether an element of a tree matches a compiled selector."""

    def up(e: Element, chain: tuple, i: int) -> bool:
        if not _simple_ok(e, chain[i][1]):
            return False
        if i == 0:
            return True
        comb = chain[i][0]
        if comb in ("+", "~"):
            own = _siblings(e)
            before = own[: own.index(e)]
            return any(up(x, chain, i - 1) for x in (before[-1:] if comb == "+" else before))
        p = e.parent
        while p is not None:
            if up(p, chain, i - 1):
                return True
            if comb == ">":
                return False
            p = p.parent
        return False

    return any(up(e, chain, len(chain) - 1) for chain in compiled)


#: Elements whose start ends an open element of the kind before the colon.
_ENDS = {
    k: frozenset(v.split())
    for k, v in {
        "p": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul",
        "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody tfoot thead", "td": "td th tr tbody tfoot", "th": "td th tr tbody tfoot",
        "option": "option optgroup", "thead": "tbody tfoot", "tbody": "tbody tfoot",
    }.items()
}


def document(html: str) -> Element:
    """The page as a tree; contents of templates are left out, as in a browser's."""
    root = here = Element("#document", {})
    hidden = 0
    for t in tokens(html):
        if t[0] == "text":
            if not hidden:
                here.children.append(t[1] if here.name in _RAW and here.name not in ("title", "textarea") else unescape(t[1]))
        elif t[0] == "start":
            _, name, attrs, closed = t
            if hidden:
                hidden += name == "template"
                continue
            while here.parent is not None and name in _ENDS.get(here.name, ()):
                here = here.parent
            e = Element(name, attrs, here)
            here.children.append(e)
            if name == "template":
                hidden = 1
            elif name not in VOID and not (closed and name in ("svg", "path", "circle", "use")):
                here = e
        elif hidden:
            hidden -= t[1] == "template"
        else:
            e = here
            while e.parent is not None and e.name != t[1]:
                e = e.parent
            if e.parent is not None:
                here = e.parent
    return root


#: A comment, a declaration, or a whole tag with its attributes; last, a tag that isn't whole.
_SCAN = re.compile(r"<!--.*?-->|<[!?][^>]*>|<([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"']))*+)>|</[A-Za-z](?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"']))*+>|<(?:!--|/?[A-Za-z])", re.S)


def _scanned(html: str, names: frozenset[str]) -> list[tuple[str, dict[str, str]]] | None:
    """(name, attributes) of the elements with these names that start in the page; None if a tag isn't whole, which
    tokens() is for. Other tags are passed over without a look at their attributes."""
    out, at = [], 0
    while m := _SCAN.search(html, at):
        at = m.end()
        name = m[1]
        if name is None:
            if m.group() == "<!--" or m.end() - m.start() < 3 or m.group()[-1] != ">":
                return None
            continue
        name = name.lower()
        if name in names:
            attributes: dict[str, str] = {}
            for a in _ATTR.finditer(m[2]):
                if a[1]:
                    attributes.setdefault(a[1].lower(), unescape(next((v for v in a.groups()[1:] if v is not None), ""), True))
            out.append((name, attributes))
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if not stop:
                break
            at = stop.start()
    return out


def link_urls(html: str, selector: str = "a", base_url: str | None = None) -> list[Url]:
    """The URLs of the elements that match, in document order, repeated ones included.

    The first base element wherever it stands holds for all; empty references are dropped, blank ones are the page itself.
    """
    base = parsed(base_url) if base_url else None
    compiled = compile_selector(selector)
    hrefs: list[str] = []
    bases: list[str] = []
    if not is_streaming_selector(selector):
        tree = document(html)
        hrefs = [e.attrs.get("href") for e in tree.select(selector)]
        bases = [e.attrs["href"] for e in tree.select("base[href]")]
    else:
        flat = all(len(chain) == 1 for chain in compiled)
        tags = {chain[0][1].tag for chain in compiled} if flat else {None}
        found = None if None in tags else _scanned(html, frozenset(tags) | {"base"})
        if found is not None:
            starts = ((name, attrs, True) for name, attrs in found)
        else:
            starts = ((t[1], t[2], t[3]) if t[0] == "start" else (t[1], None, True) for t in tokens(html) if t[0] != "text")
        here = Element("#document", {})
        for name, attrs, closed in starts:
            if attrs is None:
                if not flat:
                    e = here
                    while e.parent is not None and e.name != name:
                        e = e.parent
                    here = e.parent or here
                continue
            e = Element(name, attrs, here)
            if "href" in attrs:
                if name == "base":
                    bases.append(attrs["href"])
                if matches(e, compiled):
                    hrefs.append(attrs["href"])
            if not flat and name not in VOID and not closed:
                here = e
    if bases:
        base = parse(bases[0].strip(), base) or base
    urls = (parse(h, base) for h in hrefs if h)
    return [u for u in urls if u]


def links(html: str, selector: str = "a", base_url: str | None = None) -> list[str]:
    """link_urls() as texts."""
    return [u.href for u in link_urls(html, selector, base_url)]


def title(html: str) -> str | None:
    """The trimmed text of the first title."""
    inside = False
    for t in tokens(html):
        if t[0] == "start" and t[1] == "title":
            inside = True
        elif inside:
            return unescape(t[1]).strip() if t[0] == "text" else ""
    return None


LINKS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("url", URL_PARTS)]))
ELEMENTS = T.ArrayType(
    T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("html", T.StringType())]
    )
)


def link_rows(pages: DataFrame, keep: list[str], html: str = "text", base_url: str = "loaded_url", selector: str = "a", repeats: bool = True) -> DataFrame:
    """A row for each link of each page: the columns `keep` of the page, `pos`, `is_first` (no link before it on the page has
    its URL) and the parsed URL as `_u`; without `repeats` only the first of each URL. Each page is parsed once, whatever
    filters follow, and no list of a page's links is ever made a value of a row."""
    compile_selector(selector)
    names = [f.name for f in URL_PARTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, firsts, urls = [], [], [], []
            for i, (h, base) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                seen: set[str] = set()
                for pos, u in enumerate(link_urls(h, selector, base) if h is not None else ()):
                    first = u.href not in seen
                    if first or repeats:
                        rows.append(i)
                        places.append(pos)
                        firsts.append(first)
                        urls.append(_parts(u))
                        seen.add(u.href)
            columns = list(zip(*urls)) or [[]] * len(names)
            parsed = pa.StructArray.from_arrays([pa.array(c, pa.int32() if n == "port" else pa.string()) for n, c in zip(names, columns)], names)
            at = pa.array(rows, pa.int64())
            own = [b.column(k).take(at) for k in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), pa.array(firsts, pa.bool_()), parsed], names=[*keep, "pos", "is_first", "_u"])

    fields = [pages.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("pos", T.IntegerType()), T.StructField("is_first", T.BooleanType()), T.StructField("_u", URL_PARTS)])
    return pages.select(F.col(html).alias("_html"), F.col(base_url).alias("_base_url"), *keep).mapInArrow(run, schema)


def page_links(html: Column, base_url: Column, selector: str = "a") -> Column:
    """The links of a page as an array of (pos, url parts)."""
    compile_selector(selector)

    @F.pandas_udf(LINKS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = [f.name for f in URL_PARTS]
        for pages, bases in parts:
            out = []
            for h, b in zip(pages, bases):
                found = link_urls(h, selector, b if isinstance(b, str) else None) if isinstance(h, str) else []
                out.append([{"pos": i, "url": dict(zip(names, _parts(u)))} for i, u in enumerate(found)])
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()(html, base_url)  # else a filter on its result runs it a second time


def page_title(html: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([title(x) if isinstance(x, str) else None for x in s], dtype=object)

    return run(html)


def select(html: Column, css: str) -> Column:
    """The elements that match, in document order, as (name, text, attrs, html); text, attr and first are then native."""
    compile_selector(css)

    @F.pandas_udf(ELEMENTS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(
                [[{"name": e.name, "text": e.text, "attrs": e.attrs, "html": e.html} for e in document(x).select(css)] if isinstance(x, str) else [] for x in s],
                dtype=object,
            )

    return run(html)


def with_page(html: Column, extract: Callable[[Element], str | None]) -> Column:
    """A function of your own over the parsed page, giving a text."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([extract(document(x)) if isinstance(x, str) else None for x in s], dtype=object)

    return run(html)
