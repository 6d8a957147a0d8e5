"""URL parsing by the web's URL standard, normalization and scope decisions.

Parsing needs an Arrow function, as no built-in one normalizes; it runs once for a column and gives a struct, and all
decisions over that struct are native expressions.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import quote, quote_plus, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Special schemes and their default ports.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
STRATEGIES = ("all", "same-hostname", "same-domain", "same-origin")

# What stays as it is in each part; quote() keeps letters, digits and "_.-~".
_SAFE_FRAGMENT = "!#$%&'()*+,/:;=?@[\\]^{|}"
_SAFE_QUERY = "!$%&()*+,/:;=?@[\\]^`{|}"  # without the apostrophe: special schemes escape it
_SAFE_PATH = "!$%&'()*+,/:;=@[\\]^|"
_SAFE_USER = "!$%&'()*+,"
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_TRIM = "".join(map(chr, range(0x21)))


@dataclass(frozen=True, slots=True)
class Url:
    scheme: str
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None
    user: str = ""
    opaque: bool = False

    @property
    def special(self) -> bool:
        return self.scheme in PORTS

    @property
    def authority(self) -> str:
        return f"{self.host}{'' if self.port is None else f':{self.port}'}"

    @property
    def origin(self) -> str | None:
        return f"{self.scheme}://{self.authority}" if self.special and self.scheme != "file" else None

    @property
    def href(self) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            out += f"//{self.user}{'@' if self.user else ''}{self.authority}"
        elif not self.opaque and self.path.startswith("//"):
            out += "/."
        out += self.path
        if self.query is not None:
            out += f"?{self.query}"
        return out if self.fragment is None else f"{out}#{self.fragment}"


def _quoted(text: str, safe: str) -> str:
    return text if text.isascii() and text.isalnum() else quote(text, safe=safe, errors="replace")


def _host(text: str, special: bool) -> str | None:
    """The host as it's written in a URL; None if it can't be one."""
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]" if text.endswith("]") else None
        except ValueError:
            return None
    if not special:
        return None if re.search(r"[\x00\t\n\r #/<>?@\[\\\]^|]", text) else quote(text, safe="!\"$%&'()*+,;=`{}~:")
    try:
        name = unquote_to_bytes(text).decode("utf-8") if "%" in text else text
        if not name.isascii() or "xn--" in name.lower():
            name = ".".join(_label(x) for x in re.split("[.。．｡]", name))
    except (UnicodeError, ValueError):
        return None
    name = name.lower()
    if not name or _BAD_HOST.search(name):
        return None
    last = name.removesuffix(".").rpartition(".")[2]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        return _ipv4(name.removesuffix("."))
    return name


def _label(label: str) -> str:
    import encodings.idna

    return label.lower() if label.isascii() else encodings.idna.ToASCII(encodings.idna.nameprep(label)).decode()


def _ipv4(name: str) -> str | None:
    parts = name.split(".")
    if len(parts) > 4:
        return None
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p, 16) if p[:2] == "0x" and len(p) > 2 else 0 if p == "0x" else int(p, 8) if p[:1] == "0" and len(p) > 1 else int(p))
        except ValueError:
            return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _segments(path: str, before: list[str], special: bool) -> str:
    """The path with dot segments resolved on top of `before`."""
    if special:
        path = path.replace("\\", "/")
    out, parts = list(before), path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        plain = p.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_quoted(p, _SAFE_PATH))
    return "/" + "/".join(out)


def _tail(text: str, special: bool) -> tuple[str, str | None, str | None]:
    head, hash_, fragment = text.partition("#")
    head, mark, query = head.partition("?")
    safe = _SAFE_QUERY if special else _SAFE_QUERY + "'"
    return head, quote(query, safe=safe, errors="replace") if mark else None, quote(fragment, safe=_SAFE_FRAGMENT, errors="replace") if hash_ else None


def _with_authority(scheme: str, rest: str) -> Url | None:
    special = scheme in PORTS
    m = re.match(r"[^/\\?#]*" if special else r"[^/?#]*", rest)
    authority, rest = m.group(), rest[m.end() :]
    user, at, hostport = authority.rpartition("@")
    h = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", hostport)
    if not h or at and not h[1]:
        return None
    host = _host(h[1], special) if h[1] else None if special and scheme != "file" else ""
    if host is None:
        return None
    if scheme == "file" and host == "localhost":
        host = ""
    port = int(h[2]) if h[2] else None
    if port is not None and port > 65535:
        return None
    path, query, fragment = _tail(rest, special)
    name, colon, secret = user.partition(":")
    user = _quoted(name, _SAFE_USER) + (f":{_quoted(secret, _SAFE_USER)}" if colon and secret else "") if user else ""
    path = _segments(path[1:], [], special) if path else "/" if special else ""
    return Url(scheme, host, None if port == PORTS.get(scheme, -1) else port, path, query, fragment, user)


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """The URL a text denotes, relative to `base` if there is one; None for what is no URL."""
    if text is None:
        return None
    s = re.sub("[\t\n\r]", "", text.strip(_TRIM))
    m = _SCHEME.match(s)
    if m:
        scheme, rest = m[1].lower(), s[m.end() :]
        if scheme in PORTS:
            if base and base.scheme == scheme and not re.match(r"[/\\]", rest):
                return _relative(rest, base)
            if scheme == "file" and not re.match(r"[/\\]{2}", rest):
                return _relative(rest, base) if base and base.scheme == "file" else _with_authority("file", rest if rest[:1] in ("/", "\\") else f"/{rest}")
            return _with_authority(scheme, re.sub(r"^[/\\]{2}" if scheme == "file" else r"^[/\\]*", "", rest))
        if rest.startswith("//"):
            return _with_authority(scheme, rest[2:])
        path, query, fragment = _tail(rest, False)
        if path.startswith("/"):
            return Url(scheme, None, None, _segments(path[1:], [], False), query, fragment)
        return Url(scheme, None, None, quote(path, safe=_SAFE_FRAGMENT + "\"<>` ~", errors="replace"), query, fragment, opaque=True)
    if base is None or base.opaque and not s.startswith("#"):
        return None
    return _relative(s, base)


def _relative(s: str, base: Url) -> Url | None:
    slashes = re.match(r"[/\\]{2}" if base.special else "//", s)
    if slashes:
        return _with_authority(base.scheme, re.sub(r"^[/\\]*", "", s) if base.special and base.scheme != "file" else s[2:])
    path, query, fragment = _tail(s, base.special)
    if not path:
        return replace(base, query=base.query if query is None else query, fragment=fragment)
    if path[0] == "/" or base.special and path[0] == "\\":
        return replace(base, path=_segments(path[1:], [], base.special), query=query, fragment=fragment)
    return replace(base, path=_segments(path, base.path.split("/")[1:-1], base.special), query=query, fragment=fragment)


@lru_cache(1 << 14)
def parsed(text: str) -> Url | None:
    """parse() that remembers; pages share base URLs."""
    return parse(text)


def normalize(text: str | None, keep_fragment: bool = False) -> str | None:
    """The form of a URL that requests are told apart by; None for what is no URL.

    Tracking parameters (utm_*) and user info go, parameters are sorted by name (by UTF-16 code units, stable) and form
    encoded, one slash at the end goes, the fragment stays only if it's wanted and not empty.
    """
    url = parse(text.strip()) if text else None
    if url is None:
        return None
    query = ""
    if url.query:
        pairs = []
        for p in url.query.split("&"):
            if p:
                name, _, value = p.partition("=")
                name, value = (unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace") for x in (name, value))
                if not name.startswith("utm_"):
                    pairs.append((name, value))
        pairs.sort(key=lambda p: p[0].encode("utf-16-be"))
        query = "&".join(f"{_form(n)}={_form(v)}" for n, v in pairs)
    out = f"{url.scheme}://{url.authority if url.host is not None else ''}{url.path.removesuffix('/')}"
    out += f"?{query}" if query else ""
    return f"{out}#{url.fragment}" if keep_fragment and url.fragment else out


def _form(text: str) -> str:
    return quote_plus(text, safe="*").replace("~", "%7E")


URL_PARTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("href", "scheme", "host")]
    + [T.StructField("port", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("path", "query", "fragment", "origin")]
)


def _parts(url: Url | None) -> tuple:
    return (url.href, url.scheme, url.host, url.port, url.path, url.query, url.fragment, url.origin) if url else (None,) * 8


def _frame(urls: list[Url | None]) -> pd.DataFrame:
    out = pd.DataFrame([_parts(u) for u in urls], columns=[f.name for f in URL_PARTS], dtype=object)
    out["port"] = out["port"].astype("Int32")
    return out


@F.pandas_udf(URL_PARTS)
def url_parts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The parsed URL; all fields are null for what is no URL."""
    for s in parts:
        yield _frame([parsed(x) if isinstance(x, str) else None for x in s])


@F.pandas_udf(T.StringType())
def resolve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """resolve(href, base): the absolute URL of a reference; null where either is no URL."""
    for hrefs, bases in parts:
        out = []
        for h, b in zip(hrefs, bases):
            base = parsed(b) if isinstance(b, str) else None
            url = parse(h, base) if isinstance(h, str) and (base or not isinstance(b, str)) else None
            out.append(url.href if url else None)
        yield pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _normalized(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for urls, keeps in parts:
        yield pd.Series([normalize(u, bool(k)) if isinstance(u, str) else None for u, k in zip(urls, keeps.fillna(False))], dtype=object)


def normalized_url(url: Column, keep_fragment: Column | bool = False) -> Column:
    return _normalized(url, keep_fragment if isinstance(keep_fragment, Column) else F.lit(keep_fragment))


def encode_uri_component(c: Column) -> Column:
    """Percent-encoding that keeps A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def domain_key(host: Column, domain: Column) -> Column:
    """What pacing goes by: the registrable domain, else the host, in lower case without trailing dots."""
    return F.coalesce(domain, F.regexp_replace(F.lower(host), r"\.+$", ""))


def _no_dot(host: Column) -> Column:
    return F.regexp_replace(host, r"\.$", "")


def in_scope(strategy: Column, target: Column, origin: Column, target_domain: Column, origin_domain: Column) -> Column:
    """Whether a URL (struct URL_PARTS) is in the scope of another one under a strategy. Native.

    The domains are registrable domains; where the origin has none, same-domain compares origins.
    """
    same_origin = target["origin"].eqNullSafe(origin["origin"]) & target["origin"].isNotNull()
    known_domain = target_domain.eqNullSafe(origin_domain)
    return (
        F.when(target["href"].isNull() | origin["href"].isNull(), False)
        .when(strategy == "all", True)
        .when(strategy == "same-hostname", _no_dot(target["host"]).eqNullSafe(_no_dot(origin["host"])))
        .when(strategy == "same-domain", F.when(origin_domain.isNotNull(), known_domain).otherwise(same_origin))
        .when(
            strategy == "same-origin",
            target["scheme"].eqNullSafe(origin["scheme"]) & target["host"].eqNullSafe(origin["host"]) & target["port"].eqNullSafe(origin["port"]),
        )
        .otherwise(False)
    )


def rejection(strategy: Column, target: Column, origin: Column, target_domain: Column, origin_domain: Column) -> Column:
    """Why a URL isn't enqueued by scheme and strategy: 'scheme', 'unparsable', 'strategy', or null if it is. Where the
    origin is no URL every http(s) target passes."""
    return (
        F.when(target["href"].isNull(), "unparsable")
        .when(~target["scheme"].isin("http", "https"), "scheme")
        .when(origin["href"].isNull(), F.lit(None).cast("string"))
        .when(~in_scope(strategy, target, origin, target_domain, origin_domain), "strategy")
    )


def filter_base(strategy: Column, explicit: Column, original: Column, final: Column, original_domain: Column, final_domain: Column) -> Column:
    """The URL that links are compared with: an explicit base, else the final URL for 'all' and for redirects within the
    domain under 'same-domain', else the original."""
    stayed = original_domain.eqNullSafe(final_domain)
    return F.coalesce(explicit, F.when((strategy == "all") | (strategy == "same-domain") & stayed, F.coalesce(final, original)).otherwise(original))
