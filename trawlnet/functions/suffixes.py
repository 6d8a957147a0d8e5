"""Registrable domains by the public suffix list's ICANN section."""

from __future__ import annotations

import ipaddress
import os
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(1)
def suffix_rules() -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """(plain, wildcard, exception) rules, from the list in the HTTP client library that Spark ships.

    TRAWLNET_SUFFIX_LIST names another copy of the list. Without any, every top-level domain is a suffix.
    """
    text = ""
    if own := os.environ.get("TRAWLNET_SUFFIX_LIST"):
        text = Path(own).read_text("utf-8")
    else:
        for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("httpclient-*.jar")):
            with zipfile.ZipFile(jar) as z:
                text = z.read("mozilla/public-suffix-list.txt").decode("utf-8")
    icann = text.partition("===BEGIN ICANN DOMAINS===")[2].partition("===END ICANN DOMAINS===")[0]
    plain, wild, exceptions = set(), set(), set()
    for line in icann.splitlines():
        rule = line.split("//")[0].strip()
        if not rule:
            continue
        kept = exceptions if rule[0] == "!" else wild if rule.startswith("*.") else plain
        rule = rule.lstrip("!").removeprefix("*.")
        kept.add(rule)
        if not rule.isascii():
            kept.add(".".join("xn--" + x.encode("punycode").decode() if not x.isascii() else x for x in rule.split(".")))
    return frozenset(plain), frozenset(wild), frozenset(exceptions)


def registrable_domain(hostname: str | None) -> str | None:
    """The label above the longest public suffix, with that suffix.

    None for null and empty names, addresses, bare suffixes and single labels. One trailing dot is ignored; an unknown
    top-level domain is a suffix by itself.
    """
    if not hostname:
        return None
    host = hostname.lower().removesuffix(".")
    labels = host.split(".")
    if len(labels) < 2 or "" in labels or host[0] == "[" or _is_address(host):
        return None
    plain, wild, exceptions = suffix_rules()
    for i in range(len(labels)):
        rest = ".".join(labels[i:])
        if rest in exceptions:
            suffix = len(labels) - i - 1
            break
        if rest in plain or ".".join(labels[i + 1 :]) in wild:
            suffix = len(labels) - i
            break
    else:
        suffix = 1
    return ".".join(labels[-suffix - 1 :]) if suffix < len(labels) else None


def _is_address(host: str) -> bool:
    if not host[-1].isdigit():
        return ":" in host
    try:
        ipaddress.ip_address(host)
        return True
    except ValueError:
        return False


@F.pandas_udf(T.StringType())
def registrable_domains(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str | None] = {}
    for s in parts:
        if len(known) > 1 << 17:
            known.clear()
        for h in s.dropna().unique():
            if h not in known:
                known[h] = registrable_domain(h)
        yield s.map(known.get, na_action="ignore")


def hostname(url: Column) -> Column:
    """The lower-case host of a URL text, without user, port and trailing dots; null where there is none. JVM-side."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(url, " ", " ")), r"[\t\r\n]", "")
    authority = F.regexp_extract(clean, r"^(?i)[a-z][a-z0-9+.-]*:[/\\]{2,}([^/\\?#]*)", 1)
    host = F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:@]*)(?::\d*)?$", 1)
    return F.nullif(F.regexp_replace(F.lower(F.trim(host)), r"\.+$", ""), F.lit(""))
