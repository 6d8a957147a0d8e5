"""Sitemaps: decoding, parsing and lastmod values."""

from __future__ import annotations

import gzip
import re
import xml.parsers.expat
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.functions.instants import read_instant
from trawlnet.functions.text import js_number
from trawlnet.functions.urls import rejection, url_parts

#: The change frequencies there are.
CHANGE_FREQUENCIES = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")
_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "loc", "lastmod", "changefreq")] + [T.StructField("priority", T.DoubleType())])
PARSED = T.StructType([T.StructField("items", T.ArrayType(_ITEM)), T.StructField("error", T.StringType())])


_LASTMOD = re.compile(r"\d{4}(?:-\d\d(?:-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:?\d\d)?)?)?)?")


def is_lastmod(text: str) -> bool:
    """Whether a text is a lastmod in one of the protocol's forms."""
    return bool(_LASTMOD.fullmatch(text)) and any(x is not None for x in read_instant(text))


def parse_sitemap_xml(content: str) -> list[dict]:
    """The entries of a urlset or a sitemapindex in order. Raises ValueError for malformed XML.

    Entries without a location are dropped (in an index an empty one counts); unknown change frequencies and lastmods are ignored and
    don't replace known ones, a priority that's no number replaces any.
    """
    root = None
    items: list[dict] = []
    entry: dict | None = None
    path: list[str] = []
    text: list[str] = []

    def start(name: str, _: dict) -> None:
        nonlocal root, entry
        path.append(name)
        text.clear()
        if len(path) == 1:
            root = name
        elif name == "url" and root == "urlset" or name == "sitemap" and root == "sitemapindex":
            entry = {}

    def end(name: str) -> None:
        nonlocal entry
        value = "".join(text).strip()
        path.pop()
        text.clear()
        if entry is None:
            return
        if name in ("url", "sitemap") and len(path) == 1:
            if root == "urlset" and entry.get("loc"):
                items.append({"kind": "url", "loc": entry["loc"], "lastmod": entry.get("lastmod"), "changefreq": entry.get("changefreq"), "priority": entry.get("priority")})
            elif root == "sitemapindex" and "loc" in entry:
                items.append({"kind": "sitemap", "loc": entry["loc"], "lastmod": None, "changefreq": None, "priority": None})
            entry = None
        elif name == "loc":
            entry["loc"] = value
        elif name == "lastmod" and is_lastmod(value):
            entry["lastmod"] = value
        elif name == "changefreq" and value in CHANGE_FREQUENCIES:
            entry["changefreq"] = value
        elif name == "priority":
            entry["priority"] = js_number(value)

    p = xml.parsers.expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text.append
    try:
        p.Parse(content.lstrip("﻿ \t\r\n").encode(), True)
    except xml.parsers.expat.ExpatError as e:
        raise ValueError(str(e)) from None
    return items


def parse_sitemap_text(content: str) -> list[dict]:
    return [{"kind": "url", "loc": x.strip(), "lastmod": None, "changefreq": None, "priority": None} for x in content.splitlines() if x.strip()]


def decode_sitemap(body: bytes, url: str, mime: str | None) -> list[dict]:
    """The entries of a fetched sitemap: gzip is undone, then XML or text by type, name or first bytes. ValueError else."""
    path = url.split("#")[0].split("?")[0].lower()
    if body[:3] == b"\x1f\x8b\x08":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(str(e)) from None
        path = path.removesuffix(".gz")
    text = body.decode("utf-8", "replace")
    if body[:6] == b"<?xml " or mime in ("text/xml", "application/xml") or path.endswith(".xml"):
        return parse_sitemap_xml(text)
    if mime == "text/plain" or path.endswith(".txt"):
        return parse_sitemap_text(text)
    raise ValueError(f"unsupported sitemap type {mime}")


@F.pandas_udf(PARSED)
def parsed_sitemap(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """parsed_sitemap(bytes, url, mime): the entries, or why there are none."""
    for bodies, urls, mimes in parts:
        items, errors = [], []
        for b, u, m in zip(bodies, urls, mimes):
            try:
                items.append(decode_sitemap(bytes(b), u or "", m if isinstance(m, str) else None) if b is not None else [])
                errors.append(None if b is not None else "no body")
            except ValueError as e:
                items.append([])
                errors.append(str(e))
        yield pd.DataFrame({"items": pd.Series(items, dtype=object), "error": pd.Series(errors, dtype=object)})


def sitemap_rows(sitemaps: DataFrame, id_col: str = "sitemap_id", content_col: str = "content") -> DataFrame:
    """(id, pos, kind, loc, lastmod, changefreq, priority): the entries of stored sitemaps."""
    parsed = sitemaps.select(id_col, parsed_sitemap(F.encode(content_col, "UTF-8"), F.lit("sitemap.xml"), F.lit("application/xml")).alias("p"))
    return parsed.select(id_col, F.posexplode("p.items").alias("pos", "x")).select(id_col, "pos", "x.*")


def change_frequency(c: Column) -> Column:
    return F.when(c.isin(*CHANGE_FREQUENCIES), c)


def lastmod_utc(c: Column) -> Column:
    """A lastmod in the sitemap protocol's own forms, native: date-times (without a zone: UTC), dates, months, years."""
    t = F.trim(c)
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy-MM", "yyyy")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def traverse(seeds: DataFrame, responses: DataFrame, strategy: str = "same-hostname", max_depth: int = 8) -> DataFrame:
    """(origin_sitemap_url, kind, loc, lastmod, changefreq, priority, depth): all pages that sitemaps list, nested ones followed.

    `seeds` has `url`; `responses` are captured sitemaps (url, mime, body). Each step joins the sitemaps found in the last
    one that weren't visited yet, so there are at most `max_depth` steps; entries out of scope of their sitemap are left out.
    """
    from trawlnet.functions.suffixes import registrable_domains
    from trawlnet.session import written

    pages = responses.select(F.col("url").alias("_page"), parsed_sitemap("body", "url", "mime").alias("_p"))
    frontier = written(seeds.select("url").distinct(), "sitemaps")
    visited, found = frontier, []
    for depth in range(max_depth + 1):
        rows = frontier.join(pages, F.col("url") == F.col("_page")).select(F.col("url").alias("origin_sitemap_url"), F.explode("_p.items").alias("x")).select("origin_sitemap_url", "x.*")
        rows = rows.withColumn("_t", url_parts("loc")).withColumn("_o", url_parts("origin_sitemap_url"))
        rows = rows.withColumn("_td", registrable_domains(F.col("_t.host"))).withColumn("_od", registrable_domains(F.col("_o.host")))
        ok = rows.where(rejection(F.lit(strategy), F.col("_t"), F.col("_o"), F.col("_td"), F.col("_od")).isNull())
        step = written(ok.drop("_t", "_o", "_td", "_od").withColumn("depth", F.lit(depth)), "sitemap-step")
        found.append(step.where("kind = 'url'"))
        if depth == max_depth:
            break
        frontier = written(step.where("kind = 'sitemap'").select(F.col("loc").alias("url")).distinct().join(visited, "url", "left_anti"), "sitemaps")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
