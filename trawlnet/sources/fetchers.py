"""Where responses come from: a table of captured pages, or HTTP."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from http.cookiejar import CookieJar
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.charsets import content_type
from trawlnet.functions.urls import normalized_url, parse

RESPONSE = "request_id string, url string, status int, headers array<struct<name: string, value: string>>, redirects array<string>, body binary, duration_ms bigint, error string"
MAX_REDIRECTS = 10


class Fetcher(Protocol):
    """Gives for requests (id, url, method, payload, headers) the columns of RESPONSE with mime and charset."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


class PagesFetcher:
    """Responses of captured pages, joined on the normalized URL; of several captures the latest counts, none gives no response."""

    def __init__(self, pages: DataFrame) -> None:
        keyed = pages.withColumn("_key", normalized_url(F.col("url")))
        last = keyed.groupBy("_key").agg(F.max("response_id").alias("response_id"))
        self.pages = keyed.join(last, ["_key", "response_id"], "left_semi").select("_key", F.col("url").alias("_url"), "status", "headers", "redirects", "body", "mime", "charset")

    def __call__(self, requests: DataFrame) -> DataFrame:
        r = requests.select(F.col("id").alias("request_id"), "url", normalized_url(F.col("url")).alias("_key"))
        out = r.join(self.pages, "_key", "left")
        return out.select(
            "request_id", F.coalesce("_url", "url").alias("url"), "status", "headers", "redirects", "body", F.lit(0).cast("bigint").alias("duration_ms"),
            F.when(F.col("status").isNull(), "no captured page").alias("error"), "mime", "charset",
        )


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


def next_hop(status: int, method: str, location: str, url: str, headers: dict[str, str]) -> tuple[str, str, dict[str, str]] | None:
    """(url, method, headers) of a redirect, or None: 303, and 301 and 302 after POST, become GET; credentials and cookies
    don't go to another origin."""
    if status not in (301, 302, 303, 307, 308):
        return None
    base = parse(url)
    target = parse(location, base)
    if not target or target.scheme not in ("http", "https"):
        return None
    get = status == 303 and method != "HEAD" or status in (301, 302) and method == "POST"
    keep = {k: v for k, v in headers.items() if target.origin == base.origin or k.lower() not in ("authorization", "proxy-authorization", "cookie")}
    return target.href, "GET" if get else method, keep


class HttpFetcher:
    """Fetches over HTTP from the workers, hosts kept together; bodies above `max_body` are cut there as errors.

    A task that runs again fetches again, so write the result before using it. Speculation should be off.
    """

    def __init__(self, timeout: float = 30, max_body: int = 100 << 20, user_agent: str = "trawlnet/1.0") -> None:
        self.timeout, self.max_body, self.user_agent = timeout, max_body, user_agent

    def __call__(self, requests: DataFrame) -> DataFrame:
        timeout, most, agent = self.timeout, self.max_body, self.user_agent

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            jar = CookieJar()
            opener = urllib.request.build_opener(_NoRedirect, urllib.request.HTTPCookieProcessor(jar))
            for f in frames:
                rows = [_fetch(opener, *r, timeout, most, agent) for r in f[["id", "url", "method", "payload", "headers"]].itertuples(index=False)]
                yield pd.DataFrame(rows, columns=["request_id", "url", "status", "headers", "redirects", "body", "duration_ms", "error"])

        host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
        got = requests.select("id", "url", "method", "payload", "headers").repartition(host).mapInPandas(run, RESPONSE)
        header = F.filter("headers", lambda h: F.lower(h["name"]) == "content-type")
        kind = content_type(F.when(F.size(header) > 0, header[0]["value"]))
        return got.select("*", kind["mime"].alias("mime"), kind["charset"].alias("charset"))


def _fetch(opener, rid, url, method, payload, headers, timeout: float, most: int, agent: str) -> tuple:
    began, redirects = time.monotonic(), []
    method, headers = method or "GET", {"User-Agent": agent, "Accept-Encoding": "gzip, deflate"} | dict(headers or {})
    body = payload.encode() if payload else None

    def out(status=None, hs=None, data=None, error=None) -> tuple:
        return rid, url, status, hs or [], redirects, data, int((time.monotonic() - began) * 1000), error

    try:
        for _ in range(MAX_REDIRECTS + 1):
            left = timeout - (time.monotonic() - began)
            if left <= 0:
                return out(error="timed out")
            request = urllib.request.Request(url, data=body, headers=headers, method=method)
            try:
                answer = opener.open(request, timeout=left)
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                hs = [{"name": k, "value": v} for k, v in answer.headers.items()]
                hop = next_hop(answer.status, method, answer.headers.get("Location") or "", url, headers)
                if hop:
                    redirects.append(hop[0])
                    body = body if hop[1] == method else None
                    url, method, headers = hop
                    continue
                data = answer.read(most + 1)
                if len(data) > most:
                    return out(answer.status, hs, None, "body too large")
                coding = (answer.headers.get("Content-Encoding") or "").lower()
                if coding in ("gzip", "deflate") and data:
                    data = zlib.decompress(data, 47)
                return out(answer.status, hs, data)
        return out(error="too many redirects")
    except (OSError, ValueError, zlib.error) as e:
        return out(error=str(e))
