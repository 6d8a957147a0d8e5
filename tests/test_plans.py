import io
import os
import sys
from contextlib import redirect_stdout
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trawlnet import configuration
from trawlnet.operators.enqueue import EnqueueOptions
from trawlnet.plans import oracle, queries
from trawlnet.plans.crawl import CrawlOptions, crawl
from trawlnet.sources.fetchers import PagesFetcher, next_hop


def _page(links=(), title="t"):
    return bytearray(f"<title>{title}</title>{''.join(f'<a href={x}>x</a>' for x in links)}".encode())


def _responses(spark, pages):
    rows = [(i, u, s, [], [], m, "utf-8", b) for i, (u, s, m, b) in enumerate(pages)]
    return spark.createDataFrame(rows, "response_id bigint, url string, status int, headers array<struct<name: string, value: string>>, redirects array<string>, mime string, charset string, body binary")


def test_crawl(spark):
    html = "text/html"
    pages = [
        ("https://e.com/start", 200, html, _page(["/a", "/b", "/a#x", "https://o.com/x", "mailto:a@b.c", "/error"])),
        ("https://e.com/a", 200, html, _page(["/c", "/start"])), ("https://e.com/b", 200, html, _page(["/c"])), ("https://e.com/c", 200, html, _page()),
        ("https://e.com/error", 500, html, _page()),
    ]
    seeds = spark.createDataFrame([("https://e.com/start", 1)], "url string, pos bigint")
    out = crawl(spark, seeds, PagesFetcher(_responses(spark, pages)), CrawlOptions(EnqueueOptions(), default_retries=1, extract=lambda p: p.select("id", F.length("text").alias("n"))))
    assert out.stopped == "finished"
    got = {r.url.rsplit("/", 1)[1]: r.crawl_depth for r in out.queue.collect()}
    assert got == {"start": 0, "a": 1, "b": 1, "error": 1, "c": 2}
    ends = {(r.outcome): r.n for r in out.attempts.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert ends == {"ok": 4, "retry": 1, "failed": 1}
    assert out.items.count() == 4 and out.queue.where("order_no is not null").count() == 0
    limited = crawl(spark, seeds, PagesFetcher(_responses(spark, pages)), CrawlOptions(max_requests=2, batch=1))
    assert limited.stopped == "limit" and limited.queue.where("order_no is null").count() == 2


def test_crawl_pages_to_the_end(spark, tmp_path):
    html = "text/html"
    pages = [("https://e.com/start", 200, html, _page(["/gone", "/busy"])), ("https://e.com/busy", 503, html, _page()), ("https://e.com/slow", 429, html, _page())]
    _responses(spark, pages).write.parquet(str(tmp_path / "responses.parquet"))
    got = {(r.crawl_depth, r.outcome, r.error_kind): r.n for r in queries.crawl_pages(spark, str(tmp_path), batch=3).collect()}
    assert got == {
        (0, "ok", None): 1, (0, "retry", "other"): 3, (0, "failed", "other"): 1, (0, "retry", "session"): 3, (0, "failed", "session"): 1,
        (1, "retry", "other"): 3, (1, "failed", "other"): 1,
    }


def test_crawl_with_handlers_and_robots(spark, monkeypatch):
    from trawlnet.plans import crawl as plan

    monkeypatch.setattr(plan, "PARTS", 3)
    html = "text/html"
    links = _page(["/a", "/b", "/private/x", "/flaky"])
    pages = [("https://e.com/start", 200, html, links), ("https://e.com/a", 200, html, _page(["/b", "/start"])), ("https://e.com/b", 200, html, _page(["/c"])), ("https://e.com/c", 200, html, _page()),
             ("https://e.com/private/x", 200, html, _page()), ("https://e.com/private/seed", 200, html, _page()), ("https://e.com/flaky", 503, html, _page())]
    seeds = spark.createDataFrame([("https://e.com/start", 1, "front"), ("https://e.com/private/seed", 2, None)], "url string, pos bigint, label string")
    robots = spark.createDataFrame([("https://e.com", "User-agent: *\nDisallow: /private/")], "origin string, content string")
    o = CrawlOptions(
        EnqueueOptions(label="detail"), batch=2, routes={"front": lambda p: p.select("id", F.lit("front").alias("item")), "detail": lambda p: p.select("id", F.lit("detail").alias("item"))},
        before=lambda b: b.withColumn("user_data", F.lit('{"seen":1}')), on_failed=lambda f: f.select("id", F.concat(F.lit("failed "), "error_message").alias("item")),
        on_error=lambda e: e.withColumn("no_retry", F.col("retry_count") >= 2),
    )
    out = crawl(spark, seeds, PagesFetcher(_responses(spark, pages)), o, robots)
    assert out.stopped == "finished"
    q = {r.url.removeprefix("https://e.com/"): r for r in out.queue.collect()}
    assert set(q) == {"start", "a", "b", "c", "flaky", "private/seed"} and all(r.order_no is None and r.handled_at for r in q.values())
    assert q["flaky"].retry_count == 2 and len(q["flaky"].error_messages) == 2 and q["b"].user_data == '{"seen":1}'
    assert {(r.outcome, r.error_message): r.n for r in out.attempts.groupBy("outcome", "error_message").agg(F.count("*").alias("n")).collect()} == {
        ("ok", None): 4, ("skipped", "robots.txt"): 1, ("retry", "status 503"): 1, ("failed", "status 503"): 1,
    }
    assert sorted(r.item for r in out.items.collect()) == ["detail"] * 3 + ["failed status 503", "front"]
    lost = crawl(spark, seeds, PagesFetcher(_responses(spark, pages)), CrawlOptions(routes={"other": lambda p: p.select("id", F.lit("").alias("item"))}))
    assert lost.stopped == "critical" and lost.attempts.where("error_message = 'no route for front'").count() == 1


def test_pages_are_parsed_once(spark, data):
    out = io.StringIO()
    with redirect_stdout(out):
        queries.link_frontier(spark, data).explain()
    plan = out.getvalue()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and plan.count("ArrowEvalPython") <= 2


def test_redirects():
    h = {"Cookie": "x", "Accept": "y"}
    assert next_hop(303, "POST", "/n", "https://e.com/a", h) == ("https://e.com/n", "GET", h)
    assert next_hop(302, "POST", "https://o.com/", "https://e.com/a", h) == ("https://o.com/", "GET", {"Accept": "y"})
    assert next_hop(307, "POST", "/n", "https://e.com/a", h)[1] == "POST"
    assert next_hop(200, "GET", "/n", "https://e.com/a", h) is None and next_hop(302, "GET", "ftp://x/", "https://e.com/a", h) is None


def test_configuration(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"storage_dir": "/f", "max_retries": 7}')
    c = configuration.load(str(f), {"TRAWLNET_STORAGE_DIR": "/e", "TRAWLNET_PURGE_ON_START": "0", "TRAWLNET_MAX_RETRIES": ""}, default_queue="q")
    assert (c.storage_dir, c.purge_on_start, c.max_retries, c.default_queue) == ("/e", False, 7, "q")


def test_streams(spark, tmp_path):
    from trawlnet.operators import pacing
    from trawlnet.streaming import stateful

    rows = [("d", 0, 1, "rate_limited", None, None), ("d", 1000, 2, "fetch", None, None), ("d", 2000, 3, "fetch", None, None), ("e", 5, 4, "fetch", None, None)]
    df = spark.createDataFrame(rows, "domain string, at_ms bigint, seq bigint, kind string, wait_ms bigint, interval_ms bigint")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful.start(stateful.backoff_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    key = lambda r: (r.domain, r.at_ms)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, pacing.backoff_states(df).collect())), key


def test_sitemap_source(spark, tmp_path):
    from trawlnet.sources.sitemap_source import SitemapSource

    (tmp_path / "s.xml").write_text("<urlset>" + "".join(f"<url><loc>https://e.com/{i}</loc></url>" for i in range(5)) + "</urlset>")
    spark.dataSource.register(SitemapSource)
    assert spark.read.format("sitemap").load(str(tmp_path / "s.xml")).where("pos > 2").count() == 2
    q = spark.readStream.format("sitemap").option("batch", "2").load(str(tmp_path / "s.xml")).writeStream.format("memory").queryName("sm").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    for _ in range(20):
        if spark.table("sm").count() >= 5:
            break
        q.processAllAvailable()
    q.stop()
    assert spark.table("sm").count() == 5


def test_entry_and_registration():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in os.listdir(data):
        c.execute(f"create view {t.split('.')[0]} as select * from '{data}/{t}'")
    df = queries.queries()[name](spark, data)
    cur = c.execute(oracle.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(x[0] for x in cur.description) == names
    at = [[x[0] for x in cur.description].index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect()), key=repr)
    assert got == want


def _plain(x):
    """Values as they compare: decimals and whole numbers as numbers, times without their zone, rounded floats."""
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime) else x


def test_flagship(spark, data):
    df = queries.link_frontier(spark, data)
    assert df.columns == ["id", "url", "unique_key", "crawl_depth", "src_id", "pos"]
    assert df.count() == df.select("id").distinct().count() > 0
