import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trawlnet import schemas
from trawlnet.operators import attempts as A
from trawlnet.operators import compaction, instants, load, pacing, skew, stats, stores
from trawlnet.operators import frontier as Q
from trawlnet.operators.enqueue import EnqueueOptions, add_requests, skip_reasons, to_requests
from trawlnet.operators.requests import build_requests, from_wire, to_wire


def _queue(spark, rows=()):
    return spark.createDataFrame([(i, f"https://e.com/{i}", f"https://e.com/{i}", o, b, None) for i, o, b in rows], "id string, url string, unique_key string, order_no bigint, in_progress boolean, handled_at timestamp")


def test_frontier(spark):
    q = _queue(spark, [("a", 1, False), ("b", None, False), ("c", 2, True)])
    new = spark.createDataFrame([("d", 1), ("a", 2), ("d", 3), ("b", 4), ("e", 5)], "id string, pos bigint").withColumn("url", F.col("id")).withColumn("unique_key", F.col("id"))
    after, report = Q.add_batch(q, new)
    assert sorted((r.id, r.order_no) for r in after.collect() if r.id in "de") == [("d", 3), ("e", 4)]
    assert sorted((r.request_id, r.was_already_present, r.was_already_handled) for r in report.collect()) == [("a", True, False), ("b", True, True), ("d", False, False), ("d", True, False), ("e", False, False)]
    front, _ = Q.add_batch(q, new, forefront=True)
    assert [r.id for r in Q.fetch_next(front, 2).collect()] == ["e", "d"]
    assert Q.counts(q).first().asDict() == {"total": 3, "handled": 1, "pending": 2}
    busy = Q.mark_in_progress(q, Q.fetch_next(q, 5))
    assert Q.is_empty(busy) and not Q.is_finished(busy) and not Q.is_empty(Q.restart(busy))
    done = Q.mark_handled(busy, spark.createDataFrame([("a",), ("b",), ("zz",)], "id string"))
    assert {r.id for r in done.where("order_no is null").collect()} == {"a", "b"}
    back = Q.reclaim(busy, spark.createDataFrame([("a", True, 1), ("b", False, 2), ("c", False, 3)], "id string, forefront boolean, pos bigint"))
    assert {r.id: r.order_no for r in back.collect()} == {"a": -3, "b": None, "c": 5}
    empty, rep = Q.add_batch(_queue(spark), new.limit(0))
    assert empty.count() == 0 and rep.count() == 0


def test_build_and_wire(spark):
    rows = spark.createDataFrame([("https://e.com/d", "post", "q=1", 3, "L", '{"page": 2}'), ("", "GET", None, None, None, None), ("https://e.com/x", "GET", "b", None, None, None)], "url string, method string, payload string, crawl_depth int, label string, user_data string")
    made = build_requests(rows)
    assert [r.error for r in made.collect()] == [None, "the URL is empty", "GET can't have a body"]
    wire = to_wire(made.where("error is null")).first().json
    parsed = json.loads(wire)
    assert parsed["userData"] == {"page": 2, "label": "L", "__engine": {"crawlDepth": 3}} and parsed["method"] == "POST" and "handledAt" not in parsed
    again = from_wire(to_wire(made.where("error is null"))).first()
    assert (again.crawl_depth, again.label, again.payload, again.retry_count) == (3, "L", "q=1", 0)
    assert from_wire(spark.createDataFrame([('{"url": "https://e.com/y", "method": "put", "headers": null}',)], "json string")).first().method == "PUT"


def test_enqueue(spark):
    links = [(1, "https://e.com/a"), (2, "https://e.com/a"), (3, "https://o.com/"), (4, "mailto:x@y.z"), (5, "https://e.com/private"), (6, "https://e.com/b"), (7, "https://e.com/a#x"), (8, "https://e.com/skip")]
    df = spark.createDataFrame([("p", i, u, "https://e.com/", 0) for i, u in links], "src_id string, pos int, url string, base_url string, depth int")
    robots = spark.createDataFrame([("https://e.com", "User-agent: *\nDisallow: /private")], "origin string, content string")
    o = EnqueueOptions(exclude=["**/skip"], limit=2, label="L")
    got = skip_reasons(df, o, robots)
    assert {r.pos: r.skip_reason for r in got.collect()} == {1: None, 2: "duplicate", 3: "strategy", 4: "scheme", 5: "robots", 6: None, 7: None, 8: "pattern"}
    made = to_requests(got, o).collect()
    assert [(r.pos, r.crawl_depth, r.label) for r in sorted(made, key=lambda r: r.pos)] == [(1, 1, "L"), (6, 1, "L")]
    assert {r.skip_reason for r in skip_reasons(df, EnqueueOptions(max_depth=0)).where("pos in (1, 6)").collect()} == {"depth"}
    assert [r.crawl_depth for r in add_requests(spark.createDataFrame([(None,), (7,)], "crawl_depth int"), 2).collect()] == [3, 7]


def test_attempts(spark):
    rows = [(200, "text/html"), (404, "text/html"), (403, "image/png"), (500, "x/y"), (429, "text/html"), (200, "image/png"), (None, None)]
    df = spark.createDataFrame(rows, "status int, mime string").select(A.classify_response(F.col("status"), F.col("mime")).alias("c"))
    assert [r.c.error_kind for r in df.collect()] == [None, None, "session", "other", "throttled", "non_retryable", "other"]
    state = spark.createDataFrame([(k, 0, 1, n) for k, n in (("other", False), ("other", True), ("retry_request", False), ("session", False), ("throttled", False), ("critical", False), (None, False))], "error_kind string, retry_count int, max_retries int, no_retry boolean")
    got = A.next_state(state.withColumn("error_message", F.lit("m")).withColumn("error_messages", F.array().cast("array<string>"))).collect()
    assert [(r.outcome, r.next, r.retry_count, r.retire_session) for r in got] == [
        ("retry", "end", 1, False), ("failed", "handled", 0, False), ("retry", "end", 1, False), ("retry", "end", 1, True), ("throttled", "front", 0, False), ("critical", "stop", 0, False), ("ok", "handled", 0, False),
    ]
    routed = A.route(spark.createDataFrame([("A",), ("B",), (None,)], "label string"), ["A"]).collect()
    assert [r.route for r in routed] == ["A", "default", "default"]


def test_statistics(spark):
    rows = [("ok", 10, 0, 200), ("ok", 15, 2, 200), ("failed", 7, 2, 503), ("retry", None, 1, 503), ("skipped", None, 0, None)]
    df = spark.createDataFrame(rows, "outcome string, duration_ms bigint, retry_count int, status int").withColumn("error_message", F.lit("boom 12\nx"))
    s = stats.crawl_statistics(df, F.lit(120_000)).first()
    assert (s.requests_total, s.requests_finished, s.avg_succeeded_ms, s.min_duration_ms, s.max_duration_ms, s.succeeded_per_minute, s.failed_per_minute) == (3, 4, 13, 7, 15, 1, 0)
    assert [(r.retries, r.n) for r in stats.retry_histogram(df).orderBy("retries").collect()] == [(0, 1), (1, 0), (2, 2)]
    assert [(r.status, r.n) for r in stats.status_histogram(df).collect()] == [(503, 2)]
    assert [(r.error_group, r.n) for r in stats.error_histogram(df).collect()] == [("boom _", 1)]
    assert stats.crawl_statistics(df.limit(0)).first().avg_succeeded_ms == 0
    record = stats.statistics_record(stats.crawl_statistics(df))
    assert json.loads(record.first().record)["requestsTotal"] == 3
    assert stats.restore_statistics(record).first().requests_failed == 1
    assert stats.restore_statistics(spark.createDataFrame([("{}",)], "record string")).count() == 0


def test_load(spark):
    t = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 3, 3, 10)]
    df = spark.createDataFrame([("cpu", x, o) for x, o in zip(t, (True, True, False, True, False))] + [("one", t[0], True)], "signal string, created_at timestamp, is_overloaded boolean")
    r = {x.signal: x.ratio for x in load.overload(df).collect()}
    assert r["one"] == 1.0 and r["cpu"] == pytest.approx((1000 + 0 + 1) / (1000 + 2000 + 1 + 7000))
    assert {x.signal: x.ratio for x in load.overload(df, 7000).collect()}["cpu"] == pytest.approx(1 / 7001)
    assert load.system_status(df).first().is_idle_now is False
    assert [load.autoscale_step(c, d, 1, 200, i) for c, d, i in ((9, 10, True), (8, 10, True), (10, 10, False), (1, 1, False))] == [11, 10, 9, 1]
    assert load.autoscale_step(10, 10, 1, 200, True, minute_full=True) == 10
    assert load.may_start(0, 5, 1, False) and not load.may_start(2, 5, 1, False)


def test_pacing(spark):
    b = pacing.Backoff()
    assert b.rate_limited(0) and b.until == 2000 and not b.rate_limited(1000)
    assert b.rate_limited(2000) and b.until == 6000 and b.rate_limited(6500, 90_000) and b.until == 66_500
    assert b.rate_limited(126_500) and b.n == 1
    rows = [("d", 0, 1, "rate_limited", None, None), ("d", 1000, 2, "fetch", None, None), ("d", 2000, 3, "min_interval", None, 500), ("d", 2000, 4, "fetch", None, None), ("d", 2100, 5, "fetch", None, None), ("e", 5, 6, "fetch", None, None)]
    df = spark.createDataFrame(rows, "domain string, at_ms bigint, seq bigint, kind string, wait_ms bigint, interval_ms bigint")
    assert [r.applied for r in pacing.backoff_states(df).orderBy("domain", "at_ms", "next_fetch_ms").collect()] == [True, False, True, True, False, True]
    s = spark.createDataFrame([("s", 1, "bad"), ("s", 2, "bad"), ("s", 3, "good"), ("s", 4, "bad"), ("s", 5, "bad"), ("r", 1, "retire")], "session_id string, seq int, outcome string")
    got = {r.session_id: (r.usage, r.score, r.usable) for r in pacing.session_states(s).collect()}
    assert got == {"s": (5, 3.5, False), "r": (1, 0.0, False)}
    assert pacing.throttled_alias("é.test") == "throttled-%C3%A9.test"


def test_stores(spark, tmp_path):
    ds = spark.createDataFrame([(1, '{"a":1}')], "seq bigint, item string")
    more = stores.push_data(ds, spark.createDataFrame([(1, '[{"a":2},{"a":3}]'), (2, ' {"a":4}')], "pos int, item string"))
    assert [(r.seq, json.loads(r.item)["a"]) for r in more.orderBy("seq").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    with pytest.raises(Exception, match="only objects"):
        stores.push_data(ds, spark.createDataFrame([(1, '"x"')], "pos int, item string")).collect()
    assert [r.seq for r in stores.get_data(more, 1, 2, desc=True).collect()] == [3, 2]
    assert [r.a for r in stores.typed(more, "a int").orderBy("seq").collect()] == [1, 2, 3, 4]
    assert stores.export(more, str(tmp_path / "x.jsonl")) == 4
    assert len(json.loads((tmp_path / "y.json").read_text() if stores.export(more, str(tmp_path / "y.json")) else "")) == 4
    with pytest.raises(ValueError):
        stores.export(more, "x.csv")
    kv = spark.createDataFrame([("b", bytearray(b"1"), "text/plain", 1, False), ("b", bytearray(b"2"), "text/plain", 2, None), ("a", bytearray(b"x"), "image/png", 3, False), ("c", bytearray(b"x"), "image/png", 4, False), ("c", None, None, 5, True)], schemas.KEY_VALUE)
    now = stores.current(kv)
    assert sorted((r.key, r.text) for r in stores.get_text(now).collect()) == [("a", None), ("b", "2")]
    page = stores.list_keys(now, limit=1).collect()
    assert [(r.key, r.is_truncated) for r in page] == [("a", True)]
    assert [r.key for r in stores.list_keys(now, after="a").collect()] == ["b"]
    (tmp_path / "kv").mkdir()
    (tmp_path / "kv" / "INPUT.json").write_text("{}")
    (tmp_path / "kv" / "pic").write_text("x")
    assert sorted((r.key, r.content_type) for r in stores.adopt_files(spark, str(tmp_path / "kv")).collect()) == [("INPUT", "application/json"), ("pic", "application/octet-stream")]
    cat = spark.createDataFrame([("queue", "q1", "Main", False), ("queue", "q2", "default", True)], "kind string, id string, name string, run_scoped boolean")
    assert stores.find_storage(cat, "queue", name="mAIN").first().id == "q1" and stores.find_storage(cat, "queue").first().id == "q2" and stores.purge(cat).count() == 1


def test_compaction(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"q{i % 2}", f"r{i % 50}" if i % 3 else "hot", "x") for i in range(300)] + [(900, None, "n", "x"), (901, "q0", None, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, queue_id string, id string, kept string")
    df.repartition(12).write.parquet(src)
    compaction.compact(spark, src, ["queue_id", "id"], "row_id", dst, files_per_batch=5)
    got = spark.read.parquet(dst)
    want = {(q, i) for _, q, i, _ in rows if q and i}
    assert {(r.queue_id, r.id) for r in got.collect()} == want and got.count() == len(want)
    df.limit(0).unionByName(spark.createDataFrame([(1000, "q0", "new", "x"), (1001, "q0", "hot", "x")], df.schema)).coalesce(1).write.mode("append").parquet(src)
    compaction.compact(spark, src, ["queue_id", "id"], "row_id", dst)
    assert spark.read.parquet(dst).count() == len(want) + 1
    assert len(list((tmp_path / "out").glob("batch=*"))) == 4
    # A batch that runs again (its commit was lost with the driver) replaces its files.
    files = sorted(p.name for p in (tmp_path / "out" / "batch=3").glob("*.parquet"))
    for p in (tmp_path / "out-checkpoint" / "commits").glob("*3*"):
        p.unlink()
    compaction.compact(spark, src, ["queue_id", "id"], "row_id", dst)
    assert spark.read.parquet(dst).count() == len(want) + 1 and sorted(p.name for p in (tmp_path / "out" / "batch=3").glob("*.parquet")) != files
    # Nothing new: nothing changes.
    before = sorted(map(str, spark.read.parquet(dst).select("row_id").collect()))
    compaction.compact(spark, src, ["queue_id", "id"], "row_id", dst)
    assert sorted(map(str, spark.read.parquet(dst).select("row_id").collect())) == before


def test_miscounted(spark):
    storages = spark.createDataFrame([("queue", "a", None, 2), ("queue", "b", None, 0), ("dataset", "d", 5, None), ("dataset", "n", None, None)], "kind string, id string, item_count bigint, total_request_count bigint")
    counts = spark.createDataFrame([("queue", "a", 2), ("dataset", "d", 4)], "kind string, id string, n_records bigint")
    assert sorted(tuple(r) for r in compaction.miscounted(storages, counts).collect()) == [("dataset", "d"), ("dataset", "n")]


def test_salted(spark):
    rows = [("hot", i % 90, i) for i in range(3000)] + [(f"k{i % 7}", i % 5, i) for i in range(100)] + [(None, 1, 1)] * 3
    df = spark.createDataFrame(rows, "k string, v int, n int")
    partials, merges = {"rows": F.count("*"), "top": F.max("n")}, {"rows": F.sum("rows"), "top": F.max("top")}
    got = {r.k: (r.rows, r.top, r.n_distinct) for r in skew.salted_aggregate(df, "k", partials, merges, "v").collect()}
    want = {r.k: (r.rows, r.top, r.d) for r in df.groupBy("k").agg(F.count("*").alias("rows"), F.max("n").alias("top"), F.countDistinct("v").alias("d")).collect()}
    assert got == want and skew.heavy_keys(df, "k", 0.5) == ["hot"]
    plain = {r.k: r.rows for r in skew.salted_aggregate(df, "k", partials, merges).collect()}
    assert plain == {k: v[0] for k, v in want.items()}
    assert skew.salted_aggregate(df.limit(0), "k", partials, merges, "v").count() == 0


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2024-03-10T01:30:00-08:00", None, "2024-03-10 09:30:00"), ("2024-07-01 12:00", "Europe/Berlin", "2024-07-01 10:00:00"), ("1 September 2024 20:57:19 (CEST)", "Europe/Prague", "2024-09-01 18:57:19"),
        ("2024-03-31 02:30", "Europe/Berlin", None), ("2024-10-27 02:30", "Europe/Berlin", None), ("Oct 27, 2024 2:30:00 AM CET", "Europe/Berlin", "2024-10-27 01:30:00"), ("Oct 27, 2024 2:30:00 AM CEST", "Europe/Berlin", "2024-10-27 00:30:00"),
        ("01/12/2023 07:05", None, None), ("31/12/2023", None, "2023-12-31 00:00:00"), ("11/11/2023", None, "2023-11-11 00:00:00"), ("2024", "Asia/Kathmandu", "2023-12-31 18:15:00"), ("20240305", None, "2024-03-05 00:00:00"),
        ("1743745322", "Asia/Tokyo", "2025-04-04 05:42:02"), ("1743745322123", None, "2025-04-04 05:42:02.123"), ("1743745322123456", None, "2025-04-04 05:42:02.123456"), ("27 septembre 2024 à 22h36", None, "2024-09-27 22:36:00"),
        ("26. April 2023, 20:25 Uhr", None, "2023-04-26 20:25:00"), ("19 de octubre de 2025 18:23", None, "2025-10-19 18:23:00"), ("June 17, 2025 10:25 a.m.", None, "2025-06-17 10:25:00"), ("2023-02-29", None, None), ("2024-05-01T25:61:00Z", None, None),
        ("unknown", None, None), ("", None, None), (None, None, None), ("2024-12-12T06:47:25+01:00[Europe/Prague]", None, "2024-12-12 05:47:25"), ("2024-05-01 10:00", "No/Where", None), ("20250613T201220−04", None, "2025-06-14 00:12:20"),
    ],
)
def test_instants(spark, text, zone, want):
    sites = spark.createDataFrame([("d", zone)], "domain string, time_zone string")
    got = instants.to_utc(spark.createDataFrame([(text, "d", 1)], "lastmod string, domain string, year int"), sites).select(F.timestamp_micros("utc_us").cast("string"), "year").first()
    assert (got[0], got[1]) == (want, 1)


def test_zone_intervals():
    rows = instants.zone_intervals("Europe/Berlin", 2023, 2025)
    assert [r[2] for r in rows] == [3600, 7200, 3600, 7200, 3600, 7200, 3600]
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
