"""Stored records, texts from pages that could end a job, and folds over groups of any size."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from trawlnet.functions import charsets, robots, text
from trawlnet.operators import frontier, pacing, stats, stores

#: The members of the stored forms, in their order.
STATISTICS = (
    "requestsSucceeded requestsFailed requestsRetries requestsFailedPerMinute requestsSucceededPerMinute requestMinDurationMillis requestMaxDurationMillis "
    "requestTotalFailedDurationMillis requestTotalSucceededDurationMillis crawlerStartedAt crawlerFinishedAt statsPersistedAt crawlerRuntimeMillis crawlerLastStartTimestamp "
    "requestRetryHistogram statsId requestAvgFailedDurationMillis requestAvgSucceededDurationMillis requestTotalDurationMillis requestsTotal requestsWithStatusCode errors retryErrors"
).split()
SESSION = "id cookieJar proxyInfo userData fingerprint maxErrorScore errorScoreDecrement expiresAt createdAt usageCount maxUsageCount errorScore retired".split()


def test_statistics_record(spark):
    rows = [("ok", 0, 0, 200, None), ("failed", 7, 2, 503, "boom 1"), ("retry", None, 1, 503, "boom 2"), ("skipped", None, 0, None, None)]
    df = spark.createDataFrame(rows, "outcome string, duration_ms bigint, retry_count int, status int, error_message string")
    s = stats.crawl_statistics(df, F.lit(120_000)).join(stats.histograms(df)).withColumn("started_at", F.lit("2026-01-02 03:04:05.678").cast("timestamp"))
    record = stats.statistics_record(s)
    got = json.loads(record.first().record)
    assert list(got) == STATISTICS
    assert got["requestMinDurationMillis"] == 0 and got["requestAvgSucceededDurationMillis"] is None and got["requestAvgFailedDurationMillis"] == 7
    assert got["requestsSucceeded"] == 1 and got["requestTotalDurationMillis"] == 7 and got["requestRetryHistogram"] == [1, 0, 1]
    assert got["requestsWithStatusCode"] == {"503": 2} and got["errors"] == {"boom _": 1} and got["retryErrors"] == {"boom _": 1}
    assert got["crawlerStartedAt"] == "2026-01-02T03:04:05.678Z" and got["crawlerFinishedAt"] is None
    again = stats.restore_statistics(record).first()
    assert (again.requests_total, again.retry_histogram, again.errors, again.min_duration_ms) == (2, [1, 0, 1], {"boom _": 1}, 0)
    assert again.started_at == datetime(2026, 1, 2, 3, 4, 5, 678000)
    nothing = json.loads(stats.statistics_record(stats.crawl_statistics(df.limit(0))).first().record)
    assert nothing["requestMinDurationMillis"] is None
    for member in ("statsId", "requestsTotal", "requestRetryHistogram"):
        lacking = [(json.dumps({k: v for k, v in got.items() if k != member}),), (json.dumps(got | {member: None}),)]
        assert stats.restore_statistics(spark.createDataFrame(lacking, "record string")).count() == 0
    odd = json.dumps(got | {"errors": {"a": {"b": {"count": 1}}}, "requestsFailedPerMinute": None})
    assert stats.restore_statistics(spark.createDataFrame([(odd,)], "record string")).first().requests_failed == 1


def test_session_records(spark):
    outcomes = [("s", i, "bad" if i == 2 else "good") for i in range(4)] + [("gone", i, "bad") for i in range(4)]
    states = pacing.session_states(spark.createDataFrame(outcomes, "session_id string, seq int, outcome string"))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    records = pacing.sessions_record(states, at)
    (row,) = records.collect()
    got = json.loads(row.record)
    assert list(got) == SESSION
    assert got == {
        "id": "s", "cookieJar": {"cookies": []}, "proxyInfo": None, "userData": {}, "fingerprint": None, "maxErrorScore": 3.0, "errorScoreDecrement": 0.5, "expiresAt": "2026-01-01T00:50:00.000Z",
        "createdAt": "2026-01-01T00:00:00.000Z", "usageCount": 4, "maxUsageCount": 50, "errorScore": 0.5, "retired": False,
    }
    later = pacing.restore_sessions(records, at).first()
    assert (later.session_id, later.usage, later.score, later.usable, later.user_data) == ("s", 4, 0.5, True, "{}")
    assert pacing.restore_sessions(records, F.lit("2026-01-01 00:50:00").cast("timestamp")).first().usable is False
    few = spark.createDataFrame([('{"id":"x","createdAt":"2026-01-01T00:00:00Z","expiresAt":"2026-01-02T00:00:00Z"}',), ('{"id":"x"}',), ("no",)], "record string")
    assert [(r.max_usage, r.usable) for r in pacing.restore_sessions(few, at).collect()] == [(50, True)]


def test_export_is_pretty(spark, tmp_path):
    ds = spark.createDataFrame([(1, '{"a": 1.0, "b":[1,{"c":"é"}]}'), (2, "{}")], "seq bigint, item string")
    at = tmp_path / "new" / "folder"
    stores.export(ds, str(at / "x.json"))
    assert (at / "x.json").read_text() == '[\n  {\n    "a": 1,\n    "b": [\n      1,\n      {\n        "c": "é"\n      }\n    ]\n  },\n  {}\n]\n'
    stores.export(ds, str(at / "x.jsonl"))
    assert (at / "x.jsonl").read_text() == '{"a":1,"b":[1,{"c":"é"}]}\n{}\n'
    stores.export(ds.limit(0), str(at / "y.json"))
    assert (at / "y.json").read_text() == "[]\n"


def test_labels_that_are_no_charsets(spark):
    labels = "hex base64 zlib rot13 undefined idna punycode unicode_escape mbcs uu bz2 nothing".split()
    assert all(charsets.codec_of(x) is None for x in labels)
    assert [charsets.codec_of(x) for x in ("latin1", "Shift_JIS", "gb2312", "utf-16", "KOI8-U", "big5")] == ["cp1252", "cp932", "gb18030", "utf-16-le", "koi8-u", "big5"]
    df = spark.createDataFrame([(bytearray(b"caf\xe9"), x) for x in [*labels, "latin1"]], "body binary, label string")
    assert {r.t for r in df.select(charsets.decode_body("body", "label").alias("t")).collect()} == {"caf�", "café"}


@pytest.mark.parametrize(("value", "want"), [("9" * 22, None), (str(2**64 - 1), 2**63 - 1), ("9" * 5000, None), ("120", 120_000), ("0", None), ("Thu, 01 Jan 9999 00:00:30 GMT", 251619523230000 + 0)])
def test_retry_after_of_any_length(spark, value, want):
    now = int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    if value.startswith("Thu"):
        want = int(datetime(9999, 1, 1, 0, 0, 30, tzinfo=timezone.utc).timestamp() * 1000) - now
    assert text.retry_after_ms(value, now) == want
    df = spark.createDataFrame([(value, now)], "v string, now bigint")
    assert df.select(text.retry_after("v", "now").alias("x")).first().x == want


def test_paths_after_an_escape_are_whole(spark):
    tail = "x" * 150_000 + "/end"
    urls = spark.createDataFrame([(1, f"https://e.com/%c3{tail}"), (2, f"https://e.com/%c3{tail[:-1]}")], "id int, url string")
    files = spark.createDataFrame([("https://e.com", "User-agent: *\nDisallow: /*/end$")], "origin string, content string")
    assert {r.id: r.allowed for r in robots.robots_allowed(urls, files).select("id", "allowed").collect()} == {1: False, 2: True}


def test_store_writes_and_transactions(spark):
    ds = spark.createDataFrame([(1, '{"a":1}')], "seq bigint, item string")
    kv = spark.createDataFrame([("a", bytearray(b"1"), "text/plain", 4, False)], "key string, value binary, content_type string, seq bigint, deleted boolean")
    new = spark.createDataFrame([(2, "b", "zwei"), (1, "b", "two"), (3, "a", "é")], "pos int, key string, text string")
    after = stores.set_texts(kv, new)
    assert {r.key: r.text for r in stores.get_text(stores.current(after)).collect()} == {"a": "é", "b": "zwei"}
    assert [r.key for r in stores.current(stores.delete_keys(after, spark.createDataFrame([(1, "a"), (2, "none")], "pos int, key string"))).collect()] == ["b"]
    with pytest.raises(Exception, match="not a valid key"):
        stores.set_texts(kv, spark.createDataFrame([(1, "a/b", "x")], "pos int, key string, text string")).collect()
    t, done = stores.Transaction(ds, kv), []
    t.after_commit.append(lambda: done.append(1))
    t.set_values(spark.createDataFrame([(1, "c", bytearray(b"3"), "text/plain")], "pos int, key string, value binary, content_type string"))
    t.push_data(spark.createDataFrame([(1, '{"a":2}')], "pos int, item string"))
    assert {r.key for r in t.get_text().collect()} == {"a", "c"} and not done
    t.rollback()
    assert {r.key for r in t.get_text().collect()} == {"a"}
    t.after_commit.append(lambda: done.append(2))
    t.push_data(spark.createDataFrame([(1, '{"a":3}')], "pos int, item string"))
    dataset, records = t.commit()
    assert [r.item for r in dataset.orderBy("seq").collect()] == ['{"a":1}', '{"a":3}'] and records.count() == 1 and done == [2]
    catalog = spark.createDataFrame([("dataset", "d", 1, None, None), ("queue", "d", None, None, None)], "kind string, id string, item_count bigint, modified_at timestamp, accessed_at timestamp")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    got = {r.kind: r for r in stores.touched(catalog, "dataset", "d", at, True, item_count=F.lit(2)).collect()}
    assert got["dataset"].item_count == 2 and got["dataset"].modified_at and got["queue"].accessed_at is None
    assert [r.kind for r in stores.drop(catalog, "dataset", "d").collect()] == ["queue"]


def test_lookup(spark):
    q = spark.createDataFrame([("a", 1), ("b", 2)], "id string, order_no bigint")
    assert [r.id for r in frontier.lookup(q, spark.createDataFrame([("b",), ("b",), ("x",)], "id string")).collect()] == ["b"]


SIGNAL = "domain string, at_ms bigint, seq bigint, kind string, wait_ms bigint, interval_ms bigint"


def test_folds_of_many_frames_and_batches(spark, tmp_path):
    """Signals in falling order, a few a frame: the streams' folds are those of the batch."""
    from trawlnet.streaming import stateful

    rows = [(d, 1000 * i, i, "rate_limited" if i % 2 else "fetch", None, None) for d in ("d", "e") for i in range(9, 0, -1)]
    df = spark.createDataFrame(rows, SIGNAL)
    later = spark.createDataFrame([("d", 200_000, 20, "fetch", None, None), ("d", 201_000, 21, "rate_limited", None, None), ("f", 1, 1, "rate_limited", None, None)], SIGNAL)
    for n, part in enumerate((df, later)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at = str(tmp_path / "in")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        try:
            stateful.start(stateful.backoff_stream(spark.readStream.schema(SIGNAL).parquet(at)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
            stateful.backoff_batches(spark.readStream.schema(SIGNAL).parquet(at), str(tmp_path / "b"), str(tmp_path / "bcp")).awaitTermination(120)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = ["domain", "at_ms", "kind", "applied", "n", "until_ms", "next_fetch_ms"]
    want = sorted(map(tuple, pacing.backoff_states(df.unionByName(later)).select(columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == want
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "b" / "results")).select(columns).collect())) == want
    states = {r.domain: r.n for r in spark.read.parquet(str(tmp_path / "b" / "states" / "batch=1")).collect()}
    assert states == {"d": 1, "e": 3, "f": 1}


def test_session_stream_of_many_frames(spark, tmp_path):
    from trawlnet.streaming import stateful

    rows = [("s", i, "bad" if i < 4 else "good") for i in range(9, 0, -1)]
    df = spark.createDataFrame(rows, "session_id string, seq int, outcome string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        stream = stateful.session_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        stream.writeStream.outputMode("update").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in spark.table("sess").collect()] == [tuple(r) for r in pacing.session_states(df).collect()] == [("s", 9, 0.0, False, True)]
