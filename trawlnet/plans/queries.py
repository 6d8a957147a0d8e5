"""The registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.functions import robots as R
from trawlnet.functions.charsets import content_type, prescan
from trawlnet.functions.html import link_rows, page_links, page_title, select
from trawlnet.functions.keys import payload_hash, request_id
from trawlnet.functions.patterns import passes
from trawlnet.functions.sitemaps import change_frequency, lastmod_utc, sitemap_rows
from trawlnet.functions.suffixes import hostname, registrable_domains
from trawlnet.functions.text import pretty
from trawlnet.functions.urls import encode_uri_component, in_scope, normalized_url, url_parts
from trawlnet.operators import attempts as A
from trawlnet.operators import compaction, instants, load, pacing, skew, stats, stores
from trawlnet.operators import frontier as Q
from trawlnet.operators.enqueue import EnqueueOptions, skip_reasons, to_requests
from trawlnet.operators.requests import build_requests, from_wire, to_wire
from trawlnet.plans.crawl import CrawlOptions, crawl, decoded, links_of
from trawlnet.session import spread, table
from trawlnet.sources.fetchers import PagesFetcher

Query = Callable[[SparkSession, str], DataFrame]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages of HTML with their text."""
    x = table(spark, d, "responses").where("status = 200 and body is not null").where(F.col("mime").isin(*A.PAGE_TYPES))
    return spread(x.select(F.col("response_id"), F.col("request_id").alias("id"), "url", F.col("url").alias("loaded_url"), F.decode("body", "UTF-8").alias("text")))


def link_frontier(spark: SparkSession, d: str) -> DataFrame:
    """New requests of the captured pages: links, same hostname, keyed, the first of each id."""
    pages = _pages(spark, d).withColumn("id", F.col("response_id").cast("string")).withColumn("crawl_depth", F.lit(0))
    o = EnqueueOptions()
    fresh = to_requests(skip_reasons(links_of(pages, o, repeats=False), o), o).withColumn("at", F.struct(F.col("src_id").cast("bigint"), "pos"))
    first = fresh.groupBy("id").agg(F.min_by(F.struct("url", "unique_key", "crawl_depth", "src_id", "pos"), "at").alias("x"))
    return first.select("id", "x.*")


# --- URLs, keys, pages -------------------------------------------------------------------------------------------------


def normalized_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalize_url").select("case_id", normalized_url(F.col("input"), F.col("keep_fragment")).alias("normalized"))


def request_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requests").select("row_id", request_id(F.col("unique_key")).alias("request_id"), payload_hash(F.col("payload")).alias("payload_hash"))


def built_requests(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "requests").select("url", "method", "payload", "label", "user_data", "crawl_depth", "session_id", "max_retries", "headers", (F.upper("method") == "POST").alias("extended_key"))
    return build_requests(x).select("id", "url", "unique_key", "method", "error")


def request_wire(spark: SparkSession, d: str) -> DataFrame:
    """Requests written to their stored form and read again."""
    x = from_wire(to_wire(table(spark, d, "requests").withColumn("loaded_url", F.col("loaded_url"))))
    return x.select("id", "url", "unique_key", "method", "payload", "label", "crawl_depth", "max_retries", "session_id", "enqueue_strategy", "no_retry", "retry_count", "error_messages")


def host_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requests").select("row_id", hostname(F.col("url")).alias("host"))


def url_structs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requests").select("row_id", url_parts("url").alias("u")).select("row_id", "u.scheme", "u.host", "u.port")


def domain_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "registrable_domain").select("case_id", registrable_domains("hostname").alias("domain"))


def scope_decisions(spark: SparkSession, d: str) -> DataFrame:
    """For each request with a final URL: whether that's in the scope of the request, by strategy."""
    x = table(spark, d, "requests").where("loaded_url is not null").select("row_id", url_parts("url").alias("o"), url_parts("loaded_url").alias("t"))
    x = x.withColumn("od", registrable_domains(F.col("o.host"))).withColumn("td", registrable_domains(F.col("t.host")))
    return x.select("row_id", *[in_scope(F.lit(s), F.col("t"), F.col("o"), F.col("td"), F.col("od")).alias(s.replace("-", "_")) for s in ("all", "same-hostname", "same-domain", "same-origin")])


def pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    keep = passes(F.col("url"), include=["http{s,}://**/catalog/**", "http{s,}://**/shop/**"], exclude=["**utm_*"])
    return table(spark, d, "requests").where(keep).select("row_id", "url")


def encoded_components(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalize_url").select("case_id", encode_uri_component(F.col("input")).alias("encoded"))


def links_per_page(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("response_id", F.size(page_links(F.col("text"), F.col("url"))).cast("bigint").alias("n_links"))


def top_linked(spark: SparkSession, d: str) -> DataFrame:
    """The hundred URLs most pages link to: a top-k."""
    x = link_rows(_pages(spark, d), []).select(F.col("_u.href").alias("url"))
    return x.groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(100)


def link_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).withColumn("id", F.col("response_id").cast("string")).withColumn("crawl_depth", F.lit(1))
    o = EnqueueOptions(exclude=["**/page1*"], max_depth=2)
    return skip_reasons(links_of(pages, o), o).groupBy(F.coalesce("skip_reason", F.lit("enqueued")).alias("reason")).agg(F.count("*").alias("n"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("response_id", page_title(F.col("text")).alias("title"))


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    x = _pages(spark, d).select("response_id", select(F.col("text"), "article > h2").alias("e"))
    return x.select("response_id", F.size("e").cast("bigint").alias("n"), F.try_element_at(F.transform("e", lambda e: e.text), F.lit(1)).alias("first_heading"))


def declared_charsets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "charset_prescan").select("case_id", prescan(F.col("html")).alias("charset"))


def decoded_lengths(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "responses").where("body is not null").withColumn("charset", F.lit("utf-8"))
    return decoded(x).select("response_id", F.length("text").cast("bigint").alias("n_chars"))


def content_types(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "responses")
    header = F.filter("headers", lambda h: F.lower(h["name"]) == "content-type")
    return x.select("response_id", content_type(F.when(F.size(header) > 0, header[0]["value"])).alias("c")).select("response_id", "c.mime", "c.charset")


# --- robots and sitemaps -----------------------------------------------------------------------------------------------

_ROBOTS = "User-agent: *\nDisallow: /archive\nAllow: /archive/ribbon\nDisallow: /*?*page=\nCrawl-delay: 2\n"


def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Requests against one robots.txt at each of their origins."""
    urls = table(spark, d, "requests").select("row_id", "url")
    origins = urls.select(url_parts("url")["origin"].alias("origin")).where("origin is not null").distinct()
    return R.robots_allowed(urls, origins.withColumn("content", F.lit(_ROBOTS))).select("row_id", "allowed", "crawl_delay")


def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    return sitemap_rows(table(spark, d, "sitemap_xml")).select("sitemap_id", "pos", "kind", "loc", "priority")


def change_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sitemap_urls").groupBy(change_frequency(F.col("changefreq")).alias("changefreq")).agg(F.count("*").alias("n"))


def protocol_lastmods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sitemap_urls").select("row_id", lastmod_utc(F.col("lastmod")).alias("lastmod_utc"))


# --- the frontier ------------------------------------------------------------------------------------------------------


def frontier_first(spark: SparkSession, d: str) -> DataFrame:
    """Of each request of a queue the first delivery."""
    x = table(spark, d, "requests").withColumn("_key", F.concat_ws("\u0001", "queue_id", "id"))
    return Q.first_of_each(x, "_key", "row_id").select("queue_id", "id", "row_id")


def frontier_add(spark: SparkSession, d: str) -> DataFrame:
    """The report of adding the pending requests to a queue of the handled ones."""
    x = table(spark, d, "requests")
    queue = Q.first_of_each(x.where("order_no is null"), "id", "row_id").select("id", "url", "unique_key", "handled_at", "order_no").withColumn("in_progress", F.lit(False))
    new = x.where("order_no is not null").select("id", "url", "unique_key", F.lit(None).cast("timestamp").alias("handled_at"), F.col("row_id").alias("pos"))
    return Q.add_batch(queue, new)[1]


def frontier_next(spark: SparkSession, d: str) -> DataFrame:
    """The hundred requests fetched next: a top-k."""
    x = table(spark, d, "requests").withColumn("in_progress", F.lit(False))
    return Q.fetch_next(x, 100, "row_id").select("row_id", "id")


def frontier_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "requests").groupBy("queue_id")
    return x.agg(F.count("*").alias("total"), F.count_if(F.col("order_no").isNull()).alias("handled"), F.count_if(F.col("order_no").isNotNull()).alias("pending"))


def frontier_orders(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the order of adding, without a task that sorts all."""
    return Q.with_row_numbers(table(spark, d, "requests").select("row_id"), "row_id", "n").select("row_id", F.col("n").cast("bigint").alias("n"))


def crawl_pages(spark: SparkSession, d: str, batch: int = 1_000_000) -> DataFrame:
    """A crawl of captured pages from all of them as seeds, to its end: how the attempts ended, by depth. `batch` is the
    size of a step only. A captured 429 stays one, so it's retried as a blocked page, not as often as it comes."""
    responses = table(spark, d, "responses").where("response_id is not null")
    seeds = responses.groupBy("url").agg(F.min("response_id").alias("pos")).withColumn("crawl_depth", F.lit(0))
    out = crawl(spark, seeds, PagesFetcher(responses), CrawlOptions(batch=batch, max_steps=None, ignore_statuses=(429,)))
    return out.attempts.groupBy("crawl_depth", "outcome", "error_kind").agg(F.count("*").alias("n"))


# --- attempts, statistics, load ----------------------------------------------------------------------------------------


def response_classes(spark: SparkSession, d: str) -> DataFrame:
    c = A.classify_response(F.col("status"), F.col("mime"))
    return table(spark, d, "responses").select("response_id", c.alias("c")).select("response_id", "c.error_kind", "c.error_message")


def retry_states(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each fetched request."""
    c = A.classify_response(F.col("status"), F.col("mime"))
    r = table(spark, d, "responses").select("response_id", "request_id", c.alias("c"))
    q = table(spark, d, "requests")
    q = Q.first_of_each(q, "id", "row_id").select("id", "no_retry", "retry_count", "max_retries", "error_messages")
    x = r.join(q, r["request_id"] == q["id"]).select("response_id", "no_retry", "retry_count", "max_retries", "error_messages", "c.error_kind", "c.error_message")
    return A.next_state(x).select("response_id", "outcome", "next", "retry_count", F.size("error_messages").alias("n_errors"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """The event table read as attempts."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "click", "retry").otherwise("ok")
    return table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("started_at"), kind.alias("outcome"), F.floor("value").cast("bigint").alias("duration_ms"), (F.col("event_id") % 5).cast("int").alias("retry_count"))


def statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.crawl_statistics(_attempts(spark, d), F.lit(3_600_000))


def statistics_by_user(spark: SparkSession, d: str) -> DataFrame:
    x = stats.crawl_statistics(_attempts(spark, d), by=["user_id"])
    return x.select("user_id", "requests_finished", "requests_failed", "requests_total", "min_duration_ms", "max_duration_ms", "avg_succeeded_ms")


def retry_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "requests").withColumn("outcome", F.lit("ok"))
    return stats.retry_histogram(x)


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.status_histogram(table(spark, d, "responses"))


def error_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "requests").select(F.explode("error_messages").alias("error_message")).withColumn("outcome", F.lit("failed"))
    return stats.error_histogram(x)


def minute_loads(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stats.tasks_per_minute(x, by=["event_type"])


def overload_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select(F.col("user_id").alias("signal"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type") == "error").alias("is_overloaded"))
    return load.overload(x).select("signal", F.round("ratio", 6).alias("ratio"), "is_overloaded")


def backoffs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "rate_limited").otherwise("fetch")
    x = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("domain"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.lit(None).cast("bigint").alias("wait_ms"), F.lit(None).cast("bigint").alias("interval_ms"),
    )
    return pacing.backoff_states(x)


def session_health(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "bad").otherwise("good")
    return pacing.session_states(table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("outcome")))


# --- storages ----------------------------------------------------------------------------------------------------------


def dataset_page(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "dataset_items").select(F.col("row_id").alias("seq"), "item")
    return stores.get_data(x, offset=100, limit=50, desc=True)


def dataset_columns(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "dataset_items").select(F.col("row_id").alias("seq"), "item")
    return stores.typed(x, "url string, title string, price double")


def _records(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", "dataset_id", F.col("seq").cast("string"))
    return table(spark, d, "dataset_items").select(key.alias("key"), F.encode("item", "UTF-8").alias("value"), F.lit("application/json").alias("content_type"), F.col("row_id").alias("seq"), F.lit(False).alias("deleted"))


def store_current(spark: SparkSession, d: str) -> DataFrame:
    x = stores.current(_records(spark, d))
    return x.join(stores.get_text(x), "key").where(stores.valid_key(F.col("key"))).select("key", "seq", "text")


def store_writes(spark: SparkSession, d: str) -> DataFrame:
    """The store after each item's title was written under its dataset's name and the keys that end with 0 or 7 were deleted."""
    x = table(spark, d, "dataset_items").where("dataset_id is not null")
    texts = x.select(F.col("row_id").alias("pos"), F.col("dataset_id").alias("key"), F.coalesce(F.get_json_object("item", "$.title"), F.lit("")).alias("text"))
    records = stores.set_texts(_records(spark, d).limit(0), texts)
    gone = x.select("dataset_id").distinct().where("right(dataset_id, 1) in ('0', '7')").select(F.col("dataset_id").alias("key"), F.col("dataset_id").alias("pos"))
    return stores.get_text(stores.current(stores.delete_keys(records, gone)))


def queue_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The stored requests that responses belong to."""
    return Q.lookup(table(spark, d, "requests"), table(spark, d, "responses").select(F.col("request_id").alias("id"))).select("row_id", "id")


def sitemap_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap entries by whether they lie on their sitemap's own host, by strategy."""
    x = table(spark, d, "sitemap_urls").select("row_id", url_parts("sitemap_url").alias("o"), url_parts("loc").alias("t"))
    none = F.lit(None).cast("string")
    return x.select("row_id", *[in_scope(F.lit(s), F.col("t"), F.col("o"), none, none).alias(s.replace("-", "_")) for s in ("all", "same-hostname", "same-origin")])


def store_keys(spark: SparkSession, d: str) -> DataFrame:
    """A page of keys: as many as a listing gives."""
    return stores.list_keys(stores.current(_records(spark, d)), "d0000", after="d000001", limit=1000)


def pretty_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_items").select("row_id", pretty("item").alias("text"))


# --- problems 3, 5 and 6 -----------------------------------------------------------------------------------------------


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return compaction.storage_counts(spark, f"{d}/requests.parquet", f"{d}/dataset_items.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.miscounted(table(spark, d, "storages"), p3_counts(spark, d))


def _domain_rows(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "requests").select(
        hostname(F.col("url")).alias("host"), "unique_key", F.lit(0).alias("is_host"), F.col("order_no").isNull().cast("int").alias("handled"),
        "retry_count", "crawl_depth", "written_at",
    )
    hosts = table(spark, d, "registrable_domain").select(
        F.regexp_replace(F.lower("hostname"), r"\.+$", "").alias("host"), F.lit(None).cast("string").alias("unique_key"), F.lit(1).alias("is_host"),
        F.lit(0).alias("handled"), F.lit(0).alias("retry_count"), F.lit(None).cast("int").alias("crawl_depth"), F.lit(None).cast("timestamp").alias("written_at"),
    )
    return requests.unionByName(hosts).select(registrable_domains("host").alias("domain"), "*").drop("host")


def _domain_profile(rows: DataFrame, keys: str | list[str]) -> DataFrame:
    partials = {
        "n_requests": F.sum(1 - F.col("is_host")),
        "n_hostnames": F.sum("is_host"),
        "n_handled": F.sum("handled"),
        "n_retries": F.sum("retry_count"),
        "max_depth": F.max("crawl_depth"),
        "first_written": F.min("written_at"),
        "last_written": F.max("written_at"),
    }
    merges = {n: (F.min if n == "first_written" else F.max if n in ("max_depth", "last_written") else F.sum)(n) for n in partials}
    return skew.salted_aggregate(rows, keys, partials, merges, distinct="unique_key").withColumnRenamed("n_distinct", "n_unique_keys")


def p5_domains(spark: SparkSession, d: str) -> DataFrame:
    """Per registrable domain: its requests, their different keys, how they went, and its test hostnames."""
    return _domain_profile(_domain_rows(spark, d), "domain")


def p5_domain_days(spark: SparkSession, d: str) -> DataFrame:
    """The same per registrable domain and day of writing: how a domain's share of the frontier came to be."""
    return _domain_profile(_domain_rows(spark, d).withColumn("day", F.to_date("written_at")), ["domain", "day"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.lastmod_instants(spark, table(spark, d, "sitemap_urls"), table(spark, d, "sitemap_xml"), table(spark, d, "sites"))


_ALL = [
    link_frontier, normalized_urls, request_ids, built_requests, request_wire, host_names, url_structs, domain_names, scope_decisions, pattern_filter,
    encoded_components, links_per_page, top_linked, link_skip_reasons, page_titles, page_headings, declared_charsets, decoded_lengths, content_types,
    robots_decisions, sitemap_entries, change_frequencies, protocol_lastmods, frontier_first, frontier_add, frontier_next, frontier_counts, frontier_orders,
    crawl_pages, response_classes, retry_states, statistics, statistics_by_user, retry_counts, status_counts, error_counts, minute_loads, overload_ratios,
    backoffs, session_health, dataset_page, dataset_columns, store_current, store_writes, queue_lookup, sitemap_scopes, store_keys, pretty_items, p3_counts, p3_found, p5_domain_days, p5_domains, p6_found,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}
