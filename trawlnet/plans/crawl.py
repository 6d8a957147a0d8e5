"""A crawl as supersteps over DataFrames: fetch a batch of the queue, classify, handle, enqueue, commit.

Each step writes its tables to the shared folder, so the lineage stays short and a lost executor costs one step at most.
The queue is never rewritten: a step appends what it adds, what it puts back and what it has handled (see Ledger).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet import schemas
from trawlnet.functions.charsets import decode_body, prescan, resolved_charset
from trawlnet.functions.html import link_rows
from trawlnet.functions.robots import robots_allowed
from trawlnet.functions.suffixes import registrable_domains
from trawlnet.functions.urls import filter_base, rejection, url_parts
from trawlnet.operators import attempts as A
from trawlnet.operators import frontier as Q
from trawlnet.operators.enqueue import EnqueueOptions, skip_reasons, to_requests
from trawlnet.operators.requests import build_requests
from trawlnet.session import written
from trawlnet.sources.fetchers import Fetcher


@dataclass
class CrawlOptions:
    enqueue: EnqueueOptions = field(default_factory=EnqueueOptions)
    selector: str = "a"
    batch: int = 10_000
    max_requests: int | None = None
    #: None: no limit, until the queue is empty.
    max_steps: int | None = None
    default_retries: int = A.MAX_RETRIES
    page_types: tuple[str, ...] = A.PAGE_TYPES
    ignore_statuses: tuple[int, ...] = ()
    error_statuses: tuple[int, ...] = ()
    #: From the step's fetched pages (id, url, text, label, ...) the rows (id, item) to store.
    extract: Callable[[DataFrame], DataFrame] | None = None
    #: As `extract`, by the request's label; others go to `extract`. Without that they're a critical error, which stops the crawl.
    routes: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    #: Changes the requests of a step before they're fetched, and the responses before they're classified.
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None
    #: Of attempts that will be tried again, with their errors, the requests as they go back (no_retry, user_data, headers, ...).
    on_error: Callable[[DataFrame], DataFrame] | None = None
    #: Of requests that failed for good the rows (id, item) to store.
    on_failed: Callable[[DataFrame], DataFrame] | None = None
    #: Whose rules of robots.txt hold.
    agent: str = "*"


@dataclass
class CrawlResult:
    queue: DataFrame
    attempts: DataFrame
    items: DataFrame | None
    steps: int
    stopped: str


def decoded(pages: DataFrame, mime: str = "mime", charset: str = "charset") -> DataFrame:
    """`pages` with `text`, decoded by header, declared or default charset."""
    label = resolved_charset(F.lit(None).cast("string"), F.col(charset), prescan(F.col("body")), F.col(mime), F.lit(None).cast("string"))
    return pages.withColumn("text", decode_body("body", label))


def links_of(pages: DataFrame, options: EnqueueOptions, selector: str = "a", repeats: bool = True) -> DataFrame:
    """(src_id, pos, url, base_url, depth, is_first, and parsed _u, _b, _bd) of the links of fetched pages (id, url, loaded_url,
    text, crawl_depth). URLs and domains of bases are parsed once a page."""
    o = options.strategy
    x = pages.withColumn("loaded_url", F.coalesce("loaded_url", "url")).withColumn("_b", url_parts("url"))
    none = F.lit(None).cast("string")
    x = x.withColumn("base_url", F.col("url")).withColumn("_bd", registrable_domains(F.col("_b.host")) if o == "same-domain" else none)
    if o in ("all", "same-domain"):
        x = x.withColumn("_f", url_parts("loaded_url")).withColumn("_fd", registrable_domains(F.col("_f.host")) if o == "same-domain" else none)
        x = x.withColumn("base_url", filter_base(F.lit(o), none, F.col("url"), F.col("loaded_url"), F.col("_bd"), F.col("_fd")))
        own = F.col("base_url") == F.col("url")
        x = x.withColumn("_b", F.when(own, F.col("_b")).otherwise(F.col("_f"))).withColumn("_bd", F.when(own, F.col("_bd")).otherwise(F.col("_fd")))
    x = x.withColumn("src_id", F.col("id")).withColumn("depth", F.coalesce("crawl_depth", F.lit(0)))
    return link_rows(x, ["src_id", "base_url", "depth", "_b", "_bd"], "text", "loaded_url", selector, repeats).withColumn("url", F.col("_u.href"))


def seed_queue(spark: SparkSession, seeds: DataFrame) -> DataFrame:
    """A queue of the seeds (url, pos and any other field of a request), the first of equal keys."""
    made = build_requests(seeds.drop("pos")).join(seeds.select("url", "pos").groupBy("url").agg(F.min("pos").alias("pos")), "url")
    empty = spark.createDataFrame([], schemas.QUEUE)
    return Q.add_batch(empty, made.where("error is null").withColumn("crawl_depth", F.coalesce("crawl_depth", F.lit(0))))[0]


#: Parts of the queue after which they're written as one.
PARTS = 24


class Ledger:
    """The queue as parts that are only appended to.

    Order numbers are unique and a step takes the smallest there are, in front (negative) or not. So what a part has left
    are its rows above the largest number taken since it was written: one number a part, and a filter that files are
    skipped by. Requests that are put back come in a later part under their new number. All ids that ever came are known
    from the parts, so a link to a handled request is no new one.
    """

    def __init__(self, queue: DataFrame) -> None:
        self.columns, self.spark = queue.columns, queue.sparkSession
        queue = written(queue, "queue")
        self.handled = [queue.where("order_no is null")]
        self.parts: list[tuple[DataFrame, int | None]] = [(queue.where("order_no is not null"), None)]
        self.known = [queue.select("id")]
        self.top = queue.agg(F.coalesce(F.max(F.abs("order_no")), F.lit(0))).first()[0]

    def pending(self) -> DataFrame:
        return _union([part if taken is None else part.where(F.col("order_no") > taken) for part, taken in self.parts])

    def queue(self) -> DataFrame:
        return _union([self.pending(), *self.handled])

    def take(self, n: int) -> DataFrame:
        batch = written(Q.fetch_next(self.pending(), n), "batch")
        if (last := batch.agg(F.max("order_no")).first()[0]) is not None:
            self.parts = [(part, last if taken is None else max(taken, last)) for part, taken in self.parts]
        return batch

    def _numbered(self, rows: DataFrame, pos: str, forefront: Column) -> DataFrame:
        part = Q.with_row_numbers(rows, pos, "_n").withColumn("order_no", (F.col("_n") + self.top) * F.when(forefront, -1).otherwise(1))
        for c in self.columns:
            if c not in part.columns:
                part = part.withColumn(c, F.lit(None))
        kinds = dict(self.parts[0][0].dtypes)
        part = written(part.select(*[F.col(c).cast(kinds[c]) if c != "in_progress" else F.lit(False).alias(c) for c in self.columns]), "queue")
        self.top = part.agg(F.coalesce(F.max(F.abs("order_no")), F.lit(self.top))).first()[0]
        return part

    def commit(self, state: DataFrame, fresh: DataFrame) -> None:
        """Adds a step's results: `state` are its requests with `next`, `fresh` new ones (with a unique pos), of which those
        that are known stay out."""
        done = state.where("next = 'handled'").withColumn("handled_at", F.coalesce("handled_at", F.current_timestamp())).withColumn("order_no", F.lit(None).cast("bigint"))
        self.handled.append(written(done.withColumn("in_progress", F.lit(False)).select(*self.columns), "handled"))
        back = state.where("next in ('front', 'end')").withColumn("_front", F.col("next") == "front")
        self.parts.append((self._numbered(back, "order_no", F.col("_front")), None))
        unknown = Q.first_of_each(fresh, "id", "pos").join(_union(self.known), "id", "left_anti")
        part = self._numbered(unknown, "pos", F.lit(False))
        self.parts.append((part, None))
        self.known.append(part.select("id"))
        if len(self.parts) > PARTS:
            self.parts = [(written(self.pending().repartitionByRange("order_no"), "queue"), None)]
            self.known = [written(_union(self.known), "known")]
            self.handled = [written(_union(self.handled), "handled")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def step(ledger: Ledger, batch: DataFrame, fetch: Fetcher, options: CrawlOptions, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(attempts, items) after fetching one batch, whose results the ledger has then.

    Requests that robots.txt forbids aren't fetched: they're skipped.
    """
    o = options
    asked, denied = batch, None
    if robots is not None:
        checked = written(robots_allowed(batch, robots, o.agent).drop("crawl_delay"), "checked")
        asked, denied = checked.where("allowed").drop("allowed"), checked.where("not allowed").drop("allowed")
    if o.before:
        asked = o.before(asked)
    got = written(fetch(asked), "fetched")
    x = asked.join(got.drop("headers", "redirects").withColumnRenamed("url", "_final"), asked["id"] == got["request_id"]).drop("request_id")
    x = x.withColumn("loaded_url", F.coalesce("_final", "url"))
    if o.after:
        x = o.after(x)
    x = x.withColumn("_t", url_parts("loaded_url")).withColumn("_o", url_parts("url"))
    x = x.withColumn("_td", registrable_domains(F.col("_t.host"))).withColumn("_od", registrable_domains(F.col("_o.host")))
    strategy = F.coalesce("enqueue_strategy", F.lit("all"))
    left = (F.col("loaded_url") != F.col("url")) & rejection(strategy, F.col("_t"), F.col("_o"), F.col("_td"), F.col("_od")).isNotNull()
    x = x.withColumn("_c", A.classify_response(F.col("status"), F.col("mime"), o.page_types, o.ignore_statuses, o.error_statuses, redirected_out=left))
    x = x.select("*", "_c.error_kind", "_c.error_message").drop("_c", "_t", "_o", "_td", "_od", "_final")
    if o.routes and o.extract is None:
        lost = F.col("error_kind").isNull() & ~F.coalesce(F.col("label").isin(*o.routes), F.lit(False))
        x = x.withColumn("error_message", F.when(lost, F.concat(F.lit("no route for "), F.coalesce("label", F.lit("requests without a label")))).otherwise(F.col("error_message")))
        x = x.withColumn("error_kind", F.when(lost, "critical").otherwise(F.col("error_kind")))
    if denied is not None:
        x = x.unionByName(denied.withColumn("error_kind", F.lit("skipped")).withColumn("error_message", F.lit("robots.txt")), allowMissingColumns=True)
    state = written(A.next_state(x, o.default_retries), "attempts")
    if o.on_error:
        again = F.col("outcome") == "retry"
        back = o.on_error(state.where(again))
        back = back.withColumn("next", F.when(F.coalesce("no_retry", F.lit(False)), "handled").otherwise(F.col("next"))).withColumn("outcome", F.when(F.col("next") == "handled", "failed").otherwise("retry"))
        state = written(state.where(~again).unionByName(back.select(*state.columns)), "attempts")
    ok = decoded(state.where("outcome = 'ok'"))
    handlers = [(F.col("label") == label, f) for label, f in o.routes.items()]
    if o.extract:
        handlers.append((~F.coalesce(F.col("label").isin(*o.routes), F.lit(False)) if o.routes else F.lit(True), o.extract))
    items = [f(ok.where(mine)) for mine, f in handlers] + ([o.on_failed(state.where("outcome = 'failed'"))] if o.on_failed else [])
    fresh = to_requests(skip_reasons(links_of(ok, o.enqueue, o.selector, repeats=False), o.enqueue, robots), o.enqueue)
    # A page's place in the batch and a link's place in the page give the order of adding.
    fresh = fresh.join(batch.select(F.col("id").alias("src_id"), F.col("order_no").alias("_order")), "src_id").withColumn("pos", F.struct("_order", "pos"))
    fresh = written(fresh.select("id", "url", "unique_key", "method", "crawl_depth", "enqueue_strategy", "label", "user_data", "pos"), "links")
    ledger.commit(state, fresh)
    log = state.select(F.col("id").alias("request_id"), "crawl_depth", (F.col("retry_count") + F.when(F.col("outcome") == "retry", 0).otherwise(1)).alias("attempt"), "outcome", "error_kind", "error_message", "status", "duration_ms", "retry_count")
    return log, _union(items) if items else None


def crawl(spark: SparkSession, seeds: DataFrame, fetch: Fetcher, options: CrawlOptions | None = None, robots: DataFrame | None = None) -> CrawlResult:
    """Crawls until nothing is left, the limit of requests or steps is reached, or a critical error stops it."""
    o = options or CrawlOptions()
    ledger = Ledger(seed_queue(spark, seeds))
    logs, items, finished, n, stopped = None, None, 0, 0, "steps"
    for n in count():
        room = o.batch if o.max_requests is None else min(o.batch, o.max_requests - finished)
        if n == o.max_steps:
            break
        if room <= 0:
            stopped = "limit"
            break
        batch = ledger.take(room)
        if batch.isEmpty():
            stopped = "finished"
            break
        log, got = step(ledger, batch, fetch, o, robots)
        logs = log if logs is None else logs.unionByName(log)
        if got is not None:
            got = written(got, "items")
            items = got if items is None else items.unionByName(got)
        ended = log.agg(F.count_if(F.col("outcome").isin("ok", "failed", "skipped")).alias("n"), F.coalesce(F.bool_or(F.col("outcome") == "critical"), F.lit(False)).alias("c")).first()
        finished += ended.n
        if ended.c:
            n, stopped = n + 1, "critical"
            break
    return CrawlResult(ledger.queue(), logs, items, n, stopped)
