"""Links to new requests: one projection that gives each link its reason to be skipped, or none."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.functions.keys import request_id, unique_key
from trawlnet.functions.patterns import passes
from trawlnet.functions.suffixes import registrable_domains
from trawlnet.functions.urls import normalized_url, rejection, url_parts


@dataclass(frozen=True)
class EnqueueOptions:
    strategy: str = "same-hostname"
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    include_regex: Sequence[str] = ()
    exclude_regex: Sequence[str] = ()
    max_depth: int | None = None
    limit: int | None = None
    label: str | None = None
    user_data: str | None = None
    #: Gives for the DataFrame of survivors the one to enqueue; rows may be dropped and columns changed.
    transform: Callable[[DataFrame], DataFrame] | None = None
    agent: str = "*"
    columns: Sequence[str] = field(default=())


def skip_reasons(links: DataFrame, options: EnqueueOptions, robots: DataFrame | None = None) -> DataFrame:
    """`links` (src_id, pos, url, base_url, depth of the page) with `skip_reason`, null for links to enqueue. What is known already
    isn't computed again: the parsed URL `_u`, the parsed base `_b` with its domain `_bd`, and `is_first`, which says that no
    link before it on the page has its URL.

    In this order: scheme and strategy, patterns, a copy within the page (of the URL text; 'duplicate'), depth, robots. The
    copies of a filtered link have its reason, those of a passing one are duplicates. Pages' links don't meet: where the
    first links aren't known, a window over one page finds them.
    """
    o = options
    x = links if "_u" in links.columns else links.withColumn("_u", url_parts("url"))
    by_domain = o.strategy == "same-domain"  # the one strategy that needs domains
    x = x if "_b" in x.columns else x.withColumn("_b", url_parts("base_url"))
    x = x if "_bd" in x.columns else x.withColumn("_bd", registrable_domains(F.col("_b.host")) if by_domain else F.lit(None).cast("string"))
    x = x.withColumn("_ud", registrable_domains(F.col("_u.host")) if by_domain else F.lit(None).cast("string"))
    x = x.withColumn("_r1", rejection(F.lit(o.strategy), F.col("_u"), F.col("_b"), F.col("_ud"), F.col("_bd")))
    x = x.withColumn("_r1", F.coalesce("_r1", F.when(~passes(F.col("_u.href"), o.include, o.exclude, o.include_regex, o.exclude_regex), "pattern")))
    if "is_first" in x.columns:
        again = ~F.col("is_first")
    else:
        again = F.row_number().over(Window.partitionBy("src_id", "_u.href", F.col("_r1").isNull()).orderBy("pos")) > 1
    reason = F.coalesce(F.col("_r1"), F.when(again, "duplicate"))
    if o.max_depth is not None:
        reason = F.coalesce(reason, F.when(F.coalesce(F.col("depth"), F.lit(0)) + 1 > o.max_depth, "depth"))
    x = x.withColumn("skip_reason", reason)
    if robots is not None:
        from trawlnet.functions.robots import robots_allowed

        x = robots_allowed(x.withColumn("_href", F.col("_u.href")), robots, o.agent, "_href")
        x = x.withColumn("skip_reason", F.coalesce("skip_reason", F.when(~F.col("allowed"), "robots"))).drop("allowed", "crawl_delay", "_href")
    return x.withColumn("url", F.coalesce("_u.href", "url")).drop("_u", "_b", "_ud", "_bd", "_r1", "is_first")


def to_requests(links: DataFrame, options: EnqueueOptions) -> DataFrame:
    """Requests of the links without a reason to skip: one level deeper, tagged with strategy, label and user data; `limit`
    counts, for each page, those that are left after the transform."""
    o = options
    x = links.where("skip_reason is null").withColumn("crawl_depth", F.coalesce(F.col("depth"), F.lit(0)) + 1)
    x = x.withColumn("enqueue_strategy", F.lit(o.strategy)).withColumn("label", F.lit(o.label).cast("string")).withColumn("user_data", F.lit(o.user_data or "{}")).withColumn("method", F.lit("GET"))
    if o.transform:
        x = o.transform(x)
    if o.limit is not None:
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy("src_id").orderBy("pos"))).where(F.col("_n") <= o.limit).drop("_n")
    x = x.withColumn("unique_key", unique_key(F.col("url"), normalized_url(F.col("url")), F.col("method"), F.lit(None).cast("string")))
    return x.withColumn("id", request_id(F.col("unique_key")))


def add_requests(rows: DataFrame, parent_depth: int) -> DataFrame:
    """Requests added from a page by hand: a level below it unless they say otherwise; no scope or depth is checked."""
    return rows.withColumn("crawl_depth", F.coalesce("crawl_depth", F.lit(parent_depth + 1)))
