"""Load: time-weighted overload ratios, and what they mean for concurrency."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The ratio above which a signal means overload.
LIMITS = {"memory": 0.2, "cpu": 0.4, "event_loop": 0.6, "storage": 0.3}


def overload(snapshots: DataFrame, window_ms: int | None = None, by: list[str] | None = None, limit: float = 0.2) -> DataFrame:
    """(by..., ratio, is_overloaded) of snapshots (created_at, is_overloaded), over the last `window_ms` before the newest.

    A snapshot weighs the milliseconds since the one before it, at least 1; the first only anchors, a single one is the
    ratio itself. The comparison with the limit is strict. Snapshots of one signal are one group, as order matters.
    """
    keys = by or ["signal"]
    ms = F.unix_millis("created_at")
    x = snapshots.where("created_at is not null").select(*keys, ms.alias("_ms"), F.col("is_overloaded").cast("int").alias("_o"))
    if window_ms:
        newest = F.max("_ms").over(Window.partitionBy(*keys))
        # What comes after the last element that's too old.
        x = x.withColumn("_old", F.col("_ms") < newest - window_ms).where("not _old")
    order = Window.partitionBy(*keys).orderBy("_ms", "_o")
    gap = F.col("_ms") - F.lag("_ms").over(order)  # null for the first; greatest() would make that a number
    x = x.withColumn("_w", F.when(gap > 0, gap).when(gap <= 0, 1))
    a = x.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_o")).alias("_a"), F.sum("_w").alias("_b"), F.max(F.when(F.col("_w").isNull(), F.col("_o"))).alias("_first"))
    ratio = F.coalesce(F.col("_a") / F.col("_b"), F.col("_first").cast("double"), F.lit(0.0))
    return a.select(*keys, ratio.alias("ratio"), (ratio > limit).alias("is_overloaded"))


def system_status(snapshots: DataFrame, current_ms: int = 5_000, historical_ms: int = 30_000) -> DataFrame:
    """(is_idle_now, was_idle): no signal overloaded in the current and in the historical window."""
    out = []
    for ms, name in ((current_ms, "is_idle_now"), (historical_ms, "was_idle")):
        r = overload(snapshots, ms)
        limit = F.coalesce(*[F.when(F.col("signal") == s, v) for s, v in LIMITS.items()], F.lit(0.2))
        out.append(r.agg(F.coalesce(~F.bool_or(F.col("ratio") > limit), F.lit(True)).alias(name)))
    return out[0].crossJoin(out[1])  # one row each


def autoscale_step(current: int, desired: int, least: int, most: int, idle: bool, minute_full: bool = False, ratio: float = 0.9, step: float = 0.05) -> int:
    """The next desired concurrency: up while idle and nearly all of it is used, down while not idle."""
    if minute_full:
        return desired
    if idle and desired < most and current >= math.floor(desired * ratio):
        return min(most, desired + math.ceil(desired * step))
    if not idle and desired > least:
        return max(least, desired - math.ceil(desired * step))
    return desired


def may_start(current: int, desired: int, least: int, idle: bool, minute_full: bool = False) -> bool:
    return not minute_full and current < desired and (current < least or idle)
