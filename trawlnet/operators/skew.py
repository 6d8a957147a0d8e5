"""Per-key results where a few keys hold most rows (problem 5).

Two-stage salted aggregation: keys whose share of the rows is above a threshold get a salt, partial results are computed
for each (key, salt), and the partials are merged by key. The salt is a hash of the column whose distinct values are
counted, or of the row, so a task that runs again gives the same result (a random number wouldn't), and exact distinct
counts can be merged by adding, as each value has one salt.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.session import written

#: A key with more than this share of all rows is salted; at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.005
SALTS = 64


def heavy_keys(rows: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Keys with more than `share` of all rows, counted over all rows; at most 1 / share of them."""
    counts = written(rows.groupBy(key).count(), "counts")  # so the rows are read once for both
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return [r[0] for r in counts.where(F.col("count") > max(1, total * share)).select(key).collect() if r[0] is not None]


def salted_aggregate(
    rows: DataFrame,
    keys: str | list[str],
    partials: Mapping[str, Column],
    merges: Mapping[str, Column],
    distinct: str | None = None,
    heavy: list | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """(keys, merges...): `partials` are aggregates over rows, `merges` aggregates over columns named as the partials.

    The first of the keys is the one that may be heavy. With `distinct` there's also `n_distinct`, the exact number of
    different non-null values of that column. Null keys form one group, as in GROUP BY, and are salted too. An empty table
    gives no rows.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if heavy is None:
        heavy = heavy_keys(rows, keys[0])
    what = F.xxhash64(distinct) if distinct else F.xxhash64(*rows.columns)
    is_heavy = F.col(keys[0]).isNull() | (F.col(keys[0]).isin(heavy) if heavy else F.lit(False))
    salted = rows.withColumn("_salt", F.when(is_heavy, F.pmod(what, F.lit(salts))).otherwise(F.lit(-1)).cast("int"))
    names = list(partials)
    if distinct:
        # Equal values of a key meet in one group here, wherever their rows were; only counts go on.
        inner = salted.groupBy(*keys, "_salt", F.col(distinct).alias("_value")).agg(*[c.alias(n) for n, c in partials.items()])
        first = inner.groupBy(*keys, "_salt").agg(*[merges[n].alias(n) for n in partials], F.count("_value").alias("n_distinct"))
        names.append("n_distinct")
    else:
        first = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(*keys).agg(*[merges.get(n, F.sum(n)).alias(n) for n in names])
