"""One UTC instant for each date-time text, whatever its format and zone (problem 6).

Texts are read into UTC times, where the offset is written, or local wall-clock times. Local times are joined as-of to the
offset intervals of the site's zone, exploded by zone and local year: two matching intervals with different offsets mean
an ambiguous time, none a time that was skipped, one gives the offset. A zone abbreviation restricts the intervals to
those that bear it.

Defined results: no row for null, empty and unreadable texts, for sites that aren't known, for unknown zones, for a null
id. Local times before FIRST_YEAR have the zone's first offset; those after LAST_YEAR have the offset of the same day and
time in a year of the last rules whose days fall on the same weekdays. A null time zone is UTC. Repeated rows each give their own row.
"""

from __future__ import annotations

from calendar import isleap
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.functions.instants import read_instant

#: No zone had an offset other than its first one before, nor has one rules that end after.
FIRST_YEAR, LAST_YEAR = 1800, 2100
#: No zone changes its offset twice within this; before 1900 none did within the longer one.
_STEP, _LONG_STEP = timedelta(days=5), timedelta(days=150)
_EVER = 1 << 62
#: Zones times years above which the interval table is joined by a shuffle instead of being broadcast.
BROADCAST_ROWS = 150_000

_READ = T.StructType([T.StructField("utc", T.LongType()), T.StructField("local", T.LongType()), T.StructField("abbreviation", T.StringType())])


@F.pandas_udf(_READ)
def _read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in parts:
        got = [read_instant(x if isinstance(x, str) else None) for x in s]
        yield pd.DataFrame({f: pd.Series([g[i] for g in got], dtype=t) for i, (f, t) in enumerate((("utc", "Int64"), ("local", "Int64"), ("abbreviation", object)))})


@lru_cache(1 << 10)
def zone_intervals(name: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple[datetime, datetime, int, str]]:
    """(from, to, offset in seconds, abbreviation) of a zone, in UTC, without gaps."""
    zone = ZoneInfo(name)

    def state(t: datetime) -> tuple[int, str]:
        there = t.astimezone(zone)
        return int(there.utcoffset().total_seconds()), there.tzname() or ""

    at, end = datetime(first, 1, 1, tzinfo=timezone.utc) - timedelta(days=2), datetime(last + 1, 1, 3, tzinfo=timezone.utc)
    out, begun, now = [], at, state(at)
    while at < end:
        after = min(at + (_STEP if at.year >= 1899 else _LONG_STEP), end)
        if (then := state(after)) != now:
            lo, hi = at, after
            while hi - lo > timedelta(seconds=1):
                mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                lo, hi = (mid, hi) if state(mid) == now else (lo, mid)
            out.append((begun, hi, *now))
            begun, now, at = hi, state(hi), hi
        else:
            at = after
    return [*out, (begun, end, *now)]


def interval_rows(names: list[str]) -> list[tuple[str, int, list[tuple[int, int, int, str]]]]:
    """(zone, local year, intervals that touch it as local lo, local hi, offset, abbreviation), in microseconds."""
    rows: dict[tuple[str, int], list] = {}
    for name in names:
        try:
            intervals = zone_intervals(name)
        except (ValueError, OSError, KeyError):
            continue
        for lo, hi, offset, abbreviation in intervals:
            lo, hi = (x.replace(tzinfo=None) + timedelta(seconds=offset) for x in (lo, hi))
            for year in range(max(lo.year, FIRST_YEAR), min(hi.year, LAST_YEAR) + 1):
                us = [(x - datetime(1970, 1, 1)) // timedelta(microseconds=1) for x in (lo, hi)]
                us[0] = -_EVER if (lo - timedelta(days=3)).year < FIRST_YEAR else us[0]
                rows.setdefault((name, year), []).append((*us, offset * 1_000_000, abbreviation.upper()))
    return [(z, y, v) for (z, y), v in rows.items()]


def _like(year: int) -> int:
    """A year of the last rules, with the same days on the same weekdays."""
    return next(y for y in range(LAST_YEAR - 28, LAST_YEAR) if date(y, 1, 1).weekday() == date(year, 1, 1).weekday() and isleap(y) == isleap(year))


#: By weekday of the first of January (1: Sunday), plus 10 in leap years.
_LIKE = {(date(y, 1, 1).weekday() + 1) % 7 + 1 + 10 * isleap(y): _like(y) for y in range(LAST_YEAR + 1, LAST_YEAR + 400)}
_INTERVALS = "_iv_zone string, _iv_year int, _intervals array<struct<lo: bigint, hi: bigint, offset: bigint, abbreviation: string>>"


def to_utc(texts: DataFrame, sites: DataFrame, text: str = "lastmod", domain: str = "domain") -> DataFrame:
    """`texts` with `utc_us`, the instant in microseconds since 1970 UTC, or null."""
    spark = texts.sparkSession
    # The zones in use: a few hundred names at most, as many as the zone database has.
    names = [r[0] for r in sites.select("time_zone").where("time_zone is not null").distinct().collect()]
    rows = interval_rows(sorted({*names, "UTC"}))
    intervals = spark.createDataFrame(rows, _INTERVALS)
    if len(rows) <= BROADCAST_ROWS:
        intervals = F.broadcast(intervals)
    zones = sites.groupBy(F.col("domain").alias("_domain")).agg(F.coalesce(F.min("time_zone"), F.lit("UTC")).alias("_zone"))
    read = texts.withColumn("_read", _read(F.col(text)))
    read = read.join(zones, F.col(domain) == F.col("_domain"), "left")
    year = F.year(F.timestamp_micros(F.col("_read.local")))
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    leap = F.when(F.datediff(F.make_date(year, F.lit(12), F.lit(31)), new_year) == 365, 10).otherwise(0)
    like = F.create_map(*[F.lit(x) for kv in _LIKE.items() for x in kv])[F.dayofweek(new_year) + leap]
    late = year > LAST_YEAR
    read = read.withColumn("_year", F.when(late, like).otherwise(F.greatest(year, F.lit(FIRST_YEAR))))
    days = F.when(late, F.datediff(new_year, F.make_date(F.col("_year"), F.lit(1), F.lit(1)))).otherwise(0).cast("bigint")
    read = read.withColumn("_at", F.col("_read.local") - days * 86_400_000_000)
    read = read.join(intervals, (F.col("_iv_zone") == F.col("_zone")) & (F.col("_iv_year") == F.col("_year")), "left")
    at, abbreviation = F.col("_at"), F.col("_read.abbreviation")
    fits = F.filter("_intervals", lambda x: (x.lo <= at) & (at < x.hi) & (abbreviation.isNull() | (abbreviation == x.abbreviation)))
    offsets = F.array_distinct(F.transform(fits, lambda x: x.offset))
    local = F.when(F.size(offsets) == 1, F.col("_read.local") - offsets[0])
    return read.withColumn("utc_us", F.coalesce(F.col("_read.utc"), local)).drop("_read", "_year", "_at", "_domain", "_zone", "_iv_zone", "_iv_year", "_intervals")


def lastmods(sitemap_urls: DataFrame, sitemap_xml: DataFrame) -> DataFrame:
    """(src, rec_id, pos, domain, lastmod) of both sitemap tables."""
    flat = sitemap_urls.select(F.lit("sitemap_urls").alias("src"), F.col("row_id").alias("rec_id"), F.lit(0).cast("bigint").alias("pos"), "domain", "lastmod")
    items = sitemap_xml.select("sitemap_id", "domain", F.posexplode("items").alias("pos", "item"))
    nested = items.select(F.lit("sitemap_xml").alias("src"), F.col("sitemap_id").alias("rec_id"), F.col("pos").cast("bigint"), "domain", F.col("item.lastmod").alias("lastmod"))
    return flat.unionByName(nested).where("rec_id is not null")


def lastmod_instants(spark: SparkSession, sitemap_urls: DataFrame, sitemap_xml: DataFrame, sites: DataFrame) -> DataFrame:
    """(src, rec_id, pos, utc_ms): a row for each lastmod that denotes exactly one instant."""
    read = to_utc(lastmods(sitemap_urls, sitemap_xml).where("lastmod is not null"), sites)
    return read.where("utc_us is not null").select("src", "rec_id", "pos", F.floor(F.col("utc_us") / F.lit(1000)).cast("bigint").alias("utc_ms"))
