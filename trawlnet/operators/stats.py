"""Statistics of crawls, from the table of attempts; each is one aggregation with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.functions.text import error_group

_MS_A_MINUTE = 60_000


def crawl_statistics(attempts: DataFrame, runtime_ms: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Counters, durations and rates. `attempts` has outcome (ok, failed, retry, skipped), duration_ms and retry_count.

    The total leaves skipped requests out, the finished ones count them. Averages are rounded half away from zero and 0
    where there's nothing; the rate of successes is rounded, that of failures rounded down.
    """
    ok, failed = F.col("outcome") == "ok", F.col("outcome") == "failed"
    end = ok | failed
    a = attempts.groupBy(*(by or [])).agg(
        F.count_if(ok).alias("requests_succeeded"), F.count_if(failed).alias("requests_failed"), F.count_if(F.col("outcome") == "retry").alias("requests_retries"),
        F.count_if(F.col("outcome") == "skipped").alias("requests_skipped"), F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("succeeded_ms"),
        F.coalesce(F.sum(F.when(failed, F.col("duration_ms"))), F.lit(0)).alias("failed_ms"), F.coalesce(F.min(F.when(end, F.col("duration_ms"))), F.lit(0)).alias("min_duration_ms"),
        F.coalesce(F.max(F.when(end, F.col("duration_ms"))), F.lit(0)).alias("max_duration_ms"),
    )
    total = F.col("requests_succeeded") + F.col("requests_failed")

    def avg(s: str, n: Column) -> Column:
        return F.when(n > 0, F.round(F.col(s) / n)).otherwise(0).cast("bigint")

    run = runtime_ms if runtime_ms is not None else F.lit(0)
    return a.select(
        "*", total.alias("requests_total"), (total + F.col("requests_skipped")).alias("requests_finished"),
        avg("succeeded_ms", F.col("requests_succeeded")).alias("avg_succeeded_ms"), avg("failed_ms", F.col("requests_failed")).alias("avg_failed_ms"),
        F.when(run > 0, F.round(F.col("requests_succeeded") * _MS_A_MINUTE / run)).otherwise(0).cast("bigint").alias("succeeded_per_minute"),
        F.when(run > 0, F.floor(F.col("requests_failed") * _MS_A_MINUTE / run)).otherwise(0).cast("bigint").alias("failed_per_minute"),
    )


def retry_histogram(attempts: DataFrame) -> DataFrame:
    """(retries, n): finished requests by their retries, with zeros in the gaps."""
    done = attempts.where("outcome in ('ok', 'failed')").groupBy(F.col("retry_count").alias("retries")).count()
    span = done.agg(F.max("retries").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0), "m")).alias("retries"))
    return span.join(done, "retries", "left").select("retries", F.coalesce("count", F.lit(0)).alias("n"))


def status_histogram(attempts: DataFrame) -> DataFrame:
    """(status, n) of attempts with a status from 400 to 599."""
    return attempts.where("status between 400 and 599").groupBy("status").agg(F.count("*").alias("n"))


def error_histogram(attempts: DataFrame, outcomes: tuple[str, ...] = ("failed",)) -> DataFrame:
    """(error_group, n) of attempts that ended so; digits in messages are masked."""
    return attempts.where(F.col("outcome").isin(*outcomes)).groupBy(error_group(F.col("error_message")).alias("error_group")).agg(F.count("*").alias("n"))


#: The members of a stored statistics record, in their order, and the column and type of each.
RECORD = {
    "requestsSucceeded": "requests_succeeded bigint", "requestsFailed": "requests_failed bigint", "requestsRetries": "requests_retries bigint",
    "requestsFailedPerMinute": "failed_per_minute bigint", "requestsSucceededPerMinute": "succeeded_per_minute bigint", "requestMinDurationMillis": "min_duration_ms bigint",
    "requestMaxDurationMillis": "max_duration_ms bigint", "requestTotalFailedDurationMillis": "failed_ms bigint", "requestTotalSucceededDurationMillis": "succeeded_ms bigint",
    "crawlerStartedAt": "started_at timestamp", "crawlerFinishedAt": "finished_at timestamp", "statsPersistedAt": "persisted_at timestamp", "crawlerRuntimeMillis": "runtime_ms bigint",
    "crawlerLastStartTimestamp": "last_start_ms bigint", "requestRetryHistogram": "retry_histogram array<bigint>", "statsId": "stats_id string",
    "requestAvgFailedDurationMillis": "avg_failed_ms bigint", "requestAvgSucceededDurationMillis": "avg_succeeded_ms bigint", "requestTotalDurationMillis": "total_ms bigint",
    "requestsTotal": "requests_total bigint", "requestsWithStatusCode": "status_codes map<string,bigint>", "errors": "errors map<string,bigint>", "retryErrors": "retry_errors map<string,bigint>",
}
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Members that may be null in a record that is restored.
_NULLABLE = {
    "requestsFailedPerMinute", "requestsSucceededPerMinute", "requestMinDurationMillis", "crawlerStartedAt", "crawlerFinishedAt", "requestAvgFailedDurationMillis",
    "requestAvgSucceededDurationMillis",
}


def histograms(attempts: DataFrame) -> DataFrame:
    """One row (retry_histogram, status_codes, errors, retry_errors): the histograms as a record holds them. They have an entry
    for each number of retries, status and group of errors, not for each attempt."""

    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.col("n"))))).alias(name))

    retries = retry_histogram(attempts).agg(F.transform(F.sort_array(F.collect_list(F.struct("retries", "n"))), lambda x: x.n).alias("retry_histogram"))
    out = retries.join(packed(status_histogram(attempts), "status", "status_codes"))  # one row each
    out = out.join(packed(error_histogram(attempts), "error_group", "errors"))
    return out.join(packed(error_histogram(attempts, ("retry",)), "error_group", "retry_errors"))


def statistics_record(statistics: DataFrame) -> DataFrame:
    """(record): statistics as JSON with all members; columns that aren't there are empty or null. Averages of nothing are
    null, and the minimum is while nothing has ended; a minimum of 0 is 0."""
    empty = {"retry_histogram": F.array().cast("array<bigint>"), "status_codes": F.create_map().cast("map<string,bigint>"), "errors": F.create_map().cast("map<string,bigint>")}
    empty |= {"retry_errors": empty["errors"], "persisted_at": F.current_timestamp(), "runtime_ms": F.lit(0), "last_start_ms": F.unix_millis(F.current_timestamp()), "stats_id": F.lit("0")}
    empty["total_ms"] = F.col("succeeded_ms") + F.col("failed_ms")
    zero = F.lit(0).cast("bigint")
    fields = []
    for n, kind in RECORD.items():
        name, of = kind.split(" ", 1)
        c = F.col(name) if name in statistics.columns else empty.get(name, F.lit(None)).cast(of)
        if n.startswith("requestAvg"):
            c = F.nullif(c, zero)
        elif n == "requestMinDurationMillis":
            c = F.when(F.col("requests_total") > 0, c)
        fields.append((F.date_format(c, _ISO) if of == "timestamp" else c).alias(n))
    return statistics.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def restore_statistics(records: DataFrame) -> DataFrame:
    """Statistics from their records; one that lacks a member, or has null where none may be, gives no row. Errors are kept
    if they're counts by group."""
    ddl = ", ".join(f"`{n}` {'string' if kind.endswith('timestamp') else kind.split(' ', 1)[1]}" for n, kind in RECORD.items() if n not in ("errors", "retryErrors"))
    j = records.select("record", F.from_json("record", ddl).alias("j"))
    whole = F.size(F.array_intersect(F.json_object_keys("record"), F.array(*[F.lit(n) for n in RECORD]))) == len(RECORD)
    for n in RECORD:
        if n not in _NULLABLE and n not in ("errors", "retryErrors"):
            whole = whole & F.col(f"j.{n}").isNotNull()
    out = []
    for n, kind in RECORD.items():
        name, of = kind.split(" ", 1)
        if n in ("errors", "retryErrors"):
            c = F.coalesce(F.from_json(F.get_json_object("record", f"$.{n}"), of, {"mode": "PERMISSIVE"}), F.create_map().cast(of))
        else:
            c = F.try_to_timestamp(f"j.{n}") if of == "timestamp" else F.col(f"j.{n}")
            c = F.coalesce(c, F.lit(0).cast("bigint")) if of == "bigint" else c
        out.append(c.alias(name))
    return j.where(whole).select(*out)


def runtime_ms(started: Column, ended: Column, earlier_ms: Column | None = None) -> Column:
    """The time a crawl has run, earlier runs it goes on from included."""
    return F.unix_millis(ended) - F.unix_millis(started) + (earlier_ms if earlier_ms is not None else F.lit(0))


def tasks_per_minute(events: DataFrame, at: str = "ts", by: list[str] | None = None) -> DataFrame:
    """`events` with `in_last_minute`: the events of the 60 one-second buckets that end with the event's own."""
    second = F.unix_seconds(F.col(at))
    per_second = events.groupBy(*(by or []), second.alias("second")).agg(F.count("*").alias("n"))
    # A row a second and key: however many events a second has, its window holds 60 rows.
    w = Window.partitionBy(*(by or [])).orderBy("second").rangeBetween(-59, 0)
    return per_second.withColumn("in_last_minute", F.sum("n").over(w))
