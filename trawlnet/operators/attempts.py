"""What became of each fetch: classification and the next state of its request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that mean the session is blocked, and types a page may have.
BLOCKED = (401, 403, 429)
PAGE_TYPES = ("text/html", "application/xhtml+xml")
MAX_RETRIES = 3


def classify_response(
    status: Column,
    mime: Column,
    types: Sequence[str] = PAGE_TYPES,
    ignore: Sequence[int] = (),
    as_error: Sequence[int] = (),
    blocked: Sequence[int] = BLOCKED,
    redirected_out: Column | None = None,
) -> Column:
    """(error_kind, error_message) of a response, nulls for success.

    A 429 is throttling, a redirect out of scope skips the request, an unsupported type isn't retried (servers' errors and
    blocked pages may have any), blocked statuses are errors of the session, 500 and above or listed ones are errors; other
    statuses succeed.
    """
    server = (status >= 500) | status.isin(*blocked) if blocked else status >= 500
    fails = ((status >= 500) & ~status.isin(*ignore) if ignore else status >= 500) | (status.isin(*as_error) if as_error else F.lit(False))
    kind = F.when(status.isNull(), "other")
    if 429 not in ignore:
        kind = kind.when(status == 429, "throttled")
    if redirected_out is not None:
        kind = kind.when(redirected_out, "skipped")
    kind = kind.when(~server & ~F.coalesce(mime, F.lit("application/octet-stream")).isin(*types), "non_retryable")
    kind = kind.when(status.isin(*blocked), "session") if blocked else kind
    kind = kind.when(fails, "other")
    message = (
        F.when(kind == "non_retryable", F.concat(F.lit("unexpected content type "), F.coalesce(mime, F.lit("application/octet-stream"))))
        .when(kind == "session", F.concat(F.lit("blocked: status "), status.cast("string")))
        .when(kind == "throttled", F.lit("429 too many requests"))
        .when(kind == "skipped", F.lit("redirected out of scope"))
        .when(status.isNull(), F.lit("no response"))
        .when(kind.isNotNull(), F.concat(F.lit("status "), status.cast("string")))
    )
    return F.struct(kind.alias("error_kind"), message.alias("error_message"))


def retries(error_kind: Column, no_retry: Column, retry_count: Column, max_retries: Column, default: int = MAX_RETRIES) -> Column:
    """Whether a failed request is tried again: never if it or its error says so, always if the error asks for it, else
    while it was tried less often than it may be."""
    return F.when(F.coalesce(no_retry, F.lit(False)) | (error_kind == "non_retryable"), False).when(error_kind == "retry_request", True).otherwise(retry_count < F.coalesce(max_retries, F.lit(default)))


def next_state(attempts: DataFrame, default_retries: int = MAX_RETRIES) -> DataFrame:
    """`attempts` (a request's columns with error_kind and error_message) with `outcome` and the request's next state.

    ok and skipped: handled. throttled: to the front, nothing counted. critical: the crawl stops. retry: to the end with
    one more retry and its message. failed: handled with its message. Session errors retire the session either way.
    """
    k = F.col("error_kind")
    attempts = attempts.withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))
    again = retries(k, F.col("no_retry"), F.col("retry_count"), F.col("max_retries"), default_retries)
    outcome = F.when(k.isNull(), "ok").when(k.isin("skipped", "throttled", "critical"), k).when(again, "retry").otherwise("failed")
    x = attempts.withColumn("outcome", outcome)
    bad = F.col("outcome").isin("retry", "failed")
    return (
        x.withColumn("retry_count", F.col("retry_count") + F.when(F.col("outcome") == "retry", 1).otherwise(0))
        .withColumn("error_messages", F.when(bad, F.array_append(F.coalesce("error_messages", F.array().cast("array<string>")), F.col("error_message"))).otherwise(F.col("error_messages")))
        .withColumn("next", F.when(F.col("outcome").isin("ok", "skipped", "failed"), "handled").when(F.col("outcome") == "throttled", "front").when(F.col("outcome") == "retry", "end").otherwise("stop"))
        .withColumn("retire_session", F.coalesce(k == "session", F.lit(False)))
    )


def route(requests: DataFrame, labels: Sequence[str], default: bool = True) -> DataFrame:
    """`requests` with `route`, the label of the handler; 'default' for the others, or a critical error without one."""
    known = F.col("label").isin(*labels) if labels else F.lit(False)
    out = requests.withColumn("route", F.when(F.coalesce(known, F.lit(False)), F.col("label")).otherwise(F.lit("default" if default else None).cast("string")))
    return out if default else out.withColumn("error_kind", F.when(F.col("route").isNull(), "critical"))
