"""Building requests and their stored JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.keys import request_id, unique_key
from trawlnet.functions.urls import normalized_url

#: The member of user data that holds the engine's own fields; a parameter, as stores differ in its name.
BAG = "__engine"
#: The fields in it, by column.
BAG_FIELDS = {"skip_navigation": "skipNavigation", "max_retries": "maxRetries", "crawl_depth": "crawlDepth", "session_id": "sessionId", "enqueue_strategy": "enqueueStrategy"}


def _or(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def build_requests(rows: DataFrame) -> DataFrame:
    """Requests from rows with `url` and any of the other fields; `error` says why a row is none.

    An empty URL, a body on GET, and a key given together with `always_unique` are errors. A given key holds; else it's
    computed. The method is upper case, GET by default; missing lists and counts are empty.
    """
    df = rows
    method = F.upper(F.coalesce(_or(df, "method", "string"), F.lit("GET")))
    payload, given = _or(df, "payload", "string"), _or(df, "unique_key", "string")
    always = F.coalesce(_or(df, "always_unique", "boolean"), F.lit(False))
    extended = F.coalesce(_or(df, "extended_key", "boolean"), F.lit(False))
    error = (
        F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "the URL is empty")
        .when((method == "GET") & (F.coalesce(F.length(payload), F.lit(0)) > 0), "GET can't have a body")
        .when(always & given.isNotNull(), "a key can't be given and random")
    )
    key = F.coalesce(given, unique_key(F.col("url"), normalized_url(F.col("url"), F.coalesce(_or(df, "keep_fragment", "boolean"), F.lit(False))), method, payload, extended, F.lit(False)))
    key = F.when(always & given.isNull(), F.concat(F.randstr(17), F.lit("|"), key)).otherwise(key)
    made = df.withColumn("unique_key", key)
    return made.select(
        request_id(F.col("unique_key")).alias("id"), "url", "unique_key", method.alias("method"), payload.alias("payload"),
        F.coalesce(_or(df, "headers", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("headers"),
        F.coalesce(_or(df, "user_data", "string"), F.lit("{}")).alias("user_data"), _or(df, "label", "string").alias("label"),
        _or(df, "skip_navigation", "boolean").alias("skip_navigation"), _or(df, "crawl_depth", "int").alias("crawl_depth"),
        _or(df, "session_id", "string").alias("session_id"), _or(df, "max_retries", "int").alias("max_retries"),
        _or(df, "enqueue_strategy", "string").alias("enqueue_strategy"), F.coalesce(_or(df, "no_retry", "boolean"), F.lit(False)).alias("no_retry"),
        F.coalesce(_or(df, "retry_count", "int"), F.lit(0)).alias("retry_count"),
        F.coalesce(_or(df, "error_messages", "array<string>"), F.array().cast("array<string>")).alias("error_messages"),
        _or(df, "loaded_url", "string").alias("loaded_url"), _or(df, "handled_at", "timestamp").alias("handled_at"), error.alias("error"),
    )


def _members(fields: list[Column]) -> Column:
    """`"name":value` members joined; null ones are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _text(name: str, c: Column) -> Column:
    """A member with a JSON string; to_json of a struct, without its braces, gives the escapes."""
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.struct(c.alias(name))), r"^\{|\}$", ""))


def to_wire(requests: DataFrame, bag: str = BAG) -> DataFrame:
    """(id, json): the stored form. Members without a value are left out, the engine's own fields lie in user data's bag."""
    own = _members([F.when(F.col(c).isNotNull(), F.regexp_replace(F.to_json(F.struct(F.col(c).alias(n))), r"^\{|\}$", "")) for c, n in BAG_FIELDS.items()])
    data = F.coalesce(F.nullif(F.trim("user_data"), F.lit("")), F.lit("{}"))
    label = F.when(F.col("label").isNotNull() & F.get_json_object(data, "$.label").isNull(), _text("label", F.col("label")))
    inside = F.nullif(F.regexp_replace(data, r"^\s*\{\s*|\s*\}\s*$", ""), F.lit(""))
    user = _members([inside, label, F.when(own != "{}", F.concat(F.lit(f'"{bag}":'), own))])
    fields = [
        _text("id", F.col("id")), _text("url", F.col("url")), _text("uniqueKey", F.col("unique_key")), _text("method", F.col("method")), _text("payload", F.col("payload")),
        _text("noRetry", F.col("no_retry")), _text("retryCount", F.col("retry_count")), F.concat(F.lit('"errorMessages":'), F.to_json("error_messages")),
        F.concat(F.lit('"headers":'), F.to_json("headers")), F.concat(F.lit('"userData":'), user), _text("loadedUrl", F.col("loaded_url")),
        _text("handledAt", F.date_format("handled_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
    ]
    return requests.select("id", _members(fields).alias("json"))


_WIRE = (
    "id string, url string, uniqueKey string, method string, payload string, noRetry boolean, retryCount int, errorMessages array<string>, "
    "headers map<string,string>, loadedUrl string, handledAt string"
)


def from_wire(rows: DataFrame, json_col: str = "json", bag: str = BAG) -> DataFrame:
    """Requests from their stored form; missing and null members have their defaults, the method is upper case."""
    j = F.from_json(json_col, _WIRE)
    data = F.coalesce(F.get_json_object(json_col, "$.userData"), F.lit("{}"))
    kinds = {"skip_navigation": "boolean", "max_retries": "int", "crawl_depth": "int", "session_id": "string", "enqueue_strategy": "string"}
    parsed = rows.select(j.alias("j"), data.alias("user_data"))
    key = F.coalesce("j.uniqueKey", "j.url")
    return parsed.select(
        F.coalesce("j.id", request_id(key)).alias("id"), "j.url", key.alias("unique_key"), F.upper(F.coalesce("j.method", F.lit("GET"))).alias("method"), "j.payload",
        F.coalesce("j.headers", F.create_map().cast("map<string,string>")).alias("headers"), "user_data", F.get_json_object("user_data", "$.label").alias("label"),
        *[F.get_json_object("user_data", f"$.{bag}.{n}").cast(kinds[c]).alias(c) for c, n in BAG_FIELDS.items()],
        F.coalesce("j.noRetry", F.lit(False)).alias("no_retry"), F.coalesce("j.retryCount", F.lit(0)).alias("retry_count"),
        F.coalesce("j.errorMessages", F.array().cast("array<string>")).alias("error_messages"), F.col("j.loadedUrl").alias("loaded_url"),
        F.try_to_timestamp("j.handledAt").alias("handled_at"),
    )
