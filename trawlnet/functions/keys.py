"""Request keys and ids, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(text: Column, length: int) -> Column:
    """The first letters and digits of the text's SHA-256 in base 64."""
    return F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(text, 256))), "[+/=\r\n]", ""), 1, length)


def payload_hash(payload: Column) -> Column:
    return F.coalesce(_digest(F.nullif(payload, F.lit("")), 8), F.lit(""))


def request_id(unique_key: Column) -> Column:
    return _digest(unique_key, 15)


def unique_key(url: Column, normalized: Column, method: Column, payload: Column, extended: Column | bool = False, always: Column | bool = False) -> Column:
    """What a request is told apart by: its normalized URL, or the text itself if it's no URL; extended, with method and
    payload hash in front; `always` puts 17 random characters in front (not deterministic)."""
    extended, always = (x if isinstance(x, Column) else F.lit(x) for x in (extended, always))
    plain = F.coalesce(normalized, url)
    full = F.concat_ws("|", F.upper(F.coalesce(method, F.lit("GET"))), payload_hash(payload), plain)
    key = F.when(extended, full).otherwise(plain)
    return F.when(always, F.concat(F.randstr(17), F.lit("|"), key)).otherwise(key)
