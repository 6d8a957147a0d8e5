"""Small text functions: numbers as scripts read them, retry hints, error groups, stored JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|Infinity)")


def js_number(text: str) -> float | None:
    """The number a text is in a script: empty is 0, 0x, 0o and 0b count, other texts are none."""
    t = text.strip()
    if not t:
        return 0.0
    if m := re.fullmatch(r"0([xXoObB])([0-9a-fA-F]+)", t):
        try:
            return float(int(m[2], {"x": 16, "o": 8, "b": 2}[m[1].lower()]))
        except ValueError:
            return None
        except OverflowError:
            return float("inf")
    return float(t.replace("Infinity", "inf")) if _NUMBER.fullmatch(t) else None


def js_number_column(c: Column) -> Column:
    """js_number() without octal and binary, native."""
    t = F.trim(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(t == "", 0.0)
        .when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 100), 16, 10).cast("double"))
        .when(t.rlike(r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)$"), t.cast("double"))
        .when(t.rlike(r"^\+?Infinity$"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
    )


_SECONDS, _LONG = 1 << 64, (1 << 63) - 1


def retry_after_ms(value: str | None, now_ms: int) -> int | None:
    """Milliseconds a Retry-After value asks to wait: whole seconds above 0 (of 64 bits, else it's no value), or a date in
    the future."""
    if value is None:
        return None
    t = value.strip()
    if re.fullmatch(r"[0-9]+", t):
        seconds = int(t) if len(t) < 40 else _SECONDS
        return min(seconds * 1000, _LONG) or None if seconds < _SECONDS else None
    try:
        at = parsedate_to_datetime(t)
    except (ValueError, TypeError, IndexError):
        try:
            at = datetime.fromisoformat(t) if "T" in t.upper() else None
        except ValueError:
            at = None
    if at is None:
        return None
    try:
        wait = int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000) - now_ms
    except (OverflowError, ValueError, OSError):  # a zone that leads out of the calendar
        return None
    return wait if wait > 0 else None


@F.pandas_udf(T.LongType())
def retry_after(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """retry_after(value, now in ms): the milliseconds to wait, or null."""
    for values, nows in parts:
        yield pd.Series([retry_after_ms(v if isinstance(v, str) else None, int(n)) for v, n in zip(values, nows)], dtype="Int64")


def error_group(message: Column) -> Column:
    """What errors are grouped by: the first 200 characters of the first line with digits masked."""
    return F.regexp_replace(F.substring(F.substring_index(message, "\n", 1), 1, 200), "[0-9]+", "_")


def _number(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    m = re.fullmatch(r"(-?[\d.]+?)(?:\.0)?e([+-])0*(\d+)", repr(x))
    return f"{m[1]}e{m[2]}{m[3]}" if m else repr(x)


def compact_json(text: str) -> str:
    """JSON in one line, numbers as scripts write them."""

    def write(v: object) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(x)}" for k, x in v.items()) + "}"
        if isinstance(v, list):
            return f"[{','.join(map(write, v))}]"
        return _number(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)

    return write(json.loads(text))


def pretty_json(text: str) -> str:
    """JSON in the form records are stored in: two spaces, letters as they are, numbers as scripts write them."""

    def write(v: object, pad: str) -> str:
        inner = pad + "  "
        if isinstance(v, dict):
            return "{" + ",".join(f"\n{inner}{json.dumps(k, ensure_ascii=False)}: {write(x, inner)}" for k, x in v.items()) + (f"\n{pad}}}" if v else "}")
        if isinstance(v, list):
            return "[" + ",".join(f"\n{inner}{write(x, inner)}" for x in v) + (f"\n{pad}]" if v else "]")
        return _number(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)

    return write(json.loads(text), "")


@F.pandas_udf(T.StringType())
def pretty(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Pretty JSON; null for what is no JSON."""
    for s in parts:
        out = []
        for x in s:
            try:
                out.append(pretty_json(x) if isinstance(x, str) else None)
            except ValueError:
                out.append(None)
        yield pd.Series(out, dtype=object)
