"""Records that differ only in how they are written (problem 1).

A record's canonical form holds the words and numbers of its fields in order: letter case, white space and punctuation
are gone, percent-escapes and plus signs are decoded, query parameters and JSON members are sorted. Equal records are
found without hashing groups together: canonical records are range-partitioned and sorted, each sorted partition is
scanned once for runs of equal neighbours (comparing full keys), and the runs at partition borders are joined up from one
summary row per partition. A group of copies of any size is therefore spread over as many tasks as its share of the rows.

Defined results: null and empty fields hold no words and are alike; malformed escapes stand for themselves; a payload
that's neither JSON nor a form is read as plain text; rows with a null id are kept apart from copies (they can't be named
and are left out). Empty tables give empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.session import shuffle_partitions, written

NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
_NOT_WORD = regex.compile(NOT_WORD)
_FORM = re.compile(r"[^=&\s]+=[^&]*(?:&[^=&\s]+=[^&]*)*&*")


def words(c: Column) -> Column:
    """The words of a text, decoded and in one letter case, with single spaces between."""
    escaped = F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))
    plain = F.when(c.contains("%"), F.coalesce(escaped, c)).otherwise(c)
    return F.trim(F.regexp_replace(F.lower(F.upper(plain)), NOT_WORD, " "))


def url_words(c: Column) -> Column:
    """The words of a URL with its query parameters in sorted order."""
    head = F.substring_index(c, "#", 1)
    path = F.substring_index(head, "?", 1)
    query = F.substring(head, F.length(path) + 2, F.length(head))
    fragment = F.substring(c, F.length(head) + 2, F.length(c))
    params = F.array_sort(F.filter(F.transform(F.split(query, "&"), words), lambda w: w != ""))
    return F.when(
        c.contains("?") | c.contains("#"), F.trim(F.concat_ws(" ", words(path), F.array_join(params, " "), words(fragment)))
    ).otherwise(words(c))


def _words(text: str) -> str:
    return _NOT_WORD.sub(" ", unquote_plus(text).upper().lower()).strip()


def _json_words(value: object) -> str:
    if isinstance(value, _Members):
        return " ".join(sorted(f"{_words(k)} {_json_words(v)}".strip() for k, v in value.pairs))
    if isinstance(value, list):
        return " ".join(_json_words(v) for v in value)
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return _words(str(value))


class _Members:
    def __init__(self, pairs: list) -> None:
        self.pairs = pairs


def payload_words(text: str | None) -> str:
    """The words of a request body: JSON members and form fields in sorted order, other text as it is."""
    if not text:
        return ""
    if text.lstrip()[:1] in ("{", "["):
        try:
            return _json_words(json.loads(text, object_pairs_hook=_Members, parse_int=str, parse_float=str, parse_constant=str))
        except (ValueError, RecursionError):
            pass
    if _FORM.fullmatch(text.strip()):
        return " ".join(sorted(w for p in text.split("&") if (w := _words(p))))
    return _words(text)


@F.pandas_udf(T.StringType())
def _payload_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield pd.Series([payload_words(x) if isinstance(x, str) else "" for x in s])


def key_of(*fields: Column) -> Column:
    """Fields' words as one key; a separator that no word holds keeps the fields apart."""
    return F.concat_ws("\u0001", *[F.coalesce(f, F.lit("")) for f in fields])


def request_records(requests: DataFrame) -> DataFrame:
    return requests.select(
        F.lit("requests").alias("src"),
        F.col("row_id").alias("id"),
        key_of(words(F.col("method")), url_words(F.col("url")), _payload_words("payload")).alias("key"),
    )


def normalize_url_records(cases: DataFrame) -> DataFrame:
    return cases.select(
        F.lit("normalize_url").alias("src"),
        F.col("case_id").alias("id"),
        key_of(url_words(F.col("input")), F.col("keep_fragment").cast("string"), url_words(F.col("expected"))).alias("key"),
    )


_SCAN = pa.schema(
    [
        ("kind", pa.int8()),  # 0: a copy, 1: a run, 2: summary of a partition
        ("src", pa.string()),
        ("first_id", pa.int64()),
        ("copy_id", pa.int64()),
        ("n", pa.int64()),
        ("pid", pa.int32()),
        ("open", pa.bool_()),  # its run may go on in a neighbouring partition
        ("head", pa.string()),  # summary: key of the first run
        ("tail", pa.string()),  # summary: key of the last run
        ("single", pa.bool_()),  # summary: the partition is one run
    ]
)
_SCAN_DDL = (
    "kind tinyint, src string, first_id bigint, copy_id bigint, n bigint, pid int, open boolean, head string, tail string, single boolean"
)


def _rows(kind: int, length: int, /, **columns: object) -> pa.RecordBatch:
    out = []
    for f in _SCAN:
        v = kind if f.name == "kind" else columns.get(f.name)
        out.append(v if isinstance(v, pa.Array) else pa.array(v, f.type) if isinstance(v, (np.ndarray, list)) else pa.array([v] * length, f.type))
    return pa.RecordBatch.from_arrays(out, schema=_SCAN)


def _scanner(copies: bool, runs: bool):
    """Scans a sorted partition for runs of equal keys; holds one batch and one open run at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        head = key = src = None  # of the first run; of the run that's open
        first, size, is_first_run = None, 0, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            full, srcs, ids = b.column("full"), b.column("src"), b.column("id").to_numpy()
            starts = np.ones(n, bool)
            starts[1:] = pc.not_equal(full.slice(1), full.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts[0] = key is None or full[0].as_py() != key
            at = np.flatnonzero(starts)
            if head is None:
                head = full[0].as_py()
            run_of = np.cumsum(starts) - 1  # -1: the run carried over from the batch before
            run_ids = ids[at]
            firsts = np.where(run_of < 0, first if first is not None else 0, run_ids[np.maximum(run_of, 0)] if len(at) else 0)
            # Rows of the partition's first run may belong to a run that began in an earlier partition.
            early = (run_of < 0) if key is not None else (run_of == 0)
            if not is_first_run:
                early = np.zeros(n, bool)
            if copies:
                pick = ~starts | early
                if pick.any():
                    take = pa.array(np.flatnonzero(pick))
                    yield _rows(0, int(pick.sum()), src=srcs.take(take), first_id=firsts[pick], copy_id=ids[pick], pid=pid, open=pa.array(early[pick]))
            if runs:
                ends = np.append(at[1:], n)
                lengths = ends - at
                if key is not None:  # what the open run gains from this batch
                    size += int(at[0]) if len(at) else n
                if len(at):
                    if key is not None:
                        yield _rows(1, 1, src=src, first_id=[first], n=[size], pid=pid, open=is_first_run)
                    shut = len(at) - 1
                    if shut:
                        flags = np.zeros(shut, bool)
                        flags[0] = key is None
                        yield _rows(1, shut, src=srcs.take(pa.array(at[:-1])), first_id=run_ids[:-1], n=lengths[:-1].astype("int64"), pid=pid, open=pa.array(flags))
                    size = int(lengths[-1])
            if len(at):
                if key is not None or len(at) > 1:
                    is_first_run = False
                first = int(run_ids[-1])
                src = srcs[int(at[-1])].as_py()
            key = full[n - 1].as_py()
        if key is not None:
            if runs:
                yield _rows(1, 1, src=src, first_id=[first], n=[size], pid=pid, open=True)
            yield _rows(2, 1, src=src, first_id=[first], pid=pid, open=True, head=head, tail=key, single=is_first_run)

    return scan


def _scanned(records: DataFrame, partitions: int | None, copies: bool, runs: bool) -> tuple[DataFrame, DataFrame]:
    """The scan's rows, and for each partition the id that its first run began with in an earlier one, if it did."""
    n = partitions or shuffle_partitions(records.sparkSession)
    full = F.concat_ws("\u0001", "src", "key")
    keyed = records.where("id is not null").select(F.xxhash64(full).alias("h"), full.alias("full"), "src", "id")
    # The hash in front makes comparisons cheap and ranges even; the id behind splits a group that's larger than a partition.
    ordered = keyed.repartitionByRange(n, "h", "full", "id").sortWithinPartitions("h", "full", "id").select("full", "src", "id")
    rows = written(ordered.mapInArrow(_scanner(copies, runs), _SCAN_DDL), "runs")
    order = Window.orderBy("pid")  # one row for each partition of the shuffle, never more
    goes_on = F.col("head") == F.lag("tail").over(order)
    began = F.when(~F.col("single") | ~F.coalesce(goes_on, F.lit(False)), F.col("first_id"))
    borders = (
        rows.where("kind = 2")
        .select("pid", "head", "tail", "single", "first_id")
        .select("pid", F.coalesce(goes_on, F.lit(False)).alias("goes_on"), began.alias("began"))
        .select("pid", "goes_on", F.last("began", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("origin"))
        .where("goes_on")
        .select("pid", "origin")
    )
    return rows, borders


def copies(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(src, first_id, copy_id): a row for each record that's a copy of one with a smaller id."""
    rows, borders = _scanned(records, partitions, copies=True, runs=False)
    sure = rows.where("kind = 0 and not open").select("src", "first_id", "copy_id")
    early = rows.where("kind = 0 and open").join(F.broadcast(borders), "pid", "left")  # a row a partition at most
    early = early.select("src", F.coalesce("origin", "first_id").alias("first_id"), "copy_id").where("first_id <> copy_id")
    return sure.unionByName(early)


def representatives(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(src, first_id, n_copies): one row for each group of equal records, with how many records it has."""
    rows, borders = _scanned(records, partitions, copies=False, runs=True)
    runs = rows.where("kind = 1").select("src", "first_id", "n", "pid", "open")
    sure = runs.where("not open").select("src", "first_id", F.col("n").alias("n_copies"))
    starts = rows.where("kind = 2").select("pid", F.col("first_id").alias("last_first"), "single")
    edge = runs.where("open").join(F.broadcast(borders), "pid", "left").join(F.broadcast(starts), "pid")
    # Of a partition's two open runs only the first can go on from before; a lone run is both.
    edge = edge.withColumn("is_head", F.col("single") | (F.col("first_id") != F.col("last_first")))
    edge = edge.withColumn("first_id", F.when(F.col("is_head"), F.coalesce("origin", "first_id")).otherwise(F.col("first_id")))
    return sure.unionByName(edge.groupBy("src", "first_id").agg(F.sum("n").alias("n_copies")))
