"""The folds of pacing and sessions over streams, with state kept by key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trawlnet.operators.pacing import BACKOFF, BACKOFF_STATE, SESSION, Backoff, Session, _fold, backoff_fold


#: Rows that are given on at once.
_ROWS = 10_000


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str], by: list[str]) -> Iterator[pd.DataFrame]:
    """A key's signals of one batch in order, however many frames they came in. They're held in narrow columns until all
    are there, so a batch (maxFilesPerTrigger, maxBytesPerTrigger) bounds the memory; batches without that bound are folded
    by `backoff_batches`."""
    own = pd.concat([f[list(dict.fromkeys([*by, *columns]))] for f in frames], ignore_index=True)
    own = own.assign(**{c: own[c].astype("category") for c in ("kind", "outcome") if c in own}).sort_values(by, kind="stable", ignore_index=True)[columns]
    for k in range(0, len(own), _ROWS):
        yield own.iloc[k : k + _ROWS]


def _backoff(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    b = Backoff(*state.get) if state.exists else Backoff()
    for f in _in_order(frames, ["at_ms", "kind", "wait_ms", "interval_ms"], ["at_ms", "seq"]):
        rows = []
        for at, kind, wait, interval in f.itertuples(index=False):
            done = _fold(b, kind, int(at), None if pd.isna(wait) else int(wait), None if pd.isna(interval) else int(interval))
            rows.append((key[0], int(at), kind, done, b.n, b.until, b.next_fetch))
        yield pd.DataFrame(rows, columns=["domain", "at_ms", "kind", "applied", "n", "until_ms", "next_fetch_ms"])
    state.update((b.until, b.decays, b.n, b.interval, b.next_fetch))


def backoff_stream(signals: DataFrame) -> DataFrame:
    """As pacing.backoff_states, for a stream of signals; a batch's signals of a domain are taken in order of time."""
    return signals.groupBy("domain").applyInPandasWithState(_backoff, BACKOFF, "until bigint, decays bigint, n int, gap bigint, next_fetch bigint", "append", GroupStateTimeout.NoTimeout)


def backoff_batches(signals: DataFrame, target: str, checkpoint: str) -> Any:
    """backoff_stream() for batches in which a domain may have any number of signals: each batch is sorted by Spark and folded
    in constant memory. Results lie in target/results/batch=n, states in target/states/batch=n; a batch that runs again
    replaces both."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(BACKOFF_STATE).parquet(f"{target}/states/batch={number - 1}") if number else None
        both = backoff_fold(batch, before)
        both.write.mode("overwrite").parquet(f"{target}/folded/batch={number}")
        both = spark.read.parquet(f"{target}/folded/batch={number}")
        both.where("at_ms is not null").select(*[c.split()[0] for c in BACKOFF.split(", ")]).write.mode("overwrite").parquet(f"{target}/results/batch={number}")
        after = both.where("at_ms is null").select("domain", "state.*")
        if before is not None:
            after = after.unionByName(before.join(after.select("domain"), "domain", "left_anti"))
        after.write.mode("overwrite").parquet(f"{target}/states/batch={number}")

    return signals.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _session(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = Session(*state.get) if state.exists else Session()
    for f in _in_order(frames, ["outcome"], ["seq"]):
        for o in f["outcome"]:
            {"good": s.good, "bad": s.bad, "retire": s.retire}[o]()
    state.update((s.usage, s.score, s.retired))
    yield pd.DataFrame([(key[0], s.usage, s.score, s.retired, s.usable())], columns=["session_id", "usage", "score", "retired", "usable"])


def session_stream(outcomes: DataFrame) -> DataFrame:
    """The state of each session that a batch touches."""
    return outcomes.groupBy("session_id").applyInPandasWithState(_session, SESSION, "usage int, score double, retired boolean", "update", GroupStateTimeout.NoTimeout)


def statistics_stream(attempts: DataFrame, watermark: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Attempts by minute and outcome; attempts later than the watermark are left out."""
    return (
        attempts.withWatermark("started_at", watermark)
        .groupBy(F.window("started_at", every), "outcome")
        .agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"))
        .select(F.col("window.start").alias("minute"), "outcome", "n", "duration_ms")
    )


def start(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> Any:
    """Writes a stream's batches to a table, once each."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target)
