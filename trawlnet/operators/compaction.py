"""Many small files into few large ones, each record once (problem 3).

A checkpointed streaming compactor: the file source finds each stored file once and keeps that in the query's checkpoint;
what is there is processed in batches, and each batch is written under its batch number with overwrite, so a batch that
runs again replaces its files. Within a batch the delivery with the lowest row number stays; a record that an earlier
batch has written isn't written again.

Only keys are shuffled to find what stays (with partial aggregation, so a record delivered over and over costs nothing);
whole rows are then joined by their unique row number, which has no skew, in as many partitions as files are written, so
rows are shuffled once and no task reads more than a file takes. Later batches read the keys of those before, not their rows. Rows with a null key aren't records and are left
out. Empty inputs give an empty table. Columns of any name go through unchanged, save `batch`, which the target reserves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.session import fresh_path

TARGET_BYTES = 128 << 20
#: Files are at least this large before their number is raised to four for each core.
LEAST_BYTES = 4 << 20


def _key(keys: list[str]) -> list:
    return [F.col(k) for k in keys]


def compact(
    spark: SparkSession,
    source: str,
    keys: list[str],
    row_id: str,
    target: str | None = None,
    checkpoint: str | None = None,
    files_per_batch: int | None = None,
    target_bytes: int = TARGET_BYTES,
) -> str:
    """Compacts what lies at `source` and wasn't compacted yet; gives the target's path. Call it again for new files."""
    target = target or fresh_path(spark, "compacted")
    checkpoint = checkpoint or f"{target}-checkpoint"
    schema = spark.read.parquet(source).schema
    if "batch" in schema.names:
        raise ValueError("the source has a column `batch`, which the target uses for its own")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    glob = f"{source[:-1]}[{source[-1]}]"  # as a pattern the path may be a folder or a single file
    stream = reader.parquet(glob).where(" and ".join(f"`{k}` is not null" for k in keys))
    stream = stream.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    cores = spark.sparkContext.defaultParallelism

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        size = batch.groupBy("_file").agg(F.max("_size").alias("_size")).agg(F.sum("_size")).first()[0] or 0
        files = max(1, math.ceil(size / target_bytes), min(4 * cores, math.ceil(size / LEAST_BYTES)))
        rows = batch.drop("_file", "_size")
        stays = rows.groupBy(*_key(keys)).agg(F.min(row_id).alias(row_id))
        if number:
            before = own.read.parquet(target).where(F.col("batch") < number).select(*keys)
            stays = stays.join(before, keys, "left_anti")
        # Both sides are cut into the files' partitions by the join's key: the join needs no other exchange, the write none.
        kept = rows.repartition(files, row_id).join(stays.select(row_id).repartition(files, row_id).hint("merge"), row_id, "left_semi").select(*schema.names)
        kept.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return target


def compacted(spark: SparkSession, source: str, keys: list[str], row_id: str, **options: object) -> DataFrame:
    """The compacted table: each record of `source` once, in few files."""
    target = compact(spark, source, keys, row_id, **options)
    schema = spark.read.parquet(source).schema
    try:
        return spark.read.schema(schema).option("basePath", target).parquet(target)
    except Exception as e:  # no file was there to compact
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def storage_counts(spark: SparkSession, requests: str, dataset_items: str, **options: object) -> DataFrame:
    """(kind, id, n_records): the records of each queue and dataset, from their compacted tables."""
    queues = compacted(spark, requests, ["queue_id", "id"], "row_id", **options).groupBy("queue_id").agg(F.count("*").alias("n_records"))
    sets = compacted(spark, dataset_items, ["dataset_id", "seq"], "row_id", **options).groupBy("dataset_id").agg(F.count("*").alias("n_records"))
    return queues.select(F.lit("queue").alias("kind"), F.col("queue_id").alias("id"), "n_records").unionByName(
        sets.select(F.lit("dataset").alias("kind"), F.col("dataset_id").alias("id"), "n_records")
    )


def miscounted(storages: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, id): storages whose recorded count isn't the number of their records; a missing count is none."""
    recorded = F.when(F.col("kind") == "queue", F.col("total_request_count")).otherwise(F.col("item_count"))
    known = storages.where("kind in ('queue', 'dataset')").select("kind", "id", recorded.alias("recorded"))
    both = known.join(counts, ["kind", "id"], "left")
    return both.where(~F.col("recorded").eqNullSafe(F.coalesce("n_records", F.lit(0).cast("bigint")))).select("kind", "id")
