"""Session settings, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "trawlnet", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the engine expects; `conf` overrides."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table of the input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is `spark.checkpoint.dir` of the session. Where that is unset a temporary folder is used, which is only right
    in local mode (tests); on a cluster without the setting this raises instead of writing to a machine's own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = os.environ.get("TRAWLNET_LOCAL_SHARED") or tempfile.mkdtemp(prefix="trawlnet-")
    os.environ["TRAWLNET_LOCAL_SHARED"] = at
    return f"file://{at}"


_roots: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. All paths of an application are removed when its driver ends."""
    root = f"{shared_dir(spark)}/trawlnet/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        path, conf = spark._jvm.org.apache.hadoop.fs.Path(root), spark._jsc.hadoopConfiguration()
        atexit.register(_remove, path, conf)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(path: object, conf: object) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may have ended before
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage is cut, and losing an executor loses nothing."""
    spark = df.sparkSession
    at = fresh_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores before work in Python, where they come from fewer files than there are cores; no shuffle else.

    For plans without an exchange, as asking an adaptive plan with one for its partitions would run it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
