"""The request queue as a DataFrame: set semantics by id, order by a signed number.

A queue has the columns of a request, `order_no` (null: handled; negative: put in front) and `in_progress`. Operations give
the next queue; nothing is updated in place. Where one id may come with a third of all rows (a link on every page), the
copies are first reduced by a partial aggregation over narrow columns, and only winners are joined with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlnet.session import written


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest `order` of each key; `order` is unique. No group is sorted or collected."""
    first = rows.groupBy(key).agg(F.min(order).alias(order))
    return rows.join(first.select(order), order, "left_semi")


def add_batch(queue: DataFrame, new: DataFrame, forefront: bool = False, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(queue, report): requests that the queue doesn't have are added in the order of `pos` (a unique number).

    Of a key that comes twice the first counts. The report has a row for each row of `new`: unique_key, request_id,
    was_already_present (also for later copies in the batch), was_already_handled. A request that has `handled_at` comes in
    as handled. Rows whose id isn't the key's are rejected before (see requests.build_requests).
    """
    known = queue.select("id", F.col("order_no").isNull().alias("_handled"))
    keep = [c for c in queue.columns if c in new.columns]
    first = first_of_each(new, "id", pos)
    fresh = first.join(known.select("id"), "id", "left_anti")
    fresh = written(fresh.select(*dict.fromkeys([*keep, pos])), "fresh")
    base = queue.agg(F.coalesce(F.max(F.abs("order_no")), F.lit(0)).alias("_base"))
    numbered = with_row_numbers(fresh, pos, "_n").crossJoin(F.broadcast(base))  # one row
    number = (F.col("_base") + F.col("_n")) * (-1 if forefront else 1)
    done = F.col("handled_at").isNotNull() if "handled_at" in keep else F.lit(False)
    rows = numbered.withColumn("order_no", F.when(~done, number)).withColumn("in_progress", F.lit(False))
    for c, kind in queue.dtypes:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    firsts = first.select(F.col(pos).alias("_first_pos"))
    report = (
        new.select("unique_key", F.col("id").alias("request_id"), pos)
        .join(known.withColumnRenamed("id", "request_id"), "request_id", "left")
        .join(firsts, F.col(pos) == F.col("_first_pos"), "left")
        .select(
            "unique_key", "request_id",
            (F.col("_handled").isNotNull() | F.col("_first_pos").isNull()).alias("was_already_present"), F.coalesce("_handled", F.lit(False)).alias("was_already_handled"),
        )
    )
    return queue.unionByName(rows.select(*queue.columns)), report


def with_row_numbers(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of a unique column, without one task that sorts all rows.

    Rows are range-partitioned and sorted; each partition's numbers begin after the counts of those before it.
    """
    spread = written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = spread.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return spread.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def fetch_next(queue: DataFrame, n: int, *ties: str) -> DataFrame:
    """The next `n` requests, first by order number, then by `ties` where numbers aren't unique: a top-k."""
    return queue.where("order_no is not null and not in_progress").orderBy("order_no", *ties).limit(n)


def lookup(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue's requests with an id of `ids` (id); ids it doesn't have give no row."""
    return queue.join(ids.select("id").distinct(), "id", "left_semi")


def mark_in_progress(queue: DataFrame, batch: DataFrame) -> DataFrame:
    ids = batch.select("id", F.lit(True).alias("_mine"))
    return queue.join(ids, "id", "left").withColumn("in_progress", F.coalesce("_mine", "in_progress")).drop("_mine").select(*queue.columns)


def mark_handled(queue: DataFrame, done: DataFrame, at: Column | None = None) -> DataFrame:
    """Requests of `done` (id) become handled; unknown and handled ones stay as they are."""
    ids = done.select("id").distinct().withColumn("_mine", F.lit(True))
    mine = F.col("_mine").isNotNull() & F.col("order_no").isNotNull()
    out = queue.join(ids, "id", "left").withColumn("handled_at", F.when(mine, F.coalesce("handled_at", at if at is not None else F.current_timestamp())).otherwise(F.col("handled_at")))
    return out.withColumn("order_no", F.when(~mine, F.col("order_no"))).withColumn("in_progress", F.when(mine, False).otherwise(F.col("in_progress"))).select(*queue.columns)


def reclaim(queue: DataFrame, back: DataFrame, pos: str = "pos") -> DataFrame:
    """Requests of `back` (id, forefront, a unique pos) get a new number at the end, or in front; handled ones stay."""
    base = queue.agg(F.coalesce(F.max(F.abs("order_no")), F.lit(0)).alias("_base"))
    ids = with_row_numbers(first_of_each(back, "id", pos).select("id", "forefront", pos), pos, "_n").drop(pos)
    out = queue.join(ids, "id", "left").crossJoin(F.broadcast(base))  # one row
    mine = F.col("_n").isNotNull() & F.col("order_no").isNotNull()
    out = out.withColumn("order_no", F.when(mine, (F.col("_base") + F.col("_n")) * F.when(F.col("forefront"), -1).otherwise(1)).otherwise(F.col("order_no")))
    return out.withColumn("in_progress", F.when(mine, False).otherwise(F.col("in_progress"))).select(*queue.columns)


def counts(queue: DataFrame) -> DataFrame:
    """(total, handled, pending); what is in progress is pending."""
    return queue.agg(F.count("*").alias("total"), F.count_if(F.col("order_no").isNull()).alias("handled"), F.count_if(F.col("order_no").isNotNull()).alias("pending"))


def is_empty(queue: DataFrame) -> bool:
    return queue.where("order_no is not null and not in_progress").isEmpty()


def is_finished(queue: DataFrame) -> bool:
    return queue.where("order_no is not null").isEmpty()


def restart(queue: DataFrame) -> DataFrame:
    """The queue after a stop: what was in progress is fetched again."""
    return queue.withColumn("in_progress", F.lit(False))


def tandem(loader: DataFrame, queue: DataFrame, pos: str = "pos") -> DataFrame:
    """The queue with a loader's requests moved to its front."""
    return add_batch(queue, loader, forefront=True, pos=pos)[0]


def loader_status(loader: DataFrame) -> DataFrame:
    """(status, handled, pending) of a loader's rows with `state` (queued, in_progress, handled) and a `loading` flag."""
    c = loader.agg(F.count_if(F.col("state") == "handled").alias("handled"), F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(F.col("state") == "in_progress").alias("busy"), F.coalesce(F.bool_or("loading"), F.lit(False)).alias("loading"))
    status = F.when(F.col("queued") > 0, "ready").when((F.col("busy") > 0) | F.col("loading"), "waiting").otherwise("finished")
    return c.select(status.alias("status"), "handled", (F.col("queued") + F.col("busy")).alias("pending"))
