"""Datasets, key-value stores and the catalog of storages."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.text import compact_json, pretty_json
from trawlnet.operators.frontier import with_row_numbers
from trawlnet.session import written

KEY = r"^[A-Za-z0-9!\-_.'()]{1,256}$"


# --- datasets ----------------------------------------------------------------------------------------------------------


def push_data(dataset: DataFrame, items: DataFrame, pos: str = "pos") -> DataFrame:
    """The dataset (seq, item) with JSON texts added in the order of `pos`: objects, or arrays of objects, which are
    flattened. Others raise when the result is read."""
    kind = F.get_json_object("item", "$")
    trimmed = F.trim("item")
    many = F.from_json(F.when(trimmed.startswith("["), trimmed), "array<string>")
    flat = items.select(pos, F.posexplode(F.when(trimmed.startswith("["), many).otherwise(F.array(trimmed))).alias("_i", "item"))
    bad = ~F.coalesce(F.trim("item").startswith("{"), F.lit(False)) | kind.isNull()
    checked = flat.withColumn("item", F.when(bad, F.raise_error(F.lit("only objects can be stored"))).otherwise(F.col("item")))
    base = dataset.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_base"))
    ordered = with_row_numbers(checked.withColumn("_order", F.struct(pos, "_i")), "_order", "_n").crossJoin(F.broadcast(base))  # one row
    return dataset.select("seq", "item").unionByName(ordered.select((F.col("_base") + F.col("_n")).alias("seq"), "item"))


def get_data(dataset: DataFrame, offset: int = 0, limit: int | None = None, desc: bool = False) -> DataFrame:
    """A page of the dataset in its order; `desc` turns the order around before the offset. A top-k with a limit."""
    out = dataset.orderBy(F.desc("seq") if desc else F.asc("seq"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def typed(dataset: DataFrame, schema: str) -> DataFrame:
    """Items read into columns; what isn't there is null."""
    return dataset.select("seq", F.from_json("item", schema).alias("_x")).select("seq", "_x.*")


def export(dataset: DataFrame, path: str) -> int:
    """Writes items to a .jsonl file, a line each, or as one pretty array to a .json file, by way of the driver's file system
    and row by row; folders that aren't there are made. Gives the number of items."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError("only .json and .jsonl can be written")
    n = 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    lines = path.endswith("l")
    with open(path, "w", encoding="utf-8") as f:
        f.write("" if lines else "[")
        for row in dataset.orderBy("seq").select("item").toLocalIterator():
            item = compact_json(row[0]) if lines else pretty_json(row[0]).replace("\n", "\n  ")
            f.write(f"{item}\n" if lines else f"{',' if n else ''}\n  {item}")
            n += 1
        f.write("" if lines else "\n]\n" if n else "]\n")
    return n


# --- key-value stores --------------------------------------------------------------------------------------------------


def valid_key(key: Column) -> Column:
    return key.rlike(KEY)


def current(records: DataFrame) -> DataFrame:
    """The last write of each key (key, value, content_type, seq, deleted) by seq; deleted keys are gone.

    The winner is found over narrow columns, so a key written over and over doesn't gather in one task.
    """
    last = records.groupBy("key").agg(F.max("seq").alias("seq"))
    return records.join(last, ["key", "seq"], "left_semi").where("not coalesce(deleted, false)")


def set_values(records: DataFrame, values: DataFrame, pos: str = "pos") -> DataFrame:
    """The records with writes (key, value, content_type) in the order of `pos`: the last of a key counts. A null value deletes
    the key; keys that aren't valid raise when the result is read."""
    checked = F.when(valid_key(F.col("key")), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("not a valid key: "), F.coalesce("key", F.lit("null")))).cast("string"))
    base = records.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_base"))
    new = with_row_numbers(values.select(pos, checked.alias("key"), "value", "content_type"), pos, "_n").crossJoin(F.broadcast(base))  # one row
    return records.select("key", "value", "content_type", "seq", "deleted").unionByName(
        new.select("key", "value", "content_type", (F.col("_base") + F.col("_n")).alias("seq"), F.col("value").isNull().alias("deleted"))
    )


def set_texts(records: DataFrame, texts: DataFrame, pos: str = "pos", content_type: str = "text/plain; charset=utf-8") -> DataFrame:
    """set_values() for texts (key, text)."""
    return set_values(records, texts.select(pos, "key", F.encode("text", "UTF-8").alias("value"), F.lit(content_type).alias("content_type")), pos)


def delete_keys(records: DataFrame, keys: DataFrame, pos: str = "pos") -> DataFrame:
    """The records after keys (key) were deleted; deleting what isn't there is no error."""
    none = F.lit(None)
    return set_values(records, keys.select(pos, "key", none.cast("binary").alias("value"), none.cast("string").alias("content_type")), pos)


def list_keys(store: DataFrame, prefix: str = "", after: str | None = None, limit: int = 1000) -> DataFrame:
    """Keys with a prefix after a key, in byte order, with `is_last`: false on the last row of a page that goes on."""
    limit = max(1, limit)
    x = store.where(F.col("key").startswith(prefix)) if prefix else store
    x = x.where(F.col("key") > after) if after is not None else x
    top = x.select("key", F.octet_length("value").alias("size")).orderBy("key").limit(limit + 1)
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("key"))  # over limit + 1 rows
    return top.withColumn("_n", n).withColumn("is_truncated", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def get_text(store: DataFrame) -> DataFrame:
    """(key, text) of JSON, text and XML records; the others have no text."""
    kind = F.lower(F.substring_index("content_type", ";", 1))
    is_text = kind.startswith("text/") | (kind == "application/json") | kind.rlike(r"^application/(?:[^;]*\+)?xml$")
    return store.select("key", F.when(is_text, F.decode("value", "UTF-8")).alias("text"))


def adopt_files(spark, directory: str, input_keys: tuple[str, ...] = ("INPUT",)) -> DataFrame:
    """Bare files of a folder as records (key, value, content_type); declared input keys may have .json behind."""
    files = spark.read.format("binaryFile").load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    is_json = name.endswith(".json")
    stem = F.regexp_replace(name, r"\.json$", "")
    key = F.when(stem.isin(*input_keys), stem).otherwise(name)
    return files.select(key.alias("key"), F.col("content").alias("value"), F.when(is_json | name.isin(*input_keys), "application/json").otherwise("application/octet-stream").alias("content_type"))


# --- transactions and the catalog --------------------------------------------------------------------------------------


def committed(attempts: DataFrame, outputs: str = "outputs") -> DataFrame:
    """What successful attempts wrote, in the order of writing: attempts carry their outputs, and only those with the
    outcome ok are written, so a failed or repeated attempt leaves nothing behind."""
    return attempts.where("outcome = 'ok'").select("request_id", "attempt", F.posexplode(outputs).alias("pos", "item"))


class Transaction:
    """Writes to a dataset and a key-value store that are seen in here at once and by others only after commit().

    After rollback(), or without a commit, nothing was written. `after_commit` functions run once, after the commit.
    """

    def __init__(self, dataset: DataFrame, records: DataFrame) -> None:
        self.base = dataset, records
        self.dataset, self.records = self.base
        self.after_commit: list[Callable[[], None]] = []

    def push_data(self, items: DataFrame, pos: str = "pos") -> None:
        self.dataset = push_data(self.dataset, items, pos)

    def set_values(self, values: DataFrame, pos: str = "pos") -> None:
        self.records = set_values(self.records, values, pos)

    def get_text(self) -> DataFrame:
        return get_text(current(self.records))

    def rollback(self) -> None:
        self.dataset, self.records = self.base
        self.after_commit = []

    def commit(self) -> tuple[DataFrame, DataFrame]:
        """(dataset, records) with all writes, as tables of their own: what was checked is checked once, before anyone sees it."""
        self.base = self.dataset, self.records = written(self.dataset, "dataset"), written(self.records, "records")
        run, self.after_commit = self.after_commit, []
        for f in run:
            f()
        return self.base


def find_storage(catalog: DataFrame, kind: str, id: str | None = None, name: str | None = None) -> DataFrame:
    """The storage with an id (as it is) or a name (letter case of ASCII doesn't count); without both the default one."""
    x = catalog.where(F.col("kind") == kind)
    if id is not None:
        return x.where(F.col("id") == id)
    name = {"__default__": "default"}.get(name or "default", name or "default")
    return x.where(F.lower("name") == name.lower())


def purge(catalog: DataFrame) -> DataFrame:
    """The catalog at the start of a run: storages of single runs (default and aliases) are gone."""
    return catalog.where("not coalesce(run_scoped, false)")


def drop(catalog: DataFrame, kind: str, id: str) -> DataFrame:
    """The catalog without a storage."""
    return catalog.where(~((F.col("kind") == kind) & F.col("id").eqNullSafe(F.lit(id))))


def touched(catalog: DataFrame, kind: str, id: str, at: Column, modified: bool = False, **counts: Column) -> DataFrame:
    """The catalog after a storage was read, or written with `modified`; `counts` are its new counts, such as item_count."""
    mine = (F.col("kind") == kind) & F.col("id").eqNullSafe(F.lit(id))
    new = {"accessed_at": at} | ({"modified_at": at} if modified else {}) | counts
    return catalog.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})
