"""Global places and running totals in an order, without a task that holds all rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def stored(df: DataFrame, tag: str = "places") -> DataFrame:
    """The rows written as Parquet in the folder that all executors share, and read back: lineage ends here.

    The folder is ``spark.checkpoint.dir``, else the warehouse; only an in-process master without the setting gets a
    temporary folder, removed at exit.
    """
    spark = df.sparkSession
    path = store_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared store."""
    return f"{_root(spark)}/{tag}-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marginalia"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_places(df: DataFrame, *order: Column | str, name: str = "place", partitions: int | None = None, keep=stored) -> DataFrame:
    """The rows with their place (long, from 0) in the order.

    Rows are dealt into ranges of the order and sorted there; a row's place is its own in its range and the number of rows
    in the ranges before it. Only the ranges' sizes (``partitions`` of them) pass through the driver. Rows that tie in all
    of ``order`` get places in any order, and share a range: end the order with a key. An empty table stays empty.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = free_name(df, "_at")
    ranged = keep(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright(at, 33).alias("part")).count().collect()
    offsets, total = [], 0
    for part, size in sorted((r["part"], r["count"]) for r in sizes):
        offsets.append((part, total))
        total += size
    before, part = free_name(df, "_before"), free_name(df, "_part")
    starts = spark.createDataFrame(offsets, f"{part} long, {before} long")
    placed = ranged.join(F.broadcast(starts), F.shiftright(at, 33) == F.col(part))  # a row for each range
    return placed.withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, before, part)
