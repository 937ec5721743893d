"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20  # of an Arrow batch that goes to Python

_own: dict[str, str] = {}
_made: list[str] = []  # folders of this process, in their order


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster sets it.

    Only an in-process master (``local[..]``) falls back to a temporary folder, removed at exit; on a cluster
    without the setting the warehouse folder is used, which Spark shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = tempfile.mkdtemp(prefix="marginalia-")
            atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
        return f"file://{_own[key]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marginalia"


def shared_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(f: Callable) -> Callable:
    """While ``f`` runs, Arrow batches to Python hold BATCH_BYTES (and a row) at most; its first argument is a DataFrame.

    Spark's own bound is 64 MB. A batch's memory is taken in the JVM and, as bytes and as strings, in the worker, once for
    each running task, and neither gives all of it back. It counts for what ``f`` itself runs or stores.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **options):
        conf = docs.sparkSession.conf
        before = conf.get(key)
        conf.set(key, str(BATCH_BYTES))
        try:
            return f(docs, *args, **options)
        finally:
            conf.set(key, before)

    return run


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column of a user's table has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept_last(spark: SparkSession, since: int) -> int:
    """Delete the folders made since there were ``since``, but for the last one, when nothing else reads them; how many are left."""
    while len(_made) > since + 1:
        discard(spark, _made.pop(-2))
    return len(_made)


def made() -> int:
    return len(_made)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for archive files that Spark's writers have no format for."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)
