"""Shared folder, written intermediate tables and small Arrow helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent, in local mode, a temporary folder takes its place; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veritab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors.

    As nothing reads the write's shuffles again, Spark drops their files at its end and not when the driver's heap is next collected.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with _freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LOCK = threading.Lock()
_WRITING: dict[int, tuple[int, str]] = {}  # by session: writes under way, and the setting before the first of them


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession):
    """The setting holds while any thread of the session writes, and goes back to what it was with the last."""
    with _LOCK:
        n, before = _WRITING.get(id(spark), (0, ""))
        if not n:
            before = spark.conf.get(_FREE_SHUFFLES, "false")
            spark.conf.set(_FREE_SHUFFLES, "true")
        _WRITING[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(id(spark))
            if n > 1:
                _WRITING[id(spark)] = n - 1, before
            else:
                spark.conf.set(_FREE_SHUFFLES, before)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_atomically(uri: str, fill) -> int:
    """Runs fill(stream) on a file that appears under its name only when whole; a repeated task replaces it by the same bytes."""
    folder, _, name = uri.rpartition("/")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        fill(out)
    fs.move(part, f"{path}/{name}")
    return fs.get_file_info(f"{path}/{name}").size


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; columns with other names don't matter."""
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
