"""What the operators of this subpackage share: staged tables, Arrow batch sizes, word and key helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is one local process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='harrow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: str = "4m"):
    """Arrow batches of at most ``rows`` rows and about ``size`` for the jobs run inside the block, so that long texts fit in a worker."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    old = {key: spark.conf.get(key) for key in new}
    try:
        for key, value in new.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, UPPER, LOWER)


def hash_fraction(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts; any SQL engine gives the same."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_bucket(n: int, *parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long") % n).cast("int")


def buckets_for(rows: int, most: int = 50_000) -> int:
    """Hash buckets that leave about ``most`` rows to a cell, whatever share of all rows has one length or source; 64 at least."""
    return max(64, -(-rows // most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Drop what an operator keeps in a worker process between its tasks; operators add theirs.
kept_in_worker: list[Callable[[], None]] = []


def trim() -> None:
    """Gives memory that is free in this process back to the machine: workers live on, idle, while other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def lean(work: Callable) -> Callable:
    """``work`` on the batches of a task, in a worker process that keeps nothing of other operators before and nothing of this task after it."""

    def run(batches):
        for drop in kept_in_worker:
            drop()
        yield from work(batches)
        trim()

    return run
