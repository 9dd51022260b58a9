"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text that are worked on at a time.
TEXT = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, as in local tests, a temporary folder is chosen
    once for the session and stored in its configuration; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("steleworks.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="steleworks-")
        spark.conf.set("steleworks.scratch.dir", found)
    return found


#: With this Spark deletes the shuffle files of a query that ends; else they stay until the driver's JVM happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _swept(spark: SparkSession):
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SWEEP)
        else:
            spark.conf.set(_SWEEP, before)


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and nothing reads its shuffle files any more."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/steleworks/{uuid.uuid4().hex}"
    with _swept(spark):
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._steleworks_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames that cut() returned and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_steleworks_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_is(key: Column, modulus: int, remainder: int) -> Column:
    """crc32(key as text) mod modulus = remainder; a null key gives false."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = TEXT) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have `most` bytes at the most, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    start, ends = 0, np.cumsum(sizes)
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as no taken one needs."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
