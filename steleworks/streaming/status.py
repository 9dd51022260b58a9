"""The resumable status table as a structured stream.

Every micro-batch is merged into the table by key and written as the table's next
version; the version is named after the batch, so a batch that is run again after a
failure writes the same version again. The checkpoint says which batch comes next.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="steleworks-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def merge(old: DataFrame | None, batch: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Last value and number of events by key; both are partial results that can be merged."""
    new = batch.groupBy(key).agg(F.max(F.struct(*order, value)).alias("last"), F.count("*").alias("n"))
    return new if old is None else old.unionByName(new).groupBy(key).agg(F.max("last").alias("last"), F.sum("n").alias("n"))


def run_status(spark: SparkSession, path: str, folder: str | None = None, key: str = "user_id", value: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Work through all files at `path` that have not been worked through, and return the table (key, value, n)."""
    folder = folder or _folder(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    # A stream reads folders; a single file is picked from its own.
    source, wanted = path.rsplit("/", 1) if single else (path, "*.parquet")
    schema = spark.read.parquet(path).schema
    done: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{folder}/table/{number - 1}") if number else None
        merge(old, batch, key, value, list(order)).write.mode("overwrite").parquet(f"{folder}/table/{number}")
        _forget(spark, f"{folder}/table/{number - 2}")  # a batch that is run again needs the one before
        done.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", wanted).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = done[-1] if done else _last(spark, f"{folder}/table")
    return spark.read.parquet(f"{folder}/table/{last}").select(key, F.col(f"last.{value}").alias(value), "n")


def _forget(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _last(spark: SparkSession, folder: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return max(int(f.getPath().getName()) for f in files)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream without rows whose key came within the delay before."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
