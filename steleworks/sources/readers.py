"""Readers. Each has an explicit schema, and gives an empty table where its input is absent."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import SPACE


def guarded(spark: SparkSession, read, schema: str) -> DataFrame:
    """What read() gives, or an empty table of this schema if the path is not there."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def csv(spark: SparkSession, path: str, schema: str = schemas.TRANSCRIPTS) -> DataFrame:
    """CSV with a header; cells may hold line feeds, a byte order mark is skipped."""
    return guarded(spark, lambda: spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path), schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every line that isn't blank, without white space around it."""
    raw = guarded(spark, lambda: spark.read.text(path), "value string")
    return raw.select(F.regexp_replace("value", f"^{SPACE}+|{SPACE}+$", "").alias("value")).filter("value <> ''")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line."""
    return lines(spark, path).distinct()


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """(filename, status) of a log of two columns, split at the first comma; of several lines of a file the last wins."""
    # Lines are in order by file, block and place in the block, so that a large log is read in parts.
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    raw = guarded(spark, lambda: spark.read.text(path).select(place.alias("n"), F.col("value").alias("line")), "n struct<path:string,block:long,line:long>, line string")
    rows = raw.filter((F.trim("line") != "") & F.contains("line", F.lit(",")))
    parts = rows.select("n", F.split("line", ",", 2).alias("p")).select("n", F.trim(F.col("p")[0]).alias("filename"), F.trim(F.col("p")[1]).alias("status"))
    return parts.filter("filename <> 'filename'").groupBy("filename").agg(F.max_by("status", "n").alias("status"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): files as one text each."""
    return guarded(spark, lambda: spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), "path string, value string")


def joined_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the stripped lines of each file, joined without anything between."""
    strip = lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    return whole_texts(spark, path).select("path", F.array_join(F.transform(F.split("value", "\n"), strip), "").alias("value"))


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(path, document): JSON of a known schema as structs, of any other as VARIANT."""
    raw = whole_texts(spark, path)
    return raw.select("path", (F.from_json("value", schema) if schema else F.try_parse_json("value")).alias("document"))


def config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object over the defaults, key by key; a file that can't be read leaves the defaults."""
    import json

    try:
        row = spark.read.text(path, wholetext=True).first()
        return defaults | (json.loads(row["value"]) if row else {})
    except (AnalysisException, ValueError):
        return dict(defaults)


def images(spark: SparkSession, path: str, glob: str = "*.{png,jpg}", least: int = 256) -> DataFrame:
    """Image files in order of path; too small ones and those of another kind are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).filter(F.col("length") >= least)
    head = F.hex(F.substring("content", 1, 4))
    return rows.filter((head == "89504E47") | head.startswith("FFD8FF")).orderBy("path")


def shards(spark: SparkSession, path: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """(path, row, label, pixels) of NPZ shards; one that is broken or lacks `images` or `labels` has no rows. most: so many rows, drawn by a seeded hash."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with np.load(io.BytesIO(data)) as z:
                        x, y = z["images"], z["labels"]
                except Exception:  # whatever is wrong with a shard, the others are read
                    continue
                n = min(len(x), len(y))
                pixels = pa.array([v.ravel().astype("int32").tolist() for v in x[:n]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(y[:n].astype("int64")), pixels], ["path", "row", "label", "pixels"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    out = raw.mapInArrow(run, "path string, row long, label long, pixels array<int>")
    return out.orderBy(F.xxhash64("path", "row", F.lit(seed)), "path", "row").limit(most) if most else out


def listing(spark: SparkSession, path: str, ignored: tuple[str, ...] = (".git", "__pycache__")) -> DataFrame:
    """(path, depth, size) of all files below a folder that no ignored folder holds, in order."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    rows = rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))))
    return rows.select("path", (F.size(F.split("path", "/")) - 1).alias("depth"), "size").orderBy("path")


def tree(spark: SparkSession, path: str, ignored: tuple[str, ...] = (".git", "__pycache__")) -> DataFrame:
    """(path, depth, folder) of everything below a folder, as a tree is printed: within a folder, folders first, then by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    parts = listing(spark, path, ignored).select(F.split(F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + root.replace("file:///", "file:/") + "/", ""), "/").alias("p"))
    every = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth")).select(F.slice("p", F.lit(1), F.col("depth")).alias("p"), "depth", (F.col("depth") < F.size("p")).alias("folder")).distinct()
    # A step that leads to a folder sorts before one that is a file.
    key = F.transform("p", lambda x, i: F.struct(((i + 1 == F.size("p")) & ~F.col("folder")).alias("file"), x.alias("name")))
    return every.orderBy(key).select(F.array_join("p", "/").alias("path"), "depth", "folder")


PAGES = "pages array<struct<blocks:array<struct<type:int,bbox:array<double>,lines:array<struct<spans:array<struct<text:string,bbox:array<double>,size:double>>>>>>>>"


def paged_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, block, kind, text, bbox, size, error) of a folder of documents, whose pages are given as JSON.

    Blocks of type 0 give a `text` row for each span that isn't blank, blocks of type 1 an
    `image` row. A document that can't be read has one row with its error, and the others go on.
    """
    docs = whole_texts(spark, path).select("path", F.from_json("value", PAGES).alias("d"))
    bad = docs.filter("d.pages IS NULL").select("path", F.lit("ValueError").alias("error"))
    b = docs.select("path", F.posexplode("d.pages").alias("page", "p")).select("path", "page", F.posexplode("p.blocks").alias("block", "b"))
    at = ["path", "page", "block"]
    spans = b.filter("b.type = 0").select(*at, F.explode("b.lines").alias("l")).select(*at, F.explode("l.spans").alias("s")).filter(F.trim("s.text") != "")
    texts = spans.select(*at, F.lit("text").alias("kind"), F.trim("s.text").alias("text"), "s.bbox", "s.size")
    return texts.unionByName(b.filter("b.type = 1").select(*at, F.lit("image").alias("kind"), "b.bbox"), allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)


def dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A Parquet data set, split by folders split=…; one of its splits reads that folder only."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split and "split" in df.columns else df
