"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV with a header; the first name carries the byte order mark that spreadsheets look for."""
    first = df.columns[0]
    (df.withColumnRenamed(first, BOM + first) if bom else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def results(df: DataFrame, path: str) -> bool:
    """CSV and JSON of the rows; nothing is written where there are none."""
    if df.isEmpty():
        return False
    csv(df, f"{path}/csv")
    json(df, f"{path}/json")
    return True


def append_log(df: DataFrame, path: str) -> None:
    """Lines filename,status added to a log."""
    df.select(F.concat_ws(",", "filename", "status").alias("value")).write.mode("append").text(path)


def texts(df: DataFrame, path: str) -> None:
    """Child rows of texts, a folder for each type; empty contents are left out."""
    folder = F.create_map(*[F.lit(x) for kv in {"transcript": "transcriptions", "translation": "translations", "punctuated": "punctuated"}.items() for x in kv])
    rows = df.filter(F.length("content") > 0).withColumn("char_count", F.length("content")).withColumn("folder", F.coalesce(F.try_element_at(folder, F.col("text_type")), F.lit("texts")))
    rows.write.mode("append").partitionBy("folder").parquet(path)


def scalars(df: DataFrame, path: str) -> None:
    """Metrics (step, name, value) added to a table."""
    df.select("step", "name", "value").write.mode("append").parquet(path)


def catalog(tables: dict[str, DataFrame], path: str) -> None:
    """The catalogue's tables, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
