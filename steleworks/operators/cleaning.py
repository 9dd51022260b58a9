"""The corpus cleaning job: clean, flatten, filter by length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

MIN_LENGTH = 20


def target_column(df: DataFrame, name: str) -> str:
    """The named column, or the first one where there is none of that name."""
    return name if name in df.columns else df.columns[0]


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def clean_corpus(df: DataFrame, column: str = "transcript", removed: str = t.REMOVED, least: int = MIN_LENGTH) -> DataFrame:
    """df with `preprocess`, for the rows where it has at least `least` characters."""
    c = F.col(target_column(df, column))
    return df.withColumn("preprocess", t.flatten(t.clean(c, removed))).filter(F.length("preprocess") >= least)


def counts(df: DataFrame, column: str = "transcript", least: int = MIN_LENGTH) -> DataFrame:
    """How many rows clean_corpus keeps and removes."""
    n = F.length(t.flatten(t.clean(F.col(target_column(df, column)))))
    return df.agg(F.count("*").alias("total"), F.count_if(n >= least).alias("kept"), F.count_if(n < least).alias("removed"))
