"""Profiles of tables: describe, quartile bounds, flags, correlations, histograms, vocabularies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, column: Column, *keys: str) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (interpolated) and most, overall or by keys."""
    x = df.select(*keys, column.cast("double").alias("x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = x.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), q.alias("q"), F.max("x").alias("most"))
    return out.select(*keys, "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))], "most")


def is_null(name: str, kind: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, NaN counted as null, in one aggregate."""
    one = df.agg(*[F.count_if(is_null(n, k)).alias(n) for n, k in df.dtypes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("nulls")) for n in df.columns])).alias("r")).select("r.*")


def bounds(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """One row: for each column the bounds `factor` quartile ranges beyond the quartiles (low_c, high_c)."""
    both = df.agg(*[F.percentile(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns])
    spread = {c: F.col(c)[1] - F.col(c)[0] for c in columns}
    return both.select(*[(F.col(c)[0] - factor * spread[c]).alias(f"low_{c}") for c in columns], *[(F.col(c)[1] + factor * spread[c]).alias(f"high_{c}") for c in columns])


def outlier_flags(high: list[str], low: list[str]) -> dict[str, Column]:
    """Whether a value is beyond its bad bound, strictly; null and NaN are not."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return {c: F.coalesce(ok(c) & (F.col(c) > F.col(f"high_{c}")), F.lit(False)) for c in high} | {c: F.coalesce(ok(c) & (F.col(c) < F.col(f"low_{c}")), F.lit(False)) for c in low}


def bad_indicators(df: DataFrame, high: list[str], low: list[str], factor: float = 1.5) -> DataFrame:
    """df with bad_indicator_count; metrics that df doesn't have are skipped. The bounds are one row, so they are broadcast."""
    high, low = ([c for c in own if c in df.columns] for own in (high, low))
    if not high + low:
        return df.withColumn("bad_indicator_count", F.lit(0))
    limits = bounds(df, high + low, factor)
    flagged = df.crossJoin(F.broadcast(limits))
    total = sum((f.cast("int") for f in outlier_flags(high, low).values()), F.lit(0))
    return flagged.withColumn("bad_indicator_count", total).drop(*limits.columns)


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """(a, b, r): Pearson's r of each pair of columns, from one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.round(F.corr(a, b), digits).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over equal bins from 0; the last one is closed. Bins without rows are left out."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return x.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, key: str, column: str, skip: list[str]) -> DataFrame:
    """(char, frequency, first): first is the smallest (key, position).

    Counts and smallest keys are aggregated before the shuffle, a row for each character and
    task; positions are then looked up in the documents that some character comes first in.
    """

    def chars(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).alias("k"), F.posexplode(F.split(column, "")).alias("pos", "char")).filter((F.col("char") != "") & ~F.col("char").isin(*skip))

    counts = chars(df).groupBy("char").agg(F.count("*").alias("frequency"), F.min("k").alias("k"))
    firsts = counts.select(F.col("k").alias("first_key")).distinct()
    own = chars(df.join(firsts, df[key].eqNullSafe(F.col("first_key")), "left_semi")).groupBy("char", "k").agg(F.min("pos").alias("pos"))
    at = own.select(F.col("char").alias("c"), F.col("k").alias("first_key"), "pos")
    return counts.join(at, (F.col("char") == F.col("c")) & F.col("k").eqNullSafe(F.col("first_key"))).select("char", "frequency", F.struct("k", "pos").alias("first"))


def top(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows in this order, numbered; only these n meet in one place."""
    from pyspark.sql import Window

    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))
