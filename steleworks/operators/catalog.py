"""The catalogue of documents, images and texts, and incremental processing over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def with_defaults(df: DataFrame, defaults: dict[str, str] = schemas.DEFAULTS) -> DataFrame:
    """Null or absent columns that have a default get it."""
    out = df
    for name, sql in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.expr(sql)) if name in df.columns else F.expr(sql))
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key: the newest, with values that it lacks taken from the one before."""
    cols = [c for c in old.columns if c != key]
    both = old.unionByName(new, allowMissingColumns=True).withColumn("__o", order)
    return both.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__o"))).alias(c) for c in cols])


def latest(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key: an event log read as a table."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def pending(docs: DataFrame, source: str | None, most_retries: int, limit: int, key: str = "doc_id") -> DataFrame:
    """The next batch of the queue, in order of the key."""
    rows = docs.filter((F.col("status") == "pending") & (F.col("retries") <= most_retries))
    return (rows.filter(F.col("source") == source) if source else rows).orderBy(key).limit(limit)


def resume_plan(items: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """(key, status, action): what a rerun does with each item; errors are tried again, what is done is skipped."""
    s = F.col("status")
    action = F.when(s.isNull(), "process").when(s.startswith("ERROR"), "retry").when(s == "KEEP", "recover").otherwise("skip")
    return items.join(log, key, "left").withColumn("action", action)


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.join(seen, key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that break the foreign key."""
    return child.join(parent.select(key), key, "left_anti")


def cascade(child: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """What is left of the children when parents are removed."""
    return child.join(removed.select(key), key, "left_anti")


def lookup(df: DataFrame, names: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """df with `value` from a lookup table, or the default; Catalyst broadcasts the table where it is small."""
    return df.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def manifest(wanted: DataFrame, found: DataFrame, key: str, source: str, target: str, action: str) -> DataFrame:
    """(key, source, target, action): a row for each wanted file; those that found lacks are `missing` and have no target."""
    both = wanted.join(found.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    hit = F.col("__hit").isNotNull()
    return both.select(key, F.format_string(source, key).alias("source"), F.when(hit, F.format_string(target, key)).alias("target"), F.when(hit, action).otherwise("missing").alias("action"))


def saved_images(downloads: DataFrame, path: str, kind: str, size: str, order: str, least: int = 256) -> DataFrame:
    """Downloads that are kept: images of at least so many bytes, the first of each path."""
    good = downloads.filter(F.lower(kind).startswith("image/") & (F.col(size) >= least))
    rest = [x for x in good.columns if x not in (path, order)]
    return good.groupBy(path).agg(F.min(order).alias(order), *[F.min_by(x, order).alias(x) for x in rest])


def generated(df: DataFrame, prompt: str, make: Callable[[], Callable[[str], str]], name: str = "output") -> DataFrame:
    """df with what a generator says to each prompt, stripped; an error or a null prompt gives ''.

    make: makes the generator once for each task (a client or a model); it is called row by
    row in Arrow batches. A column of that name is replaced.
    """
    rest = df.drop(name)
    at = rest.columns.index(prompt)

    def run(batches):
        import pyarrow as pa

        generator = make()

        def one(x):
            try:
                return generator(x).strip() if x is not None else ""
            except Exception:  # whatever goes wrong with one row, the others go on
                return ""

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(x) for x in b.column(at).to_pylist()], pa.string())], [*b.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, `{name}` string")


def isolated(f: Callable[[str], str]):
    """A batched function (status, result) that turns an exception into the row's own ERROR status."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import StringType, StructField, StructType

    kind = StructType([StructField("status", StringType()), StructField("result", StringType())])

    def run(s):
        import pandas as pd

        rows = []
        for x in s:
            try:
                rows.append(("KEEP" if (y := f(x)) else "SKIP", y))
            except Exception as e:
                rows.append((f"ERROR:{type(e).__name__}", None))
        return pd.DataFrame(rows, columns=["status", "result"])

    import pandas as pd

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return pandas_udf(run, kind)
