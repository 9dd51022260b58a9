"""Evaluation: error rates, BLEU, top-k, F1, weights, perplexity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StructField, StructType

EDITS = StructType([StructField(n, IntegerType()) for n in ("substitutions", "deletions", "insertions")])
#: Cells of the edit matrix that are held at a time; beyond that the matrix is traced by halves.
CELLS = 4_000_000


def cer(truth: Column, guess: Column) -> Column:
    """Edit distance over the truth's length; 0.0 for an empty truth."""
    return F.when(F.length(truth) > 0, F.levenshtein(truth, guess) / F.length(truth)).otherwise(F.lit(0.0))


def _moves(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions that turn a into b; at equal cost match, substitution, deletion, insertion in this order, from the end."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[0] = np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int64)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, :-1] + (b != a[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(row - ramp) + ramp
    s = d = ins = 0
    i, j = n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and cost[i, j] == cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[i, j] == cost[i - 1, j - 1] + 1:
            s, i, j = s + 1, i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, d, ins


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ramp = np.arange(len(b) + 1)
    row = ramp.copy()
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return row


def edits(truth: str, guess: str) -> tuple[int, int, int]:
    """How many substitutions, deletions and insertions; memory stays bounded for long texts, which are halved first."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (truth or "", guess or ""))

    def split(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        if (len(a) + 1) * (len(b) + 1) <= CELLS or len(a) < 2:
            return _moves(a, b)
        half = len(a) // 2
        at = int(np.argmin(_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]))
        return tuple(x + y for x, y in zip(split(a[:half], b[:at]), split(a[half:], b[at:]), strict=True))

    return split(a, b)


@pandas_udf(EDITS)
def edit_counts(truth: pd.Series, guess: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edits(a, b) for a, b in zip(truth, guess, strict=True)], columns=["substitutions", "deletions", "insertions"])


def softmax(v: Column) -> Column:
    """What is the same for all elements is an argument of zip_with, as within a lambda it would be computed for each of them."""
    same = lambda x: F.array_repeat(x, F.size(v))
    e = F.zip_with(v, same(F.array_max(v).cast("double")), lambda x, top: F.exp(x.cast("double") - top))
    return F.zip_with(e, same(F.aggregate(e, F.lit(0.0), lambda a, y: a + y)), lambda x, total: x / total)


def top_k(v: Column, k: int) -> Column:
    """The k largest as structs (index, value), ties to the smaller index."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("key"), i.alias("index"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["index"].alias("index"), p["value"].alias("value")))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over all labels that occur on either side; 0 where a label has neither. Two aggregates by label, no cross join."""
    pairs = df.groupBy(F.col(truth).alias("y"), F.col(guess).alias("z")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0)
    a = pairs.groupBy(F.col("y").alias("c")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("ap"))
    b = pairs.groupBy(F.col("z").alias("c")).agg(F.sum("n").alias("pp"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = a.join(b, "c", "full").select((2 * zero(F.col("tp"))).alias("up"), (zero(F.col("ap")) + zero(F.col("pp"))).alias("down"))
    return both.agg(F.avg(F.when(F.col("down") > 0, F.col("up") / F.col("down")).otherwise(0.0)).alias("macro_f1"), F.count("*").alias("labels"))


def class_weights(df: DataFrame, label: str, classes: int, power: float = 0.5) -> DataFrame:
    """(id, weight) of all classes: counts of at least 1 to the negative power, over their mean."""
    counts = df.groupBy(F.col(label).cast("long").alias("id")).agg(F.count("*").alias("n"))
    raw = df.sparkSession.range(classes).join(counts, "id", "left").select("id", (1 / F.pow(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("double"), F.lit(power))).alias("w"))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("w").alias("mean")))).select("id", (F.col("w") / F.col("mean")).alias("weight"))


def ngram_matches(pairs: DataFrame, keys: list[str], guess: str, truth: str, most: int = 4) -> DataFrame:
    """(keys, k, guessed, matched): character n-grams of the guess, and those clipped by the truth's counts. Spaces don't count."""

    def grams(c: str, name: str) -> DataFrame:
        chars = F.filter(F.split(c, ""), lambda x: (x != "") & ~x.rlike(r"^\s$"))
        rows = pairs.select(*keys, chars.alias("cs")).select(*keys, "cs", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")).filter(F.size("cs") >= F.col("k"))
        g = rows.select(*keys, "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("cs") - F.col("k") + 1), lambda i: F.array_join(F.slice("cs", i, F.col("k")), ""))).alias("gram"))
        return g.groupBy(*keys, "k", "gram").agg(F.count("*").alias(name))

    both = grams(guess, "h").join(grams(truth, "r"), [*keys, "k", "gram"], "left")
    return both.groupBy(*keys, "k").agg(F.sum("h").alias("guessed"), F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("matched"))


def sizes(c: str) -> Column:
    return F.length(F.regexp_replace(c, r"\s", ""))


def unit(v: Column) -> Column:
    """The vector over its length."""
    x = F.transform(v, lambda e: e.cast("double"))
    return F.zip_with(x, F.array_repeat(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e)), F.size(v)), lambda e, n: e / n)


def greedy_match(a: Column, b: Column) -> Column:
    """Mean over a's unit vectors of the largest cosine with one of b's: one side of a greedy embedding match."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def match_scores(pairs: DataFrame, guess: str, truth: str) -> DataFrame:
    """pairs with precision, recall and f1 of the guess's token vectors (unit vectors) against the truth's; null where a side has none."""
    both = pairs.withColumn("precision", F.when((F.size(guess) > 0) & (F.size(truth) > 0), greedy_match(F.col(guess), F.col(truth)))).withColumn("recall", F.when(F.col("precision").isNotNull(), greedy_match(F.col(truth), F.col(guess))))
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(p + r))


def masked_metrics(rows: DataFrame, batch: str, label: str, logits: str) -> DataFrame:
    """One row: loss, perplexity, tokens, correct1 and correct5 over rows with a label; each batch's mean loss counts by its tokens."""
    own = F.get(F.col(logits), F.col(label))
    total = F.aggregate(F.zip_with(logits, F.array_repeat(F.array_max(logits), F.size(logits)), lambda x, top: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    above = F.size(F.filter(F.zip_with(logits, F.array_repeat(own, F.size(logits)), lambda x, y: x > y), lambda x: x))
    x = rows.filter(F.col(label).isNotNull()).select(batch, (F.log(total) + F.array_max(logits) - own).alias("loss"), above.alias("above"))
    b = x.groupBy(batch).agg(F.avg("loss").alias("loss"), F.count("*").alias("n"), F.count_if(F.col("above") < 1).alias("c1"), F.count_if(F.col("above") < 5).alias("c5"))
    mean = F.sum(F.col("loss") * F.col("n")) / F.sum("n")
    return b.agg(mean.alias("loss"), F.exp(mean).alias("perplexity"), F.sum("n").alias("tokens"), F.sum("c1").alias("correct1"), F.sum("c5").alias("correct5"))


def numbered(df: DataFrame, part: str, order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
