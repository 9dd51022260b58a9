"""Operators on ordered sequences: windows, votes, islands, runs, running bests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 400, 100
#: Characters whose votes are held at a time.
BLOCK = 1 << 17


def window_starts(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Starts of windows over n characters; the first that reaches the end is the last. No window over nothing."""
    stride = max(1, size - overlap)
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))


def text_windows(df: DataFrame, key: str, column: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    rows = df.select(key, F.col(column).alias("t"), F.posexplode(window_starts(F.length(column), size, overlap)).alias("window", "start"))
    return rows.select(key, "window", "start", F.substring("t", F.col("start") + 1, F.lit(size)).alias("piece"))


def vote(labels: DataFrame, *keys: str) -> DataFrame:
    """The label of each position from labels (keys, window, label): most votes, ties to the earliest window; 'O' has no vote.

    Positions with no vote are left out; whoever joins takes 'O' for them.
    """
    counted = labels.filter("label <> 'O'").groupBy(*keys, "label").agg(F.count("*").alias("n"), F.min("window").alias("first"))
    return counted.groupBy(*keys).agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))


def stitch(texts: list[str], predict: Callable[[int, int, str], np.ndarray], names: list[str], puncs: dict[str, str], size: int = SIZE, overlap: int = OVERLAP) -> str:
    """The text with the punctuation of each character's label behind it.

    predict(window, start, piece) gives the labels as places in `names`, of which the first is
    'O'; what it doesn't label has 'O'. Votes as in vote(). Several texts are one, their
    characters by position, then by code point.
    """
    stride, n, out = max(1, size - overlap), max(map(len, texts), default=0), []
    for base in range(0, n, BLOCK):
        end = min(base + BLOCK, n)
        votes, first = np.zeros((len(names), end - base), np.int64), np.zeros((len(names), end - base), np.int64)
        for text in texts:
            last = max(-(-(len(text) - size) // stride), 0) if text else -1
            for w in range(max(0, -(-(base - size + 1) // stride)), min(last, (end - 1) // stride) + 1):
                start = w * stride
                piece = text[start : start + size]
                got = np.asarray(predict(w, start, piece))[: len(piece)]
                got = got[max(0, base - start) : end - start]
                at = max(start, base) - base
                for k in range(1, len(names)):
                    hit, own = got == k, slice(at, at + len(got))
                    first[k, own] = np.where(hit & ((votes[k, own] == 0) | (first[k, own] > w)), w, first[k, own])
                    votes[k, own] += hit
        label = np.where(votes > 0, (votes << 32) - first, 0).argmax(0)
        points = [np.frombuffer(t[base:end].encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        pos, chars = np.concatenate([np.arange(len(p)) for p in points]), np.concatenate(points)
        if len(points) > 1:
            order = np.lexsort((chars, pos))
            pos, chars = pos[order], chars[order]
        behind = [np.frombuffer(puncs.get(name, "").encode("utf-32-le"), np.uint32) if k else np.zeros(0, np.uint32) for k, name in enumerate(names)]
        own = label[pos]
        widths = np.array([len(b) + 1 for b in behind])[own]
        at = np.cumsum(widths) - widths
        line = np.empty(int(widths.sum()), np.uint32)
        line[at] = chars
        for k, b in enumerate(behind):
            places = at[own == k] if len(b) else at[:0]
            for j, c in enumerate(b.tolist()):
                line[places + j + 1] = c
        out.append(line.tobytes().decode("utf-32-le", "surrogatepass"))
    return "".join(out)


def stitched(df: DataFrame, key: str, column: str, predict: Callable[[int, int, str], np.ndarray], names: list[str], puncs: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, sentence): stitch() over the texts of each key; texts without a character have none, and those without a key no labels.

    Only texts are shuffled: characters and votes stay in the task that has all texts of their key.
    """
    name = f"`{key}` {df.schema[key].dataType.simpleString()}"
    grouped = df.filter(F.length(column) > 0).groupBy(key).agg(F.collect_list(column).alias("texts")).select(key, "texts", puncs.alias("puncs"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                rows = zip(b.column(0).is_valid().to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
                made = [stitch(texts, predict, names, dict(p) if keyed else {}, size, overlap) for keyed, texts, p in rows]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], [key, "sentence"])

    return grouped.mapInArrow(run, f"{name}, sentence string")


def islands(df: DataFrame, part: list[str], order: list[str], starts: Column) -> DataFrame:
    """df with `entry`, the number of the group that a row with `starts` opens; rows before the first one are dropped."""
    own = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("entry", F.sum(starts.cast("int")).over(own)).filter("entry > 0")


def runs(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """df with `run`, which numbers runs of equal values, and `run_size`."""
    w = Window.partitionBy(*part).orderBy(*order)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    numbered = df.withColumn("run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("run_size", F.count("*").over(Window.partitionBy(*part, "run")))


def running_best(df: DataFrame, part: list[str], order: list[str], value: str, patience: int) -> DataFrame:
    """df with `best` so far, whether the row improves it strictly, how many rows since it did, and whether patience is out."""
    w = Window.partitionBy(*part).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    up = df.withColumn("improved", F.coalesce(F.col(value) > before, F.lit(True))).withColumn("best", F.greatest(F.coalesce(before, F.col(value)), F.col(value)))
    n = F.row_number().over(w)
    since = up.withColumn("__n", n).withColumn("since", F.col("__n") - F.max(F.when(F.col("improved"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.max((F.col("since") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return since.withColumn("stopped", F.coalesce(hit == 1, F.lit(False))).drop("__n")
