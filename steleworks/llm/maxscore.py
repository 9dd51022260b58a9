"""Exact top-k inner-product search with MaxScore.

A term is a dimension; its postings in a shard are the shard's values there, with
the bounds lo and hi of what a term can add to a query's score. Terms are ordered
by hi - lo. The non-essential ones are the longest run of narrow terms that cannot
lift a vector above the threshold (the k-th score so far) when all essential terms
add their lo. Essential postings are traversed, widest term first; the others are
probed only for vectors whose partial score and remaining bounds are still
competitive. Shards keep the threshold that earlier shards of their group have
reached, and shard results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, table

#: Vectors in a shard, queries in a block, shards that one task works through, terms added at a time.
SHARD, QUERIES, GROUP, STEP = 8192, 4096, 4, 8


def quantized(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): whole-number vectors; those that are null or hold a null, NaN or infinite component are left out."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = df.select(F.col(key).cast("long").alias("vec_id"), wide.alias("w")).filter(
        F.col("vec_id").isNotNull() & F.col("w").isNotNull() & ~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return good.select("vec_id", F.transform("w", lambda x: F.floor(x * scale).cast("long")).alias("v"))


class Shard:
    """Vectors as rows, with the range of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        #: Doubles hold every sum exactly below 2^53; beyond that Python's whole numbers are used.
        wide = float(np.abs(vectors).max(initial=0)) ** 2 * max(1, vectors.shape[1]) < 2**52
        self.columns = np.ascontiguousarray(vectors[order].T.astype(np.float64)) if wide else vectors[order].T.astype(object)
        self.low = self.columns.min(1) if len(ids) else np.zeros(len(self.columns))
        self.high = self.columns.max(1) if len(ids) else np.zeros(len(self.columns))


class Best:
    """The k best (score, vec_id) so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), np.empty(0, np.int64)

    @property
    def threshold(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(query: np.ndarray, own: int, shard: Shard, best: Best) -> int:
    """Add what the shard has for the query to best; returns how many vectors were scored to the end."""
    dims, n = len(shard.columns), len(shard.ids)
    if not n:
        return 0
    q = np.zeros(dims, query.dtype)
    q[: len(query)] = query[:dims]
    q = q.astype(shard.columns.dtype)
    if best.threshold == -np.inf:  # a first threshold from a few vectors
        few = slice(0, min(n, 8 * best.k))
        best_start = q @ shard.columns[:, few]
        keep = shard.ids[few] != own
        best.add(best_start[keep], shard.ids[few][keep])
        left = np.arange(few.stop, n)
    else:
        left = np.arange(n)
    a, b = q * shard.low, q * shard.high
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort((low - high).astype(np.float64), kind="stable")  # widest first
    width = (high - low)[order]
    narrow_first = np.cumsum(width[::-1])
    essential = dims - int(np.searchsorted(narrow_first.astype(np.float64), float(best.threshold) - float(low.sum()), "left"))
    essential = max(0, min(dims, essential))
    rest = np.append(np.cumsum(high[order][::-1])[::-1][1:], 0)  # what terms after each can add at most
    partial = np.zeros(len(left), shard.columns.dtype)
    if not essential and float(low.sum() + width.sum()) < best.threshold:
        return 0
    at = 0
    while at < dims and len(left):
        end = min(at + STEP, essential) if at < essential else min(at + STEP, dims)
        terms = order[at:end]
        part = shard.columns[terms] if len(left) == n else shard.columns[np.ix_(terms, left)]
        partial = partial + q[terms] @ part
        at = end
        if best.threshold > -np.inf:
            live = partial + rest[at - 1] >= best.threshold
            if not live.all():
                left, partial = left[live], partial[live]
    keep = shard.ids[left] != own
    if keep.any():
        best.add(partial[keep], shard.ids[left][keep])
    return len(left)


BLOCK = "block int, ids binary, dims int, data binary"


def blocks(rows: DataFrame, count: int, most: int, distinct: bool = False) -> DataFrame:
    """rows (vec_id, v) packed into blocks of at most `most` vectors, dealt by a hash of vec_id to `count` numbers."""

    def run(batches):
        ids: list[np.ndarray] = []
        vectors: list[list] = []
        number = None

        def out():
            id_ = np.concatenate(ids)
            dims = max((len(v) for v in vectors), default=0)
            data = np.zeros((len(vectors), dims), np.int64)
            for i, v in enumerate(vectors):
                data[i, : len(v)] = v
            if distinct:
                id_, first = np.unique(id_, return_index=True)
                data = data[first]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([id_.astype("<i8").tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([_packed(data)], pa.binary())],
                ["block", "ids", "dims", "data"],
            )

        for b in batches:
            block, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for s, e in zip(starts, [*starts[1:], len(block)], strict=True):
                if number is not None and block[s] != number:
                    yield out()
                    ids, vectors = [], []
                number = int(block[s])
                for at in range(s, e, most):
                    part = b.slice(at, min(most, e - at))
                    if vectors and len(vectors) + part.num_rows > most and key[at] != ids[-1][-1]:
                        yield out()
                        ids, vectors = [], []
                    ids.append(part.column(1).to_numpy())
                    vectors += part.column(2).to_pylist()
        if vectors:
            yield out()

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")).select("block", "vec_id", "v")
    return dealt.repartition(min(count, 4 * parallelism(rows.sparkSession)), "block").sortWithinPartitions("block", "vec_id", "v").mapInArrow(run, BLOCK)


def _packed(data: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type; the first byte is its width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(data).max(initial=0) < 1 << 8 * w - 1)
    return bytes([width]) + data.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dims).astype(np.int64) if dims else np.zeros((0, 0), np.int64)


FOUND = "query_id long, vec_id long, score long"


def top_k(queries: DataFrame, vectors: DataFrame, k: int, shard: int = SHARD, most: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query (vec_id, v).

    A query's own rows, those with its vec_id, are no candidates. Ties go to the
    smaller vec_id. Query ids that repeat count once, with the smallest vector;
    repeated candidates count each. Shorter vectors count as filled with zeros.
    Scores beyond 64 bits are cut to the largest or smallest such number.
    Blocks of queries meet groups of shards; no task gets more than one block and
    GROUP shards, and nothing is broadcast.
    """
    n_shards = max(1, -(-vectors.count() // shard))
    n_queries = max(1, -(-queries.count() // most))
    # Groups of GROUP shards at most, and smaller ones where that leaves tasks without work.
    groups = min(n_shards, max(-(-n_shards // GROUP), parallelism(vectors.sparkSession) // n_queries))
    shards = blocks(vectors, n_shards, 2 * shard).select(
        F.lit(1).alias("kind"), "block", "ids", "dims", "data", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), (F.col("block") % groups).alias("g")
    )
    asked = blocks(queries, n_queries, 1 << 30, True).select(
        F.lit(0).alias("kind"), "block", "ids", "dims", "data", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    )

    def run(batch: pa.Table) -> pa.Table:
        rows = sorted(batch.select(["kind", "block", "ids", "dims", "data"]).to_pylist(), key=lambda r: (r["kind"], r["block"]))
        best: list[tuple[int, np.ndarray, Best]] = []
        for r in rows:
            ids, data = np.frombuffer(r["ids"], "<i8"), _unpacked(r["data"], r["dims"])
            if not r["kind"]:
                best += [(int(i), v, Best(k)) for i, v in zip(ids, data, strict=True)]
                continue
            dims = max([r["dims"], *(len(v) for _, v, _ in best[:1])])
            part = Shard(ids, np.pad(data, ((0, 0), (0, dims - r["dims"]))))
            for own, query, top in best:
                search(query, own, part, top)
        cols = [[i for i, _, t in best for _ in t.ids], [int(x) for _, _, t in best for x in t.ids], [max(-(2**63), min(2**63 - 1, int(x))) for _, _, t in best for x in t.scores]]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = shards.unionByName(asked).groupBy("q", "g").applyInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_maxscore(spark, sf_dir: str) -> DataFrame:
    rows = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return top_k(rows.filter("vec_id % 20 = 0"), rows, 20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
