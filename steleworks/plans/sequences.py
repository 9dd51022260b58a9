"""Ordered sequences (group G of the inventory, with F13, F27, H06-H08, D13-D15)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import sequences as s
from .base import query, table

_WINDOWS = "SELECT doc_id, unnest(range(0, greatest(CAST(ceil((length(text) - 400) / 300.0) AS INTEGER), 0) + 1)) AS w, text FROM documents WHERE length(text) > 0"


@query(f"SELECT doc_id, CAST(w AS INTEGER) AS \"window\", CAST(w * 300 AS INTEGER) AS start, substr(text, CAST(w * 300 + 1 AS BIGINT), 400) AS piece FROM ({_WINDOWS})")
def text_windows(spark, d):
    """Windows of 400 characters, 100 of them shared."""
    return s.text_windows(table(spark, d, "documents"), "doc_id", "text")


_LABEL = "substr(md5(CAST(w AS VARCHAR) || '|' || CAST(pos AS VARCHAR)), 1, 1)"
_KIND = f"CASE WHEN {_LABEL} IN ('0', '1', '2') THEN 'B-0' WHEN {_LABEL} IN ('3', '4') THEN 'B-1' ELSE 'O' END"
_POSITIONS = f"SELECT doc_id, w, w * 300 + i AS pos FROM (SELECT doc_id, w, unnest(range(0, least(400, length(text) - w * 300))) AS i FROM ({_WINDOWS}))"
_VOTED = f"SELECT doc_id, pos, arg_max(label, n * 100000 - w) AS label FROM (SELECT doc_id, pos, label, count(*) AS n, min(w) AS w FROM (SELECT doc_id, w, pos, {_KIND} AS label FROM ({_POSITIONS})) WHERE label <> 'O' GROUP BY ALL) GROUP BY ALL"


def _predictions(spark, d):
    """A stand-in for a token classifier: labels from a hash of window and position."""
    w = s.text_windows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "window", "start", F.length("piece").alias("n"))
    rows = w.select("doc_id", "window", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    h = F.substring(F.md5(F.concat_ws("|", F.col("window").cast("string"), F.col("pos").cast("string")).cast("binary")), 1, 1)
    return rows.withColumn("label", F.when(h.isin("0", "1", "2"), "B-0").when(h.isin("3", "4"), "B-1").otherwise("O"))


@functools.lru_cache(4096)
def _window_labels(window: int, start: int) -> np.ndarray:
    digits = [hashlib.md5(f"{window}|{p}".encode(), usedforsecurity=False).hexdigest()[0] for p in range(start, start + s.SIZE)]
    return np.array([1 if x in "012" else 2 if x in "34" else 0 for x in digits], np.int8)


def _labels(window: int, start: int, piece: str) -> np.ndarray:
    """The stand-in of _predictions by window: places in O, B-0, B-1; a window's labels are the same in all texts."""
    return _window_labels(window, start)[: len(piece)]


@query(f"SELECT label, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM ({_VOTED}) GROUP BY label")
def window_vote(spark, d):
    """Majority over overlapping windows, ties to the earliest."""
    voted = s.vote(_predictions(spark, d), "doc_id", "pos")
    return voted.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("total"))


@query(
    f"""WITH v AS ({_VOTED}), c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE text <> '')
    SELECT c.doc_id, md5(regexp_replace(string_agg(ch || CASE label WHEN 'B-0' THEN ', ' WHEN 'B-1' THEN '。 ' ELSE '' END, '' ORDER BY c.pos), '^\\s+|\\s+$', '', 'g')) AS sentence_md5
    FROM c LEFT JOIN v ON c.doc_id = v.doc_id AND c.pos = v.pos GROUP BY c.doc_id"""
)
def punct_stitch(spark, d):
    """Labels become punctuation behind their characters; the sentence's digest."""
    puncs = F.create_map(F.lit("B-0"), t.space_after(t.reduce_punctuation(F.lit(","))), F.lit("B-1"), t.space_after(t.reduce_punctuation(F.lit("、。"))))
    whole = s.stitched(table(spark, d, "documents"), "doc_id", "text", _labels, ["O", "B-0", "B-1"], puncs)
    return whole.select("doc_id", F.md5(F.btrim("sentence", F.lit("\t\n\f\r ")).cast("binary")).alias("sentence_md5"))


@query(
    """SELECT conv_id, entry, min(turn) AS first_turn, count(*) AS pages, string_agg(role, '>' ORDER BY turn) AS roles FROM (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM conversations) WHERE entry > 0 GROUP BY conv_id, entry"""
)
def entry_segments(spark, d):
    """A heading opens an entry, what follows belongs to it, what precedes the first is dropped."""
    rows = s.islands(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.col("role") == "user")
    pages = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return rows.groupBy("conv_id", "entry").agg(F.min("turn").alias("first_turn"), F.count("*").alias("pages"), F.array_join(F.transform(pages, lambda x: x["role"]), ">").alias("roles"))


@query(
    """WITH a AS (SELECT user_id, event_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    c AS (SELECT *, n - max(CASE WHEN b IS NULL OR value > b THEN n END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM a)
    SELECT user_id, event_id, greatest(coalesce(b, value), value) AS best, b IS NULL OR value > b AS improved, CAST(since AS INTEGER) AS since,
    coalesce(max(CASE WHEN since >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS stopped FROM c"""
)
def running_best(spark, d):
    """Strict improvements, and the stop after five rows without one."""
    rows = s.running_best(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", 5)
    return rows.select("user_id", "event_id", "best", "improved", "since", "stopped")


@query("SELECT user_id, event_id, event_type, before FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def change_points(spark, d):
    """Rows that differ from the one before."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", "event_type", before.alias("before")).filter("before <> event_type")


@query(
    """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
    SELECT user_id, event_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM b) WHERE NOT (event_type = 'view' AND n >= 3)"""
)
def run_suppress(spark, d):
    """Long runs of one value are left out."""
    rows = s.runs(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.filter("NOT (event_type = 'view' AND run_size >= 3)").select("user_id", "event_id", "event_type")


@query(
    """WITH m AS (SELECT o_custkey, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY o_custkey) SELECT o_orderkey, o_custkey, round(o_totalprice / med, 6) AS size FROM orders JOIN m USING (o_custkey) WHERE o_totalprice < 1.5 * med"""
)
def median_outlier_drop(spark, d):
    """Rows far above their group's median go, the others are scaled by it."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    med = orders.groupBy("o_custkey").agg(F.percentile("o_totalprice", 0.5).alias("med"))
    return orders.join(med, "o_custkey").filter("o_totalprice < 1.5D * med").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") / F.col("med"), 6).alias("size"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 10) DESC, l_extendedprice, l_linenumber) AS INTEGER) AS ordinal FROM lineitem")
def reading_order(spark, d):
    """Columns from right to left, downwards in each."""
    w = Window.partitionBy("l_orderkey").orderBy(F.floor(F.col("l_quantity") / 10).desc(), "l_extendedprice", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("ordinal"))


@query(
    """WITH p AS (SELECT vec_id, x, ink FROM (SELECT vec_id, unnest(range(0, 64)) AS x, unnest(embedding) AS v FROM embeddings), LATERAL (SELECT CASE WHEN v > 0.05 THEN 1 ELSE 0 END AS ink)),
    c AS (SELECT vec_id, x, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS g FROM p WHERE ink = 1)
    SELECT vec_id, CAST(min(x) AS INTEGER) AS x1, CAST(max(x) AS INTEGER) AS x2 FROM c GROUP BY vec_id, g"""
)
def column_split(spark, d):
    """Islands where a profile has ink."""
    w = Window.partitionBy("vec_id").orderBy("x")
    ink = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v")).filter("v > 0.05D")
    return ink.withColumn("g", F.col("x") - F.row_number().over(w)).groupBy("vec_id", "g").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).select("vec_id", "x1", "x2")


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE over_ = 0 AND n = 1"""
)
def take_while(spark, d):
    """Rows up to the last page, one for each name."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    over = F.coalesce(F.max((F.col("event_type") == "purchase").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_type", "event_id", over.alias("over"), n.alias("n")).filter("over = 0 AND n = 1").select("user_id", "event_type", "event_id")


@query(
    """SELECT conv_id, i AS pos, t.turn AS turn, t.text AS body FROM (SELECT conv_id, list_filter(list(role ORDER BY turn), lambda r: r = 'user') AS tabs, list({'turn': turn, 'text': text} ORDER BY turn) AS blocks FROM conversations GROUP BY conv_id), LATERAL (SELECT unnest(range(1, least(len(tabs), len(blocks)) + 1)) AS i), LATERAL (SELECT blocks[i] AS t)"""
)
def positional_join(spark, d):
    """The n-th tab with the n-th block, as far as both go."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("blocks"))
    g = g.withColumn("tabs", F.filter("blocks", lambda b: b["role"] == "user"))
    n = F.least(F.size("tabs"), F.size("blocks"))
    rows = g.filter(n > 0).select("conv_id", F.posexplode(F.slice("blocks", 1, n)).alias("i", "b"))
    return rows.select("conv_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("b.turn").alias("turn"), F.col("b.text").alias("body"))
