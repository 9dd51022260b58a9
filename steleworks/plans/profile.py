"""Profiling (group F of the inventory, with E16, I01 and J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import profile as p
from .base import query, table

_DESCRIBE = "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS least, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS most"


@query(f"SELECT {_DESCRIBE} FROM (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents)")
def length_stats(spark, d):
    """F02, D34."""
    return p.describe(table(spark, d, "documents"), F.length("text"))


@query(f"SELECT lang, {_DESCRIBE} FROM (SELECT lang, CAST(length(text) AS DOUBLE) AS x FROM documents) GROUP BY lang")
def length_stats_by_lang(spark, d):
    """F02 by language."""
    return p.describe(table(spark, d, "documents"), F.length("text"), "lang")


@query("SELECT 'event_id' AS \"column\", count(*) FILTER (WHERE event_id IS NULL) AS nulls FROM events UNION ALL SELECT 'ts', count(*) FILTER (WHERE ts IS NULL) FROM events UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM events UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL) FROM events UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL OR isnan(value)) FROM events UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL) FROM events")
def null_profile(spark, d):
    """F03."""
    return p.null_counts(table(spark, d, "events"))


_SKIP = "(' ', ',', '。', '.', chr(10), chr(9), '')"


@query(
    f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS "char", generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents),
    g AS (SELECT "char", count(*) AS frequency, min(doc_id * 1000000 + pos) AS f FROM c WHERE "char" NOT IN {_SKIP} GROUP BY "char")
    SELECT CAST(row_number() OVER (ORDER BY frequency DESC, f) AS INTEGER) AS rank, "char", CAST(frequency AS BIGINT) AS frequency FROM g QUALIFY rank <= 30"""
)
def char_vocab_topn(spark, d):
    """The most frequent characters, ties by first appearance."""
    vocab = p.vocabulary(table(spark, d, "documents"), "doc_id", "text", t.UNCOUNTED)
    return p.top(vocab, [F.desc("frequency"), F.col("first")], 30).select("rank", "char", "frequency")


@query("SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, (SELECT count(DISTINCT label) FROM embeddings) AS labels FROM documents")
def distinct_counts(spark, d):
    """F11, F12."""
    docs = table(spark, d, "documents").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"))
    return docs.crossJoin(F.broadcast(table(spark, d, "embeddings").agg(F.countDistinct("label").alias("labels"))))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY label")
def class_distribution(spark, d):
    """F09, F12, I01."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


_HIGH, _LOW = ["l_extendedprice", "l_tax"], ["l_quantity", "l_discount"]
_BOUNDS = ", ".join(f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS low_{c}" for c in _HIGH + _LOW) + ", " + ", ".join(f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS high_{c}" for c in _HIGH + _LOW)
#: Nothing is beyond 1.5 quartile ranges in this table; a narrower fence flags some rows.
_FENCE = 0.6
_FLAGGED = f"SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, {' + '.join([f'CAST({c} > high_{c} AS INTEGER)' for c in _HIGH] + [f'CAST({c} < low_{c} AS INTEGER)' for c in _LOW])} AS bad_indicator_count FROM lineitem, (SELECT {_BOUNDS.replace('1.5', str(_FENCE))} FROM lineitem)"


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_HIGH, *_LOW)


@query("SELECT " + ", ".join(f"round(low_{c}, 6) AS low_{c}, round(high_{c}, 6) AS high_{c}" for c in _HIGH + _LOW) + f" FROM (SELECT {_BOUNDS} FROM lineitem)")
def quality_bounds(spark, d):
    """F04, F05."""
    b = p.bounds(_lines(spark, d), _HIGH + _LOW)
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query(f"WITH b AS (SELECT {_BOUNDS.replace('1.5', '0.6')} FROM lineitem) SELECT " + ", ".join([f"count(*) FILTER (WHERE {c} > high_{c}) AS {c}" for c in _HIGH] + [f"count(*) FILTER (WHERE {c} < low_{c}) AS {c}" for c in _LOW]) + " FROM lineitem, b")
def quality_outlier_counts(spark, d):
    """rows beyond each bound."""
    rows = _lines(spark, d)
    return rows.crossJoin(F.broadcast(p.bounds(rows, _HIGH + _LOW, _FENCE))).agg(*[F.count_if(f).alias(c) for c, f in p.outlier_flags(_HIGH, _LOW).items()])


@query(f"SELECT bad_indicator_count, count(*) AS n FROM ({_FLAGGED}) GROUP BY 1")
def quality_flag_histogram(spark, d):
    """F06, F09."""
    return p.bad_indicators(_lines(spark, d), _HIGH, _LOW, _FENCE).groupBy("bad_indicator_count").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, bad_indicator_count FROM ({_FLAGGED}) WHERE bad_indicator_count >= 1")
def quality_bad_rows(spark, d):
    """Rows at the threshold or above."""
    return p.bad_indicators(_lines(spark, d), _HIGH, _LOW, _FENCE).filter("bad_indicator_count >= 1").select("l_orderkey", "l_linenumber", "bad_indicator_count")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def metric_correlation(spark, d):
    """F08."""
    return p.correlations(_lines(spark, d), _CORR)


@query(
    "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1"
)
def metric_histogram60(spark, d):
    """60 bins, the last one closed."""
    return p.histogram(table(spark, d, "orders"), "o_totalprice", 60)


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS high, printf('%.2f%%', 100.0 * count(*) FILTER (WHERE value > 50) / count(*)) AS share, CAST(max(try_cast(regexp_extract(props, '(\\d+)', 1) AS INTEGER)) AS INTEGER) AS most FROM events GROUP BY event_type")
def run_counters(spark, d):
    """Counters by status, largest parsed number, percentages as text."""
    n, high = F.count("*"), F.count_if(F.col("value") > 50)
    return table(spark, d, "events").groupBy("event_type").agg(
        n.alias("total"), high.alias("high"), F.format_string("%.2f%%", 100.0 * high / n).alias("share"), F.max(F.regexp_extract("props", r"(\d+)", 1).try_cast("int")).alias("most")
    )
