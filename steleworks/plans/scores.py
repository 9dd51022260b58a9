"""Scoring (group E of the inventory, with F14-F21, I03-I08, H05, K07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import scores as s
from .base import query, table, values

_GUESS = "replace(text, 'th', 'ht') || 'x'"
_TRUTH = "text"


def _pairs(spark, d):
    return table(spark, d, "benchmark").selectExpr("item_id", f"{_TRUTH} AS truth", f"{_GUESS} AS guess")


@query(f"SELECT item_id, CAST(levenshtein({_TRUTH}, {_GUESS}) AS INTEGER) AS distance, round(levenshtein({_TRUTH}, {_GUESS}) / CAST(length({_TRUTH}) AS DOUBLE), 6) AS cer, round(1 - levenshtein({_TRUTH}, {_GUESS}) / CAST(length({_TRUTH}) AS DOUBLE), 6) AS accuracy FROM benchmark")
def cer_pairs(spark, d):
    """E01, E02."""
    x = _pairs(spark, d).withColumn("cer", s.cer(F.col("truth"), F.col("guess")))
    return x.select("item_id", F.levenshtein("truth", "guess").alias("distance"), F.round("cer", 6).alias("cer"), F.round(1 - F.col("cer"), 6).alias("accuracy"))


@query(f"SELECT item_id, CAST(levenshtein({_TRUTH}, {_GUESS}) AS INTEGER) AS total, length({_GUESS}) - length({_TRUTH}) AS surplus FROM benchmark")
def cer_edits(spark, d):
    """Substitutions, deletions and insertions, checked by their sum (the distance) and by insertions - deletions."""
    x = _pairs(spark, d).withColumn("e", s.edit_counts("truth", "guess"))
    e = lambda n: F.col(f"e.{n}")
    return x.select("item_id", (e("substitutions") + e("deletions") + e("insertions")).alias("total"), (e("insertions") - e("deletions")).cast("long").alias("surplus"))


_CER = [("府尹嚴相公", "府尹相公", 0, 1, 0), ("abc", "axc", 1, 0, 0), ("abc", "abxc", 0, 0, 1), ("ab", "ba", 2, 0, 0), ("kitten", "sitting", 2, 0, 1), ("abcd", "", 0, 4, 0), ("", "xyz", 0, 0, 3)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {x}, {y}, {z})" for a, b, x, y, z in _CER) + ") AS v(truth, guess, substitutions, deletions, insertions)")
def cer_edit_values(spark, d):
    """E01 on literal rows."""
    return values(spark, "truth string, guess string", [r[:2] for r in _CER]).withColumn("e", s.edit_counts("truth", "guess")).select("truth", "guess", "e.*")


@query(
    """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), p AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS INTEGER) AS rank, 'c' || i AS token, round(p, 6) AS probability FROM p QUALIFY rank <= 10"""
)
def topk_softmax(spark, d):
    """The ten likeliest classes with their tokens."""
    rows = table(spark, d, "embeddings").select("vec_id", s.top_k(s.softmax(F.col("embedding")), 10).alias("top"))
    return rows.select("vec_id", F.posexplode("top").alias("pos", "t")).select("vec_id", (F.col("pos") + 1).alias("rank"), F.concat(F.lit("c"), F.col("t.index")).alias("token"), F.round("t.value", 6).alias("probability"))


_ARG = "list_position(embedding, list_max(embedding)) - 1"


@query(
    f"""SELECT round(avg(CAST(({_ARG}) % 10 = label AS DOUBLE)), 6) AS top1, round(avg(CAST(list_contains(list_transform(list_slice(list_reverse_sort(embedding), 1, 5), lambda x: (list_position(embedding, x) - 1) % 10), label) AS DOUBLE)), 6) AS top5, count(*) AS n FROM embeddings"""
)
def accuracy_topk(spark, d):
    """E05, F20, F21, L08."""
    first = F.transform(s.top_k(F.col("embedding"), 5), lambda p: p["index"] % 10)
    hit = lambda c: F.round(F.avg(c.cast("double")), 6)
    return table(spark, d, "embeddings").agg(hit(s.argmax(F.col("embedding")) % 10 == F.col("label")).alias("top1"), hit(F.array_contains(first, F.col("label"))).alias("top5"), F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT quality AS y, toxic AS z FROM labels), c AS (SELECT y AS c FROM p UNION SELECT z FROM p), g AS (SELECT c, sum(CAST(y = c AND z = c AS INTEGER)) AS tp, sum(CAST(z = c AS INTEGER)) + sum(CAST(y = c AS INTEGER)) AS down FROM c, p GROUP BY c)
    SELECT round(avg(CASE WHEN down = 0 THEN 0 ELSE 2.0 * tp / down END), 9) AS macro_f1, count(*) AS labels FROM g"""
)
def macro_f1(spark, d):
    """F19."""
    return s.macro_f1(table(spark, d, "labels"), "quality", "toxic").withColumn("macro_f1", F.round("macro_f1", 9))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT r.range AS id, 1 / sqrt(coalesce(n, 1)) AS w FROM range(13) r LEFT JOIN c ON r.range = c.label) SELECT id, round(w / avg(w) OVER (), 9) AS weight FROM w")
def class_weights(spark, d):
    """Absent classes count as one."""
    return s.class_weights(table(spark, d, "embeddings"), "label", 13).withColumn("weight", F.round("weight", 9))


_LOSS = "abs(embedding[1]) + 0.5"


@query(f"SELECT round(exp(sum(CAST({_LOSS} AS DOUBLE) * n) / sum(n)), 6) AS perplexity, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT embedding, label + 1 AS n FROM embeddings WHERE label <> 3)")
def perplexity(spark, d):
    """Rows of label 3 stand for empty masks and are left out."""
    x = table(spark, d, "embeddings").filter("label <> 3").select((F.abs(F.col("embedding")[0]) + F.lit(0.5).cast("float")).cast("double").alias("loss"), (F.col("label") + 1).alias("n"))
    return x.agg(F.round(F.exp(F.sum(F.col("loss") * F.col("n")) / F.sum("n")), 6).alias("perplexity"), F.sum("n").alias("tokens"))


@query("SELECT label % 3 AS epoch, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS loss, round(100 * avg(CAST((list_position(embedding, list_max(embedding)) - 1) % 10 = label AS DOUBLE)), 6) AS accuracy FROM embeddings GROUP BY 1")
def epoch_metrics(spark, d):
    """means by epoch."""
    x = table(spark, d, "embeddings")
    hit = (s.argmax(F.col("embedding")) % 10 == F.col("label")).cast("double")
    return x.groupBy((F.col("label") % 3).alias("epoch")).agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("loss"), F.round(100 * F.avg(hit), 6).alias("accuracy"))


_NGRAMS = f"""WITH p AS (SELECT item_id, string_split(regexp_replace({_TRUTH}, '\\s', '', 'g'), '') AS r, string_split(regexp_replace({_GUESS}, '\\s', '', 'g'), '') AS h FROM benchmark),
    k AS (SELECT unnest([1, 2, 3, 4]) AS k),
    gh AS (SELECT item_id, k, gram, count(*) AS n FROM (SELECT item_id, k, unnest(list_transform(range(1, len(h) - k + 2), lambda i: array_to_string(h[i : i + k - 1], ''))) AS gram FROM p, k) GROUP BY ALL),
    gr AS (SELECT item_id, k, gram, count(*) AS n FROM (SELECT item_id, k, unnest(list_transform(range(1, len(r) - k + 2), lambda i: array_to_string(r[i : i + k - 1], ''))) AS gram FROM p, k) GROUP BY ALL),
    m AS (SELECT gh.item_id, gh.k, sum(gh.n) AS guessed, sum(least(gh.n, coalesce(gr.n, 0))) AS matched FROM gh LEFT JOIN gr ON gh.item_id = gr.item_id AND gh.k = gr.k AND gh.gram = gr.gram GROUP BY ALL)"""


@query(
    _NGRAMS
    + """, t AS (SELECT k, sum(guessed) AS g, sum(matched) AS m FROM m GROUP BY k), l AS (SELECT sum(len(h)) AS h, sum(len(r)) AS r FROM p)
    SELECT round(100 * exp(avg(ln(m / g))) * min(CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END), 6) AS bleu FROM t, l"""
)
def bleu_corpus(spark, d):
    """F16: corpus BLEU over characters."""
    pairs = _pairs(spark, d)
    total = s.ngram_matches(pairs, ["item_id"], "guess", "truth").groupBy("k").agg(F.sum("guessed").alias("g"), F.sum("matched").alias("m"))
    size = pairs.agg(F.sum(s.sizes("guess")).alias("h"), F.sum(s.sizes("truth")).alias("r"))
    penalty = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return total.crossJoin(F.broadcast(size)).agg(F.round(100 * F.exp(F.avg(F.log(F.col("m") / F.col("g")))) * F.min(penalty), 6).alias("bleu"))


@query(
    _NGRAMS
    + """, z AS (SELECT item_id, k, guessed, matched, sum(CASE WHEN matched = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY k) AS zeros FROM m)
    SELECT item_id, round(100 * exp(avg(ln(CASE WHEN matched > 0 THEN matched / guessed ELSE 1 / (pow(2, zeros) * guessed) END))) * min(CASE WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END), 6) AS bleu FROM z JOIN p USING (item_id) GROUP BY item_id"""
)
def bleu_sentence(spark, d):
    """sentence BLEU over characters; orders without a match are smoothed by halves."""
    from pyspark.sql import Window

    pairs = _pairs(spark, d)
    m = s.ngram_matches(pairs, ["item_id"], "guess", "truth")
    zeros = F.sum((F.col("matched") == 0).cast("int")).over(Window.partitionBy("item_id").orderBy("k"))
    p = F.when(F.col("matched") > 0, F.col("matched") / F.col("guessed")).otherwise(1 / (F.pow(F.lit(2.0), "zeros") * F.col("guessed")))
    size = pairs.select("item_id", s.sizes("guess").alias("h"), s.sizes("truth").alias("r"))
    penalty = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return m.withColumn("zeros", zeros).join(size, "item_id").groupBy("item_id").agg(F.round(100 * F.exp(F.avg(F.log(p))) * F.min(penalty), 6).alias("bleu"))


_MATCH = """WITH u AS (SELECT vec_id // 8 AS sentence, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings),
    c AS (SELECT x.sentence, x.vec_id AS a, y.vec_id AS b, list_inner_product(x.u, y.u) AS s FROM u x JOIN u y ON y.sentence = x.sentence + 1),
    p AS (SELECT sentence, avg(best) AS precision FROM (SELECT sentence, a, max(s) AS best FROM c GROUP BY ALL) GROUP BY sentence), r AS (SELECT sentence, avg(best) AS recall FROM (SELECT sentence, b, max(s) AS best FROM c GROUP BY ALL) GROUP BY sentence)"""


def _matched(spark, d):
    u = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("sentence"), s.unit(F.col("embedding")).alias("u"))
    guess = u.groupBy("sentence").agg(F.collect_list("u").alias("guess"))
    truth = guess.select((F.col("sentence") - 1).alias("sentence"), F.col("guess").alias("truth"))
    return s.match_scores(guess.join(truth, "sentence"), "guess", "truth")


@query(_MATCH + "SELECT sentence, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p JOIN r USING (sentence)")
def embedding_match(spark, d):
    """precision, recall and F1 of each pair of sentences by greedy matching of their tokens' vectors; any encoder's vectors can be put in. A sentence is eight vectors, its reference the next one."""
    return _matched(spark, d).select("sentence", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_MATCH + "SELECT 'vectors' AS model, round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean, round(avg(2 * precision * recall / (precision + recall)), 6) AS f1_mean, count(*) AS pairs FROM p JOIN r USING (sentence)")
def embedding_match_summary(spark, d):
    """means by model over the valid pairs."""
    return _matched(spark, d).groupBy(F.lit("vectors").alias("model")).agg(*[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("precision", "recall", "f1")], F.count("*").alias("pairs"))


@query(
    """WITH m AS (SELECT vec_id // 4 AS batch, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 3 = 0 AND vec_id // 4 % 5 <> 0),
    x AS (SELECT batch, ln(list_sum(list_transform(e, lambda y: exp(y)))) - e[label + 1] AS loss, len(list_filter(e, lambda y: y > e[label + 1])) AS above FROM m),
    b AS (SELECT batch, avg(loss) AS loss, count(*) AS n, count(*) FILTER (WHERE above < 1) AS c1, count(*) FILTER (WHERE above < 5) AS c5 FROM x GROUP BY batch)
    SELECT round(sum(loss * n) / sum(n), 6) AS loss, round(exp(sum(loss * n) / sum(n)), 6) AS perplexity, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(c1) AS BIGINT) AS correct1, CAST(sum(c5) AS BIGINT) AS correct5 FROM b"""
)
def mlm_evaluation(spark, d):
    """Loss, perplexity and tokens right at 1 and at 5 over masked positions; other positions and batches without a mask have no part. Vectors stand for a model's logits."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("batch"), F.when((F.col("vec_id") % 3 == 0) & (F.floor(F.col("vec_id") / 4) % 5 != 0), F.col("label")).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    return s.masked_metrics(rows, "batch", "label", "logits").select(*[F.round(c, 6).alias(c) for c in ("loss", "perplexity")], "tokens", "correct1", "correct5")


@query("SELECT CASE WHEN b < 205 THEN 'train' WHEN b < 230 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM (SELECT ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INTEGER AS b FROM documents) GROUP BY 1")
def split_80_10_10(spark, d):
    """A split by a hash of the key, the same in every run."""
    b = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2), 16, 10).cast("int")
    return table(spark, d, "documents").select(F.when(b < 205, "train").when(b < 230, "validation").otherwise("test").alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def seeded_sample(spark, d):
    """A repeatable sample of 100 rows, by the order of a hash."""
    return table(spark, d, "documents").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(100).select("doc_id", "lang")


@query("SELECT lang, arg_max(doc_id, n_chars * 10000000 - doc_id) AS best, CAST(max(n_chars) AS BIGINT) AS metric FROM documents GROUP BY lang")
def best_checkpoint(spark, d):
    """The row with the best metric, the earliest of equals."""
    return table(spark, d, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best"), F.max("n_chars").alias("metric"))


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN round(length(d.text) / 100.0, 2) END AS score FROM documents d LEFT JOIN labels l USING (doc_id)")
def scores_back(spark, d):
    """Scores of the valid rows only, written back to all rows."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    valid = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    scored = docs.join(valid, "doc_id").select("doc_id", F.round(F.length("text") / 100.0, 2).alias("score"))
    return docs.select("doc_id").join(scored, "doc_id", "left")


@query("SELECT '부윤' AS a, '부윤 엄' AS b")
def noun_stub(spark, d):
    """D18 without a tagger: Hangul words outside of brackets."""
    return values(spark, "a string, b string", [("부윤(府尹)", "부윤(府尹) 엄 嚴")]).select(t.noun_candidates(F.col("a")).alias("a"), t.noun_candidates(F.col("b")).alias("b"))
