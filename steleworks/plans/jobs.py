"""Whole jobs and table contracts (C05-C12, D38, F26, N05, N06 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.cleaning import require, target_column
from ..operators.scores import ngram_matches, sizes
from .base import query, table


@query("SELECT doc_id, text AS target, quality AS model_name_f1 FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL")
def column_contract(spark, d):
    """The wanted column or the first one, columns dropped if they are there, rows with nulls dropped, a column's slug."""
    rows = require(table(spark, d, "documents"), "doc_id", "text").drop("source", "lang", "not_there").join(table(spark, d, "labels"), "doc_id", "left")
    slug = "Model Name".replace(" ", "_").lower() + "_f1"
    return rows.na.drop(subset=["quality", "text"]).select("doc_id", F.col(target_column(rows, "text")).alias("target"), F.col("quality").alias(slug))


@query("SELECT lang, string_agg(doc_id, '' ORDER BY doc_id) AS joined FROM documents GROUP BY lang")
def joined_column(spark, d):
    """a column as one text, in order of the key, by group; a group's text is one value, so it has to fit in one task, as in the job itself."""
    g = table(spark, d, "documents").groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return g.select("lang", F.array_join(F.transform("ids", lambda x: x.cast("string")), "").alias("joined"))


_REPLY = "CASE WHEN item_id % 3 = 0 THEN 'x' || chr(10) || '[최종 번역]: ' || text || chr(10) || 'y' ELSE '[최종 번역] ' || substr(text, 6) END"


@query(
    f"""WITH s AS (SELECT item_id, text AS ref, {_REPLY} AS reply FROM benchmark WHERE trim(text) <> ''),
    p AS (SELECT item_id, string_split(regexp_replace(ref, '\\s', '', 'g'), '') AS r, string_split(regexp_replace(CASE WHEN contains(reply, '[최종 번역]:') THEN split_part(trim(split_part(reply, '[최종 번역]:', 2)), chr(10), 1) ELSE split_part(trim(split_part(reply, '[최종 번역]', 2)), chr(10), 1) END, '\\s', '', 'g'), '') AS h FROM s),
    g AS (SELECT item_id, unnest(h) AS gram, 'h' AS side FROM p UNION ALL SELECT item_id, unnest(r), 'r' FROM p),
    c AS (SELECT item_id, gram, count(*) FILTER (WHERE side = 'h') AS a, count(*) FILTER (WHERE side = 'r') AS b FROM g GROUP BY ALL)
    SELECT item_id, round(sum(least(a, b)) / min(len(h)), 6) AS precision, CAST(min(len(h)) AS INTEGER) AS hyp_size FROM c JOIN p USING (item_id) GROUP BY item_id"""
)
def translation_job(spark, d):
    """Source filter, generated output (a stand-in for the model) of every row, final translation, character precision; seeded_sample is the job's sample."""
    rows = table(spark, d, "benchmark").filter(F.trim("text") != "")
    made = rows.selectExpr("item_id", "text AS ref", f"{_REPLY.replace('chr(10)', 'char(10)')} AS reply").withColumn("hyp", t.final_translation(F.col("reply")))
    one = ngram_matches(made, ["item_id"], "hyp", "ref", 1)
    return one.join(made.select("item_id", sizes("hyp").alias("hyp_size")), "item_id").select("item_id", F.round(F.col("matched") / F.col("guessed"), 6).alias("precision"), "hyp_size")


_MASKED = "substr(md5(doc_id || '|' || pos), 1, 2) < '26'"


@query(
    f"""SELECT doc_id, count(*) FILTER (WHERE m) AS masked, count(*) AS tokens FROM (SELECT doc_id, {_MASKED} AS m FROM (SELECT doc_id, unnest(range(0, least(len(string_split(text, ' ')), 126))) AS pos FROM documents)) GROUP BY doc_id"""
)
def mlm_masking(spark, d):
    """15 % of the tokens are masked by a hash, labels elsewhere are left out; tokens are cut at 126."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", " "), 1, 126)).alias("pos", "token"))
    masked = F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("pos").cast("string")).cast("binary")), 1, 2) < "26"
    labelled = rows.withColumn("label", F.when(masked, F.col("token")))
    return labelled.groupBy("doc_id").agg(F.count("label").alias("masked"), F.count("*").alias("tokens"))
