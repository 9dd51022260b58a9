"""Cleaning of the corpus and text functions (groups C and D of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.catalog import generated
from ..operators.cleaning import clean_corpus as clean_operator
from ..operators.cleaning import counts
from .base import query, table, values

_WS, _BLANK = t.SPACE, t.BLANK


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _clean_sql(removed: str, c: str = "text") -> str:
    x = f"regexp_replace(coalesce({c}, ''), {_sql(t.ILLEGIBLE)}, '{t.MARK}', 'g')"
    x = f"regexp_replace({x}, {_sql(removed)}, '', 'g')"
    x = f"regexp_replace({x}, {_sql('|'.join(t.NOISE))}, '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {_sql(_BLANK + '+')}, ' ', 'g'), {_sql(' *' + chr(10) + ' *')}, chr(10), 'g')"
    x = f"regexp_replace({x}, {_sql(f'^{_WS}+|{_WS}+$')}, '', 'g')"
    return f"regexp_replace(regexp_replace({x}, {_sql(_WS + '+')}, ' ', 'g'), {_sql(f'^{_WS}+|{_WS}+$')}, '', 'g')"


def _flat(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), {_sql(_WS + '+')}, ' ', 'g'), {_sql(f'^{_WS}+|{_WS}+$')}, '', 'g')"


@query(f"SELECT doc_id, preprocess, CAST(length(preprocess) AS INTEGER) AS n FROM (SELECT doc_id, {_clean_sql(t.REMOVED)} AS preprocess FROM documents) WHERE length(preprocess) >= 20")
def clean_corpus(spark, d):
    """The transcript cleaning as it is."""
    return clean_operator(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "preprocess", F.length("preprocess").alias("n"))


@query(f"SELECT doc_id, preprocess, CAST(length(preprocess) AS INTEGER) AS n FROM (SELECT doc_id, {_clean_sql(t.LATIN_REMOVED)} AS preprocess FROM documents) WHERE length(preprocess) >= 20")
def clean_corpus_latin(spark, d):
    """The same with a class for Latin script, which leaves the letters."""
    return clean_operator(table(spark, d, "documents").select("doc_id", "text"), "text", removed=t.LATIN_REMOVED).select("doc_id", "preprocess", F.length("preprocess").alias("n"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE n >= 20) AS kept, count(*) FILTER (WHERE n < 20) AS removed FROM (SELECT length({_clean_sql(t.REMOVED)}) AS n FROM documents)")
def clean_corpus_counts(spark, d):
    """Rows before and after the length filter, in one aggregate."""
    return counts(table(spark, d, "documents").select("text"), "text")


@query("SELECT doc_id, regexp_replace(text, '[\\p{P}\\p{Z}]', '', 'g') AS stripped FROM documents")
def strip_punct(spark, d):
    """D12."""
    return table(spark, d, "documents").select("doc_id", t.strip_punctuation(F.col("text")).alias("stripped"))


@query(
    """SELECT doc_id, round(CASE WHEN length(replace(text, ' ', '')) > 0 THEN length(regexp_replace(text, '[^é-ÿ]', '', 'g')) / CAST(length(replace(text, ' ', '')) AS DOUBLE) ELSE 0 END, 9) AS accent_ratio,
    regexp_matches(text, '[가-힣]') AS hangul FROM documents"""
)
def script_ratio(spark, d):
    """D07-D09 with another range, as the texts are in Latin script."""
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(t.cjk_ratio(c, "é-ÿ"), 9).alias("accent_ratio"), t.has_hangul(c).alias("hangul"))


_RATIOS = [("府尹 碑", 1.0), ("서울 碑", 1 / 3), ("abc府", 0.25), ("", 0.0)]


@query("SELECT * FROM (VALUES ('府尹 碑', 1.0::DOUBLE, false), ('서울 碑', 0.333333::DOUBLE, true), ('abc府', 0.25::DOUBLE, false), ('', 0.0::DOUBLE, false)) AS v(s, ratio, hangul)")
def cjk_ratio_values(spark, d):
    """D07-D09 on literal rows."""
    return values(spark, "s string", [(s,) for s, _ in _RATIOS]).select("s", F.round(t.cjk_ratio(F.col("s")), 6).alias("ratio"), t.has_hangul(F.col("s")).alias("hangul"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM part")
def slugify_title(spark, d):
    """D10 for ASCII names."""
    return table(spark, d, "part").select("p_partkey", t.slug_ascii(F.col("p_name")).alias("slug"))


@query("SELECT * FROM (VALUES ('Report No.3 (Café)', 'report_no_3_cafe'), ('A-01 碑 v2.0', 'a_01_v2_0'), ('서울 봉은사', '')) AS v(s, slug)")
def slugify_unicode(spark, d):
    """D10 with decomposition: a batched Python function, as Spark has no NFKD."""
    return values(spark, "s string", [("Report No.3 (Café)",), ("A-01 碑 v2.0",), ("서울 봉은사",)]).select("s", t.slug("s").alias("slug"))


@query("SELECT * FROM (VALUES ('① 앞면(前)', '앞면'), ('후面', '뒷면'), ('우측면', '오른쪽면'), ('명문', '명문'), ('비문 ', '비문'), ('앞 면', NULL), ('설명', NULL), ('123', NULL)) AS v(s, face)")
def caption_normalize(spark, d):
    """Captions of faces."""
    rows = ["① 앞면(前)", "후面", "우측면", "명문", "비문 ", "앞 면", "설명", "123"]
    return values(spark, "s string", [(r,) for r in rows]).select("s", t.caption(F.regexp_replace("s", "面", "면")).alias("face"))


_PUNCT = [(",", ","), ("、。", "。"), ("?!", "?"), ("..?", "。"), ("』", ""), (":-.", ","), ("!", "。"), ("", "")]


@query("SELECT s, r AS reduced, regexp_replace(r, '([!:,?。])', '\\1 ', 'g') AS spaced FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PUNCT) + ") AS v(s, r)")
def punct_reduce(spark, d):
    """D13-D15."""
    rows = values(spark, "s string", [(a,) for a, _ in _PUNCT]).withColumn("reduced", t.reduce_punctuation(F.col("s")))
    return rows.withColumn("spaced", t.space_after(F.col("reduced")))


_MADE = "CASE WHEN turn % 3 = 0 THEN '음독: ' || text || chr(10) || '[최종 번역]: ' || text || chr(10) || 'end' WHEN turn % 3 = 1 THEN '[최종 번역] ' || text ELSE text END"


@query(
    f"""SELECT conv_id, turn, CASE WHEN contains(s, '[최종 번역]:') THEN split_part(regexp_replace(split_part(s, '[최종 번역]:', 2), {_sql(f'^{_WS}+|{_WS}+$')}, '', 'g'), chr(10), 1)
    WHEN contains(s, '[최종 번역]') THEN split_part(regexp_replace(split_part(s, '[최종 번역]', 2), {_sql(f'^{_WS}+|{_WS}+$')}, '', 'g'), chr(10), 1) ELSE s END AS translation
    FROM (SELECT conv_id, turn, {_MADE} AS s FROM conversations)"""
)
def parse_marker_output(spark, d):
    """The final translation after its marker; C10: rows come from a marked output."""
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_MADE.replace('chr(10)', 'char(10)')} AS s")
    return rows.select("conv_id", "turn", t.final_translation(F.col("s")).alias("translation"))


@query(f"SELECT s, {_flat(chr(40) + 'regexp_replace(s, ' + _sql(chr(92) + '([^)]*[一-鿿][^)]*' + chr(92) + ')') + ', ' + repr('') + ', ' + repr('g') + ')' + chr(41))} AS plain FROM (VALUES ('부윤(府尹) 엄 상공(嚴相公)의 (note) 비'), ('a (b) c'), ('(漢)')) AS v(s)")
def gloss_removal(spark, d):
    """D17."""
    return values(spark, "s string", [("부윤(府尹) 엄 상공(嚴相公)의 (note) 비",), ("a (b) c",), ("(漢)",)]).select("s", t.drop_glosses(F.col("s")).alias("plain"))


@query("SELECT * FROM (VALUES ('公[MASK1]鼎[MASK22]', '公[MASK]鼎[MASK]', true), ('[MASK]', '[MASK]', false), ('▨', '▨', false)) AS v(s, plain, numbered)")
def mask_normalize(spark, d):
    """D20."""
    return values(spark, "s string", [("公[MASK1]鼎[MASK22]",), ("[MASK]",), ("▨",)]).select("s", t.plain_masks(F.col("s")).alias("plain"), F.col("s").rlike(r"\[MASK\d+\]").alias("numbered"))


@query(
    """SELECT doc_id, CASE source WHEN 'src0' THEN 'KYU' WHEN 'src1' THEN 'HIS' WHEN 'src2' THEN 'NRI' ELSE 'UNK' END || '_' || doc_id AS key,
    doc_id || '_' || CASE WHEN doc_id % 2 = 0 THEN 'transcript' ELSE 'summary' END || '.txt' AS file,
    CASE WHEN doc_id % 2 = 0 THEN 'transcriptions' ELSE 'texts' END AS folder, CAST(length(text) AS INTEGER) AS char_count, substr(text, 1, 100) AS preview FROM documents WHERE text <> ''"""
)
def derived_keys(spark, d):
    """Keys by prefix, file names, folder with default; empty contents are left out."""
    prefix = F.create_map(*[F.lit(x) for kv in {"src0": "KYU", "src1": "HIS", "src2": "NRI"}.items() for x in kv])
    folder = F.create_map(*[F.lit(x) for kv in {"transcript": "transcriptions", "translation": "translations", "punctuated": "punctuated"}.items() for x in kv])
    kind = F.when(F.col("doc_id") % 2 == 0, "transcript").otherwise("summary")
    return table(spark, d, "documents").filter("text <> ''").select(
        "doc_id",
        F.concat_ws("_", F.coalesce(F.try_element_at(prefix, F.col("source")), F.lit("UNK")), F.col("doc_id")).alias("key"),
        F.format_string("%s_%s.txt", "doc_id", kind).alias("file"),
        F.coalesce(F.try_element_at(folder, kind), F.lit("texts")).alias("folder"),
        F.length("text").alias("char_count"),
        F.substring("text", 1, 100).alias("preview"),
    )


@query(
    """SELECT doc_id, coalesce(nullif(concat_ws(chr(10), nullif(a, ''), nullif(b, '')), ''), '[EMPTY]') AS body, split_part(text, ' ', 1) AS first_word, replace(text, ' ', '') AS tight
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS a, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS b FROM documents)"""
)
def join_parts(spark, d):
    """Non-empty parts as lines with a sentinel; first token; without spaces."""
    rows = table(spark, d, "documents").selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS a", "CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS b")
    return rows.select("doc_id", t.joined_lines(F.col("a"), F.col("b")).alias("body"), F.split_part("text", F.lit(" "), F.lit(1)).alias("first_word"), F.replace("text", F.lit(" "), F.lit("")).alias("tight"))


@query("SELECT doc_id, '<example>' || chr(10) || '<new_translation>' || chr(10) || '<input>' || text || '</input>' || chr(10) || '<output>' AS prompt FROM documents WHERE trim(text) <> ''")
def prompt_assembly(spark, d):
    """Prompts around non-blank texts; a generator is plugged in after this."""
    return table(spark, d, "documents").filter(F.trim("text") != "").select("doc_id", F.concat(F.lit("<example>\n<new_translation>\n<input>"), F.col("text"), F.lit("</input>\n<output>")).alias("prompt"))


def _echo():
    def generate(prompt: str) -> str:
        if "@" in prompt:
            raise ValueError("the stand-in refuses addresses")
        return f"[최종 번역]: {prompt}"

    return generate


@query("SELECT conv_id, turn, CASE WHEN text IS NULL OR contains(text, '@') THEN '' ELSE trim('[최종 번역]: ' || text) END AS output FROM conversations")
def generated_rows(spark, d):
    """A generator as a source of rows, '' where it fails; the stand-in gives its prompt back and refuses some."""
    return generated(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", _echo).select("conv_id", "turn", "output")


@query("SELECT doc_id, CAST(list_slice(string_split(text, ''), 1, 126) AS VARCHAR[]) AS tokens FROM documents")
def tokenize_map(spark, d):
    """Character tokens, cut to 126."""
    return table(spark, d, "documents").select("doc_id", F.slice(F.split("text", ""), 1, 126).alias("tokens"))
