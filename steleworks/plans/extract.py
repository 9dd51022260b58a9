"""Extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import html as h
from .base import query, table, values


@query("SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, nullif(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '') AS heading FROM pages")
def page_title(spark, d):
    """Null without a match."""
    c = F.col("html")
    return table(spark, d, "pages").select("page_id", t.first_group(c, "(?s)<title>(.*?)</title>").alias("title"), F.nullif(h.without_tags(F.regexp_extract(c, "(?s)<h1>(.*?)</h1>", 1)), F.lit("")).alias("heading"))


@query("""SELECT page_id, CAST(i AS INTEGER) AS ordinal, links[i] AS href, texts[i] AS label FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS links, regexp_extract_all(html, '(?s)<a(?:\\s[^>]*)?>(.*?)</a>', 1) AS texts FROM pages), LATERAL (SELECT unnest(range(1, len(links) + 1)) AS i)""")
def page_links(spark, d):
    """Links with their labels, in order."""
    c = F.col("html")
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.arrays_zip(h.attributes(c, "a", "href").alias("href"), h.tag_texts(c, "a").alias("label"))).alias("pos", "a"))
    return rows.select("page_id", (F.col("pos") + 1).alias("ordinal"), F.col("a.href").alias("href"), F.col("a.label").alias("label"))


_VISIBLE = "regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_a}', '{_b}')"


@query(f"SELECT page_id, trim(regexp_replace({_VISIBLE}, '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages")
def page_text(spark, d):
    """Visible text; what belongs to scripts, styles and comments is removed first."""
    return table(spark, d, "pages").select("page_id", h.visible_text(F.col("html")).alias("body"))


_REFERENCES = [("a &amp;lt; b", "a &lt; b"), ("caf&eacute; &#39;x&#x27;", "café 'x'"), ("&unknown; & &amp", "&unknown; & &amp"), ("&#128512;&NotEqualTilde;&#0;", "😀≂̸\ufffd"), ("&&gt;;", "&>;"), ("plain", "plain"), ("", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in _REFERENCES) + ") AS v(s, plain)")
def char_references(spark, d):
    """Character references of every kind, each decoded once."""
    return values(spark, "s string", [(a,) for a, _ in _REFERENCES]).select("s", h.decoded(F.col("s")).alias("plain"))


_ITEMS = """SELECT CAST(page_id + 1 AS INTEGER) AS page, CAST(i AS INTEGER) AS ordinal, links[i + 1] AS item FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS links FROM pages WHERE page_id % 17 <> 5 AND page_id < 150), LATERAL (SELECT unnest(range(0, len(links))) AS i)"""


@query(f"WITH x AS ({_ITEMS}), f AS (SELECT page + 1 AS page FROM (SELECT page FROM x UNION SELECT CAST(page_id + 1 AS INTEGER) FROM pages WHERE page_id % 17 = 5 UNION SELECT 0) WHERE page + 1 NOT IN (SELECT page FROM x UNION SELECT CAST(page_id + 1 AS INTEGER) FROM pages WHERE page_id % 17 = 5)) SELECT item, arg_min(page, page * 100000 + ordinal) AS page, arg_min(ordinal, page * 100000 + ordinal) AS ordinal FROM x WHERE page < (SELECT min(page) FROM f) GROUP BY item")
def list_until_empty(spark, d):
    """Items of a list in pages up to the first page without any; pages with an error (every 17th here) are passed over, and so end nothing."""
    from ..sources.paged import until_empty

    bad, page = F.col("page_id") % 17 == 5, (F.col("page_id") + 1).cast("int").alias("page")
    rows = table(spark, d, "pages").select("page_id", page, F.when(bad, "HTTPError").alias("error"), F.when(~bad & (F.col("page_id") < 150), h.attributes(F.col("html"), "a", "href")).otherwise(F.array().cast("array<string>")).alias("items"))
    return until_empty(rows.select("page", "error", F.posexplode_outer("items").alias("ordinal", "item")))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) <> '' AS has_title, CASE WHEN page_id % 4 = 1 THEN NULL ELSE length(html) END AS tab_chars, CASE WHEN page_id % 4 = 1 THEN 'HTTPError' END AS error FROM pages")
def detail_pages(spark, d):
    """An item's main page and its text tab, two requests by one id; an item whose tab fails keeps its error and stops no other."""
    main = table(spark, d, "pages").select("page_id", "html")
    tab = main.select("page_id", F.when(F.col("page_id") % 4 != 1, F.col("html")).alias("tab"))
    return main.join(tab, "page_id").select("page_id", t.first_group(F.col("html"), "(?s)<title>(.*?)</title>").isNotNull().alias("has_title"), F.length("tab").cast("long").alias("tab_chars"), F.when(F.col("tab").isNull(), "HTTPError").alias("error"))


@query("SELECT page_id, regexp_extract(html, 'track\\((\\d+)\\)', 1) AS id, split_part(split_part(url, '/', 3), ':', 1) AS host, CAST(try_cast(regexp_extract(url, 'page=(\\d+)', 1) AS INTEGER) AS INTEGER) AS page FROM pages")
def script_ids(spark, d):
    """Ids in handlers and scripts, page numbers."""
    c = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(c, r"track\((\d+)\)", 1).alias("id"), F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1)).alias("host"), F.regexp_extract("url", r"page=(\d+)", 1).try_cast("int").alias("page"))


@query(
    """SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
    coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '(\\.[^./]+)$', 1), ''), '.jpg') AS suffix,
    'http://x/ImageDown?imgFileNm=' || regexp_extract(url, '^https?://([^/?#]*)', 1) AS download FROM pages"""
)
def url_parts(spark, d):
    """D24-D27."""
    u = F.col("url")
    host = F.parse_url(u, F.lit("HOST"))
    return table(spark, d, "pages").select(
        "page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), host.alias("host"), F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit("")).alias("path"), F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"),
        t.url_suffix(u).alias("suffix"), F.concat(F.lit("http://x/ImageDown?imgFileNm="), F.url_encode(host)).alias("download"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def json_props(spark, d):
    """Values of JSON text, with a default."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("missing"))


@query("SELECT conv_id, string_agg(replace(text, chr(10), ''), '' ORDER BY turn) AS harvest FROM conversations GROUP BY conv_id")
def json_text_harvest(spark, d):
    """Texts of a nested document, in its order."""
    j = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", F.struct("text").alias("field")))).alias("fields"))).alias("j"))
    fields = F.from_json("j", "fields array<struct<turn:long,field:struct<text:string>>>")["fields"]
    return j.select("conv_id", F.array_join(F.transform(fields, lambda x: F.replace(x["field"]["text"], F.lit("\n"), F.lit(""))), "").alias("harvest"))


@query("SELECT conv_id, string_agg(replace(text, chr(10), ''), '' ORDER BY turn) AS harvest FROM conversations GROUP BY conv_id")
def json_text_harvest_any(spark, d):
    """The same from documents of any shape, by a table function that keeps the order of keys."""
    spark.udtf.register("json_texts", h.register_udtfs()["JsonTexts"])
    j = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", F.struct("text").alias("field")))).alias("fields"))).alias("j"))
    rows = spark.sql("SELECT conv_id, h.ordinal, h.text FROM {j} AS j, LATERAL json_texts(j.j) AS h", j=j)
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("harvest"))


@query("SELECT page_id, count(*) AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>', 0)) FROM pages) GROUP BY page_id")
def nested_elements(spark, d):
    """Elements of nested HTML by a table function; how many list items a page has."""
    spark.udtf.register("nested_text", h.register_udtfs()["NestedText"])
    pages = table(spark, d, "pages").select("page_id", "html")
    rows = spark.sql("SELECT p.page_id, n.tag FROM {pages} AS p, LATERAL nested_text(p.html) AS n WHERE n.tag = 'li'", pages=pages)
    return rows.groupBy("page_id").agg(F.count("*").alias("items"))


_SCRIPT = "var imgArr = [\"a.jpg\", \"b c.png\"];"


@query("SELECT * FROM (VALUES ('script', CAST(['a.jpg', 'b c.png'] AS VARCHAR[])), ('none', NULL)) AS v(name, images)")
def script_array(spark, d):
    """An array inside a script; null where there is none."""
    return values(spark, "name string, s string", [("script", f"<script>{_SCRIPT}</script>"), ("none", "<p>")]).select("name", h.json_array(F.col("s")).alias("images"))


@query("SELECT * FROM (VALUES ('https://x/3302/7', 1), ('https://x/3302/9', 2)) AS v(url, ordinal)")
def gallery_urls(spark, d):
    """Arguments of gallery anchors, kept by their fifth one, first seen of each URL."""
    rows = values(spark, "html string", [("<a onclick=\"view('1','a','7','x','3302')\"><a onclick=\"view('1','a','8','x','3301')\"><a onclick=\"view('1','b','7','x','3302')\"><a onclick=\"view('2','a','9','x','3302')\">",)])
    calls = rows.select(F.posexplode(F.regexp_extract_all("html", F.lit(r"view\(([^)]*)\)"), F.lit(1))).alias("pos", "call")).select("pos", h.unquoted_arguments(F.col("call")).alias("a"))
    urls = calls.filter(F.col("a")[4] == "3302").groupBy(F.concat_ws("/", F.lit("https://x"), F.col("a")[4], F.col("a")[2]).alias("url")).agg(F.min("pos").alias("pos"))
    from pyspark.sql import Window

    return urls.select("url", F.row_number().over(Window.orderBy("pos")).alias("ordinal"))


_LINES = [("p1", ["x", " 01 ", "서울 봉은사", "奉恩寺碑", "시대 조선", "제작연도 1856년 소재지 서울"]), ("p2", ["1", "본문"]), ("p3", ["02", "탑골", "◆", "x"])]


@query("SELECT * FROM (VALUES ('p1', '01', '서울 봉은사', '奉恩寺碑', '조선', '1856년'), ('p2', NULL, NULL, NULL, NULL, NULL), ('p3', '02', '탑골', NULL, NULL, NULL)) AS v(page, number, name, hanja, era, year)")
def entry_headings(spark, d):
    """Headings of entries and their metadata."""
    rows = values(spark, "page string, lines array<string>", _LINES)
    return rows.select("page", h.heading(F.col("lines"), t.CJK).alias("h"), h.metadata(F.col("lines")).alias("m")).select("page", "h.number", "h.name", "h.hanja", "m.era", "m.year")


_KEYS = [("d1", 1, "표제", "가"), ("d1", 2, "시대", "조선"), ("d1", 3, "표제2", "나"), ("d1", 4, "서체", "해서"), ("d2", 1, "서체/시대", "x"), ("d2", 2, "기타", "y")]


@query("SELECT * FROM (VALUES ('d1', '나', '조선', '해서'), ('d2', NULL, 'x', NULL)) AS v(doc_id, title, period, script_style)")
def metadata_pivot(spark, d):
    """Ordered contains-dispatch of key and value rows to columns; later rows overwrite."""
    rows = values(spark, "doc_id string, pos int, field string, value string", _KEYS)
    k, v, p = F.col("field"), F.col("value"), F.col("pos")
    return rows.groupBy("doc_id").agg(h.contains_dispatch(k, v, p, "title", ["표제"], []), h.contains_dispatch(k, v, p, "period", ["시대"], ["표제"]), h.contains_dispatch(k, v, p, "script_style", ["서체"], ["표제", "시대"]))


@query("SELECT * FROM (VALUES ('원문 텍스트', 'transcript'), ('번역문', 'translation'), ('해석문', 'translation')) AS v(label, text_type)")
def text_classification(spark, d):
    """Labels to text types; other labels and short rows are dropped."""
    rows = values(spark, "label string, cells int, buttons array<string>", [("원문 텍스트", 4, ["탁본 보기"]), ("번역문", 5, []), ("해석문", 4, []), ("번역문 2", 4, []), ("원문", 3, [])])
    kind = F.when(F.contains("label", F.lit("원문")), "transcript").when(F.col("label").isin("번역문", "해석문"), "translation")
    return rows.filter("cells >= 4").select("label", kind.alias("text_type"), F.exists("buttons", lambda b: F.contains(b, F.lit("탁본"))).alias("rubbing")).filter("text_type IS NOT NULL").select("label", "text_type")


@query("SELECT * FROM (VALUES ('p', 0, 0, 'a b', 9.5::DOUBLE), ('p', 0, 1, 'c', 12.0::DOUBLE)) AS v(page, block, line, text, size)")
def page_spans(spark, d):
    """Blocks of type 0, their lines and spans, as rows."""
    rows = values(spark, "page string, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string,size:double>>>>>>", [("p", [(0, [([("a ", 9.5), ("b", 9.5)],), ([("c", 12.0)],)]), (1, None)])])
    b = rows.select("page", F.posexplode("blocks").alias("block", "b")).filter("b.type = 0").select("page", "block", F.posexplode("b.lines").alias("line", "l"))
    return b.select("page", "block", "line", F.array_join("l.spans.text", "").alias("text"), F.array_max("l.spans.size").alias("size"))


@query("SELECT * FROM (VALUES ('a', 'MASK2', 0, 0, 4, 5)) AS v(image, type, x1, y1, x2, y2)")
def mask_items(spark, d):
    """Items of a result that are MASK2 and not empty after clamping."""
    rows = values(spark, "image string, results array<struct<order:int,type:string,box:array<double>>>", [("a", [(1, "MASK2", [-1.0, 0.0, 4.9, 5.0]), (2, "MASK1", [0.0, 0.0, 2.0, 2.0]), (3, "MASK2", [5.0, 5.0, 5.2, 9.0])])])
    r = rows.select("image", F.explode("results").alias("r")).select("image", "r.type", *[F.greatest(F.col("r.box")[i].cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return r.filter(F.contains("type", F.lit("MASK2")) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 9 ELSE 1 END AS margin, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '5' AS idx FROM events")
def map_merge(spark, d):
    """Options over defaults, later ones win; a map with whole-number keys."""
    defaults = F.create_map(F.lit("margin"), F.lit(1), F.lit("k"), F.lit(0))
    own = F.map_concat(F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("int")), F.when(F.col("event_type") == "view", F.create_map(F.lit("margin"), F.lit(9))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))))
    rows = table(spark, d, "events").select("event_id", own.alias("own"))
    both = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key("own", k)), F.col("own"))
    ids = F.transform_keys(F.create_map(F.lit("1"), F.lit("5")), lambda k, v: k.cast("int"))
    return rows.select("event_id", F.element_at(both, "margin").alias("margin"), F.element_at(both, "k").alias("k"), F.element_at(ids, 1).alias("idx"))
