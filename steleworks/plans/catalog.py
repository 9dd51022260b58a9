"""Catalogue, joins, sets and incremental processing (A25, A26, B04-B10, H, J, M, O of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from .base import query, table


@query("SELECT user_id, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_type FROM events GROUP BY user_id")
def status_latest(spark, d):
    """An event log as a table; the last entry wins."""
    return c.latest(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS retries, max(ts) AS last_ts FROM events GROUP BY user_id")
def status_retries(spark, d):
    """Retries are a count over the log."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("retries"), F.max("ts").alias("last_ts"))


_LOG = "CASE event_type WHEN 'error' THEN 'ERROR:ValueError' WHEN 'view' THEN 'KEEP' ELSE 'SKIP' END"


@query(
    f"""WITH log AS (SELECT user_id, arg_max(s, k) AS status FROM (SELECT user_id, {_LOG} AS s, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0') AS k FROM events WHERE value < 20) GROUP BY user_id)
    SELECT user_id, CASE WHEN status IS NULL THEN 'process' WHEN status LIKE 'ERROR%' THEN 'retry' WHEN status = 'KEEP' THEN 'recover' ELSE 'skip' END AS action FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN log USING (user_id)"""
)
def resume_plan(spark, d):
    """What a rerun does with every item."""
    events = table(spark, d, "events")
    log = c.latest(events.filter("value < 20").withColumn("status", F.expr(_LOG)), "user_id", "status", "ts", "event_id")
    return c.resume_plan(events.select("user_id").distinct(), log, "user_id").select("user_id", "action")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value <= 50 ORDER BY event_id LIMIT 200")
def pending_queue(spark, d):
    """The next 200 of the queue."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", "pending").otherwise("completed").alias("status"), F.when(F.col("value") <= 50, 1).otherwise(11).alias("retries"))
    return c.pending(rows, None, 10, 200, "event_id").select("event_id", "user_id")


@query(
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'new' ELSE source END AS source, lang, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS version FROM documents
    UNION ALL SELECT doc_id + 1000000, 'new', NULL, 2 FROM documents WHERE lang = 'de' AND n_chars > 2000"""
)
def doc_upsert(spark, d):
    """New rows enrich old ones of the same key; what they lack stays."""
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", "source", "lang").withColumn("version", F.lit(1))
    newer = [F.lit("new").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(2).alias("version")]
    changed = docs.filter("lang = 'de'").select("doc_id", *newer)
    added = docs.filter("lang = 'de' AND n_chars > 2000").select((F.col("doc_id") + 1000000).alias("doc_id"), *newer)
    return c.upsert(old, changed.unionByName(added), "doc_id", F.col("version"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seen_anti(spark, d):
    """Rows whose key has not been seen."""
    return c.unseen(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT count(*) FILTER (WHERE hit) AS moved, count(*) FILTER (WHERE NOT hit) AS missing FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS hit FROM documents)")
def file_semi(spark, d):
    """Rows found in a listing are moved, the others are missing."""
    docs = table(spark, d, "documents").select("doc_id")
    listing = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return docs.join(listing, "doc_id", "left").agg(F.count_if("hit").alias("moved"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query(
    """SELECT doc_id, 'raw/' || doc_id || '.txt' AS source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'keep/' || doc_id || '.txt' END AS target,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'move' ELSE 'missing' END AS action FROM documents"""
)
def move_manifest(spark, d):
    """What a file job copies or moves, row by row, and what it can't find."""
    listing = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    return c.manifest(table(spark, d, "documents").select("doc_id"), listing, "doc_id", "raw/%s.txt", "keep/%s.txt", "move")


_TYPE = "CASE event_type WHEN 'view' THEN 'image/png' WHEN 'click' THEN 'IMAGE/JPEG' ELSE 'text/html' END"


@query(
    f"""WITH x AS (SELECT event_id, 'img' || user_id || '.png' AS file_path, {_TYPE} AS type, CAST(floor(value * 20) AS BIGINT) AS file_size FROM events)
    SELECT arg_min(event_id, event_id) AS id, file_path, arg_min(file_size, event_id) AS file_size FROM x WHERE lower(type) LIKE 'image/%' AND file_size >= 256 GROUP BY file_path"""
)
def image_rows(spark, d):
    """Rows of saved images: the first download of each file that is an image of 256 bytes or more; later ones have been seen."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("img"), F.col("user_id"), F.lit(".png")).alias("file_path"), F.expr(_TYPE).alias("content_type"), F.floor(F.col("value") * 20).alias("file_size"))
    return c.saved_images(rows, "file_path", "content_type", "file_size", "id").select("id", "file_path", "file_size")


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE '?' END AS grade FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_default(spark, d):
    """A lookup with a default."""
    grades = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("grade"))
    return c.lookup(table(spark, d, "documents").select("doc_id"), grades, "doc_id", "grade", "?")


@query("SELECT o_orderkey, count(l_linenumber) AS children, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def fk_fanout(spark, d):
    """Parents with their children."""
    child = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("children"), F.sum("l_quantity").alias("quantity"))
    zero = lambda n: F.coalesce(n, F.lit(0))
    return table(spark, d, "orders").select("o_orderkey").join(child, "o_orderkey", "left").select("o_orderkey", zero("children").alias("children"), F.round(zero("quantity"), 2).alias("quantity"))


@query("SELECT conv_id, turn, e.n AS entry_turns, t.text AS piece FROM conversations t JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) e USING (conv_id)")
def entry_fanout(spark, d):
    """Every child carries what its parent has."""
    rows = table(spark, d, "conversations")
    return rows.join(rows.groupBy("conv_id").agg(F.count("*").alias("entry_turns")), "conv_id").select("conv_id", "turn", "entry_turns", F.col("text").alias("piece"))


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS left_over")
def fk_check(spark, d):
    """Rows without a parent, and what a cascade leaves."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    a = c.orphans(lines, orders, "o_orderkey").agg(F.count("*").alias("orphans"))
    return a.crossJoin(F.broadcast(c.cascade(lines, orders.filter("o_orderstatus = 'F'"), "o_orderkey").agg(F.count("*").alias("left_over"))))


@query("SELECT l_orderkey, a AS line, b AS caption FROM (SELECT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b, row_number() OVER (PARTITION BY x.l_orderkey, x.l_linenumber ORDER BY y.l_extendedprice - x.l_extendedprice, y.l_linenumber) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_extendedprice > x.l_extendedprice) WHERE n = 1")
def nearest_caption(spark, d):
    """Of the boxes below an image in the same page, the nearest; a range join within a key."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("y"))
    both = x.join(x.select("l_orderkey", F.col("line").alias("other"), F.col("y").alias("below")), "l_orderkey").filter("below > y")
    return both.groupBy("l_orderkey", "line").agg(F.min_by("other", F.struct(F.col("below") - F.col("y"), "other")).alias("caption"))


@query("SELECT r_name AS period, range AS page FROM region, range(1, 56)")
def page_grid(spark, d):
    """Configuration by pages."""
    return table(spark, d, "region").select(F.col("r_name").alias("period"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(55).cast("long"))).alias("page"))


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) UNION ALL SELECT 'distinct', count(*) FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT n_nationkey FROM nation INTERSECT SELECT r_regionkey FROM region) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region)"""
)
def distinct_union(spark, d):
    """J01-J04."""
    a, b = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union", a.unionByName(b)).unionByName(n("distinct", a.union(b).distinct())).unionByName(n("intersect", a.intersect(b))).unionByName(n("except", a.subtract(b)))


@query("SELECT source, lang, min(doc_id) AS first_seen FROM documents GROUP BY ALL")
def first_seen(spark, d):
    """Distinct values with where they come first."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first_seen"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 'SKIP' WHEN contains(text, '@') THEN 'ERROR:ValueError' ELSE 'KEEP' END AS status FROM documents")
def isolated_items(spark, d):
    """A function for each item whose exceptions become the item's status."""

    def first_word(x: str) -> str:
        if "@" in x:
            raise ValueError(x)
        return x[:20]

    return table(spark, d, "documents").select("doc_id", c.isolated(first_word)("text").alias("r")).select("doc_id", "r.status")


@query("SELECT strftime(ts, '%Y%m%d_%H') AS run, count(*) AS n, CAST(min(epoch_us(ts) // 1000) AS BIGINT) AS first_ms FROM events GROUP BY 1")
def run_names(spark, d):
    """Names of runs from times, milliseconds."""
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyyMMdd_HH").alias("run")).agg(F.count("*").alias("n"), F.min(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("first_ms"))


@query("SELECT user_id, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def stream_status(spark, d):
    """The status table as a stream keeps it, micro-batch by micro-batch, exactly once."""
    from ..streaming.status import run_status

    return run_status(spark, f"{d}/events.parquet")
