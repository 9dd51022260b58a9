"""Image kernels (E07-E14, K09, K10, L02-L04 and F24, F25 of the inventory), on vectors as rows of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as p
from ..operators.restore import restored
from .base import query, table, values

#: Vectors as gray values, the same whole numbers in both engines.
_GRAY = "list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor(CAST(x AS DOUBLE) * 256 + 128))) AS INTEGER))"


def _gray(spark, d):
    px = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 256 + 128))).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", px.alias("px"))


@query(f"SELECT vec_id, list_transform(px, lambda x: CAST(CASE WHEN list_max(px) > list_min(px) THEN floor((x - list_min(px)) / CAST(list_max(px) - list_min(px) AS DOUBLE) * 255) ELSE 0 END AS INTEGER)) AS px FROM (SELECT vec_id, {_GRAY} AS px FROM embeddings)")
def minmax_rescale(spark, d):
    """E07."""
    return _gray(spark, d).select("vec_id", p.rescale(F.col("px")).alias("px"))


@query(f"SELECT vec_id, CASE WHEN list_avg(px) < 127 THEN list_transform(px, lambda x: CAST(255 - x AS INTEGER)) ELSE px END AS px FROM (SELECT vec_id, {_GRAY} AS px FROM embeddings)")
def polarity(spark, d):
    """E11."""
    return _gray(spark, d).select("vec_id", p.bright(F.col("px")).alias("px"))


@query(f"SELECT vec_id, list_transform(px, lambda x: CAST(CASE WHEN len(px) > len(list_filter(px, lambda y: y = list_min(px))) THEN round((len(list_filter(px, lambda y: y <= x)) - len(list_filter(px, lambda y: y = list_min(px)))) / CAST(len(px) - len(list_filter(px, lambda y: y = list_min(px))) AS DOUBLE) * 255) ELSE x END AS INTEGER)) AS px FROM (SELECT vec_id, {_GRAY} AS px FROM embeddings)")
def equalize_hist(spark, d):
    """E13."""
    return _gray(spark, d).select("vec_id", p.equalized(F.col("px")).alias("px"))


@query(
    f"""WITH h AS (SELECT vec_id, b, count(*) AS n FROM (SELECT vec_id, unnest({_GRAY}) AS b FROM embeddings) GROUP BY ALL),
    c AS (SELECT vec_id, b, sum(n) OVER w AS w0, sum(b * n) OVER w AS m0, sum(n) OVER (PARTITION BY vec_id) AS w1, sum(b * n) OVER (PARTITION BY vec_id) AS m1 FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY b)),
    s AS (SELECT vec_id, b, w0 * (w1 - w0) * pow(m0 / w0 - (m1 - m0) / (w1 - w0), 2) AS v FROM c WHERE w1 > w0) SELECT vec_id, CAST(b AS INTEGER) AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, b) = 1"""
)
def otsu_threshold(spark, d):
    """E12, K09."""
    return _gray(spark, d).select("vec_id", p.otsu(F.col("px")).cast("int").alias("threshold"))


@query(f"SELECT vec_id, round(ink, 6) AS ink, CASE WHEN ink < 0.05 OR ink > 0.6 THEN 'MASK1' ELSE 'MASK2' END AS damage FROM (SELECT vec_id, len(list_filter(px, lambda x: x < 100)) / CAST(len(px) AS DOUBLE) AS ink FROM (SELECT vec_id, {_GRAY} AS px FROM embeddings))")
def mask_class(spark, d):
    """E08, E09."""
    return _gray(spark, d).withColumn("ink", p.density(F.col("px"), 100)).select("vec_id", F.round("ink", 6).alias("ink"), p.damage(F.col("ink")).alias("damage"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, x - 5) AS x, greatest(0, y - 5) AS y, least(60 - greatest(0, x - 5), w + 10) AS w, least(60 - greatest(0, y - 5), 13) AS h, CAST(greatest(16, trunc(w * 1000 * 5e-5)) AS INTEGER) AS least_area FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS x, l_linenumber AS y, CAST(l_tax * 100 AS INTEGER) + 1 AS w FROM lineitem)")
def crop_margin(spark, d):
    """Boxes with a margin inside their image, and the least area of a part."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS INT) AS x", "l_linenumber AS y", "CAST(round(l_tax * 100) AS INT) + 1 AS w")
    box = p.with_margin(F.col("x"), F.col("y"), F.col("w"), F.lit(3), F.lit(60), F.lit(60), F.lit(5))
    return rows.select("l_orderkey", "l_linenumber", box.alias("b"), p.least_area(F.lit(1000), F.col("w")).alias("least_area")).select("l_orderkey", "l_linenumber", "b.*", "least_area")


@query(f"SELECT vec_id, list_transform(list_slice(px, 11, 14), lambda x: [x, x, x]) AS rgb, round((px[1] / 255.0 - 0.5) / 0.5, 6) AS first FROM (SELECT vec_id, {_GRAY} AS px FROM embeddings)")
def channels(spark, d):
    """A slice in three channels; standardised values."""
    return _gray(spark, d).select("vec_id", p.three_channels(F.slice("px", 11, 4)).alias("rgb"), F.round(F.element_at(p.standardized(F.col("px")), 1), 6).alias("first"))


@query("SELECT label, CAST(min(vec_id) AS BIGINT) AS x1, CAST(max(vec_id) AS BIGINT) AS x2, arg_max(vec_id, embedding[1]) AS largest FROM embeddings WHERE embedding[1] > 0 GROUP BY label")
def union_box(spark, d):
    """the union of boxes, and the largest."""
    return table(spark, d, "embeddings").filter(F.col("embedding")[0] > 0).groupBy("label").agg(F.min("vec_id").alias("x1"), F.max("vec_id").alias("x2"), F.max_by("vec_id", F.col("embedding")[0]).alias("largest"))


_IMAGE = [[255] * 8, [255] * 8, [255, 255, 0, 0, 0, 255, 255, 255], [255, 255, 0, 0, 0, 255, 255, 255], [255, 255, 0, 0, 0, 255, 255, 255], [255] * 8, [255] * 8, [255] * 8]


@query("SELECT * FROM (VALUES ('flat', false, 'no region', NULL), ('mark', true, '', CAST([1, 1, 5, 5] AS INTEGER[])), ('none', false, 'no image', NULL)) AS v(name, success, message, bbox)")
def unified_preprocess(spark, d):
    """Binary image and box of the writing; failures are rows of their own kind."""
    rows = values(spark, "name string, image array<array<int>>", [("flat", [[9, 9], [9, 9]]), ("mark", _IMAGE), ("none", [])])
    return rows.select("name", p.preprocess("image").alias("r")).select("name", "r.success", "r.message", "r.bbox")


@query(
    f"""WITH b AS (SELECT vec_id, px, CAST(px[1] % 6 - 1 AS INTEGER) AS x1, CAST(px[2] % 7 AS INTEGER) AS y1, CAST(px[1] % 6 - 1 + px[3] % 4 AS INTEGER) AS x2, CAST(px[2] % 7 + 3 AS INTEGER) AS y2 FROM (SELECT vec_id, {_GRAY} AS px FROM embeddings)
        WHERE len(list_filter(px, lambda x: x < 100)) / CAST(len(px) AS DOUBLE) BETWEEN 0.05 AND 0.6),
    c AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(px) AS v, greatest(x1, 0) AS x1, y1, greatest(x2, 0) AS x2, y2 FROM b),
    k AS (SELECT vec_id, CAST(floor(v / 16.0) AS INTEGER) AS class FROM c WHERE i % 8 >= x1 AND i % 8 < x2 AND i // 8 >= y1 AND i // 8 < y2),
    n AS (SELECT a.vec_id, a.class, count(k.class) AS n FROM (SELECT vec_id, CAST(unnest(range(0, 16)) AS INTEGER) AS class FROM (SELECT DISTINCT vec_id FROM k)) a LEFT JOIN k ON a.vec_id = k.vec_id AND a.class = k.class GROUP BY ALL)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, class) AS INTEGER) AS rank, class, round(exp(n) / sum(exp(n)) OVER (PARTITION BY vec_id), 6) AS probability FROM n QUALIFY rank <= 10"""
)
def mask_restore(spark, d):
    """Masked items, their crops, and the ten likeliest classes; the counts of 16 shades stand in for a model."""
    at = lambda i: F.element_at("px", i)
    box = F.array(at(1) % 6 - 1, at(2) % 7, at(1) % 6 - 1 + at(3) % 4, at(2) % 7 + 3)
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("px", i * 8 + 1, F.lit(8)))
    items = _gray(spark, d).select("vec_id", image.alias("image"), p.damage(p.density(F.col("px"), 100)).alias("type"), box.alias("box"))
    shades = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter(F.flatten(c), lambda x: F.floor(x / 16) == k)))
    return restored(items, ["vec_id"], shades).withColumn("probability", F.round("probability", 6))
