"""Kernels on small gray images: rows of pixels as arrays of whole numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# Densities of ink below and above which a mark is damaged as a whole.
SPARSE, DENSE = 0.05, 0.60


def _given(v: Column, f) -> Column:
    """f of a value that is computed once; named within another lambda, it would be computed for each element."""
    return F.transform(F.array(v), f)[0]


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def rescale(v: Column) -> Column:
    """Stretched to 0..255, cut to whole numbers; a flat image is all zero."""
    ends = F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    return _given(ends, lambda e: F.transform(v, lambda x: F.when(e["high"] > e["low"], F.floor((x - e["low"]) / (e["high"] - e["low"]) * 255)).otherwise(0).cast("int")))


def inverted(v: Column) -> Column:
    return F.transform(v, lambda x: 255 - x)


def bright(v: Column) -> Column:
    """With a bright background: inverted if the mean is below 127, and back if that doesn't help."""
    once = F.when(mean(v) < 127, inverted(v)).otherwise(v)
    return F.when(mean(once) < 127, inverted(once)).otherwise(once)


def counts(v: Column) -> Column:
    """Pixels of each gray value 0..255."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.size(F.filter(v, lambda x: x == b)))


def equalized(v: Column) -> Column:
    """Histogram equalisation: each value's share of pixels up to it, from the smallest one's on. One pass for each gray value, not for each pixel."""
    until = F.map_from_entries(F.transform(F.array_distinct(v), lambda b: F.struct(b, F.size(F.filter(v, lambda y: y <= b)))))
    fixed = F.struct(until.alias("until"), F.array_min(v).alias("least"), F.size(v).alias("n"))

    def one(x: Column, c: Column) -> Column:
        low = c["until"][c["least"]]
        return F.when(c["n"] > low, F.round((c["until"][x] - low) / (c["n"] - low) * 255)).otherwise(x).cast("int")

    return _given(fixed, lambda c: F.transform(v, lambda x: one(x, c)))


def otsu(v: Column) -> Column:
    """The threshold with the largest variance between the classes; of equal ones the smallest, of a flat image its gray value."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    whole = F.struct(F.size(v).alias("n"), total(v).alias("sum"))

    def below(b: Column) -> Column:
        return _given(F.filter(v, lambda x: x <= b), lambda p: F.struct((-b).alias("key"), F.size(p).alias("n"), total(p).alias("sum")))

    def spread(c: Column, all_: Column) -> Column:
        w, rest = c["n"], all_["n"] - c["n"]
        value = w * rest * F.pow(c["sum"] / w - (all_["sum"] - c["sum"]) / rest, F.lit(2.0))
        return F.struct(F.when((w > 0) & (rest > 0), value).alias("spread"), c["key"].alias("key"))

    classes = F.transform(F.array_distinct(v), below)
    return -_given(whole, lambda all_: F.array_max(F.transform(classes, lambda c: spread(c, all_))))["key"]


def density(v: Column, below: int = 128) -> Column:
    """Share of dark pixels."""
    return F.size(F.filter(v, lambda x: x < below)) / F.size(v)


def damage(d: Column) -> Column:
    return F.when((d < SPARSE) | (d > DENSE), "MASK1").otherwise("MASK2")


def with_margin(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, m: Column) -> Column:
    """A box with a margin, inside the image."""
    left, top = F.greatest(F.lit(0), x - m), F.greatest(F.lit(0), y - m)
    return F.struct(left.alias("x"), top.alias("y"), F.least(width - left, w + 2 * m).alias("w"), F.least(height - top, h + 2 * m).alias("h"))


def crop(image: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Part of an image that is an array of rows."""
    return F.transform(F.slice(image, y + 1, h), lambda r: F.slice(r, x + 1, w))


def least_area(height: Column, width: Column) -> Column:
    return F.greatest(F.lit(16), (height * width * 5e-5).cast("int"))


def three_channels(v: Column) -> Column:
    return F.transform(v, lambda p: F.array(p, p, p))


def standardized(v: Column, mean_: float = 0.5, std: float = 0.5) -> Column:
    return F.transform(v, lambda p: (p / 255 - F.lit(mean_)) / F.lit(std))


FOUND = StructType([StructField("success", BooleanType()), StructField("message", StringType()), StructField("bbox", ArrayType(IntegerType())), StructField("threshold", IntegerType()), StructField("binary", ArrayType(ArrayType(IntegerType())))])


def _grown(m: np.ndarray, low: bool) -> np.ndarray:
    """Erosion or dilation by a 3 x 3 square."""
    p = np.pad(m, 1, constant_values=low)
    parts = [p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)]
    return np.logical_and.reduce(parts) if low else np.logical_or.reduce(parts)


def _components(m: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of the 8-connected parts."""
    label, out = np.zeros(m.shape, int), []
    for y, x in zip(*np.nonzero(m), strict=True):
        if label[y, x]:
            continue
        label[y, x], stack, cells = 1, [(y, x)], []
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for c in range(max(0, a - 1), min(m.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(m.shape[1], b + 2)):
                    if m[c, d] and not label[c, d]:
                        label[c, d] = 1
                        stack.append((c, d))
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return out


def preprocess_one(rows: list[list[int]], margin: int = 1, least: int = 4) -> dict:
    """Gray image to binary: threshold, closing and opening, box around all parts that are large enough, crop."""
    try:
        g = np.array([list(r) for r in rows], np.int64)
        if g.ndim != 2 or not g.size:
            raise ValueError("no image")
        g = 255 - g if g.mean() < 127 else g
        values = np.unique(g)
        below = [(g <= b) for b in values[:-1]]
        spread = [m.sum() * (~m).sum() * (g[m].mean() - g[~m].mean()) ** 2 for m in below]
        threshold = int(values[int(np.argmax(spread))]) if spread else int(values[0])
        ink = g <= threshold if spread else np.zeros(g.shape, bool)
        closed = _grown(_grown(ink, False), True)
        parts = [c for c in _components(closed) if c[4] >= least]
        if not parts:
            return {"success": False, "message": "no region", "bbox": None, "threshold": threshold, "binary": None}
        x1, y1 = min(c[0] for c in parts), min(c[1] for c in parts)
        x2, y2 = max(c[0] + c[2] for c in parts), max(c[1] + c[3] for c in parts)
        x1, y1, x2, y2 = max(0, x1 - margin), max(0, y1 - margin), min(g.shape[1], x2 + margin), min(g.shape[0], y2 + margin)
        return {"success": True, "message": "", "bbox": [x1, y1, x2 - x1, y2 - y1], "threshold": threshold, "binary": np.where(ink, 0, 255)[y1:y2, x1:x2].tolist()}
    except (ValueError, TypeError) as e:
        return {"success": False, "message": str(e), "bbox": None, "threshold": None, "binary": None}


@pandas_udf(FOUND)
def preprocess(images: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([preprocess_one(x) for x in images], columns=[f.name for f in FOUND])
