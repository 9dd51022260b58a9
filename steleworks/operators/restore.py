"""Restoring masked places of images: items, crops, likeliest classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from .scores import softmax, top_k


def restored(items: DataFrame, keys: list[str], predict: Callable[[Column], Column], most: int = 10) -> DataFrame:
    """The `most` likeliest classes of each item of (keys, image, type, box): keys, rank, class, probability.

    An item counts if its type holds MASK2 and its box (x1, y1, x2, y2), cut to whole numbers
    of 0 and more, isn't empty. `image` is an array of rows; predict(crop) gives the logits.
    A null image or box gives no row.
    """
    x1, y1, x2, y2 = (F.greatest(F.col("box")[i].cast("int"), F.lit(0)) for i in range(4))
    rows = items.filter(F.contains("type", F.lit("MASK2")) & (x2 > x1) & (y2 > y1))
    crop = pixels.crop(F.col("image"), x1, y1, x2 - x1, y2 - y1)
    # A crop outside of the image has no pixels.
    rows = rows.select(*keys, crop.alias("crop")).filter(F.exists("crop", lambda r: F.size(r) > 0))
    logits = rows.select(*keys, predict(F.col("crop")).alias("logits"))
    top = logits.select(*keys, F.posexplode(top_k(softmax(F.col("logits")), most)).alias("pos", "t"))
    return top.select(*keys, (F.col("pos") + 1).alias("rank"), F.col("t.index").alias("class"), F.col("t.value").alias("probability"))
