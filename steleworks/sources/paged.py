"""A list that comes in pages, as a Python data source: one partition for each page.

    spark.dataSource.register(PagedList)
    spark.read.format("paged_list").option("template", "file:///lists/{page}.html").option("pages", 55).load()

A page that can't be read has a row with its error instead of items, so that one
broken page doesn't stop the others; a page without items has a row without either.
"""

from __future__ import annotations

import re
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: what an item of a list page looks like; its id is the first group.
ITEM = r"""fnSearchDetailClick\('(.+?)'\)"""


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.template, self.pages = options["template"], int(options.get("pages", 1))
        self.pattern, self.timeout = options.get("pattern", ITEM), float(options.get("timeout", 30))

    def partitions(self):
        return [Page(k) for k in range(1, self.pages + 1)]

    def read(self, partition):
        url = self.template.replace("{page}", str(partition.number))
        try:
            with urllib.request.urlopen(url, timeout=self.timeout) as r:
                source = r.read().decode("utf-8", "replace")
        except (OSError, ValueError) as e:
            yield (partition.number, None, None, type(e).__name__)
            return
        items = re.findall(self.pattern, source)
        for k, item in enumerate(items):
            yield (partition.number, k, item, None)
        if not items:
            yield (partition.number, None, None, None)


class PagedList(DataSource):
    @classmethod
    def name(cls):
        return "paged_list"

    def schema(self):
        return "page int, ordinal int, item string, error string"

    def reader(self, schema):
        return PagedReader(self.options)


def until_empty(rows):
    """The items of the pages before the first one, from 1 on, that has neither items nor an error; each id once, where it comes first.

    A page with an error is passed over: it has no items and ends nothing.
    """
    from pyspark.sql import functions as F

    full = rows.filter("item IS NOT NULL")
    passed = rows.filter("item IS NOT NULL OR error IS NOT NULL").select("page").distinct()
    first = rows.sparkSession.range(1).select(F.lit(1).cast("int").alias("page"))
    stop = first.unionByName(passed.select((F.col("page") + 1).cast("int").alias("page"))).join(passed, "page", "left_anti").filter("page >= 1").agg(F.min("page").alias("stop"))
    kept = full.crossJoin(F.broadcast(stop)).filter("page >= 1 AND page < stop")
    return kept.groupBy("item").agg(F.min(F.struct("page", "ordinal")).alias("at")).select("item", "at.page", "at.ordinal")
