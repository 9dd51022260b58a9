"""The corpus pipeline: language ID, near-duplicates, repeated strings, PII, packing.

Every stage works on all that the one before it has kept, read again from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steleworks.llm import langid, packing, simhash, suffixes, surrogates
from steleworks.llm.common import cut, table

STAGES = [
    ("language_id", langid.stage),
    ("simhash_dedup", simhash.stage),
    ("suffix_dedup", suffixes.stage),
    ("pii_surrogates", surrogates.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL can't tell these stages; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
