"""A corpus from documents to packed sequences; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumispec.llm import jaccard, packing, pii, quality
from lumispec.llm.common import stored, table

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("PII", pii.stage),
    ("best-fit packing", packing.stage),
]

#: Line-first cleaning, MinHash and packing have no SQL form. tests/llm holds run()'s join against brute force and calls
#: the other stages' operators by hand; those have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
