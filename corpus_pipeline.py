"""Corpus pipeline: quality, near duplicates, contamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. The quality classifier learns its model, so SQL cannot state the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, jaccard_join, mixing, quality, sharding
from larkspur.llm._shared import written

STAGES = [
    ("quality classifier", quality.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("sharding", sharding.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
