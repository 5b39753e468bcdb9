"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``
for the documents that they keep. ``run`` writes the result of each stage as a table in the shared folder and reads it
for the next, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import delete, scratch
from tessera.llm.decontaminate import decontamination_stage
from tessera.llm.jaccard import jaccard_stage
from tessera.llm.packing import packing_stage
from tessera.llm.quality import quality_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Token ids are not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep. Null, empty and repeated texts, null ids, empty tables and further
    columns, whatever their names, are handled as the stages' modules say; a stage's table is removed when the next is
    written, and the last one, which the result reads, by ``tessera.llm.common.clean``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
