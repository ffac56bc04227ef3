"""The corpus pipeline: five operators in order, each stage written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import best_fit_packing, jaccard_join, language_id, quality_rules, secret_scans
from sparkloom.llm.common import drop, save

STAGES = [
    ("quality rules", quality_rules.filter_stage),
    ("language ID", language_id.filter_stage),
    ("n-gram Jaccard join", jaccard_join.keep_one),
    ("secret scans", secret_scans.redact_stage),
    ("best-fit packing", best_fit_packing.pack_stage),
]

#: Language ID, the join's forest and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
