"""The training-data pipeline: quality rules, near-duplicate removal,
benchmark decontamination, mixing of sources, token-id files.

Each stage is written as Parquet in the shared folder and read again, so a
lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievekit.llm.decontaminate import drop_leaks
from sievekit.llm.mixing import apply_mix
from sievekit.llm.near_dedup import keep_one
from sievekit.llm.quality_rules import keep_good
from sievekit.llm.token_output import write_stage
from sievekit.sources.stage import checkpoint_stage

STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one),
    ("decontaminate", drop_leaks),
    ("mixing", apply_mix),
    ("token_output", write_stage),
]

# Similarity joins, seeded orders and a tokenizer have no SQL form; the run is
# tested against a brute-force version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = checkpoint_stage(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
