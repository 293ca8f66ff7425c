"""A pipeline over documents made of the operators of verbaline.llm."""

from __future__ import annotations

from verbaline.llm import mixing, packing, quality, secrets, simhash
from verbaline.llm.common import written

STAGES = [
    ("quality_classifier", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("secret_scan", secrets.stage),
    ("source_mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL cannot express the models, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages in turn over all documents; each result is written and read again, and nothing is sampled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
