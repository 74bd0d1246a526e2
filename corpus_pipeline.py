"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, token ids.

Each stage gets all documents that the stage before it kept, and its result is written as
Parquet in the shared folder and read again. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertweave.llm import stages
from alertweave.llm.common import materialize, prepare, table

STAGES = [
    ("quality classifier", stages.quality_classifier),
    ("line dedup", stages.line_dedup),
    ("SimHash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontamination),
    ("byte-level BPE", stages.encoding),
]

#: The classifier is fitted in the run, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
