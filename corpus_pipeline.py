"""A corpus pipeline: five stages over documents, each written before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame of all that it
keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, mixing, quality, secrets, simhash
from graphloom.llm.common import own_dir

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("secret scans", secrets.stage),
    ("mixing sources to target weights", mixing.stage),
    ("byte-level bpe", bpe.stage),
]
#: Classifier, SimHash and BPE are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each one's rows written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = own_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
