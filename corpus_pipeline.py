"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. SQL cannot express the models, so there is no ORACLE_SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.shared import scratch
from millrace.llm import mixing, neardup, packing, quality, secrets
from millrace.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is under the limit go."""
    return quality.select_documents(docs, *quality.fit(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 connect, the one of smallest id stays."""
    return neardup.without_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    out = secrets.mask_secrets(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 over sources,
    150 % of all words, two passes at most."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between is written to the shared folder."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
