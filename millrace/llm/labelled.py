"""A bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import uniform


def graded(labels: DataFrame) -> DataFrame:
    """One row a document: the worst of repeated labels; rows with nulls are left out."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, seed: int) -> DataFrame:
    """(doc_id, text, quality, toxic) of about ``bound`` labelled documents, and 2 *
    ``bound`` at most, the same ones on each run; of rows that share an id one text.
    The labels' side has a proven bound, so it is broadcast and the documents are
    read once; only the picked ones are shuffled."""
    rows = graded(labels)
    n = rows.count()
    share = min(1.0, bound / max(n, 1))
    picked = rows.filter(uniform(F.lit(seed), "doc_id") < share).limit(2 * bound)
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality", "toxic")
