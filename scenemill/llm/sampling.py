"""The labelled rows a model may learn from: a bounded sample of one side of a fixed split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000


def held_out() -> Column:
    """Whether a row's label may not be learned from: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """text and label of at most `limit` labelled documents, picked by the order of a hash of their ids.

    The bound holds for the rows a model is fitted on alone; scores are given to every document. Of an
    id labelled twice the greater label counts.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # `limit` rows of an id and a label: under 200 kB
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "label")
