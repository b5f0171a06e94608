"""A training corpus from `documents`: quality, near copies, repeats, leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. Every stage but
the last returns the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenemill.llm import bpe, leaks, nearcopies, quality, repeats
from scenemill.llm.storage import free_name, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_score")
    return quality.score(docs, model, name).where(F.col(name) >= 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies."""
    return nearcopies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand earlier; a document of which nothing is left goes, and n_chars follows."""
    empty = free_name(docs, "_empty")
    was_empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    cut = repeats.without_repeats(docs.withColumn(empty, was_empty)).where(F.col(empty) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to."""
    return bpe.tokens(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_each),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("tokens", tokenize),
]

# SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"pipeline-{name}")
    return docs
