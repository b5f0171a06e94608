"""Sharding by a keyed permutation of global row numbers.

Rows get numbers 0 to n-1 in the order of (doc_id, size, crc). A Feistel network permutes the power
of four that holds n; a value of n or more is sent through again until it is below n (cycle walking),
which keeps the map one to one on 0..n-1. The permuted number p gives shard p mod k and slot p div k,
so counts differ by one at most, slots have no gaps, and anyone who knows n, k and the seed can
compute a row's place, or a place's row, without the table.

Null texts have size 16 and the checksum of no bytes. Rows alike in every column may swap places with
each other only. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import mix
from .storage import stored

ROUNDS = 6
OVERHEAD = 16


def _network(x: np.ndarray, half: int, seed: int, forward: bool) -> np.ndarray:
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> width, x & mask
    for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        if forward:
            left, right = right, left ^ (mix(right + key) & mask)
        else:
            left, right = right ^ (mix(left + key) & mask), left
    return (left << width) | right


def permute(x: np.ndarray, n: int, seed: int, forward: bool = True) -> np.ndarray:
    """The permutation of 0..n-1 (or, backward, its inverse) at each x."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    x = _network(np.asarray(x, np.uint64), half, seed, forward)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], half, seed, forward)
    return x


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Add a gapless number by `order`, without bringing rows into one task.

    The sorted rows are written once, so that later readers see the same partitions; each partition's
    start comes from one count per partition.
    """
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)),
        "numbered",
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start")
    )
    # one row per partition of the sort: thousands at most
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def assign(docs: DataFrame, shards: int = 40, seed: int = 2024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_no of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    numbered = number_rows(base, ["doc_id", "size", "text_crc32"])
    n = numbered.count()

    @F.pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), n, seed).astype(np.int64))

    return numbered.withColumn("_p", place("row_no")).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
