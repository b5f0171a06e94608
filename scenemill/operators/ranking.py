"""Ranks and running sums over one global order, without bringing a group into one task.

Rows are range-partitioned and sorted, and checkpointed so that partitions stay what they are. A partition
runs over its own rows; what stands before or after it comes from one row per partition and group.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Through the folder in spark.checkpoint.dir; where it is unset and Spark runs on this machine alone, as in tests, one here is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def in_order(df: DataFrame, group: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """df sorted over all partitions, with `_part` and `_at`; of its columns only those in `keep`, if that is given, so that less is written."""
    keys = [F.col(c) for c in group] + order
    return checkpointed(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select(*(df.columns if keep is None else keep), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    )


def running(sorted_df: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add running sums (this row included) within each group of a frame made by in_order."""
    inner = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = sorted_df.select("*", *[F.sum(c).over(inner).alias(f"_l_{n}") for n, c in sums.items()])
    totals = sorted_df.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and group that has rows in it
    starts = totals.select("_part", *group, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    on = [local["_part"] == starts["_part"], *[local[g].eqNullSafe(starts[g]) for g in group]]
    both = local.join(starts.select(F.col("_part"), *group, *[f"_b_{n}" for n in sums]), on)
    return both.select(
        *[local[c] for c in sorted_df.columns], *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums]
    )


def best_from_here(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Add the greatest `value` from each row to the end of its group."""
    inner = Window.partitionBy("_part", *group).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)  # a running maximum from the end
    local = df.withColumn("_l", F.max(value).over(inner))
    tops = df.groupBy("_part", *group).agg(F.max(value).alias("_t"))
    after = Window.partitionBy(*group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = tops.select("_part", *group, F.max("_t").over(after).alias("_e"))
    on = [local["_part"] == ends["_part"], *[local[g].eqNullSafe(ends[g]) for g in group]]
    return local.join(ends, on).select(*[local[c] for c in df.columns], F.greatest("_l", "_e").alias(name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add 1, 2, ... over the whole table in `order`."""
    return running(in_order(df, [], order), [], {name: F.lit(1)}).drop("_part", "_at")
