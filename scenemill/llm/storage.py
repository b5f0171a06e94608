"""The folder that driver and executors share, and tables written there to cut lineage.

A written table outlives a lost executor, and what Python computed once is not computed again for
each reader. Tables stay until the folder is cleared, as a cluster does with its checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs on this machine alone, as in tests, a folder here is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scenemill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as a long. One of another type is an error: it would turn to null in silence."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{name} must be an integer, not {kind.simpleString()}")
    return F.col(name).cast("long").alias(name)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
