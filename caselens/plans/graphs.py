"""Connected components by joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="caselens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A broadcast hint for a kept table of few numbers or short names a row, if it has so many rows at most; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *keys: str, rows: int = 200_000) -> DataFrame:
    """df dealt by keys to as many tasks as keep about so many rows in each, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def dealt(df: DataFrame, tasks: int, rows: int) -> DataFrame:
    """df in so many tasks at most; dealt anew where one of its partitions holds more than `rows`, as that of a file which a single task has read."""
    most = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0
    return df.coalesce(tasks) if most <= rows else df.repartition(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of edges (a, b), comp being the smallest node that can be reached.

    In turns, every node hands its larger neighbours, then its smaller ones, to the smallest node that it knows, until nothing changes. The rounds grow with
    the logarithm of the longest way; a node with very many neighbours is only summed up.
    """
    ways = kept(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = ways.unionByName(ways.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ways = kept(smaller.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(ways.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            alone = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("u")).distinct().join(ways, "u", "left_anti").select("u", F.col("u").alias("v"))
            return ways.unionByName(ways.select(F.col("v").alias("u"), "v").distinct()).unionByName(alone).distinct().toDF("node", "comp")
        seen = now
