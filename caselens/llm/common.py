"""Helpers the text operators share: the shared scratch folder, staged tables, bounded broadcasts and graph components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when its rows are counted and measured to be within this.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="caselens-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back; cuts lineage and survives lost executors.

    All tables of an application stand in one folder, caselens/<application id>, which can go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/caselens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a table whose measured size is within the bound; otherwise a shuffled join. Of numbers and strings only."""
    strings = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for f in df.schema):
        return df
    per_row = 16 + 8 * len(df.columns)
    size = df.agg(F.sum(sum(strings, F.lit(per_row)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def text_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, UTF-8 bytes) of a text column, for choosing numbers of blocks."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()
    return n, size


def blocks_for(size: int, block_bytes: int) -> int:
    return max(1, math.ceil(size / block_bytes))


def slices(batch: pa.RecordBatch, column: int | str, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, and so many bytes in a text column unless one text alone has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of edges (a, b) as (node, comp), comp being the smallest node.

    Alternating large-star and small-star steps: every node points its larger neighbours, then its
    smaller ones, at the smallest node it knows, until nothing changes. Each step is two grouped minima
    and two equi-joins, so a node with very many neighbours is only ever aggregated, never gathered.
    Smallest nodes themselves are not listed.
    """
    e, before = stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    ), None
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        before, e = e, stage(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        unstage(before)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = now


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the CRC-32 of an expression's ASCII text: eight steps a byte, the first of which takes the byte in."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    step = "case when xor(h, x) % 2 = 1 then xor(xor(h, x) // 2, 3988292384) else xor(h, x) // 2 end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda h, x: {step}), 4294967295)"
