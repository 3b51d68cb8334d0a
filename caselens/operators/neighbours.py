"""What follows what in a case, however long the case is.

Most cases are short, and their logs are put in order together. Cases with more logs than a task should order are found by a sketch of the most frequent
cases, in one pass without a shuffle of all; their logs are dealt to ranges of (case, time), each a chunk of its own. A chunk's last log takes what
follows from the first log of the next chunk: the borders are a row for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.plans.graphs import few, kept

#: Logs of a case that are ordered together, and cases that a pass can hold to be longer.
LONG = 1_000_000
TRACKED = 1000
ORDER = ("ts", "log_seq")


def _name(case_col: str) -> Column:
    """A case as text that isn't null."""
    return F.coalesce(F.concat(F.lit("="), F.col(case_col).cast("string")), F.lit("-"))


def long_cases(logs: DataFrame, case_col: str = "case_id", long: int = LONG) -> dict[str, int]:
    """Cases with more than `long` logs, and their numbers of logs, as far as they have a thousandth of all; at most TRACKED.

    A sketch of ten times as many cases misses none that has a thousandth of the rows; what it finds is counted exactly.
    """
    tops = logs.select(_name(case_col).alias("case")).agg(F.expr(f"approx_top_k(case, {TRACKED}, {10 * TRACKED})").alias("top")).first()["top"] or []
    maybe = [r["item"] for r in tops if r["count"] > long]
    if not maybe:
        return {}
    counts = logs.where(_name(case_col).isin(maybe)).groupBy(_name(case_col).alias("case")).agg(F.count(F.lit(1)).alias("n"))
    return {r["case"]: r["n"] for r in counts.where(F.col("n") > long).collect()}  # TRACKED at most


def chunked(logs: DataFrame, case_col: str = "case_id", order: tuple[str, ...] = ORDER, long: int = LONG) -> tuple[DataFrame, bool]:
    """(logs with chunk, whether any case has several): chunks of a case follow one another in its order."""
    hot = long_cases(logs, case_col, long)
    if not hot:
        return logs.withColumn("chunk", F.lit(0)), False
    is_hot = _name(case_col).isin(list(hot))
    dealt = logs.where(is_hot).repartitionByRange(max(2, -(-2 * sum(hot.values()) // long)), case_col, *order).withColumn("chunk", F.spark_partition_id())
    return logs.where(~is_hot).withColumn("chunk", F.lit(0)).unionByName(kept(dealt)), True


def followed(logs: DataFrame, carried: tuple[str, ...], first: tuple[str, ...] = (), case_col: str = "case_id", order: tuple[str, ...] = ORDER, long: int = LONG) -> DataFrame:
    """logs with next, a struct of the carried columns of the case's next log (null for the last), and first, one of the columns `first` of its first log."""
    rows, several = chunked(logs, case_col, order, long)
    window = Window.partitionBy(case_col, "chunk").orderBy(*order)
    out = rows.withColumn("next", F.lead(F.struct(*carried)).over(window)).withColumn("first", F.first(F.struct(*first)).over(window) if first else F.lit(None))
    if not several:
        return out.drop("chunk")
    place = F.struct(*order)
    edges = rows.groupBy(case_col, "chunk").agg(F.min_by(F.struct(*carried), place).alias("head"), *([F.min_by(F.struct(*first), place).alias("start")] if first else []))
    along = Window.partitionBy(case_col).orderBy("chunk")  # a row for each chunk
    edges = edges.select(F.col(case_col).alias("__case"), F.col("chunk").alias("__chunk"), F.lead("head").over(along).alias("__head"), F.row_number().over(along).alias("__nth"), (F.first("start").over(along) if first else F.lit(None)).alias("__start"))
    borders = kept(edges.where("__head is not null or __nth > 1").drop("__nth"))
    met = out.join(few(borders), F.col(case_col).eqNullSafe(F.col("__case")) & (F.col("chunk") == F.col("__chunk")), "left")
    return met.withColumn("next", F.coalesce("next", "__head")).withColumn("first", F.coalesce("__start", "first")).drop("chunk", "__case", "__chunk", "__head", "__start")
