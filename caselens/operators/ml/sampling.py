"""A small sample of deviations that covers anomalies, clusters, severities, periods of the day and officers.

Rows have deviation_id (which also orders them), cluster, is_anomaly, distance to their cluster's mean, severity,
officer_id and detected_at. The sample holds all anomalies, so it grows with the rows: it is joined as a table, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import times, vocab
from caselens.plans.graphs import kept

#: Rows of a cluster that are ranked together, at least.
PART = 200_000


def anomalies(rows: DataFrame) -> DataFrame:
    return rows.where("is_anomaly").select("deviation_id", F.lit("anomaly").alias("reason"))


def allocation(rows: DataFrame, budget: int) -> DataFrame:
    """(cluster, size, allocated): the budget dealt to clusters by their normal rows, one at least, cut back from the largest if it is too much."""
    sizes = rows.where("not is_anomaly and cluster != -1").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))
    part = F.least(F.greatest(F.lit(1), F.bround(F.col("size") / F.col("total") * budget, 0).cast("int")), F.col("size").cast("int"))
    dealt = sizes.crossJoin(total).select("cluster", "size", part.alias("dealt"))
    over = F.broadcast(dealt.agg(F.greatest(F.sum("dealt") - budget, F.lit(0)).alias("over")))
    spare = F.col("dealt") - 1
    before = F.coalesce(F.sum(spare).over(Window.orderBy(F.desc("dealt"), "cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a cluster
    cut = F.greatest(F.lit(0), F.least(spare, F.col("over") - F.col("before")))
    return dealt.withColumn("before", before).crossJoin(over).select("cluster", "size", (F.col("dealt") - cut).cast("int").alias("allocated"))


def representatives(rows: DataFrame, allocated: DataFrame) -> DataFrame:
    """Half of each cluster's allocation nearest to its mean, one at least, the rest farthest; normal rows only.

    A cluster is dealt to parts first; a part passes on as many of its nearest and farthest as the largest allocation, so no task holds a whole cluster.
    """
    group, allocated = Window.partitionBy("cluster"), kept(allocated)
    normal = rows.where("not is_anomaly and cluster != -1").select("deviation_id", "cluster", "distance")
    most = allocated.agg(F.max("allocated")).first()[0] or 0
    parts = max(1, normal.count() // max(PART, 50 * most))

    def ranked(df: DataFrame, own) -> DataFrame:
        return df.withColumns({"near": F.row_number().over(own.orderBy("distance", "deviation_id")), "far": F.row_number().over(own.orderBy(F.desc("distance"), "deviation_id"))})

    dealt = normal.withColumn("part", F.pmod(F.hash("deviation_id"), F.lit(parts))).repartition(parts, "cluster", "part")
    ends = ranked(dealt, Window.partitionBy("cluster", "part")).where((F.col("near") <= most) | (F.col("far") <= most))
    n = F.col("allocated")
    close = F.greatest(F.lit(1), F.floor(n / 2))
    met = ranked(ends.drop("part"), group).join(F.broadcast(allocated.select("cluster", "allocated")), "cluster").where((F.col("near") <= close) | (F.col("far") <= n - close))
    order = F.row_number().over(group.orderBy("deviation_id"))
    return met.withColumn("nth", order).where(F.col("nth") <= n).select("deviation_id", F.lit("representative").alias("reason"))


def uncovered(rows: DataFrame, sample: DataFrame, value: Column, reason: str, most: int | None = None) -> DataFrame:
    """The first row of each value that no sampled row has; of the first `most` values in order, if given."""
    valued = rows.select("deviation_id", value.alias("value")).where("value is not null")
    have = valued.join(sample.select("deviation_id"), "deviation_id", "left_semi").select("value").distinct()
    firsts = valued.groupBy("value").agg(F.min("deviation_id").alias("deviation_id")).join(have, "value", "left_anti")
    if most is not None:
        firsts = firsts.orderBy("value").limit(most)
    return firsts.select("deviation_id", F.lit(reason).alias("reason"))


def sampled(rows: DataFrame, target: int = 75, officers: int = 5) -> DataFrame:
    """(deviation_id, reason) of the whole sample; a row has the first reason that chose it."""
    bad = anomalies(rows)
    budget = max(0, target - bad.count())
    chosen = bad
    if budget:
        chosen = chosen.unionByName(representatives(rows, allocation(rows, budget)))
    known = F.when(F.col("severity").isin(*vocab.SEVERITIES), F.col("severity"))
    for value, reason, most in ((known, "severity", None), (times.period(times.event_time(rows, ("detected_at", "created_at"))), "period", None), (F.col("officer_id"), "officer", officers)):
        chosen = chosen.unionByName(uncovered(rows, chosen, value, reason, most))
    return chosen


def report(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: rows, sampled rows, compression, what the sample is made of, and what it covers."""
    reasons = ("anomaly", "representative", "severity", "period", "officer")
    made = sample.agg(F.count(F.lit(1)).alias("selected"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    met = rows.join(sample, "deviation_id")
    cover = met.agg(F.count_distinct("severity").alias("severities"), F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"), F.count_distinct("officer_id").alias("officers"))
    return total.crossJoin(made).crossJoin(cover).withColumn("compression", F.when(F.col("selected") > 0, F.round(F.col("total") / F.col("selected"), 2)).otherwise(0.0))


def labelled(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """The sampled rows with a struct ml_labels: cluster (or noise), is_anomaly, score."""
    name = F.when(F.col("cluster") == -1, "noise").otherwise(F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    return rows.join(sample, "deviation_id").withColumn("ml_labels", F.struct(name.alias("cluster"), "is_anomaly", "score"))
