"""Whole ways through the library: logs to deviations, raw deviations to clean ones and their statistics, deviations to a sample."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators import clean, detect, stats
from caselens.operators.ml import clusters, features, outliers, sampling
from caselens.plans.graphs import kept, spread

#: Deviations that a task of the way to a sample takes, about; the columns of them that it needs, if they are there.
ROWS = 20_000
NEEDED = ("deviation_id", "officer_id", "deviation_type", "severity", "description", "detected_at", "created_at")


def analysed_logs(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """The deviations of a log with the notes of their cases."""
    found = detect.detect(logs, rules)
    return detect.with_notes(found, detect.case_notes(logs, found)) if "notes" in logs.columns else found


def analysed_deviations(raw: DataFrame) -> dict[str, DataFrame]:
    """Cleaned deviations, the report of the cleaning, what was rejected, and all statistics, by name."""
    tidy = clean.cleaned(raw)
    return {"cleaned": tidy, "report": clean.graded(clean.report(raw)), "rejected": clean.rejected(raw)} | stats.analysis(tidy)


def ml_sample(devs: DataFrame, target: int = 75) -> DataFrame:
    """(deviation_id, cluster, is_anomaly, score, reason) of a sample that stands for all; all rows pass if there are fewer than 10.

    Rows are dealt to tasks first, while they are short; their features are kept as Spark's sparse vectors and only spread out where they are read.
    """
    if devs.limit(10).count() < 10:
        return devs.select("deviation_id", F.lit("cluster_0").alias("cluster"), F.lit(False).alias("is_anomaly"), F.lit(0.0).alias("score"), F.lit("all").alias("reason"))
    devs = kept(spread(devs.select(*[c for c in NEEDED if c in devs.columns]), "deviation_id", rows=ROWS))
    made = kept(features.fit(devs).transform(devs).select("deviation_id", "officer_id", "severity", "detected_at", "features"))
    cluster, _ = clusters.clustered(made, "deviation_id", "features")
    rows = kept(made.join(cluster, "deviation_id")).withColumn("v", vector_to_array("features"))
    score = outliers.scored(rows, "deviation_id", "v")
    means = rows.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("mean"))
    means = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda m: m["mean"]).alias("mean"))  # a row a cluster
    gap = F.sqrt(F.aggregate(F.zip_with("v", "mean", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x))
    near = rows.join(F.broadcast(means), "cluster").select("deviation_id", "officer_id", "severity", "detected_at", "cluster", gap.alias("distance"))
    found = kept(near.join(score.drop("threshold"), "deviation_id"))
    sample = sampling.sampled(found, target)
    return sampling.labelled(found, sample).select("deviation_id", "ml_labels.*", "reason")
