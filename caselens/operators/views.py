"""Views over logs and deviations: dashboard, rankings, compliance, trend, process flow, upload batches, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators.detect import step_pairs


def dashboard(logs: DataFrame, devs: DataFrame, officers: DataFrame, sops: DataFrame) -> DataFrame:
    """One row: cases, deviations, officers, procedures, and deviations for 100 cases."""
    n = F.count(F.lit(1))
    parts = logs.agg(F.count_distinct("case_id").alias("total_cases")).crossJoin(devs.agg(n.alias("total_deviations")))
    parts = parts.crossJoin(officers.agg(n.alias("total_officers"))).crossJoin(sops.agg(n.alias("total_sops")))
    return parts.withColumn("deviation_rate", F.when(F.col("total_cases") > 0, F.round(100.0 * F.col("total_deviations") / F.col("total_cases"), 2)).otherwise(0.0))


def with_officers(devs: DataFrame, officers: DataFrame) -> DataFrame:
    return devs.join(officers.select("officer_id", F.col("name").alias("officer_name"), F.col("role").alias("officer_role")), "officer_id", "left")


def recent(devs: DataFrame, officers: DataFrame, rules: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The n newest deviations, with officer and, if they name one, rule. Only those n rows are joined."""
    rows = with_officers(devs.orderBy(F.desc("detected_at"), "deviation_id").limit(n), officers)
    if rules is None:
        return rows
    return rows.join(F.broadcast(rules.select("rule_id", F.col("rule_description"))), "rule_id", "left")


def listed(devs: DataFrame, officer: str | None = None, kind: str | None = None, severity: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Deviations by officer, type, severity and time (both ends included); what is None doesn't filter."""
    for column, value in (("officer_id", officer), ("deviation_type", kind), ("severity", severity)):
        devs = devs if value is None else devs.where(F.col(column) == value)
    devs = devs if start is None else devs.where(F.col("detected_at") >= F.lit(start).cast("timestamp_ntz"))
    return devs if end is None else devs.where(F.col("detected_at") <= F.lit(end).cast("timestamp_ntz"))


def top_officers(devs: DataFrame, officers: DataFrame, n: int = 5) -> DataFrame:
    best = devs.groupBy("officer_id").agg(F.count(F.lit(1)).alias("deviations")).orderBy(F.desc("deviations"), "officer_id").limit(n)
    return with_officers(best, officers).select("officer_id", "officer_name", "deviations")


def by(devs: DataFrame, *keys: str) -> DataFrame:
    return devs.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def summary(devs: DataFrame) -> DataFrame:
    """(grouping, key, count): in all, by severity, by type and by officer, in one pass over the deviations."""
    sets = devs.groupingSets([[], ["severity"], ["deviation_type"], ["officer_id"]], "severity", "deviation_type", "officer_id").agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid"))
    name = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "type").otherwise("officer")
    return sets.select(name.alias("grouping"), F.coalesce("severity", "deviation_type", "officer_id", F.lit("all")).alias("key"), "count")


def by_officer(devs: DataFrame, officers: DataFrame) -> DataFrame:
    """Deviations of each officer; avg_severity reads severities as numbers (0 for words), avg_severity_rank weighs them 1 to 4."""
    rank = F.lit(None)
    for name, weight in vocab.SEVERITY_WEIGHTS.items():
        rank = F.when(F.col("severity") == name, weight).otherwise(rank)
    rows = devs.groupBy("officer_id").agg(
        F.count(F.lit(1)).alias("deviations"), F.avg(F.coalesce(F.expr("try_cast(severity as int)"), F.lit(0))).alias("avg_severity"),
        F.round(F.avg(rank), 2).alias("avg_severity_rank"))
    return with_officers(rows, officers).select("officer_id", "officer_name", "deviations", "avg_severity", "avg_severity_rank")


def _between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    df = df if start is None else df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("timestamp_ntz"))


def case_compliance(logs: DataFrame, devs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: cases with a log in the range, cases with a deviation found in it, and the share without; 100 if there are no cases."""
    n = _between(logs, "ts", start, end).agg(F.count_distinct("case_id").alias("total_cases"))
    n = n.crossJoin(_between(devs, "detected_at", start, end).agg(F.count_distinct("case_id").alias("deviating_cases")))
    rate = F.round(100.0 * (F.col("total_cases") - F.col("deviating_cases")) / F.col("total_cases"), 2)
    return n.withColumn("compliance_rate", F.when(F.col("total_cases") > 0, rate).otherwise(100.0))


def log_compliance(logs: DataFrame, devs: DataFrame) -> DataFrame:
    """One row: the share of logs without a deviation, as if each had one at most."""
    n = logs.agg(F.count(F.lit(1)).alias("logs")).crossJoin(devs.agg(F.count(F.lit(1)).alias("deviations")))
    return n.withColumn("compliance_rate", F.round((1 - F.col("deviations") / F.greatest("logs", F.lit(1))) * 100, 1))


def trend(devs: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Deviations by day and severity, of the `days` days up to now."""
    end = F.lit(now).cast("timestamp_ntz")
    recent_ones = devs.where((F.col("detected_at") >= F.timestamp_add("DAY", F.lit(-days), end)) & (F.col("detected_at") <= end))
    return recent_ones.groupBy(F.date_format("detected_at", "yyyy-MM-dd").alias("day"), "severity").agg(F.count(F.lit(1)).alias("count"))


def flow_nodes(logs: DataFrame) -> DataFrame:
    return logs.groupBy("step_name").agg(F.count(F.lit(1)).alias("frequency"))


def flow_edges(logs: DataFrame) -> DataFrame:
    """The directly-follows graph: how often each step follows each in a case."""
    pairs = step_pairs(logs).where("step_2 is not null")
    return pairs.groupBy(F.col("step_1").alias("from_step"), F.col("step_2").alias("to_step")).agg(F.count(F.lit(1)).alias("frequency"))


def uploads(logs: DataFrame, uploaded: str = "uploaded_at") -> DataFrame:
    """Batches of logs uploaded in the same second: logs, cases, whether any is generated, and the file's name or one made from the time."""
    second = F.date_format(F.date_trunc("second", uploaded), "yyyy-MM-dd HH:mm:ss")
    rows = logs.groupBy(second.alias("upload_id")).agg(
        F.count(F.lit(1)).alias("logs"), F.count_distinct("case_id").alias("cases"), F.max("is_synthetic").alias("is_synthetic"), F.max("original_filename").alias("filename"))
    return rows.withColumn("filename", F.coalesce("filename", F.concat(F.when(F.col("is_synthetic"), "generated ").otherwise("upload "), "upload_id")))


def notes_coverage(logs: DataFrame, devs: DataFrame) -> DataFrame:
    """One row: logs and deviations, how many have notes, in whole percent."""
    def part(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name), F.count_if(F.coalesce(F.col("notes") != "", F.lit(False))).alias(f"{name}_with_notes"))

    def percent(name: str) -> Column:
        return F.when(F.col(name) > 0, F.round(100.0 * F.col(f"{name}_with_notes") / F.col(name), 0)).otherwise(0.0).alias(f"{name}_percent")

    return part(logs, "logs").crossJoin(part(devs, "deviations")).select("*", percent("logs"), percent("deviations"))


ANALYSED = ("case_id", "officer_id", "deviation_type", "severity", "description", "expected_behavior", "actual_behavior", "notes", "detected_at")


def for_analysis(devs: DataFrame) -> DataFrame:
    """The columns of deviations that pattern analysis reads, newest first."""
    return devs.select("deviation_id", *ANALYSED).orderBy(F.desc("detected_at"), "deviation_id")


def severity_shares(devs: DataFrame) -> DataFrame:
    """Severities that occur, in whole percent."""
    rows = by(devs, "severity")
    total = F.broadcast(rows.agg(F.sum("count").alias("total")))
    return rows.crossJoin(total).select("severity", "count", F.round(100.0 * F.col("count") / F.col("total"), 0).alias("percent"))
