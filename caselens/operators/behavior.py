"""Officer behaviour: profiles, risk, habits. All officers at once, by grouped aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import times, vocab
from caselens.plans.graphs import spread


def _severities() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in vocab.SEVERITIES]


def weight(severity: Column) -> Column:
    """Risk weight of a severity, 2 for unknown ones."""
    out = F.lit(2)
    for name, w in vocab.RISK_WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def days_of(logs: DataFrame) -> DataFrame:
    """(officer_id, day, case_id), each once, dealt to tasks before they are told apart, not a whole file to a task."""
    return spread(logs.select("officer_id", F.to_date("ts").alias("day"), "case_id"), "officer_id", "day", "case_id").distinct()


def workload(logs: DataFrame) -> DataFrame:
    """(officer_id, average_workload, peak_day, peak_cases): distinct cases a day over active days; the earliest of equal peaks."""
    days = days_of(logs).groupBy("officer_id", "day").agg(F.count("case_id").alias("cases"))
    peak = F.min_by("day", F.struct(-F.col("cases"), "day"))
    return days.groupBy("officer_id").agg(F.round(F.avg("cases"), 2).alias("average_workload"), F.date_format(peak, "yyyy-MM-dd").alias("peak_day"), F.max("cases").alias("peak_cases"))


def risk_score(weighted: Column, cases: Column) -> Column:
    """Weights of the deviations for each case, times ten, 100 at most; 0 without deviations."""
    return F.coalesce(F.least(F.round(weighted / F.greatest(cases, F.lit(1)) * 10, 2), F.lit(100.0)), F.lit(0.0))


def profiles(logs: DataFrame, devs: DataFrame) -> DataFrame:
    """A row for every officer with logs or deviations: cases, deviations, rate, workload, risk and most common deviation."""
    done = spread(logs.select("officer_id", "case_id"), "officer_id", "case_id").distinct().groupBy("officer_id").agg(F.count("case_id").alias("total_cases"))
    kinds = devs.groupBy("officer_id", "deviation_type").agg(F.count(F.lit(1)).alias("n"), F.sum(weight(F.col("severity"))).alias("w"))
    best = F.min_by(F.concat("deviation_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), F.struct(-F.col("n"), "deviation_type"))
    found = kinds.groupBy("officer_id").agg(F.sum("n").alias("deviation_count"), F.sum("w").alias("weighted"), best.alias("most_common_deviation"))
    both = done.join(found, "officer_id", "full_outer").join(workload(logs), "officer_id", "left")
    cases, n = F.coalesce("total_cases", F.lit(0).cast("long")), F.coalesce("deviation_count", F.lit(0).cast("long"))
    return both.select(
        "officer_id", cases.alias("total_cases"), n.alias("deviation_count"), F.when(cases > 0, F.round(100.0 * n / cases, 2)).otherwise(0.0).alias("deviation_rate"),
        F.coalesce("average_workload", F.lit(0.0)).alias("average_workload"), F.coalesce("peak_day", F.lit("N/A")).alias("peak_day"),
        risk_score(F.col("weighted"), cases).alias("risk_score"), F.coalesce("most_common_deviation", F.lit("None")).alias("most_common_deviation"))


def snapshot(officer_profiles: DataFrame, day: str) -> DataFrame:
    """Profiles with the day they are of, for an append to a table partitioned by it."""
    return officer_profiles.withColumn("profile_date", F.lit(day).cast("date"))


def _pattern(df: DataFrame, kind: str, description: Column, confidence: float, frequency: Column, trigger: Column) -> DataFrame:
    return df.select("officer_id", F.lit(kind).alias("pattern_type"), description.alias("description"), trigger.alias("trigger_condition"), frequency.cast("long").alias("frequency"), F.lit(confidence).alias("confidence_score"))


def _trigger(**fields: Column) -> Column:
    return F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))])


def workload_patterns(logs: DataFrame, devs: DataFrame, busy: int = 15, least: float = 2) -> DataFrame:
    """Officers who have more than `least` deviations a day, on average, on days with more than `busy` cases."""
    cases = days_of(logs).groupBy("officer_id", "day").agg(F.count("case_id").alias("cases")).where(F.col("cases") > busy)
    found = devs.groupBy("officer_id", F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("deviations"))
    days = cases.join(found, ["officer_id", "day"], "left").groupBy("officer_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cases").alias("load"), F.avg(F.coalesce("deviations", F.lit(0))).alias("rate"))
    load = F.bround("load", 0).cast("int")
    text = F.concat(F.lit("Deviation rate increases when workload exceeds "), load.cast("string"), F.lit(" cases/day"))
    return _pattern(days.where(F.col("rate") > least), "workload_threshold", text, 0.85, F.col("n"), _trigger(workload_threshold=load, deviation_increase=F.round("rate", 2)))


def weekday_patterns(devs: DataFrame, least: float = 30) -> DataFrame:
    """Officers with more than `least` percent of their deviations on one weekday, of equal ones the earliest in the week."""
    days = devs.groupBy("officer_id", F.weekday("detected_at").alias("d"), times.weekday_name(F.col("detected_at")).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    best = days.groupBy("officer_id").agg(F.sum("n").alias("total"), F.min_by(F.struct("weekday", "n"), F.struct(-F.col("n"), "d")).alias("best"))
    percent, n, day = 100.0 * F.col("best.n") / F.col("total"), F.col("best.n"), F.col("best.weekday")
    text = F.concat(F.lit("Higher deviation rate on "), day, F.lit("s ("), n.cast("string"), F.lit(" deviations, "), F.bround(percent, 0).cast("int").cast("string"), F.lit("%)"))
    return _pattern(best.where(percent > least), "time_based", text, 0.75, n, _trigger(day_of_week=day, deviation_count=n))


def step_patterns(devs: DataFrame, least: int = 3) -> DataFrame:
    """Officers with `least` deviations or more of their most frequent type, and the step that the first of these lacks, if it names one."""
    step = F.col("context.missing_step") if "context" in devs.columns else F.lit(None).cast("string")
    kinds = devs.groupBy("officer_id", "deviation_type").agg(F.count(F.lit(1)).alias("n"), F.min_by(step, "deviation_id").alias("step"))
    best = kinds.groupBy("officer_id").agg(F.min_by(F.struct("deviation_type", "n", "step"), F.struct(-F.col("n"), "deviation_type")).alias("best")).select("officer_id", "best.*")
    n = F.col("n")
    text = F.concat(F.lit("Frequently commits "), F.replace("deviation_type", F.lit("_"), F.lit(" ")), F.lit(" ("), n.cast("string"), F.lit(" times)"))
    text = F.concat(text, F.coalesce(F.concat(F.lit(": often skips "), F.col("step")), F.lit("")))
    return _pattern(best.where(n >= least), "step_specific", text, 0.90, n, _trigger(deviation_type=F.col("deviation_type"), frequency=n))


def patterns(logs: DataFrame, devs: DataFrame) -> DataFrame:
    """All habits of officers who have both logs and deviations."""
    found = reduce(DataFrame.unionByName, [workload_patterns(logs, devs), weekday_patterns(devs), step_patterns(devs)])
    return found.join(logs.select("officer_id").distinct(), "officer_id", "left_semi")


def listed_patterns(found: DataFrame, officers: DataFrame, officer: str | None = None) -> DataFrame:
    """Habits, of one officer or all, with officers' names, the most certain first."""
    found = found if officer is None else found.where(F.col("officer_id") == officer)
    return found.join(officers.select("officer_id", "name"), "officer_id", "left").orderBy(F.desc("confidence_score"), "officer_id", "pattern_type")


def risk_matrix(officers: DataFrame, devs: DataFrame) -> DataFrame:
    """Every officer with deviations by severity, zeros included, and their weighted sum."""
    n = devs.groupBy("officer_id").agg(*_severities())
    zeros = [F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in vocab.SEVERITIES]
    rows = officers.join(n, "officer_id", "left").select("officer_id", "name", *zeros)
    return rows.withColumn("risk_score", sum((F.col(s) * w for s, w in vocab.RISK_WEIGHTS.items()), F.lit(0).cast("long")))


def officer_counts(officers: DataFrame, devs: DataFrame) -> DataFrame:
    """Every officer with the number of deviations, zeros included."""
    n = devs.groupBy("officer_id").agg(F.count(F.lit(1)).alias("deviations"))
    return officers.join(n, "officer_id", "left").select("officer_id", "name", "role", "department", F.coalesce("deviations", F.lit(0).cast("long")).alias("deviations"))


def cards(officers: DataFrame, devs: DataFrame, snapshots: DataFrame, found: DataFrame) -> DataFrame:
    """Every officer with the latest profile, habits, and counts of deviations."""
    newest = F.row_number().over(Window.partitionBy("officer_id").orderBy(F.desc("profile_date")))
    latest = snapshots.withColumn("nth", newest).where("nth = 1").drop("nth")
    habits = found.groupBy("officer_id").agg(F.sort_array(F.collect_list(F.struct("pattern_type", "description", "confidence_score"))).alias("patterns"))
    return officer_counts(officers, devs).join(latest, "officer_id", "left").join(habits, "officer_id", "left")
