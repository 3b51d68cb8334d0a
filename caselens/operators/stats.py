"""Statistics over deviation tables. Every function is one or two grouped aggregations; ties go by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import times, vocab


def share(part: Column, whole: Column) -> Column:
    """Percentage with two places, 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 2)).otherwise(0.0)


def counted(devs: DataFrame, *keys: str) -> DataFrame:
    return devs.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def with_total(df: DataFrame) -> DataFrame:
    """df with the sum of its counts; df has a row for each key of a small domain."""
    return df.crossJoin(F.broadcast(df.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))))


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def banded(score: Column, bands) -> Column:
    out = None
    for least, text in bands:
        out = F.when(score >= least, text) if out is None else out.otherwise(text) if least is None else out.when(score >= least, text)
    return out


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in vocab.SEVERITIES]


def overview(devs: DataFrame) -> DataFrame:
    """One row: deviations, cases, officers, and deviations for each of them on average."""
    n = devs.agg(F.count(F.lit(1)).alias("total_deviations"), F.count_distinct("case_id").alias("unique_cases"), F.count_distinct("officer_id").alias("unique_officers"))
    return n.withColumns({
        "average_deviations_per_case": ratio(F.col("total_deviations"), F.col("unique_cases")),
        "average_deviations_per_officer": ratio(F.col("total_deviations"), F.col("unique_officers")),
    })


def severity_distribution(devs: DataFrame) -> DataFrame:
    """A row for each severity, also those that don't occur."""
    counts = devs.agg(*severity_counts(), F.count(F.lit(1)).alias("total"))
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("severity"), F.col(s).alias("count")) for i, s in enumerate(vocab.SEVERITIES)])
    return counts.select(F.inline(rows), "total").select("position", "severity", "count", share(F.col("count"), F.col("total")).alias("percentage"))


def severity_score(devs: DataFrame) -> DataFrame:
    """One row: mean weight of the severities in percent of the worst, its band, and the most frequent severity."""
    counts = devs.agg(*severity_counts(), F.count(F.lit(1)).alias("total"))
    weighted = sum((F.col(s) * w for s, w in vocab.SEVERITY_WEIGHTS.items()), F.lit(0))
    score = F.when(F.col("total") > 0, F.round(weighted / F.col("total") * 25, 2)).otherwise(0.0)
    most = F.array_max(F.array(*[F.struct(F.col(s).alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("s")) for i, s in enumerate(vocab.SEVERITIES)]))
    return counts.select(score.alias("severity_score"), banded(score, vocab.SEVERITY_BANDS).alias("severity_assessment"), F.when(F.col("total") > 0, most["s"]).alias("most_common_severity"))


def top_types(devs: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent types with their shares, and how many types there are."""
    types = counted(devs, "deviation_type")
    totals = F.broadcast(types.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("unique_types")))
    rows = top(types, n, F.desc("count"), "deviation_type").crossJoin(totals)
    return rows.select("deviation_type", "count", share(F.col("count"), F.col("total")).alias("percentage"), "unique_types")


def category_of(kind: Column) -> Column:
    """The first category one of whose words is part of the type's name, else other."""
    name, out = F.lower(kind), None
    for category, words in vocab.CATEGORIES:
        hit = name.contains(words[0])
        for w in words[1:]:
            hit = hit | name.contains(w)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")


def categories(devs: DataFrame) -> DataFrame:
    types = counted(devs, "deviation_type").groupBy(category_of(F.col("deviation_type")).alias("category")).agg(F.sum("count").alias("count"))
    return with_total(types).select("category", "count", share(F.col("count"), F.col("total")).alias("percentage"))


def timed(devs: DataFrame, columns: tuple[str, ...] = ("detected_at", "timestamp", "created_at")) -> DataFrame:
    """The rows of devs that have a readable time, as event_ts."""
    return devs.withColumn("event_ts", times.event_time(devs, columns)).where("event_ts is not null")


def by_hour(devs: DataFrame) -> DataFrame:
    """A row for each of the 24 hours."""
    hours = timed(devs).groupBy(F.hour("event_ts").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    every = devs.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return every.join(F.broadcast(hours), "hour", "left").select(F.format_string("%02d:00", "hour").alias("hour"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def by_weekday(devs: DataFrame) -> DataFrame:
    """A row for each weekday, Monday first."""
    days = timed(devs).groupBy(F.weekday("event_ts").alias("position")).agg(F.count(F.lit(1)).alias("count"))
    every = devs.sparkSession.createDataFrame(list(enumerate(vocab.WEEKDAYS)), "position int, weekday string")
    return every.join(F.broadcast(days), "position", "left").select("position", "weekday", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def peak_hours(devs: DataFrame, n: int = 3) -> DataFrame:
    return top(by_hour(devs), n, F.desc("count"), "hour")


def peak_days(devs: DataFrame, n: int = 3) -> DataFrame:
    return top(by_weekday(devs), n, F.desc("count"), "position").select("weekday", "count")


def by_period(devs: DataFrame) -> DataFrame:
    """Periods of the day that occur, with their shares."""
    rows = timed(devs).groupBy(times.period(F.col("event_ts")).alias("period")).agg(F.count(F.lit(1)).alias("count"))
    return with_total(rows).select("period", "count", share(F.col("count"), F.col("total")).alias("percentage"))


def date_range(devs: DataFrame) -> DataFrame:
    """One row: first and last day, and how many rows have a readable time."""
    days = [f("event_ts") for f in (F.min, F.max)]
    return timed(devs).agg(*[F.date_format(c, "yyyy-MM-dd").alias(n) for c, n in zip(days, ("first_day", "last_day"), strict=True)], F.count(F.lit(1)).alias("timed"))


def top_entities(devs: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """The n values of key with the most deviations: how many, distinct others, average, severities and most frequent type."""
    totals = devs.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(other).alias("others"), *severity_counts())
    best = top(totals, n, F.desc("total"), key)
    types = counted(devs, key, "deviation_type").groupBy(key).agg(F.min_by("deviation_type", F.struct(-F.col("count"), "deviation_type")).alias("top_type"))
    return types.join(F.broadcast(best), key).select(key, "total", "others", ratio(F.col("total"), F.col("others")).alias("average"), *vocab.SEVERITIES, "top_type")  # n rows


def spread(devs: DataFrame, key: str) -> DataFrame:
    """One row: mean, median, sample deviation, least and most deviations by value of key."""
    n = counted(devs, key)
    return n.agg(
        F.round(F.avg("count"), 2).alias("mean"), F.median("count").alias("median"), F.round(F.coalesce(F.stddev_samp("count"), F.lit(0.0)), 2).alias("std_dev"),
        F.min("count").alias("min"), F.max("count").alias("max"))


def severity_by_type(devs: DataFrame, n: int = 3) -> DataFrame:
    """For each severity its n most frequent types."""
    rank = F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("count"), "deviation_type"))
    return counted(devs, "severity", "deviation_type").withColumn("rank", rank).where(F.col("rank") <= n)


def high_risk_officers(devs: DataFrame, least: float = 50, n: int = 10) -> DataFrame:
    """Officers whose critical and high deviations weigh more than `least` percent of the worst case; the n worst."""
    rows = devs.groupBy("officer_id").agg(F.count(F.lit(1)).alias("total"), *severity_counts())
    score = F.round((4 * F.col("critical") + 3 * F.col("high")) / (4 * F.col("total")) * 100, 2)
    return top(rows.withColumn("risk_score", score).where(F.col("risk_score") > least), n, F.desc("risk_score"), "officer_id").select("officer_id", "risk_score", "total", "critical", "high")


def critical_mass(devs: DataFrame) -> DataFrame:
    """One row: percentage of critical deviations and three quarters of that of high ones, and its band."""
    n = devs.agg(F.count(F.lit(1)).alias("total"), *severity_counts())
    score = F.when(F.col("total") > 0, F.round(100.0 * F.col("critical") / F.col("total") + 75.0 * F.col("high") / F.col("total"), 2)).otherwise(0.0)
    return n.select(score.alias("critical_mass_score"), banded(score, vocab.CRITICAL_MASS_BANDS).alias("critical_mass_assessment"))


def concentration(devs: DataFrame, n: int = 5, limit: float = 50) -> DataFrame:
    """One row: the share of the n officers with the most deviations, whether it is above limit, and how many officers there are."""
    rows = counted(devs, "officer_id")
    best = top(rows, n, F.desc("count"), "officer_id").agg(F.sum("count").alias("best"))
    totals = rows.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("unique_officers"))
    part = share(F.col("best"), F.col("total"))
    return totals.crossJoin(best).select(part.alias("top_officer_percentage"), (part > limit).alias("is_concentrated"), "unique_officers")


def diversity(devs: DataFrame, limit: int = 15) -> DataFrame:
    """One row: types, their number in percent of the deviations, and whether that many types is high."""
    n = devs.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("deviation_type").alias("unique_types"))
    return n.select("unique_types", share(F.col("unique_types"), F.col("total")).alias("diversity_score"), F.when(F.col("unique_types") > limit, "High diversity").otherwise("Low diversity").alias("assessment"))


def analysis(devs: DataFrame) -> dict[str, DataFrame]:
    """All statistics of a deviation table by name; lazily, each computed when it is read."""
    return {
        "overview": overview(devs), "severity_distribution": severity_distribution(devs), "severity_score": severity_score(devs), "top_types": top_types(devs),
        "categories": categories(devs), "by_hour": by_hour(devs), "by_weekday": by_weekday(devs), "peak_hours": peak_hours(devs), "peak_days": peak_days(devs),
        "by_period": by_period(devs), "date_range": date_range(devs), "officers": top_entities(devs, "officer_id", "case_id", 20), "officer_spread": spread(devs, "officer_id"),
        "cases": top_entities(devs, "case_id", "officer_id", 10), "case_spread": spread(devs, "case_id"), "severity_by_type": severity_by_type(devs),
        "high_risk_officers": high_risk_officers(devs), "critical_mass": critical_mass(devs), "concentration": concentration(devs), "diversity": diversity(devs),
    }


def summary(devs: DataFrame) -> DataFrame:
    """(measure, key, value) of the short summary: overview, severities and the five most frequent types."""
    o = overview(devs).select(F.expr("stack(3, 'total', total_deviations, 'cases', unique_cases, 'officers', unique_officers) as (key, value)")).select(F.lit("overview").alias("measure"), "key", "value")
    s = severity_distribution(devs).select(F.lit("severity").alias("measure"), F.col("severity").alias("key"), F.col("count").alias("value"))
    t = top_types(devs, 5).select(F.lit("type").alias("measure"), F.col("deviation_type").alias("key"), F.col("count").alias("value"))
    return o.unionByName(s).unionByName(t)
