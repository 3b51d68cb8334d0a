"""Officer behaviour in the order logs and the event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators import behavior as b
from caselens.registry import query
from caselens.sources import tables as t
from caselens.sources.tables import DEVIATIONS, EVENT_LOGS, OFFICERS, ORDER_LOGS

W = f"with {DEVIATIONS}, {OFFICERS}, {ORDER_LOGS}"
WEIGHT = "case severity when 'critical' then 10 when 'high' then 5 when 'medium' then 2 when 'low' then 1 else 2 end"
WORKLOAD = """daily as (select officer_id, ts::date as day, count(distinct case_id) as cases from logs group by all), workload as (
  select officer_id, round(avg(cases), 2) as average_workload, strftime(first(day order by cases desc, day), '%Y-%m-%d') as peak_day, max(cases) as peak_cases from daily group by officer_id)"""
PROFILES = f"""{WORKLOAD}, done as (select officer_id, count(distinct case_id) as total_cases from logs group by officer_id),
kinds as (select officer_id, deviation_type, count(*) as n, sum({WEIGHT}) as w from devs group by all),
found as (select officer_id, sum(n)::bigint as deviation_count, sum(w) as weighted, first(deviation_type || ' (' || n::varchar || ')' order by n desc, deviation_type) as most_common_deviation from kinds group by officer_id),
profiles as (select officer_id, coalesce(total_cases, 0)::bigint as total_cases, coalesce(deviation_count, 0)::bigint as deviation_count,
  case when total_cases > 0 then round(100.0 * coalesce(deviation_count, 0) / total_cases, 2) else 0::double end as deviation_rate, coalesce(average_workload, 0) as average_workload,
  coalesce(peak_day, 'N/A') as peak_day, coalesce(least(round(weighted / greatest(coalesce(total_cases, 0), 1) * 10, 2), 100), 0)::double as risk_score, coalesce(most_common_deviation, 'None') as most_common_deviation
  from done full join found using (officer_id) left join workload using (officer_id))"""


def _both(spark, sf):
    return t.order_logs(spark, sf), t.deviations(spark, sf)


@query("g1_profiles", f"{W}, {PROFILES} select officer_id, total_cases, deviation_count, deviation_rate from profiles")
def g1(spark, sf):
    return b.profiles(*_both(spark, sf)).select("officer_id", "total_cases", "deviation_count", "deviation_rate")


@query("g2_workload", f"{W}, {WORKLOAD} select * from workload")
def g2(spark, sf):
    return b.workload(t.order_logs(spark, sf))


@query("g3_risk_score", f"{W}, {PROFILES} select officer_id, risk_score from profiles")
def g3(spark, sf):
    return b.profiles(*_both(spark, sf)).select("officer_id", "risk_score")


@query("g4_most_common_deviation", f"{W}, {PROFILES} select officer_id, most_common_deviation from profiles")
def g4(spark, sf):
    return b.profiles(*_both(spark, sf)).select("officer_id", "most_common_deviation")


EVENT_DEVS = """devs as (select event_id as deviation_id, user_id::varchar || '/' || strftime(ts, '%Y-%m-%d') as case_id, (user_id % 20)::varchar as officer_id, event_type as deviation_type,
  case event_type when 'error' then 'critical' when 'view' then 'low' else 'medium' end as severity, ts as detected_at from events where event_type in ('error', 'view', 'signup'))"""
E = f"with {EVENT_LOGS}, {EVENT_DEVS}"
BUSY = """cases as (select officer_id, ts::date as day, count(distinct case_id) as cases from logs group by all having count(distinct case_id) > {busy}),
found as (select officer_id, detected_at::date as day, count(*) as deviations from devs group by all),
busy as (select officer_id, count(*) as n, avg(cases) as load, avg(coalesce(deviations, 0)) as rate from cases left join found using (officer_id, day) group by officer_id having avg(coalesce(deviations, 0)) > 2),
workload_rows as (select officer_id, 'workload_threshold' as pattern_type, 'Deviation rate increases when workload exceeds ' || round_even(load, 0)::int::varchar || ' cases/day' as description, n as frequency, 0.85::double as confidence_score from busy)"""
WEEKDAYS = """wd as (select officer_id, isodow(detected_at) as d, dayname(detected_at) as weekday, count(*) as n from devs group by all),
bestday as (select officer_id, sum(n) as total, first(weekday order by n desc, d) as weekday, max(n) as n from wd group by officer_id),
weekday_rows as (select officer_id, 'time_based' as pattern_type, 'Higher deviation rate on ' || weekday || 's (' || n::varchar || ' deviations, ' || round_even(100.0 * n / total, 0)::int::varchar || '%)' as description,
  n as frequency, 0.75::double as confidence_score from bestday where 100.0 * n / total > {least})"""
STEPS = """kinds as (select officer_id, deviation_type, count(*) as n from devs group by all),
bestkind as (select officer_id, first(deviation_type order by n desc, deviation_type) as deviation_type, max(n) as n from kinds group by officer_id),
step_rows as (select officer_id, 'step_specific' as pattern_type, 'Frequently commits ' || replace(deviation_type, '_', ' ') || ' (' || n::varchar || ' times)' as description, n as frequency, 0.9::double as confidence_score
  from bestkind where n >= 3)"""
PLAIN = ["officer_id", "pattern_type", "description", "frequency", "confidence_score"]


def event_devs(spark, sf):
    kinds = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "low").otherwise("medium")
    return t.read(spark, sf, "events").where(F.col("event_type").isin("error", "view", "signup")).select(
        F.col("event_id").alias("deviation_id"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"),
        (F.col("user_id") % 20).cast("string").alias("officer_id"), F.col("event_type").alias("deviation_type"), kinds.alias("severity"), F.col("ts").alias("detected_at"))


@query("g5_workload_pattern", f"{E}, {BUSY.format(busy=5)} select * from workload_rows")
def g5(spark, sf):
    return b.workload_patterns(t.event_logs(spark, sf), event_devs(spark, sf), busy=5).select(PLAIN)


@query("g6_weekday_pattern", f"{W}, {WEEKDAYS.format(least=15)} select * from weekday_rows")
def g6(spark, sf):
    return b.weekday_patterns(t.deviations(spark, sf), least=15).select(PLAIN)


@query("g7_step_pattern", f"{E}, {STEPS} select * from step_rows")
def g7(spark, sf):
    return b.step_patterns(event_devs(spark, sf)).select(PLAIN)


PATTERNS = f"{E}, {BUSY.format(busy=15)}, {WEEKDAYS.format(least=30)}, {STEPS}, patterns as (select * from workload_rows union all select * from weekday_rows union all select * from step_rows)"


@query("g8_patterns", f"{PATTERNS} select * from patterns where officer_id in (select officer_id from logs)")
def g8(spark, sf):
    return b.patterns(t.event_logs(spark, sf), event_devs(spark, sf)).select(PLAIN)


@query("g9_pattern_list", f"{PATTERNS}, {OFFICERS} select p.officer_id, o.name, p.pattern_type, p.description, p.confidence_score from patterns p left join officers o on o.officer_id = p.officer_id where p.officer_id = '7'")
def g9(spark, sf):
    found = b.patterns(t.event_logs(spark, sf), event_devs(spark, sf))
    return b.listed_patterns(found, t.officers(spark, sf), "7").select("officer_id", "name", "pattern_type", "description", "confidence_score")


SEV = ", ".join(f"count_if(severity = '{s}')::bigint as {s}" for s in vocab.SEVERITIES)


@query("g10_risk_matrix", f"""{W}, n as (select officer_id, {SEV} from devs group by officer_id)
select o.officer_id, name, coalesce(critical, 0)::bigint as critical, coalesce(high, 0)::bigint as high, coalesce(medium, 0)::bigint as medium, coalesce(low, 0)::bigint as low,
  (10 * coalesce(critical, 0) + 5 * coalesce(high, 0) + 2 * coalesce(medium, 0) + coalesce(low, 0))::bigint as risk_score from officers o left join n using (officer_id)""")
def g10(spark, sf):
    return b.risk_matrix(t.officers(spark, sf), t.deviations(spark, sf))


@query("g11_officer_counts", f"{W} select o.officer_id, name, role, department, count(d.deviation_id) as deviations from officers o left join devs d on d.officer_id = o.officer_id and severity = 'critical' group by all")
def g11(spark, sf):
    return b.officer_counts(t.officers(spark, sf), t.deviations(spark, sf).where("severity = 'critical'"))


@query("g12_officer_cards", f"""{W}, {PROFILES}, {WEEKDAYS.format(least=15)}, {STEPS.replace('kinds', 'kinds2')},
patterns as (select * from weekday_rows union all select * from step_rows), habits as (select officer_id, count(*) as n_patterns, string_agg(pattern_type, ',' order by pattern_type, description) as pattern_types from patterns group by officer_id)
select o.officer_id, name, (select count(*) from devs d where d.officer_id = o.officer_id) as deviations, '1998-12-31' as profile_date, p.risk_score, coalesce(n_patterns, 0)::int as n_patterns, pattern_types
from officers o left join profiles p using (officer_id) left join habits using (officer_id)""")
def g12(spark, sf):
    logs, devs = _both(spark, sf)
    made = b.profiles(logs, devs).select("officer_id", "risk_score")
    snapshots = b.snapshot(made, "1998-12-31").unionByName(b.snapshot(made.withColumn("risk_score", F.lit(0.0)), "1997-12-31"))
    found = b.weekday_patterns(devs, least=15).unionByName(b.step_patterns(devs))
    rows = b.cards(t.officers(spark, sf), devs, snapshots, found)
    types = F.array_join(F.transform("patterns", lambda x: x["pattern_type"]), ",")
    return rows.select("officer_id", "name", "deviations", F.date_format("profile_date", "yyyy-MM-dd").alias("profile_date"), "risk_score", F.coalesce(F.size("patterns"), F.lit(0)).alias("n_patterns"), types.alias("pattern_types"))


@query("g13_profile_snapshots", f"{W}, {PROFILES} select officer_id, total_cases, risk_score, '1998-12-31' as profile_date from profiles")
def g13(spark, sf):
    rows = b.snapshot(b.profiles(*_both(spark, sf)), "1998-12-31")
    return rows.select("officer_id", "total_cases", "risk_score", F.date_format("profile_date", "yyyy-MM-dd").alias("profile_date"))
