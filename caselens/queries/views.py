"""Views over the order logs and the deviations of the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.operators import detect as d
from caselens.operators import views as v
from caselens.queries.detect import PAIRS
from caselens.registry import query
from caselens.sources import tables as t
from caselens.sources.tables import DEVIATIONS, OFFICERS, ORDER_LOGS

W = f"with {DEVIATIONS}, {OFFICERS}, {ORDER_LOGS}"
STAMP = "%Y-%m-%d %H:%M:%S"
NOW, START, END = "1997-06-01 00:00:00", "1995-01-01 00:00:00", "1996-12-31 23:59:59"


def _stamp(column="detected_at"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("j1_dashboard", f"""{W} select (select count(distinct case_id) from logs) as total_cases, (select count(*) from devs) as total_deviations, (select count(*) from officers) as total_officers,
  (select count(*) from part) as total_sops, round(100.0 * (select count(*) from devs) / (select count(distinct case_id) from logs), 2) as deviation_rate""")
def j1(spark, sf):
    return v.dashboard(t.order_logs(spark, sf), t.deviations(spark, sf), t.officers(spark, sf), t.read(spark, sf, "part"))


@query("j2_recent", f"""{W} select d.deviation_id, d.officer_id, name as officer_name, role as officer_role, deviation_type, strftime(detected_at, '{STAMP}') as detected_at
from devs d left join officers o on o.officer_id = d.officer_id order by d.detected_at desc, deviation_id limit 10""")
def j2(spark, sf):
    rows = v.recent(t.deviations(spark, sf), t.officers(spark, sf))
    return rows.select("deviation_id", "officer_id", "officer_name", "officer_role", "deviation_type", _stamp())


@query("j3_top_officers", f"""{W} select d.officer_id, name as officer_name, count(*) as deviations from devs d left join officers o on o.officer_id = d.officer_id
group by all order by deviations desc, d.officer_id limit 5""")
def j3(spark, sf):
    return v.top_officers(t.deviations(spark, sf), t.officers(spark, sf))


@query("j4_by_severity", f"{W} select severity, count(*) as count from devs group by all")
def j4(spark, sf):
    return v.by(t.deviations(spark, sf), "severity")


@query("j4_by_type", f"{W} select deviation_type, count(*) as count from devs group by all")
def j4_type(spark, sf):
    return v.by(t.deviations(spark, sf), "deviation_type")


@query("j5_summary", f"""{W} select 'total' as grouping, 'all' as key, count(*) as count from devs union all select 'severity', severity, count(*) from devs group by severity
union all select 'type', deviation_type, count(*) from devs group by deviation_type union all select 'officer', officer_id, count(*) from devs group by officer_id""")
def j5(spark, sf):
    return v.summary(t.deviations(spark, sf))


@query("j6_by_officer", f"""{W} select d.officer_id, name as officer_name, count(*) as deviations, avg(coalesce(try_cast(severity as int), 0)) as avg_severity,
  round(avg(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 end), 2) as avg_severity_rank
from devs d left join officers o on o.officer_id = d.officer_id group by all""")
def j6(spark, sf):
    return v.by_officer(t.deviations(spark, sf), t.officers(spark, sf))


@query("j7_by_type_and_severity", f"{W} select deviation_type, severity, count(*) as count from devs group by all")
def j7(spark, sf):
    return v.by(t.deviations(spark, sf), "deviation_type", "severity")


@query("j8_case_compliance", f"""{W}, n as (select (select count(distinct case_id) from logs where ts between timestamp '{START}' and timestamp '{END}') as total_cases,
  (select count(distinct case_id) from devs where severity = 'critical' and detected_at between timestamp '{START}' and timestamp '{END}') as deviating_cases)
select total_cases, deviating_cases, case when total_cases > 0 then round(100.0 * (total_cases - deviating_cases) / total_cases, 2) else 100.0::double end as compliance_rate from n""")
def j8(spark, sf):
    return v.case_compliance(t.order_logs(spark, sf), t.deviations(spark, sf).where("severity = 'critical'"), START, END)


@query("j9_log_compliance", f"""{W}, n as (select (select count(*) from logs) as logs, (select count(*) from devs where severity = 'high') as deviations)
select logs, deviations, round((1 - deviations / greatest(logs, 1)) * 100, 1) as compliance_rate from n""")
def j9(spark, sf):
    return v.log_compliance(t.order_logs(spark, sf), t.deviations(spark, sf).where("severity = 'high'"))


@query("j10_trend", f"""{W} select strftime(detected_at, '%Y-%m-%d') as day, severity, count(*) as count from devs
where detected_at >= timestamp '{NOW}' - interval 30 day and detected_at <= timestamp '{NOW}' group by all""")
def j10(spark, sf):
    return v.trend(t.deviations(spark, sf), NOW)


@query("j11_flow_nodes", f"{W} select step_name, count(*) as frequency from logs group by all")
def j11(spark, sf):
    return v.flow_nodes(t.order_logs(spark, sf))


@query("j12_flow_edges", f"{W}, {PAIRS} select step_1 as from_step, step_2 as to_step, count(*) as frequency from pairs where step_2 is not null group by all")
def j12(spark, sf):
    return v.flow_edges(t.order_logs(spark, sf))


@query("j13_uploads", f"""with batches as (
  select strftime(date_trunc('second', ts), '{STAMP}') as upload_id, count(*) as logs, count(distinct user_id) as cases, bool_or(event_type = 'error') as is_synthetic,
    max(case when event_id % 3 = 0 then 'events-' || event_type || '.csv' end) as filename from events group by 1)
select upload_id, logs, cases, is_synthetic, coalesce(filename, case when is_synthetic then 'generated ' else 'upload ' end || upload_id) as filename from batches""")
def j13(spark, sf):
    logs = t.read(spark, sf, "events").select(
        F.col("ts").alias("uploaded_at"), F.col("user_id").alias("case_id"), (F.col("event_type") == "error").alias("is_synthetic"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("events-"), "event_type", F.lit(".csv"))).alias("original_filename"))
    return v.uploads(logs)


@query("j14_notes_coverage", f"""{W}, n as (select (select count(*) from logs) as logs, (select count_if(notes <> '') from logs)::bigint as logs_with_notes, (select count(*) from devs) as deviations,
  (select count_if(notes <> '') from devs)::bigint as deviations_with_notes)
select *, round(100.0 * logs_with_notes / logs, 0) as logs_percent, round(100.0 * deviations_with_notes / deviations, 0) as deviations_percent from n""")
def j14(spark, sf):
    return v.notes_coverage(t.order_logs(spark, sf), t.deviations(spark, sf))


@query("j15_for_analysis", f"""{W} select deviation_id, case_id, officer_id, deviation_type, severity, description, expected_behavior, actual_behavior, notes, strftime(detected_at, '{STAMP}') as detected_at from devs""")
def j15(spark, sf):
    return v.for_analysis(t.deviations(spark, sf)).select("deviation_id", *v.ANALYSED[:-1], _stamp())


@query("j16_severity_shares", f"{W} select severity, count(*) as count, round(100.0 * count(*) / (select count(*) from devs), 0) as percent from devs group by all")
def j16(spark, sf):
    return v.severity_shares(t.deviations(spark, sf))


@query("b14_filtered_deviations", f"""{W} select d.deviation_id, d.officer_id, o.name as officer_name, strftime(detected_at, '{STAMP}') as detected_at from devs d left join officers o on o.officer_id = d.officer_id
where deviation_type = 'missing_step' and severity = 'high' and detected_at >= timestamp '{START}' and detected_at <= timestamp '{END}'""")
def b14(spark, sf):
    rows = v.listed(t.deviations(spark, sf), kind="missing_step", severity="high", start=START, end=END)
    return v.with_officers(rows, t.officers(spark, sf)).select("deviation_id", "officer_id", "officer_name", _stamp())


@query("b13_case_trace", f"{W} select log_seq, step_name, strftime(ts, '{STAMP}') as ts, row_number() over (order by logs.ts, log_seq)::int as position from logs where case_id = '7'")
def b13(spark, sf):
    from caselens.operators.ingest import trace

    return trace(t.order_logs(spark, sf), "7").select("log_seq", "step_name", _stamp("ts"), "position")


def detected(spark, sf):
    """The deviations that detection finds in the order logs; for checks of the whole way."""
    return d.detect(t.order_logs(spark, sf), t.rules(spark))
