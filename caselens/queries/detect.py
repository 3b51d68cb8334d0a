"""Detection on the order and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators import detect as d
from caselens.registry import query
from caselens.sources import tables as t
from caselens.sources.tables import DEVIATIONS, EVENT_LOGS, ORDER_LOGS

EXPECTED = "expected(idx, step_name) as (values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(vocab.STANDARD_STEPS)) + ")"
CASES = """cases as (
  select case_id, first(officer_id order by ts, log_seq) as officer_id, count(*) as n_logs, min(ts) as first_ts, max(ts) as last_ts,
    coalesce(bool_or(lower(step_name) like '%manager%' and lower(step_name) like '%approval%'), false) as has_manager,
    coalesce(bool_or(lower(step_name) like '%final%' and lower(step_name) like '%approval%'), false) as has_final
  from logs group by case_id)"""
PAIRS = """pairs as (
  select case_id, first_value(officer_id) over w as officer_id, step_name as step_1, lead(step_name) over w as step_2, ts as ts_1, lead(ts) over w as ts_2
  from logs window w as (partition by case_id order by ts, log_seq))"""
MISSING = """missing as (
  select c.case_id, c.officer_id, 'missing_step' as deviation_type, 'high' as severity, 'Missing required step: ' || e.step_name as description,
    'Step "' || e.step_name || '" should be completed' as expected_behavior, 'Step "' || e.step_name || '" was skipped' as actual_behavior
  from cases c cross join expected e where not exists (select 1 from logs l where l.case_id = c.case_id and l.step_name = e.step_name))"""
WRONG = """wrong as (
  select p.case_id, p.officer_id, 'wrong_sequence' as deviation_type, 'high' as severity, 'Wrong step order: ' || step_2 || ' before ' || step_1 as description,
    step_1 || ' should come before ' || step_2 as expected_behavior, step_2 || ' was performed before ' || step_1 as actual_behavior
  from pairs p join expected a on a.step_name = p.step_1 join expected b on b.step_name = p.step_2 where a.idx > b.idx)"""
EXTRA = """extra as (
  select distinct l.case_id, c.officer_id, 'unexpected_step' as deviation_type, 'medium' as severity, 'Unexpected step performed: ' || l.step_name as description,
    'Only standard SOP steps should be performed' as expected_behavior, 'Unexpected step "' || l.step_name || '" was performed' as actual_behavior
  from logs l join cases c using (case_id) where l.step_name not in (select step_name from expected))"""
MANAGER = """manager as (
  select case_id, officer_id, 'missing_approval' as deviation_type, 'critical' as severity, 'Missing manager approval' as description,
    'Manager approval required before final approval' as expected_behavior, 'Manager approval step not found' as actual_behavior from cases where not has_manager)"""
FINAL = """final as (
  select case_id, officer_id, 'missing_approval' as deviation_type, 'critical' as severity, 'Missing final approval' as description,
    'Final approval required to complete case' as expected_behavior, 'Final approval step not found' as actual_behavior from cases where not has_final)"""
RUSHED = """rushed as (
  select case_id, officer_id, 'timing_violation' as deviation_type, 'medium' as severity, 'Process completed too quickly' as description,
    'Proper review time required for each step' as expected_behavior, date_diff('microsecond', first_ts, last_ts) / 3600000000.0 as duration_hours
  from cases where n_logs >= 2 and date_diff('microsecond', first_ts, last_ts) / 3600000000.0 < 1)"""
GAPS = """gaps as (
  select case_id, officer_id, 'timing_violation' as deviation_type, 'low' as severity, 'Long delay between ' || step_1 || ' and ' || step_2 as description,
    'Steps should be completed in timely manner' as expected_behavior, printf('Gap of %.1f days between steps', date_diff('microsecond', ts_1, ts_2) / 86400000000.0) as actual_behavior
  from pairs where date_diff('microsecond', ts_1, ts_2) / 86400000000.0 > 7)"""
BASE = f"with {ORDER_LOGS}, {EXPECTED}, {CASES}, {PAIRS}"
EBASE = f"with {EVENT_LOGS}, {EXPECTED}, {CASES}, {PAIRS}"
PLAIN = ["case_id", "officer_id", "deviation_type", "severity", "description", "expected_behavior", "actual_behavior"]
ALL = ", ".join([MISSING, WRONG, EXTRA, MANAGER, FINAL, RUSHED, GAPS])
EVERY = f"""found as (
  select {', '.join(PLAIN)} from missing union all select {', '.join(PLAIN)} from wrong union all select {', '.join(PLAIN)} from extra
  union all select {', '.join(PLAIN)} from manager union all select {', '.join(PLAIN)} from final
  union all select {', '.join(PLAIN[:-1])}, printf('Process completed in %.1f hours', duration_hours) from rushed union all select {', '.join(PLAIN)} from gaps)"""


def _profiles(spark, sf):
    return d.case_profiles(t.order_logs(spark, sf))


def _expected(spark):
    return d.expected_sequence(t.rules(spark))


def found_in_orders(spark, sf):
    return d.detect(t.order_logs(spark, sf), t.rules(spark))


PHRASES = [p for p, _ in vocab.STEP_PHRASES] + ["nothing in particular"]
NAMED = " ".join(f"when lower(rule_description) like '%{p}%' then '{s}'" for p, s in vocab.STEP_PHRASES)


@query("d1_expected_sequence", f"""
with rules as (
  select p_partkey as rule_id, case when p_size % 2 = 0 then 'sequence' else 'timing' end as rule_type, 'Then Complete ' || {PHRASES}[p_partkey % 9 + 1] || ' for ' || p_brand as rule_description,
    case when p_size % 3 <> 0 then p_size end as step_number from part
), named as (select *, case {NAMED} end as step_name from rules where rule_type = 'sequence')
select (row_number() over (order by coalesce(step_number, 999), rule_id) - 1)::int as idx, step_name from named where step_name is not null""")
def d1(spark, sf):
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % 9).cast("int"))
    rules = t.read(spark, sf, "part").select(
        F.col("p_partkey").alias("rule_id"), F.when(F.col("p_size") % 2 == 0, "sequence").otherwise("timing").alias("rule_type"),
        F.concat(F.lit("Then Complete "), phrase, F.lit(" for "), "p_brand").alias("rule_description"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("step_number"))
    return d.expected_sequence(rules)


@query("d2_case_sequences", f"""with {ORDER_LOGS}
select case_id, first(officer_id order by ts, log_seq) as officer_id, string_agg(step_name, ' > ' order by ts, log_seq) as actual_sequence from logs group by case_id""")
def d2(spark, sf):
    return d.sequences(t.order_logs(spark, sf)).select("case_id", "officer_id", F.array_join("actual_sequence", " > ").alias("actual_sequence"))


@query("d3_missing_step", f"{BASE}, {MISSING} select * from missing")
def d3(spark, sf):
    return d.missing_steps(_profiles(spark, sf), _expected(spark)).select(PLAIN)


@query("d4_wrong_sequence", f"{BASE}, {WRONG} select * from wrong")
def d4(spark, sf):
    return d.wrong_order(d.step_pairs(t.order_logs(spark, sf)), _expected(spark)).select(PLAIN)


@query("d5_unexpected_step", f"{EBASE}, {EXTRA} select * from extra")
def d5(spark, sf):
    return d.unexpected_steps(d.case_profiles(t.event_logs(spark, sf)), _expected(spark)).select(PLAIN)


@query("d6_missing_manager_approval", f"{BASE}, {MANAGER} select * from manager")
def d6(spark, sf):
    return d.missing_approvals(_profiles(spark, sf), t.rules(spark), ("manager",)).select(PLAIN)


@query("d7_missing_final_approval", f"{BASE}, {FINAL} select * from final")
def d7(spark, sf):
    return d.missing_approvals(_profiles(spark, sf), t.rules(spark), ("final",)).select(PLAIN)


@query("d8_rushed_case", f"{EBASE}, {RUSHED} select case_id, officer_id, severity, description, round(duration_hours, 6) as duration_hours from rushed")
def d8(spark, sf):
    found = d.rushed_cases(d.case_profiles(t.event_logs(spark, sf)), t.rules(spark))
    return found.select("case_id", "officer_id", "severity", "description", F.round("context.duration_hours", 6).alias("duration_hours"))


@query("d9_long_gap", f"{BASE}, {GAPS} select * from gaps")
def d9(spark, sf):
    return d.long_gaps(d.step_pairs(t.order_logs(spark, sf)), t.rules(spark)).select(PLAIN)


@query("d10_all_deviations", f"{BASE}, {ALL}, {EVERY} select *, null::bigint as rule_id from found")
def d10(spark, sf):
    return found_in_orders(spark, sf).select(*PLAIN, "rule_id")


@query("d10_approval_checks", f"{BASE}, {ALL}, {EVERY} select * from found where deviation_type in ('missing_approval', 'timing_violation')")
def d10_approval(spark, sf):
    return d.detect(t.order_logs(spark, sf), t.rules(spark), ("approval", "timing")).select(PLAIN)


@query("d11_case_officer", f"{BASE} select case_id, officer_id, n_logs, strftime(first_ts, '%Y-%m-%d %H:%M:%S') as first_ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S') as last_ts from cases")
def d11(spark, sf):
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_ts", "last_ts")]
    return _profiles(spark, sf).select("case_id", "officer_id", "n_logs", *times)


@query("d12_deviation_texts", f"{BASE}, {ALL}, {EVERY} select deviation_type, description, expected_behavior, actual_behavior, count(*) as n from found group by all")
def d12(spark, sf):
    return found_in_orders(spark, sf).groupBy("deviation_type", "description", "expected_behavior", "actual_behavior").agg(F.count(F.lit(1)).alias("n"))


NOTES = """noted as (
  select case_id, string_agg('[' || step_name || '] ' || notes, ' | ' order by ts, log_seq) as notes from logs
  where notes is not null and case_id in (select case_id from wrong) group by case_id)"""


@query("d13_case_notes", f"{BASE}, {WRONG}, {NOTES} select * from noted")
def d13(spark, sf):
    logs = t.order_logs(spark, sf)
    return d.case_notes(logs, d.wrong_order(d.step_pairs(logs), _expected(spark)))


@query("d14_deviations_with_notes", f"{BASE}, {WRONG}, {NOTES} select w.case_id, w.description, n.notes from wrong w left join noted n using (case_id)")
def d14(spark, sf):
    logs = t.order_logs(spark, sf)
    found = d.wrong_order(d.step_pairs(logs), _expected(spark))
    return d.with_notes(found, d.case_notes(logs, found)).select("case_id", "description", "notes")


@query("d15_run_summary", f"""{BASE}, {ALL}, {EVERY}
select (select count(distinct case_id) from logs) as cases, (select count(*) from logs) as logs, (select count(distinct officer_id) from logs) as officers, count(*) as deviations,
  count_if(severity = 'critical')::bigint as critical, count_if(severity = 'high')::bigint as high, count_if(severity = 'medium')::bigint as medium, count_if(severity = 'low')::bigint as low from found""")
def d15(spark, sf):
    return d.run_summary(t.order_logs(spark, sf), found_in_orders(spark, sf))


@query("d16_synthetic_batches", f"""{BASE}, {WRONG}, both_batches as (select true as is_synthetic, * from wrong where case_id::bigint % 2 = 0 union all select null, * from wrong where case_id::bigint % 2 = 1)
select coalesce(is_synthetic, false) as is_synthetic, deviation_type, count(*) as n from both_batches group by all""")
def d16(spark, sf):
    found = d.wrong_order(d.step_pairs(t.order_logs(spark, sf)), _expected(spark))
    even = F.col("case_id").cast("long") % 2 == 0
    real = found.where(~even).withColumn("context", F.col("context").withField("is_synthetic", F.lit(None).cast("boolean")))
    both = d.tagged_synthetic(found.where(even)).unionByName(real)
    return both.groupBy(F.coalesce("context.is_synthetic", F.lit(False)).alias("is_synthetic"), "deviation_type").agg(F.count(F.lit(1)).alias("n"))


@query("d17_notes_of_case", f"with {ORDER_LOGS} select log_seq, step_name, notes from logs where case_id = '7' and notes is not null")
def d17(spark, sf):
    return d.log_notes(t.order_logs(spark, sf), "7")


@query("d18_edited_notes", f"""with {DEVIATIONS}, edits as (
  select l_orderkey, min(deviation_id) as deviation_id from (select deviation_id, case_id as l_orderkey from devs) group by l_orderkey)
select d.deviation_id, case when e.deviation_id is not null then 'Reviewed order ' || d.case_id else d.notes end as notes, case when e.deviation_id is not null then 'auditor' end as edited_by
from devs d left join edits e using (deviation_id)""")
def d18(spark, sf):
    found = t.deviations(spark, sf)
    edits = found.groupBy("case_id").agg(F.min("deviation_id").alias("deviation_id")).select(
        "deviation_id", F.concat(F.lit("Reviewed order "), "case_id").alias("notes"), F.lit("auditor").alias("edited_by"), F.lit("2025-01-15 10:00:00").alias("edited_at"))
    return d.edited_notes(found, edits).select("deviation_id", "notes", "edited_by")


@query("entry_deviation_counts", f"{BASE}, {ALL}, {EVERY} select deviation_type, severity, count(*) as n from found where deviation_type in ('missing_step', 'wrong_sequence', 'unexpected_step') group by all")
def entry(spark, sf):
    found = d.detect(t.order_logs(spark, sf), t.rules(spark), ("sequence",))
    return found.groupBy("deviation_type", "severity").agg(F.count(F.lit(1)).alias("n"))
