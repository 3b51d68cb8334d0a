"""The deviations of the order lines as text for a model, and answers read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.operators import stats
from caselens.operators import textbatch as b
from caselens.operators.ml import clusters
from caselens.queries.ml import LABELLED, labelled
from caselens.registry import query
from caselens.sources import tables as t
from caselens.sources.tables import DEVIATIONS, ORDER_LOGS

BATCHED = f"{DEVIATIONS}, batched as (select *, row_number() over (order by deviation_id) - 1 as position from devs)"
BLOCK = """'Deviation ' || (position % 100 + 1)::varchar || ':' || chr(10) || '- Case ID: ' || case_id || chr(10) || '- Officer ID: ' || officer_id || chr(10) || '- Type: ' || deviation_type || chr(10) || '- Severity: ' || severity
  || chr(10) || '- Description: ' || description || chr(10) || '- Expected: ' || expected_behavior || chr(10) || '- Actual: ' || actual_behavior || chr(10) || '- Notes: ' || coalesce(nullif(notes, ''), 'No notes/comments available')"""


@query("i1_batches", f"with {BATCHED} select deviation_id, position, position // 100 as batch from batched")
def i1(spark, sf):
    return b.batched(t.deviations(spark, sf).select("deviation_id")).select("deviation_id", "position", "batch")


@query("i2_batch_texts", f"with {BATCHED} select position // 100 as batch, count(*) as n, string_agg({BLOCK}, chr(10) || chr(10) order by position) as text from batched group by 1")
def i2(spark, sf):
    return b.batch_texts(t.deviations(spark, sf))


@query("i3_statistics_text", f"""with {DEVIATIONS}, n as (select count(*) as total, count(distinct case_id) as cases, count(distinct officer_id) as officers from devs),
sev as (select string_agg('- ' || upper(severity[1]) || severity[2:] || ': ' || c::varchar || ' (' || p::varchar || '%)', chr(10) order by list_position(['critical', 'high', 'medium', 'low'], severity)) as lines
  from (select severity, count(*) as c, round(100.0 * count(*) / (select total from n), 2)::double as p from devs group by severity)),
kinds as (select string_agg('- ' || deviation_type || ': ' || c::varchar || ' (' || p::varchar || '%)', chr(10) order by c desc, deviation_type) as lines
  from (select deviation_type, count(*) as c, round(100.0 * count(*) / (select total from n), 2)::double as p from devs group by deviation_type order by c desc, deviation_type limit 5))
select 'Overview:' || chr(10) || '- Total Deviations: ' || total::varchar || chr(10) || '- Unique Cases: ' || cases::varchar || chr(10) || '- Unique Officers: ' || officers::varchar || chr(10)
  || 'Severity Distribution:' || chr(10) || sev.lines || chr(10) || 'Top Deviation Types:' || chr(10) || kinds.lines as context from n, sev, kinds""")
def i3(spark, sf):
    devs = t.deviations(spark, sf)
    return b.statistics_text(stats.overview(devs), stats.severity_distribution(devs), stats.top_types(devs, 5))


@query("i4_cluster_text", f"""with {LABELLED}, sizes as (select cluster, count(*) as size from rows where cluster <> -1 group by cluster),
sev as (select cluster, first(severity order by n desc, severity) as s from (select cluster, severity, count(*) as n from rows group by all) group by cluster),
kind as (select cluster, first(deviation_type order by n desc, deviation_type) as k from (select cluster, deviation_type, count(*) as n from rows group by all) group by cluster)
select string_agg('CLUSTER_' || cluster::varchar || ': ' || size::varchar || ' deviations, top type ' || k || ', top severity ' || s, chr(10) order by cluster) as context from sizes join sev using (cluster) join kind using (cluster)""")
def i4(spark, sf):
    return b.cluster_text(clusters.summary(labelled(spark, sf)))


@query("i5_case_texts", f"""with {ORDER_LOGS}, n as (select *, row_number() over (partition by case_id order by ts, log_seq) as nth from logs)
select case_id, string_agg(nth::varchar || '. Step: ' || step_name || ', Action: ' || action || ', Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ', Status: ' || coalesce(status, 'N/A'), chr(10) order by nth) as text,
  coalesce(string_agg('[' || step_name || '] ' || notes, ' | ' order by nth) filter (notes <> ''), 'No notes available for this case') as notes from n group by case_id""")
def i5(spark, sf):
    return b.case_texts(t.order_logs(spark, sf))


@query("i6_unanswered", f"with {BATCHED} select position // 100 as batch, count(*) as n, null::varchar as answer from batched group by 1")
def i6(spark, sf):
    return b.answered(b.batch_texts(t.deviations(spark, sf))).select("batch", "n", "answer")


@query("i6_answered", f"with {BATCHED} select position // 100 as batch, count(*) as n, count_if(severity = 'critical')::varchar || ' critical' as summary, 1::int as calls from batched group by 1")
def i6_answered(spark, sf):
    rows = b.parsed(b.answered(b.batch_texts(t.deviations(spark, sf)), b.counting), F.col("answer"))
    return rows.select("batch", "n", F.col("result.overall_summary").alias("summary"), F.col("result.api_calls_made").alias("calls"))


# A fifth of the answers is whole and fenced with a trailing comma, a fifth bare with objects for recommendations, a fifth lacks a key, a fifth is
# no JSON, and a fifth has all fields that an answer can have.
ANSWERS = """answers as (select event_id as batch, event_type as e, case event_id % 5
  when 0 then 'Sure:' || chr(10) || '```json' || chr(10) || '{"overall_summary": "s' || event_id::varchar || '", "behavioral_patterns": [{"pattern": "' || event_type || '", "frequency": "1", "risk_level": "high", "officers_involved": ["a", "b"], "supporting_evidence": "x"}], "hidden_rules": [], "systemic_issues": [], "recommendations": ["check ' || event_type || '"], "api_calls_made": 2, }' || chr(10) || '```'
  when 1 then '{"overall_summary": "t", "behavioral_patterns": [], "hidden_rules": [], "systemic_issues": [], "recommendations": [{"priority": "high", "recommendation": "do ' || event_type || '"}, {"recommendation": "more"}]}'
  when 2 then '{"overall_summary": "no lists"}' when 3 then 'not json'
  else '{"overall_summary": "u", "behavioral_patterns": [], "hidden_rules": [{"rule": "' || event_type || '", "confidence": "high", "evidence": "y", "compliance_impact": "z"}], "systemic_issues": [{"issue": "i", "frequency": "2", "impact": "m", "recommended_fix": "fix ' || event_id::varchar || '"}], "time_patterns": [{"pattern": "p", "reason": "r", "recommendation": "q"}], "justification_analysis": {"most_common_reasons": [{"reason": "w", "count": 3, "percentage": "33%"}], "justified_count": 1, "not_justified_count": 2, "unclear_count": ' || (event_id % 7)::varchar || '}, "risk_insights": ["k"], "recommendations": [], "deviations_analyzed": 9}' end as answer from events)"""


def answers(spark, sf):
    k, e, i = F.col("event_id") % 5, F.col("event_type"), F.col("event_id").cast("string")
    lists = '"hidden_rules": [], "systemic_issues": [], '
    more = '", "frequency": "1", "risk_level": "high", "officers_involved": ["a", "b"], "supporting_evidence": "x"}], '
    first = F.concat(F.lit('Sure:\n```json\n{"overall_summary": "s'), i, F.lit('", "behavioral_patterns": [{"pattern": "'), e, F.lit(more + lists + '"recommendations": ["check '), e, F.lit('"], "api_calls_made": 2, }\n```'))
    second = F.concat(F.lit('{"overall_summary": "t", "behavioral_patterns": [], ' + lists + '"recommendations": [{"priority": "high", "recommendation": "do '), e, F.lit('"}, {"recommendation": "more"}]}'))
    whole = F.concat(
        F.lit('{"overall_summary": "u", "behavioral_patterns": [], "hidden_rules": [{"rule": "'), e, F.lit('", "confidence": "high", "evidence": "y", "compliance_impact": "z"}], "systemic_issues": [{"issue": "i", "frequency": "2", "impact": "m", "recommended_fix": "fix '), i,
        F.lit('"}], "time_patterns": [{"pattern": "p", "reason": "r", "recommendation": "q"}], "justification_analysis": {"most_common_reasons": [{"reason": "w", "count": 3, "percentage": "33%"}], "justified_count": 1, "not_justified_count": 2, "unclear_count": '),
        (F.col("event_id") % 7).cast("string"), F.lit('}, "risk_insights": ["k"], "recommendations": [], "deviations_analyzed": 9}'))
    text = F.when(k == 0, first).when(k == 1, second).when(k == 2, '{"overall_summary": "no lists"}').when(k == 3, "not json").otherwise(whole)
    return t.read(spark, sf, "events").select(F.col("event_id").alias("batch"), text.alias("answer"))


@query("i7_parsed_answers", f"""with {ANSWERS} select batch, case batch % 5 when 0 then 's' || batch::varchar when 1 then 't' when 4 then 'u' else 'unread' end as summary, (batch % 5 = 0)::int as n_patterns,
  case when batch % 5 = 0 then 2 when batch % 5 in (2, 3) then 0 end::int as calls, case batch % 5 when 0 then 'check ' || e when 1 then '[high] do ' || e || '|[NORMAL] more' else '' end as recommendations,
  case when batch % 5 = 0 then 'a,b' end as officers, case when batch % 5 = 4 then e || '/high/y/z' end as rule, case when batch % 5 = 4 then 'i/2/m/fix ' || batch::varchar end as issue, case when batch % 5 = 4 then 'p/r/q' end as time_pattern,
  case when batch % 5 = 4 then 'w/3/33%' end as reason, case when batch % 5 = 4 then (batch % 7)::int when batch % 5 in (2, 3) then 0 end as unclear, case when batch % 5 = 4 then 9 when batch % 5 in (2, 3) then 0 end::int as analyzed from answers""")
def i7(spark, sf):
    r = F.col("result")

    def first(name: str, *parts: str):
        return F.concat_ws("/", *[F.get(r[name], F.lit(0))[p].cast("string") for p in parts])

    def filled(c):
        return F.nullif(c, F.lit(""))

    reasons = r["justification_analysis"]["most_common_reasons"]
    reason = F.concat_ws("/", *[F.get(reasons, F.lit(0))[p].cast("string") for p in ("reason", "count", "percentage")])
    return b.parsed(answers(spark, sf), F.col("answer")).select(
        "batch", r["overall_summary"].alias("summary"), F.size(r["behavioral_patterns"]).alias("n_patterns"), r["api_calls_made"].alias("calls"), F.array_join(r["recommendations"], "|").alias("recommendations"),
        F.array_join(F.get(r["behavioral_patterns"], F.lit(0))["officers_involved"], ",").alias("officers"), filled(first("hidden_rules", "rule", "confidence", "evidence", "compliance_impact")).alias("rule"),
        filled(first("systemic_issues", "issue", "frequency", "impact", "recommended_fix")).alias("issue"), filled(first("time_patterns", "pattern", "reason", "recommendation")).alias("time_pattern"), filled(reason).alias("reason"),
        r["justification_analysis"]["unclear_count"].alias("unclear"), r["deviations_analyzed"].alias("analyzed"))


@query("i8_merged_answers", f"""with {ANSWERS}, n as (select count(*) as batches, sum(case when batch % 5 = 4 then 9 else 0 end)::bigint as analyzed from answers)
select batches, (select sum(case batch % 5 when 0 then 2 when 1 then 1 when 4 then 1 else 0 end)::bigint from answers) as api_calls_made, analyzed as deviations_analyzed,
  'Aggregated analysis from ' || batches::varchar || ' batches covering ' || analyzed::varchar || ' deviations' as summary,
  (select string_agg(e, ',' order by batch) from (select * from answers where batch % 5 = 0 order by batch limit 10)) as patterns,
  (select string_agg('fix ' || batch::varchar, ',' order by batch) from (select * from answers where batch % 5 = 4 order by batch limit 5)) as fixes,
  (select string_agg(r, ',' order by batch, place) from (select * from (select batch, 0 as place, case batch % 5 when 0 then 'check ' || e when 1 then '[high] do ' || e end as r from answers where batch % 5 < 2
    union all select batch, 1, '[NORMAL] more' from answers where batch % 5 = 1) order by batch, place limit 10)) as recommendations from n""")
def i8(spark, sf):
    rows = b.merged(b.parsed(answers(spark, sf), F.col("answer")).select("batch", "result"))
    return rows.select(
        "batches", "api_calls_made", "deviations_analyzed", F.col("overall_summary").alias("summary"), F.array_join(F.transform("behavioral_patterns", lambda x: x["pattern"]), ",").alias("patterns"),
        F.array_join(F.transform("systemic_issues", lambda x: x["recommended_fix"]), ",").alias("fixes"), F.array_join("recommendations", ",").alias("recommendations"))


@query("i9_usage", "select count(*) as total_calls, sum(length(text))::bigint as input_tokens, sum(turn)::bigint as output_tokens, round(sum(length(text)) * 0.003::double / 1000 + sum(turn) * 0.015::double / 1000, 6) as cost from conversations")
def i9(spark, sf):
    calls = t.read(spark, sf, "conversations").select(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return b.usage(calls)
