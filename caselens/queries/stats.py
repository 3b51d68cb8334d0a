"""Statistics over the deviations of the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import times, vocab
from caselens.operators import stats as s
from caselens.registry import query
from caselens.sources import tables as t
from caselens.sources.tables import DEVIATIONS

W = f"with {DEVIATIONS}"
SEV = "count_if(severity = 'critical')::bigint as critical, count_if(severity = 'high')::bigint as high, count_if(severity = 'medium')::bigint as medium, count_if(severity = 'low')::bigint as low"
SEVERITY_TABLE = "sev(position, severity, weight) as (values (0, 'critical', 4), (1, 'high', 3), (2, 'medium', 2), (3, 'low', 1))"
DAYS = "days(position, weekday) as (values " + ", ".join(f"({i}, '{d}')" for i, d in enumerate(vocab.WEEKDAYS)) + ")"
CATEGORY = "case " + " ".join("when " + " or ".join(f"deviation_type like '%{w}%'" for w in words) + f" then '{c}'" for c, words in vocab.CATEGORIES) + " else 'other' end"


def bands(score: str, table) -> str:
    return "case " + " ".join(f"when {score} >= {least} then '{text}'" for least, text in table if least is not None) + f" else '{table[-1][1]}' end"


@query("f1_overview", f"""{W} select count(*) as total_deviations, count(distinct case_id) as unique_cases, count(distinct officer_id) as unique_officers,
  round(count(*) / count(distinct case_id), 2) as average_deviations_per_case, round(count(*) / count(distinct officer_id), 2) as average_deviations_per_officer from devs""")
def f1(spark, sf):
    return s.overview(t.deviations(spark, sf))


@query("f2_severity_distribution", f"""{W}, {SEVERITY_TABLE} select sev.position::int as position, sev.severity, count(devs.severity) as count, round(100.0 * count(devs.severity) / (select count(*) from devs), 2) as percentage
from sev left join devs using (severity) group by all""")
def f2(spark, sf):
    return s.severity_distribution(t.deviations(spark, sf))


@query("f3_severity_score", f"""{W}, {SEVERITY_TABLE}, scored as (select round(sum(weight) / count(*)::double * 25, 2) as severity_score from devs join sev using (severity))
select severity_score, {bands('severity_score', vocab.SEVERITY_BANDS)} as severity_assessment,
  (select severity from devs join sev using (severity) group by severity, position order by count(*) desc, position limit 1) as most_common_severity from scored""")
def f3(spark, sf):
    return s.severity_score(t.deviations(spark, sf))


@query("f4_top_types", f"""{W}, n as (select deviation_type, count(*) as count from devs group by all)
select deviation_type, count, round(100.0 * count / (select sum(count) from n), 2) as percentage, (select count(*) from n) as unique_types from n order by count desc, deviation_type limit 10""")
def f4(spark, sf):
    return s.top_types(t.deviations(spark, sf))


@query("f5_categories", f"""{W} select {CATEGORY} as category, count(*) as count, round(100.0 * count(*) / (select count(*) from devs), 2) as percentage from devs group by 1""")
def f5(spark, sf):
    return s.categories(t.deviations(spark, sf))


@query("f6_event_time", """with texts as (
  select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250' when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d') when 3 then 'not a time' end as detected_at,
    strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at from events), chosen as (select event_id, split_part(coalesce(detected_at, created_at), '.', 1) as x from texts)
select event_id, strftime(coalesce(try_strptime(x, '%Y-%m-%dT%H:%M:%S'), try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') as event_time from chosen""")
def f6(spark, sf):
    k, ts = F.col("event_id") % 5, F.col("ts")
    texts = t.read(spark, sf, "events").select(
        "event_id", F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250"))).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd")).when(k == 3, "not a time").alias("detected_at"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    return texts.select("event_id", F.date_format(times.event_time(texts), "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("f7_by_hour", f"{W}, h as (select unnest(range(24)) as h) select printf('%02d:00', h) as hour, count(detected_at) as count from h left join devs on hour(detected_at) = h group by all")
def f7(spark, sf):
    return s.by_hour(t.deviations(spark, sf))


@query("f8_by_weekday", f"{W}, {DAYS} select position::int as position, weekday, count(detected_at) as count from days left join devs on isodow(detected_at) - 1 = position group by all")
def f8(spark, sf):
    return s.by_weekday(t.deviations(spark, sf))


@query("f9_peak_hours", f"{W} select printf('%02d:00', hour(detected_at)) as hour, count(*) as count from devs group by all order by count desc, hour limit 3")
def f9(spark, sf):
    return s.peak_hours(t.deviations(spark, sf))


@query("f9_peak_days", f"{W} select dayname(detected_at) as weekday, count(*) as count from devs group by weekday, isodow(detected_at) order by count desc, isodow(detected_at) limit 3")
def f9_days(spark, sf):
    return s.peak_days(t.deviations(spark, sf))


PERIOD = "case when hour(detected_at) < 6 then 'night' when hour(detected_at) < 12 then 'morning' when hour(detected_at) < 18 then 'afternoon' else 'evening' end"


@query("f10_by_period", f"{W} select {PERIOD} as period, count(*) as count, round(100.0 * count(*) / (select count(*) from devs), 2) as percentage from devs group by 1")
def f10(spark, sf):
    return s.by_period(t.deviations(spark, sf))


@query("f11_date_range", f"{W} select strftime(min(detected_at), '%Y-%m-%d') as first_day, strftime(max(detected_at), '%Y-%m-%d') as last_day, count(*) as timed from devs")
def f11(spark, sf):
    return s.date_range(t.deviations(spark, sf))


def entities(key: str, other: str, n: int) -> str:
    return f"""{W}, totals as (select {key}, count(*) as total, count(distinct {other}) as others, {SEV} from devs group by {key}),
  types as (select {key}, first(deviation_type order by n desc, deviation_type) as top_type from (select {key}, deviation_type, count(*) as n from devs group by all) group by {key})
select {key}, total, others, round(total / others, 2) as average, critical, high, medium, low, top_type from totals join types using ({key}) order by total desc, {key} limit {n}"""


def spread(key: str) -> str:
    return f"""{W}, n as (select count(*) as n from devs group by {key})
select round(avg(n), 2) as mean, median(n)::double as median, round(stddev_samp(n), 2) as std_dev, min(n) as min, max(n) as max from n"""


@query("f12_officer_top20", entities("officer_id", "case_id", 20))
def f12(spark, sf):
    return s.top_entities(t.deviations(spark, sf), "officer_id", "case_id", 20)


@query("f13_officer_spread", spread("officer_id"))
def f13(spark, sf):
    return s.spread(t.deviations(spark, sf), "officer_id")


@query("f14_case_top10", entities("case_id", "officer_id", 10))
def f14(spark, sf):
    return s.top_entities(t.deviations(spark, sf), "case_id", "officer_id", 10)


@query("f15_case_spread", spread("case_id"))
def f15(spark, sf):
    return s.spread(t.deviations(spark, sf), "case_id")


@query("f16_severity_by_type", f"""{W}, n as (select severity, deviation_type, count(*) as count from devs group by all)
select *, row_number() over (partition by severity order by count desc, deviation_type)::int as rank from n qualify rank <= 3""")
def f16(spark, sf):
    return s.severity_by_type(t.deviations(spark, sf))


@query("f17_high_risk_officers", f"""{W}, n as (select officer_id, count(*) as total, {SEV} from devs group by officer_id)
select officer_id, round((4 * critical + 3 * high) / (4 * total) * 100, 2) as risk_score, total, critical, high from n where round((4 * critical + 3 * high) / (4 * total) * 100, 2) > 25
order by risk_score desc, officer_id limit 10""")
def f17(spark, sf):
    return s.high_risk_officers(t.deviations(spark, sf), least=25)


@query("f18_critical_mass", f"""{W}, n as (select count(*) as total, {SEV} from devs), scored as (select round(100.0 * critical / total + 75.0 * high / total, 2) as critical_mass_score from n)
select critical_mass_score, {bands('critical_mass_score', vocab.CRITICAL_MASS_BANDS)} as critical_mass_assessment from scored""")
def f18(spark, sf):
    return s.critical_mass(t.deviations(spark, sf))


@query("f19_concentration", f"""{W}, n as (select officer_id, count(*) as count from devs group by all), best as (select sum(count) as best from (select count from n order by count desc, officer_id limit 5))
select round(100.0 * best / (select sum(count) from n), 2) as top_officer_percentage, round(100.0 * best / (select sum(count) from n), 2) > 50 as is_concentrated, (select count(*) from n) as unique_officers from best""")
def f19(spark, sf):
    return s.concentration(t.deviations(spark, sf))


@query("f20_diversity", f"""{W} select count(distinct deviation_type) as unique_types, round(100.0 * count(distinct deviation_type) / count(*), 2) as diversity_score,
  case when count(distinct deviation_type) > 15 then 'High diversity' else 'Low diversity' end as assessment from devs""")
def f20(spark, sf):
    return s.diversity(t.deviations(spark, sf))


@query("f21_summary", f"""{W} select 'overview' as measure, 'total' as key, count(*) as value from devs union all select 'overview', 'cases', count(distinct case_id) from devs
union all select 'overview', 'officers', count(distinct officer_id) from devs union all select 'severity', severity, count(*) from devs group by severity
union all (select 'type', deviation_type, count(*) as n from devs group by deviation_type order by n desc, deviation_type limit 5)""")
def f21(spark, sf):
    return s.summary(t.deviations(spark, sf))
