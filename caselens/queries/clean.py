"""Cleaning of the raw deviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators import clean as c
from caselens.registry import query
from caselens.sources import tables as t
from caselens.sources.tables import RAW_DEVIATIONS

SPELLINGS = " ".join(f"when '{a}' then '{b}'" for a, b in vocab.SEVERITY_SPELLINGS.items())
SEVERITIES = ", ".join(f"'{s}'" for s in vocab.SEVERITIES)
TYPES = ", ".join(f"'{s}'" for s in vocab.DEVIATION_TYPES)
# The raw rows have no white space beyond blanks and tabs.
STRIP = "regexp_replace({0}, '^[ \\t]+|[ \\t]+$', '', 'g')"
SPACED = "regexp_replace(regexp_replace({0}, '^[ \\t]+|[ \\t]+$', '', 'g'), '[ \\t]+', ' ', 'g')"
SEVERITY = f"case when lower({STRIP.format('severity')}) in ({SEVERITIES}) then lower({STRIP.format('severity')}) else case lower({STRIP.format('severity')}) {SPELLINGS} else 'medium' end end"
TYPE = f"regexp_replace(lower({STRIP.format('deviation_type')}), '[- ]+', '_', 'g')"
MARKED = f"""marked as (
  select *, row_number() over (partition by {STRIP.format('case_id')}, {STRIP.format('officer_id')}, lower({STRIP.format('deviation_type')}) order by deviation_id) > 1 as is_duplicate from raw)"""
TYPED = f"""typed as (
  select * replace ({SEVERITY} as severity, {TYPE} as deviation_type), (lower({STRIP.format('severity')}) not in ({SEVERITIES}))::int + ({TYPE} <> deviation_type)::int as type_fixes from marked)"""
FLAGGED = f"""flagged as (
  select * replace (coalesce(expected_behavior, 'Not specified') as expected_behavior, coalesce(notes, '') as notes),
    {STRIP.format('case_id')} = '' or {STRIP.format('description')} = '' as is_missing from typed), spaced as (
  select * replace ({SPACED.format('description')} as description), ({SPACED.format('description')} <> description)::int as text_fixes from flagged), done as (
  select *, case when length(description) < 10 then 'Description too short' end as validation_error from spaced)"""
BASE = f"with {RAW_DEVIATIONS}, {MARKED}, {TYPED}, {FLAGGED}"
KEPT = "not is_duplicate and not is_missing"
REPORT = f"""report as (
  select count(*) as original_count, count_if(is_duplicate)::bigint as duplicates_removed, coalesce(sum(type_fixes) filter (not is_duplicate), 0)::bigint as type_fixes,
    count_if(not is_duplicate and is_missing)::bigint as missing_handled, coalesce(sum(text_fixes) filter ({KEPT}), 0)::bigint as text_fields_normalized,
    count_if({KEPT} and validation_error is not null)::bigint as validation_errors, count_if({KEPT} and validation_error is null)::bigint as final_count from done)"""
COLUMNS = ["deviation_id", "case_id", "officer_id", "deviation_type", "severity", "description", "expected_behavior", "actual_behavior", "notes"]


@query("e1_dedupe", f"with {RAW_DEVIATIONS}, {MARKED} select {', '.join(COLUMNS)} from marked where not is_duplicate")
def e1(spark, sf):
    return c.without_duplicates(t.raw_deviations(spark, sf), "deviation_id").select(COLUMNS)


@query("e2_text_types", f"with {RAW_DEVIATIONS} select deviation_id, case_id, officer_id, deviation_type, severity, description from raw")
def e2(spark, sf):
    return c.as_text(t.raw_deviations(spark, sf)).select("deviation_id", *c.REQUIRED)


@query("e3_severity", f"with {RAW_DEVIATIONS} select deviation_id, {SEVERITY} as severity, lower({STRIP.format('severity')}) not in ({SEVERITIES}) as fixed from raw")
def e3(spark, sf):
    s = F.col("severity")
    return t.raw_deviations(spark, sf).select("deviation_id", c.severity_of(s).alias("severity"), c.severity_fixed(s).alias("fixed"))


@query("e4_type", f"with {RAW_DEVIATIONS} select deviation_id, {TYPE} as deviation_type, {TYPE} <> deviation_type as fixed, {TYPE} not in ({TYPES}) as unknown from raw")
def e4(spark, sf):
    k = F.col("deviation_type")
    return t.raw_deviations(spark, sf).select("deviation_id", c.type_of(k).alias("deviation_type"), c.type_fixed(k).alias("fixed"), c.type_unknown(k).alias("unknown"))


@query("e5_missing_values", f"{BASE} select deviation_id, is_missing, expected_behavior, notes from done")
def e5(spark, sf):
    return c.flagged(t.raw_deviations(spark, sf), steps=("types", "missing")).select("deviation_id", "is_missing", "expected_behavior", "notes")


@query("e6_text", f"{BASE} select deviation_id, description, text_fixes from done")
def e6(spark, sf):
    return c.flagged(t.raw_deviations(spark, sf)).select("deviation_id", "description", "text_fixes")


@query("e7_quarantine", f"""{BASE} select deviation_id, case when is_duplicate then 'Duplicate' when is_missing then 'Missing required value' else validation_error end as reject_reason
from done where is_duplicate or is_missing or validation_error is not null""")
def e7(spark, sf):
    return c.rejected(t.raw_deviations(spark, sf)).select("deviation_id", "reject_reason")


@query("e8_report", f"{BASE}, {REPORT} select *, round(100.0 * final_count / original_count, 2) as retained_pct from report")
def e8(spark, sf):
    return c.report(t.raw_deviations(spark, sf))


@query("e8_cleaned", f"{BASE} select {', '.join(COLUMNS)} from done where {KEPT} and validation_error is null")
def e8_cleaned(spark, sf):
    return c.cleaned(t.raw_deviations(spark, sf)).select(COLUMNS)


@query("e9_quality_score", f"""{BASE}, {REPORT}, scored as (
  select round(greatest(0.0, 100 - 100.0 * (duplicates_removed + type_fixes + missing_handled) / original_count), 2) as quality_score from report)
select quality_score, case when quality_score >= 95 then 'A' when quality_score >= 85 then 'B' when quality_score >= 70 then 'C' when quality_score >= 60 then 'D' else 'F' end as grade from scored""")
def e9(spark, sf):
    return c.graded(c.report(t.raw_deviations(spark, sf))).select("quality_score", "grade")
