"""Rules in the documents: every document is read as a procedure text."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators import sop as s
from caselens.registry import query
from caselens.sources import tables as t

SENTENCES = r"""parts as (select doc_id as sop_id, unnest(range(0, len(x))) as position, unnest(x) as part from (select doc_id, string_split_regex(text, '[.!?]+') as x from documents)),
sentences as (select sop_id, position::int as position, regexp_replace(part, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') as sentence from parts where regexp_replace(part, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') <> '')"""


def _case(value: int) -> str:
    whens = " ".join(f"when regexp_matches(lower(sentence), '{'|'.join(p)}') then '{(name, level)[value]}'" for name, level, p in vocab.RULE_PATTERNS)
    return f"case {whens} end"


TIME = r"(\d+)\s+(days?|hours?|weeks?|months?)"
RULES = rf"""rules as (select sop_id, position, {_case(0)} as rule_type, sentence as rule_description, try_cast(nullif(regexp_extract(lower(sentence), 'step\s+(\d+)', 1), '') as int) as step_number, {_case(1)} as severity,
  try_cast(nullif(regexp_extract(lower(sentence), '{TIME}', 1), '') as int) as duration, nullif(regexp_extract(lower(sentence), '{TIME}', 2), '') as unit from sentences where {_case(0)} is not null)"""
W = f"with {SENTENCES}, {RULES}"


def docs(spark, sf):
    return t.read(spark, sf, "documents").select(F.col("doc_id").alias("sop_id"), "text")


def rules(spark, sf):
    return s.extracted_rules(docs(spark, sf))


@query("c1_sentences", f"with {SENTENCES} select * from sentences")
def c1(spark, sf):
    return s.sentences(docs(spark, sf))


@query("c2_rules", f"{W} select sop_id, position, rule_type, severity from rules")
def c2(spark, sf):
    return rules(spark, sf).select("sop_id", "position", "rule_type", "severity")


# The documents have no numbered steps or spans of time, so the next two read sentences made from the order lines.
MADE = """sentences as (select l_orderkey as sop_id, l_linenumber as position, case l_partkey % 4 when 0 then 'Step ' || l_linenumber::varchar || ': verify part ' || l_partkey::varchar
  when 1 then 'Ship within ' || l_quantity::int::varchar || ' days of order' when 2 then 'Confirm after ' || l_linenumber::varchar || '  weeks or 3 months' else 'Nothing to do' end as sentence from lineitem)"""


def made(spark, sf):
    k, n = F.col("l_partkey"), F.col("l_linenumber").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("Step "), n, F.lit(": verify part "), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("Ship within "), F.col("l_quantity").cast("int").cast("string"), F.lit(" days of order")))
    text = text.when(k % 4 == 2, F.concat(F.lit("Confirm after "), n, F.lit("  weeks or 3 months"))).otherwise("Nothing to do")
    return t.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sop_id"), F.col("l_linenumber").alias("position"), text.alias("sentence"))


@query("c3_step_numbers", rf"with {MADE} select sop_id, position, sentence, try_cast(nullif(regexp_extract(lower(sentence), 'step\s+(\d+)', 1), '') as int) as step_number from sentences")
def c3(spark, sf):
    return made(spark, sf).withColumn("step_number", s.step_number(F.col("sentence")))


@query("c4_timing_constraints", f"with {MADE}, {RULES} select sop_id, position, rule_type, case when rule_type = 'timing' then duration end as duration, case when rule_type = 'timing' then unit end as unit from rules")
def c4(spark, sf):
    texts = made(spark, sf).select("sop_id", "position", F.col("sentence"))
    kind, _ = s.kind_of(F.col("sentence"))
    rows = texts.withColumn("rule_type", kind).where("rule_type is not null").withColumn("found", F.when(F.col("rule_type") == "timing", s.timing_constraint(F.col("sentence"))))
    return rows.select("sop_id", "position", "rule_type", "found.duration", "found.unit")


TYPES = ", ".join(f"'{x}'" for x in vocab.RULE_TYPES)


@query("c5_rule_sets", f"{W} select sop_id, count(*) as n_rules, bool_and(rule_type in ({TYPES})) as is_valid from rules group by sop_id")
def c5(spark, sf):
    return s.rule_sets(rules(spark, sf))


# Rule sets that are invalid in each way, and some that aren't: a set for each size of part.
FAULTY = f"""faulty as (select p_size as sop_id, p_partkey as rule_id, case when p_size % 7 = 1 and p_partkey % 3 = 0 then null when p_size % 7 = 2 and p_partkey % 3 = 0 then 'custom' else {list(vocab.RULE_TYPES)}[p_partkey % 16 + 1] end as rule_type,
  case when p_size % 7 = 3 and p_partkey % 3 = 0 then '  ' else p_brand end as rule_description, case when p_size % 7 = 4 and p_partkey % 3 = 0 then null when p_size % 7 = 5 and p_partkey % 3 = 0 then 'urgent' else {list(vocab.SEVERITIES)}[p_partkey % 4 + 1] end as severity from part)"""


def faulty(spark, sf):
    k, third, way = F.col("p_partkey"), F.col("p_partkey") % 3 == 0, F.col("p_size") % 7

    def pick(values):
        return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))

    return t.read(spark, sf, "part").select(
        F.col("p_size").alias("sop_id"), k.alias("rule_id"), F.when((way == 1) & third, F.lit(None)).when((way == 2) & third, "custom").otherwise(pick(vocab.RULE_TYPES)).alias("rule_type"),
        F.when((way == 3) & third, "  ").otherwise(F.col("p_brand")).alias("rule_description"), F.when((way == 4) & third, F.lit(None)).when((way == 5) & third, "urgent").otherwise(pick(vocab.SEVERITIES)).alias("severity"))


@query("c5_invalid_sets", f"""with {FAULTY} select sop_id, count(*) as n_rules, bool_and(coalesce(rule_type in ({TYPES}) and severity in ('critical', 'high', 'medium', 'low') and trim(rule_description) <> '', false)) as is_valid from faulty group by sop_id""")
def c5_invalid(spark, sf):
    return s.rule_sets(faulty(spark, sf))


@query("c5_rule_faults", f"""with {FAULTY}, found as (select sop_id, rule_id, unnest([case when rule_type is null then 'no rule_type' end, case when trim(rule_description) = '' then 'no rule_description' end, case when severity is null then 'no severity' end,
  case when rule_type = 'custom' then 'unknown rule_type: custom' end, case when severity = 'urgent' then 'unknown severity: urgent' end]) as fault from faulty) select * from found where fault is not null""")
def c5_faults(spark, sf):
    return s.rule_faults(faulty(spark, sf))


@query("c6_confidence", f"""{W} select sop_id, count(*) as n_rules, round(avg(least(0.5::double + case when step_number <> 0 then 0.15 else 0 end::double + case when rule_type = 'timing' and duration is not null then 0.1 else 0 end::double, 1)), 2) as confidence
from rules group by sop_id""")
def c6(spark, sf):
    return s.confidences(rules(spark, sf))


CONFIDENCE = "round(avg(least(0.5::double + case when step_number <> 0 then 0.15 else 0 end::double + case when rule_type = 'timing' and duration is not null then 0.1 else 0 end::double, 1))"


# Two methods: the patterns on whole sentences, and a stricter one that takes only sentences of 12 words or fewer.
@query("c7_compared_methods", f"""{W}, both_methods as (select *, 'pattern' as method from rules union all select *, 'model' as method from rules where length(rule_description) - length(replace(rule_description, ' ', '')) < 12),
sides as (select sop_id, count_if(method = 'pattern')::bigint as pattern, count_if(method = 'model')::bigint as model, {CONFIDENCE} filter (method = 'pattern'), 2) as pattern_confidence, {CONFIDENCE} filter (method = 'model'), 2) as model_confidence
  from both_methods group by sop_id)
select *, case when pattern > model then 'pattern' when model > pattern then 'model' else 'equal' end as more_rules from sides""")
def c7(spark, sf):
    found = rules(spark, sf)
    blanks = F.length("rule_description") - F.length(F.replace("rule_description", F.lit(" "), F.lit("")))
    return s.compared(found.withColumn("method", F.lit("pattern")).union(found.where(blanks < 12).withColumn("method", F.lit("model"))))


@query("c8_json_in_text", r"""with answers as (select event_id, case event_id % 4 when 0 then 'Here it is: ```json' || chr(10) || replace(props, '}', ', }') || chr(10) || '``` as asked' when 1 then 'Answer ' || props || ' end'
  when 2 then '[' || props || ',]' else 'no answer' end as answer from events),
fenced as (select event_id, answer, regexp_extract(answer, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) as fenced, regexp_extract(answer, '(?s)(\{.*\}|\[.*\])', 1) as bare from answers)
select event_id, nullif(regexp_replace(case when fenced <> '' then fenced else bare end, ',(\s*[}\]])', '\1', 'g'), '') as found from fenced""")
def c8(spark, sf):
    k, props = F.col("event_id") % 4, F.col("props")
    text = F.when(k == 0, F.concat(F.lit("Here it is: ```json\n"), F.replace(props, F.lit("}"), F.lit(", }")), F.lit("\n``` as asked"))).when(k == 1, F.concat(F.lit("Answer "), props, F.lit(" end")))
    text = text.when(k == 2, F.concat(F.lit("["), props, F.lit(",]"))).otherwise("no answer")
    return t.read(spark, sf, "events").select("event_id", s.json_in(text).alias("found"))


@query("c9_stored_rules", "select p_partkey as rule_id, nullif(floor(p_size / 7.0)::int, 0) as step_number, coalesce(case when p_size % 3 = 0 then 'high' end, 'medium') as severity from part")
def c9(spark, sf):
    rows = t.read(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") / 7.0).alias("step_number"), F.when(F.col("p_size") % 3 == 0, "high").alias("severity"))
    return s.stored(rows)


@query("c10_run_metadata", f"""{W}, n as (select sop_id, count(*) as rules_count from rules group by sop_id)
select doc_id as sop_id, coalesce(rules_count, 0)::bigint as rules_count, coalesce(rules_count, 0) > 0 as processed, case when rules_count > 0 then 'completed' else 'failed' end as status from documents left join n on sop_id = doc_id""")
def c10(spark, sf):
    return s.run_metadata(docs(spark, sf).select("sop_id"), rules(spark, sf))


@query("c11_rules_of_sop", f"{W} select position, rule_type, rule_description, step_number from rules where sop_id = 106")
def c11(spark, sf):
    return s.rules_of(rules(spark, sf), 106).select("position", "rule_type", "rule_description", "step_number")


@query("c12_sops_with_rules", f"""{W}, n as (select sop_id, string_agg(position::varchar || ':' || rule_type || ':' || severity, ',' order by position) as rules from rules group by sop_id)
select doc_id as sop_id, coalesce(rules, '') as rules from documents left join n on sop_id = doc_id""")
def c12(spark, sf):
    rows = s.with_rules(docs(spark, sf).select("sop_id"), rules(spark, sf))
    each = F.transform("rules", lambda x: F.concat_ws(":", x["position"].cast("string"), x["rule_type"], x["severity"]))
    return rows.select("sop_id", F.coalesce(F.array_join(each, ","), F.lit("")).alias("rules"))
