"""The policy rules on loans made of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators import limits
from caselens.operators import rules as r
from caselens.registry import query
from caselens.sources import tables as t

PRODUCTS, ROLES, GRADES = ("home", "auto", "personal"), ("officer", "manager", "senior_manager", "director"), ("low", "medium", "high")


def loans(spark, sf):
    """Loan logs: attributes by arithmetic on the keys of the order lines."""
    k, n, s, o = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_orderkey")

    def pick(values, i):
        return F.get(F.array(*map(F.lit, values)), i.cast("int"))

    ts = F.col("l_shipdate")
    return t.read(spark, sf, "lineitem").select(
        F.when(k % 97 != 0, o.cast("string")).alias("case_id"), s.cast("string").alias("officer_id"), pick(vocab.STANDARD_STEPS, n - 1).alias("step_name"), ts.alias("ts"),
        (n.cast("long") * 1_000_000_000 + s).alias("log_seq"), F.when(k % 89 == 0, " ").otherwise(F.col("l_returnflag")).alias("action"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("decision"),
        F.col("l_extendedprice").alias("amount"), pick(PRODUCTS, o % 3).alias("product"), pick(ROLES, s % 4).alias("approver_role"),
        F.when(k % 9 == 0, s.cast("string")).otherwise(F.concat(F.lit("A"), (k % 50).cast("string"))).alias("approver_id"), pick(GRADES, k % 3).alias("risk_grade"),
        F.when((n == 6) & (k % 2 == 0), "escalated").otherwise("normal").alias("approval_level"), F.timestamp_add("HOUR", (k % 48).cast("int"), ts).alias("approval_timestamp"),
        F.timestamp_add("DAY", (k % 5).cast("int"), ts).alias("sla_target_timestamp"), (k % 50 == 0).alias("sla_breach_flag"), (k % 400).alias("tenor_months"),
        (F.col("l_discount") * 8).alias("emi_to_income_ratio"), (F.col("l_tax") * 8).alias("dti_ratio"), (300 + k % 600).alias("credit_score"), (k % 8 == 0).alias("exception_flag"),
        (k % 6 != 0).alias("kyc_completed_flag"), (k % 40 == 0).alias("sanctions_hit_flag"), (k % 45 == 0).alias("watchlist_hit_flag"), (o % 20 == 0).alias("pep_flag"), (F.col("l_discount") * 11).alias("ltv_ratio"),
        F.when(k % 30 != 0, F.date_sub(ts.cast("date"), (k % 500).cast("int"))).alias("collateral_value_date"), (k % 7 != 0).alias("security_created_flag"),
        F.when(k % 11 == 0, "pending").otherwise("active").alias("mandate_status"), F.col("l_extendedprice").alias("loan_amount_sanctioned"),
        F.when(k % 10 == 0, F.col("l_extendedprice") - 1).otherwise(F.col("l_extendedprice")).alias("disbursement_amount"), (k % 13 != 0).alias("post_disbursement_qc_flag"),
        ts.cast("date").alias("disbursement_date"), F.date_add(ts.cast("date"), (k % 60).cast("int")).alias("qc_date"), (k % 120).alias("overdue_days"), (k % 4).alias("bucket"),
        (k % 25 == 0).alias("restructure_flag"), F.when(k % 35 == 0, F.col("l_extendedprice")).alias("writeoff_amount"), F.concat(F.lit("B"), (s % 5).cast("string")).alias("branch_code"),
        F.concat(F.lit("C"), (o % 1000).cast("string")).alias("customer_id"), F.when(k % 60 != 0, k).alias("audit_trail_id"),
        F.when(k % 70 == 0, "n/a").when(k % 71 == 0, "1e5").when(k % 3 != 0, k.cast("string")).alias("raw_amount"),
    )


LOANS = f"""loans as (
  select case when l_partkey % 97 <> 0 then l_orderkey::varchar end as case_id, l_suppkey::varchar as officer_id, {list(vocab.STANDARD_STEPS)}[l_linenumber] as step_name, l_shipdate as ts,
    l_linenumber::bigint * 1000000000 + l_suppkey as log_seq, case when l_partkey % 89 = 0 then ' ' else l_returnflag end as action, l_linestatus as status, l_returnflag as decision,
    l_extendedprice as amount, {list(PRODUCTS)}[l_orderkey % 3 + 1] as product, {list(ROLES)}[l_suppkey % 4 + 1] as approver_role,
    case when l_partkey % 9 = 0 then l_suppkey::varchar else 'A' || (l_partkey % 50)::varchar end as approver_id, {list(GRADES)}[l_partkey % 3 + 1] as risk_grade,
    case when l_linenumber = 6 and l_partkey % 2 = 0 then 'escalated' else 'normal' end as approval_level, l_shipdate + to_hours((l_partkey % 48)::int) as approval_timestamp,
    l_shipdate + to_days((l_partkey % 5)::int) as sla_target_timestamp, l_partkey % 50 = 0 as sla_breach_flag, l_partkey % 400 as tenor_months, l_discount * 8 as emi_to_income_ratio, l_tax * 8 as dti_ratio,
    300 + l_partkey % 600 as credit_score, l_partkey % 8 = 0 as exception_flag, l_partkey % 6 <> 0 as kyc_completed_flag, l_partkey % 40 = 0 as sanctions_hit_flag, l_partkey % 45 = 0 as watchlist_hit_flag,
    l_orderkey % 20 = 0 as pep_flag, l_discount * 11 as ltv_ratio, case when l_partkey % 30 <> 0 then l_shipdate::date - (l_partkey % 500)::int end as collateral_value_date, l_partkey % 7 <> 0 as security_created_flag,
    case when l_partkey % 11 = 0 then 'pending' else 'active' end as mandate_status, l_extendedprice as loan_amount_sanctioned, case when l_partkey % 10 = 0 then l_extendedprice - 1 else l_extendedprice end as disbursement_amount,
    l_partkey % 13 <> 0 as post_disbursement_qc_flag, l_shipdate::date as disbursement_date, l_shipdate::date + (l_partkey % 60)::int as qc_date, l_partkey % 120 as overdue_days, l_partkey % 4 as bucket,
    l_partkey % 25 = 0 as restructure_flag, case when l_partkey % 35 = 0 then l_extendedprice end as writeoff_amount, 'B' || (l_suppkey % 5)::varchar as branch_code, 'C' || (l_orderkey % 1000)::varchar as customer_id,
    case when l_partkey % 60 <> 0 then l_partkey end as audit_trail_id, case when l_partkey % 70 = 0 then 'n/a' when l_partkey % 71 = 0 then '1e5' when l_partkey % 3 <> 0 then l_partkey::varchar end as raw_amount
  from lineitem)"""
FIRST = "first(officer_id order by ts, log_seq) as officer_id"
LIMIT = "case approver_role " + " ".join(f"when '{k}' then {v}" for k, v in r.ROLE_LIMITS.items()) + " end"
OF_PRODUCT = "case product " + " ".join("when '{0}' then {{{0}}}".format(p) for p in PRODUCTS) + " end"


def of_product(values: dict) -> str:
    return OF_PRODUCT.format(**values)


def rows(hit: str, detail: str) -> str:
    return f"select case_id, officer_id, {detail} as detail from loans where {hit}"


def cases(aggregates: str, hit: str, detail: str) -> str:
    return f"select case_id, officer_id, {detail} as detail from (select case_id, {FIRST}, {aggregates} from loans group by case_id) where {hit}"


DISBURSED = "step_name = 'Final Approval'"
SO_FAR = "over (partition by case_id order by ts, log_seq rows between unbounded preceding and current row)"
FOUND = {
    "duplicate_step": f"select case_id, officer_id, step_name || ' x' || n::varchar as detail from (select case_id, step_name, {FIRST}, count(*) as n from loans where step_name in ('Credit Check', 'Manager Approval', 'Final Approval') group by case_id, step_name) where n > 1",
    "skipped_mandatory_subprocess": cases("min(product) as product, list(distinct step_name) as steps", f"not list_contains(steps, {of_product({k: repr(v) for k, v in r.MANDATORY.items()})})", of_product({k: repr(v) for k, v in r.MANDATORY.items()})),
    "insufficient_approval_hierarchy": cases("max(amount) as amount, count(distinct approver_role) as roles", "roles < case when amount < 30000 then 1 when amount < 60000 then 2 else 3 end", "roles::varchar || ' of ' || case when amount < 30000 then 1 when amount < 60000 then 2 else 3 end::varchar"),
    "unauthorized_approver": rows(f"amount > {LIMIT}", "approver_role"),
    "self_approval_violation": "select case_id, officer_id, approver_id as detail from (select *, first_value(officer_id) over (partition by case_id order by ts, log_seq) as opened_by from loans) where approver_id = opened_by",
    "escalation_missing": cases("bool_or(risk_grade = 'high') as risky, bool_or(approval_level = 'escalated') as escalated", "risky and not escalated", "'not escalated'"),
    "tat_breach": cases("date_diff('microsecond', min(ts), max(ts)) / 86400000000.0 as days, bool_or(approval_timestamp > sla_target_timestamp or sla_breach_flag) as late", "days > 60 or late", "case when late then 'late step' else 'long case' end"),
    "cutoff_breach": "select * from (select case_id, officer_id, case when hour(approval_timestamp) >= 18 then 'hour' when isodow(approval_timestamp) >= 6 then 'weekend' when strftime(approval_timestamp, '%Y-%m-%d') in ('1996-12-25', '1997-01-01') then 'holiday' end as detail from loans) where detail is not null",
    "post_disbursement_qc_delay": rows("qc_date - disbursement_date > 45", "(qc_date - disbursement_date)::varchar"),
    "ineligible_tenor": rows(f"tenor_months < {of_product({k: v[0] for k, v in r.TENORS.items()})} or tenor_months > {of_product({k: v[1] for k, v in r.TENORS.items()})}", "tenor_months::varchar"),
    "emi_to_income_breach": rows("emi_to_income_ratio > 0.6::double or dti_ratio > 0.5::double", "case when emi_to_income_ratio > 0.6::double then 'emi' else 'dti' end"),
    "low_score_approved_without_exception": rows("credit_score < 600 and decision = 'A' and not exception_flag", "credit_score::varchar"),
    "kyc_incomplete_progression": f"select case_id, officer_id, step_name as detail from (select *, bool_or(step_name = 'Credit Check') {SO_FAR} as past, bool_or(kyc_completed_flag) {SO_FAR} as done from loans) where past and not done",
    "sanctions_hit_not_rejected": rows("(sanctions_hit_flag or watchlist_hit_flag) and decision <> 'R'", "decision"),
    "pep_no_edd_or_extra_approval": cases("bool_or(pep_flag) as pep, bool_or(step_name = 'Risk Assessment') as edd, count(distinct approver_id) as approvers", "pep and not edd and approvers < 2", "approvers::varchar"),
    "ltv_breach": rows(f"ltv_ratio > {of_product({k: f'{v}::double' for k, v in r.LTV_CAPS.items()})}", "product"),
    "valuation_missing_or_stale": rows("collateral_value_date is null or ts::date - collateral_value_date > 365", "case when collateral_value_date is null then 'missing' else 'stale' end"),
    "security_not_created": rows(f"{DISBURSED} and not security_created_flag", "'no security'"),
    "pre_disbursement_condition_unmet": rows(f"{DISBURSED} and not (kyc_completed_flag and security_created_flag)", "concat_ws(',', case when not kyc_completed_flag then 'kyc_completed_flag' end, case when not security_created_flag then 'security_created_flag' end)"),
    "mandate_not_set_before_disbursement": rows(f"{DISBURSED} and mandate_status <> 'active'", "mandate_status"),
    "incorrect_disbursement_amount": rows("disbursement_amount <> loan_amount_sanctioned", "round(disbursement_amount - loan_amount_sanctioned, 2)::decimal(12, 2)::varchar"),
    "post_disbursement_qc_missing": rows(f"{DISBURSED} and not post_disbursement_qc_flag", "'no check'"),
    "collection_escalation_delay": rows("bucket < case when overdue_days < 30 then 0 when overdue_days < 60 then 1 when overdue_days < 90 then 2 else 3 end", "overdue_days::varchar"),
    "unauthorized_restructure": rows("restructure_flag and approver_role not in ('senior_manager', 'director')", "approver_role"),
    "unauthorized_writeoff": rows(f"writeoff_amount > {LIMIT}", "approver_role"),
    "missing_core_field": "select * from (select case_id, officer_id, concat_ws(',', case when case_id is null then 'case_id' end, case when trim(action) = '' then 'action' end) as detail from loans) where detail <> ''",
    "invalid_format": rows("raw_amount is not null and not regexp_matches(raw_amount, '^-?\\d+(\\.\\d+)?$')", "raw_amount"),
    "inconsistent_value_across_steps": cases("count(distinct branch_code) as nb, count(distinct product) as np", "nb > 1 or np > 1", "concat_ws(',', case when nb > 1 then 'branch_code' end, case when np > 1 then 'product' end)"),
    "duplicate_active_case": f"select case_id, officer_id, (count(*) over (partition by customer_id, product))::varchar as detail from (select customer_id, product, case_id, {FIRST} from loans where status = 'O' group by customer_id, product, case_id) qualify count(*) over (partition by customer_id, product) > 1",
    "audit_trail_missing": "select case_id, officer_id, case when audit_trail_id is null then 'no trail' else 'unknown trail' end as detail from loans where audit_trail_id is null or audit_trail_id not in (select p_partkey from part where p_size % 10 <> 0)",
}
LEVELS = {
    "duplicate_step": "medium", "skipped_mandatory_subprocess": "high", "insufficient_approval_hierarchy": "critical", "unauthorized_approver": "critical", "self_approval_violation": "critical",
    "escalation_missing": "high", "tat_breach": "high", "cutoff_breach": "low", "post_disbursement_qc_delay": "medium", "ineligible_tenor": "high", "emi_to_income_breach": "high",
    "low_score_approved_without_exception": "critical", "kyc_incomplete_progression": "critical", "sanctions_hit_not_rejected": "critical", "pep_no_edd_or_extra_approval": "critical", "ltv_breach": "high",
    "valuation_missing_or_stale": "medium", "security_not_created": "high", "pre_disbursement_condition_unmet": "critical", "mandate_not_set_before_disbursement": "high", "incorrect_disbursement_amount": "critical",
    "post_disbursement_qc_missing": "medium", "collection_escalation_delay": "medium", "unauthorized_restructure": "critical", "unauthorized_writeoff": "critical", "missing_core_field": "high",
    "invalid_format": "medium", "inconsistent_value_across_steps": "medium", "duplicate_active_case": "medium", "audit_trail_missing": "medium",
}


def _limits(name: str, spark, sf) -> dict:
    if name != "audit_trail_missing":
        return {}
    return {"trail": t.read(spark, sf, "part").where("p_size % 10 != 0").select(F.col("p_partkey").alias("audit_trail_id"))}


def _register(i: int, name: str) -> None:
    sql = f"with {LOANS} select case_id, officer_id, '{name}' as deviation_type, '{LEVELS[name]}' as severity, detail from ({FOUND[name]})"
    query(f"x{i}_{name}", sql)(lambda spark, sf: r.RULES[name](loans(spark, sf), **_limits(name, spark, sf)))


for number, rule_name in enumerate(r.RULES, 1):
    _register(number, rule_name)


@query("x_all_rules", f"with {LOANS}, found as (" + " union all ".join(f"select '{n}' as deviation_type, '{LEVELS[n]}' as severity from ({q})" for n, q in FOUND.items()) + ") select deviation_type, severity, count(*) as n from found group by all")
def all_rules(spark, sf):
    limits = {"audit_trail_missing": _limits("audit_trail_missing", spark, sf)}
    return r.apply_rules(loans(spark, sf), **limits).groupBy("deviation_type", "severity").agg(F.count(F.lit(1)).alias("n"))


# Limits of an amount by product and day: a band for each part, valid from its own day or always.
BAND = "(p_retailprice * 10)::double"


@query("x_limit_bands", f"""with {LOANS}, bands as (
  select {list(PRODUCTS)}[p_partkey % 3 + 1] as product, case when p_partkey % 11 <> 0 then {BAND} end as low, {BAND} + p_size * 10 as high, case when p_partkey % 5 <> 0 then date '1992-01-01' + (p_partkey % 2000)::int end as valid_from, p_partkey as "limit" from part),
asked as (select distinct product, amount, ts::date as day from loans),
held as (select a.*, "limit" from asked a join bands b on a.product = b.product and (low is null or amount >= low) and amount < high and (valid_from is null or day >= valid_from)
  qualify row_number() over (partition by a.product, a.amount, a.day order by valid_from desc nulls last, low desc nulls last, "limit"::varchar) = 1)
select case_id, log_seq, "limit" from loans l left join held h on l.product = h.product and l.amount = h.amount and l.ts::date = h.day""")
def limit_bands(spark, sf):
    k, low = F.col("p_partkey"), (F.col("p_retailprice") * 10).cast("double")
    bands = t.read(spark, sf, "part").select(
        F.get(F.array(*map(F.lit, PRODUCTS)), (k % 3).cast("int")).alias("product"), F.when(k % 11 != 0, low).alias("low"), (low + F.col("p_size") * 10).alias("high"),
        F.when(k % 5 != 0, F.date_add(F.lit("1992-01-01").cast("date"), (k % 2000).cast("int"))).alias("valid_from"), k.alias("limit"))
    look = limits.Lookup(bands, (("product", "product"),), "amount", "ts")
    return limits.with_limit(loans(spark, sf), "limit", look, small=False).select("case_id", "log_seq", "limit")
