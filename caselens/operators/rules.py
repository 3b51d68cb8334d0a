"""Declarative policy rules over loan logs: a registry of predicates on rows or on cases.

Each rule is a function (logs, **limits) -> (case_id, officer_id, deviation_type, severity, detail). It is written as
a hit and a detail on rows (with window columns, if it needs any) or on cases (with aggregates); a few are tables of their
own. Many rules are applied together: row rules in a few scans without a shuffle, all that look along a case over one
window, all case rules in one grouped aggregation. Limits are parameters with defaults; those that hang on a role, a product, an amount or a day are tables
(see limits), which may have dates of validity and any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators.limits import Lookup, of_rows, with_limits


class OnRows(NamedTuple):
    """Rows where hit holds; columns: what is computed over the rows of a case first, by name; looks: limits that are looked up first, by name."""

    hit: Column
    detail: Column
    columns: dict[str, Column] = {}
    looks: dict[str, Lookup] = {}


class OnCases(NamedTuple):
    """Cases whose aggregates fulfil hit. details: instead of one hit, several (officer_id, detail), null where there is none; given: what is computed on rows first, by name."""

    aggregates: dict[str, Column]
    hit: Column | None = None
    detail: Column | None = None
    details: tuple[Column, ...] = ()
    looks: dict[str, Lookup] = {}
    given: dict[str, Column] = {}


Rule = Callable[..., "OnRows | OnCases | DataFrame"]
#: Row rules of one scan; the code of many more at once is too long for the JVM to compile, and seven times slower.
TOGETHER = 8
RULES: dict[str, Callable[..., DataFrame]] = {}
WRITTEN: dict[str, tuple[Rule, str]] = {}

ROLE_LIMITS = {"officer": 20_000.0, "manager": 40_000.0, "senior_manager": 70_000.0, "director": 1e12}
APPROVERS = ((0.0, 30_000.0, 1), (30_000.0, 60_000.0, 2), (60_000.0, 1e12, 3))
TENORS = {"home": (60, 360), "auto": (12, 84), "personal": (6, 60)}
LTV_CAPS = {"home": 0.8, "auto": 0.9, "personal": 0.5}
BUCKETS = ((0, 30, 0), (30, 60, 1), (60, 90, 2), (90, 1_000_000, 3))
MANDATORY = {"home": "Risk Assessment", "auto": "Credit Check", "personal": "Income Verification"}
HOLIDAYS = ("1996-12-25", "1997-01-01")
CORE = ("case_id", "officer_id", "step_name", "action", "ts")


def rule(name: str, severity: str) -> Callable[[Rule], Rule]:
    """Register a rule by the type of its deviations."""

    def add(f: Rule) -> Rule:
        WRITTEN[name] = (f, severity)

        def run(logs: DataFrame, **limits) -> DataFrame:
            return apply_rules(logs, [name], **{name: limits})

        run.__doc__ = f.__doc__
        RULES[name] = run
        return run

    return add


def apply_rules(logs: DataFrame, names: Iterable[str] | None = None, **limits: dict) -> DataFrame:
    """The deviations of the named rules, or of all whose columns logs has; limits by rule name."""
    written = {n: WRITTEN[n][0](logs, **limits.get(n, {})) for n in (RULES if names is None else names)}
    on_rows = {n: r for n, r in written.items() if isinstance(r, OnRows) and not r.columns}
    along = {n: r for n, r in written.items() if isinstance(r, OnRows) and r.columns}
    on_cases = {n: r for n, r in written.items() if isinstance(r, OnCases)}
    parts = [_named(r, n) for n, r in written.items() if isinstance(r, DataFrame)]
    some = list(on_rows.items())
    parts += [_hits(logs, dict(some[i : i + TOGETHER])) for i in range(0, len(some), TOGETHER)]
    if along:
        parts.append(_hits(logs.withColumns({c: x for r in along.values() for c, x in r.columns.items()}), along))
    if on_cases:
        first = F.min_by("officer_id", F.struct("ts", "log_seq")).alias("officer_id")
        # Rows are dealt by case first, as sets and texts that are grouped before the shuffle are sorted, and spilled, by every map task.
        rows = logs.withColumns({c: x for r in on_cases.values() for c, x in r.given.items()}).repartition("case_id")
        cases = rows.groupBy("case_id").agg(first, *[x.alias(c) for c, x in {c: x for r in on_cases.values() for c, x in r.aggregates.items()}.items()])
        parts.append(_hits(cases, on_cases))
    return reduce(DataFrame.unionByName, parts)


def _named(found: DataFrame, name: str) -> DataFrame:
    return found.select("case_id", "officer_id", F.lit(name).alias("deviation_type"), F.lit(WRITTEN[name][1]).alias("severity"), F.col("detail").cast("string").alias("detail"))


def _hits(rows: DataFrame, rules: dict[str, OnRows | OnCases]) -> DataFrame:
    """A row for each rule that a row of rows hits."""
    rows = with_limits(rows, {name: look for r in rules.values() for name, look in r.looks.items()})

    def hit(name: str, officer: Column, detail: Column) -> Column:
        return F.struct(officer.alias("officer_id"), F.lit(name).alias("deviation_type"), F.lit(WRITTEN[name][1]).alias("severity"), detail.cast("string").alias("detail"))

    if len(rules) == 1:
        [(name, r)] = rules.items()
        if r.hit is not None:  # a filter, which is pushed down
            return _named(rows.where(r.hit).withColumn("detail", r.detail), name)
    found = [F.when(r.hit, hit(n, F.col("officer_id"), r.detail)) for n, r in rules.items() if r.hit is not None]
    found += [F.when(d.isNotNull(), hit(n, d["officer_id"], d["detail"])) for n, r in rules.items() if r.hit is None for d in r.details]
    return rows.select("case_id", F.explode(F.array(*found)).alias("hit")).where("hit is not null").select("case_id", "hit.*")


def _by(logs: DataFrame, limits: DataFrame | dict, key: str, kind: str = "double") -> DataFrame:
    """A table (key, limit): as it is given, or of a dict."""
    return limits if isinstance(limits, DataFrame) else of_rows(logs.sparkSession, f"{key} string, limit {kind}", limits.items())


def _bands(logs: DataFrame, limits: DataFrame | Iterable, kind: str = "int") -> DataFrame:
    """A table (low, high, limit): as it is given, or of rows."""
    return limits if isinstance(limits, DataFrame) else of_rows(logs.sparkSession, f"low double, high double, limit {kind}", limits)


def _distinct(column: str) -> Column:
    """Number of distinct values in a case."""
    return F.size(F.collect_set(column))


def _disbursing(step: str = "Final Approval") -> Column:
    return F.col("step_name") == step


@rule("duplicate_step", "medium")
def duplicate_step(logs, once: tuple[str, ...] = ("Credit Check", "Manager Approval", "Final Approval")):
    """Steps to be done once that a case has several times."""
    found = {}
    for i, step in enumerate(once):
        at = F.col("step_name") == step
        found[f"n_once_{i}"], found[f"by_once_{i}"] = F.count_if(at), F.min_by("officer_id", F.when(at, F.struct("ts", "log_seq")))
    each = [F.when(F.col(f"n_once_{i}") > 1, F.struct(F.col(f"by_once_{i}").alias("officer_id"), F.concat(F.lit(f"{step} x"), F.col(f"n_once_{i}").cast("string")).alias("detail"))) for i, step in enumerate(once)]
    return OnCases(found, details=tuple(each))


@rule("skipped_mandatory_subprocess", "high")
def skipped_mandatory(logs, mandatory: DataFrame | dict[str, str] = MANDATORY):
    """Cases without the step that their product needs; mandatory has (product, limit), limit being the step."""
    needed = Lookup(_by(logs, mandatory, "product", "string"), (("least_product", "product"),))
    return OnCases({"least_product": F.min("product"), "steps_done": F.collect_set("step_name")}, ~F.array_contains("steps_done", F.col("step_needed")), F.col("step_needed"), looks={"step_needed": needed})


@rule("insufficient_approval_hierarchy", "critical")
def insufficient_hierarchy(logs, needed: DataFrame | Iterable = APPROVERS):
    """Cases with fewer distinct roles approving than their largest amount needs; needed has (low, high, limit), limit being a number of roles."""
    n = F.col("roles_needed")
    found = {"most_amount": F.max("amount"), "roles": _distinct("approver_role")}
    return OnCases(found, F.col("roles") < n, F.concat(F.col("roles").cast("string"), F.lit(" of "), n.cast("string")), looks={"roles_needed": Lookup(_bands(logs, needed), value="most_amount")})


@rule("unauthorized_approver", "critical")
def unauthorized_approver(logs, limits: DataFrame | dict[str, float] = ROLE_LIMITS):
    """Amounts above the limit of the approver's role on that day; limits has (role, limit) and may have dates of validity."""
    return OnRows(F.col("amount") > F.col("role_limit"), F.col("approver_role"), looks={"role_limit": _role_limit(logs, limits)})


def _role_limit(logs: DataFrame, limits: DataFrame | dict[str, float]) -> Lookup:
    return Lookup(_by(logs, limits, "role"), (("approver_role", "role"),), at="ts")


@rule("self_approval_violation", "critical")
def self_approval(logs):
    """Approvals by the officer who opened the case."""
    first = F.first("officer_id").over(Window.partitionBy("case_id").orderBy("ts", "log_seq"))
    return OnRows(F.col("approver_id") == F.col("opened_by"), F.col("approver_id"), {"opened_by": first})


@rule("escalation_missing", "high")
def escalation_missing(logs):
    """High-risk cases without an escalated approval."""
    given = {"__risky": F.col("risk_grade") == "high", "__escalated": F.col("approval_level") == "escalated"}
    found = {"risky": F.bool_or("__risky"), "escalated": F.bool_or("__escalated")}
    return OnCases(found, F.col("risky") & ~F.coalesce("escalated", F.lit(False)), F.lit("not escalated"), given=given)


@rule("tat_breach", "high")
def tat_breach(logs, sla_days: float = 60):
    """Cases that took longer than agreed, or with a step after its target time or flagged so."""
    late = F.coalesce(F.col("approval_timestamp") > F.col("sla_target_timestamp"), F.lit(False)) | F.coalesce("sla_breach_flag", F.lit(False))
    found = {"days": F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 86_400_000_000, "late": F.bool_or("__late")}
    return OnCases(found, (F.col("days") > sla_days) | F.col("late"), F.when(F.col("late"), "late step").otherwise("long case"), given={"__late": late})


@rule("cutoff_breach", "low")
def cutoff_breach(logs, hour: int = 18, holidays: DataFrame | Iterable[str] = HOLIDAYS):
    """Approvals at or after the cut-off hour, on weekends, or on holidays; holidays has (day, limit), limit being a name."""
    table = holidays if isinstance(holidays, DataFrame) else of_rows(logs.sparkSession, "day string, limit string", [(d, "holiday") for d in holidays]).withColumn("day", F.col("day").cast("date"))
    at = F.col("approval_timestamp")
    hit = F.when(F.hour(at) >= hour, "hour").when(F.weekday(at) >= 5, "weekend").when(F.col("holiday").isNotNull(), F.lit("holiday"))
    days = table.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "limit")
    return OnRows(hit.isNotNull(), hit, looks={"holiday": Lookup(days, (("date_format(approval_timestamp, 'yyyy-MM-dd')", "day"),))})


@rule("post_disbursement_qc_delay", "medium")
def qc_delay(logs, days: int = 45):
    """Checks more than so many days after disbursement."""
    gap = F.datediff("qc_date", "disbursement_date")
    return OnRows(gap > days, gap)


@rule("ineligible_tenor", "high")
def ineligible_tenor(logs, tenors: DataFrame | dict[str, tuple[int, int]] = TENORS):
    """Tenors outside all ranges of the product; tenors has (product, low, high), low inclusive and high exclusive. Products without a range are not judged."""
    table = tenors if isinstance(tenors, DataFrame) else of_rows(logs.sparkSession, "product string, low double, high double", [(p, low, high + 1) for p, (low, high) in tenors.items()])
    table = table.withColumn("limit", F.lit(1))
    key, months = (("product", "product"),), F.col("tenor_months")
    looks = {"tenor_fits": Lookup(table, key, "tenor_months"), "tenor_known": Lookup(table.select("product", "limit").distinct(), key)}
    return OnRows(months.isNotNull() & F.col("tenor_known").isNotNull() & F.col("tenor_fits").isNull(), months, looks=looks)


@rule("emi_to_income_breach", "high")
def emi_breach(logs, emi: float = 0.6, dti: float = 0.5):
    """Instalments or debts too high for the income."""
    return OnRows((F.col("emi_to_income_ratio") > emi) | (F.col("dti_ratio") > dti), F.when(F.col("emi_to_income_ratio") > emi, "emi").otherwise("dti"))


@rule("low_score_approved_without_exception", "critical")
def low_score(logs, least: int = 600):
    """Approvals in spite of a low score and without an exception."""
    return OnRows((F.col("credit_score") < least) & (F.col("decision") == "A") & ~F.coalesce("exception_flag", F.lit(False)), F.col("credit_score"))


@rule("kyc_incomplete_progression", "critical")
def kyc_incomplete(logs, gate: str = "Credit Check", order: tuple[str, ...] = ()):
    """Logs at or after the gate step, in time, at which KYC has not been completed before or then."""
    so_far = Window.partitionBy("case_id").orderBy("ts", "log_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {"past": F.max(F.col("step_name") == gate).over(so_far), "done": F.max("kyc_completed_flag").over(so_far)}
    return OnRows(F.col("past") & ~F.coalesce("done", F.lit(False)), F.col("step_name"), found)


@rule("sanctions_hit_not_rejected", "critical")
def sanctions_not_rejected(logs):
    """Hits on a sanctions or watch list that were not rejected."""
    return OnRows((F.col("sanctions_hit_flag") | F.col("watchlist_hit_flag")) & (F.col("decision") != "R"), F.col("decision"))


@rule("pep_no_edd_or_extra_approval", "critical")
def pep_unchecked(logs, edd: str = "Risk Assessment", approvers: int = 2):
    """Cases of politically exposed persons with neither enhanced diligence nor enough approvers."""
    found = {"pep": F.bool_or("pep_flag"), "edd": F.bool_or(F.col("step_name") == edd), "approvers": _distinct("approver_id")}
    return OnCases(found, F.col("pep") & ~F.col("edd") & (F.col("approvers") < approvers), F.col("approvers"))


@rule("ltv_breach", "high")
def ltv_breach(logs, caps: DataFrame | dict[str, float] = LTV_CAPS):
    """Loans too large for their security; caps has (product, limit) and may have dates of validity."""
    return OnRows(F.col("ltv_ratio") > F.col("ltv_cap"), F.col("product"), looks={"ltv_cap": Lookup(_by(logs, caps, "product"), (("product", "product"),), at="ts")})


@rule("valuation_missing_or_stale", "medium")
def stale_valuation(logs, days: int = 365):
    """Decisions without a valuation, or with one older than so many days."""
    age = F.datediff("ts", "collateral_value_date")
    return OnRows(F.col("collateral_value_date").isNull() | (age > days), F.when(F.col("collateral_value_date").isNull(), "missing").otherwise("stale"))


@rule("security_not_created", "high")
def security_not_created(logs):
    """Disbursements without security."""
    return OnRows(_disbursing() & ~F.coalesce("security_created_flag", F.lit(False)), F.lit("no security"))


@rule("pre_disbursement_condition_unmet", "critical")
def condition_unmet(logs, gates: tuple[str, ...] = ("kyc_completed_flag", "security_created_flag")):
    """Disbursements while a condition is unmet."""
    unmet = F.concat_ws(",", *[F.when(~F.coalesce(g, F.lit(False)), F.lit(g)) for g in gates])
    return OnRows(_disbursing() & (unmet != ""), unmet)


@rule("mandate_not_set_before_disbursement", "high")
def mandate_not_set(logs):
    """Disbursements without an active mandate."""
    return OnRows(_disbursing() & ~F.col("mandate_status").eqNullSafe("active"), F.col("mandate_status"))


@rule("incorrect_disbursement_amount", "critical")
def wrong_amount(logs):
    """Amounts disbursed that aren't those sanctioned."""
    return OnRows(~F.col("disbursement_amount").eqNullSafe(F.col("loan_amount_sanctioned")), F.round(F.col("disbursement_amount") - F.col("loan_amount_sanctioned"), 2).cast("decimal(12,2)"))


@rule("post_disbursement_qc_missing", "medium")
def qc_missing(logs):
    """Disbursements without a check."""
    return OnRows(_disbursing() & ~F.coalesce("post_disbursement_qc_flag", F.lit(False)), F.lit("no check"))


@rule("collection_escalation_delay", "medium")
def escalation_delay(logs, buckets: DataFrame | Iterable = BUCKETS):
    """Overdue loans in a lower bucket than their days call for; buckets has (low, high, limit), limit being the bucket."""
    return OnRows(F.col("bucket") < F.col("bucket_due"), F.col("overdue_days"), looks={"bucket_due": Lookup(_bands(logs, buckets), value="overdue_days")})


@rule("unauthorized_restructure", "critical")
def unauthorized_restructure(logs, allowed: tuple[str, ...] = ("senior_manager", "director")):
    """Restructured loans without an approver of sufficient rank."""
    return OnRows(F.col("restructure_flag") & ~F.coalesce(F.col("approver_role").isin(*allowed), F.lit(False)), F.col("approver_role"))


@rule("unauthorized_writeoff", "critical")
def unauthorized_writeoff(logs, limits: DataFrame | dict[str, float] = ROLE_LIMITS):
    """Write-offs above the limit of the approver's role on that day."""
    return OnRows(F.col("writeoff_amount") > F.col("writeoff_limit"), F.col("approver_role"), looks={"writeoff_limit": _role_limit(logs, limits)})


@rule("missing_core_field", "high")
def missing_core_field(logs, fields: tuple[str, ...] = CORE):
    """Rows that lack a field every log must have."""
    lacking = F.concat_ws(",", *[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields])
    return OnRows(lacking != "", lacking)


@rule("invalid_format", "medium")
def invalid_format(logs, column: str = "raw_amount", pattern: str = r"^-?\d+(\.\d+)?$"):
    """Values that are there but aren't numbers."""
    value = F.col(column)
    return OnRows(value.isNotNull() & (value.try_cast("double").isNull() | ~value.rlike(pattern)), value)


@rule("inconsistent_value_across_steps", "medium")
def inconsistent_values(logs, columns: tuple[str, ...] = ("branch_code", "product")):
    """Cases with several values of what should be one."""
    several = F.concat_ws(",", *[F.when(F.col(f"mixed_{c}"), F.lit(c)) for c in columns])
    return OnCases({f"mixed_{c}": F.min(c) != F.max(c) for c in columns}, several != "", several)


@rule("duplicate_active_case", "medium")
def duplicate_active(logs):
    """Active cases of customers who have several for one product."""
    cases = logs.where("status = 'O'").groupBy("customer_id", "product", "case_id").agg(F.min_by("officer_id", F.struct("ts", "log_seq")).alias("officer_id"))
    n = cases.groupBy("customer_id", "product").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cases.join(n, ["customer_id", "product"]).withColumn("detail", F.col("n"))


@rule("audit_trail_missing", "medium")
def audit_missing(logs, trail: DataFrame | None = None):
    """Logs without an audit trail, or whose trail isn't in the audit table."""
    if trail is None:
        return OnRows(F.col("audit_trail_id").isNull(), F.lit("no trail"))
    absent = logs.where("audit_trail_id is null").withColumn("detail", F.lit("no trail"))
    unknown = logs.where("audit_trail_id is not null").join(trail.select("audit_trail_id").distinct(), "audit_trail_id", "left_anti").withColumn("detail", F.lit("unknown trail"))
    return absent.select("case_id", "officer_id", "detail").unionByName(unknown.select("case_id", "officer_id", "detail"))
