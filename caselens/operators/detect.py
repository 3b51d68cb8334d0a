"""Deviations of event logs from a procedure: missing, misplaced and unexpected steps, missing approvals, timing.

Logs have case_id, officer_id, step_name, ts and log_seq (which orders equal times). Checks per case read one
profile of the case (a single grouped aggregation); checks on neighbouring steps share one window, over chunks of long cases.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators.neighbours import LONG, followed
from caselens.operators.textbatch import numbered

CONTEXT = "struct<missing_step:string,step_1:string,step_2:string,unexpected_step:string,approval_type:string,issue:string,duration_hours:double,gap_days:double>"
COLUMNS = ("case_id", "officer_id", "deviation_type", "severity", "description", "expected_behavior", "actual_behavior", "context")
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def _context(**fields) -> Column:
    names = [f.split(":")[0] for f in CONTEXT[7:-1].split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(CONTEXT)


class Told(NamedTuple):
    """What a check says of a hit, from the hit's columns."""

    deviation_type: str
    severity: str
    description: Column
    expected_behavior: Column
    actual_behavior: Column
    context: dict[str, Column]


def _told(hits: DataFrame, checks: dict[str, Told]) -> DataFrame:
    """The deviations of hits, each told as its `check` does."""

    def by_check(text: Callable[[Told], Column]) -> Column:
        return reduce(lambda out, n: out.when(F.col("check") == n, text(checks[n])), list(checks)[1:], F.when(F.col("check") == next(iter(checks)), text(next(iter(checks.values())))))

    told = {n: by_check(lambda c, n=n: F.lit(v) if isinstance(v := getattr(c, n), str) else v) for n in Told._fields[:-1]}
    return hits.select("case_id", "officer_id", *[v.alias(n) for n, v in told.items()], by_check(lambda c: _context(**c.context)).alias("context"))


def step_named(description: Column) -> Column:
    """The standard step that a rule's text names; the first phrase of the list wins, null if there is none."""
    text = F.lower(description)
    return F.coalesce(*[F.when(text.contains(phrase), F.lit(step)) for phrase, step in vocab.STEP_PHRASES])


def expected_sequence(rules: DataFrame) -> DataFrame:
    """(idx, step_name) of the procedure that the sequence rules name, in step order.

    Without any named step the standard steps stand in; without sequence rules there is no procedure.
    """
    named = rules.where(F.col("rule_type") == "sequence").select("step_number", "rule_id", step_named(F.col("rule_description")).alias("step_name"))
    placed = named.where("step_name is not null").select(F.struct(F.coalesce("step_number", F.lit(999)).alias("step_number"), "rule_id").alias("place"), "step_name")
    found = numbered(placed, "place").select(F.col("position").cast("int").alias("idx"), "step_name")
    counts = named.agg(F.count(F.lit(1)).alias("rules"), F.count("step_name").alias("named"))
    standard = counts.where("rules > 0 and named = 0").select(F.posexplode(F.array(*map(F.lit, vocab.STANDARD_STEPS))).alias("idx", "step_name"))
    return found.unionByName(standard)


def has_rule(df: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """df, or no rows of it where the rule table has no rule of the kind."""
    gate = rules.where(F.col("rule_type") == kind).limit(1).select(F.lit(1).alias("__gate"))
    return df.crossJoin(F.broadcast(gate)).drop("__gate")


def case_profiles(logs: DataFrame) -> DataFrame:
    """A row for each case: officer of its earliest log, its set of steps, times, and what its approval steps are."""
    step = F.lower("step_name")
    return logs.groupBy("case_id").agg(
        F.min_by("officer_id", F.struct("ts", "log_seq")).alias("officer_id"), F.collect_set("step_name").alias("steps"), F.count(F.lit(1)).alias("n_logs"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.coalesce(F.bool_or(step.contains("manager") & step.contains("approval")), F.lit(False)).alias("has_manager"),
        F.coalesce(F.bool_or(step.contains("final") & step.contains("approval")), F.lit(False)).alias("has_final"),
    )


def sequences(logs: DataFrame) -> DataFrame:
    """(case_id, officer_id, actual_sequence): the steps of each case in the order of time."""
    row = F.struct("ts", "log_seq", "step_name")
    steps = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["step_name"])
    return logs.groupBy("case_id").agg(F.min_by("officer_id", F.struct("ts", "log_seq")).alias("officer_id"), steps.alias("actual_sequence"))


def step_pairs(logs: DataFrame, long: int = LONG) -> DataFrame:
    """Every log with the officer of its case's first log, and the step and time that follow it in its case; cases of over `long` logs are many tasks."""
    found = followed(logs, ("step_name", "ts"), ("officer_id",), long=long)
    return found.select(
        "case_id", F.col("first.officer_id").alias("officer_id"), F.col("step_name").alias("step_1"), F.col("next.step_name").alias("step_2"),
        F.col("ts").alias("ts_1"), F.col("next.ts").alias("ts_2"),
    )


def _gates(rules: DataFrame, *kinds: str) -> DataFrame:
    """One row: whether the rule table has a rule of each of the kinds."""
    return F.broadcast(rules.agg(*[F.coalesce(F.bool_or(F.col("rule_type") == k), F.lit(False)).alias(f"has_{k}_rule") for k in kinds]))


def _steps(expected: DataFrame) -> DataFrame:
    return F.broadcast(expected.agg(F.array_distinct(F.collect_list("step_name")).alias("expected")))


def _on_cases(profiles: DataFrame, checks: tuple[str, ...], expected: DataFrame | None = None, rules: DataFrame | None = None, min_hours: float = 1.0) -> DataFrame:
    """The hits of checks on cases, all from one pass over the profiles."""
    step, hours = F.col("hit.step"), F.col("hours")
    needed = {"manager": "Manager approval required before final approval", "final": "Final approval required to complete case"}
    told = {
        "missing_step": Told("missing_step", "high", F.concat(F.lit("Missing required step: "), step), F.concat(F.lit('Step "'), step, F.lit('" should be completed')),
            F.concat(F.lit('Step "'), step, F.lit('" was skipped')), {"missing_step": step}),
        "unexpected_step": Told("unexpected_step", "medium", F.concat(F.lit("Unexpected step performed: "), step), F.lit("Only standard SOP steps should be performed"),
            F.concat(F.lit('Unexpected step "'), step, F.lit('" was performed')), {"unexpected_step": step}),
        **{k: Told("missing_approval", "critical", F.lit(f"Missing {k} approval"), F.lit(text), F.lit(f"{k.capitalize()} approval step not found"), {"approval_type": F.lit(k)}) for k, text in needed.items()},
        "rushed": Told("timing_violation", "medium", F.lit("Process completed too quickly"), F.lit("Proper review time required for each step"),
            F.format_string("Process completed in %.1f hours", hours), {"duration_hours": hours, "issue": F.lit("rushed_process")}),
    }

    def hit(check: str, step: Column | None = None) -> Column:
        return F.struct(F.lit(check).alias("check"), (F.lit(None).cast("string") if step is None else step).alias("step"))

    hits = {
        "missing_step": lambda: F.transform(F.array_except("expected", "steps"), lambda s: hit("missing_step", s)),
        "unexpected_step": lambda: F.transform(F.when(F.size("expected") > 0, F.array_except("steps", "expected")).otherwise(F.array().cast("array<string>")), lambda s: hit("unexpected_step", s)),
        **{k: lambda k=k: F.array(F.when(F.col("has_approval_rule") & ~F.col(f"has_{k}"), hit(k))) for k in needed},
        "rushed": lambda: F.array(F.when(F.col("has_timing_rule") & (F.col("n_logs") >= 2) & (F.col("hours") < min_hours), hit("rushed"))),
    }
    rows = profiles
    if "rushed" in checks:
        rows = rows.withColumn("hours", F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts")) / HOUR_US)
    if expected is not None:
        rows = rows.crossJoin(_steps(expected))
    if rules is not None:
        rows = rows.crossJoin(_gates(rules, "approval", "timing"))
    found = rows.select("case_id", "officer_id", *(["hours"] if "rushed" in checks else []), F.explode(F.concat(*[hits[c]() for c in checks])).alias("hit")).where("hit is not null")
    return _told(found.withColumn("check", F.col("hit.check")), {c: told[c] for c in checks})


def _on_pairs(pairs: DataFrame, checks: tuple[str, ...], expected: DataFrame | None = None, rules: DataFrame | None = None, max_days: float = 7.0) -> DataFrame:
    """The hits of checks on neighbouring steps, all from one pass over the pairs."""
    a, b, days = F.col("step_1"), F.col("step_2"), F.col("days")
    told = {
        "wrong_order": Told("wrong_sequence", "high", F.concat(F.lit("Wrong step order: "), b, F.lit(" before "), a), F.concat(a, F.lit(" should come before "), b),
            F.concat(b, F.lit(" was performed before "), a), {"step_1": a, "step_2": b}),
        "long_gap": Told("timing_violation", "low", F.concat(F.lit("Long delay between "), a, F.lit(" and "), b), F.lit("Steps should be completed in timely manner"),
            F.format_string("Gap of %.1f days between steps", days), {"step_1": a, "step_2": b, "gap_days": days}),
    }
    hits, rows = {"wrong_order": F.col("idx_1") > F.col("idx_2"), "long_gap": F.col("has_timing_rule") & (days > max_days)}, pairs
    if "wrong_order" in checks:
        place = expected.groupBy("step_name").agg(F.max("idx").alias("idx"))
        for i in (1, 2):
            rows = rows.join(F.broadcast(place.select(F.col("step_name").alias(f"step_{i}"), F.col("idx").alias(f"idx_{i}"))), f"step_{i}", "left")
    if "long_gap" in checks:
        rows = rows.withColumn("days", F.timestamp_diff("MICROSECOND", F.col("ts_1"), F.col("ts_2")) / DAY_US).crossJoin(_gates(rules, "timing"))
    if len(checks) == 1:  # a filter, which is pushed down
        return _told(rows.where(hits[checks[0]]).withColumn("check", F.lit(checks[0])), {checks[0]: told[checks[0]]})
    found = rows.where(reduce(lambda x, y: x | y, [hits[c] for c in checks])).withColumn("check", F.explode(F.array(*[F.when(hits[c], c) for c in checks])))
    return _told(found.where("check is not null"), {c: told[c] for c in checks})


def missing_steps(profiles: DataFrame, expected: DataFrame) -> DataFrame:
    """missing_step: once for each expected step that a case lacks."""
    return _on_cases(profiles, ("missing_step",), expected)


def unexpected_steps(profiles: DataFrame, expected: DataFrame) -> DataFrame:
    """unexpected_step: once for each step of a case that the procedure doesn't have."""
    return _on_cases(profiles, ("unexpected_step",), expected)


def wrong_order(pairs: DataFrame, expected: DataFrame) -> DataFrame:
    """wrong_sequence: each pair of neighbouring expected steps that stands the wrong way round; of a repeated expected step the last place counts."""
    return _on_pairs(pairs, ("wrong_order",), expected)


def missing_approvals(profiles: DataFrame, rules: DataFrame, kinds: tuple[str, ...] = ("manager", "final")) -> DataFrame:
    """missing_approval: cases without a manager's or without a final approval step, where there is an approval rule."""
    return _on_cases(profiles, kinds, rules=rules)


def rushed_cases(profiles: DataFrame, rules: DataFrame, min_hours: float = 1.0) -> DataFrame:
    """timing_violation: cases of two logs or more done in less than min_hours, where there is a timing rule."""
    return _on_cases(profiles, ("rushed",), rules=rules, min_hours=min_hours)


def long_gaps(pairs: DataFrame, rules: DataFrame, max_days: float = 7.0) -> DataFrame:
    """timing_violation: more than max_days between neighbouring steps, where there is a timing rule."""
    return _on_pairs(pairs, ("long_gap",), rules=rules, max_days=max_days)


CHECKS = ("sequence", "approval", "timing")
OF_CASES = {"sequence": ("missing_step", "unexpected_step"), "approval": ("manager", "final"), "timing": ("rushed",)}
OF_PAIRS = {"sequence": ("wrong_order",), "timing": ("long_gap",)}


def detect(logs: DataFrame, rules: DataFrame, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """All deviations of the chosen checks, from one shuffle of profiles and one of neighbours. rule_id is there for rules that name one; these checks don't."""
    on_cases, on_pairs = (tuple(n for c in CHECKS if c in checks for n in of.get(c, ())) for of in (OF_CASES, OF_PAIRS))
    expected = expected_sequence(rules) if "sequence" in checks else None
    found = [_on_cases(case_profiles(logs), on_cases, expected, rules)]
    if on_pairs:
        found.append(_on_pairs(step_pairs(logs), on_pairs, expected, rules))
    return reduce(DataFrame.unionByName, found).withColumn("rule_id", F.lit(None).cast("long"))


def case_notes(logs: DataFrame, deviations: DataFrame) -> DataFrame:
    """(case_id, notes): "[step] note" of every log with a note, in the order of time, for cases that deviate."""
    noted = logs.where(F.col("notes").isNotNull()).join(deviations.select("case_id").distinct(), "case_id", "left_semi")
    line = F.struct("ts", "log_seq", F.concat(F.lit("["), F.col("step_name"), F.lit("] "), F.col("notes")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return noted.groupBy("case_id").agg(F.array_join(lines, " | ").alias("notes"))


def with_notes(deviations: DataFrame, notes: DataFrame) -> DataFrame:
    """deviations with their case's notes, null where it has none."""
    return deviations.join(notes, "case_id", "left")


def run_summary(logs: DataFrame, deviations: DataFrame) -> DataFrame:
    """One row: cases, logs, officers, deviations, and deviations of each severity."""
    of_logs = logs.agg(F.count_distinct("case_id").alias("cases"), F.count(F.lit(1)).alias("logs"), F.count_distinct("officer_id").alias("officers"))
    of_deviations = deviations.agg(F.count(F.lit(1)).alias("deviations"), *[F.count_if(F.col("severity") == s).alias(s) for s in vocab.SEVERITIES])
    return of_logs.crossJoin(of_deviations)


def tagged_synthetic(deviations: DataFrame) -> DataFrame:
    """deviations marked as coming from generated logs, in their context."""
    return deviations.withColumn("context", F.col("context").withField("is_synthetic", F.lit(True)))


def log_notes(logs: DataFrame, case_id: str) -> DataFrame:
    """(log_seq, step_name, notes) of one case's logs that have a note."""
    return logs.where((F.col("case_id") == case_id) & F.col("notes").isNotNull()).select("log_seq", "step_name", "notes")


def edited_notes(deviations: DataFrame, edits: DataFrame) -> DataFrame:
    """deviations with the notes of edits (deviation_id, notes, edited_by, edited_at) in place of their own, and who edited them when."""
    new = edits.select("deviation_id", F.col("notes").alias("new_notes"), "edited_by", "edited_at")
    return deviations.join(new, "deviation_id", "left").withColumn("notes", F.coalesce("new_notes", "notes")).drop("new_notes")
