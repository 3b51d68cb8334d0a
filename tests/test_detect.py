import pytest
from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators import detect as d
from caselens.sources import tables as t
from tests.conftest import SF

RULES = "rule_id long, rule_type string, rule_description string, step_number int"


def logs(spark, *rows):
    """Rows (case, officer, step, time, note); log_seq is their place."""
    made = [(c, o, s, ts, i, n) for i, (c, o, s, ts, n) in enumerate(rows)]
    df = spark.createDataFrame(made, "case_id string, officer_id string, step_name string, ts string, log_seq long, notes string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def rules(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RULES)


def full(spark, case="c", officer="o"):
    return [(case, officer, s, f"2025-01-0{i + 1} 09:00:00", None) for i, s in enumerate(vocab.STANDARD_STEPS)]


ALL = (("sequence", "in order", 1), ("approval", "approve", 2), ("timing", "in time", 3))


def kinds(df):
    return sorted((r["case_id"], r["deviation_type"], r["severity"]) for r in df.collect())


def test_perfect_case_has_none(spark):
    assert d.detect(logs(spark, *full(spark)), rules(spark, *ALL)).count() == 0


def test_no_rules_no_deviations(spark):
    assert d.detect(logs(spark, ("c", "o", "X", "2025-01-01 00:00:00", None)), rules(spark)).count() == 0


def test_officer_is_that_of_the_earliest_log(spark):
    rows = logs(spark, ("c", "late", "Final Approval", "2025-01-02 00:00:00", None), ("c", "early", "Credit Check", "2025-01-01 00:00:00", None))
    found = d.detect(rows, rules(spark, *ALL))
    assert {r["officer_id"] for r in found.collect()} == {"early"}


def test_expected_sequence_by_step_then_rule(spark):
    found = d.expected_sequence(rules(spark, ("sequence", "Then run a Credit Check", None), ("sequence", "income verification and credit check", 2), ("timing", "final approval", 1), ("sequence", "no step", 1)))
    assert [r["step_name"] for r in found.orderBy("idx").collect()] == ["Income Verification", "Credit Check"]


def test_expected_sequence_defaults_and_gate(spark):
    assert d.expected_sequence(rules(spark, ("sequence", "do it well", 1))).count() == len(vocab.STANDARD_STEPS)
    assert d.expected_sequence(rules(spark, ("timing", "do it well", 1))).count() == 0


def test_missing_wrong_and_unexpected(spark):
    expected = (("sequence", "application received", 1), ("sequence", "credit check", 2), ("sequence", "final approval", 3))
    rows = logs(
        spark, ("c", "o", "Credit Check", "2025-01-01 00:00:00", None), ("c", "o", "Application Received", "2025-01-02 00:00:00", None), ("c", "o", "Tea", "2025-01-03 00:00:00", None),
        ("c", "o", "Credit Check", "2025-01-04 00:00:00", None), ("c", "o", "Application Received", "2025-01-05 00:00:00", None), ("c", "o", "Tea", "2025-01-06 00:00:00", None))
    found = d.detect(rows, rules(spark, *expected))
    assert kinds(found) == [("c", "missing_step", "high"), ("c", "unexpected_step", "medium"), ("c", "wrong_sequence", "high"), ("c", "wrong_sequence", "high")]
    texts = {r["description"] for r in found.collect()}
    assert texts == {"Missing required step: Final Approval", "Unexpected step performed: Tea", "Wrong step order: Application Received before Credit Check"}


def test_last_place_of_a_repeated_expected_step_counts(spark):
    expected = (("sequence", "credit check", 1), ("sequence", "risk assessment", 2), ("sequence", "credit check", 3))
    rows = logs(spark, ("c", "o", "Credit Check", "2025-01-01 00:00:00", None), ("c", "o", "Risk Assessment", "2025-01-02 00:00:00", None))
    assert kinds(d.detect(rows, rules(spark, *expected))) == [("c", "wrong_sequence", "high")]


def test_approvals_by_words_in_any_case(spark):
    rows = logs(spark, ("a", "o", "MANAGER final approval", "2025-01-01 00:00:00", None), ("b", "o", "Approval by manager", "2025-01-01 00:00:00", None))
    found = d.detect(rows, rules(spark, ("approval", "x", 1)))
    assert [(r["case_id"], r["context"]["approval_type"]) for r in found.collect()] == [("b", "final")]


@pytest.mark.parametrize(("second", "rushed"), [("2025-01-01 00:59:59", 1), ("2025-01-01 01:00:00", 0)])
def test_rushed_is_strict(spark, second, rushed):
    rows = logs(spark, ("c", "o", "A", "2025-01-01 00:00:00", None), ("c", "o", "B", second, None), ("one", "o", "A", "2025-01-01 00:00:00", None))
    assert d.detect(rows, rules(spark, ("timing", "x", 1))).count() == rushed


@pytest.mark.parametrize(("second", "gaps"), [("2025-01-08 00:00:00", 0), ("2025-01-08 00:00:01", 1)])
def test_gap_is_strict(spark, second, gaps):
    rows = logs(spark, ("c", "o", "A", "2025-01-01 00:00:00", None), ("c", "o", "B", second, None))
    found = d.detect(rows, rules(spark, ("timing", "x", 1))).collect()
    assert len(found) == gaps
    if gaps:
        assert found[0]["actual_behavior"] == "Gap of 7.0 days between steps" and found[0]["severity"] == "low"


def test_equal_times_go_by_place(spark):
    rows = logs(spark, ("c", "o", "A", "2025-01-01 00:00:00", None), ("c", "p", "B", "2025-01-01 00:00:00", None))
    assert d.sequences(rows).first()["actual_sequence"] == ["A", "B"]


def test_notes_in_order_for_deviating_cases_only(spark):
    rows = logs(spark, ("c", "o", "B", "2025-01-02 00:00:00", "two"), ("c", "o", "A", "2025-01-01 00:00:00", "one"), ("d", "o", "A", "2025-01-01 00:00:00", "x"))
    bad = spark.createDataFrame([("c", "o")], "case_id string, officer_id string")
    assert [(r["case_id"], r["notes"]) for r in d.case_notes(rows, bad).collect()] == [("c", "[A] one | [B] two")]


def test_counts_on_the_order_logs(spark):
    rows, r = t.order_logs(spark, SF), t.rules(spark)
    found = {(x["deviation_type"], x["severity"]): x["count"] for x in d.detect(rows, r).groupBy("deviation_type", "severity").count().collect()}
    assert found[("missing_step", "high")] == 5712 and found[("wrong_sequence", "high")] == 1958 and found[("timing_violation", "low")] == 4446
    assert ("timing_violation", "medium") not in found


def test_missing_and_covered_are_cases_times_steps(spark):
    rows = t.order_logs(spark, SF)
    profiles, expected = d.case_profiles(rows), d.expected_sequence(t.rules(spark))
    covered = rows.select("case_id", "step_name").distinct().count()
    assert d.missing_steps(profiles, expected).count() + covered == profiles.count() * 7


def test_order_of_rows_does_not_matter(spark):
    rows, r = t.order_logs(spark, SF), t.rules(spark)
    mixed = rows.orderBy(F.rand(3)).repartition(7)
    a, b = (sorted(map(str, d.detect(x, r).drop("context").collect())) for x in (rows, mixed))
    assert a == b


def test_neighbour_checks_share_one_window(spark):
    plan = d.step_pairs(t.order_logs(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
