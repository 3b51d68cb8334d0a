"""What a task holds doesn't grow with the table: plans and results of the steps that deal rows to tasks first."""

from pyspark.sql import functions as F

from caselens.operators import behavior, detect, ingest, textbatch
from caselens.operators.ml import sampling
from caselens.sources import tables as t
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_need_no_second_shuffle(spark):
    rows = textbatch.numbered(t.deviations(spark, SF).select("deviation_id"), spans=5)
    assert "row_number" not in plan(rows) and plan(rows).count("hashpartitioning") == 1  # that of the counts
    found = [r["deviation_id"] for r in rows.orderBy("position").collect()]
    assert found == sorted(found) and [r["position"] for r in rows.select("position").orderBy("position").collect()] == list(range(len(found)))
    texts = textbatch.batch_texts(t.deviations(spark, SF))
    assert "REPARTITION_BY_NUM" in plan(texts)


def test_headers_are_dealt_before_they_are_told_apart(spark):
    df = spark.createDataFrame([(1, "Loan ID"), (1, "Loan ID"), (1, None), (2, "xyz"), (2, "Remarks")], "file int, header string")
    found = ingest.header_mapping(df)
    assert "REPARTITION_BY_NUM" in plan(found) and "Join" not in plan(found)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "Loan ID", "case_id"), (1, None, None), (2, "xyz", None), (2, "Remarks", "notes")]))


def test_representatives_by_parts_of_clusters(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("deviation_id"), (F.col("id") % 3 - 1).cast("int").alias("cluster"), (F.col("id") % 11 == 0).alias("is_anomaly"), (F.col("id") * 7919 % 1009).cast("double").alias("distance"))
    allocated = spark.createDataFrame([(0, 9), (1, 4)], "cluster int, allocated int")
    monkeypatch.setattr(sampling, "PART", 10)
    found = sampling.representatives(rows, allocated)
    assert "hashpartitioning(cluster" in plan(found) and "part" in plan(found)
    wanted = set()
    for cluster, n in ((0, 9), (1, 4)):
        own = [(i * 7919 % 1009, str(i)) for i in range(5000) if i % 3 - 1 == cluster and i % 11]
        near, far = sorted(own)[: n // 2], sorted(own, key=lambda x: (-x[0], x[1]))[: n - n // 2]
        wanted |= {i for _, i in [*near, *far]}
    assert {r["deviation_id"] for r in found.collect()} == wanted and found.count() == len(wanted)


def test_cases_of_a_day_are_dealt_before_they_are_counted(spark):
    logs = t.event_logs(spark, SF)
    found = behavior.workload(logs)
    assert "REPARTITION_BY_NUM" in plan(found) and "count(distinct" not in plan(found)
    n = {(r["officer_id"], r["cases"]) for r in logs.groupBy("officer_id", F.to_date("ts").alias("day")).agg(F.count_distinct("case_id").alias("cases")).groupBy("officer_id").agg(F.max("cases").alias("cases")).collect()}
    assert {(r["officer_id"], r["peak_cases"]) for r in found.collect()} == n


def test_all_checks_read_the_logs_twice(spark):
    rules = t.rules(spark)
    found = detect.detect(t.order_logs(spark, SF), rules)
    assert plan(found).count("FileScan parquet") == 2  # profiles of cases, and what follows what
    profiles, pairs, expected = detect.case_profiles(t.order_logs(spark, SF)), detect.step_pairs(t.order_logs(spark, SF)), detect.expected_sequence(rules)
    single = [detect.missing_steps(profiles, expected), detect.unexpected_steps(profiles, expected), detect.missing_approvals(profiles, rules), detect.rushed_cases(profiles, rules), detect.wrong_order(pairs, expected), detect.long_gaps(pairs, rules)]
    apart = single[0]
    for other in single[1:]:
        apart = apart.unionByName(other)
    found = found.drop("rule_id")
    assert found.count() == apart.count() > 0 and not found.exceptAll(apart).take(1)
    for gone, types in (("approval", {"missing_approval"}), ("timing", {"timing_violation"}), ("sequence", {"missing_step", "wrong_sequence", "unexpected_step"})):
        less = detect.detect(t.order_logs(spark, SF), rules.where(F.col("rule_type") != gone)).drop("rule_id")
        assert less.count() == found.where(~F.col("deviation_type").isin(*types)).count()


def test_cases_are_not_grouped_before_the_shuffle(spark):
    """Grouping of sets and texts sorts, and spills, all rows of a map task."""
    from caselens.operators import rules
    from caselens.queries.rules import loans

    found = rules.apply_rules(loans(spark, SF), ["skipped_mandatory_subprocess", "tat_breach", "pep_no_edd_or_extra_approval"])
    text = plan(found)
    assert text.count("Exchange hashpartitioning(case_id") == 1 and "REPARTITION_BY_COL" in text
    exchanged = text.index("Exchange hashpartitioning(case_id")
    assert "collect_set" in text[:exchanged] and "collect_set" not in text[exchanged:]
