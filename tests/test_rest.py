import json

import pytest
from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators import detect, ingest, rules, sop, stats, textbatch
from caselens.operators.ml import clusters, outliers, sampling
from caselens.plans import analysis
from caselens.plans.graphs import components
from caselens.queries import ingest as q_ingest
from caselens.sources import files
from caselens.sources import tables as t
from caselens.streaming import logs as stream
from tests.conftest import SF

DEV = "deviation_id long, case_id string, officer_id string, deviation_type string, severity string, detected_at string"


def four(spark):
    rows = [
        (1, "A", "OFF123", "missing_step", "critical", "2025-01-15 14:00:00"), (2, "B", "OFF123", "ltv_breach", "critical", "2025-01-15T09:00:00.5"),
        (3, "C", "OFF456", "tat_breach", "high", "2025-01-16 11:00:00"), (4, "D", "OFF789", "x", "medium", "2025-01-16 16:00:00")]
    return spark.createDataFrame(rows, DEV)


def test_statistics_by_hand(spark):
    d = four(spark)
    s = stats.severity_score(d).first()
    assert (s["severity_score"], s["severity_assessment"][:14], s["most_common_severity"]) == (81.25, "Very High Risk", "critical")
    m = stats.critical_mass(d).first()
    assert (m["critical_mass_score"], m["critical_mass_assessment"][:6]) == (68.75, "Severe")
    assert {r["officer_id"]: r["risk_score"] for r in stats.high_risk_officers(d).collect()} == {"OFF123": 100.0, "OFF456": 75.0}
    assert {r["period"]: r["count"] for r in stats.by_period(d).collect()} == {"morning": 2, "afternoon": 2}
    assert [r["count"] for r in stats.by_weekday(d).orderBy("position").collect()] == [0, 0, 2, 2, 0, 0, 0]
    assert stats.concentration(d).first()["top_officer_percentage"] == 100.0 and stats.diversity(d).first()["diversity_score"] == 100.0


def test_statistics_of_nothing(spark):
    d = four(spark).limit(0)
    assert stats.overview(d).first()["average_deviations_per_case"] == 0.0
    assert [r["count"] for r in stats.severity_distribution(d).collect()] == [0, 0, 0, 0]
    assert stats.severity_score(d).first()["most_common_severity"] is None
    assert stats.date_range(d).first()["timed"] == 0


@pytest.mark.parametrize(("kind", "category"), [
    ("post_disbursement_qc_delay", "timing"), ("collection_escalation_delay", "approval"), ("ltv_breach", "credit"), ("collateral_docs_incomplete", "other")])
def test_categories(spark, kind, category):
    assert spark.range(1).select(stats.category_of(F.lit(kind)).alias("c")).first()["c"] == category


def test_rule_sentences(spark):
    text = "Step 1: Application. Then check the authenticity! It must be approved by a manager? Done within 3 days. Validate it. Nothing."
    rows = sop.extracted_rules(spark.createDataFrame([(1, text), (2, None), (3, " .. ")], "sop_id int, text string")).orderBy("position").collect()
    assert [r["rule_type"] for r in rows] == ["sequence", "sequence", "approval", "timing", "validation"]
    assert rows[0]["step_number"] == 1 and rows[3]["condition_logic"].asDict() == {"duration": 3, "unit": "days"}
    assert sop.kind_of(F.lit("authenticity"))


def test_confidence(spark):
    rows = spark.createDataFrame([(1, "timing", 2, ["a"], "3 days", "x"), (1, "kyc", None, None, None, None)], "sop_id int, rule_type string, step_number int, required_fields array<string>, timing_constraint string, condition_logic string")
    assert sop.confidences(rows).first()["confidence"] == 0.75


def test_json_in_text(spark):
    df = spark.createDataFrame([('a ```json\n{"x": [1,],}\n``` b',), ('x {"a": 1} y',), ("none",)], "t string")
    assert [r[0] for r in df.select(sop.json_in(F.col("t"))).collect()] == ['{"x": [1]}', '{"a": 1}', None]


def test_aliases_take_the_first_value_that_is_there(spark):
    df = spark.createDataFrame([("", "7", "u", "Step", "2025-01-02", "12 s", " hi "), ("c", "7", None, "Step", "2025-01-02T10:00:00Z", "x", "")], "case string, LOAN_ID string, User string, Activity string, Date string, Duration string, Notes string")
    rows = ingest.logs_from(df).orderBy("log_seq").collect()
    assert [r["case_id"] for r in rows] == ["7", "c"] and rows[0]["duration_seconds"] == 12 and rows[0]["notes"] == "hi" and rows[0]["action"] == "completed"
    assert rows[0]["reject_reason"] is None and rows[1]["reject_reason"].endswith("Missing officer_id") and rows[1]["duration_seconds"] is None


def test_day_and_month_first(spark):
    df = spark.createDataFrame([("c", "o", "s", "03-04-2025 10:00")], "case_id string, officer_id string, step_name string, timestamp string")
    from caselens.functions import times

    assert ingest.logs_from(df).first()["ts"].month == 3 and ingest.logs_from(df, times.DAY_FIRST).first()["ts"].month == 4


def test_header_mapping(spark):
    df = spark.createDataFrame([("f", h) for h in ("Loan_Amount", "User", "remarks", "zzz", "loan_amount_requested")], "file string, header string")
    loose = {r["header"]: r["field"] for r in ingest.header_mapping(df).collect()}
    assert loose == {"Loan_Amount": "case_id", "User": "officer_id", "remarks": "notes", "zzz": None, "loan_amount_requested": "case_id"}
    strict = {r["header"]: r["field"] for r in ingest.header_mapping(df, strict=True).collect()}
    assert strict["Loan_Amount"] == "loan_amount_requested"


def test_field_list():
    assert len(vocab.REQUIRED_FIELDS) + len(vocab.OPTIONAL_FIELDS) == 125 and len(vocab.DEVIATION_TYPES) == 43


def test_csv_with_mark_and_quotes(spark, tmp_path):
    (tmp_path / "log.csv").write_text('﻿case_id,step_name,remarks\n1,A,"x, y"\n\n2,B,"say ""hi"""\n', encoding="utf-8")
    df = files.csv_logs(spark, str(tmp_path / "log.csv"))
    assert df.columns == ["case_id", "step_name", "remarks"] and [r["remarks"] for r in df.orderBy("case_id").collect()] == ["x, y", 'say "hi"']


def test_rules_have_limits(spark):
    from caselens.queries.rules import loans

    df = loans(spark, SF)
    a, b = (rules.RULES["ltv_breach"](df, **x).count() for x in ({}, {"caps": {"home": 9.0, "auto": 9.0, "personal": 9.0}}))
    assert a > 0 and b == 0 and len(rules.RULES) == 30


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (22, 21)], "a long, b long")
    found = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert {found[i] for i in range(1, 10)} == {1} and {found[i] for i in (20, 21, 22)} == {20}


def test_density_clusters(spark):
    points = [(i, [float(i % 5) / 10, 0.0]) for i in range(10)] + [(100 + i, [5.0 + i / 10, 5.0]) for i in range(6)] + [(200, [9.0, -9.0])]
    df = spark.createDataFrame(points, "id long, v array<double>")
    found = {r["id"]: r["cluster"] for r in clusters.density_clusters(df, "id", "v", eps=0.5).collect()}
    assert {found[i] for i in range(10)} == {0} and {found[100 + i] for i in range(6)} == {100} and found[200] == -1


def test_outlier_stands_out(spark):
    df = spark.createDataFrame([(i, [float(i % 10), float(i % 7)]) for i in range(200)] + [(999, [500.0, -500.0])], "id long, v array<double>")
    rows = outliers.scored(df, "id", "v", contamination=0.05)
    assert rows.orderBy("score").first()["id"] == 999 and 0 < rows.where("is_anomaly").count() <= 11
    assert {r["is_anomaly"] for r in outliers.scored(df.limit(5), "id", "v").collect()} == {False}


def test_sample_holds_all_anomalies(spark):
    from caselens.queries.ml import labelled

    rows = labelled(spark, SF)
    sample = sampling.sampled(rows, 200)
    bad = rows.where("is_anomaly").select("deviation_id")
    assert bad.join(sample, "deviation_id", "left_anti").count() == 0
    assert sample.groupBy("deviation_id").count().where("count > 1").count() == 0
    assert sampling.allocation(rows, 75).agg(F.sum("allocated")).first()[0] == 75


def test_small_tables_pass_through(spark):
    assert {r["reason"] for r in analysis.ml_sample(t.deviations(spark, SF).limit(5)).collect()} == {"all"}


def test_positions_are_gapless(spark):
    rows = textbatch.numbered(t.deviations(spark, SF), spans=7)
    assert sorted(r["position"] for r in rows.select("position").collect()) == list(range(rows.count()))


def test_model_hook(spark):
    batches = spark.createDataFrame([(0, 2, "ab"), (1, 1, "c")], "batch long, n long, text string")
    found = textbatch.answered(batches, lambda s: s.str.upper()).orderBy("batch").collect()
    assert [r["answer"] for r in found] == ["AB", "C"]


def test_stream_of_logs(spark, tmp_path):
    logs = t.order_logs(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    logs.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    q = stream.daily_activity(source, delay="1 day").writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(logs) from activity").first()[0] == logs.count()
    q = stream.ingest(source.select("case_id", "officer_id", "step_name", "action", F.col("ts").cast("string").alias("timestamp")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "good")).count() == logs.count()


def test_merged_answers_bring_only_the_first_entries_together(spark):
    answer = "struct<behavioral_patterns:array<struct<pattern:string>>,hidden_rules:array<string>,systemic_issues:array<string>,time_patterns:array<string>,risk_insights:array<string>,recommendations:array<string>,api_calls_made:int>"
    rows = [(b, ([(f"p{b}.{i}",) for i in range(b % 4)] if b % 5 else None, None, [], ["t"], [None, f"r{b}"], [f"x{b}"] * 3, b % 3 or None)) for b in range(40)]
    merged = textbatch.merged(spark.createDataFrame(rows[::-1], f"batch long, result {answer}").repartition(5))
    [found] = merged.collect()
    assert found["batches"] == 40 and found["api_calls_made"] == sum(b % 3 or 1 for b in range(40))
    assert [x["pattern"] for x in found["behavioral_patterns"]] == [f"p{b}.{i}" for b in range(40) if b % 5 for i in range(b % 4)][:10]
    assert found["hidden_rules"] == [] == found["systemic_issues"] and found["time_patterns"] == ["t"] * 5
    assert found["risk_insights"] == [x for b in range(5) for x in (None, f"r{b}")] and found["recommendations"] == [f"x{b}" for b in range(4) for _ in range(3)][:10]
    assert merged._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") >= 6
    [none] = textbatch.merged(spark.createDataFrame([], f"batch long, result {answer}")).collect()
    assert none["batches"] == 0 and none["recommendations"] == []


def test_expected_sequence_has_no_window_over_all_rules(spark):
    rules_ = t.rules(spark)
    plan = detect.expected_sequence(rules_)._jdf.queryExecution().optimizedPlan().toString()
    assert all("windowspecdefinition(__span" in x for x in plan.splitlines() if "row_number()" in x)


def test_every_document_is_loaded_as_a_text(spark):
    want = {r["doc_id"]: (r["lang"], r["text"] or "") for r in t.read(spark, SF, "documents").collect()}
    found = q_ingest.document_texts(spark, SF).collect()
    assert {r["doc_id"]: (r["lang"], r["text"].removesuffix("\n")) for r in found} == want and len(found) == len(want)
    assert {(r["version"], r["file_type"], r["status"]) for r in found} == {("1.0", "txt", "pending")}


def test_preview_is_the_first_rows_in_order(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(50)], "k long, v string").repartition(7)
    assert [(r["position"], r["row"]) for r in files.preview(rows, "k").orderBy("position").collect()] == [(0, '{"k":0,"v":"x"}'), (1, '{"k":1,"v":null}'), (2, '{"k":2,"v":"x"}')]


def test_saved_reports_are_read_back_whole(spark):
    report = {
        "overall_summary": "9 deviations", "behavioral_patterns": [{"pattern": "p", "frequency": "all", "risk_level": "critical", "officers_involved": ["a", "b"], "supporting_evidence": "e"}],
        "hidden_rules": [{"rule": "r", "confidence": "high", "evidence": "e", "compliance_impact": "c"}], "systemic_issues": [{"issue": "i", "frequency": "9", "impact": "m", "recommended_fix": "f"}],
        "time_patterns": [{"pattern": "p", "reason": "r", "recommendation": "n"}],
        "justification_analysis": {"most_common_reasons": [{"reason": "w", "count": 3, "percentage": "33.3%"}], "justified_count": 0, "not_justified_count": 9, "unclear_count": 0, "justification_quality": "poor"},
        "risk_insights": ["k"], "recommendations": ["[CRITICAL] audit"], "api_calls_made": 1, "deviations_analyzed": 9,
    }
    merged = report | {"justification_analysis": {"note": "Aggregated from multiple batches"}}
    texts = [json.dumps(report), "As asked:\n```json\n" + json.dumps(merged)[:-1] + ",\n}\n```", json.dumps({k: v for k, v in report.items() if k != "hidden_rules"}), json.dumps(report | {"recommendations": [{"priority": "high", "recommendation": "x"}, {"text": "y"}, "z"]})]
    df = spark.createDataFrame(list(enumerate(texts)), "batch long, answer string")
    rows = {r["batch"]: r["result"].asDict(recursive=True) for r in textbatch.parsed(df, F.col("answer")).collect()}

    def there(x):
        return {k: there(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [there(v) for v in x] if isinstance(x, list) else x

    assert there(rows[0]) == report and there(rows[1]) == merged
    assert rows[2]["overall_summary"] == "unread" and rows[2]["api_calls_made"] == 0 and rows[2]["hidden_rules"] == []
    assert rows[3]["recommendations"] == ["[high] x", '[NORMAL] {"text":"y"}', "z"]


def test_rules_together_are_the_rules_one_by_one(spark):
    from collections import Counter

    from caselens.queries.rules import loans

    df = loans(spark, SF).persist()
    together = Counter(map(tuple, rules.apply_rules(df).collect()))
    assert together == sum((Counter(map(tuple, r(df).collect())) for r in rules.RULES.values()), Counter())
    scans = rules.apply_rules(loans(spark, SF))._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans <= 8
    df.unpersist()


def test_words_in_any_script(spark):
    from caselens.operators.ml import features

    df = spark.createDataFrame([("Théâtre größe niño",), ("théâtre GRÖSSE x",)], "description string")
    found = {r["term"]: (r["documents"], r["times"]) for r in features.vocabulary(df, min_df=1, max_df=1.0).collect()}
    assert found["théâtre"] == (2, 2) and found["größe"] == (1, 1) and found["niño"] == (1, 1) and found["größe niño"] == (1, 1) and "x" not in found


def test_documents_are_loaded_from_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_ingest, "scratch", lambda spark, name: str(tmp_path / name))
    n = q_ingest.document_texts(spark, SF).count()
    assert n == t.read(spark, SF, "documents").count() and len(list((tmp_path / "sops").rglob("part-*"))) < n / 10


def test_a_folder_of_texts_is_loaded_one_row_a_file(spark, tmp_path):
    for lang, name, text in (("en", "a.txt", "one\ntwo\n"), ("de", "b.v2.MD", "x")):
        (tmp_path / f"lang={lang}").mkdir()
        (tmp_path / f"lang={lang}" / name).write_text(text)
    found = sorted((r["file"], r["title"], r["version"], r["file_type"], r["status"], r["text"], r["lang"]) for r in files.sop_texts(spark, str(tmp_path)).collect())
    assert found == [("a.txt", "a", "1.0", "txt", "pending", "one\ntwo\n", "en"), ("b.v2.MD", "b.v2", "1.0", "md", "pending", "x", "de")]


def test_report_of_a_sample_whose_anomalies_exceed_the_target(spark, duck):
    from caselens import catalog
    from caselens.queries.ml import labelled

    rows = labelled(spark, SF)
    found = duck.sql(catalog.SQL["h22_sampling_report"].replace("2000", "7"))
    assert dict(zip(found.columns, found.fetchall()[0], strict=True)) == sampling.report(rows, sampling.sampled(rows, 7)).first().asDict()
