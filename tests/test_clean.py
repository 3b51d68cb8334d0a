from pyspark.sql import functions as F

from caselens.operators import clean as c

SCHEMA = "deviation_id long, case_id string, officer_id string, deviation_type string, severity string, description string, expected_behavior string, actual_behavior string, notes string"
GOOD = ("X", "O1", "missing_step", "high", "A step is missing here", "e", "a", "n")


def devs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def changed(**fields):
    names = SCHEMA.replace("deviation_id long, ", "").replace(" string", "").split(", ")
    return tuple(fields.get(n, v) for n, v in zip(names, GOOD, strict=True))


def test_report_of_six_rows(spark):
    rows = [changed(case_id=f"C{i}") for i in range(4)]
    df = devs(spark, *rows, changed(case_id="C0"), changed(case_id=" "))
    r = c.graded(c.report(df)).first()
    assert (r["original_count"], r["duplicates_removed"], r["type_fixes"], r["missing_handled"], r["final_count"]) == (6, 1, 0, 1, 4)
    assert (r["text_fields_normalized"], r["validation_errors"], r["retained_pct"], r["quality_score"], r["grade"]) == (0, 0, 66.67, 66.67, "D")


def test_empty_table(spark):
    r = c.graded(c.report(devs(spark, GOOD).limit(0))).first()
    assert (r["original_count"], r["retained_pct"], r["quality_score"], r["grade"]) == (0, 0.0, 0.0, "N/A")


def test_severities(spark):
    given = [" HI ", "crit", "unknown", "Critical", "important", "minor", "med", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    found = [r["x"] for r in df.orderBy("i").select(c.severity_of(F.col("s")).alias("x")).collect()]
    assert found == ["high", "critical", "medium", "critical", "high", "low", "medium", None]


def test_types(spark):
    df = spark.createDataFrame([("Missing Step",), ("missing-step",), ("missing_step",), ("made -up",)], "t string")
    found = [(r["a"], r["b"], r["c"]) for r in df.select(c.type_of(F.col("t")).alias("a"), c.type_fixed(F.col("t")).alias("b"), c.type_unknown(F.col("t")).alias("c")).collect()]
    assert found == [("missing_step", True, False), ("missing_step", True, False), ("missing_step", False, False), ("made_up", True, True)]


def test_description_of_nine_and_ten(spark):
    df = devs(spark, changed(case_id="A", description="123456789"), changed(case_id="B", description="1234567890"))
    assert [r["case_id"] for r in c.cleaned(df).collect()] == ["B"]
    assert [r["reject_reason"] for r in c.rejected(df).collect()] == ["Description too short"]


def test_white_space_of_all_kinds(spark):
    df = devs(spark, changed(description=" \x1da \tb   long\x07 text "))
    assert c.cleaned(df).first()["description"] == "a b long text"


def test_missing_step_rows_of_a_case_collapse(spark):
    df = devs(spark, changed(description="Missing step one"), changed(description="Missing step two"))
    assert [r["description"] for r in c.cleaned(df).collect()] == ["Missing step one"]
    by_text = c.without_duplicates(df, "deviation_id", [F.col("description")])
    assert by_text.count() == 2


def test_null_and_the_word_none_are_one_key(spark):
    df = devs(spark, changed(case_id=None), changed(case_id="None"))
    assert c.without_duplicates(df, "deviation_id").count() == 1


def test_cleaning_is_a_fixpoint(spark):
    df = devs(spark, GOOD, changed(case_id="Y", severity="crit", deviation_type="Missing-Step", description="  two  blanks here "), changed(case_id="Z", expected_behavior=None, notes=None))
    once = c.cleaned(df)
    assert sorted(map(str, once.collect())) == sorted(map(str, c.cleaned(once).collect()))


def test_steps_can_be_left_out(spark):
    df = devs(spark, GOOD, GOOD)
    assert c.cleaned(df, steps=("types", "missing", "text")).count() == 2
