"""Neighbours in long cases and copies of a hot key against plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from caselens.operators import clean, ingest, neighbours
from caselens.operators.detect import step_pairs
from caselens.operators.views import flow_edges


def logs(spark, n=6000):
    """One case holds half of the log, logs without a case a quarter; many of equal times."""
    i = F.col("id")
    case = F.when(i % 2 == 0, "hot").when(i % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("c"), i % 50))
    step = F.concat(F.lit("s"), F.pmod(F.hash("id"), F.lit(7)))
    return spark.range(n).select(case.alias("case_id"), F.concat(F.lit("o"), i % 11).alias("officer_id"), step.alias("step_name"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(n // 20))).alias("ts"), F.col("id").alias("log_seq"))


def plain(rows):
    order = Window.partitionBy("case_id").orderBy("ts", "log_seq")
    return rows.select("case_id", F.first("officer_id").over(order).alias("officer_id"), F.col("step_name").alias("step_1"), F.lead("step_name").over(order).alias("step_2"), F.col("ts").alias("ts_1"), F.lead("ts").over(order).alias("ts_2"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_long_cases_are_many_chunks(spark):
    rows = logs(spark)
    assert neighbours.long_cases(rows, long=1000) == {"=hot": 3000, "-": 1500}
    parts, several = neighbours.chunked(rows, long=500)
    sizes = {(r["case_id"], r["chunk"]): r["count"] for r in parts.groupBy("case_id", "chunk").count().collect()}
    assert several and sum(c == "hot" for c, _ in sizes) > 5 and max(sizes.values()) < 800


def test_neighbours_of_a_case_that_holds_half_the_log(spark):
    rows = logs(spark)
    for long in (300, 1000, 10**9):
        assert rows_of(step_pairs(rows, long=long)) == rows_of(plain(rows))
    plan = step_pairs(rows, long=300)._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in plan and plan.count("Window") >= 1
    edges = {(r["from_step"], r["to_step"]): r["frequency"] for r in flow_edges(rows).collect()}
    assert sum(edges.values()) == plain(rows).where("step_2 is not null").count()


def test_the_trace_of_a_long_case(spark):
    found = [r["position"] for r in ingest.trace(logs(spark), "hot").collect()]
    assert found == list(range(1, 3001))


def test_a_hot_duplicate_key(spark):
    i = F.col("id")
    devs = spark.range(4000).repartition(7).select(F.when(i % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), i % 30)).alias("case_id"), F.lit("o").alias("officer_id"), F.lit("t").alias("deviation_type"), i.alias("n"))
    marked = clean.marked_duplicates(devs, "n")
    firsts = sorted(r["n"] for r in marked.where("not is_duplicate").collect())
    assert marked.count() == 4000 and firsts == sorted(r["n"] for r in clean.without_duplicates(devs, "n").collect()) == [0, 1, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    twice = devs.union(devs)  # rows alike throughout: one of them stays
    assert clean.marked_duplicates(twice, "n").where("not is_duplicate").count() == 11 == clean.without_duplicates(twice, "n").count()
    assert "WindowGroupLimit" in clean.without_duplicates(devs, "n")._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_before_they_are_put_in_order_and_hot_keys_after(spark, monkeypatch):
    devs = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") < 2000, "same").otherwise((F.col("id") % 700).cast("string")).alias("case_id"), F.lit("o").alias("officer_id"), F.lit("t").alias("deviation_type")).repartition(5)
    expected = sorted({("same" if i < 2000 else str(i % 700)): i for i in range(2999, -1, -1)}.values())

    def found():
        df = clean.without_duplicates(devs, "n")
        return sorted(r["n"] for r in df.collect()), "Partial" in df._jdf.queryExecution().executedPlan().toString()

    assert found() == (expected, False)  # no sort of input partitions
    monkeypatch.setattr(clean, "HELD", 100)
    assert found() == (expected, True)  # of the hot key, a partition passes on one row


def test_a_report_deals_flags_and_keys_but_no_texts(spark):
    devs = spark.range(40).select(
        F.col("id").cast("string").alias("deviation_id"), (F.col("id") % 30).cast("string").alias("case_id"), F.lit("o").alias("officer_id"), F.lit("t t").alias("deviation_type"), F.lit("HI").alias("severity"),
        F.lit("a  long text").alias("description"), F.lit(None).cast("string").alias("expected_behavior"), F.lit("x").alias("actual_behavior"), F.lit("n").alias("notes"))
    report = clean.report(devs)
    assert report.first().asDict() == {"original_count": 40, "duplicates_removed": 10, "type_fixes": 60, "missing_handled": 0, "text_fields_normalized": 30, "validation_errors": 0, "final_count": 30, "retained_pct": 75.0}
    assert all("description" not in line for line in report._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line or "Window" in line)
    assert report._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
