"""Deviations as text for a model, in batches, and the model's answers back as tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.operators.sop import json_in
from caselens.plans.graphs import kept

ANSWER = """overall_summary string,
behavioral_patterns array<struct<pattern:string,frequency:string,risk_level:string,officers_involved:array<string>,supporting_evidence:string>>,
hidden_rules array<struct<rule:string,confidence:string,evidence:string,compliance_impact:string>>,
systemic_issues array<struct<issue:string,frequency:string,impact:string,recommended_fix:string>>,
time_patterns array<struct<pattern:string,reason:string,recommendation:string>>,
justification_analysis struct<note:string,most_common_reasons:array<struct<reason:string,count:int,percentage:string>>,justified_count:int,not_justified_count:int,unclear_count:int,justification_quality:string>,
risk_insights array<string>, recommendations array<string>, api_calls_made int, deviations_analyzed int"""
#: What stands for an answer that can't be read: empty lists, counts of 0, and a status of the library's own as its summary.
UNREAD = "unread"
EMPTY = json.dumps({
    "overall_summary": UNREAD, "behavioral_patterns": [], "hidden_rules": [], "systemic_issues": [], "time_patterns": [],
    "justification_analysis": {"most_common_reasons": [], "justified_count": 0, "not_justified_count": 0, "unclear_count": 0},
    "risk_insights": [], "recommendations": [], "api_calls_made": 0, "deviations_analyzed": 0,
})
#: Keys that an answer must have, and how many entries of each list a merged answer keeps.
REQUIRED = ("overall_summary", "behavioral_patterns", "hidden_rules", "systemic_issues", "recommendations")
KEPT = {"behavioral_patterns": 10, "hidden_rules": 5, "systemic_issues": 5, "time_patterns": 5, "risk_insights": 10, "recommendations": 10}
#: Dollars for a thousand tokens in and out.
PRICE_IN, PRICE_OUT = 0.003, 0.015


def spans_of(devs: DataFrame, span_rows: int = 50_000) -> int:
    """How many ranges keep about span_rows rows in each."""
    return max(1, -(-devs.count() // span_rows))


def numbered(devs: DataFrame, order: str = "deviation_id", spans: int | None = None, span_rows: int = 50_000) -> DataFrame:
    """devs with position, from 0 in the order of a column, without bringing all rows together.

    Rows are dealt to ranges of the order, as many as keep about span_rows rows in each, put in order there by the task that gets them, and kept so; a position
    is the rows in the ranges before, a sum over few counts, plus the place in the range.
    """
    ranged = devs.repartitionByRange(spans or spans_of(devs, span_rows), order).sortWithinPartitions(order)
    ranged = kept(ranged.withColumn("__row", F.monotonically_increasing_id()))  # the range in the upper 31 bits, the place in the lower 33
    ranged = ranged.withColumns({"__span": F.shiftright("__row", 33), "__place": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__row")
    counts = ranged.groupBy("__span").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__span", (F.sum("__n").over(Window.orderBy("__span")) - F.col("__n")).alias("__before"))  # spans rows
    return ranged.join(F.broadcast(before), "__span").withColumn("position", F.col("__before") + F.col("__place")).drop("__span", "__place", "__before")


def batched(devs: DataFrame, size: int = 100, order: str = "deviation_id", spans: int | None = None) -> DataFrame:
    """devs with position and batch: `size` rows each, in order."""
    return numbered(devs, order, spans).withColumn("batch", F.floor(F.col("position") / size).cast("long"))


def block(position: Column) -> Column:
    """The text of one deviation, numbered within its batch from 1."""
    def shown(name: str, absent: str = "N/A") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(absent))

    lines = [
        F.concat(F.lit("Deviation "), position.cast("string"), F.lit(":")), F.concat(F.lit("- Case ID: "), shown("case_id")), F.concat(F.lit("- Officer ID: "), shown("officer_id")),
        F.concat(F.lit("- Type: "), shown("deviation_type")), F.concat(F.lit("- Severity: "), shown("severity")), F.concat(F.lit("- Description: "), shown("description")),
        F.concat(F.lit("- Expected: "), shown("expected_behavior")), F.concat(F.lit("- Actual: "), shown("actual_behavior")),
        F.concat(F.lit("- Notes: "), F.coalesce(F.nullif("notes", F.lit("")), F.lit("No notes/comments available"))),
    ]
    return F.concat_ws("\n", *lines)


def batch_texts(devs: DataFrame, size: int = 100, order: str = "deviation_id") -> DataFrame:
    """(batch, n, text): the blocks of each batch in order, a blank line between them; as many tasks as ranges."""
    spans = spans_of(devs)
    rows = batched(devs, size, order, spans).repartition(spans, "batch")
    texts = rows.select("batch", "position", block(F.col("position") % size + 1).alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda x: x["block"]), "\n\n")
    return texts.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), joined.alias("text"))


def statistics_text(overview: DataFrame, severities: DataFrame, types: DataFrame) -> DataFrame:
    """One row, context: the overview, severities and most frequent types as text; the tables have a few rows each."""
    def lines(df: DataFrame, order: Column, line: Column, name: str) -> DataFrame:
        return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda x: x["line"]), "\n").alias(name))

    part = F.concat(F.lit(": "), F.col("count").cast("string"), F.lit(" ("), F.col("percentage").cast("string"), F.lit("%)"))
    s = lines(severities, F.col("position"), F.concat(F.lit("- "), F.initcap("severity"), part), "severity_lines")
    t = lines(types, F.struct((-F.col("count")).alias("n"), "deviation_type"), F.concat(F.lit("- "), F.col("deviation_type"), part), "type_lines")
    head = F.concat_ws(
        "\n", F.concat(F.lit("- Total Deviations: "), F.col("total_deviations").cast("string")), F.concat(F.lit("- Unique Cases: "), F.col("unique_cases").cast("string")),
        F.concat(F.lit("- Unique Officers: "), F.col("unique_officers").cast("string")))
    return overview.crossJoin(s).crossJoin(t).select(F.concat_ws("\n", F.lit("Overview:"), head, F.lit("Severity Distribution:"), "severity_lines", F.lit("Top Deviation Types:"), "type_lines").alias("context"))


def cluster_text(summary: DataFrame) -> DataFrame:
    """One row, context: a line for each cluster that isn't noise, in the order of clusters."""
    line = F.concat(F.lit("CLUSTER_"), F.col("cluster").cast("string"), F.lit(": "), F.col("size").cast("string"), F.lit(" deviations, top type "), "top_type", F.lit(", top severity "), "top_severity")
    rows = summary.where("cluster != -1").select("cluster", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "line"))), lambda x: x["line"]), "\n").alias("context"))


def case_texts(logs: DataFrame) -> DataFrame:
    """(case_id, text, notes): the numbered steps of each case in the order of time, and its notes, or that there are none."""
    order = Window.partitionBy("case_id").orderBy("ts", "log_seq")
    line = F.concat(
        F.row_number().over(order).cast("string"), F.lit(". Step: "), "step_name", F.lit(", Action: "), "action", F.lit(", Time: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(", Status: "), F.coalesce("status", F.lit("N/A")))
    rows = logs.select("case_id", F.row_number().over(order).alias("nth"), line.alias("line"), F.when(F.col("notes") != "", F.concat(F.lit("["), "step_name", F.lit("] "), "notes")).alias("note"))
    ordered = F.array_sort(F.collect_list(F.struct("nth", "line", "note")))
    found = rows.groupBy("case_id").agg(ordered.alias("lines"))
    notes = F.array_join(F.transform("lines", lambda x: x["note"]), " | ")
    return found.select("case_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.when(notes != "", notes).otherwise("No notes available for this case").alias("notes"))


def rules_text(rules: DataFrame) -> DataFrame:
    """One row, rules: the numbered rules of a small table."""
    line = F.concat(F.row_number().over(Window.orderBy("rule_id")).cast("string"), F.lit(". ["), "rule_type", F.lit("] "), "rule_description", F.lit(" (Severity: "), "severity", F.lit(")"))
    rows = rules.select("rule_id", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "line"))), lambda x: x["line"]), "\n").alias("rules"))


def nothing(texts: pd.Series) -> pd.Series:
    """The scorer that stands in where there is no model: no answer."""
    return pd.Series([None] * len(texts), dtype=object)


def counting(texts: pd.Series) -> pd.Series:
    """A scorer that answers by rule: how many deviations of a batch are critical, in a fence and with a trailing comma as models write them."""
    n = texts.str.count("- Severity: critical\\n").astype(str)
    return "Found:\n```json\n{\"overall_summary\": \"" + n + " critical\", \"behavioral_patterns\": [], \"hidden_rules\": [], \"systemic_issues\": [], \"recommendations\": [], \"api_calls_made\": 1,}\n```"


def answered(batches: DataFrame, model: Callable[[pd.Series], pd.Series] = nothing) -> DataFrame:
    """batches with answer, by a function from a series of texts to a series of answers, run in the tasks."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(answer=model(pdf["text"]).to_numpy())

    rows = batches.drop("answer")
    return rows.mapInPandas(ask, T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())]))


def parsed(answers: DataFrame, text: Column) -> DataFrame:
    """answers with result, a struct: the JSON in the text read, fenced or bare; the empty result where it can't be read or lacks a required key.

    Recommendations that are objects become "[priority] text", NORMAL without a priority, the object itself without a text.
    """
    rows = answers.withColumn("__json", json_in(text))
    said = F.col("__json")
    spelt = F.from_json(F.get_json_object(said, "$.recommendations"), "array<string>")

    def plain(r: Column) -> Column:
        text = F.coalesce(F.get_json_object(r, "$.recommendation"), r)
        return F.when(r.startswith("{"), F.concat(F.lit("["), F.coalesce(F.get_json_object(r, "$.priority"), F.lit("NORMAL")), F.lit("] "), text)).otherwise(r)

    keys = F.json_object_keys(said)
    ok = F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED), F.lit(False))
    read = rows.withColumns({"__read": F.from_json(said, ANSWER), "__spelt": spelt, "__ok": ok})
    result = F.when(F.col("__ok"), F.col("__read").withField("recommendations", F.coalesce(F.transform("__spelt", plain), F.col("__read.recommendations")))).otherwise(F.from_json(F.lit(EMPTY), ANSWER))
    return read.withColumn("result", result).drop("__json", "__read", "__spelt", "__ok")


def merged(results: DataFrame, count_col: str | None = None) -> DataFrame:
    """One row of rows (batch, result): a summary, lists joined in the order of batches, so many entries of each kept; calls and deviations summed.

    count_col: the number of deviations of a batch; without it the results' own numbers count.
    """
    results = kept(results)
    own = "deviations_analyzed" in results.schema["result"].dataType.names
    n = F.col(count_col) if count_col else F.coalesce("result.deviations_analyzed", F.lit(0)) if own else F.lit(0)
    out = results.agg(F.count(F.lit(1)).alias("batches"), F.sum(F.coalesce("result.api_calls_made", F.lit(1))).alias("api_calls_made"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("deviations_analyzed"))
    for name, most in KEPT.items():
        entries = results.select("batch", "result", F.posexplode(f"result.{name}").alias("place", "entry"))
        first = entries.orderBy("batch", "result", "place").limit(most)  # at most so many rows of each partition meet
        row = F.array_sort(F.collect_list(F.struct("batch", "result", "place", "entry")))
        out = out.crossJoin(first.agg(F.transform(row, lambda x: x["entry"]).alias(name)))
    summary = F.concat(F.lit("Aggregated analysis from "), F.col("batches").cast("string"), F.lit(" batches covering "), F.col("deviations_analyzed").cast("string"), F.lit(" deviations"))
    return out.withColumns({"overall_summary": summary, "justification_analysis": F.struct(F.lit("Aggregated from multiple batches").alias("note"))})


def usage(calls: DataFrame) -> DataFrame:
    """One row of rows (input_tokens, output_tokens): calls, tokens and cost."""
    n = calls.agg(F.count(F.lit(1)).alias("total_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"))
    return n.withColumn("cost", F.round(F.col("input_tokens") * PRICE_IN / 1000 + F.col("output_tokens") * PRICE_OUT / 1000, 6))
