"""Event logs, rules, officers and deviations read from the given tables, and the same as SQL common tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import vocab

RULES = [
    (1, 1, "sequence", "Every case runs through the standard steps", 1, "high"),
    (2, 1, "approval", "Larger amounts need the approval of two people", 2, "critical"),
    (3, 1, "timing", "A case is done within 7 days", 3, "medium"),
]
RULES_SCHEMA = "rule_id long, sop_id int, rule_type string, rule_description string, step_number int, severity string"
TYPES = (
    "missing_step", "wrong_sequence", "unexpected_step", "missing_approval", "timing_violation", "tat_breach",
    "ltv_breach", "kyc_incomplete_progression", "post_disbursement_qc_delay", "collection_escalation_delay",
    "missing_core_field", "collateral_docs_incomplete",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULES_SCHEMA)


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are orders, steps the standard steps by line number, officers suppliers."""
    steps = F.array(*map(F.lit, vocab.STANDARD_STEPS))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_suppkey").cast("string").alias("officer_id"),
        F.get(steps, F.col("l_linenumber") - 1).alias("step_name"), F.col("l_shipdate").alias("ts"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")).alias("log_seq"), F.col("l_returnflag").alias("action"),
        F.col("l_linestatus").alias("status"), (F.col("l_quantity") * 60).cast("int").alias("duration_seconds"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("notes"),
    )


ORDER_LOGS = f"""logs as (
  select l_orderkey::varchar as case_id, l_suppkey::varchar as officer_id, {list(vocab.STANDARD_STEPS)}[l_linenumber] as step_name, l_shipdate as ts,
    l_linenumber::bigint * 1000000000 + l_suppkey as log_seq, l_returnflag as action, l_linestatus as status, (l_quantity * 60)::int as duration_seconds,
    case when l_partkey % 3 = 0 then 'part ' || l_partkey::varchar end as notes
  from lineitem)"""


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are a user's days, steps event types, officers twenty groups of users."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), day).alias("case_id"), (F.col("user_id") % 20).cast("string").alias("officer_id"),
        F.col("event_type").alias("step_name"), "ts", F.col("event_id").alias("log_seq"), F.lit("completed").alias("action"), F.lit("completed").alias("status"),
        F.lit(None).cast("int").alias("duration_seconds"), F.get_json_object("props", "$.k").alias("notes"),
    )


EVENT_LOGS = """logs as (
  select user_id::varchar || '/' || strftime(ts, '%Y-%m-%d') as case_id, (user_id % 20)::varchar as officer_id, event_type as step_name, ts, event_id as log_seq,
    'completed' as action, 'completed' as status, null::int as duration_seconds, json_extract_string(props, '$.k') as notes
  from events)"""


def officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officers are suppliers, their departments nations."""
    nation = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").cast("string").alias("officer_id"), F.col("s_name").alias("name"), F.lit("Loan Officer").alias("role"), F.col("n_name").alias("department"))


OFFICERS = """officers as (
  select s_suppkey::varchar as officer_id, s_name as name, 'Loan Officer' as role, n_name as department
  from supplier left join nation on s_nationkey = n_nationkey)"""


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def deviations(spark: SparkSession, sf_dir: str, part: str | None = None) -> DataFrame:
    """A deviation for every line of an order, clean: type by part, severity by quantity, time by ship date and part; part: the name of a column for the part's number."""
    k, n, q = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity")
    kind = F.get(F.array(*map(F.lit, TYPES)), ((k + 3 * n) % len(TYPES)).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string"), F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("deviation_id"),
        F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_suppkey").cast("string").alias("officer_id"), kind.alias("deviation_type"),
        F.when(q < 5, "critical").when(q < 15, "high").when(q < 35, "medium").otherwise("low").alias("severity"),
        _text("Line ", n, " of order ", F.col("l_orderkey"), " deviates").alias("description"), _text("Part ", k, " in order").alias("expected_behavior"),
        _text("Part ", k, " out of order").alias("actual_behavior"), F.when(k % 3 == 0, _text("part ", k)).alias("notes"),
        F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("l_shipdate")).alias("detected_at"), *([k.alias(part)] if part else []),
    )


_DEVIATIONS = f"""
  select concat_ws('-', l_orderkey::varchar, l_linenumber::varchar, l_suppkey::varchar, strftime(l_shipdate, '%Y%m%d')) as deviation_id,
    l_orderkey::varchar as case_id, l_suppkey::varchar as officer_id, {list(TYPES)}[(l_partkey + 3 * l_linenumber) % {len(TYPES)} + 1] as deviation_type,
    case when l_quantity < 5 then 'critical' when l_quantity < 15 then 'high' when l_quantity < 35 then 'medium' else 'low' end as severity,
    'Line ' || l_linenumber::varchar || ' of order ' || l_orderkey::varchar || ' deviates' as description,
    'Part ' || l_partkey::varchar || ' in order' as expected_behavior, 'Part ' || l_partkey::varchar || ' out of order' as actual_behavior,
    case when l_partkey % 3 = 0 then 'part ' || l_partkey::varchar end as notes, l_shipdate + to_hours((l_partkey % 24)::int) as detected_at"""
DEVIATIONS = f"devs as ({_DEVIATIONS} from lineitem)"


def raw_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviations as they might arrive: repeated, misspelt, blank, unspaced. Text columns throughout."""
    k = F.col("k")
    dirty = deviations(spark, sf_dir, "k").select(
        "deviation_id", F.when(k % 17 == 0, "  ").when(k % 5 == 0, F.concat(F.lit(" "), "case_id", F.lit(" "))).otherwise(F.col("case_id")).alias("case_id"), "officer_id",
        F.when(k % 6 == 0, F.upper(F.replace("deviation_type", F.lit("_"), F.lit("-")))).when(k % 6 == 1, F.replace("deviation_type", F.lit("_"), F.lit(" "))).otherwise(F.col("deviation_type")).alias("deviation_type"),
        F.when(k % 7 == 0, F.upper("severity")).when(k % 7 == 1, "crit").when(k % 7 == 2, " HI ").when(k % 7 == 3, "unknown").otherwise(F.col("severity")).alias("severity"),
        F.when(k % 29 == 0, "short").when(k % 11 == 0, F.concat(F.lit("\t"), F.replace("description", F.lit(" "), F.lit("  ")))).otherwise(F.col("description")).alias("description"),
        F.when(k % 4 != 0, F.col("expected_behavior")).alias("expected_behavior"), "actual_behavior", "notes", "detected_at", "k",
    )
    again = dirty.where(k % 13 == 0).withColumn("deviation_id", F.concat("deviation_id", F.lit("b")))
    return dirty.unionByName(again).drop("k")


RAW_DEVIATIONS = f"""made as ({_DEVIATIONS}, l_partkey as k from lineitem), dirty as (
  select deviation_id, case when k % 17 = 0 then '  ' when k % 5 = 0 then ' ' || case_id || ' ' else case_id end as case_id, officer_id,
    case when k % 6 = 0 then upper(replace(deviation_type, '_', '-')) when k % 6 = 1 then replace(deviation_type, '_', ' ') else deviation_type end as deviation_type,
    case when k % 7 = 0 then upper(severity) when k % 7 = 1 then 'crit' when k % 7 = 2 then ' HI ' when k % 7 = 3 then 'unknown' else severity end as severity,
    case when k % 29 = 0 then 'short' when k % 11 = 0 then chr(9) || replace(description, ' ', '  ') else description end as description,
    case when k % 4 <> 0 then expected_behavior end as expected_behavior, actual_behavior, notes, detected_at, k
  from made), raw as (
  select * exclude (k) from dirty union all select deviation_id || 'b', * exclude (k, deviation_id) from dirty where k % 13 = 0)"""
