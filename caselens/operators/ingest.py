"""Logs in: header mapping, alias-resolving projection, required fields with quarantine, times, notes, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import times, vocab
from caselens.operators.textbatch import numbered
from caselens.plans.graphs import spread

FIELDS = tuple(name for name, _ in vocab.LOG_ALIASES)


def _filled(name: str) -> Column:
    return F.nullif(F.col(f"`{name}`").cast("string"), F.lit(""))


def field(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first value that is neither null nor empty among the columns of these names; each name exactly, then in any case."""
    found: list[str] = []
    for name in names:
        found += [c for c in df.columns if c == name and c not in found]
        found += [c for c in df.columns if c.lower() == name.lower() and c not in found][:1]
    return F.coalesce(*[_filled(c) for c in found]) if found else F.lit(None).cast("string")


def logs_from(df: DataFrame, formats: tuple[str, ...] = times.LOG_FORMATS, row_col: str | None = None) -> DataFrame:
    """The log fields of any table, as text but for ts and duration_seconds, with reject_reason: null where the row is good.

    row_col numbers the rows from 0; without it rows are numbered as they stand in the partitions (in order, with gaps).
    A time that no format reads is a missing timestamp.
    """
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    text = df.select(row.alias("log_seq"), *[field(df, names).alias(name) for name, names in vocab.LOG_ALIASES])
    out = text.withColumns({
        "action": F.coalesce("action", F.lit("completed")), "status": F.coalesce("status", F.lit("completed")), "ts": times.parsed(F.col("timestamp"), formats),
        "duration_seconds": F.expr("try_cast(regexp_extract(duration_seconds, '^\\\\s*([+-]?\\\\d+)', 1) as int)"), "notes": F.nullif(F.trim("notes"), F.lit("")),
    })
    missing = F.when(F.col("case_id").isNull(), "case_id").when(F.col("officer_id").isNull(), "officer_id").when(F.col("step_name").isNull(), "step_name").when(F.col("ts").isNull(), "timestamp")
    return out.withColumn("reject_reason", F.concat(F.lit("Row "), (F.col("log_seq") + 2).cast("string"), F.lit(": Missing "), missing))


def good(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is null").drop("reject_reason")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is not null")


def ingest_summary(rows: DataFrame, errors: int = 10) -> DataFrame:
    """One row: rows, saved, skipped, cases, officers and notes among the saved, the first errors, and whether there are more."""
    ok = F.col("reject_reason").isNull()
    n = rows.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(ok).alias("saved"), F.count_if(~ok).alias("skipped"), F.count_distinct(F.when(ok, F.col("case_id"))).alias("cases"),
        F.count_distinct(F.when(ok, F.col("officer_id"))).alias("officers"), F.count_if(ok & F.col("notes").isNotNull()).alias("notes"))
    first = quarantined(rows).orderBy("log_seq").limit(errors).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("log_seq", "reject_reason"))), lambda x: x["reject_reason"]), "; ").alias("first_errors"))
    return n.crossJoin(first).withColumn("has_more", F.col("skipped") > errors)


def header_mapping(headers: DataFrame, strict: bool = False) -> DataFrame:
    """(file, header, field) of rows (file, header): the first field with a pattern that equals the header or is part of it.

    strict takes a field whose pattern equals the header before any whose pattern is only a part. Patterns are a fixed list, tried in one expression.
    """
    h = F.lower(F.trim("header"))
    tried = [F.when(h.isin(*words), name) for name, words in vocab.HEADER_PATTERNS] if strict else []
    tried += [F.when(reduce(Column.__or__, [h.contains(p) for p in words]), name) for name, words in vocab.HEADER_PATTERNS]
    return spread(headers.select("file", "header"), "file").distinct().withColumn("field", F.coalesce(*tried))


def mapping_check(mapping: DataFrame) -> DataFrame:
    """(file, missing_required, optional_present, n_mapped, is_valid, message) of each file's mapping."""
    required, optional = (F.array(*map(F.lit, x)) for x in (vocab.REQUIRED_FIELDS, vocab.OPTIONAL_FIELDS))
    rows = mapping.groupBy("file").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.count("field").alias("n_mapped"))
    rows = rows.withColumns({"missing": F.array_except(required, "fields"), "present": F.array_sort(F.array_intersect("fields", optional))})
    valid = F.size("missing") == 0
    text = F.when(valid, "Mapping is valid").otherwise(F.concat(F.lit("Missing required fields: "), F.array_join("missing", ", ")))
    return rows.select("file", F.array_join("missing", ",").alias("missing_required"), F.array_join("present", ",").alias("optional_present"), "n_mapped", valid.alias("is_valid"), text.alias("message"))


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The columns of df that the mapping (header to field) names, renamed; headers that df lacks are passed over, of two for one field the last counts."""
    last = {field_name: header for header, field_name in mapping.items() if header in df.columns}
    return df.select(*[F.col(f"`{header}`").alias(field_name) for field_name, header in last.items()])


def notes_column(mapping: DataFrame) -> DataFrame:
    """(file, header) of the column mapped to notes or comments, the first by name."""
    return mapping.where(F.col("field").isin("notes", "comments")).groupBy("file").agg(F.min("header").alias("header"))


def filtered(logs: DataFrame, case_id: str | None = None, officer_id: str | None = None) -> DataFrame:
    """Logs of a case and/or an officer, with the total before any limit."""
    for name, value in (("case_id", case_id), ("officer_id", officer_id)):
        logs = logs if value is None else logs.where(F.col(name) == value)
    return logs


def page(logs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest logs first, a page of them, with the total number of all."""
    total = F.broadcast(logs.agg(F.count(F.lit(1)).alias("total")))
    return logs.orderBy(F.desc("ts"), "case_id", "log_seq").offset(offset).limit(limit).crossJoin(total)


def trace(logs: DataFrame, case_id: str) -> DataFrame:
    """One case's logs, oldest first, numbered from 1; a case of any length, by ranges of its times."""
    own = logs.where(F.col("case_id") == case_id)
    placed = numbered(own.withColumn("__place", F.struct("ts", "log_seq")), "__place").drop("__place")
    return placed.withColumn("position", (F.col("position") + 1).cast("int")).orderBy("position")


def new_officers(logs: DataFrame, officers: DataFrame) -> DataFrame:
    """Officers that the logs name and the table lacks, with a made-up name and the usual role."""
    absent = logs.select("officer_id").where("officer_id is not null").distinct().join(officers.select("officer_id"), "officer_id", "left_anti")
    return absent.select("officer_id", F.concat(F.lit("Officer "), "officer_id").alias("name"), F.lit("Loan Officer").alias("role"), F.lit(None).cast("string").alias("department"))
