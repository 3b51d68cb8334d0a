"""Files in and out: CSV and JSON logs, procedure texts, tables by batch."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"


def csv_logs(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log with a header: every column text, blank lines skipped, a byte-order mark taken off the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.removeprefix(BOM).strip('"') for c in df.columns])


def json_logs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of log records, or one record a line."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def preview(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first n rows in the order of a column as (position, row): the row is JSON."""
    first = df.orderBy(order).limit(n)
    position = F.row_number().over(Window.orderBy(order)) - 1  # n rows
    return first.select(position.alias("position"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def headers(df: DataFrame, file: str) -> DataFrame:
    """(file, position, header) of a table's columns."""
    return df.sparkSession.createDataFrame([(file, i, c) for i, c in enumerate(df.columns)], "file string, position int, header string")


def record(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; no row if there is none."""
    return df.where(F.col(key) == value)


def append_logs(logs: DataFrame, path: str, upload_id: str, uploaded_at: str) -> None:
    """Append one upload, partitioned by its id, with one time for all its rows."""
    rows = logs.withColumns({"upload_id": F.lit(upload_id), "uploaded_at": F.lit(uploaded_at).cast("timestamp")})
    rows.write.mode("append").partitionBy("upload_id").parquet(path)


def append_deviations(devs: DataFrame, path: str, run_id: str) -> None:
    """Append the deviations of one run, partitioned by its id; running again under another id doesn't mix with it."""
    devs.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def without_upload(logs: DataFrame, uploaded_second: str, uploaded: str = "uploaded_at") -> DataFrame:
    """Logs but for those uploaded in the given second."""
    return logs.where(F.date_format(uploaded, "yyyy-MM-dd HH:mm:ss") != uploaded_second)


def without_sop(sops: DataFrame, rules: DataFrame, sop_id) -> tuple[DataFrame, DataFrame]:
    """Procedures and rules but for one procedure and its rules."""
    return sops.where(F.col("sop_id") != sop_id), rules.where(F.col("sop_id") != sop_id)


def merged_mapping(saved: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(sop_id, header, field): saved mappings with the confirmed ones over them."""
    new = confirmed.select("sop_id", "header", F.col("field").alias("new_field"))
    return saved.join(new, ["sop_id", "header"], "full_outer").select("sop_id", "header", F.coalesce("new_field", "field").alias("field"))


def save_mapping(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").partitionBy("sop_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON, one a line."""
    df.write.mode("overwrite").json(path)


#: Lines of a file that its head is looked for in, however large it is.
HEAD_LINES = 200


def head(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """(position, header, value) of the first n records of a CSV file, or of the first by name of a folder's, every column; what is read doesn't grow with the file.

    The first HEAD_LINES lines are taken from the first split; values may hold line breaks and quotes. Blank lines are passed over; absent values are null.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [x.getPath() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    first = min((str(x.toString()) for x in found if not x.getName().startswith(("_", "."))), default=None)
    lines = [r["value"] for r in spark.read.text(first).limit(HEAD_LINES).collect()] if first else []
    records = [r for r in csv.reader(io.StringIO("\n".join(lines).removeprefix(BOM))) if r]
    names, rows = (records[0], records[1 : n + 1]) if records else ([], [])
    cells = [(i, c, row[k] if k < len(row) else None) for i, row in enumerate(rows) for k, c in enumerate(names)]
    return spark.createDataFrame(cells, "position int, header string, value string")


#: Separates the texts of a corpus file, and what stands for it, and for itself, within a text.
BETWEEN, ESCAPE = "\x1e", "\x1a"
ENTRY = "file string, title string, version string, file_type string, status string"


def write_corpus(texts: DataFrame, path: str) -> None:
    """Texts (file, title, version, file_type, status, text) in a few files, many texts in each, which readers can split between texts."""
    whole = F.concat(F.to_json(F.struct(*[c.split()[0] for c in ENTRY.split(", ")])), F.lit("\n"), F.coalesce("text", F.lit("")))
    safe = F.replace(F.replace(whole, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(BETWEEN), F.lit(f"{ESCAPE}1"))
    texts.select(safe.alias("value")).write.mode("overwrite").option("lineSep", BETWEEN).text(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, version, file_type, status, text) of the texts of corpus files; a null text has come back empty."""
    whole = spark.read.option("lineSep", BETWEEN).text(path)
    plain = F.replace(F.replace("value", F.lit(f"{ESCAPE}1"), F.lit(BETWEEN)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))
    cut = F.locate("\n", "value")
    rows = whole.withColumn("value", plain).where("value != ''")
    return rows.select(F.from_json(F.substring("value", F.lit(1), cut - 1), ENTRY).alias("entry"), F.substring("value", cut + 1, F.length("value")).alias("text")).select("entry.*", "text")


def sop_texts(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    """Procedure texts of a folder, one row a file, with name, version, type and status, and the columns that its folders name."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = spark.read.text(path, wholetext=True)
    folders = [c for c in df.columns if c != "value"]
    df = df.select(name.alias("file"), F.col("value").alias("text"), *folders)
    return df.select("file", F.regexp_replace("file", r"\.[^.]*$", "").alias("title"), F.lit(version).alias("version"), F.lower(F.element_at(F.split("file", r"\."), -1)).alias("file_type"), F.lit("pending").alias("status"), "text", *folders)
