"""Cleaning of deviation tables: repeated rows, spellings, missing values, unspaced text, with a report of it all.

One projection flags every row; a row leaves with the first step that rejects it, so that the report is a single
aggregation over flags. Steps can be switched off by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import vocab

STEPS = ("duplicates", "types", "missing", "text")
REQUIRED = ("case_id", "officer_id", "deviation_type", "severity", "description")
COUNTS = ("original_count", "duplicates_removed", "type_fixes", "missing_handled", "text_fields_normalized", "validation_errors", "final_count")
TEXTS = ("description", "expected_behavior", "actual_behavior", "notes")
#: White space by Unicode, as a class and one by one, and control characters.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: What `spaced` changes inside a text, besides two blanks in a row: white space that is not a blank, and control characters.
UNEVEN = "".join(map(chr, [*range(0x20), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Rows that a task puts in order to find duplicates, and keys that a pass can hold to have more copies.
HELD = 1_200_000
TRACKED = 1000


def stripped(c: Column) -> Column:
    """Text without outer white space. Most texts have none and pass as they are: trimming by a list of characters costs microseconds a text."""
    return F.when(F.substring(c, 1, 1).isin(*SPACES) | F.substring(c, -1, 1).isin(*SPACES), F.btrim(c, F.lit(SPACES))).otherwise(c)


def spaced(c: Column) -> Column:
    """Text without outer white space, with single blanks inside and no control characters."""
    return inner_spaced(stripped(c))


def inner_spaced(c: Column) -> Column:
    """The same of a text that is stripped already; most texts are even and pass as they are."""
    even = F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), CONTROL, "")
    return F.when(F.contains(c, F.lit("  ")) | (F.translate(c, UNEVEN, "") != c), even).otherwise(c)


def duplicate_key() -> list[Column]:
    """Case, officer and type; a null is the text None."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("case_id", "officer_id", "deviation_type")]
    return [stripped(text[0]), stripped(text[1]), F.lower(stripped(text[2]))]


def marked_duplicates(devs: DataFrame, order_col: str, key: list[Column] | None = None) -> DataFrame:
    """devs with is_duplicate: whether an earlier row has the same key. The row of smallest order_col stays.

    The first row of each key and partition is found first, then the first of those; so a key may have any number of copies.
    """
    names = [f"__key{i}" for i in range(len(key or duplicate_key()))]
    rows = devs.withColumns(dict(zip(names, key or duplicate_key(), strict=True))).withColumn("__part", F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy(*names, "__part").orderBy(order_col))
    rows = rows.withColumn("__part", F.when(own == 1, F.lit(-1)).otherwise(F.col("__part")))
    first = F.row_number().over(Window.partitionBy(*names, "__part").orderBy(order_col))
    return rows.withColumn("is_duplicate", (F.col("__part") >= 0) | (first > 1)).drop(*names, "__part")


def without_duplicates(devs: DataFrame, order_col: str, key: list[Column] | None = None) -> DataFrame:
    """The rows that are no duplicates.

    Rows are dealt by their key to tasks of a bounded number each and put in order there alone: a sort before they are dealt would have to hold whole input
    partitions. Keys with more copies than a task should hold are found by a sketch first; of those, a partition passes on one row at most.
    """
    names = [f"__key{i}" for i in range(len(key or duplicate_key()))]
    rows = devs.withColumns(dict(zip(names, key or duplicate_key(), strict=True))).withColumn("__hash", F.xxhash64(*names))
    n, tops = rows.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(__hash, {TRACKED}, {10 * TRACKED})")).first()
    hot = [r["item"] for r in tops or [] if r["count"] > HELD]
    first = F.row_number().over(Window.partitionBy("__hash", *names).orderBy(order_col))
    rest, tasks = rows.where(~F.col("__hash").isin(hot)) if hot else rows, -(-n // HELD)
    rest = rest.repartition(tasks, "__hash") if tasks > int(devs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rest.repartition("__hash")
    dealt = rest.withColumn("__first", first).where("__first = 1")
    if hot:
        dealt = dealt.unionByName(rows.where(F.col("__hash").isin(hot)).withColumn("__first", first).where("__first = 1"))
    return dealt.drop("__first", "__hash", *names)


def as_text(devs: DataFrame, columns: tuple[str, ...] = (*REQUIRED, *TEXTS[1:])) -> DataFrame:
    """devs with the given columns as strings."""
    return devs.withColumns({c: F.col(c).cast("string") for c in columns if c in devs.columns})


def severity_of(c: Column) -> Column:
    """One of the four severities: as it is, by its known spellings, else medium."""
    return F.when(c.isNotNull(), spelt_severity(F.lower(stripped(c))))


def spelt_severity(s: Column) -> Column:
    known = F.when(s.isin(*vocab.SEVERITIES), s)
    for spelling, meant in vocab.SEVERITY_SPELLINGS.items():
        known = known.when(s == spelling, F.lit(meant))
    return known.otherwise(F.lit("medium"))


def severity_fixed(c: Column) -> Column:
    return F.coalesce(~F.lower(stripped(c)).isin(*vocab.SEVERITIES), F.lit(False))


def type_of(c: Column) -> Column:
    """A type's name: lower case, with single underscores for blanks and hyphens. Unknown names stay."""
    return F.regexp_replace(F.lower(stripped(c)), "[- ]+", "_")


def type_fixed(c: Column) -> Column:
    return F.coalesce(type_of(c) != c, F.lit(False))


def type_unknown(c: Column) -> Column:
    return F.coalesce(~type_of(c).isin(*vocab.DEVIATION_TYPES), F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (stripped(c) == "")


def flagged(devs: DataFrame, order_col: str = "deviation_id", steps: tuple[str, ...] = STEPS) -> DataFrame:
    """devs cleaned, every row still there, with is_duplicate, type_fixes, is_missing, text_fixes and validation_error."""
    return checked(marked_duplicates(devs, order_col) if "duplicates" in steps else devs.withColumn("is_duplicate", F.lit(False)), steps)


def checked(devs: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """devs with what `flagged` adds but is_duplicate. Each value is cleaned once, in a projection of its own; what comes after compares the cleaned values."""
    off, none = F.lit(False), F.lit(0)
    out = as_text(devs)
    stripped_of = {c: f"__{c}" for c in dict.fromkeys((*REQUIRED, *TEXTS))}
    out = out.withColumns({s: stripped(F.col(c)) for c, s in stripped_of.items()})
    if "types" in steps:
        low = out.withColumns({"__low": F.lower("__severity"), "__type": F.regexp_replace(F.lower("__deviation_type"), "[- ]+", "_")})
        fixes = F.coalesce(~F.col("__low").isin(*vocab.SEVERITIES), off).cast("int") + F.coalesce(F.col("__type") != F.col("deviation_type"), off).cast("int")
        out = low.withColumns({"type_fixes": fixes, "severity": F.when(F.col("severity").isNotNull(), spelt_severity(F.col("__low"))), "deviation_type": F.col("__type")}).drop("__low", "__type")
        stripped_of |= {"severity": "severity", "deviation_type": "deviation_type"}
    else:
        out = out.withColumn("type_fixes", none)

    def empty(c: str) -> Column:
        return F.col(c).isNull() | (F.col(stripped_of[c]) == "")

    lacking = off
    for c in REQUIRED:
        lacking = lacking | empty(c)
    out = out.withColumn("is_missing", lacking if "missing" in steps else off)
    if "missing" in steps:
        filled = {c: F.when(empty(c), F.lit("Not specified")).otherwise(F.col(c)) for c in ("expected_behavior", "actual_behavior")}
        bare = {stripped_of[c]: F.when(empty(c), F.lit("Not specified")).otherwise(F.col(stripped_of[c])) for c in ("expected_behavior", "actual_behavior")}
        out = out.withColumns(filled | bare | {"notes": F.coalesce("notes", F.lit("")), "__notes": F.coalesce("__notes", F.lit(""))})
    if "text" in steps:
        even = F.transform(F.array(*[stripped_of[c] for c in TEXTS]), inner_spaced)  # one function for all: written out for each, the code is slower than this
        out = out.withColumn("__even", even).withColumns({stripped_of[c]: F.get("__even", F.lit(i)) for i, c in enumerate(TEXTS)}).drop("__even")
        changed = sum((F.coalesce(F.col(stripped_of[c]) != F.col(c), off).cast("int") for c in TEXTS), none)
        out = out.withColumn("text_fixes", changed).withColumns({c: F.col(stripped_of[c]) for c in TEXTS})
    else:
        out = out.withColumn("text_fixes", none)
    ids = F.when(empty("case_id"), "Missing case_id").when(empty("officer_id"), "Missing officer_id")
    out = out.withColumn("validation_error", ids.when(F.coalesce(F.length("description"), none) < 10, "Description too short"))
    return out.drop(*[c for c in stripped_of.values() if c.startswith("__")])


def _valid() -> Column:
    return ~F.col("is_missing") & F.col("validation_error").isNull()


def _fresh(devs: DataFrame, order_col: str, steps: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Columns of the checked rows that are no duplicates: rows are checked before they are dealt, so that only these columns and the key travel."""
    if "duplicates" not in steps:
        return checked(devs, steps).select(columns)
    names = [f"__of{i}" for i in range(len(duplicate_key()))]
    rows = checked(devs.withColumns(dict(zip(names, duplicate_key(), strict=True)) | {"__order": F.col(order_col)}), steps).select(*columns, *names, "__order")
    return without_duplicates(rows, "__order", [F.col(c) for c in names]).select(columns)


def cleaned(devs: DataFrame, order_col: str = "deviation_id", steps: tuple[str, ...] = STEPS) -> DataFrame:
    """The rows of devs that pass every step, cleaned, with the columns of devs."""
    return _fresh(devs, order_col, steps, [*devs.columns, "is_missing", "validation_error"]).where(_valid()).select(*devs.columns)


def rejected(devs: DataFrame, order_col: str = "deviation_id", steps: tuple[str, ...] = STEPS) -> DataFrame:
    """The other rows, with the reason of the first step that rejects each."""
    reason = F.when(F.col("is_duplicate"), "Duplicate").when(F.col("is_missing"), "Missing required value").otherwise(F.col("validation_error"))
    return flagged(devs, order_col, steps).withColumn("reject_reason", reason).where("reject_reason is not null").select(*devs.columns, "reject_reason")


def report(devs: DataFrame, order_col: str = "deviation_id", steps: tuple[str, ...] = STEPS) -> DataFrame:
    """One row: rows before, what each step did, rows after, and the share kept. A step counts what the ones before it left."""
    row, filled = _fresh(devs, order_col, steps, ["type_fixes", "is_missing", "text_fixes", "validation_error"]), ~F.col("is_missing")
    of_fresh = row.agg(
        F.count(F.lit(1)).alias("fresh"), F.coalesce(F.sum("type_fixes"), F.lit(0)).cast("long").alias("type_fixes"), F.count_if("is_missing").alias("missing_handled"),
        F.coalesce(F.sum(F.when(filled, F.col("text_fixes"))), F.lit(0)).cast("long").alias("text_fields_normalized"),
        F.count_if(filled & F.col("validation_error").isNotNull()).alias("validation_errors"), F.count_if(_valid()).alias("final_count"),
    )
    counts = devs.agg(F.count(F.lit(1)).alias("original_count")).crossJoin(of_fresh).withColumn("duplicates_removed", F.col("original_count") - F.col("fresh")).select(*COUNTS)
    share = F.when(F.col("original_count") > 0, F.round(100.0 * F.col("final_count") / F.col("original_count"), 2)).otherwise(0.0)
    return counts.withColumn("retained_pct", share)


def graded(reports: DataFrame) -> DataFrame:
    """reports with quality_score and grade; N/A for an empty table."""
    troubles = F.col("duplicates_removed") + F.col("type_fixes") + F.col("missing_handled")
    score = F.when(F.col("original_count") > 0, F.round(F.greatest(F.lit(0.0), 100 - 100.0 * troubles / F.col("original_count")), 2)).otherwise(0.0)
    grade = F.when(F.col("original_count") == 0, "N/A")
    for least, name in vocab.QUALITY_GRADES[:-1]:
        grade = grade.when(F.col("quality_score") >= least, name)
    return reports.withColumn("quality_score", score).withColumn("grade", grade.otherwise(vocab.QUALITY_GRADES[-1][1]))
