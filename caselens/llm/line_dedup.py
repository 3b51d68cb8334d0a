"""Removal of repeated runs of lines by winnowing over line hashes. DataFrame functions only.

A gram is the shortest row of consecutive non-blank lines with at least `noise` words; a window is all grams
that start within `guarantee - noise` words of a line. Every window's smallest gram hash is a fingerprint.
A run of at least `guarantee` words that stands in two places holds a whole window in both, hence a common
fingerprint; a match of less than `noise` words is never found. Every fingerprint is joined to its earliest
place only, so that a passage in very many documents makes one row for each, and the match is extended in
both directions as far as the lines agree. The lines of the later run go.

The earliest place may agree less far than another earlier one. Hence around every repeated fingerprint the
shortest runs of at least `guarantee` words that start or end at a line are looked up too, each by its own hash
and earliest place. They cover every line of every run of that length, and all but the earliest of each go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.llm.common import read_table, stage


@dataclass(frozen=True)
class Params:
    """Words that a match has at least (noise), and words from which on a repeated run is always found."""

    noise: int = 20
    guarantee: int = 40


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(id_col: str, text_col: str) -> Column:
    """What tells documents apart, and their order: the id, then the text."""
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))


def line_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, at, hashes, words) of every document: numbers, hashes and word counts of its non-blank lines."""
    norm = F.transform(_lines(F.col(f"`{text_col}`")), lambda x: F.btrim(F.lower(x), F.lit(" \t\r\f\v")))
    filled = F.filter(F.transform(F.col("norm"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"] != "")
    tables = (
        docs.where(F.col(f"`{text_col}`").isNotNull())
        .select(_key(id_col, text_col).alias("key"), norm.alias("norm"))
        .select("key", filled.alias("filled"))
        .where(F.size("filled") > 0)
        .select(
            "key", F.transform("filled", lambda x: x["at"]).alias("at"), F.transform("filled", lambda x: F.xxhash64(x["line"])).alias("hashes"),
            F.transform("filled", lambda x: F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(" "), F.lit(""))) + 1).alias("words"),
        )
    )
    return tables.dropDuplicates(["key"])


def fingerprints(tables: DataFrame, p: Params) -> DataFrame:
    """(key, pos, gram): the window minima of every document; pos counts its non-blank lines from 0."""
    lines = tables.select("key", F.posexplode(F.arrays_zip("hashes", "words")).alias("pos", "line")).select("key", "pos", "line.*")
    doc = Window.partitionBy("key")
    before = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.select("key", "pos", "hashes", (F.sum("words").over(before) - F.col("words")).alias("start"), F.sum("words").over(doc).alias("total"))
    by_words = doc.orderBy("start")
    gram = F.xxhash64(F.collect_list("hashes").over(by_words.rangeBetween(0, p.noise - 1)))
    grams = placed.select("key", "pos", "start", F.when(F.col("start") + p.noise <= F.col("total"), F.struct(gram.alias("gram"), "pos")).alias("own"))
    least = F.min("own").over(by_words.rangeBetween(0, p.guarantee - p.noise))
    return grams.select("key", least.alias("least")).where("least is not null").select("key", "least.*").distinct()


def long_runs(tables: DataFrame, prints: DataFrame, p: Params) -> DataFrame:
    """(key, gone): numbers of the lines of each shortest run of `guarantee` words or more that stands in an earlier place too.

    tables are documents, and prints (key, pos) their repeated fingerprints; a run that stands in two places holds one.
    """
    anchors = prints.groupBy("key").agg(F.collect_set("pos").alias("anchors"))
    lines = tables.join(anchors, "key").select("key", "anchors", F.posexplode(F.arrays_zip("at", "hashes", "words")).alias("pos", "line"))
    lines = lines.select("key", "pos", "line.*", F.when(F.array_contains("anchors", F.col("pos")), F.col("pos")).alias("anchor"))
    doc = Window.partitionBy("key")
    upto, onward = (doc.orderBy("pos").rowsBetween(*x) for x in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    placed = lines.withColumns({
        "end": F.sum("words").over(upto), "total": F.sum("words").over(doc), "last": F.max("anchor").over(upto), "next": F.min("anchor").over(onward),
    }).withColumn("start", F.col("end") - F.col("words"))
    ahead = doc.orderBy("start").rangeBetween(0, p.guarantee - 1)
    behind = doc.orderBy("end").rangeBetween(1 - p.guarantee, 0)

    def unit(enough: Column, over, low: Column, high: Column) -> Column:
        hashes, at = (F.collect_list(c).over(over) for c in ("hashes", "at"))
        return F.when(enough, F.struct(F.xxhash64(hashes).alias("unit"), low.alias("pos"), high.alias("high"), at.alias("at")))

    size = F.count(F.lit(1))
    units = placed.select(
        "key", "last", "next",
        unit(F.col("start") + p.guarantee <= F.col("total"), ahead, F.col("pos"), F.col("pos") + size.over(ahead) - 1).alias("ahead"),
        unit(F.col("end") >= p.guarantee, behind, F.col("pos") - size.over(behind) + 1, F.col("pos")).alias("behind"),
    )
    held = F.array(F.when(F.col("next") <= F.col("ahead.high"), F.col("ahead")), F.when(F.col("last") >= F.col("behind.pos"), F.col("behind")))
    units = units.select("key", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("u")).select("key", "u.unit", F.col("u.pos").cast("int").alias("pos"), "u.at")
    first = units.groupBy("unit").agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("unit", "first")
    first = stage(first, "runs")  # a plain side of the join, so that Spark can split a run that stands in very many documents
    return units.join(first, "unit").where(F.struct("key", "pos") != F.col("first")).select("key", F.col("at").alias("gone"))


def later_runs(tables: DataFrame, p: Params) -> DataFrame:
    """(key, gone): numbers of the lines of each document that repeat an earlier run."""
    prints = stage(fingerprints(tables, p), "fingerprints")
    first = prints.groupBy("gram").agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "first")
    first = stage(first, "grams")
    repeated = prints.join(first, "gram")
    hits = (
        repeated.where(F.struct("key", "pos") != F.col("first"))
        .groupBy("key", F.col("first.key").alias("key0"), (F.col("pos") - F.col("first.pos")).alias("shift"))
        .agg(F.sort_array(F.collect_set("pos")).alias("anchors"))
    )
    early = tables.select(F.col("key").alias("key0"), F.col("hashes").alias("hashes0"))
    met = hits.join(early, "key0").join(tables, "key")
    agree = F.transform(F.col("hashes"), lambda x, i: x.eqNullSafe(F.get(F.col("hashes0"), i - F.col("shift"))))
    met = met.select("key", "anchors", "at", agree.alias("agree"))

    def run(pos: Column) -> Column:
        back = F.array_position(F.reverse(F.slice("agree", F.lit(1), pos + 1)), False).cast("int")
        on = F.array_position(F.slice("agree", pos + 1, F.size("agree") - pos), False).cast("int")
        low = F.when(back == 0, F.lit(0)).otherwise(pos - back + 2)
        high = F.when(on == 0, F.size("agree") - 1).otherwise(pos + on - 2)
        return F.slice("at", low + 1, high - low + 1)

    gone = met.select("key", F.array_distinct(F.flatten(F.array_distinct(F.transform("anchors", run)))).alias("gone"))
    gone = gone.unionByName(long_runs(tables, repeated.select("key", "pos"), p))
    return gone.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """docs with the later repeated runs of lines deleted from text_col, and n_lines, n_removed.

    Lines are compared lower-cased and trimmed; blank lines are passed over and stay. Documents are ordered by
    id, then text; what comes first stays whole, also within one document. A null text stays null and has
    no lines. Repeated rows (id and text alike) are one document: each gets the same text. Documents
    without an id come first among themselves by text. Other columns are kept; n_lines and n_removed replace
    columns of these names.
    """
    tables = stage(line_tables(docs, id_col, text_col), "lines")
    gone = later_runs(tables, p).join(tables.select("key", F.size("at").cast("long").alias("n")), "key", "right")
    text = F.col(f"`{text_col}`")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _key(id_col, text_col).alias("key"), text.alias("text"))
    met = rows.join(gone, "key", "left").withColumn("lines", F.when(F.col("gone").isNotNull(), _lines(F.col("text"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by hashes, whatever the number of lines
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return met.select(
        *[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in kept],
        F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_removed", "text")
