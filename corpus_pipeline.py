"""The document pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of documents; the last one
adds the token ids. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import bpe, decontaminate, language, line_dedup, near_dedup
from caselens.llm.common import read_table, stage

#: Probability below which the language of a document counts as not found.
LEAST_SCORE = 0.5
#: Near duplicates share 0.8 of their shingles; at that a pair shares none of 40 bands of 5 rows with a probability of 1.3e-7.
NEAR = near_dedup.Params(percent=80, bands=40, rows=5)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; ones without a letter, without text or too mixed go."""
    model = language.fit(docs.where(~language.held_out()))
    found = language.predicted(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand in an earlier one; those of which nothing is left go."""
    found = line_dedup.without_repeats(docs)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more), the one with the smallest id.

    An id goes if none of its rows is kept, so repeated rows, and rows without an id, stay or go together.
    """
    found = near_dedup.near_duplicates(docs, p=NEAR)
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item: ten words of it in a row, or all of an item that has fewer."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether the bytes decoded from them are the text."""
    import public_tokenizers

    coded = bpe.with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, same_col="round_trip")
    return coded.select(*docs.columns, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near-dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("BPE encoding", encode),
]

#: Line dedup selects by its own hashes, which SQL does not have; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
