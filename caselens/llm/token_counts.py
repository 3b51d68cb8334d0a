"""Token counts without token ids.

Texts are cut into pre-tokens; a block of texts gives each pre-token once, with the texts it stands in and
how often. Those frequency rows are partitioned by a hash of the pre-token, so that all rows of a pre-token
meet: it is tokenised once, and its count times each text's frequency is summed by text. A pre-token that
stands in every text has one entry a block, hence no hot key.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from caselens.llm.common import read_table, slices

LONGS, INTS, SHORTS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int16())
#: Distinct pre-tokens whose counts a task remembers; beyond it the memory starts afresh and some are counted again.
REMEMBERED = 2_000_000
#: UTF-8 bytes of the texts of a block, unless one text alone has more.
BLOCK_BYTES = 16 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Assigned:
    """Whether Python's Unicode tables have all characters of a text; the library's may be newer and class the others otherwise."""

    def __init__(self) -> None:
        self.known: set[str] = set()

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - self.known
        good = {c for c in new if unicodedata.category(c) != "Cn"}
        self.known |= good
        return len(good) == len(new)


def splitter(path: str, pattern: str):
    """Function from a text to its pre-tokens; added tokens inside the text are pre-tokens of their own.

    Texts with unassigned characters are split by the library itself, all others by the pattern.
    """
    find, tok, assigned = regex.compile(pattern).findall, tokenizer(path), Assigned()
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(text: str) -> list[str]:
        if assigned(text):
            return find(text)
        return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return plain(text)
        return [x for i, part in enumerate(special.split(text)) for x in ([part] if i % 2 else plain(part))]

    return split


def frequencies(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, parts: int) -> DataFrame:
    """A row for each block of texts and part of the pre-tokens, and one with the ids and sizes of the block.

    In (block, part): pieces, the number of texts of each, and for each of those its place in the block and frequency.
    """
    ids = docs.schema[id_col].dataType
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.StringType())),
        T.StructField("texts", ints), T.StructField("places", T.ArrayType(T.ShortType())), T.StructField("times", ints),
        T.StructField("ids", T.ArrayType(ids)), T.StructField("bytes", longs),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path, pattern)
        for whole in batches:
            for b in slices(whole, 2, 1 << 15, BLOCK_BYTES):
                block = b.column(0)[0].as_py()
                number: dict[str, int] = {}
                piece_of, place_of, times_of, sizes = [], [], [], []
                for place, value in enumerate(b.column(2)):
                    text = value.as_py() or ""
                    sizes.append(len(text.encode("utf-8", "replace")))
                    counted = Counter(split(text))
                    piece_of += [number.setdefault(x, len(number)) for x in counted]
                    times_of += counted.values()
                    place_of.append(len(counted))
                id_list = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, INTS), pa.nulls(1, SHORTS),
                     pa.nulls(1, INTS), id_list, pa.array([sizes], LONGS)], names=schema.names)
                if not number:
                    continue
                pieces = list(number)
                part = np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) % parts for x in pieces), np.int32, len(pieces))
                piece, times = np.array(piece_of, np.int64), np.array(times_of, np.int32)
                place = np.repeat(np.arange(b.num_rows, dtype=np.int16), place_of)
                by_part = np.argsort(part, kind="stable")
                rank = np.empty_like(by_part)
                rank[by_part] = np.arange(len(by_part))
                order = np.argsort(rank[piece], kind="stable")
                places, times = place[order], times[order]
                texts = np.bincount(piece, minlength=len(pieces))[by_part].astype(np.int32)
                first = np.searchsorted(part[by_part], np.arange(parts + 1))
                held = np.concatenate([[0], np.cumsum(texts)])
                names = pa.array([pieces[i] for i in by_part], pa.string())
                some = np.flatnonzero(np.diff(first))
                ends = np.concatenate([first[some], first[-1:]]).astype(np.int32)
                entries = held[ends].astype(np.int32)
                lists = lambda off, values: pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), lists(ends, names), lists(ends, pa.array(texts)), lists(entries, pa.array(places)),
                     lists(entries, pa.array(times)), pa.nulls(len(some), id_list.type), pa.nulls(len(some), LONGS)], names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(cut, schema)


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row: UTF-8 bytes and tokens of its whole text, as the library gives them.

    A null or empty text has 0 of both. Rows are counted one by one, also repeated ones and ones without an id.
    Added special tokens inside a text are what the library makes of them: one token. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = frequencies(docs, id_col, text_col, tokenizer_file, pattern, parts)
    kind = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("place", T.ArrayType(T.ShortType())), T.StructField("id", cut.schema["ids"].dataType),
        T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.IntegerType())),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_file)
        known: dict[str, int] = {}
        none, no_counts = pa.array([[]], LONGS), pa.array([[]], INTS)
        for b in batches:
            for i in range(b.num_rows):
                block, pieces = b.column("block").slice(i, 1), b.column("pieces")[i].as_py()
                if pieces is None:
                    place = pa.array([np.arange(len(b.column("ids")[i]), dtype=np.int16)], SHORTS)
                    yield pa.RecordBatch.from_arrays([block, place, b.column("ids").slice(i, 1), b.column("bytes").slice(i, 1), no_counts], names=kind.names)
                    continue
                new = [x for x in pieces if x not in known]
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = pieces
                known.update(zip(new, (len(e.ids) for e in tok.encode_batch(new, add_special_tokens=False)), strict=True))
                each = np.repeat(np.array([known[x] for x in pieces], np.int64), b.column("texts")[i].values.to_numpy())
                total = np.bincount(b.column("places")[i].values.to_numpy(), each * b.column("times")[i].values.to_numpy())
                some = np.flatnonzero(total)
                no_ids = pa.array([[]], b.column("ids").type)
                yield pa.RecordBatch.from_arrays([block, pa.array([some.astype(np.int16)], SHORTS), no_ids, none, pa.array([total[some].astype(np.int32)], INTS)], names=kind.names)

    at = F.when(F.col("part") < 0, F.pmod(F.col("block"), F.lit(parts))).otherwise(F.col("part")).cast("int")
    counted = cut.repartitionById(parts, at).mapInArrow(count, kind)
    result = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own = rows.filter(pc.greater(pc.list_value_length(rows.column("n_bytes")), 0))
        ids, sizes = own.column("id").combine_chunks().flatten(), own.column("n_bytes").combine_chunks().flatten()
        some = rows.filter(pc.greater(pc.list_value_length(rows.column("n_tokens")), 0))
        places, tokens = (some.column(c).combine_chunks().flatten().to_numpy() for c in ("place", "n_tokens"))
        sums = np.bincount(places, tokens, len(ids)).astype(np.int64)
        return pa.Table.from_arrays([ids, sizes, pa.array(sums)], names=result.names)

    return counted.groupBy("block").applyInArrow(total, result)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
