"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each text is encoded where it lies: no shuffle. Long texts are cut first, always between a letter, digit or ASCII
mark and a blank or line end: no match of the splitting pattern spans such a place, and none looks back
over it, so the pieces of the cuts are those of the whole text. That holds for `public_tokenizers.PATTERN`; under
any other pattern texts are encoded uncut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import read_table, slices

#: Characters from which on a text is cut before it is encoded.
CUT_CHARS = 1 << 16
SAFE = regex.compile(r"(?<=[\p{L}\p{N}!-~])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_cuts(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """Parts of a text of about the given size, cut only where no match of the pattern can be split."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) > CUT_CHARS and enc._pat_str == public_tokenizers.PATTERN:
        return [i for part in safe_cuts(text) for i in enc.encode_ordinary(part)]
    return enc.encode_ordinary(text)


def with_ids(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", same_col: str | None = None, digest_cols: tuple[str, str] | None = None) -> DataFrame:
    """docs and the ids of each whole text, as array<int>; a null or empty text has none. All other columns are kept.

    same_col: name of a further column that tells whether the bytes decoded from the ids are those of the text (null: none).
    digest_cols: names of two columns with the sha256 of the ids, as little-endian unsigned 32-bit integers, and of the bytes decoded from them.
    Texts are encoded in parts of at most 1000 rows and 8 MB.
    """
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(same_col, T.BooleanType())] if same_col else [])
    added += [T.StructField(c, T.StringType()) for c in digest_cols or ()]
    kept = [f for f in docs.schema.fields if f.name not in [x.name for x in added]]
    schema = T.StructType(kept + added)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            for part in slices(b, text_col):
                texts = part.column(text_col).to_pylist()
                ids = [np.array(encode_text(enc, t), np.int32) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                back = [enc.decode_bytes(x.tolist()) for x in ids] if same_col or digest_cols else []
                if same_col:
                    out.append(pa.array([x == (t or "").encode() for x, t in zip(back, texts, strict=True)]))
                if digest_cols:
                    out.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]))
                    out.append(pa.array([hashlib.sha256(x).hexdigest() for x in back]))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *out], names=schema.names)

    columns = dict.fromkeys([*(f.name for f in kept), text_col])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(encode, schema)


def decoded(ids_col: str, rank_file: str, pattern: str):
    """Column of the bytes that the ids stand for; they are those of the text, whole characters or not."""

    @F.pandas_udf(T.BinaryType())
    def decode(ids: pd.Series) -> pd.Series:
        enc = encoding(rank_file, pattern)
        return ids.map(lambda x: None if x is None else enc.decode_bytes(x.tolist()))

    return decode(ids_col)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest_cols=("ids_sha256", "decoded_sha256"))
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")
