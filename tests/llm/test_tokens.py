import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from caselens.llm import bpe
from caselens.llm import token_counts as tc
from tests.conftest import SF
from tests.llm.common import odd_documents

JSON, PATTERN, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HARD = ["a <|endoftext|> b<|endoftext|>", "tabs\t\tand  blanks   ", "\x1c\x1d 12 345", "日本語 テキスト ½ ²", chr(0x558) + "a" + chr(0x2B73A) * 3, "it's we'll I'D", "\n\n\n x\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_library_s(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in tc.op4_token_counts(spark, SF).collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_counts_of_hard_texts(spark, library):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in tc.token_counts(df, JSON, PATTERN).collect()}
    assert found == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(HARD)}


def test_counts_of_odd_documents(spark, library):
    docs = odd_documents(spark)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or "").ids)) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(docs, JSON, PATTERN).collect()) == want
    assert tc.token_counts(docs.limit(0), JSON, PATTERN).count() == 0


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_ids_are_the_library_s(spark, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op5_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest(ids))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_documents_round_trip(spark, reference):
    docs = odd_documents(spark)
    coded = bpe.with_ids(docs, RANKS, PATTERN)
    rows = coded.withColumn("back", bpe.decoded("token_ids", RANKS, PATTERN)).collect()
    assert len(rows) == 15 and set(docs.columns) <= set(coded.columns)
    for r in rows:
        assert bytes(r["back"]).decode() == (r["text"] or "") and r["token_ids"] == reference.encode_ordinary(r["text"] or "")
    assert bpe.with_ids(docs.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("text", [*HARD, " ".join(HARD) * 40, "word " * 500, "x" * 3000, "a  b   c\n\nd " * 100])
def test_cuts_change_nothing(reference, text):
    parts = list(bpe.safe_cuts(text, 37))
    assert "".join(parts) == text and [i for p in parts for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    rows = [(i, f"some words of text {i} " * (1 + 400 * (i % 3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {tuple(r) for r in tc.token_counts(docs, JSON, PATTERN).collect()}
    monkeypatch.setattr(tc, "BLOCK_BYTES", 20_000)
    assert {tuple(r) for r in tc.token_counts(docs, JSON, PATTERN).collect()} == whole
    assert tc.frequencies(docs, "doc_id", "text", JSON, PATTERN, 1).where("part = -1").count() > 10
