"""Language identification: known words first, then shorter and shorter character n-grams.

Words of all learning texts are counted by language. A word that makes up at least `share` of some
language's words is known, so there are at most 1 / share known words a language whatever the size of the corpus,
and the model can be broadcast; the same holds for n-grams of each length, which are counted from the counted words.
A known word scores its log frequency in each language. Another word scores the mean log frequency of its
longest n-grams that are known, where shorter ones stand in only if it has none of a longer kind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import read_table, slices, stage

WORDS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
LETTER = regex.compile(r"\p{L}")
#: Texts, and bytes of them, that are counted or scored together in a task.
BATCH, BATCH_BYTES = 1000, 2 << 20


@dataclass(frozen=True)
class Params:
    """share: of a language's words or n-grams, from which one is known; grams: n-gram lengths, longest first."""

    share: float = 1e-5
    grams: tuple[int, ...] = (4, 3, 2, 1)
    unknown: str = "und"


def words(text: str | None) -> list[str]:
    """Lower-case words of letters and marks; marks without a letter are no words."""
    return [] if text is None else WORDS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language of the known words and, for each length, n-grams: numbers of the keys, and a row of `scores` for each."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    scores: np.ndarray

    def word_scores(self, found: list[str]) -> np.ndarray:
        """A row for each word: its own log frequencies if it is known, else the mean of its longest known n-grams, else zeros."""
        at = np.array([self.words.get(w, -1) for w in found], np.int64)
        out = np.where((at >= 0)[:, None], self.scores[at], 0.0) if len(self.scores) else np.zeros((len(found), len(self.langs)))
        left = np.flatnonzero(at < 0)
        for n, table in self.grams.items():
            if not len(left) or not table:
                continue
            parts = [[i for g in grams(found[w], n) if (i := table.get(g)) is not None] for w in left]
            sizes = np.array([len(x) for x in parts])
            some = sizes > 0
            if some.any():
                rows = self.scores[np.fromiter((i for x in parts for i in x), np.int64, sizes.sum())]
                starts = np.cumsum(sizes[some]) - sizes[some]
                out[left[some]] = np.add.reduceat(rows, starts, axis=0) / sizes[some][:, None]
            left = left[~some]
        return out


def _counted(rows: DataFrame, p: Params) -> list:
    """(key, lang, n, total) of the entries (kind, key, lang, n) with a large enough share; at most 1 / share for each kind and language."""
    totals = F.broadcast(rows.groupBy("kind", "lang").agg(F.sum("n").alias("total")))
    met = rows.join(totals, ["kind", "lang"])
    known = met.where(F.col("n") >= p.share * F.col("total")).select("kind", "key").distinct()
    return met.join(known, ["kind", "key"]).select("kind", "key", "lang", "n", "total").toPandas()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", p: Params = Params()) -> Model:
    """Learn from the texts and languages of docs; rows without either are passed over, other columns are not looked at."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1, BATCH, BATCH_BYTES)):
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                found.setdefault(lang.as_py(), Counter()).update(words(text.as_py()))
            for lang, counter in found.items():
                n = len(counter)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * n, pa.int32()), pa.array(counter.keys(), pa.string()), pa.array([lang] * n, pa.string()), pa.array(counter.values(), pa.int64())], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, str], Counter] = {}
            for key, lang, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for length in p.grams:
                    counter = found.setdefault((length, lang), Counter())
                    for g in grams(key, length):
                        counter[g] += n
            for (length, lang), counter in found.items():
                n = len(counter)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length] * n, pa.int32()), pa.array(counter.keys(), pa.string()), pa.array([lang] * n, pa.string()), pa.array(counter.values(), pa.int64())], names=names)

    names, kind = ["kind", "key", "lang", "n"], "kind int, key string, lang string, n long"
    source = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    totals = stage(source.mapInArrow(count, kind).groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")), "words")
    parts = stage(totals.select("key", "lang", "n").mapInArrow(cut, kind).groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")), "grams")
    found = pd.concat([_counted(totals, p), _counted(parts, p)])
    langs = sorted(found["lang"].unique())
    at = {x: i for i, x in enumerate(langs)}
    model, scores = Model(langs, {}, {n: {} for n in p.grams}, np.zeros((0, len(langs)))), []
    for kind_n, rows in found.groupby("kind"):
        size = rows.groupby("lang")["total"].max().reindex(langs)
        floor = np.log(0.5 / size.fillna(size.max()).to_numpy(float))
        table = model.grams[kind_n] if kind_n else model.words
        logs = np.log(rows["n"].to_numpy(float) / rows["total"].to_numpy(float))
        for key, lang, score in zip(rows["key"], rows["lang"], logs, strict=True):
            if key not in table:
                table[key] = len(scores)
                scores.append(floor.copy())
            scores[table[key]][at[lang]] = score
    model.scores = np.array(scores).reshape(len(scores), len(langs))
    return model


def predict_texts(model: Model, texts: list[str | None], p: Params = Params()) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities) of whole texts; `und`, 0 without a letter or a model. Distinct words are scored once."""
    number: dict[str, int] = {}
    word_of: list[int] = []
    times: list[int] = []
    text_of, lettered = [], []
    for text in texts:
        lettered.append(bool(model.langs) and text is not None and bool(LETTER.search(text)))
        counted = Counter(words(text)) if lettered[-1] else {}
        word_of += [number.setdefault(w, len(number)) for w in counted]
        times += counted.values()
        text_of.append(len(counted))
    if not any(lettered):
        return [p.unknown] * len(texts), np.zeros(len(texts))
    each = model.word_scores(list(number))[np.array(word_of, np.int64)] * np.array(times, float)[:, None]
    doc = np.repeat(np.arange(len(texts)), text_of)
    total = np.stack([np.bincount(doc, each[:, i], len(texts)) for i in range(len(model.langs))], axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    best = total.argmax(axis=1)
    score = np.where(lettered, odds[np.arange(len(texts)), best] / odds.sum(axis=1), 0.0)
    return [model.langs[i] if ok else p.unknown for i, ok in zip(best, lettered, strict=True)], score


def predicted(docs: DataFrame, model: Model, text_col: str = "text", p: Params = Params()) -> DataFrame:
    """docs with lang_pred and score, from the text alone.

    A null text, or one without any letter, is `und` with score 0, as is every text of a model learned from nothing. Equal
    scores go to the first language in order. Texts of letters never seen score 1 / languages. Other columns
    are kept; lang_pred and score replace columns of their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col, BATCH, BATCH_BYTES):
                langs, score = predict_texts(shared.value, b.column(text_col).to_pylist(), p)
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    columns = dict.fromkeys([*(f.name for f in kept), text_col])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row takes no part in learning; rows without an id don't."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(True))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
