"""Periodic runs in texts: stretches of words that repeat with a period, found by seeds on diagonals and extended.

A run of length L and period q matches itself, q words on, over L - q words: at least max(least - q, q). Lags are taken in classes, [1, least) and
then [least / 2 * 2^m, least * 2^m), so the guaranteed overlap of a class is half its bound or more, and any such overlap holds a gram
of half of it that begins at a multiple of the gram's length. The grams of all places are indexed; each one at such a multiple is looked up
among the places of the same document that lie a lag of its class further on. There are two such pairs a word and class at most, whatever the text
repeats, so pairs are never capped.

Every pair is a seed on the diagonal of its lag. Seeds of a lag are extended in order, and the furthest place that has been covered in it is kept, so
seeds within it are passed over; so are seeds within a run whose period divides their lag, which would give that run again. Small
lags come first, so each run is found with its smallest period. The documents of a slice are searched side by side.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import crc32_sql, read_table, slices

#: Texts and bytes that are searched side by side.
SLICE_ROWS = 1000
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class Params:
    """A run has `least` words or more, a multiple of four, and two periods or more."""

    least: int = 12
    seed: int = 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(key: np.ndarray, at: np.ndarray, gram: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal keys: places at multiples of gram, partners from low to high - 1 further on. at: places with a whole gram, ascending."""
    order = np.argsort(key[at], kind="stable")
    place, keys = at[order], key[at][order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1
    place, group = place[many], group[many]
    n = np.int64(len(key) + high)
    index = group * n + place
    anchor = place % gram == 0
    wanted = index[anchor]
    start, end = np.searchsorted(index, wanted + low), np.searchsorted(index, np.minimum(wanted + high, (group[anchor] + 1) * n))
    times = end - start
    begin = np.repeat(place[anchor], times)
    partner = place[np.repeat(start - np.cumsum(times) + times, times) + np.arange(times.sum())]
    return begin, partner - begin


def _reach(words: np.ndarray, place: np.ndarray, lag: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """Words that match lag further on, from each place by step (1 or -1), up to limit of them. All go on together, by longer and longer pieces."""
    reach, live, piece = np.zeros(len(place), np.int64), np.arange(len(place)), 8
    while len(live):
        offset = reach[live, None] + np.arange(piece)
        inside = offset < limit[live, None]
        i = place[live, None] + np.where(inside, offset, 0) * step
        same = inside & (words[np.where(inside, i, 0)] == words[np.where(inside, i + lag[live, None], 0)])
        whole = same.all(axis=1)
        reach[live] += np.where(whole, piece, same.argmin(axis=1))
        live = live[whole]
        piece = min(piece * 2, max(8, (1 << 20) // max(1, len(live))))
    return reach


def runs(words: np.ndarray, doc: np.ndarray, p: Params = Params()) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, ordered. words: numbers of the words of documents one after the other; doc: their documents, ascending."""
    found: dict[int, dict[tuple[int, int], int]] = {}
    n = len(words)
    if not n:
        return {}
    sizes = np.bincount(doc)
    ends = np.cumsum(sizes)
    end, size = ends[doc], sizes[doc]
    odd = np.random.default_rng(p.seed).integers(1, 2**62, 4, np.uint64) * np.uint64(2) + np.uint64(1)
    gram, low, high = p.least // 4, 1, p.least
    covered, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # by runs so far: where the run ends that reaches furthest from a place, and its period
    key = words.astype(np.uint64) * odd[0] + doc.astype(np.uint64) * odd[1]
    at = np.arange(n)
    key = _mix(key)
    one = key
    for j in range(1, gram):
        at = at[at + j < end[at]]
        key[at] = _mix(key[at] * odd[2] + one[at + j] * odd[3]) if j > 1 else _mix(one[at] * odd[2] + one[at + j] * odd[3])
    while True:
        at = at[(at + gram <= end[at]) & (size[at] >= max(p.least, 2 * low))]
        if not len(at):
            break
        place, lag = _seeds(key, at, gram, low, high)
        new = ~((covered[place] >= place + lag + gram) & (lag % period[place] == 0))
        place, lag = place[new], lag[new]
        line = doc[place] * np.int64(n + 1) + lag
        order = np.lexsort((place, line))
        place, lag, line = place[order], lag[order], line[order]
        while len(place):
            head = np.concatenate(([True], line[1:] != line[:-1]))
            i, d = place[head], lag[head]
            right = _reach(words, i, d, end[i] - i - d, 1)
            left = _reach(words, i - 1, d, i - (ends - sizes)[doc[i]], -1)
            hold = (left + right >= d) & (left + right + d >= p.least) & (right >= gram)
            for s, length, q in zip((i - left)[hold].tolist(), (left + right + d)[hold].tolist(), d[hold].tolist(), strict=True):
                own = found.setdefault(int(doc[s]), {})
                own[(s, length)] = min(q, own.get((s, length), q))
                part = covered[s : s + length]
                period[s : s + length] = np.where(part < s + length, own[(s, length)], period[s : s + length])
                np.maximum(part, s + length, out=part)
            furthest = (i + np.maximum(right, gram))[np.cumsum(head) - 1]
            rest = ~head & (place + gram > furthest)
            place, lag, line = place[rest], lag[rest], line[rest]
        low, high = (p.least // 2, p.least) if low == 1 else (low, high)
        low, high = high, 2 * high
        step = low // 2 - gram  # a gram is two that overlap or follow one another
        at = at[at + low // 2 <= end[at]]
        longer = np.zeros(n, np.uint64)
        longer[at] = _mix(key[at] * odd[2] + key[at + step] * odd[3])
        key, gram = longer, low // 2
    first = ends - sizes
    return {k: sorted((s - int(first[k]), length, q) for (s, length), q in own.items()) for k, own in found.items()}


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        edge[s + q] += 1
        edge[s + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def planted(words: list, doc_id) -> list:
    """Of a tenth of the ids: the words with a periodic end, by which finding is held against what is known to be there."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % q] for i in range(a, n)]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    flat = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    return np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), plant: bool = False) -> DataFrame:
    """A row for each row of docs: id_col, runs (array of start, length, period; ordered), collapsed (the text without the later periods of its runs).

    Words are split at ASCII white space and joined by one space. A run is a stretch of p.least words and two periods or more that no neighbouring word
    continues; its period is its smallest. A null or blank text has no runs and an empty collapsed text. Ids may be null or repeat; other columns
    of docs are ignored. plant: texts of a tenth of the ids get a periodic end first. A slice is SLICE_BYTES of texts, or one longer text.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            for part in slices(batch, 1, SLICE_ROWS, SLICE_BYTES):
                texts = [(t or "").encode("utf-8", "replace").split() for t in part.column(1).to_pylist()]
                if plant:
                    texts = [planted(t, i) for t, i in zip(texts, part.column(0).to_pylist(), strict=True)]
                found = runs(*_numbered(texts), p)
                left = [b" ".join(collapsed(t, found.get(k, []))).decode() for k, t in enumerate(texts)]
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(k, [])] for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind), pa.array(left, pa.string())], names=schema.names)

    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text")).mapInArrow(search, schema)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    rows = periodic_runs(read_table(spark, sf_dir, "documents"), plant=True)
    best = F.element_at(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))), 1)
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Brute force: all pairs of equal six-word stretches of a document, joined to maximal stretches by their lag. Every run has six such words at least.
OP12_SQL = rf"""
with split as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w, coalesce({crc32_sql('doc_id::varchar')}, 1) as h from documents
), shaped as (
  select doc_id, w, h % 10 = 0 and len(w) > 0 as plant, case when len(w) > 0 then h // 10 % len(w) else 0 end as a, 3 + h // 10 % 8 as parts from split
), texts as (
  select row_number() over () as row, doc_id, case when plant then list_transform(range(0, len(w)), lambda i: w[case when i < a then i else a + (i - a) % (1 + (len(w) - a) // parts) end + 1]) else w end as w from shaped
), grams as (
  select row, unnest(range(0, len(w) - 5)) as i, unnest(list_transform(range(1, len(w) - 4), lambda i: w[i:i + 5])) as g from texts where len(w) >= 6
), pairs as (select a.row, a.i, b.i - a.i as lag from grams a join grams b on a.row = b.row and a.g = b.g and a.i < b.i),
islands as (select row, lag, i, i - row_number() over (partition by row, lag order by i) as island from pairs),
stretches as (select row, lag, min(i) as start, count(*) + 5 + lag as length from islands group by row, lag, island),
found as (select row, start, length, min(lag) as period from stretches where length >= 12 and length >= 2 * lag group by row, start, length),
best as (select row, count(*) as n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) as b, string_agg(concat_ws(',', start, length, period) || chr(10), '' order by start, period) as listed from found group by row),
gone as (select distinct row, unnest(range(start + period, start + length)) as i from found),
words as (select row, unnest(range(0, len(w))) as i, unnest(w) as word from texts),
left_over as (select w.row, string_agg(word, ' ' order by w.i) as t from words w left join gone g on g.row = w.row and g.i = w.i where g.i is null group by w.row)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.l::bigint as length, b.p::bigint as period, (1000 * b.l // b.p)::bigint as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(l.t, '')) as collapsed_sha256
from texts t left join best using (row) left join left_over l using (row)
"""
