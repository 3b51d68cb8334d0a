"""Stupid-backoff language-model scores from n-gram count tables that are partitioned by hash.

Texts are taken in blocks as they lie. A block explodes its n-grams of an order and counts them, and sends each distinct
one once to the part of the count table that its hash belongs to; there the counts of all blocks are summed. Joined back to
the exploded n-grams, the counts give the score of every word, and scores are summed by document. A very frequent
n-gram is one row a block, never a hot key.

Orders 1 and 2 are looked up first. A longer n-gram is in the table only if the two that it is made of are, so only those
are exploded in the next round; nothing that the table holds is passed over. The n-grams of a block and part
stand in one row, as byte planes: a row for each n-gram would take three times the disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import blocks_for, read_table, slices, text_bytes


@dataclass(frozen=True)
class Params:
    """order: longest n-gram; alpha: factor of each step back; least: occurrences from which on an n-gram of two words or more is in the table.

    held_out: a text scored under the counts of its own corpus leaves its own n-grams out of them. block_bytes: text that is taken
    together, and part_bytes: text behind a part of the count table.
    """

    order: int = 3
    alpha: float = 0.4
    least: int = 1
    held_out: bool = False
    block_bytes: int = 6 << 20
    part_bytes: int = 4 << 20
    seed: int = 3

    def rounds(self) -> list[tuple[int, ...]]:
        """Orders that are looked up together; order 0 is the empty n-gram, whose count is the number of words."""
        return [tuple(range(min(2, self.order) + 1)), *((n,) for n in range(3, self.order + 1))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, lowest bytes first: the high ones are mostly zero and compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def numbers(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def word_hashes(text: str | None) -> np.ndarray:
    words = [] if text is None else text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Block:
    """Texts as numbers of their words: the hashes of distinct words, most frequent first, a number for each word, words of each text."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, sizes: np.ndarray, p: Params):
        self.hashes, self.sizes, self.p = vocabulary[words], sizes, p
        self.at = np.arange(len(words), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        self.counts: dict[int, np.ndarray] = {}  # for each order, how often the n-gram that ends at a word stands in the table
        self.weights = np.random.default_rng(p.seed).integers(1, 2**63, max(1, p.order), np.uint64) * np.uint64(2) + np.uint64(1)

    def counted(self, n: int) -> np.ndarray:
        """Zeros where nothing was looked up, as no text is long enough."""
        return self.counts.get(n, np.zeros(len(self.at), np.int32))

    def exploded(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct n-grams in order, how often each, places of the words that they end at, number of the n-gram at each place)."""
        if n == 0:
            return np.zeros(1, np.uint64), np.array([len(self.at)]), np.empty(0, np.int64), np.empty(0, np.int64)
        ok = self.at >= n - 1
        if n > 2:  # orders 1 and 2 are of the same round
            known = self.counted(n - 1) >= self.p.least
            ok[1:] &= known[1:] & known[:-1]
        places = np.flatnonzero(ok).astype(np.int32)
        total = np.full(len(places), n, np.uint64)
        for j in range(n):
            total += self.hashes[places - j] * self.weights[j]
        total = _mix(total)
        order = np.argsort(total)  # np.unique by hand: numbers of 32 bits take half the memory
        total = total[order]
        first = np.flatnonzero(np.concatenate([[True], total[1:] != total[:-1]])[: len(total)])
        times = np.diff(np.append(first, len(total)))
        which = np.empty(len(total), np.int32)
        which[order] = np.repeat(np.arange(len(first), dtype=np.int32), times)
        return total[first], times, places, which

    def joined(self, n: int, told: np.ndarray) -> None:
        """Take the table's counts of the n-grams that `exploded` has."""
        if n == 0:
            self.total = told[0] - np.repeat(self.sizes, self.sizes) if self.p.held_out else np.full(len(self.at), told[0])
            return
        _, _, places, which = self.exploded(n)
        found = told[which]
        if self.p.held_out:
            text = np.repeat(np.arange(len(self.sizes)), self.sizes)[places]
            _, pair, own = np.unique(text * np.int64(max(1, len(told))) + which, return_inverse=True, return_counts=True)
            found = found - own[pair]
        self.counts[n] = np.zeros(len(self.at), np.int64 if told.max(initial=0) > 2**31 - 1 else np.int32)
        self.counts[n][places] = found

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of every word's score, and whether it steps back; a word never counted has half an occurrence."""
        once = self.counted(1)
        score, back = np.log(np.where(once > 0, once, 0.5) / np.maximum(1, self.total)), np.zeros(len(once), bool)
        for n in range(2, self.p.order + 1):
            exists, own = self.at >= n - 1, self.counted(n)
            seen = exists & (own >= max(1, self.p.least))
            before = np.concatenate([[0], self.counted(n - 1)[:-1]])[: len(own)]
            ratio = np.log(np.where(seen, own, 1) / np.where(seen, np.maximum(before, 1), 1))
            score = np.where(seen, ratio, np.where(exists, np.log(self.p.alpha) + score, score))
            back = np.where(exists, ~seen, back)
        return score, back


def blocks(docs: DataFrame, id_col: str, text_col: str, p: Params, asks: bool, counts: bool) -> DataFrame:
    """A row for each block of texts: ids, words of each text, its vocabulary, and the number of every word (low and high bytes)."""
    b = T.BinaryType()
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("counts", T.BooleanType()), T.StructField("asks", T.BooleanType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("sizes", b), T.StructField("vocabulary", b), T.StructField("low", b), T.StructField("high", b),
    ])

    def whole(block: int, ids: list[pa.Array], hashes: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        words, which, times = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        number, ids = rank[which], pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([2 * block + (not asks)], pa.int64()), pa.array([counts]), pa.array([asks]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([np.array([len(x) for x in hashes], np.int32).tobytes()]), pa.array([words[order].tobytes()]), pa.array([number.astype(np.uint16).tobytes()]), pa.array([(number >> 16).astype(np.uint8).tobytes()])],
            names=schema.names)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, hashes, size = 0, [], [], 0
        for batch in batches:
            for part in slices(batch, 2, rows=10_000, size=p.block_bytes):
                block = block if ids else part.column(0)[0].as_py()
                ids.append(part.column(1))
                hashes += [word_hashes(t.as_py()) for t in part.column(2)]
                size += part.column(2).nbytes
                if size >= p.block_bytes:
                    yield whole(block, ids, hashes)
                    ids, hashes, size = [], [], 0
                    pa.default_memory_pool().release_unused()
        if ids:
            yield whole(block, ids, hashes)

    rows = docs.select(F.monotonically_increasing_id(), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(take, schema)


def _block(row: pa.Table, told: pa.Table, p: Params) -> Block:
    """The block of a row, with the counts (n, part, counts) that are known so far."""
    sizes, vocabulary, low, high = (np.frombuffer(row.column(c)[0].as_py(), kind) for c, kind in (("sizes", np.int32), ("vocabulary", np.uint64), ("low", np.uint16), ("high", np.uint8)))
    block = Block(vocabulary, low.astype(np.int32) + (high.astype(np.int32) << 16), sizes.astype(np.int64), p)
    order, part = told.column("n").to_numpy(), told.column("part").to_numpy()
    for n in np.unique(order):
        rows = np.flatnonzero(order == n)
        block.joined(int(n), np.concatenate([numbers(told.column("counts")[i].as_py(), np.int64) for i in rows[np.argsort(part[rows])].tolist()]))
    return block


ASKED = "block long, counts boolean, n int, part int, grams binary, times binary"
TOLD = "block long, n int, part int, counts binary"


def _exploded(row: pa.Table, told: pa.Table, p: Params, parts: int, nth: int) -> pa.Table:
    """The n-grams of a block that the nth round looks up, with their counts in the block; a row for each order and part of the count table."""
    block, out = _block(row, told, p), []
    for n in p.rounds()[nth]:
        keys, times, _, _ = block.exploded(n)
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # in the order of the keys
        first = np.flatnonzero(np.diff(part, prepend=np.uint64(2**63)))
        for x, y in zip(first, [*first[1:], len(keys)], strict=False):
            out.append((n, int(part[x]), planes(np.diff(keys[x:y], prepend=np.uint64(0))), planes(times[x:y].astype(np.uint32))))
    del block
    pa.default_memory_pool().release_unused()
    size = len(out)
    ns, ps, grams, counts = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table({
        "block": pa.array([row.column("block")[0].as_py()] * size, pa.int64()), "counts": pa.array([row.column("counts")[0].as_py()] * size, pa.bool_()), "n": pa.array(ns, pa.int32()),
        "part": pa.array(ps, pa.int32()), "grams": pa.array(grams, pa.binary()), "times": pa.array(counts, pa.binary()),
    })


def _summed(rows: pa.Table) -> pa.Table:
    """A part of the count table: the sums of all blocks, given back to each for the n-grams that it has."""
    grams = [np.cumsum(numbers(x.as_py(), np.uint64)) for x in rows.column("grams")]
    times = [numbers(x.as_py(), np.uint32) * np.int64(y.as_py()) for x, y in zip(rows.column("times"), rows.column("counts"), strict=True)]
    _, which = np.unique(np.concatenate(grams), return_inverse=True)
    sums = np.bincount(which, np.concatenate(times)).astype(np.int64)[which]
    back = np.split(sums, np.cumsum([len(x) for x in grams])[:-1])
    pa.default_memory_pool().release_unused()
    return pa.table({"block": rows.column("block"), "n": rows.column("n"), "part": rows.column("part"), "counts": pa.array([planes(x) for x in back], pa.binary())})


def _sums(row: pa.Table, told: pa.Table, p: Params, names: list[str]) -> pa.Table:
    """What `scored` gives of the texts of a block."""
    if not row.column("asks")[0].as_py():
        return pa.table([row.column("ids").combine_chunks().slice(0, 0).flatten(), *(pa.array([], x) for x in (pa.int64(), pa.int64(), pa.float64()))], names=names)
    block = _block(row, told, p)
    each, back = block.scores()
    text = np.repeat(np.arange(len(block.sizes)), block.sizes)
    sums, stepped = (np.bincount(text, x, len(block.sizes)) for x in (each, back))
    return pa.table([row.column("ids").combine_chunks().flatten(), pa.array(block.sizes), pa.array(stepped.astype(np.int64)), pa.array(sums.astype(float))], names=names)


def scored(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id_col, n_words, n_back, log_score) of every row of docs, under the n-gram counts of corpus (docs itself if none is given).

    Words are split at ASCII white space and lower-cased (A-Z). log_score is the sum over words of ln S, n_back the number of words that
    step back at least once; the first words of a text, having too few before them, take the longest order they have. N-grams
    of two words or more that were counted less often than `least` count as unseen. Null, empty and blank texts have no words and
    score 0. Rows are scored one by one, also repeated ones and ones without an id; other columns are ignored. Both tables must
    keep the order of their rows when they are read again, as written ones do: blocks follow it.
    """
    p = p if corpus is None else replace(p, held_out=False)
    parts = blocks_for(text_bytes(corpus if corpus is not None else docs, text_col)[1], p.part_bytes)
    whole = blocks(docs, id_col, text_col, p, asks=True, counts=corpus is None)
    if corpus is not None:
        other = corpus.select(F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), F.col(f"`{text_col}`").alias(text_col))
        whole = whole.union(blocks(other, id_col, text_col, p, asks=False, counts=True))
    names = [id_col, "n_words", "n_back", "log_score"]
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_back", T.LongType()), T.StructField("log_score", T.DoubleType())])

    def explode(nth: int):
        def of_block(row: pa.Table, told: pa.Table) -> pa.Table:
            return _exploded(row, told, p, parts, nth)

        return of_block

    def first(row: pa.Table) -> pa.Table:
        return _exploded(row, pa.table({c: pa.array([], pa.int32()) for c in ("n", "part", "counts")}), p, parts, 0)

    def score(row: pa.Table, told: pa.Table) -> pa.Table:
        return _sums(row, told, p, names)

    whole, told = whole.repartition("block"), None
    for r in range(len(p.rounds())):
        grams = whole.groupBy("block").applyInArrow(first, ASKED) if told is None else whole.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(explode(r), ASKED)
        counted = grams.groupBy("part").applyInArrow(_summed, TOLD).repartition("block")
        told = counted if told is None else told.union(counted)
    return whole.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, kind)


def _rounded(found: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return found.select("doc_id", "n_words", "n_back", F.round("log_score", 6).alias("log_score"), mean.alias("mean_log_score"))


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Order 3, every document under all n-grams of all others."""
    return _rounded(scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"), p=Params(least=1, held_out=True)))


def op10_lm_score_backoff(spark, sf_dir: str) -> DataFrame:
    """The scores alone."""
    return op10_lm_score(spark, sf_dir).drop("n_back")


def op10_lm_score_cutoff(spark, sf_dir: str) -> DataFrame:
    """Order 3 under the n-grams that all documents, the scored one included, hold twice or more."""
    return _rounded(scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"), p=Params(least=2)))


OP10_CUTOFF_SQL = r"""
with doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), tok as (
  select doc_id, i, w[i] as c, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as a
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from doc)
), counted as (
  select *, count(*) over () as total, count(*) over (partition by c) as n1,
    case when b is not null then count(*) over (partition by b, c) end as n2,
    case when a is not null then count(*) over (partition by a, b, c) end as n3
  from tok
), before as (
  select *, lag(n1) over (partition by doc_id order by i) as v1, lag(n2) over (partition by doc_id order by i) as v2 from counted
), s as (
  select doc_id, i > 1 and not coalesce(case when a is not null then n3 else n2 end >= 2, false) as back,
    case when n3 >= 2 then ln(n3 / v2)
    when n2 >= 2 then ln(n2 / v1) + case when a is not null then ln(0.4) else 0 end
    else ln(n1 / total) + least(i - 1, 2) * ln(0.4) end as s from before
), sums as (select doc_id, count(*) as n, count(*) filter (back) as n_back, sum(s) as s from s group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(n_back, 0)::bigint as n_back, round(coalesce(s, 0), 6) as log_score, case when n > 0 then round(s / n, 6) end as mean_log_score
from doc d left join sums using (doc_id)
"""

OP10_SQL = r"""
with doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), tok as (
  select doc_id, i, w[i] as c, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as a
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from doc)
), others as (
  select *, count(*) over () - count(*) over (partition by doc_id) as total,
    count(*) over (partition by c) - count(*) over (partition by doc_id, c) as n1,
    case when b is not null then count(*) over (partition by b, c) - count(*) over (partition by doc_id, b, c) end as n2,
    case when a is not null then count(*) over (partition by a, b, c) - count(*) over (partition by doc_id, a, b, c) end as n3
  from tok
), before as (
  select *, lag(n1) over (partition by doc_id order by i) as v1, lag(n2) over (partition by doc_id order by i) as v2 from others
), s as (
  select doc_id, i > 1 and not coalesce(case when a is not null then n3 else n2 end > 0, false) as back,
    case when n3 > 0 then ln(n3 / v2)
    when n2 > 0 then ln(n2 / v1) + case when a is not null then ln(0.4) else 0 end
    else ln(case when n1 > 0 then n1 else 0.5 end / greatest(total, 1)) + least(i - 1, 2) * ln(0.4) end as s from before
), sums as (select doc_id, count(*) as n, count(*) filter (back) as n_back, sum(s) as s from s group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(n_back, 0)::bigint as n_back, round(coalesce(s, 0), 6) as log_score, case when n > 0 then round(s / n, 6) end as mean_log_score
from doc d left join sums using (doc_id)
"""
OP10_BACKOFF_SQL = f"select * exclude (n_back) from ({OP10_SQL})"
