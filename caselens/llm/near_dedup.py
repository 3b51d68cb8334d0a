"""MinHash near-duplicate detection with odd sketches.

Every text becomes a set of hashed word shingles, k MinHash samples of it, band keys over the samples, and
an odd sketch: a bitmap in which sample i toggles the bit that (i, sample) hashes to. The XOR of two odd
sketches has about as many bits set as the two sample sets differ in, so its population count estimates
high similarities precisely; it stands between the bands, which propose pairs, and the full sets, which
confirm them. Texts with the same set are one class from the start, so copies never form pairs.

Buckets can hold very many classes. They aren't expanded into all pairs: in each round every bucket names
its most connected classes as leaders (the ones whose buckets are fullest: the original of a family of
near copies shares a bucket with more of them than any copy), all others are held against the leaders,
confirmed links are contracted to components, and leaders leave the bucket, each having been held
against everything in another component. The first round looks at a quarter of the bands, which join most of a large family,
so that its members don't meet their original again in every other band; the next round looks at all bands and has more
leaders. A pair that shares several bands is held against each other in the first of them only. In the last one what is left meets in blocks within tasks, so no candidate is lost and none is capped, and only
confirmed links are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import connected_components, read_table, sized_broadcast, stage, unstage


@dataclass(frozen=True)
class Params:
    """shingle: words; a link needs 100 * shared >= percent * union; bands x rows MinHash samples; block: members in a task.

    At similarity 0.85 a pair shares none of 32 bands of 6 rows with a probability of 2.6e-7.
    """

    shingle: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 6
    sketch_bits: int = 512
    seed: int = 7
    leaders: tuple[tuple[int, float], ...] = ((1, 0.25), (16, 1.0))  # of a bucket, and the share of the bands that the round looks at
    block: int = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, p: Params) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; fewer words than a shingle make one."""
    words = [] if text is None else text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(p.shingle, len(h))
    weights = np.random.default_rng(p.seed).integers(1, 2**63, p.shingle, np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * weights[j]
    return np.unique(_mix(total))


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of a * x + b (mod 2^32) over the set, for each (a, b)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        part = x[at : at + 512, None] * a
        part += b
        np.minimum(low, part.min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    at = _mix(samples.astype(np.uint64) * np.uint64(len(samples)) + np.arange(len(samples), dtype=np.uint64)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing_bits(p: Params) -> int:
    """XOR population count that a linked pair exceeds with a probability below 1e-8 (six deviations twice)."""
    k, apart = p.bands * p.rows, 1 - p.percent / 100
    samples = 2 * min(k, k * apart + 6 * (k * apart * (1 - apart)) ** 0.5)
    mean = p.sketch_bits / 2 * (1 - (1 - 2 / p.sketch_bits) ** samples)
    return int(mean + 6 * (mean * (1 - mean / p.sketch_bits)) ** 0.5) + 1


def signatures(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(id, n_shingles, set_key, bands, sketch) of every row; the last three are null for an empty set."""
    ids = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", ids), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed + 1)
        k = p.bands * p.rows
        a = rng.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 2**32, k, np.uint32)
        mult = rng.integers(0, 2**63, (p.bands, p.rows), np.uint64) * np.uint64(2) + np.uint64(1)
        band = rng.integers(0, 2**63, p.bands, np.uint64)
        for batch in batches:
            n, keys, bands, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), p)
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                low = minhashes(s, a, b)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(_mix((low.reshape(mult.shape).astype(np.uint64) * mult).sum(axis=1) + band).view(np.int64))
                sketches.append(odd_sketch(low, p.sketch_bits))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, p: Params) -> DataFrame:
    """(set_key, items) of rows (id, text): the full sets that confirm links."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingle_set(t.as_py(), p) for t in batch.column(1)]
            keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in items], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.view(np.int64) for x in items], pa.list_(pa.int64()))], names=["set_key", "items"])

    return docs.mapInArrow(sets, T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))]))


def _near(p: Params) -> Column:
    """Whether the sizes and odd sketches of two sides (n, sketch and n2, sketch2) leave a link possible."""
    differing = reduce(lambda x, y: x + y, (F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(p.sketch_bits // 64)))
    return (100 * F.least("n", "n2") >= p.percent * F.greatest("n", "n2")) & (differing <= most_differing_bits(p))


def _propose(live: DataFrame, leaders: int, bands: int, p: Params) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to confirm in buckets (bucket, band, rep, comp, pop, n, sketch, seen) of the first bands; and what stays for later.

    seen are the keys of the bands before this one. A pair that has one in common has met there, or meets there later.
    """
    other = live.select("bucket", *(F.col(c).alias(f"{c}2") for c in ("rep", "comp", "n", "sketch", "seen")))
    pair = [F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")]
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("pop"), "rep"))
    first = live.where(F.col("band") < bands).withColumn("rank", rank).where(F.col("rank") <= leaders)
    pairs = first.join(other, "bucket").where((F.col("comp") != F.col("comp2")) & _near(p) & ~F.arrays_overlap("seen", "seen2")).select(*pair)
    return pairs.distinct(), live.join(first.select("bucket", "rep"), ["bucket", "rep"], "left_anti")


def _rest(live: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Confirmed links (a, b) among all that is left in the buckets, as forests: pairs that are connected by then aren't looked at.

    Buckets are cut into blocks of bounded size and every two blocks of a bucket meet in a task, with their sketches and
    full sets; only links leave it, one less than members at most.
    """
    cuts = live.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("cuts"))
    held = live.select("bucket", "rep", "comp", "n", "sketch").join(cuts, "bucket").join(sets.select("rep", "items"), "rep")
    own = F.pmod(F.xxhash64("rep"), "cuts").cast("int")
    held = held.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    held = held.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "rep", "comp", "n", "sketch", "items")
    most = most_differing_bits(p)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        comp, n = pd.factorize(pdf["comp"])[0], pdf["n"].to_numpy()
        bits, items, reps = np.stack(pdf["sketch"].to_numpy()).view(np.uint64), pdf["items"].to_numpy(), pdf["rep"].to_numpy()
        found = []
        for x in range(len(pdf) - 1):
            rest = np.flatnonzero(comp[x + 1 :] != comp[x]) + x + 1
            size = (100 * np.minimum(n[rest], n[x]) >= p.percent * np.maximum(n[rest], n[x])) & (np.bitwise_count(bits[rest] ^ bits[x]).sum(axis=1) <= most)
            for y in rest[size]:
                if comp[y] != comp[x]:
                    both = len(np.intersect1d(items[x], items[y], assume_unique=True))
                    if 100 * both >= p.percent * (n[x] + n[y] - both):
                        found.append((min(reps[x], reps[y]), max(reps[x], reps[y])))
                        comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(found, columns=["a", "b"]) if found else pd.DataFrame({"a": reps[:0], "b": reps[:0]})

    ids = live.schema["rep"].dataType
    return held.groupBy("bucket", "i", "j").applyInPandas(links, T.StructType([T.StructField("a", ids), T.StructField("b", ids)])).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and split at ASCII white space. component_id is the smallest id reachable over
    links; kept is true for that id's row. Null, empty and blank texts have no shingles and are linked with
    nothing; rows without an id get no component and are kept. All rows of an id are one document: where their texts differ, it is
    linked with whatever any of them is linked with, and n_shingles is each row's own. Other columns of docs are ignored, whatever their names.
    """
    signed = stage(signatures(docs, id_col, text_col, p), "signatures")
    full = signed.where("n_shingles > 0 and id is not null")
    classes = stage(
        full.groupBy("set_key").agg(F.min("id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
        .withColumn("rep", F.monotonically_increasing_id()),  # a number for each class, which the written table keeps
        "classes",
    )
    entries = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(entries.join(shared, "bucket"), "buckets")
    popular = members.groupBy("rep").agg(F.sum("size").alias("pop")).join(classes.select("rep", "n", "sketch", "bands"), "rep")
    waiting = stage(members.select("bucket", "band", "rep").join(popular, "rep").withColumn("seen", F.slice("bands", F.lit(1), F.col("band"))).drop("bands"), "members")
    unstage(members)
    reps = classes.join(waiting.select("rep").distinct(), "rep", "left_semi").select("id", "set_key", "rep", "n")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    full_sets = shingle_sets(texts.join(sized_broadcast(reps.select("id").distinct()), "id", "left_semi"), p).join(reps.select("set_key", "rep", "n"), "set_key")
    sets = stage(full_sets.select("rep", "n", "items").dropDuplicates(["rep"]), "sets")
    labels = None
    for leaders, share in (*p.leaders, (None, 1.0)):
        now = waiting if labels is None else waiting.join(labels, waiting.rep == labels.node, "left")
        now = now.select("bucket", "band", "rep", "pop", "n", "sketch", "seen", (F.col("rep") if labels is None else F.coalesce("comp", "rep")).alias("comp"))
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        live = stage(now.join(mixed, "bucket"), "live")
        if live.isEmpty():
            break
        if leaders is None:
            links = _rest(live, sets, p)
        else:
            pairs, rest = _propose(live, leaders, round(share * p.bands), p)
            waiting = rest.drop("comp")
            links = confirmed(pairs, sets, p)
        edges = links if labels is None else links.union(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        labels = connected_components(edges)
    of_class = full.select("id", "set_key").join(classes.select("set_key", "rep"), "set_key").select("id", "rep")
    several = of_class.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id", "a")
    together = stage(of_class.join(several, "id").select("a", F.col("rep").alias("b")).where("a < b").distinct(), "together")
    if not together.isEmpty():
        edges = together if labels is None else together.union(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        labels = connected_components(edges)
    if labels is not None:
        of_class = of_class.join(labels, of_class.rep == labels.node, "left").select("id", F.coalesce("comp", "rep").alias("rep"))
    lowest = of_class.groupBy("rep").agg(F.min("id").alias("component_id"))
    of_id = of_class.distinct().join(lowest, "rep").groupBy("id").agg(F.min("component_id").alias("component_id"))
    comp = F.coalesce("component_id", "id")
    return signed.select("id", "n_shingles").join(of_id, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        comp.alias("component_id"),
        F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"),
    )


def confirmed(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full sets confirm the link."""

    def side(key: str) -> DataFrame:
        return sets.select(F.col("rep").alias(key), F.col("n").alias(f"n_{key}"), F.col("items").alias(f"items_{key}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("common"))
    return met.where(100 * F.col("common") >= p.percent * (F.col("total") - F.col("common"))).select("a", "b")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when w is null or len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words
), items as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as x, b.doc_id as y from items a join items b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (
  select doc_id as x, doc_id as y from documents
  union select r.x, l.y from reach r join links l on r.y = l.x
), comp as (select x as doc_id, min(y) as component_id from reach group by x)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join comp c using (doc_id)
"""
