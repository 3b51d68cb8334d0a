"""Approximate nearest neighbours by inverted lists and an adaptive scan over dimensions.

Centroids are fitted on a bounded sample; every vector is put in the list of its nearest centroid, and each
query probes the nearest lists: as many as hold the wanted share of the exact neighbours of some trial queries, which are searched for
among all vectors. Within a list, vectors are rotated by one random orthogonal matrix and
scanned in blocks of columns. After d of D columns a vector's partial squared distance, scaled by D / d,
estimates the full one; if it exceeds the k-th best so far by more than a test with deviation
eps / sqrt(d) allows, the vector is abandoned. What survives all columns gets its exact distance on the
original components. A query's nearest list is scanned first; the k-th distance found there is the bound
that all its other lists start with. A list is passed over where nothing in it can be within that bound: its members lie no further
from their centroid than its radius, and on that centroid's side of the plane between it and the query's own.

Small lists share a cell and a large one is cut into several, so that a list holding a third of all vectors is
many tasks, and a query travels once to a cell, not once to a list. Equal vectors are one entry with the
smallest ids that any query can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import read_table, stage


@dataclass(frozen=True)
class Params:
    """k nearest; centroids from at most sample_rows rows (and sample_bytes); sqrt(n) lists, at most max_lists.

    recall: share of the exact neighbours of `trials` queries that the probed lists must hold (1: all lists are probed); least_lists at least are probed
    (all, if there are fewer). columns: width of a column block.
    eps: width of the test: at 1.0 evenly spread vectors of 64 components lose a hundredth of what the lists hold. together: rows that are
    scanned under one bound. chunk_rows, chunk_queries: vectors of a cell, and queries that meet them in a task.
    """

    k: int = 10
    sample_rows: int = 20_000
    sample_bytes: int = 16 << 20
    max_lists: int = 4096
    recall: float = 0.97
    trials: int = 200
    least_lists: int = 32
    columns: int = 16
    eps: float = 1.0
    together: int = 256
    chunk_rows: int = 2048
    chunk_queries: int = 8192
    iterations: int = 10
    seed: int = 11


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal d x d matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _far(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids**2).sum(axis=1) - 2 * (x @ centroids.T)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to each centroid."""
    return _far(x, centroids) + (x**2).sum(axis=1)[:, None]


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row of x."""
    return nearest_of_rows(_far(x, centroids), n)


def nearest_of_rows(gaps: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n smallest entries of each row (all, if there are fewer)."""
    return np.argpartition(gaps, n - 1, axis=1)[:, :n] if n < gaps.shape[1] else np.tile(np.arange(gaps.shape[1]), (len(gaps), 1))


def kmeans(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """Centres of at most k clusters of the rows of x, none without rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(iterations):
        at = nearest_lists(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = total[n > 0] / n[n > 0][:, None]
    return c[np.unique(nearest_lists(x, c, 1))]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector that is not null, not zero and finite throughout."""
    v = F.col(vector_col) if df.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d).astype(float)


def cells_of(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each list: lists share a cell up to so many rows, larger ones have several of their own."""
    first, cells = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > rows:
            at, held = at + 1, 0
        first[i], cells[i], held = at, max(1, -(-int(n) // rows)), held + int(n)
        if cells[i] > 1:
            at, held = at + int(cells[i]), 0
    return first, cells


def lists_for(places: np.ndarray, weights: np.ndarray, recall: float) -> int:
    """The fewest nearest lists that hold so large a share of neighbours, each in the list at a place (from 0) of its query's order."""
    order = np.argsort(places, kind="stable")
    share = np.cumsum(weights[order]) / weights.sum()
    return int(places[order][np.searchsorted(share, min(recall, share[-1]) - 1e-12)]) + 1


def floors(far: np.ndarray, own: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Distances below which a query has nothing in each list; far: squared ones to the centroids, own: number of the nearest."""
    between = np.sqrt(np.maximum(squared(centroids[own], centroids), 0))
    nearest_of = np.take_along_axis(far, own[:, None], axis=1)
    plane = np.where(between > 0, (far - nearest_of) / np.where(between > 0, 2 * between, 1), 0)
    return np.maximum(np.sqrt(np.maximum(far, 0)) - radii, plane)


class Cell:
    """Rows (list, ids, v) by list, rotated, in blocks of columns."""

    def __init__(self, rows: pd.DataFrame, p: Params):
        rows = rows.sort_values("list", kind="stable")
        self.x, self.lists = np.stack(rows["v"].to_numpy()).astype(float), rows["list"].to_numpy()
        self.ids = [list(i) for i in rows["ids"]]
        d = self.x.shape[1]
        self.rotation, self.cuts = rotation(d, p.seed), range(0, d, p.columns)
        turned = self.x @ self.rotation
        self.blocks = [np.ascontiguousarray(turned[:, c : c + p.columns]) for c in self.cuts]

    def places(self, n: int) -> tuple[int, int]:
        return int(np.searchsorted(self.lists, n)), int(np.searchsorted(self.lists, n, side="right"))


def scan(cell: Cell, q: np.ndarray, own, lists: list[int], bound: float, p: Params) -> tuple[list[tuple[float, object]], int, int]:
    """(distance, id) of the k nearest rows in the given lists of a cell, the rows met, and those abandoned before their last columns.

    bound: a distance that k rows elsewhere don't exceed.
    """
    d, turned = len(q), q @ cell.rotation
    worst, best, met, abandoned = bound**2, [], 0, 0
    for low, high in ((low, min(low + p.together, end)) for first, end in (cell.places(n) for n in lists) for low in range(first, end, p.together)):
        alive = np.arange(low, high)
        partial = np.zeros(len(alive))
        met += len(alive)
        for c, block in zip(cell.cuts, cell.blocks, strict=True):
            partial += ((block[alive] - turned[c : c + p.columns]) ** 2).sum(axis=1)
            seen = min(c + p.columns, d)
            slack = (1 + p.eps / seen**0.5) ** 2 if seen < d else 1 + 1e-9
            keep = partial * (d / seen) <= worst * slack
            abandoned += len(alive) - int(keep.sum()) if seen < d else 0
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        if not len(alive):
            continue
        exact = np.sqrt(((cell.x[alive] - q) ** 2).sum(axis=1))
        best += [(s, i) for s, at in zip(exact.tolist(), alive, strict=True) for i in cell.ids[at] if i != own]
        best.sort()
        del best[p.k :]
        if len(best) == p.k:
            worst = min(worst, best[-1][0] ** 2)
    return best, met, abandoned


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", p: Params = Params(), counts: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the k nearest rows of vectors found, by Euclidean distance.

    Nearest first, ties to the smaller id; a query is never its own candidate. counts: also n_met, the distinct vectors in the
    lists that a query probed, and n_abandoned, those left before their last columns. Ids are taken as unique, and equal repeated rows count once;
    of an id with several vectors each is a row of its own, and none is a candidate of a query of that id. A query is held
    against the vectors of its own length. Rows without an id, and vectors that are null, zero, or hold a null or
    non-finite component take no part, as query or candidate; with nothing left the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ids = vectors.schema[id_col].dataType
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).distinct()
    lengths = [r["d"] for r in asked.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # a search for each
    found = [_search(rows.where(F.size("v") == d), asked.where(F.size("v") == d), d, p) for d in lengths]
    found = [f for f in found if f is not None]
    whole = reduce(DataFrame.union, found, spark.createDataFrame([], _found(ids)))
    query = Window.partitionBy("query_id", "key")
    whole = whole.select("*", F.sum("met").over(query).alias("n_met"), F.sum("abandoned").over(query).alias("n_abandoned")).where("vec_id is not null")
    rank = F.row_number().over(query.orderBy("score", "vec_id"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score", *(["n_met", "n_abandoned"] if counts else []))


def _found(ids: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", ids), T.StructField("key", T.LongType()), T.StructField("vec_id", ids), T.StructField("score", T.DoubleType()),
        T.StructField("met", T.LongType()), T.StructField("abandoned", T.LongType()),
    ])


def _probes(index: DataFrame, asked: DataFrame, centroids: np.ndarray, p: Params) -> int:
    """How many nearest lists hold the wanted share of the exact neighbours of some trial queries; every vector is held against those."""
    if p.recall >= 1:
        return len(centroids)
    trials = asked.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.trials).collect()
    own, x = [r["id"] for r in trials], np.array([r["v"] for r in trials], float)
    width = p.k + 1  # one may be the query itself

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.full((len(x), width), np.inf), np.zeros((len(x), width), np.int32), np.zeros((len(x), width), np.int64)]
        for b in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
            gaps = squared(x, _matrix(b.column("v"), x.shape[1]))
            near = nearest_of_rows(gaps, width)
            ids, lists = b.column("ids"), b.column("list").to_numpy()
            others = np.array([[sum(i != me for i in ids[j].as_py()) for j in row] for me, row in zip(own, near.tolist(), strict=True)])
            both = [np.hstack(pair) for pair in zip(best, (np.take_along_axis(gaps, near, axis=1), lists[near], others), strict=True)]
            order = np.argsort(np.where(both[2] > 0, both[0], np.inf), axis=1, kind="stable")[:, :width]
            best = [np.take_along_axis(c, order, axis=1) for c in both]
        trial, at = np.nonzero(np.isfinite(best[0]) & (best[2] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(trial.astype(np.int32)), *(pa.array(c[trial, at]) for c in best)], names=["trial", "gap", "list", "others"])

    found = index.mapInArrow(exact, "trial int, gap double, list int, others long")
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("gap", "list"))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= p.k).orderBy("trial", "rank").collect()  # trials x k
    order = np.argsort(np.argsort(squared(x, centroids), axis=1, kind="stable"), axis=1)
    left, places, weights = [p.k] * len(x), [], []
    for r in rows:
        places.append(order[r["trial"], r["list"]])
        weights.append(min(left[r["trial"]], r["others"]))
        left[r["trial"]] -= weights[-1]
    return lists_for(np.array(places), np.array(weights), p.recall) if any(weights) else len(centroids)


def _search(rows: DataFrame, asked: DataFrame, d: int, p: Params) -> DataFrame | None:
    """Rows of _found for vectors of one length: at most k for each query and cell, and one without a vec_id that counts what was met there."""
    spark, ids, vector = rows.sparkSession, rows.schema["id"].dataType, rows.schema["v"].dataType
    most = min(p.sample_rows, max(1, p.sample_bytes // (8 * d)))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").select("v").limit(most).toLocalIterator()], float)
    if not len(sample):
        return None
    n, n_asked = rows.count(), asked.count()
    centroids = kmeans(sample, min(p.max_lists, max(1, round(n**0.5))), p.iterations, p.seed)

    # No query needs more than the k + 1 smallest ids of equal vectors: one may be its own.
    smallest = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.withColumn("nth", smallest).where(F.col("nth") <= p.k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), d)
                at = nearest_lists(x, centroids, 1)[:, 0]
                away = np.sqrt(((x - centroids[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(away), b.column(0), b.column(1)], names=["list", "away", *b.schema.names])

    kinds = {"list": T.IntegerType(), "away": T.DoubleType(), "ids": T.ArrayType(ids), "v": vector}
    index = stage(distinct.select("ids", "v").mapInArrow(put, T.StructType([T.StructField(*x) for x in kinds.items()])), "lists")
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).toLocalIterator():  # a row a list: max_lists at most
        sizes[r["list"]], radii[r["list"]] = r["n"], r["radius"]
    probes = min(len(centroids), max(p.k + 1, p.least_lists, _probes(index, asked, centroids, p)))  # no list is empty: k candidates at least
    first, cells = cells_of(sizes, p.chunk_rows)
    known = spark.createDataFrame([(i, int(f), int(c)) for i, (f, c) in enumerate(zip(first, cells, strict=True))], "list int, first int, cells int")
    cuts = max(1, -(-n_asked // p.chunk_queries))
    parts = index.join(F.broadcast(known), "list").select((F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0]), "cells")).cast("int").alias("cell"), "list", "ids", "v")
    parts = parts.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    wanted = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("id", ids), T.StructField("key", T.LongType()), T.StructField("v", vector), T.StructField("bound", T.DoubleType()), T.StructField("lists", T.ArrayType(T.IntegerType())),
    ])

    def probed(nearest_only: bool):
        """Each query (id, key, v, bound) once for each cell that it probes, with the lists there, nearest first."""

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
                far = squared(_matrix(b.column("v"), d), centroids)
                order = np.argsort(far, axis=1, kind="stable")[:, :probes]
                bound = b.column("bound").to_numpy()[:, None] * (1 + 1e-9) + 1e-12
                reached = np.take_along_axis(floors(far, order[:, 0], centroids, radii), order, axis=1) <= bound
                chosen = np.arange(order.shape[1]) == 0 if nearest_only else np.arange(order.shape[1]) > 0
                at, cell, lists = [], [], []
                for i, (row, ok) in enumerate(zip(order, reached & chosen, strict=True)):
                    met: dict[int, list[int]] = {}
                    for x in row[ok].tolist():
                        for c in range(first[x], first[x] + cells[x]):
                            met.setdefault(c, []).append(x)
                    at += [i] * len(met)
                    cell += met
                    lists += met.values()
                taken = [b.column(c).take(pa.array(at, pa.int64())) for c in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *taken, pa.array(lists, pa.list_(pa.int32()))], names=wanted.names)

        return ask

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            cell = Cell(rows, p)
            for id_, key, v, bound, lists in zip(asked["id"].tolist(), asked["key"], asked["v"], asked["bound"], asked["lists"], strict=True):
                best, met, abandoned = scan(cell, np.asarray(v, float), id_, list(lists), bound, p)
                out += [(id_, key, i, s, 0, 0) for s, i in best] + [(id_, key, None, None, met, abandoned)]
        frame = pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score", "met", "abandoned"], dtype=object)
        return frame.astype({"key": "int64", "score": "float64", "met": "int64", "abandoned": "int64"})

    def met(wants: DataFrame) -> DataFrame:
        wants = wants.withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(cuts)).cast("int"))
        return parts.groupBy("cell", "cut").cogroup(wants.groupBy("cell", "cut")).applyInPandas(search, _found(ids))

    keyed = asked.select("id", F.xxhash64("v").alias("key"), "v")
    near = stage(met(keyed.withColumn("bound", F.lit(float("inf"))).mapInArrow(probed(True), wanted)), "nearest")
    kth = F.get(F.sort_array(F.collect_list("score")), p.k - 1)
    bounds = near.where("score is not null").groupBy(F.col("query_id").alias("id"), "key").agg(kth.alias("bound"))
    rest = keyed.join(bounds, ["id", "key"], "left").select("id", "key", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return near.union(met(rest.mapInArrow(probed(False), wanted)))


def op2_ann(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), counts=True)
