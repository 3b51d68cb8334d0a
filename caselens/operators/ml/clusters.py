"""Clusters: density-based by joins and components, k-means whose starts step together, their summaries."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators.ml import epsjoin
from caselens.operators.ml.features import standardised
from caselens.plans.graphs import components, dealt, few, kept

#: Starts of k-means whose first centres are picked at the same time, and tasks of a step at most: each returns sums of all centres.
AT_ONCE = 8
TASKS = 256
#: Vectors that a task of k-means holds, about, where there are enough for several tasks.
ROWS = 10_000


def density_clusters(df: DataFrame, id_col: str, vector_col: str, eps: float = 0.5, least: int = 5, weight_col: str | None = None) -> DataFrame:
    """(id, cluster): clusters of points with `least` neighbours or more within eps (themselves included), and points in their reach; -1 is noise.

    Equal vectors are one point with a weight; weight_col: rows that a row stands for, if not one. A cluster is named by the smallest id of its dense points; a point in reach of several goes to the
    smallest. Exact for vectors of any number of components, all of one length; rows without a vector are noise. A box of a grid so fine that all of it lies
    within eps is dense as a whole if it holds `least` points; such boxes are linked through one point each first, and only what this leaves open, points
    outside of them and groups that aren't one yet, is counted and linked point by point, where they meet. So nothing grows with the square of a dense group.
    """
    rows = df.select(F.col(id_col).alias("row"), F.col(vector_col).cast("array<double>").alias("v"), _weight(weight_col).alias("weight")).withColumn("hash", F.xxhash64("v"))  # sorts compare numbers, and vectors only where these are equal
    points = kept(rows.where("v is not null").groupBy("hash", "v").agg(F.min("row").alias("id"), F.sum("weight").alias("weight")))
    at = F.transform("v", lambda x: x * F.sqrt(F.size("v")) / (eps * (1 - 1e-6)))
    box = F.when(F.forall(at, lambda x: F.abs(x) < 1 << 20), F.transform(at, lambda x: F.floor(x).cast("int")))  # floor is exact enough there
    boxed = kept(points.withColumn("box", box).withColumn("spot", F.xxhash64("box")))
    dense = kept(boxed.where("box is not null").groupBy("spot", "box").agg(F.min_by("v", "id").alias("first"), F.min("id").alias("name"), F.sum("weight").alias("held")).where(F.col("held") >= least))
    near = epsjoin.links(epsjoin.cells(dense.select(F.col("name").alias("id"), F.col("first").alias("v"), F.lit(1).alias("weight")), eps).withColumn("label", F.col("id")), eps).select(F.col("id").alias("a"), F.col("other").alias("b"))
    names = dense.select("spot", "box", "name").join(components(near).select(F.col("node").alias("name"), "comp"), "name", "left").select("spot", "box", F.coalesce("comp", "name").alias("group"))
    grouped = kept(boxed.join(few(kept(names), 20_000), ["spot", "box"], "left").select("id", "v", "weight", "group"))
    members = kept(epsjoin.cells(grouped, eps))
    of_group = few(kept(grouped.where("group is not null").select("id", "group")))
    members = kept(members.join(of_group, "id", "left"))
    counted = epsjoin.around(members.withColumn("home", F.col("home") & F.col("group").isNull()), eps)
    core = kept(grouped.where("group is not null").select("id", F.col("group").alias("label")).unionByName(counted.where(F.col("around") >= least).select("id", F.col("id").alias("label"))))
    most = core.groupBy("label").count().orderBy(F.desc("count"), "label").select("label").first()
    known = members.join(core, "id", "left").where("home or label is not null")
    asked = F.col("label").isNull() | (F.col("label") != F.lit(most[0] if most else None))  # of two points of different groups one isn't of the largest
    found = kept(epsjoin.links(known.withColumn("home", F.col("home") & F.coalesce(asked, F.lit(True))), eps))
    labels = components(found.where("inner").select(F.col("id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("label"), "comp")
    labelled = core.join(labels, "label", "left").select("id", F.coalesce("comp", "label").alias("cluster"))
    ends = found.where("not inner").select("id", F.col("other").alias("label")).join(labels, "label", "left")
    border = ends.groupBy("id").agg(F.min(F.coalesce("comp", "label")).alias("cluster"))
    of_point = labelled.unionByName(border)
    met = rows.join(points.select("hash", "v", "id"), ["hash", "v"], "left").join(of_point, "id", "left")
    return met.select(F.col("row").alias(id_col), F.coalesce("cluster", F.lit(-1).cast(df.schema[id_col].dataType)).alias("cluster"))


def _weight(column: str | None) -> Column:
    return F.lit(1).cast("long") if column is None else F.col(column).cast("long")


def kmeans(df: DataFrame, column: str = "features", k: int | None = None, starts: int = 10, seed: int = 42, iterations: int = 300, tol: float = 1e-4, weight_col: str | None = None) -> tuple[DataFrame, float]:
    """(df with cluster, cost): the cheapest of several starts; k between 2 and 10, a fifth of the rows. weight_col: rows that a row stands for, if not one.

    Spark ML picks the first centres of each start; then all starts that still move take their next step in one pass over the vectors, so that the jobs are as
    many as the longest start has steps, not as all have together. A start ends when none of its centres moves by more than tol. First centres are picked among
    the rows of df, whatever their weights (Spark ML's way); steps and costs are weighted.
    """
    vectors = df.select(column, _weight(weight_col).alias("weight"))
    n, rows = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    k, tasks = k or max(2, min(10, rows // 5)), max(1, min(TASKS, n // ROWS))
    held = dealt(vectors, tasks, max(2 * ROWS, 2 * n // tasks)).persist()  # read once, by few tasks when there are few rows

    def first(i: int):
        return np.array(KMeans(k=k, seed=seed + i, maxIter=0, featuresCol=column, predictionCol="cluster").fit(held).clusterCenters())

    with ThreadPoolExecutor(min(starts, AT_ONCE)) as pool:  # small jobs: side by side they fill the cluster
        centres = list(pool.map(first, range(starts)))
    blocks = held.select(vector_to_array(column).alias("v"), "weight").mapInArrow(_packed, "weights binary, data binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)  # a step over it needs no plan
    costs, moving = [0.0] * starts, list(range(starts))
    for _ in range(iterations):
        at = np.cumsum([0, *(len(centres[i]) for i in moving)])
        parts = blocks.mapPartitions(_step(np.concatenate([centres[i] for i in moving]), at)).collect()  # a row a task
        (sums, counts, cost), still = (sum(x) for x in zip(*parts, strict=True)), []
        for j, i in enumerate(moving):
            own = slice(at[j], at[j + 1])
            new = np.where(counts[own, None] > 0, sums[own] / np.maximum(counts[own, None], 1), centres[i])
            if (((new - centres[i]) ** 2).sum(axis=1) > tol * tol).any():
                still.append(i)
            centres[i], costs[i] = new, float(cost[j])
        moving = still
        if not moving:
            break
    blocks.unpersist()
    held.unpersist()
    best = costs.index(min(costs))
    return df.withColumn("cluster", _nearest(centres[best])(vector_to_array(column))), costs[best]


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a batch and their weights in one row, as every step reads them."""
    for b in batches:
        if b.num_rows:
            packed = b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(0))
            yield pa.RecordBatch.from_pydict({name: pa.array([x.astype(np.float64).tobytes()], pa.binary()) for name, x in zip(("weights", "data"), packed, strict=True)})


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, less the squared length of each vector."""
    return (centres**2).sum(axis=1) - 2 * (x @ centres.T)


def _step(centres: np.ndarray, at: np.ndarray):
    """A pass over packed vectors: for all starts, whose centres begin at `at`, the weighted sums and numbers of vectors nearest to each centre, and the squared distances to it."""

    def step(blocks: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sums, counts, costs = np.zeros(centres.shape), np.zeros(len(centres)), np.zeros(len(at) - 1)
        for weights, data in blocks:
            w = np.frombuffer(weights)
            x, each = np.frombuffer(data).reshape(len(w), -1), np.arange(len(w))
            gaps = _gaps(x, centres)
            chosen = np.zeros(gaps.shape)
            for j in range(len(costs)):
                own = gaps[:, at[j] : at[j + 1]]
                near = own.argmin(axis=1)
                chosen[each, at[j] + near] = w
                costs[j] += own[each, near] @ w
            costs += (x * x).sum(axis=1) @ w
            sums += chosen.T @ x
            counts += chosen.sum(axis=0)
        yield sums, counts, costs

    return step


def _nearest(centres: np.ndarray):
    """A function of arrays: the number of the nearest centre."""

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        return pa.array(_gaps(_matrix(v), centres).argmin(axis=1), pa.int32())

    return nearest


def clustered(df: DataFrame, id_col: str, vector_col: str, least: int = 3, most: int = 15, eps: float = 0.5, starts: int = 10) -> tuple[DataFrame, str]:
    """((id, cluster), method) of standardised vectors: density-based if that gives least to most clusters, numbered by their names with -1 for noise, else k-means; one cluster of fewer than 10 rows.

    Vectors (arrays, or Spark's own, which may be sparse) are standardised by all rows. Equal ones are told apart before that, as they are given, and only one of
    them, with a weight, goes on: it is dense once it is standardised, whatever it was before.
    """
    if df.limit(10).count() < 10:
        return df.select(id_col, F.lit(0).alias("cluster")), "single"
    given = F.col(vector_col) if isinstance(df.schema[vector_col].dataType, VectorUDT) else array_to_vector(F.col(vector_col).cast("array<double>"))
    vectors = df.select(id_col, given.alias("features")).withColumn("hash", F.xxhash64("features"))
    points = kept(vectors.groupBy("hash", "features").agg(F.min(id_col).alias("point"), F.count(F.lit(1)).alias("weight")))
    scaled = kept(standardised(points.select("point", "features", "weight"), of=vectors))
    dense = kept(density_clusters(scaled.select("point", "weight", vector_to_array("features").alias("v")), "point", "v", eps, weight_col="weight"))
    names = dense.where(F.col("cluster") != F.lit(-1).cast(df.schema[id_col].dataType)).select("cluster").distinct().limit(most + 1)
    names = sorted(r["cluster"] for r in names.collect())  # most + 1 at most
    if least <= len(names) <= most:
        found, method = dense.select("point", (F.array_position(F.array(*map(F.lit, names)), F.col("cluster")) - 1).cast("int").alias("cluster")), "density"
    else:
        found, method = kmeans(scaled, starts=starts, weight_col="weight")[0].select("point", "cluster"), "kmeans"
    of_point = points.select("hash", "features", "point").join(found, "point").drop("point")
    return vectors.join(of_point, ["hash", "features"]).select(id_col, "cluster"), method


def summary(devs: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A row for each cluster: size, share, most frequent severity, type and officer, counts by severity, three types."""
    def most(column: str, name: str) -> DataFrame:
        n = devs.groupBy(cluster, column).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(cluster).agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(name))

    from caselens.operators.stats import severity_counts

    sizes = devs.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *severity_counts())
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))
    kinds = devs.groupBy(cluster, "deviation_type").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "deviation_type"))
    three = kinds.withColumn("rank", rank).where("rank <= 3").groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "deviation_type"))), lambda x: x["deviation_type"]), ",").alias("top_types"))
    rows = sizes.crossJoin(total).withColumn("percentage", F.round(100.0 * F.col("size") / F.col("total"), 2)).drop("total")
    for column, name in (("severity", "top_severity"), ("deviation_type", "top_type"), ("officer_id", "top_officer")):
        rows = rows.join(most(column, name), cluster)
    return rows.join(three, cluster)
