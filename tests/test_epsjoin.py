"""Exact neighbours and density clusters against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators.ml import clusters, epsjoin


def table(spark, x, ids=None):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids or range(len(x)), x)], f"id {'string' if ids else 'long'}, v array<double>")


def squares(x):
    return ((x[:, None] - x[None]) ** 2).sum(axis=2)


def families(n, dims, seed=1):
    """Half of the points in a few tight families, one of which has most, the rest spread evenly."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dims)) * 3
    own = r.choice(9, n // 2, p=[0.6, *[0.05] * 8])
    return np.concatenate([centres[own] + r.normal(size=(n // 2, dims)) * 0.05, r.normal(size=(n - n // 2, dims))])


@pytest.mark.parametrize("dims,eps", [(1, 0.001), (3, 0.1), (64, 0.5), (64, 7.0)])
def test_pairs_against_all_distances(spark, monkeypatch, dims, eps):
    monkeypatch.setattr(epsjoin, "CELL", 60)
    monkeypatch.setattr(epsjoin, "PIECE", 200)
    x = families(700, dims)
    found = {tuple(p) for p in epsjoin.pairs(table(spark, x), eps).collect()}
    a, b = np.nonzero(np.triu(squares(x) <= eps * eps, 1))
    assert found == set(zip(a.tolist(), b.tolist()))


def test_every_point_is_at_home_once_and_tasks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(epsjoin, "CELL", 100)
    most = {}
    for n in (800, 1600):
        x = families(n, 8)
        members = epsjoin.cells(table(spark, x).withColumn("weight", F.lit(1)), 0.2).persist()
        assert members.where("home").count() == n == members.where("home").select("id").distinct().count()
        most[n] = epsjoin.blocks(members).groupBy("cell", "i", "j").count().agg(F.max("count")).first()[0]
        assert members.select("cell").distinct().count() > 8
    assert most[800] < 400 and most[1600] < 400  # two blocks, uneven by their hashes


def brute_clusters(x, eps, least=5):
    near = squares(x) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        low = np.array([min([label[i], *label[near[i] & core]]) if core[i] else -1 for i in range(len(x))])
        if (low == label).all():
            break
        label = low
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_density_clusters_against_all_distances(spark, monkeypatch, seed):
    monkeypatch.setattr(epsjoin, "CELL", 50)
    r = np.random.default_rng(seed)
    x = np.round(np.concatenate([r.normal(size=(200, 2)), np.repeat(r.normal(size=(3, 2)) * 4, 7, axis=0), r.uniform(-5, 5, (80, 2))]), 2)
    found = {row["id"]: row["cluster"] for row in clusters.density_clusters(table(spark, x), "id", "v", eps=0.3).collect()}
    assert [found[i] for i in range(len(x))] == brute_clusters(x, 0.3).tolist()


def test_text_ids_missing_vectors_and_an_empty_table(spark):
    x = np.array([[0.0, 0.0]] * 6 + [[9.0, 9.0]])
    df = table(spark, x, [f"p{i}" for i in range(7)]).union(spark.createDataFrame([("none", None)], "id string, v array<double>"))
    found = {r["id"]: r["cluster"] for r in clusters.density_clusters(df, "id", "v").collect()}
    assert found == {f"p{i}": "p0" for i in range(6)} | {"p6": "-1", "none": "-1"}
    assert clusters.density_clusters(df.limit(0), "id", "v").count() == 0


def test_the_choice_of_a_method(spark):
    r = np.random.default_rng(5)
    four = np.repeat(np.eye(4) * 8, 60, axis=0) + r.normal(size=(240, 4)) * 0.05
    found, method = clusters.clustered(table(spark, four), "id", "v")
    assert method == "density" and found.where("cluster != -1").select("cluster").distinct().count() == 4
    found, method = clusters.clustered(table(spark, r.normal(size=(60, 30))), "id", "v")
    assert method == "kmeans" and found.count() == 60
    assert clusters.clustered(table(spark, four[:9]), "id", "v")[1] == "single"


def test_components_against_a_search(spark):
    from caselens.plans.graphs import components

    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for kind, made in (("long", edges), ("string", [(f"{a:05}", f"{b:05}") for a, b in edges])):
        found = components(spark.createDataFrame(made, f"a {kind}, b {kind}")).collect()
        assert {int(x["node"]): int(x["comp"]) for x in found} == {x: root(x) for x in parent} and len(found) == len(parent)


def test_a_split_that_only_copies_is_not_made(spark, monkeypatch):
    monkeypatch.setattr(epsjoin, "CELL", 100)
    x = np.random.default_rng(3).normal(size=(600, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = table(spark, x)
    assert epsjoin.cells(df.withColumn("weight", F.lit(1)), 1.08).count() == 600  # every border is within eps: 32 copies each otherwise
    a, b = np.nonzero(np.triu(squares(x) <= 1.08**2, 1))
    assert {tuple(p) for p in epsjoin.pairs(df, 1.08).collect()} == set(zip(a.tolist(), b.tolist()))


def test_a_dense_line_is_neither_copied_nor_counted_point_by_point(spark, monkeypatch):
    monkeypatch.setattr(epsjoin, "CELL", 100)
    r, rows = np.random.default_rng(4), []
    met = epsjoin.blocks
    monkeypatch.setattr(epsjoin, "blocks", lambda members: rows.append(members.count()) or met(members))
    x = np.column_stack([np.repeat(np.arange(3.0) * 5, 500), r.uniform(0, 6, 1500)])
    x = np.concatenate([x, [[2.5, 3.0], [0.4, -0.2], [10.0, 6.4]]])
    found = {row["id"]: row["cluster"] for row in clusters.density_clusters(table(spark, x), "id", "v", eps=0.5).collect()}
    assert [found[i] for i in range(len(x))] == brute_clusters(x, 0.5).tolist()
    assert sum(rows) < 3 * len(x)


def test_starts_of_kmeans_step_together_to_the_centres_of_spark_ml(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(5).random((1000, 3))
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "features"]).coalesce(1).cache()
    ml = [KMeans(k=6, seed=7 + i, maxIter=300, featuresCol="features", predictionCol="cluster").fit(df) for i in range(4)]
    best = min(ml, key=lambda m: m.summary.trainingCost)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    found, cost = clusters.kmeans(df, k=6, starts=4, seed=7)
    assert jobs() - before < sum(m.summary.numIter for m in ml)  # each start had a job a step
    assert cost == pytest.approx(best.summary.trainingCost)
    assert found.select("id", "cluster").exceptAll(best.transform(df).select("id", "cluster")).count() == 0


def test_equal_vectors_are_clustered_once_with_a_weight(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = np.repeat(r.normal(size=(60, 30)), r.integers(1, 9, 60), axis=0)
    x[:, 7] = np.where(x[:, 7] > 0, 0.0, -0.0)  # equal, and constant
    x = x[r.permutation(len(x))]
    x[::3, 7] *= -1
    held, make = [], clusters.kmeans
    monkeypatch.setattr(clusters, "kmeans", lambda df, **p: held.append(df.count()) or make(df, **p))
    for given in (table(spark, x), table(spark, x).withColumn("v", clusters.array_to_vector("v"))):
        found, method = clusters.clustered(given, "id", "v")
        found = {row["id"]: row["cluster"] for row in found.collect()}
        assert method == "kmeans" and sorted(found) == list(range(len(x)))
        z = np.delete(x, 7, axis=1)
        z, own = (z - z.mean(axis=0)) / z.std(axis=0), np.array([found[i] for i in range(len(x))])
        means = np.array([z[own == j].mean(axis=0) for j in sorted(set(own))])  # of all rows, however often a vector stands
        assert [sorted(set(own))[j] for j in ((z[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)] == own.tolist()
        assert len({(row.tobytes(), found[i]) for i, row in enumerate(z)}) == 60
    assert max(held) <= 120 < len(x)


def test_weights_of_kmeans_and_of_density_are_rows(spark):
    r = np.random.default_rng(7)
    x, weights = np.round(r.normal(size=(90, 2)), 1), r.integers(1, 6, 90)
    df = spark.createDataFrame([(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(x, weights))], "id long, v array<double>, weight long")
    rows = np.repeat(x, weights, axis=0)
    first = np.repeat(np.arange(90), weights)
    found = {row["id"]: row["cluster"] for row in clusters.density_clusters(df, "id", "v", eps=0.15, weight_col="weight").collect()}
    wanted = brute_clusters(rows, 0.15)
    assert {i: found[i] for i in first} == {i: c if c < 0 else first[c] for i, c in zip(first, wanted)}
    vectors = df.withColumn("features", clusters.array_to_vector("v"))
    of, cost = clusters.kmeans(vectors, k=4, weight_col="weight")
    own = np.array([row["cluster"] for row in of.orderBy("id").collect()])[first]
    assert cost == pytest.approx(sum(((rows[own == j] - rows[own == j].mean(axis=0)) ** 2).sum() for j in set(own)))
    assert clusters.kmeans(vectors.limit(3), weight_col="weight")[0].count() == 3


def test_rows_that_one_task_has_read_are_dealt_to_several(spark, monkeypatch):
    from caselens.operators.ml import features
    from caselens.plans import analysis
    from caselens.plans.graphs import dealt
    from caselens.sources import tables as t
    from tests.conftest import SF

    def most(df):
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    one = spark.range(4000).coalesce(1)
    assert most(dealt(one, 8, 1000)) < 1000 and "Exchange" not in dealt(one, 8, 4000)._jdf.queryExecution().executedPlan().toString()
    held, fit = [], features.fit
    monkeypatch.setattr(analysis, "ROWS", 500)
    monkeypatch.setattr(features, "fit", lambda devs: held.append(most(devs)) or fit(devs))
    monkeypatch.setattr(clusters, "clustered", lambda df, *names: held.append(most(df)) or (df.select("deviation_id", F.lit(0).alias("cluster")), "single"))
    analysis.ml_sample(t.deviations(spark, SF).coalesce(1))
    assert max(held) < 1000 and len(held) == 2
