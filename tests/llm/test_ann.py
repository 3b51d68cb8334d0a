import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import ann
from tests.conftest import SF


def brute(rows, queries, k=10):
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in queries:
        gaps = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
        out[i] = sorted((g, j) for g, (j, _) in zip(gaps.tolist(), rows, strict=True) if j != i)[:k]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    true = brute(rows, [r for r in rows if r[0] % 20 == 0])
    found = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    hits = sum((r["query_id"], r["vec_id"]) in {(q, j) for q, best in true.items() for _, j in best} for r in found)
    assert len(found) == 10 * len(true) and hits >= 0.9 * len(found)
    gaps = {(i, j): g for i, v in rows if i % 20 == 0 for j, w in rows for g in [float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum()))]}
    assert all(abs(r["score"] - gaps[r["query_id"], r["vec_id"]]) < 1e-12 for r in found)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_and_abandoning_by_the_registered_query(spark, table):
    sf = SF.replace("sf0.001", table)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    true = brute(rows, [r for r in rows if r[0] % 100 == 0])
    found = ann.op2_ann(spark, sf).collect()
    hits = sum((r["query_id"], r["vec_id"]) in {(q, j) for q, best in true.items() for _, j in best} for r in found)
    assert len(found) == 10 * len(true) and hits >= 0.9 * len(found)
    each = {r["query_id"]: (r["n_met"], r["n_abandoned"]) for r in found}
    met, abandoned = (sum(x) for x in zip(*each.values(), strict=True))
    assert met <= len(rows) * len(true) and abandoned > 0.2 * met


def clustered(n, d=32, clusters=60, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, d)) * 3
    return centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, d)) * 0.3


def test_clustered_vectors_probe_few_lists(spark):
    x = clustered(6000)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true = brute(rows, [r for r in rows if r[0] % 100 == 0])
    found = ann.nearest(df, df.where("vec_id % 100 = 0"), counts=True).collect()
    hits = sum((r["query_id"], r["vec_id"]) in {(q, j) for q, best in true.items() for _, j in best} for r in found)
    assert len(found) == 10 * len(true) and hits >= 0.9 * len(found)
    assert np.mean([r["n_met"] for r in found if r["rank"] == 1]) < 0.1 * len(rows)


def test_lists_for_a_share():
    places, weights = np.array([0, 3, 1, 7]), np.array([4, 3, 2, 1])
    assert [ann.lists_for(places, weights, r) for r in (0.4, 0.6, 0.61, 0.9, 0.91, 0.99)] == [1, 2, 4, 4, 8, 8]


def test_no_member_of_a_list_is_nearer_than_its_floor():
    x = clustered(800, d=6, clusters=9)
    centroids = ann.kmeans(x, 25, 5, 1)
    at = ann.nearest_lists(x, centroids, 1)[:, 0]
    radii = np.array([np.sqrt(((x[at == i] - c) ** 2).sum(axis=1)).max() for i, c in enumerate(centroids)])
    q = clustered(50, d=6, clusters=9, seed=5)
    far = ann.squared(q, centroids)
    low = ann.floors(far, far.argmin(axis=1), centroids, radii)
    gaps = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    assert all((gaps[:, at == i] >= low[:, [i]] - 1e-9).all() for i in range(len(centroids)))
    assert (low > 0).mean() > 0.5


def test_repeated_ids_ties_and_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0, 0.0]), (5, [2.0, 0.0, 1.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, df.where("vec_id in (2, 4)"), p=ann.Params(k=2)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    assert found == {2: [(1, 0.0), (1, round(2**0.5, 6))], 4: [(5, 1.0)]}  # vectors of another length are no candidates


def test_ties_across_lists_go_to_the_smaller_id(spark):
    import math

    ring = [(i, [math.cos(i), math.sin(i)]) for i in range(1, 400)]
    df = spark.createDataFrame([(1000, [1e-9, 0.0]), *[(i + 2000, v) for i, v in ring], *ring], "vec_id long, embedding array<double>")
    found = [r["vec_id"] for r in ann.nearest(df, df.where("vec_id = 1000"), p=ann.Params(recall=1.0, eps=50.0)).orderBy("rank").collect()]
    true = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], [(1000, [1e-9, 0.0])])
    assert found == [j for _, j in true[1000]]


def test_cells_hold_every_list_once():
    first, cells = ann.cells_of(np.array([5, 3, 0, 30, 2, 9, 1]), 10)
    assert list(zip(first.tolist(), cells.tolist(), strict=True)) == [(0, 1), (0, 1), (0, 1), (1, 3), (4, 1), (5, 1), (5, 1)]


def test_all_lists_and_a_wide_test_are_exact(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    true = brute(rows, [r for r in rows if r[0] % 100 == 0])
    found = ann.nearest(df, df.where("vec_id % 100 = 0"), p=ann.Params(recall=1.0, eps=50.0, chunk_rows=64, chunk_queries=2)).orderBy("query_id", "rank").collect()
    for q, best in true.items():
        assert [r["vec_id"] for r in found if r["query_id"] == q] == [j for _, j in best]


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    rows += [(i, [1.0, 0.0]) for i in range(200, 230)] + [(300, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    found = ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    first = [(r["vec_id"], r["score"]) for r in found if r["query_id"] == 0]
    assert first == [(i, 0.0) for i in [100, *range(200, 209)]]
    assert {r["query_id"] for r in found} == {0, 100, 200, 300}
    assert [r["vec_id"] for r in found if r["query_id"] == 100] == [0, *range(200, 209)]


def test_empty_and_few(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(one, one.where("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]


def test_rotation_keeps_distances():
    r = ann.rotation(16, 3)
    assert np.allclose(r @ r.T, np.eye(16))
