import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from caselens.llm import mixing as mx
from tests.conftest import SF
from tests.llm.common import odd_documents


def filled(sizes, weights, share, most):
    """Targets by sharing again and again what is above the bounds."""
    left, held = share * sum(sizes), [0.0] * len(sizes)
    live = set(range(len(sizes)))
    while live:
        each = {i: left * weights[i] / sum(weights[j] for j in live) for i in live}
        full = {i for i in live if each[i] > most * sizes[i]}
        if not full:
            for i in live:
                held[i] = each[i]
            break
        for i in full:
            held[i] = most * sizes[i]
            left -= held[i]
        live -= full
    return held


def test_targets_and_quotas_against_brute_force(spark):
    r = random.Random(4)
    for n in (1, 2, 7, 30):
        sizes = [r.choice([0, 3, 50, 1000, 40_000]) + r.randrange(20) for _ in range(n)]
        p = mx.Params(weights=(3, 1, 2, 5), share=r.choice([0.3, 1.5, 2.0]))
        sources = spark.createDataFrame([(f"s{i:02}" if i < n - 1 else None, s, 1) for i, s in enumerate(sizes)], "source string, source_size long, rows long")
        aims = mx.targets(sources, p).orderBy("rank").collect()
        wanted = filled(sizes, [p.weights[i % 4] for i in range(n)], p.share, p.repeats)
        assert [a["source_size"] for a in aims] == sizes and all(abs(a["target"] - w) < 1e-6 * (1 + w) for a, w in zip(aims, wanted))
        for blocks in (0, 1, n, 500):
            found = {(q["rank"], q["house"]): q["quota"] for q in mx.quotas(spark.createDataFrame(aims, mx.targets(sources, p).schema), blocks, p).collect()}
            seats, dealt = [0] * n, []
            for _ in range(blocks if sum(sizes) else 0):  # the next block goes to the highest quotient
                i = max(range(n), key=lambda i: (aims[i]["target"] / (2 * seats[i] + 1), -i))
                seats[i] += 1
                dealt.append(i)
            for house in range(1, p.shards + 1):
                counts = Counter(dealt[: round(house * blocks / p.shards)])
                assert [found.get((i, house), 0) for i in range(n)] == [counts[i] for i in range(n)]


def test_equals_sql(same_rows):
    same_rows(mx.op13_mixing, mx.OP13_SQL)


def test_spans_are_what_is_taken_and_shards_are_equal(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mx.mixed(docs).collect()
    assert all(sum(s["to"] - s["from"] for s in r["spans"]) == r["taken"] <= 2 * r["size"] for r in rows)
    assert all(0 <= s["from"] < s["to"] <= r["size"] for r in rows for s in r["spans"])
    by_shard, taken, target = Counter(), defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        for s in r["spans"]:
            by_shard[s["shard"]] += s["to"] - s["from"]
    assert all(abs(taken[s] - target[s]) <= 16 for s in target)
    assert set(by_shard) == set(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 16 * 20
    again = mx.mixed(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    other = mx.mixed(docs, p=mx.Params(seed=24)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) != sorted((r["doc_id"], r["taken"]) for r in other)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = mx.mixed(docs)
    rows = found.collect()
    assert len(rows) == 15 and found.columns == ["doc_id", "source", "size", "source_size", "target", "taken", "spans"]
    taken, sizes = Counter(), Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
    assert set(sizes) == {"s", None} and all(abs(taken[s] - next(r["target"] for r in rows if r["source"] == s)) <= 16 for s in sizes)
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mx.mixed(docs.limit(0)).count() == 0


def test_very_many_rows_alike(spark):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source"))
    other = spark.range(3000).select((F.col("id") + 100).alias("doc_id"), F.lit("three more words").alias("text"), F.concat(F.lit("b"), F.col("id") % 3).alias("source"))
    rows = mx.mixed(same.union(other)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.first("target").alias("target")).collect()
    assert sum(r["n"] for r in rows) == 23_000 and all(abs(r["taken"] - r["target"]) <= 16 for r in rows)
    assert {r["most"] for r in rows if r["source"] == "a"} <= {2, 3, 4}


def test_no_python_in_the_plan(spark):
    plan = mx.op13_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
