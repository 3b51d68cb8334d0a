import random

import pytest
from pyspark.sql import functions as F

from caselens.llm import near_dedup as nd
from tests.conftest import SF
from tests.llm.common import odd_documents


def brute(rows, percent=85):
    """(doc_id -> (n, component)) by comparing all pairs of full word shingle sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df).collect()}
    assert found == brute(rows)


def test_families_of_near_copies(spark):
    r = random.Random(1)
    rows = []
    for family in range(6):
        base = [f"w{r.randrange(900)}" for _ in range(150)]
        for copy in range(12):
            text = list(base)
            for _ in range(copy % 5):
                text[r.randrange(len(text))] = f"x{r.randrange(99)}"
            rows.append((family * 100 + copy * 7, " ".join(text)))
    check(spark, rows)


def test_chain_where_ends_are_not_linked(spark):
    base, rows = [f"w{i}" for i in range(200)], []
    for step in range(8):
        rows.append((50 - step, " ".join(base[step * 8 : step * 8 + 130])))
    check(spark, rows)


def test_equals_sql(same_rows):
    same_rows(nd.op1_near_dedup, nd.OP1_SQL)


def test_odd_documents(spark):
    found = nd.near_duplicates(odd_documents(spark)).collect()
    assert len(found) == 15
    of = {}
    for r in found:
        of.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert of[1] == [(0, 1, True)] and of[2] == [(0, 2, True)] and of[3] == [(0, 3, True)]
    assert {x[1] for x in of[5] + of[6] + of[7]} == {5} and len(of[6]) == 2
    assert of[8] == [(1, 8, True)] and of[9] == [(1, 8, False)] and of[10][0][0] == 1
    assert all(c is None and kept for _, c, kept in of[None])


def test_empty_table(spark):
    assert nd.near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_odd_sketches_tell_similarities_apart():
    import numpy as np

    p = nd.Params()
    rng = np.random.default_rng(p.seed + 1)
    k = p.bands * p.rows
    a, b = rng.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, np.uint32)
    words = [f"w{i}" for i in range(600)]

    def sketch(x):
        return nd.odd_sketch(nd.minhashes(nd.shingle_set(" ".join(x), p), a, b), p.sketch_bits)

    def apart(x, y):
        return sum(int(v).bit_count() for v in (sketch(x) ^ sketch(y)).view(np.uint64))

    assert apart(words, words) == 0
    assert apart(words, words[:560]) <= nd.most_differing_bits(p)
    assert apart(words, words[:200]) > nd.most_differing_bits(p)


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(spark, partitions):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).repartition(partitions)
    found = nd.near_duplicates(docs.withColumn("rep", F.lit(1)))
    assert found.where("component_id > doc_id").count() == 0


def test_an_id_of_several_texts_is_one_document(spark):
    r = random.Random(9)
    a, b = ([f"w{r.randrange(900)}" for _ in range(120)] for _ in range(2))
    near_a, near_b = (x[:60] + ["changed"] + x[61:] for x in (a, b))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near_a)), (3, " ".join(near_b)), (3, None), (4, "alone")]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        found = nd.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in found) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]


def test_pairs_meet_in_their_first_band_only(spark):
    """A family of which most share many bands without a link: no pair is proposed twice, and links are those of brute force."""
    r = random.Random(3)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(300):
        w = list(base)
        for _ in range(9):
            w[r.randrange(300)] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    check(spark, rows)
    p = nd.Params()
    signed = nd.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", p)
    live = signed.select(F.col("id").alias("rep"), F.col("id").alias("comp"), F.lit(1).alias("pop"), F.col("n_shingles").alias("n"), "sketch", "bands", F.posexplode("bands").alias("band", "bucket"))
    live = live.withColumn("seen", F.slice("bands", F.lit(1), F.col("band"))).drop("bands")
    pairs, _ = nd._propose(live, 10_000, p.bands, p)
    joined = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in joined
    bands = {x["id"]: x["bands"] for x in signed.collect()}
    met = {(x["a"], x["b"]) for x in pairs.collect()}
    for x in range(0, 300, 17):
        for y in range(x + 1, 300):
            if not set(bands[x]) & set(bands[y]):
                assert (x, y) not in met
