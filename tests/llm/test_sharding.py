import zlib

import xxhash

from caselens.llm import sharding as sh
from tests.conftest import SF
from tests.llm.common import odd_documents


def test_counts_slots_and_digests(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sh.op7_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(docs) // 8, len(docs) // 8 + 1)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in rows)


def order(df):
    return [r["doc_id"] for r in df.orderBy("shard", "slot").collect()]


def test_order_is_random_and_hangs_on_seed_and_rows_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = order(sh.sharded(docs, bucket_bytes=1 << 16))
    assert a == order(sh.sharded(docs.repartition(9), bucket_bytes=1 << 16)) and a != order(sh.sharded(docs, seed=18, bucket_bytes=1 << 16))
    n = len(a)
    rank = sum((i - n / 2) * (x - n / 2) for i, x in enumerate(a)) / (n**3 / 12)
    assert abs(rank) < 0.25 and a != sorted(a)


def test_permutations_are_uniform(spark):
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(F.array_join(sh.permutation(F.lit(3), F.col("id"), 1), "").alias("p")).groupBy("p").count().collect()
    assert len(rows) == 6 and all(850 < r["count"] < 1150 for r in rows)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = sh.sharded(docs, shards=4)
    rows = found.collect()
    assert len(rows) == 15 and found.columns == [*docs.columns, "shard", "slot"]
    assert sorted(sum(r["shard"] == s for r in rows) for s in range(4)) == [3, 4, 4, 4]
    assert sh.sharded(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = odd_documents(spark)
    sh.write_shards(docs, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def test_no_python_in_the_plan(spark):
    plan = sh.op7_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def spark_hash(*values):
    """Spark's xxhash64 of ints (4 bytes), longs (8) and strings; nulls are passed over."""
    h = 42
    for v, kind in values:
        if v is not None:
            raw = v.encode() if kind == "s" else int(v).to_bytes(4 if kind == "i" else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


def brute(rows, n, seed=17):
    """The order of rows (id, text), of which few are equal, in n buckets."""
    held = {}
    for i, text in rows:
        h = spark_hash((seed, "i"), (i, "l"), (text, "s"))
        held.setdefault(h % n, []).append((h, i, text))
    out = []
    for bucket in sorted(held):
        own, order = sorted(held[bucket]), []
        for k in range(len(own)):
            order.append(k)
            j = spark_hash((seed, "i"), (bucket, "i"), (k, "i")) % (k + 1)
            order[j], order[k] = order[k], order[j]
        out += [own[k][1] for k in order]
    return out


def test_every_place_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r["text"] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t.encode()) for _, t in rows)
    assert order(sh.sharded(docs, bucket_bytes=1 << 16)) == brute(rows, -(-size // (1 << 16)))


def test_equal_rows_are_dealt_over_buckets(spark):
    from pyspark.sql import functions as F

    same = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a text that stands there again and again").alias("text"))
    other = spark.range(15_000).select((F.col("id") + 100).alias("doc_id"), F.col("id").cast("string").alias("text"))
    docs = same.union(other).union(same.limit(0))
    entries, counts, total = sh.buckets(docs, "text", 17, sh.BUCKET_BYTES)
    sizes = {r["bucket"]: r["n"] for r in counts.collect()}
    assert total == 45_000 and sum(sizes.values()) == total and max(sizes.values()) < 2 * sh.BUCKET_ROWS
    held = {r["bucket"]: r["n"] for r in entries.select("bucket", F.size("entries").alias("n")).collect()}
    assert held == sizes
    rows = sh.sharded(docs).select("doc_id", "shard", "slot").collect()
    assert sum(r["doc_id"] == 7 for r in rows) == 30_000 and len({r["doc_id"] for r in rows}) == 15_001
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(8) for k in range(5625)]
    in_shard = [sum(r["doc_id"] == 7 and r["shard"] == s for r in rows) for s in range(8)]
    assert max(in_shard) < 1.4 * min(in_shard)  # 300 runs in 8 shards
