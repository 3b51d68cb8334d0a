"""Two-pass external shuffle into shards of equal counts. DataFrame functions only.

First pass: every row goes to a bucket by a seeded hash of the row, uniformly and whatever its source or
group, with as many buckets as keep each within memory. Rows that are equal throughout have one hash; where
there are many, runs of them are dealt out by the hash and the number of the run. Second pass: each bucket is put in
a canonical order and shuffled by Fisher and Yates' method, seeded by the bucket. The buckets one after the
other are the new order of all rows; shards are equal consecutive parts of it, so a bucket is written to one
or two shards only. A row's place is its bucket's offset, a running sum over bucket counts, plus its place
in the bucket: no global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import blocks_for, read_table, sized_broadcast, stage

#: UTF-8 bytes of text, and rows, that a bucket holds on average at most.
BUCKET_BYTES = 4 << 20
BUCKET_ROWS = 1000
#: Equal rows that stay together.
RUN = 100
#: Buckets whose counts are summed together first.
SPAN = 1024


def permutation(n: Column, bucket: Column, seed: int) -> Column:
    """A random order of 0 to n - 1: number i takes the place of a random earlier one (or its own), which moves to the end."""

    def step(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        moved = F.concat(F.slice(order, F.lit(1), j), F.array(i), F.slice(order, j + 2, i - j), F.array(F.get(order, j)))
        return F.when(j == i, F.concat(order, F.array(i))).otherwise(moved)

    return F.aggregate(F.slice(F.sequence(F.lit(0), n - 1), F.lit(2), n), F.array(F.lit(0)), step)


def _runs(hashes: DataFrame, run_bytes: int) -> DataFrame:
    """(h, run, times) of hashes (h, n, size) of many equal rows: n cut into runs of RUN rows, or fewer of long texts."""
    each = F.greatest(F.lit(1), F.least(F.lit(RUN), F.floor(run_bytes * F.col("n") / F.greatest(F.col("size"), F.lit(1)))))
    last = F.floor((F.col("n") - 1) / F.col("each"))
    wide = F.lit(4096)  # runs are made in two steps, so that none needs an array of all
    spans = hashes.withColumn("each", each).withColumn("last", last).withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / wide))))
    runs = spans.withColumn("run", F.explode(F.sequence(F.col("span") * wide, F.least(F.col("last"), F.col("span") * wide + wide - 1))))
    return runs.select("h", "run", F.least(F.col("each"), F.col("n") - F.col("run") * F.col("each")).cast("int").alias("times"))


def buckets(docs: DataFrame, text_col: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """((bucket, entries), (bucket, n), number of rows): the first pass. An entry is a hash and a row."""
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    length = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0))
    hashes = stage(docs.select(hashed.alias("h"), length.alias("size")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "hashes")
    total, size, most = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.max("n")).first()
    parts = F.lit(max(blocks_for(size, bucket_bytes), blocks_for(total, BUCKET_ROWS)))
    single, many = hashes.where(F.col("n") <= RUN), hashes.where(F.col("n") > RUN)
    own = F.pmod("h", parts).cast("int").alias("bucket")
    counts = single.select(own, "n")
    rows = docs.select(hashed.alias("h"), F.struct("*").alias("row"))
    entries = rows.select(own, F.struct("h", "row").alias("entry"))
    if (most or 0) > RUN and not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema):
        runs = stage(_runs(many, max(1, bucket_bytes // 8)), "runs").select("h", F.pmod(F.xxhash64("h", "run"), parts).cast("int").alias("bucket"), "times")
        counts = counts.union(runs.select("bucket", F.col("times").cast("long")))
        hot = sized_broadcast(many.select("h"))
        once = rows.join(hot, "h", "left_semi").groupBy("h", "row").agg(F.count(F.lit(1)).alias("n"))
        dealt = once.join(runs, "h").repartition("bucket")  # a run becomes rows where its bucket is, not where all equal ones meet
        dealt = dealt.select("bucket", F.explode(F.array_repeat(F.struct("h", "row"), F.col("times"))).alias("entry"))
        entries = rows.join(hot, "h", "left_anti").select(own, F.struct("h", "row").alias("entry")).union(dealt)
    else:
        counts = hashes.select(own, "n")
    return entries.groupBy("bucket").agg(F.sort_array(F.collect_list("entry")).alias("entries")), counts.groupBy("bucket").agg(F.sum("n").alias("n")), total


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (place in the shard, gapless from 0); shard sizes differ by one at most.

    The order depends on the seed and the rows alone, not on how they are partitioned; rows equal in every column
    are interchangeable, and however many there are, no bucket holds more of them than of others. Null ids and texts
    are values like others. Columns of maps and variants take no part in the hash, and rows are then kept in one bucket if they are
    equal in all others. Other columns are kept; shard and slot replace columns of these names. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    entries, counts, total = buckets(docs.select(*[F.col(f"`{c}`") for c in kept]), text_col, seed, bucket_bytes)
    counts = counts.withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = counts.groupBy("span").agg(F.sum("n").alias("n"))
    spans = spans.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("span").orderBy("bucket")) - F.col("n")
    offsets = counts.withColumn("inner", inner).join(spans, "span").select("bucket", (F.col("base") + F.col("inner")).alias("offset"))
    order = permutation(F.size("entries"), F.col("bucket"), seed)
    mixed = entries.select("bucket", F.transform(order, lambda i: F.get("entries", i)).alias("entries")).select("bucket", F.posexplode("entries").alias("at", "entry"))
    whole = mixed.join(offsets, "bucket").select("entry.row.*", (F.col("offset") + F.col("at")).alias("__place"))
    first, shard = _parts(F.col("__place"), total, shards)
    return whole.select(*[F.col(f"`{c}`") for c in kept], shard.alias("shard"), (F.col("__place") - first).alias("slot"))


def _parts(place: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Where the shard of a place starts, and the shard; shard i starts at floor(i * total / shards)."""
    first, shard = F.lit(0), F.lit(0)
    for i in range(shards):
        start = i * total // shards
        first = F.when(place >= start, F.lit(start)).otherwise(first)
        shard = F.when(place >= start, F.lit(i)).otherwise(shard)
    return first.cast("long"), shard.cast("int")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as folders shard=0, shard=1, ...; every task writes the shuffled buckets that it has, in the order of their slots."""
    sharded(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return sharded(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
