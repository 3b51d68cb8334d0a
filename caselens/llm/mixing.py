"""Mixing sources to target weights: whole blocks of words, dealt to sources by Sainte-Laguë's highest quotients. DataFrame functions only.

Every source has a target, its share of the words of the mix. The mix is blocks of equal numbers of words, and Sainte-Laguë's
method deals them: the next block goes to the source with the greatest target / (2 * blocks so far + 1). Each shard takes the next
stretch of that sequence, so its quotas are what the sources have gained between two numbers of blocks. Only the few seats around the
bounds are enumerated: all below target / (T / (B - S / 2)) + 1/2 are certain, none above target / (T / (B + S / 2)) + 1/2 can be won,
and for S sources there are 2 * S in between at most, whatever the number of blocks.

Blocks are cut from a seeded order of the source's documents, as many passes of it as a document may be repeated, one after the other;
a quota takes the next blocks of that order. So a document's words are a range of its source's order, and what the mix takes of it is
the overlap of that range with the blocks taken. Places in the order are sums over small buckets of hashes, however large a source is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.llm.common import read_table, sized_broadcast, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of an order on average, buckets whose sums are summed together first, repeated rows made at once.
BUCKET_ROWS = 2000
SPAN = 1024
COPIES = 4096


@dataclass(frozen=True)
class Params:
    """weights: of the sources in order, repeating; share: words of the mix by words there are; repeats: of a document at most; block: words."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    block: int = 16
    shards: int = 8
    seed: int = 23


def entries(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, n): n rows alike. Size is the number of words, 0 for null."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size")).groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))


def targets(sources: DataFrame, p: Params = Params()) -> DataFrame:
    """Sources (source, source_size, rows) with rank, weight and target.

    Targets share p.share of all words by weight; none is above p.repeats times its source's words, the rest is shared again by weight. Sources in order of what
    they hold by weight are full one after the other; the first that isn't tells the words a weight for all that follow.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(every) - 1
    weighed = sources.withColumn("rank", rank.cast("long")).withColumn("weight", F.get(F.array(*map(F.lit, p.weights)), (F.col("rank") % len(p.weights)).cast("int")))
    room = (p.repeats * F.col("source_size")).cast("double")
    by_room = Window.orderBy(room / F.col("weight"), "rank")
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    wanted = p.share * F.sum("source_size").over(whole)
    left = wanted - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("room", room).withColumn("level", left / weight)
    # From the first source with room for its share on, the level is that source's.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct(F.col("room") / F.col("weight"), "rank", "level"))
    found = level.withColumn("found", F.min(fits).over(whole)["level"])
    return found.select("source", "source_size", "rows", "rank", "weight", F.least(F.col("room"), F.coalesce(F.col("found") * F.col("weight"), F.col("room"))).alias("target"))


def quotas(aims: DataFrame, blocks: int, p: Params = Params()) -> DataFrame:
    """(rank, house, quota): blocks of each source when round(house * blocks / shards) blocks have been dealt, for house 1 to shards."""
    n, total = aims.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    houses = [(i, round(i * blocks / p.shards)) for i in range(1, p.shards + 1)]
    each = aims.withColumn("h", F.explode(F.array(*[F.struct(F.lit(i).alias("house"), F.lit(b).cast("long").alias("seats"), F.lit((b - n / 2) / total if total and b > n / 2 else 0.0).alias("low"), F.lit((b + n / 2) / total if total and b else 0.0).alias("high")) for i, b in houses])))
    each = each.select("rank", "target", "h.house", "h.seats", F.floor(F.col("target") * F.col("h.low") + 0.5 - 1e-9).alias("sure"), F.floor(F.col("target") * F.col("h.high") + 0.5 + 1e-9).alias("last"))
    each = each.withColumn("sure", F.greatest(F.lit(0), F.least("sure", "last")).cast("long"))
    open_seats = each.where("last > sure").select("rank", "house", F.explode(F.sequence("sure", F.col("last") - 1)).alias("seat"), "target")
    won = F.row_number().over(Window.partitionBy("house").orderBy(F.desc(F.col("target") / (2 * F.col("seat") + 1)), "rank", "seat"))
    left = each.groupBy("house").agg((F.first("seats") - F.sum("sure")).alias("left"))
    taken = open_seats.withColumn("won", won).join(F.broadcast(left), "house").where("won <= left").groupBy("rank", "house").agg(F.count(F.lit(1)).alias("more"))  # left: a row a shard
    return each.join(taken, ["rank", "house"], "left").select("rank", "house", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


def _copies(held: DataFrame) -> DataFrame:
    """A row for each of n rows alike, with its number `copy`; of very many alike in spans, which are dealt out before they become rows."""
    few, many = held.where(F.col("n") <= COPIES), held.where(F.col("n") > COPIES)
    spans = many.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("id", "source", "size", "span")
    first = F.col("span") * COPIES
    spread = spans.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("n"), first + COPIES) - 1))).drop("span")
    return few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).unionByName(spread).drop("n")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", p: Params = Params()) -> DataFrame:
    """A row for each row of docs: id_col, source, size, source_size, target, taken, spans.

    taken: words that the mix takes, repeats counted, p.repeats times size at most. spans: array of (shard, from, to), the word ranges that shards take, in
    their order. The words taken of a source differ from its target by about a block. Null is a source of its own, the last one; null and blank texts have
    no words and nothing is taken of them. Rows alike in id, source and size have places of their own, however many they are. The
    order hangs on the seed, ids, sizes and numbers of copies alone. Other columns of docs are ignored. An empty table gives no rows.
    """
    held = stage(entries(docs, id_col, text_col, source_col), "entries")
    sources = held.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    aims = stage(targets(sources, p), "targets")
    total = aims.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    dealt = quotas(aims, round(total / p.block), p)
    bounds = dealt.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("house", "quota"))), lambda h: h["quota"] * p.block).alias("bounds"))  # one number a shard
    of_source = stage(aims.join(bounds, "rank").withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS)), "sources")
    known = of_source.select(F.col("source").alias("s"), "rank", "buckets")
    key = F.md5(F.concat_ws("/", F.lit(str(p.seed)), F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("size").cast("string"), F.col("copy").cast("string")).cast("binary"))
    rows = _copies(held).withColumn("key", key)
    rows = rows.join(sized_broadcast(known), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = stage(rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2**32))).drop("buckets"), "rows")
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = sums.groupBy("rank", "span").agg(F.sum("words").alias("words"))
    base = F.sum("words").over(Window.partitionBy("rank").orderBy("span")) - F.col("words")
    inner = F.sum("words").over(Window.partitionBy("rank", "span").orderBy("bucket")) - F.col("words")
    offsets = sums.withColumn("inner", inner).join(spans.select("rank", "span", base.alias("base")), ["rank", "span"]).select("rank", "bucket", (F.col("base") + F.col("inner")).alias("offset"))
    place = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("key", "id", "size", "copy")) - F.col("size")
    placed = rows.withColumn("place", place).join(offsets, ["rank", "bucket"])
    placed = placed.join(sized_broadcast_numbers(of_source.select("rank", "source", "source_size", "target", "bounds"), p), "rank")
    start = F.col("place") + F.col("offset")
    ends = F.concat(F.array(F.lit(0).cast("long")), "bounds")
    turns = F.sequence(F.lit(0), F.lit(p.repeats * p.shards - 1))

    def span(turn):
        at, shard = start + F.floor(turn / p.shards) * F.col("source_size"), F.pmod(turn, F.lit(p.shards))
        return F.struct(shard.alias("shard"), F.greatest(F.lit(0).cast("long"), F.get(ends, shard) - at).alias("from"), F.least(F.col("size"), F.get(ends, shard + 1) - at).alias("to"))

    found = F.filter(F.transform(turns, span), lambda s: s["from"] < s["to"])
    out = placed.withColumn("spans", found)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "spans")


def sized_broadcast_numbers(of_source: DataFrame, p: Params) -> DataFrame:
    """Broadcast hint for sources with their bounds, if their measured rows are within the bound of broadcasts."""
    flat = of_source.select("rank", "source", "source_size", "target", *[F.get("bounds", F.lit(i)).alias(f"b{i}") for i in range(p.shards)])
    return sized_broadcast(flat).select("rank", "source", "source_size", "target", F.array(*[F.col(f"b{i}") for i in range(p.shards)]).alias("bounds"))


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from sized group by source
), weighed as (select *, [3, 1, 2][rank % 3 + 1] as weight, 2 * source_size::double as room from ranked),
levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(room) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from weighed window w as (order by room / weight, rank rows between unbounded preceding and 1 preceding)
), aims as (
  select source, source_size, rank, least(room, coalesce((select level from levels where level * weight <= room order by room / weight, rank limit 1) * weight, room)) as target from levels
), seats as (select rank, target, unnest(range(0, ceil(target / 16)::bigint + 2)) as seat from aims),
won as (select rank, row_number() over (order by target / (2 * seat + 1) desc, rank, seat) as r from seats where target > 0),
quotas as (select rank, count(*) * 16 as words from won where r <= (select round_even(sum(target) / 16, 0) from aims) group by rank),
copies as (select *, row_number() over (partition by source, doc_id, size) - 1 as copy from sized),
placed as (
  select c.doc_id, c.size, a.source_size, a.target, coalesce(q.words, 0) as words,
    sum(c.size) over (partition by a.rank order by md5(concat_ws('/', '23', coalesce(c.doc_id::varchar, '-'), c.size::varchar, c.copy::varchar)), c.doc_id, c.size, c.copy) - c.size as place
  from copies c join aims a on c.source is not distinct from a.source left join quotas q using (rank)
)
select doc_id, size, source_size, target, (greatest(0, least(size, words - place)) + greatest(0, least(size, words - source_size - place)))::bigint as taken from placed
"""
