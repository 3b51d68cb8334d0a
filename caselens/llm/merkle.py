"""Merkle manifest of a table: a tree of SHA-256 hashes whose parents keep the state of their hash before each child.

Every row is a leaf, leaves of a group make a tree, the roots of the groups make another. A child's digest as hex text is 64 bytes, one
block of SHA-256, so the state of a parent's hash before child k is eight words: what it was when k children had gone in. The manifest holds
these states. To fold a changed leaf to the root, the state before its place is taken up, the new digest and the siblings to its right go in; those to its
left are in the state already. The proof of a row, the hash of all siblings on its way, is carried from level to level as a state as well.

Leaves are numbered in the order of their group by ranges: sorted parts, and a running sum over the counts of parts. A chunk of arity ** levels leaves
is a task's piece and a row of the manifest with all its digests and states; its root is a leaf of the next pass, until each group has one. For folding,
a chunk's leaves meet its row and one way up to the root. Hashes run over whole columns of digests at once, in numpy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import crc32_sql, read_table, sized_broadcast, stage

#: Rows of a range that numbers are counted in.
PART_ROWS = 20_000


@dataclass(frozen=True)
class Params:
    """arity: children of a parent; levels: of a chunk, which has arity ** levels leaves."""

    arity: int = 2
    levels: int = 12

    @property
    def chunk(self) -> int:
        return self.arity**self.levels


@cache
def constants() -> tuple[np.ndarray, np.ndarray]:
    """SHA-256's first state and round constants: fractions of the square and cube roots of the first primes."""
    primes = [n for n in range(2, 312) if all(n % d for d in range(2, math.isqrt(n) + 1))]

    def cube_root(n: int) -> int:
        x = 1 << (n.bit_length() // 3 + 1)
        while (y := (2 * x + n // (x * x)) // 3) < x:
            x = y
        return x

    first = [math.isqrt(q << 64) & 0xFFFFFFFF for q in primes[:8]]
    return np.array(first, np.uint32)[:, None], np.array([cube_root(q << 96) & 0xFFFFFFFF for q in primes], np.uint32)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def taken_in(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) of hashes after a block (16, n) each; n may be 1 on either side."""
    rounds, w = constants()[1], list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for k, word in zip(rounds, w, strict=True):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + k + word
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h)) + state


def hex_block(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as blocks (16, n) of lowercase hex text."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    for half, at in ((digest >> np.uint32(16), 0), (digest & np.uint32(0xFFFF), 1)):
        x = ((half & np.uint32(0xF000)) << np.uint32(12)) | ((half & np.uint32(0xF00)) << np.uint32(8)) | ((half & np.uint32(0xF0)) << np.uint32(4)) | (half & np.uint32(0xF))
        letter = ((x + np.uint32(0x06060606)) >> np.uint32(4)) & np.uint32(0x01010101)
        out[at::2] = x + np.uint32(0x30303030) + letter * np.uint32(0x27)
    return out


def ended(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of hashes that have taken in so many whole blocks."""
    bits = np.asarray(blocks, np.uint64).reshape(1, -1) * np.uint64(512)
    last = np.zeros((16, bits.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[14], last[15] = (bits >> np.uint64(32)).astype(np.uint32)[0], (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)[0]
    return taken_in(state, last)


def _words(digests: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(digests, ">u4").astype(np.uint32).reshape(-1, 8).T)


def _bytes(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def _rows(digests: np.ndarray) -> pa.Array:
    n, raw = digests.shape[1], _bytes(digests)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 32 * n + 1, 32, dtype=np.int32).tobytes()), pa.py_buffer(raw)])


def _first(n: int) -> np.ndarray:
    return np.repeat(constants()[0], n, axis=1)


def counts_of(n: int, whole: bool, p: Params) -> list[int]:
    """Nodes of each level over n leaves of a chunk: p.levels levels where the tree goes on above it, else until one is left."""
    counts = [n]
    while len(counts) <= p.levels if whole else counts[-1] > 1:
        counts.append(-(-counts[-1] // p.arity))
    return counts


def grown(leaves: np.ndarray, counts: list[int], p: Params) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(digests of each level, states of each level above the leaves): states (8, parents * arity) before each child."""
    digests, states = [leaves], []
    for n in counts[1:]:
        own = np.zeros((8, n, p.arity), np.uint32)
        state, size = _first(n), np.minimum(p.arity, digests[-1].shape[1] - np.arange(n) * p.arity)
        for k in range(p.arity):
            own[:, :, k] = state
            has = size > k
            state[:, has] = taken_in(state[:, has], hex_block(digests[-1][:, k :: p.arity]))
        digests.append(ended(state, size))
        states.append(own.reshape(8, -1))
    return digests, states


class Fold:
    """Digests on their way up, with the states of their proofs."""

    def __init__(self, digest: np.ndarray):
        self.digest, self.proof, self.blocks = digest, _first(digest.shape[1]), np.zeros(digest.shape[1], np.int64)

    def up(self, state: np.ndarray, slot: np.ndarray, size: np.ndarray, sibling) -> None:
        """One level: state before the slot, size of the run; sibling(k, where) has the digests of children k of the runs at where."""
        own = taken_in(state, hex_block(self.digest))
        for k in range(int(size.max())):
            left, right = np.flatnonzero(k < slot), np.flatnonzero((k > slot) & (k < size))
            for where in (left, right):
                if len(where):
                    block = hex_block(sibling(k, where))
                    self.proof[:, where] = taken_in(self.proof[:, where], block)
                    self.blocks[where] += 1
                    if where is right:
                        own[:, where] = taken_in(own[:, where], block)
        self.digest = ended(own, size)


def field(column: Column) -> Column:
    """A value as its length in bytes, a colon and itself; `-` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with pos, their place in their group by order, and size, the rows of the group. The group isn't null. Groups may have any size."""
    n = df.count()
    parts = stage(df.repartitionByRange(max(1, -(-n // PART_ROWS)), group, *order).withColumn("part", F.spark_partition_id()), "parts")
    counts = parts.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")
    offsets = counts.select("part", group, before.alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    place = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)) - 1
    return stage(parts.withColumn("place", place).join(sized_broadcast(offsets), ["part", group]).withColumn("pos", F.col("place") + F.col("before")).drop("place", "before", "part"), "numbered")


PIECE = "tree string, chunk long, size long, count long, digest binary, digests binary, states binary"


def _passes(nodes: DataFrame, p: Params) -> list[DataFrame]:
    """Chunks of trees over nodes (tree, pos, size, digest), a table for each pass: the chunks of a pass are the nodes of the next."""

    def grow(table: pa.Table) -> pa.Table:
        at = np.argsort(table["pos"].to_numpy())
        own = _words(b"".join(table["digest"].to_pylist()))[:, at]
        size, n = table["size"][0].as_py(), len(at)
        digests, states = grown(own, counts_of(n, size > p.chunk, p), p)
        row = {"tree": table["tree"][0].as_py(), "chunk": int(table["pos"].to_numpy()[0]) // p.chunk, "size": size, "count": n, "digest": _bytes(digests[-1])}
        row |= {"digests": b"".join(map(_bytes, digests)), "states": b"".join(map(_bytes, states))}
        return pa.Table.from_pylist([row], pa.schema([("tree", pa.string()), ("chunk", pa.int64()), ("size", pa.int64()), ("count", pa.int64()), ("digest", pa.binary()), ("digests", pa.binary()), ("states", pa.binary())]))

    passes = []
    while True:
        groups = nodes.select("tree", "pos", "size", "digest").groupBy("tree", F.floor(F.col("pos") / p.chunk).alias("piece"))
        passes.append(stage(groups.applyInArrow(grow, PIECE), "chunks"))
        more = passes[-1].where(F.col("size") > p.chunk)
        if more.isEmpty():
            return passes
        nodes = more.select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("size") / p.chunk).alias("size"), "digest")


def _layers(digests: bytes, states: bytes, count: int, whole: bool, p: Params) -> tuple[list[np.ndarray], list[np.ndarray]]:
    counts = counts_of(count, whole, p)
    d, s = np.cumsum([0, *counts]), np.cumsum([0, *(n * p.arity for n in counts[1:])])
    flat, kept = _words(digests), _words(states) if states else np.zeros((8, 0), np.uint32)
    return [flat[:, a:b] for a, b in zip(d[:-1], d[1:], strict=True)], [kept[:, a:b] for a, b in zip(s[:-1], s[1:], strict=True)]


STEPS = "array<struct<slot:int,size:int,state:binary,siblings:binary>>"


def _ways(pieces: DataFrame, p: Params) -> DataFrame:
    """(tree, pos, chunk, steps): of every leaf of chunks, its way to the chunk's root; a step has the state before it and all children of its parent."""
    schema = T._parse_datatype_string(f"tree string, pos long, chunk long, steps {STEPS}")
    step = pa.list_(pa.struct([("slot", pa.int32()), ("size", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())]))

    def ways(batches):
        for batch in batches:
            for row in batch.to_pylist():
                digests, states = _layers(row["digests"], row["states"], row["count"], row["size"] > p.chunk, p)
                steps = []
                for at in range(row["count"]):
                    own, i = [], at
                    for level, state in enumerate(states):
                        up = i // p.arity
                        children = digests[level][:, up * p.arity : (up + 1) * p.arity]
                        own.append({"slot": i % p.arity, "size": children.shape[1], "state": _bytes(state[:, i : i + 1]), "siblings": _bytes(children)})
                        i = up
                    steps.append(own)
                n = row["count"]
                pos = np.arange(n) + row["chunk"] * p.chunk
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n), pa.array(pos, pa.int64()), pa.array([row["chunk"]] * n, pa.int64()), pa.array(steps, step)], names=["tree", "pos", "chunk", "steps"])

    return pieces.mapInArrow(ways, schema)


def _above(passes: list[DataFrame], p: Params, start: int) -> DataFrame | None:
    """(tree, pos, steps): ways from the nodes of pass `start` to the roots of their trees; None if there is no such pass."""
    ways = None
    for pieces in reversed(passes[start:]):
        own = _ways(pieces, p)
        if ways is not None:
            upper = ways.select("tree", F.col("pos").alias("chunk"), F.col("steps").alias("more"))
            own = own.join(upper, ["tree", "chunk"], "left").withColumn("steps", F.concat("steps", F.coalesce("more", F.array().cast(STEPS))))
        ways = own.select("tree", "pos", "steps")
    return ways


@dataclass
class Manifest:
    """passes: chunks of the groups' trees; top: those of the tree over their roots; ways: (tree, chunk, subroot, steps to the root); root: None without rows."""

    passes: list[DataFrame]
    top: list[DataFrame]
    ways: DataFrame
    root: bytes | None


def manifest(nodes: DataFrame, p: Params = Params()) -> Manifest:
    """The manifest of leaves (tree, pos, size, digest); trees are ordered by their names."""
    passes = _passes(nodes, p)
    roots = None
    for pieces in passes:
        own = pieces.where(F.col("size") <= p.chunk).select("tree", "digest")
        roots = own if roots is None else roots.union(own)
    ordered = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"])
    top = _passes(ordered, p)
    last = top[-1].where(F.col("size") <= p.chunk).select("digest").first()
    to_root = _above(top, p, 0).join(ordered.select("pos", "name", F.col("digest").alias("subroot")), "pos").select(F.col("name").alias("tree"), "subroot", F.col("steps").alias("last"))
    ways = passes[0].select("tree", "chunk").join(to_root, "tree")
    above, none = _above(passes, p, 1), F.array().cast(STEPS)
    if above is not None:
        ways = ways.join(above.withColumnRenamed("pos", "chunk"), ["tree", "chunk"], "left").withColumn("last", F.concat(F.coalesce("steps", none), "last"))
    return Manifest(passes, top, ways.select("tree", "chunk", "subroot", F.col("last").alias("steps")), last["digest"] if last else None)


def folded(leaves: DataFrame, held: Manifest, p: Params = Params()) -> DataFrame:
    """Leaves (id, tree, pos, size, digest, changed) with subroot, proof and folded: the root that follows from changed, or else digest, and the manifest."""
    ids = leaves.schema["id"].dataType
    schema = T.StructType([T.StructField("id", ids), *(T.StructField(c, T.BinaryType()) for c in ("digest", "subroot", "proof", "folded"))])

    def fold(own: pa.Table, piece: pa.Table) -> pa.Table:
        row = piece.to_pylist()[0]
        digests, states = _layers(row["digests"], row["states"], row["count"], row["size"] > p.chunk, p)
        kept = own["digest"].to_pylist()
        way = Fold(_words(b"".join(c or d for c, d in zip(own["changed"].to_pylist(), kept, strict=True))))
        at = own["pos"].to_numpy() - row["chunk"] * p.chunk
        for level, state in enumerate(states):
            up, slot = at // p.arity, at % p.arity
            size = np.minimum(p.arity, digests[level].shape[1] - up * p.arity)
            way.up(state[:, at], slot, size, lambda k, where, up=up, level=level: digests[level][:, up[where] * p.arity + k])
            at = up
        for step in row["steps"]:
            children = _words(step["siblings"])
            slot, size = np.full(len(kept), step["slot"]), np.full(len(kept), step["size"])
            way.up(np.repeat(_words(step["state"]), len(kept), axis=1), slot, size, lambda k, where, c=children: np.repeat(c[:, k : k + 1], len(where), axis=1))
        subroot = pa.array([row["subroot"]] * len(kept), pa.binary())
        return pa.Table.from_arrays([own["id"], pa.array(kept, pa.binary()), subroot, _rows(ended(way.proof, way.blocks)), _rows(way.digest)], names=schema.names)

    pieces = held.passes[0].join(held.ways, ["tree", "chunk"]).select("tree", "chunk", "size", "count", "digests", "states", "subroot", "steps")
    groups = leaves.withColumn("chunk", F.floor(F.col("pos") / p.chunk)).select("id", "pos", "digest", "changed", "tree", "chunk").groupBy("tree", "chunk")
    return groups.cogroup(pieces.groupBy("tree", "chunk")).applyInArrow(fold, schema)


def verified(docs: DataFrame, columns: list[str], changed: dict[str, Column], id_col: str = "doc_id", group_col: str = "lang", p: Params = Params()) -> DataFrame:
    """A row for each row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of columns, in their order. Trees are of the rows with the same group_col, ordered by id_col (null first) and leaf; null is a
    group of its own, the first one. changed: columns as they are found to be now; where they differ from what they were, folded_root isn't root. Rows
    alike are leaves of their own, one after the other, in any order. Other columns of docs are ignored. An empty table gives no rows.
    """
    was = [F.col(f"`{c}`") for c in columns]
    now = [changed.get(c, F.col(f"`{c}`")) for c in columns]
    differs = F.lit(False)
    for c, value in changed.items():
        differs = differs | ~F.col(f"`{c}`").eqNullSafe(value)
    group = F.col(f"`{group_col}`").cast("string")
    tree = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("id"), tree.alias("tree"), leaf(*was).alias("digest"), F.when(differs, leaf(*now)).alias("changed"), F.rand(1).alias("salt")), "leaves")
    leaves = numbered(rows, "tree", ["id", "digest", "salt"])
    held = manifest(leaves, p)
    found = folded(leaves, held, p)

    def text(c: str | Column) -> Column:
        return F.lower(F.hex(c))

    root = F.lit(held.root).cast("binary")
    return found.select(F.col("id").alias(id_col), text("digest").alias("leaf"), text("subroot").alias("subroot"), text(root).alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    n, hit = F.col("n_chars"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return verified(docs, docs.columns, {"n_chars": F.when(hit, n + 1).otherwise(n)})


OP11_SQL = rf"""
with recursive marked as (
  select *, coalesce({crc32_sql('doc_id::varchar')} % 7 = 0, false) as hit, coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-') || coalesce(strlen(lang)::varchar || ':' || lang, '-') as a,
    coalesce(strlen(text)::varchar || ':' || text, '-') as z from documents
), hashed as (
  select doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') || z) as leaf,
    sha256(a || coalesce(strlen((n_chars + hit::int)::varchar)::varchar || ':' || (n_chars + hit::int)::varchar, '-') || z) as now from marked
), leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from hashed),
levels as (
  select lang, 0 as level, list(leaf order by pos) as nodes from leaves group by lang
  union all select lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) from levels where len(nodes) > 1
), subroots as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as pos, max(level) over () as depth from levels where len(nodes) = 1),
top as (
  select 0 as level, list(subroot order by pos) as nodes from subroots
  union all select level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) from top where len(nodes) > 1
), up as (
  select doc_id, lang, leaf, 0 as level, pos, now as node, '' as proof from leaves
  union all select doc_id, u.lang, leaf, u.level + 1, u.pos // 2, sha256(case when u.pos % 2 = 0 then node || coalesce(nodes[u.pos + 2], '') else nodes[u.pos] || node end), proof || coalesce(case when u.pos % 2 = 0 then nodes[u.pos + 2] else nodes[u.pos] end, '')
  from up u join levels l on u.lang is not distinct from l.lang and u.level = l.level where len(nodes) > 1
), at_subroot as (select u.doc_id, u.lang, u.leaf, s.subroot, s.pos, u.node, u.proof from up u join levels l on u.lang is not distinct from l.lang and u.level = l.level and len(l.nodes) = 1 join subroots s on s.lang is not distinct from u.lang),
over as (
  select doc_id, leaf, subroot, 0 as level, pos, node, proof from at_subroot
  union all select doc_id, leaf, subroot, o.level + 1, o.pos // 2, sha256(case when o.pos % 2 = 0 then node || coalesce(nodes[o.pos + 2], '') else nodes[o.pos] || node end), proof || coalesce(case when o.pos % 2 = 0 then nodes[o.pos + 2] else nodes[o.pos] end, '')
  from over o join top t on o.level = t.level where len(nodes) > 1
)
select doc_id, leaf, subroot, nodes[1] as root, sha256(proof) as proof_sha256, node as folded_root, node = nodes[1] as verified
from over o join top t on o.level = t.level and len(nodes) = 1
"""
