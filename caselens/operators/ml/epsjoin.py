"""Points at most eps apart, exactly, for vectors of many components.

Points are dealt to cells by their nearest pivot. A point also goes, as a guest, to every cell whose border is eps or less away from it: the border
between two pivots is a plane, and the distance to it follows from the distances to the two. So whatever lies within eps of a point is in the
point's own cell, at home or as a guest. Cells that hold too many points are split again by pivots of their own; pivots are few for each
cell, whatever its size. A split is first tried on a few rows of the cell: where points are so evenly spread, or eps is so wide, that it would copy more
than it saves, the cell is cut into blocks instead, and every two blocks meet once. A task never holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.plans.graphs import few, kept

#: Points of a cell, or a block of one, that a task holds against another, and bytes of their components.
CELL, BYTES = 32_768, 32 << 20
#: Blocks that a cell is cut into if they still hold PIECE points, so that several tasks share it.
SHARED = 6
#: Pivots of a split at most; points that meet a cell's pivots in a task; share of a cell that a part must leave behind.
FAN, PIECE, LEFT = 32, 4096, 0.3
#: Rows of a cell that a split is tried on; share of a cell's comparisons that it may leave, and times as many rows as without it.
TRIED, WORK, COPIES = 2048, 0.5, 2.0


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


def _slack(x: np.ndarray, y: np.ndarray, unit: float = 1e-12) -> float:
    """What a squared distance by products may be off by."""
    return unit * (1 + (x * x).sum(axis=1).max(initial=0) + (y * y).sum(axis=1).max(initial=0)) * x.shape[1]


def within(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) where x[i] and y[j] are at most eps apart, a tile at a time: found by products, in single precision where that is near enough, and computed by components where these leave doubt."""
    if not len(x) or not len(y):
        return
    centre = y.mean(axis=0)
    u, w = x - centre, y - centre
    single = 1e-6 * (1 + (u * u).sum(axis=1).max() + (w * w).sum(axis=1).max()) * x.shape[1] <= eps * eps / 16
    slack = _slack(u, w, 1e-6 if single else 1e-12) + _slack(x, y)
    kind = np.float32 if single else np.float64
    left = np.column_stack([-2 * u, (u * u).sum(axis=1), np.ones(len(u))]).astype(kind)
    right = np.column_stack([w, np.ones(len(w)), (w * w).sum(axis=1)]).astype(kind)
    for at in range(0, len(x), 512):
        for to in range(0, len(y), 4096):
            square = left[at : at + 512] @ right[to : to + 4096].T
            i, j = np.nonzero(square <= kind(eps * eps + slack))
            sure = square[i, j] < eps * eps - slack
            doubt = np.flatnonzero(~sure)
            for some in range(0, len(doubt), 65_536):
                d = doubt[some : some + 65_536]
                sure[d] = ((x[at + i[d]] - y[to + j[d]]) ** 2).sum(axis=1) <= eps * eps
            yield at + i[sure], to + j[sure]


def _border(x: np.ndarray, p: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of pivots p for each x, and which of their cells it belongs to, at home or as a guest."""
    square, gaps = _squares(x, p), np.sqrt(_squares(p, p))
    nearest = square.argmin(axis=1)
    apart = 2 * gaps[nearest]
    border = (square - square[np.arange(len(x)), nearest][:, None]) / np.where(apart > 0, apart, 1)
    return nearest, (border <= eps * (1 + 1e-9) + _slack(x, p) / np.where(apart > 0, apart, 1)) | (apart <= 0)


def _pivots(members: DataFrame, full: DataFrame, eps: float, seed: int) -> DataFrame:
    """(cell, m, pivots) of the full cells (cell, m, h) for which a split pays, by what it does to TRIED of their rows."""
    lot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = members.join(few(full), "cell").withColumn("k", F.least(F.lit(FAN), F.ceil(2 * F.col("m") / CELL) + 1)).withColumn("lot", lot)
    drawn = drawn.withColumn("tried", F.col("lot") * F.col("m") <= TRIED).where(F.col("tried") | (F.col("home") & (F.col("lot") * F.col("h") <= 8 * F.col("k") + 64)))

    cell, most = CELL, BYTES

    def cuts(m, dims: int):
        return np.maximum(1, np.maximum(np.ceil(m / cell), np.ceil(m * dims * 8 / most)))

    def choose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lot", "ascending"), ("id", "ascending")])
        m, k = rows["m"][0].as_py(), rows["k"][0].as_py()
        x, home, tried = _matrix(rows["v"]), rows["home"].to_numpy(), rows["tried"].to_numpy()
        p = x[np.flatnonzero(home)[:k]]
        found = pa.table({"cell": rows["cell"].slice(0, 1), "m": rows["m"].slice(0, 1), "pivots": pa.array([p.tolist()], pa.list_(pa.list_(pa.float64())))})
        if len(p) < 2 or not tried.any():
            return found.slice(0, 0)
        nearest, inside = _border(x, p, eps)
        parts = m * inside[tried].mean(axis=0)
        homes = np.bincount(nearest[home], minlength=len(p)) / home.sum()
        copies = (parts * cuts(parts, x.shape[1])).sum() / (m * cuts(m, x.shape[1]))
        return found if (homes * parts).sum() <= WORK * m and copies <= COPIES else found.slice(0, 0)

    return drawn.select("cell", "id", "v", "home", "m", "k", "lot", "tried").groupBy("cell").applyInArrow(choose, "cell string, m long, pivots array<array<double>>")


def _split(members: DataFrame, pivots: DataFrame, eps: float) -> DataFrame:
    """Members of cells (cell, m, pivots) in the cells of pivots of their own."""
    id_field = members.schema["id"]
    dealt = pivots.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / PIECE))))
    pieces = members.join(few(pivots.select("cell", "m")), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.floor(F.col("m") / PIECE) + 1))
    schema = T.StructType([T.StructField("cell", T.StringType()), id_field, T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("weight", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("above", T.LongType())])

    def deal(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        x, p = _matrix(rows["v"]), np.array(chosen["pivots"][0].as_py())
        nearest, inside = _border(x, p, eps)
        i, j = np.nonzero(inside)
        taken, name = rows.take(pa.array(i)), rows["cell"][0].as_py()
        home = taken["home"].to_numpy() & (nearest[i] == j)
        return pa.Table.from_arrays([pa.array([f"{name}.{k}" for k in range(len(p))]).take(pa.array(j)), taken["id"], taken["v"], taken["weight"], pa.array(home), taken["m"]], names=schema.names)

    columns = ["cell", "id", "v", "weight", "home", "m", "piece"]
    return pieces.select(*columns).groupBy("cell", "piece").cogroup(dealt.select("cell", "piece", "pivots").toDF("of", "part", "pivots").groupBy("of", "part")).applyInArrow(deal, schema)


def cells(points: DataFrame, eps: float, seed: int = 11) -> DataFrame:
    """(cell, id, v, weight, home) of points (id, v, weight): each once at home, and as a guest wherever it may be within eps of one at home."""
    members = kept(points.select(F.lit("c").alias("cell"), "id", F.col("v").cast("array<double>").alias("v"), F.col("weight").cast("long").alias("weight"), F.lit(True).alias("home"), F.lit(1 << 62).alias("above")))
    done = []
    while True:
        sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("h"), F.first("above").alias("above"))
        full = kept(sizes.where((F.col("m") > CELL) & (F.col("h") > 1) & (F.col("m") <= (1 - LEFT) * F.col("above"))).select("cell", "m", "h"))
        pivots = full if full.isEmpty() else kept(_pivots(members, full, eps, seed + len(done)))
        if pivots.isEmpty():
            done.append(members)
            every = reduce(DataFrame.unionByName, done)
            return every.join(every.where("home").select("cell").distinct(), "cell", "left_semi").drop("above")
        names = few(pivots.select("cell"))
        done.append(members.join(names, "cell", "left_anti"))
        members = kept(_split(members.join(names, "cell", "left_semi").drop("above"), pivots, eps))


def blocks(members: DataFrame) -> DataFrame:
    """Members with i and j, the pair of blocks in which they meet, and own, the block they are of."""
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max(F.size("v")).alias("dims"))
    cuts = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("m") / CELL), F.ceil(F.col("m") * F.col("dims") * 8 / BYTES), F.least(F.lit(SHARED), F.floor(F.col("m") / PIECE))).cast("int").alias("cuts"))
    held = members.join(cuts, "cell").withColumn("own", F.pmod(F.xxhash64("id"), "cuts").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    return held.withColumn("at", F.explode(others)).select(*members.columns, "own", "at.*")


def meet(members: DataFrame, eps: float, found: Callable[[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]], pa.Table], schema: T.StructType) -> DataFrame:
    """What `found` makes of each task's points and the pairs of places (p, q), p at home, of points within eps, its own place included; each pair comes once."""

    def run(rows: pa.Table) -> pa.Table:
        x, home, first = _matrix(rows["v"]), rows["home"].to_numpy(), (pa.compute.equal(rows["own"], rows["i"])).to_numpy()
        alone = rows["i"][0].as_py() == rows["j"][0].as_py()

        def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            here, there = (np.flatnonzero(k) for k in (first, first if alone else ~first))
            mine, guests = here[home[here]], here[~home[here]]
            for i, j in within(x[mine], x[there], eps):
                p, q = mine[i], there[j]
                yield p, q
                if not alone:
                    back = home[q]
                    yield q[back], p[back]
            if not alone:
                theirs = there[home[there]]
                for i, j in within(x[theirs], x[guests], eps):
                    yield theirs[i], guests[j]

        return found(rows, near())

    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a task's work grows with the square of its bytes, by which it might be merged with others
    return blocks(members).repartition(spread, "cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(run, schema)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column in order, and the number of each row's."""
    return np.unique(np.array(column.to_pylist()), return_inverse=True)


def pairs(points: DataFrame, eps: float) -> DataFrame:
    """(a, b) of points (id, v) with a < b at most eps apart, each once. A dense group of points has the square of its size in pairs."""
    kind = points.schema["id"].dataType

    def emit(rows: pa.Table, near) -> pa.Table:
        order, at = _codes(rows["id"])[1], [[], []]
        for p, q in near:
            once = order[p] < order[q]
            at[0].append(p[once])
            at[1].append(q[once])
        a, b = (pa.array(np.concatenate(k).astype(np.int64)) if k else pa.array([], pa.int64()) for k in at)
        return pa.Table.from_arrays([rows["id"].take(a), rows["id"].take(b)], names=["a", "b"])

    return meet(cells(points.withColumn("weight", F.lit(1)), eps), eps, emit, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def around(members: DataFrame, eps: float) -> DataFrame:
    """(id, around): the weight within eps of each point at home, its own included."""

    def count(rows: pa.Table, near) -> pa.Table:
        weight, total = rows["weight"].to_numpy(), np.zeros(len(rows), np.int64)
        for p, q in near:
            total += np.bincount(p, weight[q], len(rows)).astype(np.int64)
        some = pa.array(rows["home"].to_numpy())
        return pa.Table.from_arrays([rows["id"].filter(some), pa.array(total).filter(some)], names=["id", "around"])

    busy = members.join(members.where("home").select("cell").distinct(), "cell", "left_semi")
    return meet(busy, eps, count, T.StructType([members.schema["id"], T.StructField("around", T.LongType())])).groupBy("id").agg(F.sum("around").alias("around"))


def links(members: DataFrame, eps: float) -> DataFrame:
    """(id, other, inner) of members with `label`, that of the group a core point is known to belong to, null for others: a forest of links between groups
    near each other (inner), and the groups near each point that isn't core.

    A point that isn't core has fewer around it than make one, so there are less of these than members times that number, however dense they are.
    """
    kind = members.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("other", kind), T.StructField("inner", T.BooleanType())])

    def join(rows: pa.Table, near) -> pa.Table:
        core = rows["label"].is_valid().to_numpy()
        names, own = _codes(pa.compute.coalesce(rows["label"], rows["id"]))
        group, border = np.arange(len(names)), []
        for p, q in near:
            p, q = p[core[q]], q[core[q]]
            edge = ~core[p]
            border.append(np.unique(p[edge] * len(names) + own[q[edge]]))
            a, b = group[own[p[~edge]]], group[own[q[~edge]]]
            both = np.unique(a[a != b] * len(names) + b[a != b])
            a, b = both // len(names), both % len(names)
            while len(a):  # the lowest group around, then its own, until all that is linked is one
                low = group.copy()
                np.minimum.at(low, a, group[b])
                np.minimum.at(low, b, low[a])
                while (low[low] != low).any():
                    low = low[low]
                group = low[group]
                a, b = group[a], group[b]
                a, b = a[a != b], b[a != b]
        moved = np.flatnonzero(group != np.arange(len(names)))
        at = np.unique(np.concatenate(border)) if border else np.zeros(0, np.int64)
        kind, some = rows["id"].type, at // len(names)
        first = pa.concat_arrays([pa.array(names[moved].tolist(), kind), pa.array(rows["id"].take(pa.array(some)).to_pylist(), kind)])
        second = pa.array(names[np.concatenate([group[moved], at % len(names)])].tolist(), kind)
        return pa.Table.from_arrays([first, second, pa.array(np.arange(len(first)) < len(moved))], names=schema.names)

    busy = members.groupBy("cell").agg(F.max("home").alias("any"), F.max(F.col("label").isNull()).alias("none"), F.min("label").alias("low"), F.max("label").alias("high")).where("any and (low < high or low is not null and none)")
    return meet(members.join(busy.select("cell"), "cell", "left_semi"), eps, join, schema)
