"""Tables of limits, and the limit that holds for a row: by its keys, by a number that lies in a band, and on a day.

A table has key columns, `limit`, and, as it needs them, low (inclusive) and high (exclusive), valid_from and valid_to (both inclusive); null is unbounded. A row
without a number or a key has no limit, one without a day those that always hold. Where several rows hold, the one that has been valid for the shortest time does, then the one with the highest low, then the smallest limit.

A small table is one broadcast row for each key, with its bands in order. In a large one the bands are ranked, and numbers are cut into chunks; a chunk meets the
bands that begin or end in it, and of those that span it the best of each pair of days. There every band stands in a few nodes of a tree of intervals, and a lookup
goes up its nodes; in each it finds the latest band by its day, so no lookup meets all bands that hold for it. Only distinct lookups are joined, so rows neither
multiply nor are lost.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.operators.textbatch import numbered
from caselens.plans.graphs import few, kept

#: Rows of a table, and of one key, up to which it is broadcast.
SMALL, BANDS = 20_000, 256
#: Lookups and ends of bands in a chunk.
CHUNK = 1_000_000
#: Days that stand for no bound.
EVER, NEVER = -(1 << 30), 1 << 30


@dataclass(frozen=True)
class Lookup:
    """A limit for rows: table, (expression, key column) pairs, the column with the number, and the one with the day."""

    table: DataFrame
    keys: tuple[tuple[str, str], ...] = ()
    value: str | None = None
    at: str | None = None


def of_rows(spark: SparkSession, columns: str, rows: Iterable[tuple]) -> DataFrame:
    """A small table of values; columns as in a schema."""
    names = [c.split()[0] for c in columns.split(", ")]
    made = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, row, strict=True)]) for row in rows])
    kinds = [c.split()[1] for c in columns.split(", ")]
    return spark.range(1, numPartitions=1).select(F.inline(made)).select(*[F.col(c).cast(k) for c, k in zip(names, kinds, strict=True)])


def _whole(look: Lookup) -> DataFrame:
    """The table with every column there may be; bounds as numbers, days as dates."""
    have = look.table.columns
    column = {c: F.col(c) if c in have else F.lit(None) for c in ("low", "high", "valid_from", "valid_to")}
    keys = [F.col(k).alias(f"__k{i}") for i, (_, k) in enumerate(look.keys)]
    return look.table.select(*keys, column["low"].cast("double").alias("low"), column["high"].cast("double").alias("high"), column["valid_from"].cast("date").alias("valid_from"), column["valid_to"].cast("date").alias("valid_to"), "limit")


def _holds(band: Column, value: Column | None, at: Column | None) -> Column:
    hit = F.lit(True)
    if value is not None:
        hit = hit & (band["low"].isNull() | (value >= band["low"])) & (band["high"].isNull() | (value < band["high"])) & value.isNotNull()
    if at is not None:
        hit = hit & (band["valid_from"].isNull() | (at >= band["valid_from"])) & (band["valid_to"].isNull() | (at <= band["valid_to"]))
    return hit


def _order() -> Column:
    """Where several hold, the first by this."""
    return F.struct((-F.coalesce(F.unix_date("valid_from"), F.lit(EVER))).alias("since"), (-F.coalesce("low", F.lit(-1e300))).alias("low"), F.col("limit").cast("string").alias("text"))


def is_small(look: Lookup, rows: int | None = None) -> bool:
    """Whether a table has SMALL rows at most, and BANDS of a key."""
    rows = SMALL if rows is None else rows
    if look.table.limit(rows + 1).count() > rows:
        return False
    most = _whole(look).groupBy(*[f"__k{i}" for i in range(len(look.keys))]).count().agg(F.max("count")).first()[0] or 0
    return most <= BANDS


def with_limit(df: DataFrame, name: str, look: Lookup, small: bool | None = None) -> DataFrame:
    """df with the limit that holds for each of its rows in column `name`, null where none does. small: None to measure the table."""
    if small is None:
        small = is_small(look)
    value = F.col(look.value).cast("double") if look.value else None
    at = F.col(look.at).cast("date") if look.at else None
    table, ks = _whole(look), [f"__k{i}" for i in range(len(look.keys))]
    if small:
        bands = F.array_sort(F.collect_list(F.struct(_order().alias("order"), "low", "high", "valid_from", "valid_to", "limit"))).alias("__bands")
        grouped = table.groupBy(*ks).agg(bands).where("size(__bands) > 0") if ks else table.agg(bands)
        met = df.join(F.broadcast(grouped), [F.expr(c) == F.col(k) for (c, _), k in zip(look.keys, ks, strict=True)], "left") if ks else df.crossJoin(F.broadcast(grouped))  # one row
        return met.withColumn(name, F.get(F.filter("__bands", lambda b: _holds(b, value, at)), F.lit(0))["limit"]).drop("__bands", *ks)
    return _searched_limits(df, name, look, table.withColumn("__order", _order()), ks, value, at)


def _searched_limits(df: DataFrame, name: str, look: Lookup, table: DataFrame, ks: list[str], value: Column | None, at: Column | None) -> DataFrame:
    """with_limit by a large table: __k0 .. as its keys, __order as what decides among its rows."""
    if value is not None:
        table = table.where("low is null or high is null or low < high")
    ranked = kept(numbered(table.dropna(subset=ks) if ks else table, "__order").drop("__order"))
    mine = df.withColumn("__key", F.lit(0).cast("long"))
    if ks:
        keys = kept(ranked.select(*ks).distinct().withColumn("__id", F.monotonically_increasing_id()))
        ranked = ranked.join(few(keys), ks)
        mine = df.join(few(keys), [F.expr(c) == F.col(k) for (c, _), k in zip(look.keys, ks, strict=True)], "left").withColumn("__key", F.col("__id")).drop("__id", *ks)
    else:
        ranked = ranked.withColumn("__id", F.lit(0).cast("long"))
    x = value + F.lit(0.0) if value is not None else F.lit(0.0)  # -0.0 and 0.0 are one number
    mine = mine.withColumns({"__x": x, "__at": F.unix_date(at) if at is not None else F.lit(0)})
    asked = kept(mine.where("__key is not null and __x is not null").select("__key", "__x", "__at").distinct())
    none = F.lit(None).cast("double")
    low, high = (F.col("low"), F.col("high")) if value is not None else (none, none)
    since, until = (F.coalesce(F.unix_date("valid_from"), F.lit(EVER)), F.coalesce(F.unix_date("valid_to"), F.lit(NEVER))) if at is not None else (F.lit(EVER), F.lit(NEVER))
    bands = ranked.select(F.col("__id").alias("__key"), low.alias("low"), high.alias("high"), since.alias("since"), until.alias("until"), "position")
    met = _searched(asked, bands).join(ranked.select("position", F.col("limit").alias(name)), "position").drop("position")
    on = ("__key", "__x", "__at")
    back = mine.withColumnsRenamed({c: f"__of{c}" for c in on}).join(met, [F.col(f"__of{c}").eqNullSafe(F.col(c)) for c in on], "left")
    return back.drop(*on, *[f"__of{c}" for c in on])


def _searched(asked: DataFrame, bands: DataFrame) -> DataFrame:
    """(__key, __x, __at, position) of the lookups that a band holds for, by the smallest position."""
    ends = asked.select("__key", F.col("__x").alias("x")).unionByName(bands.select("__key", F.explode(F.array("low", "high")).alias("x")))
    sizes = ends.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    large = kept(sizes.where(F.col("n") > CHUNK))
    total, most = asked.count() + bands.count(), large.agg(F.max("n")).first()[0]
    units = max(1, -(-total // CHUNK))
    if most is None:
        cut = large.select("__key", F.array().cast("array<double>").alias("cuts"))
    else:
        m = -(-most // CHUNK)
        points = F.percentile_approx("x", [i / m for i in range(1, m)], max(10_000, 50 * m))
        step = F.greatest(F.lit(1), F.floor(CHUNK * m / F.col("n")))
        cut = ends.where("x is not null and not isnan(x)").join(few(large), "__key").groupBy("__key", "n").agg(points.alias("cuts"))
        cut = kept(cut.select("__key", F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % step == 0)).alias("cuts")))

    def placed(df: DataFrame) -> DataFrame:
        """df with its key's cuts, and the unit that its key belongs to: the keys without cuts share units."""
        met = df.join(few(cut), "__key", "left").withColumn("__unit", F.when(F.col("cuts").isNull(), -1 - F.pmod(F.hash("__key"), F.lit(units))).otherwise(F.col("__key")))
        return met.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))

    probes = placed(asked).withColumn("__chunk", F.size(F.filter("cuts", lambda c: c <= F.col("__x")))).drop("cuts")
    parts = _parts(placed(bands), 0 if most is None else m.bit_length())
    found = parts.groupBy("__unit", "__chunk").cogroup(probes.groupBy("__unit", "__chunk"))
    return found.applyInArrow(_best, "__key long, __x double, __at int, position long")


def _parts(bands: DataFrame, levels: int) -> DataFrame:
    """Bands by the chunks that they begin or end in; of those that span a chunk, the first of each key and pair of days, without bounds."""
    cuts = F.col("cuts")
    first = F.when(F.col("low").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("low"))))
    last = F.when(F.col("high").isNull(), F.size(cuts)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("high"))))
    rows = bands.withColumns({"first": first, "last": last})
    begins = F.col("low").isNotNull() & ~F.coalesce(F.get(cuts, F.col("first") - 1) == F.col("low"), F.lit(False))  # inside of its first chunk
    stops = F.col("high").isNotNull() & ~F.coalesce(F.get(cuts, F.col("last")) == F.col("high"), F.lit(False))
    rows = rows.withColumns({"from": F.col("first") + begins.cast("int"), "to": F.col("last") + 1 - stops.cast("int")}).drop("cuts")
    in_part = F.array_distinct(F.array(F.when(F.col("from") > F.col("first"), F.col("first")), F.when(F.col("to") <= F.col("last"), F.col("last"))))
    edge = rows.withColumn("__chunk", F.explode(F.filter(in_part, lambda c: c.isNotNull()))).select("__unit", "__chunk", "__key", "low", "high", "since", "until", "position")
    # Runs of chunks as nodes of a tree, so that a band that spans many is few rows until the best of each node is known.
    size = F.expr("shiftleft(1, level)")
    node = rows.where("from < to").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    node = node.withColumns({"left": F.ceil(F.col("from") / size).cast("int"), "right": F.floor(F.col("to") / size).cast("int")}).where("left < right")
    node = node.withColumn("node", F.explode(F.filter(F.array(F.when(F.col("left") % 2 == 1, F.col("left")), F.when(F.col("right") % 2 == 1, F.col("right") - 1)), lambda c: c.isNotNull())))
    best = node.groupBy("__unit", "__key", "level", "node", "since", "until").agg(F.min("position").alias("position"))
    leaf = best.withColumn("__chunk", F.explode(F.sequence(F.col("node") * size, (F.col("node") + 1) * size - 1)))
    whole = leaf.groupBy("__unit", "__chunk", "__key", "since", "until").agg(F.min("position").alias("position"))
    none = F.lit(None).cast("double")
    return edge.unionByName(whole.withColumns({"low": none, "high": none}))


def _best(bands: pa.Table, asked: pa.Table) -> pa.Table:
    """The lookups of a chunk that a band holds for, with the first one's position."""
    out = asked.select(["__key", "__x", "__at"])
    if not len(bands) or not len(asked):
        return out.slice(0, 0).append_column("position", pa.array([], pa.int64()))
    bands = bands.sort_by([("position", "descending")])  # the last that holds is the best; days of beginning ascend
    col = {c: bands[c].to_numpy() for c in ("__key", "low", "high", "since", "until", "position")}
    undated = np.asarray(asked["__at"].is_null())
    day = asked["__at"].fill_null(0).to_numpy()
    lo, hi, at = _ranks(col["__key"], bands["low"], bands["high"], asked["__key"].to_numpy(), asked["__x"].to_numpy())
    always = (col["since"] == EVER) & (col["until"] == NEVER)
    best = np.full(len(at), -1)
    for some, rows in ((np.ones(len(lo), bool), ~undated), (always, undated)):
        if some.any() and rows.any():
            hit = _stabbed(lo[some], hi[some], col["since"][some], col["until"][some], at[rows], day[rows])
            best[rows] = np.where(hit >= 0, np.flatnonzero(some)[hit], -1)
    met = best >= 0
    return out.filter(pa.array(met)).append_column("position", pa.array(col["position"][best[met]], pa.int64()))


def _ranks(key: np.ndarray, low: pa.ChunkedArray, high: pa.ChunkedArray, asked_key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of (key, low), (key, high) and (key, x) among them all, in Spark's order of doubles; no bound is outside of all numbers of its key."""

    def ordered(v: np.ndarray) -> np.ndarray:
        bits = (np.where(np.isnan(v), np.nan, v) + 0.0).view(np.int64)
        return np.where(np.isnan(v), np.int64(0x7FF8 << 48), np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))

    ends = [np.where(np.asarray(c.is_null()), unbound, ordered(c.fill_null(0.0).to_numpy())) for c, unbound in ((low, -(1 << 63)), (high, (1 << 63) - 1))]
    number, owner = np.concatenate([*ends, ordered(x)]), np.concatenate([key, key, asked_key])
    order = np.lexsort((number, owner))
    fresh = (np.diff(number[order], prepend=number[order[:1]]) != 0) | (np.diff(owner[order], prepend=owner[order[:1]]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    return rank[: len(key)], rank[len(key) : 2 * len(key)], rank[2 * len(key) :]


def _stabbed(lo: np.ndarray, hi: np.ndarray, since: np.ndarray, until: np.ndarray, at: np.ndarray, day: np.ndarray) -> np.ndarray:
    """For each point the last of the bands with lo <= at < hi and since <= day <= until, -1 for none; since ascends.

    Bands stand in the nodes that make up their range in a binary tree over all ends. In the node of a point the bands by `since` end where its day does; from
    there back, runs of bands that are all over by then are passed by powers of two.
    """
    ends = np.unique(np.concatenate([lo, hi]))
    left, right, cell = (np.searchsorted(ends, v, "right") for v in (lo, hi, at))
    back = np.argsort(cell, kind="stable")  # neighbours look in the same places
    cell, day = cell[back], day[back].astype(np.int64)
    found, own = np.full(len(cell), -1), np.arange(len(left))
    shift = np.int64(1 << 31)
    while len(left):
        a, b = np.flatnonzero(left & 1), np.flatnonzero(right & 1)
        node, band = np.concatenate([left[a], right[b] - 1]), np.concatenate([own[a], own[b]])
        order = np.lexsort((band, node))
        node, band = node[order], band[order]
        place = np.searchsorted(node * (shift * 2) + since[band] + shift, cell * (shift * 2) + day + shift, "right") - 1
        if len(node):
            tops = [until[band]]
            if tops[0].min() < NEVER:
                while (1 << len(tops)) <= len(node):
                    width = 1 << (len(tops) - 1)
                    tops.append(np.maximum(tops[-1], np.concatenate([tops[-1][:width], tops[-1][:-width]])))
                for k in range(len(tops) - 1, -1, -1):
                    place = place - (((place >= 0) & (tops[k][place] < day)).astype(np.int64) << k)
            found = np.maximum(found, np.where((place >= 0) & (node[place] == cell), band[place], -1))
        left, right, cell = (left + 1) >> 1, right >> 1, cell >> 1
        on = left < right
        left, right, own = left[on], right[on], own[on]
    out = np.empty_like(found)
    out[back] = found
    return out


def with_limits(df: DataFrame, looks: dict[str, Lookup]) -> DataFrame:
    for name, look in looks.items():
        df = with_limit(df, name, look)
    return df
