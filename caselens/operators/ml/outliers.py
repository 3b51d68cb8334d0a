"""Isolation forest: trees grown on small samples in parallel, a bounded forest broadcast to score all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.plans.graphs import kept

EULER = 0.5772156649015329
#: Values that are looked at one by one when a rank has been narrowed down to so many.
FEW = 10_000


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int) -> pd.DataFrame:
    """A tree on the rows of x: nodes with feature, cut and children; leaves (feature -1) with the length of the paths that end there."""
    rng, nodes = np.random.default_rng(seed), []
    limit = int(np.ceil(np.log2(max(2, len(x)))))

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([at, -1, 0.0, -1, -1, depth + float(path_length(len(rows)))])
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        some = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(some):
            f = int(rng.choice(some))
            cut = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] <= cut
            nodes[at][1:5] = [f, cut, add(rows[left], depth + 1), add(rows[~left], depth + 1)]
        return at

    add(x, 0)
    return pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "length"])


def forest(df: DataFrame, id_col: str, vector_col: str, trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """(tree, node, feature, cut, left, right, length) of trees on `rows` random rows each; at most trees * 2 * rows nodes.

    Each tree takes the rows of smallest hash under its number; a first cut by hash leaves about 4 * rows a tree at any size of df, and
    only what is drawn is copied.
    """
    n = df.count()
    near = min(1.0, 4 * rows / max(1, n) + 1e-9)

    def lot(tree: Column) -> Column:
        return F.pmod(F.xxhash64("id", tree, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)

    drawn = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    drawn = drawn.select("id", "v", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: lot(t) <= near)).alias("tree")).withColumn("lot", lot(F.col("tree")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lot", "id"]).head(rows)
        return grow(np.stack(pdf["v"].to_numpy()).astype(float), seed + int(pdf["tree"].iloc[0])).assign(tree=pdf["tree"].iloc[0])[["tree", "node", "feature", "cut", "left", "right", "length"]]

    return drawn.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, left int, right int, length double")


def ranked(values: DataFrame, column: str, rank: int) -> float:
    """The value of that rank (from 0) in ascending order, exactly, without gathering or sorting them.

    Each pass takes two values close to the rank on either side and counts what is below, at, between and above them; what is left is some
    ten-thousandth of the values.
    """
    x, inside = F.col(column), F.lit(True)
    while True:
        rows = values.where(inside)
        n = rows.agg(F.count(x)).first()[0]
        if n <= FEW:
            return sorted(r[0] for r in rows.where(x.isNotNull()).select(x).collect())[rank]
        low, high = rows.agg(F.percentile_approx(x, [max(0.0, rank / n - 2e-4), min(1.0, rank / n + 2e-4)], 10_000)).first()[0]
        below, at_low, between, at_high = rows.agg(F.count_if(x < low), F.count_if(x == low), F.count_if((x > low) & (x < high)), F.count_if((x == high) & (x > low))).first()
        if rank < below:
            inside = inside & (x < low)
        elif rank < below + at_low:
            return low
        elif rank < below + at_low + between:
            inside, rank = inside & (x > low) & (x < high), rank - below - at_low
        elif rank < below + at_low + between + at_high:
            return high
        else:
            inside, rank = inside & (x > high), rank - below - at_low - between - at_high


def percentile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact percentile, between two values in proportion; None without values."""
    n = values.agg(F.count(column)).first()[0]
    if not n:
        return None
    at = (n - 1) * share
    low = ranked(values, column, int(at))
    high = ranked(values, column, int(at) + 1) if at > int(at) else low
    return low + (high - low) * (at - int(at))


def flagged(raw: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Rows with raw as score, is_anomaly and threshold: below the exact percentile of the share contamination, 0.2 at most, are anomalies."""
    offset = percentile(raw, "raw", min(contamination, 0.2))
    cut = F.lit(offset).cast("double")
    return raw.select(*[c for c in raw.columns if c != "raw"], (F.col("raw") - cut).alias("score"), (F.col("raw") < cut).alias("is_anomaly"), cut.alias("threshold"))


def scored(df: DataFrame, id_col: str, vector_col: str, trees: int = 100, rows: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, score, is_anomaly, threshold): scores below 0 are anomalies, the share contamination (0.2 at most) of all; fewer than 10 rows are all normal.

    The threshold is the raw score of that share, exactly.
    """
    if df.limit(10).count() < 10:
        return df.select(id_col, F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly"), F.lit(None).cast("double").alias("threshold"))
    grown = forest(df, id_col, vector_col, trees, rows, seed).toPandas()  # bounded by trees * 2 * rows
    shared = df.sparkSession.sparkContext.broadcast([t.sort_values("node") for _, t in grown.groupby("tree")])
    usual = float(path_length(min(rows, df.count())))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            length = np.zeros(len(x))
            for t in shared.value:
                f, cut, left, right, depth = (t[c].to_numpy() for c in ("feature", "cut", "left", "right", "length"))
                at = np.zeros(len(x), int)
                while (inner := f[at] >= 0).any():
                    go = np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at], left[at], right[at])
                    at = np.where(inner, go, at)
                length += depth[at]
            yield pd.DataFrame({id_col: pdf["id"], "raw": -(2.0 ** (-length / len(shared.value) / usual))})

    schema = T.StructType([df.schema[id_col], T.StructField("raw", T.DoubleType())])
    raw = kept(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null").mapInPandas(score, schema))
    return flagged(raw, contamination)


def score_ranges(found: DataFrame) -> DataFrame:
    """One row of what `scored` gives: rows, anomalies, the threshold of the raw scores, and the least, mean and greatest score."""
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"), F.max("threshold").alias("threshold"),
        F.min("score").alias("least"), F.avg("score").alias("mean"), F.max("score").alias("greatest"),
    )


def top_anomalies(devs: DataFrame, n: int = 10) -> DataFrame:
    """The n anomalies of lowest score."""
    return devs.where("is_anomaly").orderBy("score", "deviation_id").limit(n)


def profile(devs: DataFrame) -> DataFrame:
    """One row: anomalies, their share, severities, five types and officers, and the most anomalous row (description cut at 100)."""
    from caselens.operators.stats import severity_counts

    bad = devs.where("is_anomaly")
    total = devs.agg(F.count(F.lit(1)).alias("total"))
    counts = bad.agg(F.count(F.lit(1)).alias("count"), *severity_counts(), F.min_by(F.struct("deviation_id", "case_id", "deviation_type", "score", F.substring("description", 1, 100).alias("description")), F.struct("score", "deviation_id")).alias("worst"))

    def five(column: str, name: str) -> DataFrame:
        best = bad.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(5)
        return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("x")))), lambda r: r["x"]), ",").alias(name))

    rows = counts.crossJoin(total).crossJoin(five("deviation_type", "top_types")).crossJoin(five("officer_id", "top_officers"))
    percent = F.when(F.col("total") > 0, F.round(100.0 * F.col("count") / F.col("total"), 2)).otherwise(0.0)
    return rows.select("count", percent.alias("percentage"), "critical", "high", "medium", "low", "top_types", "top_officers", F.col("worst.deviation_id").alias("worst_id"), F.col("worst.score").alias("worst_score"), F.col("worst.description").alias("worst_description"))
