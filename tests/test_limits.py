"""Limits by key, band and day against a search of all rows of the table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from caselens.operators import limits
from caselens.operators.rules import RULES
from tests.conftest import SF

DAY = datetime.date(2024, 1, 1)


def tables(seed, n=120):
    r = random.Random(seed)

    def maybe(x, p=0.15):
        return None if r.random() < p else x

    bands = []
    for i in range(n):
        low = r.choice([0.0, 1.0, 2.5, 1e6, r.uniform(-50, 500)])
        bands.append((maybe(r.choice("abc"), 0.05), maybe(low), maybe(low + r.choice([0.0, 1e-3, 1.0, 8.0, 300.0, 1e9])), maybe(DAY + datetime.timedelta(r.randrange(60))), maybe(DAY + datetime.timedelta(r.randrange(60))), i))
    rows = [(maybe(r.choice("abcd")), maybe(r.choice([0.0, 1.0, 2.5, 8.0, r.uniform(-60, 600), 1e6 + 5])), maybe(DAY + datetime.timedelta(r.randrange(-5, 70))), i % 150) for i in range(300)]
    return bands, rows


def brute(bands, row):
    k, x, at, _ = row
    held = [b for b in bands if k is not None and b[0] == k and x is not None and (b[1] is None or x >= b[1]) and (b[2] is None or x < b[2]) and (b[3] is None or at and at >= b[3]) and (b[4] is None or at and at <= b[4])]
    return min(held, key=lambda b: (-((b[3] - datetime.date(1970, 1, 1)).days if b[3] else -(1 << 30)), -(b[1] if b[1] is not None else -1e300), str(b[5])))[5] if held else None


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [True, False])
def test_limits_against_a_search_of_all_bands(spark, seed, small):
    bands, rows = tables(seed)
    table = spark.createDataFrame(bands, "product string, low double, high double, valid_from date, valid_to date, limit long")
    df = spark.createDataFrame(rows, "kind string, x double, day date, limit0 long")
    found = limits.with_limit(df, "limit", limits.Lookup(table, (("kind", "product"),), "x", "day"), small)
    assert found.columns == ["kind", "x", "day", "limit0", "limit"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((*r, brute(bands, r))) for r in rows)
    assert limits.with_limit(df, "limit", limits.Lookup(table.limit(0), (("kind", "product"),), "x", "day"), small).where("limit is null").count() == 300


@pytest.mark.parametrize("small", [True, False])
def test_bands_without_keys_and_keys_without_bands(spark, small):
    bands = limits.of_rows(spark, "low double, high double, limit int", [(0, 10, 1), (10, 20, 2), (20, None, 3)])
    df = spark.createDataFrame([(x,) for x in (-1, 0, 9, 10, 19, 20, 10**9, None)], "x long")
    found = {r["x"]: r["n"] for r in limits.with_limit(df, "n", limits.Lookup(bands, value="x"), small).collect()}
    assert found == {-1: None, 0: 1, 9: 1, 10: 2, 19: 2, 20: 3, 10**9: 3, None: None}
    caps = limits.of_rows(spark, "role string, limit double, valid_from string", [("a", 1.0, None), ("a", 2.0, "2024-02-01"), ("b", 5.0, None)])
    df = spark.createDataFrame([("a", DAY), ("a", datetime.date(2024, 3, 1)), ("b", DAY), (None, DAY)], "r string, day date")
    found = [(r["r"], r["cap"]) for r in limits.with_limit(df, "cap", limits.Lookup(caps, (("r", "role"),), at="day"), small).collect()]
    assert sorted(found, key=str) == [("a", 1.0), ("a", 2.0), ("b", 5.0), (None, None)]


@pytest.mark.parametrize("chunk", [8, 60])
def test_large_tables_in_many_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(limits, "CHUNK", chunk)
    bands, rows = tables(3)
    bands += [("a", None, None, DAY + datetime.timedelta(9), None, 500), ("b", float("nan"), None, None, None, 501), ("c", -0.0, float("inf"), None, DAY, 502)]
    rows += [("b", float("nan"), DAY, 500), ("a", float("inf"), DAY, 501), ("c", 0.0, DAY, 502), ("c", -0.0, None, 503)]
    table = spark.createDataFrame(bands, "product string, low double, high double, valid_from date, valid_to date, limit long")
    df = spark.createDataFrame(rows, "kind string, x double, day date, limit0 long")
    look = limits.Lookup(table, (("kind", "product"),), "x", "day")
    found, wanted = (sorted(map(str, limits.with_limit(df, "limit", look, small).collect())) for small in (False, True))
    assert found == wanted


def test_lookups_dont_meet_all_bands_that_hold(spark):
    table = spark.range(3000).select(F.col("id").alias("low"), F.lit(1e9).alias("high"), F.date_add(F.lit(DAY), (F.col("id") % 50).cast("int")).alias("valid_from"), F.col("id").alias("limit"))
    df = spark.range(3000).select((F.col("id") + 3000).alias("x"), F.date_add(F.lit(DAY), (F.col("id") % 60).cast("int")).alias("day"))
    found = limits.with_limit(df, "limit", limits.Lookup(table, value="x", at="day"), small=False)
    assert found.where("limit = 2950 + least(datediff(day, '2024-01-01'), 49)").count() == 3000
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_the_size_of_a_table_decides(spark):
    one = spark.range(300).select(F.lit("a").alias("k"), F.col("id").alias("low"), (F.col("id") + 1).alias("high"), F.col("id").alias("limit"))
    assert not limits.is_small(limits.Lookup(one, (("k", "k"),), "x")) and limits.is_small(limits.Lookup(one.where("low < 200"), (("k", "k"),), "x"))
    assert not limits.is_small(limits.Lookup(one.where("low < 200"), (("k", "k"),), "x"), 100)


def test_rules_take_tables_with_dates(spark):
    from caselens.queries.rules import loans

    df = loans(spark, SF)
    late = limits.of_rows(spark, "role string, limit double, valid_from string", [("officer", 0.0, "1997-01-01"), ("manager", 1e12, None)])
    found = RULES["unauthorized_approver"](df, limits=late)
    wanted = df.where("approver_role = 'officer' and to_date(ts) >= '1997-01-01' and amount > 0").count()
    assert found.count() == wanted > 0
    days = df.select(F.to_date("approval_timestamp").alias("day")).distinct().withColumn("limit", F.lit("any day"))
    assert RULES["cutoff_breach"](df, holidays=days).count() == df.where("approval_timestamp is not null").count()
    plan = RULES["unauthorized_approver"](df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BroadcastHashJoin" in plan
