"""Stored tables: changes that are repeated, stopped, or race with others."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from caselens.sources.stored import Store


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    assert made.create("rules", "sop_id long, rule string", ("sop_id",), 4) and made.create("sops", "sop_id long, title string", ("sop_id",), 4)
    return made


def rules(spark, ids):
    return spark.createDataFrame([(i, f"r{i}") for i in ids], "sop_id long, rule string")


def ids(snapshot, name="rules"):
    return sorted(r["sop_id"] for r in snapshot.read(name).collect())


def test_a_change_is_applied_once(spark, store):
    assert store.append("rules", rules(spark, range(9)), "u1") and not store.append("rules", rules(spark, range(9)), "u1")
    assert not store.create("rules", "x int", ("x",)) and ids(store.snapshot()) == list(range(9))
    assert store.append("rules", rules(spark, range(2)), "u2") and ids(store.snapshot()) == sorted([*range(9), 0, 1])
    assert store.append("rules", rules(spark, []), "u3") and len(ids(store.snapshot())) == 11


def test_a_stopped_run_leaves_nothing(spark, store):
    def stopped(now):
        store.write(now.tables["rules"], rules(spark, range(5)))
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        store.change("u1", stopped)
    assert ids(store.snapshot()) == [] and store.append("rules", rules(spark, range(5)), "u1") and ids(store.snapshot()) == list(range(5))
    assert store.sweep() == 1 and store.sweep() == 0 and ids(store.snapshot()) == list(range(5))


def test_readers_keep_their_version_and_two_tables_change_at_once(spark, store):
    store.append("rules", rules(spark, [*range(12), 3, 3]), "r")
    store.append("sops", rules(spark, range(12)).withColumnRenamed("rule", "title"), "s")
    before = store.snapshot()
    store.delete({"sops": F.col("sop_id") == 3, "rules": F.col("sop_id") == 3}, "delete 3")
    after = store.snapshot()
    assert after.version == before.version + 1 and 3 not in ids(after) + ids(after, "sops") and ids(before).count(3) == 3 and 3 in ids(before, "sops")
    kept = {b for b, f in before.tables["rules"].folders.items() if after.tables["rules"].folders.get(b) == f}
    assert len(kept) >= 2  # only the bucket of 3 is written again
    assert ids(store.snapshot(before.version)) == ids(before)
    assert store.delete({"rules": F.col("rule") == "no such rule"}, "none") and ids(store.snapshot()) == ids(after)
    with pytest.raises(ValueError, match="no version 99"):
        store.snapshot(99)


def test_edits_and_new_rows(spark, store):
    store.append("rules", rules(spark, range(6)), "r")
    store.upsert("rules", spark.createDataFrame([(2, "new"), (70, "more")], "sop_id long, rule string"), "edit")
    found = {r["sop_id"]: r["rule"] for r in store.snapshot().read("rules").collect()}
    assert found == {i: f"r{i}" for i in range(6)} | {2: "new", 70: "more"}


def test_the_second_of_two_writers_starts_again(spark, store):
    seen, other = [], Store(spark, store.path)

    def work(now):
        seen.append(now.version)
        if len(seen) == 1:
            other.append("rules", rules(spark, [1]), "other")
        return {"rules": store._rewritten(now, "rules", [], rules(spark, [len(ids(now))]))}

    assert store.change("mine", work) and seen[1] == seen[0] + 1
    assert 1 in ids(store.snapshot()) and len(store.snapshot().applied) == 4


def test_writers_at_the_same_time_insert_each_key_once(spark, store):
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: Store(spark, store.path).insert_absent("sops", rules(spark, range(i, i + 6)).withColumnRenamed("rule", "title"), f"w{i}"), range(3)))
    assert ids(store.snapshot(), "sops") == list(range(8))
