"""Fitted features that are written and read again, exact ranks, invalid rule sets, heads of files and corpus files."""

import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caselens.operators import sop
from caselens.operators.ml import features, outliers
from caselens.sources import files
from caselens.sources import tables as t
from tests.conftest import ROOT, SF


def vectors(model, devs):
    return {r["deviation_id"]: [round(x, 9) for x in r["v"]] for r in model.transform(devs).select("deviation_id", vector_to_array("features").alias("v")).collect()}


@pytest.mark.parametrize("texts", [False, True])
def test_written_features_are_the_same_in_a_new_session(spark, tmp_path, texts):
    devs = t.deviations(spark, SF).limit(300)
    devs = devs.withColumn("detected_at", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss")) if texts else devs
    devs = devs.withColumn("deviation_type", F.when(F.col("deviation_type") == "tat_breach", "it's \\ odd").otherwise(F.col("deviation_type")))
    devs.write.parquet(str(tmp_path / "devs"))
    devs = spark.read.parquet(str(tmp_path / "devs"))
    model = features.fitted_stages(devs)
    new = devs.withColumns({"deviation_type": F.lit("never seen"), "officer_id": F.lit("new one"), "description": F.lit(None).cast("string"), "severity": F.lit(None).cast("string")})
    assert vectors(model, devs) == vectors(features.fit(devs), devs) and vectors(model, new) == vectors(features.fit(devs), new)
    model.save(str(tmp_path / "model"))
    assert vectors(PipelineModel.load(str(tmp_path / "model")), devs) == vectors(model, devs)
    made = model.transform(devs)
    assert made.columns == [*devs.columns, "features"] and "officer_id_0" in str(made.schema["features"].metadata)
    if not texts:
        code = f"""
from pyspark.sql import SparkSession
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
rows = PipelineModel.load({str(tmp_path / 'model')!r}).transform(s.read.parquet({str(tmp_path / 'devs')!r}))
print("SUM", round(sum(sum(r[0]) for r in rows.select(vector_to_array("features")).collect()), 4))
"""
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, cwd=ROOT)
        assert f"SUM {round(sum(map(sum, vectors(model, devs).values())), 4)}" in out.stdout, out.stderr[-500:]


@pytest.mark.parametrize("kind", ["ties", "normal", "wide", "one"])
def test_ranks_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(outliers, "FEW", 40)
    r = random.Random(2)
    made = {"ties": lambda: float(r.randrange(7)), "normal": lambda: r.gauss(0, 1), "wide": lambda: r.choice([-1, 1]) * math.exp(r.gauss(0, 60)), "one": lambda: 3.0}[kind]
    x = [made() for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "raw double").repartition(5)
    for rank in (0, 1, 399, 400, 2000, 3999):
        assert outliers.ranked(df, "raw", rank) == sorted(x)[rank]
    for share in (0.0, 0.1, 0.2, 1.0):
        assert np.isclose(outliers.percentile(df, "raw", share), np.percentile(x, 100 * share), rtol=1e-12)
    assert outliers.percentile(df.limit(0), "raw", 0.1) is None


def test_the_stated_share_is_flagged(spark):
    df = spark.range(20_000).select("id", (F.xxhash64("id") / 2.0**63).alias("raw"))
    assert outliers.flagged(df, 0.1).where("is_anomaly").count() == 2000 and outliers.flagged(df, 0.5).where("is_anomaly").count() == 4000


def test_what_makes_rule_sets_invalid(spark):
    rows = [(1, 1, "timing", "x", "high"), (2, 1, None, "x", "high"), (2, 2, "custom", " ", "urgent"), (3, 1, "timing", None, None)]
    df = spark.createDataFrame(rows, "sop_id int, rule_id int, rule_type string, rule_description string, severity string")
    assert sorted(map(tuple, sop.rule_faults(df).collect())) == [
        (2, 1, "no rule_type"), (2, 2, "no rule_description"), (2, 2, "unknown rule_type: custom"), (2, 2, "unknown severity: urgent"), (3, 1, "no rule_description"), (3, 1, "no severity")]
    assert {r["sop_id"]: r["is_valid"] for r in sop.rule_sets(df).collect()} == {1: True, 2: False, 3: False}


def test_the_head_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffcase,"note"\n\n1,"two\nlines ""q"""\n2\n3,c\n4,d\n' + "5,e\n" * 100_000, encoding="utf-8")
    rows = [tuple(r) for r in files.head(spark, str(tmp_path / "a.csv")).collect()]
    assert rows == [(0, "case", "1"), (0, "note", 'two\nlines "q"'), (1, "case", "2"), (1, "note", None), (2, "case", "3"), (2, "note", "c")]
    (tmp_path / "b.csv").write_text("")
    assert files.head(spark, str(tmp_path / "b.csv")).count() == 0


def test_corpus_files_hold_many_texts(spark, tmp_path):
    texts = ["plain", "two\nlines\n", "", None, "sep \x1e in \x1a0 and \x1a1 it", "ünïcode \r\n", "{\"a\": 1}\n"]
    rows = [(f"f{i}.txt", f"Title {i}\nwith a break", "1.0", "txt", "pending", x) for i, x in enumerate(texts * 50)]
    df = spark.createDataFrame(rows, f"{files.ENTRY}, text string")
    files.write_corpus(df.coalesce(2), str(tmp_path / "corpus"))
    assert len(list((tmp_path / "corpus").glob("part-*"))) == 2
    assert sorted(map(tuple, files.corpus(spark, str(tmp_path / "corpus")).collect())) == sorted((*r[:5], r[5] or "") for r in rows)


def test_rare_pairs_are_left_out_before_they_are_counted(spark, monkeypatch):
    r = random.Random(5)
    texts = [(" ".join(f"w{min(int(r.expovariate(0.2)), 60)}" for _ in range(r.randrange(0, 30))),) for _ in range(200)] + [(None,), ("",)]
    df = spark.createDataFrame(texts, "description string")
    counted, seen = features._counted, []
    monkeypatch.setattr(features, "_counted", lambda rows, found: seen.append(counted(rows, found)) or seen[-1])
    few = features.vocabulary(df, terms=12).collect()
    pruned = seen[1].count()
    monkeypatch.setattr(features, "MANY", 0)
    assert few == features.vocabulary(df, terms=12).collect() and len(few) == 12 and any(" " in x["term"] for x in few)
    assert pruned < seen[3].count() / 2
    assert features.vocabulary(df, terms=5000).count() > 100


def test_pairs_of_many_words_as_frequent_as_the_last_are_left_out(spark, monkeypatch):
    """Hundreds of words tie with the last of the list: the pairs that may enter are still a few, and none is lost."""
    r = random.Random(8)
    texts = [f"order {'aA' if i % 2 else 'z'}{i} deviates" for i in range(300) for _ in range(2 + i % 3)] + [f"zz{i % 3} common aa{i % 2}" for i in range(30)]
    texts += [" ".join(r.choice(("common", "zz1", "b7", "b8", "odd")) for _ in range(r.randrange(9))) for _ in range(40)]
    n, times, documents = len(texts), {}, {}
    for text in texts:
        words = text.lower().split()
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        for term in found:
            times[term] = times.get(term, 0) + 1
        for term in set(found):
            documents[term] = documents.get(term, 0) + 1
    counted, seen = features._counted, []
    monkeypatch.setattr(features, "_counted", lambda rows, found: seen.append(counted(rows, found)) or seen[-1])
    monkeypatch.setattr(features, "MANY", 110)
    df = spark.createDataFrame([(x,) for x in texts], "description string")
    for terms in (1, 3, 7, 12, 40, 100, 250, 2000):
        for max_df in (0.3, 0.8, 1.0):
            wanted = sorted(((-times[t], t) for t in times if documents[t] >= 2 and documents[t] <= max_df * n))[:terms]
            assert [(-x["times"], x["term"]) for x in features.vocabulary(df, terms=terms, max_df=max_df).collect()] == wanted
            if terms == 40:
                assert seen[-1].count() < 100 < sum(" " in t for t in times) / 5


@pytest.mark.parametrize("made", ["embedded", "texts"])
def test_code_of_features_is_short_enough_to_be_compiled(spark, made):
    """The JVM leaves methods of over 8000 bytes uncompiled."""
    from caselens.queries.ml import h6

    devs = t.deviations(spark, SF)
    rows = h6(spark, SF) if made == "embedded" else features.Features(features.fitted_text(devs.limit(50)), [f"type {i}" for i in range(40)], [f"officer {i}" for i in range(40)]).transform(devs)
    stages = rows._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
