import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from caselens.llm import lm_score as lm
from caselens.llm import quality as q
from tests.conftest import SF
from tests.llm.common import odd_documents


def brute(texts, corpus, order=3, alpha=0.4, least=1, back=False):
    """(words, score) of each text, and the words that step back; n-grams of two words or more that were counted less often than `least` are unseen."""
    grams = Counter()
    for t in corpus:
        w = (t or "").encode().lower().split()
        for n in range(1, order + 1):
            grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        grams[()] += len(w)
    grams = Counter({g: c for g, c in grams.items() if len(g) < 2 or c >= least})
    out = []
    for t in texts:
        w, total, steps = (t or "").encode().lower().split(), 0.0, 0
        for i in range(len(w)):
            n, factor = min(order, i + 1), 0.0
            while n > 1 and not grams[tuple(w[i - n + 1 : i + 1])]:
                n, factor = n - 1, factor + math.log(alpha)
            c = grams[tuple(w[i - n + 1 : i + 1])]
            steps += factor < 0
            total += factor + (math.log(c / grams[tuple(w[i - n + 1 : i])]) if n > 1 else math.log((c or 0.5) / max(1, grams[()])))
        out.append((len(w), total, steps) if back else (len(w), total))
    return out


def test_scores_equal_sql(same_rows):
    same_rows(lm.op10_lm_score, lm.OP10_SQL)


def test_backoff_on_another_corpus(spark):
    corpus = ["a b c a b d", "b c d", None, "e"]
    texts = ["a b c", "a d zz b", "zz", "", "c a b d e e"]
    docs, other = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    for order in (1, 2, 3, 4):
        for least in (1, 2):
            found = {r["doc_id"]: r for r in lm.scored(docs, other, p=lm.Params(order=order, least=least, part_bytes=4, block_bytes=8)).collect()}
            for i, (n, s, back) in enumerate(brute(texts, corpus, order, least=least, back=True)):
                assert (found[i]["n_words"], found[i]["n_back"]) == (n, back) and math.isclose(found[i]["log_score"], s, abs_tol=1e-9)


def test_backoff_scores_equal_sql(same_rows):
    same_rows(lm.op10_lm_score_backoff, lm.OP10_BACKOFF_SQL)


def test_scores_of_counts_cut_off_equal_sql(same_rows):
    same_rows(lm.op10_lm_score_cutoff, lm.OP10_CUTOFF_SQL)


def test_backoff_on_the_other_documents(spark):
    texts = ["a b c a b d a b c", "a b c d", None, "b c a b", "zz a b", "", "zz a b", "b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for order in (1, 2, 3):
        found = {r["doc_id"]: r for r in lm.scored(docs, p=lm.Params(order=order, least=1, block_bytes=12, part_bytes=4, held_out=True)).collect()}
        for i, text in enumerate(texts):
            [(n, s)] = brute([text], texts[:i] + texts[i + 1 :], order, least=1)
            assert found[i]["n_words"] == n and math.isclose(found[i]["log_score"], s, abs_tol=1e-9)


def test_a_cut_off_table_steps_back(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in lm.op10_lm_score_cutoff(spark, SF).collect()}
    want = dict(zip(texts, brute(list(texts.values()), list(texts.values()), least=2, back=True), strict=True))
    assert {i: r["n_back"] for i, r in rows.items()} == {i: back for i, (_, _, back) in want.items()}
    assert sum(r["n_back"] > 0 for r in rows.values()) > len(rows) / 2


def test_long_blocks_and_equal_rows(spark):
    texts = [f"w{i % 70000} w{i % 11} w{i % 3}" for i in range(80_000)] + ["a b c d"] * 3000
    docs = spark.createDataFrame([(i if i < 80_000 else 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = Counter((n, round(s, 6)) for n, s in brute(texts, texts))
    assert Counter((r["n_words"], round(r["log_score"], 6)) for r in lm.scored(docs, p=lm.Params(block_bytes=1 << 20)).collect()) == want


def test_scores_of_odd_documents(spark):
    docs = odd_documents(spark)
    texts = [r["text"] for r in docs.collect()]
    want = sorted((n, round(s, 6)) for n, s in brute(texts, texts))
    got = sorted((r["n_words"], round(r["log_score"], 6)) for r in lm.scored(docs).collect())
    assert np.allclose(np.array(got), np.array(want), atol=1e-5)
    assert lm.scored(docs.limit(0)).count() == 0


def auc(labels, scores):
    order = np.argsort(np.argsort(scores))
    yes = np.array(labels) == 1
    return (order[yes].sum() - yes.sum() * (yes.sum() - 1) / 2) / (yes.sum() * (~yes).sum())


def test_classifier_on_documents_it_has_not_seen(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w = q.fit(docs, labels.where("doc_id % 4 != 0"))
    rows = q.posteriors(docs, w, F.col("source"), F.col("lang")).join(labels.where("doc_id % 4 = 0").select("doc_id", F.col("quality").alias("yes"), "toxic"), "doc_id").collect()
    assert auc([r["yes"] for r in rows], [r["p_quality"] for r in rows]) > 0.95
    assert auc([r["toxic"] for r in rows], [r["p_toxic"] for r in rows]) > 0.95
    clean = [r for r in rows if r["yes"] == 1 and r["toxic"] == 0]
    assert sum(r["keep"] for r in clean) > 0.97 * len(clean)
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(not r["keep"] for r in toxic) > 0.9 * len(toxic)


def test_sparse_sites_shrink_toward_the_whole(spark):
    rows = [(i, "bad" if i % 2 else "good", "big", "p") for i in range(200)] + [(1000, "good", "tiny", "p"), (1001, "bad", "tiny2", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    good, bad = (np.setdiff1d(q.features(a, 24), q.features(b, 24)) for a, b in (("good", "bad"), ("bad", "good")))
    bins = np.concatenate([good, bad])
    w = q.Weights(np.sort(bins), np.where(np.isin(np.sort(bins), good), 3.0, -3.0)[:, None].repeat(2, axis=1), np.zeros(2))
    found = {r["doc_id"]: r for r in q.posteriors(docs, w, F.col("source"), F.col("lang")).collect()}
    assert abs(found[1000]["host_quality"] - 0.5) < abs(1 / (1 + math.exp(-3)) - 0.5) and found[1000]["host_quality"] > found[1001]["host_quality"]
    assert abs(found[0]["host_quality"] - 0.5) < 0.01


def moments(sites):
    """(rate, strength) of sites (n, sum of probabilities) by the method of moments."""
    n, s = (np.array(x, float) for x in zip(*sites, strict=True))
    rate = s.sum() / n.sum()
    spread = (s * s / n).sum() - rate * s.sum() - (len(n) - 1) * rate * (1 - rate)
    weight = n.sum() - (n * n).sum() / n.sum()
    between = max(spread / weight if weight > 0 else 0.0, 1e-4 * rate * (1 - rate), 1e-9)
    return rate, min(1e6, max(1.0, rate * (1 - rate) / between - 1))


def test_posteriors_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    w = q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    found = {r["doc_id"]: r for r in q.op9_quality(spark, SF).collect()}
    address = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = []
    for r in docs.collect():
        url = address.get(r["doc_id"])
        site = (r["source"], r["lang"])
        if url is not None:
            host, _, rest = url.split("://", 1)[1].partition("/")
            site = (host.lower(), re.split(r"[/?#]", rest)[0])
        rows.append((r["doc_id"], site, np.clip(w.evidence(q.features(r["text"], 24)), -20, 20)))
    assert {i for i, _, _ in rows} == set(found) and len({site[0] for _, site, _ in rows}) > 25  # sparse hosts among them
    for k, target in enumerate(q.TARGETS):
        paths, hosts = {}, {}
        for _, site, e in rows:
            for table, key in ((paths, site), (hosts, site[0])):
                n, s = table.get(key, (0, 0.0))
                table[key] = (n + 1, s + 1 / (1 + math.exp(-e[k])))
        rate, strong = moments(hosts.values())
        _, strong_path = moments(paths.values())
        for i, site, e in rows:
            of_host = (hosts[site[0]][1] + strong * rate) / (hosts[site[0]][0] + strong)
            of_path = (paths[site][1] + strong_path * of_host) / (paths[site][0] + strong_path)
            logit = [math.log(x / (1 - x)) for x in (min(max(x, 1e-6), 1 - 1e-6) for x in (of_path, rate))]
            want = 1 / (1 + math.exp(-(e[k] + logit[0] - logit[1])))
            assert (found[i]["host"], found[i]["path"]) == site
            assert math.isclose(found[i][f"host_{target}"], of_host, rel_tol=1e-6) and math.isclose(found[i][f"path_{target}"], of_path, rel_tol=1e-6)
            assert math.isclose(found[i][f"p_{target}"], want, rel_tol=1e-6, abs_tol=1e-12)


def test_quality_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (6, None, None), (None, 1, 1), (8, 0, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    w = q.fit(docs, labels)
    assert q.posteriors(docs, w, F.col("source"), F.col("lang")).count() == 15
    assert q.posteriors(docs.limit(0), w, F.col("source"), F.col("lang")).count() == 0
    even = q.fit(docs, labels.limit(0))
    assert not len(even.bins)
