import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from caselens.llm import language as lg
from tests.conftest import SF
from tests.llm.common import odd_documents


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = lg.op6_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.98 * len(out) and all(0 <= r["score"] <= 1 for r in rows)


def small(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the the the house", "en"), (4, "das haus und der garten", "de"), (5, None, "en"), (6, "text", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_counts_by_hand(spark):
    m = lg.fit(small(spark))
    assert m.langs == ["de", "en"] and set(m.words) == {"the", "cat", "and", "dog", "der", "hund", "und", "die", "katze", "house", "das", "haus", "garten"}
    import numpy as np

    row = m.scores[m.words["the"]]
    assert np.isclose(row[1], np.log(5 / 9)) and np.isclose(row[0], np.log(0.5 / 10))


def test_unseen_words_fall_back_to_shorter_grams(spark):
    m = lg.fit(small(spark))
    seen, unseen, strange = m.word_scores(["katze", "katzen", "qqq"])
    known = [m.scores[m.grams[4][g]] for g in lg.grams("katzen", 4) if g in m.grams[4]]
    assert seen.tolist() == m.scores[m.words["katze"]].tolist() and len(known) == 3 and unseen[0] > unseen[1] and not strange.any()
    assert abs(unseen[0] - sum(k[0] for k in known) / 3) < 1e-12
    longest = {n: [g for g in lg.grams("zzz", n) if g in m.grams[n]] for n in (4, 3, 2, 1)}
    assert not longest[4] and not longest[3] and longest[1]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    m = lg.fit(small(spark))
    rows = lg.predicted(docs, m).collect()
    assert len(rows) == 15
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and (r["score"] == 0) == (not letters)
    assert lg.predicted(docs.limit(0), m).count() == 0
    assert {r["lang_pred"] for r in lg.predicted(docs, lg.fit(docs.limit(0))).collect()} == {"und"}
    assert docs.where("doc_id is null").select(lg.held_out().alias("h")).where(F.col("h")).count() == 2


def brute(rows, texts, p=lg.Params()):
    """(language, probability) of texts, learned from rows (lang, text) by plain counting."""
    tables = {0: defaultdict(Counter)} | {n: defaultdict(Counter) for n in p.grams}
    for lang, text in rows:
        tables[0][lang].update(lg.words(text))
    for lang, counted in tables[0].items():
        for word, times in counted.items():
            for n in p.grams:
                for g in lg.grams(word, n):
                    tables[n][lang][g] += times
    langs = sorted(tables[0])
    totals = {n: {x: sum(t[x].values()) for x in langs} for n, t in tables.items()}
    known = {n: {k for x in langs for k, c in t[x].items() if c >= p.share * totals[n][x]} for n, t in tables.items()}

    def logs(n, key):
        return [math.log((tables[n][x][key] or 0.5) / totals[n][x]) for x in langs]

    def of_word(word):
        if word in known[0]:
            return logs(0, word)
        for n in p.grams:
            found = [logs(n, g) for g in lg.grams(word, n) if g in known[n]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        scores = [of_word(w) for w in lg.words(text)]
        total = [sum(x) for x in zip(*scores, strict=True)] if scores else [0.0] * len(langs)
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


def test_predictions_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    learn = [(r["lang"], r["text"]) for r in docs if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    found = {r["doc_id"]: r for r in lg.op6_language_id(spark, SF).collect()}
    for r, (lang, score) in zip(docs, brute(learn, [r["text"] for r in docs]), strict=True):
        assert found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert found[r["doc_id"]]["lang_pred"] == lang and math.isclose(found[r["doc_id"]]["score"], score, rel_tol=1e-6, abs_tol=1e-9)


def test_marks_alone_are_no_words():
    assert lg.words("áb ́ ́́ ́c 1") == ["áb", "́c"]
