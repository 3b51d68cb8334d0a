import hashlib
import random

import numpy as np
import pytest

from caselens.llm import repeats as rp
from tests.conftest import SF
from tests.llm.common import odd_documents


def brute(w, least=12):
    """All maximal stretches by every lag, each with its smallest one."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= max(q, least - q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def search(docs, **options):
    flat = np.array([x for d in docs for x in d], np.int64)
    found = rp.runs(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), rp.Params(**options))
    return [found.get(k, []) for k in range(len(docs))]


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(r.randrange(1, 6)):
            w = [r.randrange(r.choice([1, 2, 3, 40])) for _ in range(r.randrange(200))]
            if w and r.random() < 0.7:
                s = r.randrange(len(w))
                q = 1 + r.randrange(max(1, (len(w) - s) // 2))
                for i in range(s, r.randrange(s, len(w))):
                    w[i] = w[s + (i - s) % q]
            docs.append(w)
        assert search(docs) == [brute(w) for w in docs]
    assert search(docs, least=8) == [brute(w, 8) for w in docs]


def test_texts_that_repeat_all_over():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert search([b, [7] * 500, [1, 2] * 300 + [3]]) == [brute(b), [(0, 500, 1)], [(0, 600, 2)]]
    assert search([[7] * 300_000]) == [[(0, 300_000, 1)]]
    assert search([[], [5] * 11, [5] * 12]) == [[], [], [(0, 12, 1)]]


def test_equals_sql(same_rows):
    same_rows(rp.op12_periodic_runs, rp.OP12_SQL)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = rp.periodic_runs(docs).collect()
    texts = [r["text"] for r in docs.collect()]
    assert len(rows) == len(texts)
    wanted = []
    for t in texts:
        w = (t or "").encode().split()
        found = brute(w) if len(w) < 1000 else []
        wanted.append((tuple(found), b" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)).decode()))
    assert sorted((tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in rows) == sorted(wanted)
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows if r["doc_id"] == 11] == [(11, [(0, 50, 1)], "line")]
    assert rp.periodic_runs(docs.limit(0)).count() == 0


def test_digests_of_a_text_without_runs(spark, tmp_path):
    spark.createDataFrame([(2, "a  b\nc"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in rp.op12_periodic_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[3]["collapsed_sha256"] == rows[3]["runs_sha256"] == rows[2]["runs_sha256"] == empty and rows[3]["n_runs"] == 0
    assert rows[2]["collapsed_sha256"] == hashlib.sha256(b"a b c").hexdigest() and rows[2]["start"] is None and rows[2]["exponent_milli"] is None
