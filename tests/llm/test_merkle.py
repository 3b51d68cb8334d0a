import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import merkle as mk
from tests.llm.common import odd_documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows, columns, changed, arity=2):
    """(id, leaf, subroot, root, proof, folded) of rows, by hashing every tree from scratch and walking every way."""

    def leaf(row):
        return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def walk(node, i, tree, proof):
        for nodes in tree[:-1]:
            run = nodes[i // arity * arity : i // arity * arity + arity]
            at = i % arity
            proof += run[:at] + run[at + 1 :]
            node, i = h(*run[:at], node, *run[at + 1 :]), i // arity
        return node

    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    found = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            proof = []
            node = walk(leaf(changed(row)), i, trees[g], proof)
            node = walk(node, k, top, proof)
            found.append((row["doc_id"], leaf(row), trees[g][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return sorted(found, key=str)


@pytest.mark.parametrize("arity,levels", [(2, 2), (3, 1), (2, 12), (4, 2)])
def test_against_brute_force(spark, arity, levels):
    r = random.Random(arity)
    rows = [{"doc_id": i // 2 if i % 9 == 0 else i, "lang": r.choice(["en", "en", "en", "de", None, "é", "=", "single"] if i != 5 else ["alone"]), "n": r.choice([None, 1, 22])} for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, n long")
    p = mk.Params(arity=arity, levels=levels)
    bad = F.when(F.col("doc_id") % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))
    found = mk.verified(docs, docs.columns, {"n": bad}, p=p).collect()
    wanted = brute(rows, docs.columns, lambda x: x | {"n": x["n"] if x["n"] is None or x["doc_id"] % 7 else x["n"] + 1}, arity)
    assert sorted(map(tuple, found), key=str) == wanted
    assert 0 < sum(not x["verified"] for x in found) < len(found)


def test_equals_sql(same_rows):
    same_rows(mk.op11_merkle, mk.OP11_SQL)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    columns = ["doc_id", "text", "lang", "key"]
    found = mk.verified(docs, columns, {})
    assert sorted(map(tuple, found.collect()), key=str) == brute([r.asDict() for r in docs.collect()], columns, lambda x: x)
    assert found.where("not verified").count() == 0
    assert mk.verified(docs.limit(0), columns, {}).count() == 0
    one = docs.where("doc_id = 4")
    row = mk.verified(one, columns, {}).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_states_and_digests_are_those_of_the_library():
    r = np.random.default_rng(2)
    digests = r.integers(0, 2**32, (8, 40), np.uint32)
    raw = mk._bytes(digests)
    text = [raw[i : i + 32].hex().encode() for i in range(0, len(raw), 32)]
    state, whole = mk._first(40), [hashlib.sha256() for _ in text]
    for blocks in range(4):
        assert mk._bytes(mk.ended(state, blocks)) == b"".join(x.digest() for x in whole)
        state = mk.taken_in(state, mk.hex_block(digests))
        for x, t in zip(whole, text):
            x.update(t)


def test_parents_keep_the_states_before_each_child(spark):
    leaves = np.random.default_rng(3).integers(0, 2**32, (8, 5), np.uint32)
    p = mk.Params(arity=3)
    digests, states = mk.grown(leaves, mk.counts_of(5, False, p), p)
    assert [d.shape[1] for d in digests] == [5, 2, 1]
    assert (states[0][:, 1] == mk.taken_in(mk._first(1), mk.hex_block(leaves[:, :1]))[:, 0]).all()
    changed = leaves[:, 1:2] ^ np.uint32(1)
    run = mk.taken_in(mk.taken_in(states[0][:, 1:2], mk.hex_block(changed)), mk.hex_block(leaves[:, 2:3]))
    way = mk.Fold(changed)
    way.up(states[0][:, 1:2], np.array([1]), np.array([3]), lambda k, where: leaves[:, k : k + 1])
    assert (way.digest == mk.ended(run, 3)).all()
