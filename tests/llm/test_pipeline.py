import random

import corpus_pipeline as cp
from caselens.llm.common import read_table
from tests.conftest import SF
from tests.llm import test_decontaminate as dc
from tests.llm import test_line_dedup as ld
from tests.llm import test_near_dedup as nd
from tests.llm.common import odd_documents


def test_every_stage_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "near-dedup", "decontamination", "BPE encoding"]
    columns = docs.columns

    known = cp.stage(steps["language ID"](spark, docs, SF), "t")
    gone = set(r["doc_id"] for r in docs.collect()) - set(r["doc_id"] for r in known.collect())
    assert known.columns == columns and all(not any(c.isalpha() for c in r["text"] or "") for r in docs.collect() if r["doc_id"] in gone)

    lines = cp.stage(steps["line dedup"](spark, known, SF), "t")
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (known, lines))
    assert lines.columns == columns and {x for t in before.values() for x in ld.lines(t)} == {x for t in after.values() for x in ld.lines(t)}
    for i, a, b in ld.guaranteed(list(before.items())):
        for x in ld.lines(before[i])[a : b + 1]:
            assert ld.lines(after.get(i)).count(x) < ld.lines(before[i]).count(x)

    near = cp.stage(steps["near-dedup"](spark, lines, SF), "t")
    want = {i for i, (_, c) in nd.brute(list(after.items())).items() if i == c}
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == want

    clean = cp.stage(steps["decontamination"](spark, near, SF), "t")
    want = {r["doc_id"] for r in near.collect() if dc.brute(r["text"], items)[1] == 0}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == want

    coded = steps["BPE encoding"](spark, clean, SF)
    assert coded.count() == clean.count() and coded.where("not round_trip").count() == 0
    assert sorted(r["doc_id"] for r in cp.run(spark, SF).collect()) == sorted(want)


def test_stages_take_odd_documents(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, step in cp.STAGES:
            docs = cp.stage(step(spark, docs, SF), "t")


def test_near_dedup_links_from_four_fifths(spark):
    r = random.Random(8)
    rows, columns = [], read_table(spark, SF, "documents").columns
    for family in range(8):
        base = [f"w{r.randrange(900)}" for _ in range(104)]
        for copy, cut in enumerate((0, 18, 26)):  # similarities 0.82 and 0.74 to the first
            rows.append((family * 10 + copy * (1 if family % 2 else 3), " ".join(base[: 104 - cut] if copy < 2 else base[cut:])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = {x["doc_id"] for x in cp.remove_near_duplicates(spark, docs.select(*columns), SF).collect()}
    assert near == {i for i, (_, c) in nd.brute(rows, 80).items() if i == c}
    assert near != {i for i, (_, c) in nd.brute(rows, 85).items() if i == c}
