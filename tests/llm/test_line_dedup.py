import random

from caselens.llm import line_dedup as ld
from tests.conftest import SF
from tests.llm.common import odd_documents

DOCS = "doc_id long, text string"


def lines(text):
    return [x for x in (l.strip(" \t\r\f\v").lower() for l in (text or "").split("\n")) if x]


def guaranteed(rows, p=ld.Params()):
    """(doc, first line, last line) of each shortest row of lines with enough words that stands earlier too."""
    seen, out = set(), []
    for i, text in sorted(rows):
        own, words = lines(text), []
        words = [x.count(" ") + 1 for x in own]
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += words[b]
                if total >= p.guarantee:
                    run = tuple(own[a : b + 1])
                    if run in seen:
                        out.append((i, a, b))
                    seen.add(run)
                    break
    return out


def check(spark, rows):
    found = {r["doc_id"]: r for r in ld.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    kept = {i: lines(r["text"]) for i, r in found.items()}
    for i, a, b in guaranteed(rows):
        own = lines(dict(rows)[i])
        for x in own[a : b + 1]:
            assert kept[i].count(x) < own.count(x)
    everything = {x for _, t in rows for x in lines(t)}
    assert everything == {x for k in kept.values() for x in k}
    for i, text in rows:
        assert found[i]["n_lines"] == len(lines(text)) and found[i]["n_lines"] - found[i]["n_removed"] == len(kept[i])
    return kept


def sentence(r, n):
    return " ".join(f"w{r.randrange(10_000)}" for _ in range(n))


def test_passages_go_from_later_documents(spark):
    r = random.Random(2)
    passage = [sentence(r, 15) for _ in range(4)]
    rows = []
    for i in range(12):
        own = [sentence(r, r.randrange(3, 30)) for _ in range(8)]
        at = r.randrange(8)
        rows.append((i, "\n".join(own[:at] + (passage if i % 2 else []) + own[at:])))
    kept = check(spark, rows)
    assert passage[0] in kept[1] and not any(passage[k] in kept[i] for i in (3, 5, 7, 9, 11) for k in range(4))
    assert all(len(kept[i]) == 8 for i in (0, 2, 4, 3, 5))


def test_short_shared_lines_stay(spark):
    r = random.Random(3)
    rows = [(i, "\n".join([sentence(r, 30), "a short common line", sentence(r, 30)])) for i in range(5)]
    assert all(len(k) == 3 for k in check(spark, rows).values())


def test_matches_are_extended_both_ways(spark):
    r = random.Random(4)
    passage = ["tiny start", sentence(r, 60), "tiny end"]
    rows = [(1, "\n".join(["own a", *passage, "own b"])), (2, "\n".join(["own c", *passage, "own d"]))]
    assert check(spark, rows)[2] == ["own c", "own d"]


def test_runs_that_the_earliest_place_holds_in_part(spark):
    r = random.Random(7)
    x, y, z = sentence(r, 25), sentence(r, 15), sentence(r, 12)

    def own():
        return sentence(r, 30)

    texts = [[own(), x, own()], [own(), x, y, own()], [own(), x, y, own()], [own(), z, x, own()], [own(), z, x, y, own()], [y, own()], [own(), z, x, y, own()], [own(), y, x, own()], [y, x]]
    kept = check(spark, [(i, "\n".join(t)) for i, t in enumerate(texts)])
    assert kept[2] == [texts[2][0], texts[2][3]] and y in kept[1]
    assert kept[6] == [texts[6][0], texts[6][4]] and kept[8] == []


def test_repeats_within_a_document(spark):
    r = random.Random(5)
    s = [sentence(r, 25), sentence(r, 25)]
    kept = check(spark, [(1, "\n".join(s * 6))])
    assert kept[1] == s


def test_spacing_and_case_of_lines(spark):
    r = random.Random(6)
    s = sentence(r, 50)
    found = {x["doc_id"]: x["text"] for x in ld.without_repeats(spark.createDataFrame([(1, s), (2, f"Own\n\n  {s.upper()}\t\r\n\nOther")], DOCS)).collect()}
    assert found[2] == "Own\n\n\nOther" and found[1] == s


def test_guarantee_on_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = ld.without_repeats(docs)
    rows = found.collect()
    assert len(rows) == 15 and set(docs.columns) <= set(found.columns)
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    # Without an id comes first; repeated rows are one document.
    assert all(r["n_removed"] == 1 for r in rows if r["doc_id"] in (5, 6)) and [r["n_removed"] for r in rows if r["doc_id"] is None and r["text"]] == [0]


def test_empty_table(spark):
    assert ld.without_repeats(odd_documents(spark).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = ld.op3_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_text_of_many_lines(spark):
    text = "\n".join(f"line {i} of a text with many lines that stand in two documents" for i in range(2000))
    rows = [(1, text), (2, text + "\nand a last line of its own")]
    found = {r["doc_id"]: r for r in ld.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["text"] == text and found[2]["text"] == "and a last line of its own" and found[2]["n_removed"] == 2000
