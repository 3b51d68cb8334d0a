import regex

from caselens.llm import decontaminate as dc
from tests.llm.common import odd_documents

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n=10):
    own, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        for win in [w[j : j + n] for j in range(max(1, len(w) - n + 1))] if w else []:
            for j in range(len(own) - len(win) + 1):
                if own[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    if i is not None:
                        found.add(str(i))
    return len(own), len(hit), sorted(found)


ITEMS = [(1, "What is the Capital of France, and why is it so very large today?"), (2, "Short one"), (3, ""), (None, "no id here"), (2, "Short one"), (10, "a b c d e f g h i j k"), (11, "Été à Paris: ça va"), (4, None)]
TEXTS = [
    "Before. WHAT is the capital\nof France (and why) is it so very large today? after short-one!", "short  one short one", "x a b c d e f g h i j k y a b c d e f g h i j", "no ID here", "été À paris ça va", "Été à Paris ça va", None, "", "!!!",
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in dc.contamination(docs, items).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(TEXTS[r["doc_id"]], ITEMS)
        if r["doc_id"] == 0:
            text = TEXTS[0]
            assert [text[s["start"] : s["end"]] for s in r["spans"]] == ["WHAT is the capital\nof France (and why) is it so very large today", "short-one"]


def test_several_automata_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(dc, "AUTOMATON_BYTES", 40)
    for r in dc.contamination(docs, items).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(TEXTS[r["doc_id"]], ITEMS)


def test_equals_sql(same_rows):
    same_rows(dc.op8_decontaminate, dc.OP8_SQL)


def test_odd_documents(spark):
    docs, items = odd_documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.contamination(docs, items)
    rows = found.collect()
    assert len(rows) == 15 and found.columns == [*(c for c in docs.columns), "n_words", "n_hit", "items", "spans"]
    assert all((r["n_words"], r["n_hit"]) == brute(r["text"], [])[:2] for r in rows if r["doc_id"] != 4)
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in dc.contamination(docs, items.limit(0)).collect()} == {0}
