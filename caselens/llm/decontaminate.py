"""Benchmark decontamination with one Aho-Corasick automaton over the words of the test items.

The windows of all items (consecutive normalised words) are the patterns. The automaton runs over word
numbers, not characters: a sixth of the states, and matches are spans of words at once. Each text is
scanned once where it lies, without a shuffle, and spans are mapped back to characters of the original text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import blocks_for, read_table, stage, text_bytes, unstage

#: Bytes of item texts that one automaton holds; about 100 MB of states. Larger benchmarks take several, one after the other.
AUTOMATON_BYTES = 2 << 20

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Every byte that no word has becomes a blank; A-Z become a-z; bytes of other characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Params:
    """window: consecutive words of an item that count as a copy; an item with fewer is one window."""

    window: int = 10


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(NORMAL).split()


class Automaton:
    """All windows of the given (item_id, text) rows."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for at in range(max(1, len(seq) - window + 1) if seq else 0):
                owners[tuple(seq[at : at + window])].add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in owners.items():
            self.machine.add_word(key, (len(key), frozenset(ids)))
        self.any = bool(owners)
        if self.any:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(words, merged spans of hit words with ends excluded, items found)."""
        found = words(text)
        if not self.any or not found:
            return len(found), [], set()
        get = self.numbers.get
        spans: list[tuple[int, int]] = []
        items: set = set()
        for end, (n, ids) in self.machine.iter(tuple([get(w, 0) for w in found])):
            spans.append((end + 1 - n, end + 1))
            items |= ids
        merged: list[tuple[int, int]] = []
        for low, high in sorted(spans):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        return len(found), merged, items


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of characters of the original text."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    return [(at[low][0], at[high - 1][1]) for low, high in spans]


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", p: Params = Params()) -> DataFrame:
    """docs with n_words, n_hit, items (sorted as strings), spans (characters start to end of hit passages).

    Words are compared with A-Z lower-cased; a word of a text is hit when it lies in an occurrence of a window. Null,
    empty and wordless texts have no words; wordless items have no windows. Items without an id hit words
    but aren't listed; repeated items count once. Columns of docs are kept; the four replace columns of
    their names. The benchmark is read in parts of a proven size, one automaton each; of several, each is a pass over a written table.
    """
    spark = docs.sparkSession
    size = text_bytes(items, item_text_col)[1]
    n = blocks_for(size, AUTOMATON_BYTES)
    rows = items.select(F.col(f"`{item_col}`").cast("string").alias("id"), F.col(f"`{item_text_col}`").alias("text"))
    added = ("n_words", "n_hit", "items", "spans")
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    kept, staged = out.columns, None
    for i in range(n):
        part = [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).toLocalIterator()]
        out = _scanned(out, spark.sparkContext.broadcast(part), text_col, p, i)
        if n > 1:  # a task holds one automaton at a time
            before, out = staged, stage(out, "scanned")
            staged = out
            if before is not None:
                unstage(before)
    found = [F.col(f"__hits{i}") for i in range(n)]
    spans = F.array_sort(F.flatten(F.array(*[x["words"] for x in found]))) if n > 1 else found[0]["words"]
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate(spans, start, lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
    return out.select(
        *[F.col(f"`{c}`") for c in kept], found[0]["n"].alias("n_words"), hit.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[x["items"] for x in found])))).alias("items"),
        F.array_sort(F.flatten(F.array(*[x["chars"] for x in found]))).alias("spans"),
    )


def _scanned(docs: DataFrame, part, text_col: str, p: Params, i: int) -> DataFrame:
    hits = T.StructType([
        T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(SPAN)), T.StructField("chars", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())),
    ])
    schema = T.StructType([*docs.schema.fields, T.StructField(f"__hits{i}", hits)])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n", pa.int64()), ("words", pa.list_(span)), ("chars", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(part.value, p.window)
        for b in batches:
            rows = []
            for t in b.column(text_col):
                text = t.as_py()
                n, spans, items = machine.scan(text)
                as_spans = [{"start": x, "end": y} for x, y in spans]
                chars = [{"start": x, "end": y} for x, y in char_spans(text, spans)] if spans else []
                rows.append({"n": n, "words": as_spans, "chars": chars, "items": sorted(x for x in items if x is not None)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=schema.names)

    return docs.mapInArrow(scan, schema)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
with doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), item as (
  select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from benchmark
), windows as (
  select distinct item_id, n, win from (
    select item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) as win
    from item where len(w) > 0)
), sizes as (select distinct n from windows),
spots as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from doc, sizes where len(w) >= n)
), hits as (select s.doc_id, s.i, s.n, x.item_id from spots s join windows x on s.win = x.win and s.n = x.n),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hits where item_id is not null) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from doc d left join hit_words h using (doc_id) left join hit_items i using (doc_id)
"""
