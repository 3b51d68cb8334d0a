"""Quality classifier: evidence of the text combined with shrunken rates of its host and path.

Evidence: hashed features of the text, weighted by their log odds among labelled documents; counts come from
grouped sums over all labelled rows, and only features whose rates differ beyond doubt have a weight. Sites:
the documents' probabilities are summed by path and by host; a host's rate is shrunk toward the global one and
a path's toward its host's, the more the fewer documents it has, with strengths estimated from the spread
between sites (empirical Bayes). A document's posterior odds are its evidence times its path's odds against
the global odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import read_table, sized_broadcast, slices, stage

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…·•"
TARGETS = ("quality", "toxic")


@dataclass(frozen=True)
class Params:
    """bits: 2^bits hashed features; doubt: deviations by which the log odds of a feature
    must differ from 0, so that one seen in a few documents has no weight; strongest: largest weight. A document is kept with keep_quality
    or more and less than keep_toxic; the latter is high because most documents are clean."""

    bits: int = 24
    doubt: float = 3.5
    strongest: float = 6.0
    keep_quality: float = 0.5
    keep_toxic: float = 0.9


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed features: words, runs of punctuation after words, tokens of punctuation only, shouting, shape of the text."""
    tokens = [] if text is None else text.split()
    found = set()
    caps = marks = tails = 0
    for t in set(tokens):
        core = t.rstrip(PUNCTUATION)
        if not core:
            found.add("p" + t[:4])
            marks += 1
            continue
        tail = t[len(core) :]
        if len(tail) > 1:
            found.add("t" + tail[:4])
            tails += 1
        if len(core) > 1 and core.isupper():
            caps += 1
        found.add("w" + core.strip(PUNCTUATION).lower())
    n = max(1, len(set(tokens)))
    found.add(f"c{caps * 8 // n}")
    found.add(f"m{marks * 32 // n}")
    found.add(f"e{tails * 8 // n}")
    found.add(f"n{min(4, len(tokens).bit_length())}")
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) & mask for x in found), np.int64, len(found)))


@dataclass(frozen=True)
class Weights:
    """Sorted hashed features, a row of weights for each (a column for each target), and the prior log odds of each target."""

    bins: np.ndarray
    values: np.ndarray
    prior: np.ndarray

    def evidence(self, found: np.ndarray) -> np.ndarray:
        if not len(self.bins):
            return self.prior
        at = np.minimum(np.searchsorted(self.bins, found), len(self.bins) - 1)
        return self.prior + self.values[at[self.bins[at] == found]].sum(axis=0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> Weights:
    """Weights of the features that tell targets apart. All labelled documents are counted, and only features of weight leave the cluster.

    A document's label is positive if most of its label rows are; null labels don't count.
    """
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.avg((F.col(t) > 0).cast("int")).alias(t) for t in TARGETS])
    told = told.select("id", *[(F.col(t) > 0.5).cast("int").alias(t) for t in TARGETS])
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sized_broadcast(told), "id").select(*TARGETS, "text")
    every = 1 << p.bits  # stands in all documents
    names = [f"{v}_{t}" for t in TARGETS for v in ("yes", "no")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2)):
            got = [np.append(features(t.as_py(), p.bits), every) for t in b.column(2)]
            found, which = np.unique(np.concatenate([np.empty(0, np.int64), *got]), return_inverse=True)
            sizes = [len(x) for x in got]
            sums = []
            for t in range(len(TARGETS)):
                label = np.repeat(np.array([-1 if x is None else x for x in b.column(t).to_pylist()], np.int64), sizes)
                sums += [np.bincount(which[label == v], minlength=len(found)) for v in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(x.astype(np.int64)) for x in sums)], names=["bin", *names])

    counted = stage(met.mapInArrow(count, "bin long, " + ", ".join(f"{c} long" for c in names)).groupBy("bin").agg(*[F.sum(c).alias(c) for c in names]), "counts")
    totals = counted.where(F.col("bin") == every).first()
    n = {c: float(totals[c]) if totals else 0.0 for c in names}
    odds, sure = [], []
    for t in TARGETS:
        yes, no = F.col(f"yes_{t}"), F.col(f"no_{t}")
        gap = F.log((yes + 0.5) / (n[f"yes_{t}"] + 1)) - F.log((no + 0.5) / (n[f"no_{t}"] + 1))
        sure.append(F.abs(gap) >= p.doubt * F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)))
        odds.append(F.when(sure[-1], F.greatest(F.lit(-p.strongest), F.least(F.lit(p.strongest), gap))).otherwise(0.0).alias(t))
    some = sure[0]
    for x in sure[1:]:
        some = some | x
    kept = counted.where((F.col("bin") != every) & some).select("bin", *odds).orderBy("bin").toPandas()  # 2^bits rows at most, hundreds in fact
    prior = [np.log((n[f"yes_{t}"] + 0.5) / (n[f"no_{t}"] + 0.5)) for t in TARGETS]
    return Weights(kept["bin"].to_numpy(np.int64), kept[list(TARGETS)].to_numpy(float).reshape(-1, len(TARGETS)), np.array(prior))


def _logit(x: Column) -> Column:
    x = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    return F.log(x / (1 - x))


def _strength(sites: DataFrame, n: str, s: str) -> tuple[float, float]:
    """(overall rate, prior strength) of sites with n documents and a sum s of probabilities, by the method of moments."""
    a = sites.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.count(F.lit(1)).alias("h"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("ss")).first()
    if not a["n"]:
        return 0.5, 1.0
    rate = a["s"] / a["n"]
    spread = a["ss"] - rate * a["s"] - (a["h"] - 1) * rate * (1 - rate)
    weight = a["n"] - a["nn"] / a["n"]
    between = max(spread / weight if weight > 0 else 0.0, 1e-4 * rate * (1 - rate), 1e-9)
    return rate, min(1e6, max(1.0, rate * (1 - rate) / between - 1))


def sites_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path) of pages: the host of the address in lower case without its port, and the first part of its path ("" of none)."""
    url = F.col(f"`{url_col}`")
    host, path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return pages.select(F.col(f"`{id_col}`").alias("id"), F.nullif(host, F.lit("")).alias("host"), path.alias("path")).where("host is not null")


def posteriors(docs: DataFrame, weights: Weights, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), sites: DataFrame | None = None) -> DataFrame:
    """(id_col, host, path, and for each target evidence_, host_, path_ and p_; keep) of every row of docs.

    sites: (id, host, path) of documents whose address is known, the first in order if there are several; host and path are for the
    others. evidence is in log odds. Null and empty texts have the prior as their evidence; null hosts and paths are sites of their
    own. Repeated rows count as often as they stand there. Without labels every evidence is even. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [f"evidence_{t}" for t in TARGETS]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in (part for whole in batches for part in slices(whole, 3)):
            got = [w.evidence(features(t.as_py(), p.bits)) for t in b.column(3)]
            sums = np.clip(np.array(got, float).reshape(b.num_rows, len(TARGETS)), -20, 20)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(sums[:, t]) for t in range(len(TARGETS)))], names=[*b.schema.names[:3], *names])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(f"`{text_col}`").alias("text"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, host string, path string, " + ", ".join(f"{c} double" for c in names)
    evidence = rows.mapInArrow(weigh, kind)
    if sites is not None:
        known = sites.groupBy("id").agg(F.min(F.struct("host", "path")).alias("site"))
        evidence = evidence.join(known, "id", "left").select("id", *[F.when(F.col("site").isNull(), F.col(c)).otherwise(F.col(f"site.{c}")).alias(c) for c in ("host", "path")], *names)
    evidence = stage(evidence, "evidence")
    sums = [F.sum(1 / (1 + F.exp(-F.col(c)))).alias(f"s_{t}") for c, t in zip(names, TARGETS, strict=True)]
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS])
    paths, hosts = stage(paths, "paths"), stage(hosts, "hosts")
    met = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    rates = {}
    for t in TARGETS:
        rates[t], strong = _strength(hosts, "n_host", f"h_{t}")
        _, strong_path = _strength(paths, "n", f"s_{t}")
        met = met.withColumn(f"host_{t}", (F.col(f"h_{t}") + strong * rates[t]) / (F.col("n_host") + strong))
        met = met.withColumn(f"path_{t}", (F.col(f"s_{t}") + strong_path * F.col(f"host_{t}")) / (F.col("n") + strong_path))
    found = met.select(F.col("host").alias("host_"), F.col("path").alias("path_"), *[f"{x}_{t}" for t in TARGETS for x in ("host", "path")])
    out = evidence.join(sized_broadcast(stage(found, "sites")), F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")))
    odds = {t: F.col(f"evidence_{t}") + _logit(F.col(f"path_{t}")) - _logit(F.lit(float(rates[t]))) for t in TARGETS}
    out = out.select(
        F.col("id").alias(id_col), "host", "path", *[c for t in TARGETS for c in (f"evidence_{t}", f"host_{t}", f"path_{t}")],
        *[(1 / (1 + F.exp(-odds[t]))).alias(f"p_{t}") for t in TARGETS],
    )
    return out.withColumn("keep", (F.col("p_quality") >= p.keep_quality) & (F.col("p_toxic") < p.keep_toxic))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Page n of `pages` is taken as the address of document n; documents without one have their source and language as their site."""
    docs = read_table(spark, sf_dir, "documents")
    weights = fit(docs, read_table(spark, sf_dir, "labels"))
    return posteriors(docs, weights, F.col("source"), F.col("lang"), sites=sites_of(read_table(spark, sf_dir, "pages")))
