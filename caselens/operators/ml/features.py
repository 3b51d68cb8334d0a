"""Features of deviations: text, types, severity, time, officers; fitted once, applied as Spark ML stages."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import times, vocab

#: A word as the vectoriser takes it.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Words up to which pairs are held against a list of them.
MANY = 10_000


def fitted_text(devs: DataFrame, column: str = "description", terms: int = 100, min_df: int = 2, max_df: float = 0.8) -> PipelineModel:
    """TF-IDF of single words and pairs: English stop words out, the most frequent terms, smoothed idf, rows of length 1."""
    stages = terms_of(column)
    counted = Pipeline(stages=stages).fit(devs)
    n = devs.count()
    known = [(r["term"], r["documents"]) for r in vocabulary(devs, column, terms, min_df, max_df, n).collect()] or [("", 0)]  # `terms` of them at most
    counter = CountVectorizerModel.from_vocabulary([term for term, _ in known], inputCol="__terms", outputCol="__counts")
    idf = [math.log((n + 1) / (documents + 1)) + 1 for _, documents in known]
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__counts", outputCol="__scaled")
    return PipelineModel([*counted.stages, counter, scaled, Normalizer(inputCol="__scaled", outputCol="text_features")])


def terms_in(model: PipelineModel) -> list[str]:
    """The terms of fitted text, by their places in the vector."""
    return next(x.vocabulary for x in model.stages if isinstance(x, CountVectorizerModel))


def terms_of(column: str) -> list:
    """Stages that add __terms: words of two letters, digits or underscores and more, in any script and lower-cased, without stop words, then pairs of them."""
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=WORD, gaps=False, toLowercase=True)
    kept = StopWordsRemover(inputCol="__words", outputCol="__kept", stopWords=list(vocab.STOP_WORDS))
    pairs = NGram(n=2, inputCol="__kept", outputCol="__pairs")
    return [
        SQLTransformer(statement=f"select *, coalesce({column}, '') as __text from __THIS__"), words, kept, pairs,
        SQLTransformer(statement="select *, concat(__kept, __pairs) as __terms from __THIS__"),
    ]


def vocabulary(devs: DataFrame, column: str = "description", terms: int = 100, min_df: int = 2, max_df: float = 0.8, n: int | None = None) -> DataFrame:
    """(term, documents, times) of the most frequent terms, ties by name, that stand in min_df rows or more and in a share of max_df or less; n: rows, if known.

    Single words come first. A pair is never more frequent than either of its words, nor before its first word by name. So where single words fill the list, a
    pair only enters it if both words are more frequent than the last of the list, or if its first word stands before the last and the pair does so by name;
    where they don't, only if both words are in min_df rows. Such words are a list that the rest of the table doesn't lengthen; other pairs aren't counted.
    """
    n = devs.count() if n is None else n
    rows = Pipeline(stages=terms_of(column)[:3]).fit(devs).transform(devs).select("__kept")
    words = _counted(rows, F.col("__kept")).where(F.col("documents") >= min_df)
    fits, order = F.col("documents") <= max_df * n, (F.desc("times"), "term")
    often = words.where(~fits).limit(MANY + 1)  # words a row / max_df at most
    found = words.where(fits).orderBy(*order).limit(terms).withColumn("fits", F.lit(True)).unionByName(often.withColumn("fits", F.lit(False))).collect()
    top = sorted((r for r in found if r["fits"]), key=lambda r: (-r["times"], r["term"].encode()))
    a, b = F.col("__kept"), F.slice("__kept", F.lit(2), F.greatest(F.size("__kept") - 1, F.lit(0)))
    pairs = F.zip_with(a, b, lambda a, b: F.when(_may_enter(found, top, terms, a, b), F.concat(a, F.lit(" "), b)))
    both = rows.select(F.filter(pairs, lambda x: x.isNotNull()).alias("__found"))
    known = devs.sparkSession.createDataFrame([(r["term"], r["documents"], r["times"]) for r in top], "term string, documents long, times long")  # `terms` at most
    return known.unionByName(_counted(both, F.col("__found")).where((F.col("documents") >= min_df) & fits)).orderBy(*order).limit(terms)


def _may_enter(found: list, top: list, terms: int, a: Column, b: Column) -> Column:
    """Whether the pair of words a and b may be one of the most frequent terms, of which `top` are the single words and `found` these and the too frequent ones."""
    if len(found) > MANY:
        return b.isNotNull()
    if len(top) < terms or not top:
        known = [r["term"] for r in found]
        return b.isNotNull() & a.isin(known) & b.isin(known)
    last = top[-1]
    more = [r["term"] for r in found if r["times"] > last["times"]]
    before = [r["term"] for r in found if r["times"] >= last["times"] and r["term"].encode() < last["term"].encode()]
    return b.isNotNull() & (a.isin(more) & b.isin(more) | a.isin(before) & (F.concat(a, F.lit(" "), b) < last["term"]))


def _counted(rows: DataFrame, found: Column) -> DataFrame:
    """(term, documents, times) of arrays of terms; in a sorted array, a term's first place counts as its document."""
    sort = rows.select(F.sort_array(found).alias("term"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "term"), F.lit(1), F.size("term")).alias("before")
    each = sort.select(F.explode(F.arrays_zip("term", before)).alias("t"))
    return each.groupBy("t.term").agg(F.count_if(~F.col("t.term").eqNullSafe(F.col("t.before"))).alias("documents"), F.count(F.lit(1)).alias("times"))


def top_values(devs: DataFrame, column: str, n: int = 20) -> list[str]:
    """The n most frequent values; a short list, the fitted part of a one-hot encoding."""
    rows = devs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)
    return [r[column] for r in rows.collect()]


def slot(column: str, values: list[str]) -> Column:
    """Place of a value in the list, -1 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int"), F.lit(0)) - 1 if values else F.lit(-1)


def one_hot(column: str, values: list[str]) -> Column:
    """A vector with 1 at the place of a value in the list. It is one column, not one for each value: the JVM doesn't compile code that grows with the list."""
    hot = F.transform(F.array(*map(F.lit, values)), lambda x: F.coalesce((F.col(column) == x).cast("double"), F.lit(0.0)))
    names = {"ml_attr": {"num_attrs": len(values), "attrs": {"numeric": [{"idx": i, "name": str(i)} for i in range(len(values))]}}}
    return array_to_vector(hot).alias(f"__{column}", metadata=names)


def numeric() -> dict[str, Column]:
    """Severity 4 to 1 (1 for unknown ones) and the length of the description."""
    score = F.lit(1)
    for name, weight in vocab.SEVERITY_WEIGHTS.items():
        score = F.when(F.col("severity") == name, weight).otherwise(score)
    return {"severity_score": score.cast("double"), "description_length": F.coalesce(F.length("description"), F.lit(0)).cast("double")}


def temporal(devs: DataFrame) -> dict[str, Column]:
    """Hour and weekday as parts of the day and the week, a half where there is no readable time."""
    ts = times.event_time(devs, ("detected_at", "created_at"))
    return {"hour_part": F.coalesce(F.hour(ts) / 24, F.lit(0.5)), "weekday_part": F.coalesce(F.weekday(ts) / 7, F.lit(0.5))}


@dataclass
class Features:
    """Fitted features: the text stages and the lists of types and officers, kept for new data."""

    text: PipelineModel
    types: list[str]
    officers: list[str]

    def transform(self, devs: DataFrame) -> DataFrame:
        """devs with a vector `features`."""
        hot = [one_hot(c, values) for c, values in (("deviation_type", self.types), ("officer_id", self.officers)) if values]
        rows = self.text.transform(devs).select(*devs.columns, "text_features", *hot, *[c.alias(n) for n, c in (numeric() | temporal(devs)).items()])
        made = [c for c in rows.columns if c not in devs.columns]
        return VectorAssembler(inputCols=made, outputCol="features").transform(rows).drop(*made)


def fit(devs: DataFrame) -> Features:
    return Features(fitted_text(devs), top_values(devs, "deviation_type"), top_values(devs, "officer_id"))


def fitted_stages(devs: DataFrame) -> PipelineModel:
    """The same features as `fit` gives, as a pipeline that can be written: text, one-hot types and officers, numbers and times, assembled with their names."""
    found = fit(devs)
    quoted = {c: [(f"{c}_{i}", "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'") for i, v in enumerate(values)] for c, values in (("deviation_type", found.types), ("officer_id", found.officers))}
    hot = [f"coalesce(cast({c} = {v} as double), 0D) as {n}" for c, own in quoted.items() for n, v in own]
    weights = " ".join(f"when severity = '{n}' then {w}D" for n, w in vocab.SEVERITY_WEIGHTS.items())
    plain = [f"case {weights} else 1D end as severity_score", "cast(coalesce(length(description), 0) as double) as description_length"]
    when = _time_sql(devs)
    timed = [f"coalesce(hour({when}) / 24, 0.5D) as hour_part", f"coalesce(weekday({when}) / 7, 0.5D) as weekday_part"]
    made = [*(n for own in quoted.values() for n, _ in own), "severity_score", "description_length", "hour_part", "weekday_part"]
    added = SQLTransformer(statement=f"select *, {', '.join([*hot, *plain, *timed])} from __THIS__")
    assembled = VectorAssembler(inputCols=["text_features", *made], outputCol="features")
    dropped = SQLTransformer(statement=f"select * except ({', '.join(['text_features', *made, *TEXT_COLUMNS])}) from __THIS__")
    return PipelineModel([*found.text.stages, added, assembled, dropped])


#: Columns that the stages of texts add.
TEXT_COLUMNS = ("__text", "__words", "__kept", "__pairs", "__terms", "__counts", "__scaled")


def _time_sql(devs: DataFrame) -> str:
    """The time of a row as `temporal` reads it, in SQL."""
    there = [c for c in ("detected_at", "created_at") if c in devs.columns]
    if not there:
        return "cast(null as timestamp)"
    if all(dict(devs.dtypes)[c] != "string" for c in there):
        return f"coalesce({', '.join(there)})"
    cut = "regexp_replace(split_part(trim(coalesce(" + ", ".join(f"nullif(cast({c} as string), '')" for c in there) + ")), '.', 1), 'Z$', '')"
    return "coalesce(" + ", ".join("try_to_timestamp({}, '{}')".format(cut, f.replace("'", "\\'")) for f in times.FORMATS) + ")"


def standardised(df: DataFrame, column: str = "features", of: DataFrame | None = None) -> DataFrame:
    """df with column at mean 0 and deviation 1 of the population, which is `of`, or else df itself; constant components become 0."""
    of = df if of is None else of
    n = of.count()
    if n < 2:
        return df
    model = StandardScaler(inputCol=column, outputCol="__scaled", withMean=True, withStd=True).fit(of)
    back = ElementwiseProduct(scalingVec=Vectors.dense([(n / (n - 1)) ** 0.5] * len(model.mean)), inputCol="__scaled", outputCol="__population")
    return back.transform(model.transform(df)).drop("__scaled", column).withColumnRenamed("__population", column)


def standardised_components(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, position, z) of arrays: every component against mean and population deviation of its position; 0 where constant."""
    parts = df.select(id_col, F.posexplode(vector_col).alias("position", "x")).withColumn("x", F.col("x").cast("double"))
    stats = parts.groupBy("position").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("x") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return parts.join(F.broadcast(stats), "position").select(id_col, "position", z.alias("z"))  # a row a component


def nearest_and_farthest(df: DataFrame, id_col: str, vector_col: str, cluster_col: str, near: int = 2, far: int = 3) -> DataFrame:
    """(id, cluster, distance, nearest, farthest): the rows nearest to and farthest from their cluster's mean, by rank.

    Clusters of near + far rows or fewer are whole. Means and distances are grouped sums over components.
    """
    parts = df.select(id_col, cluster_col, F.posexplode(vector_col).alias("position", "x"))
    means = parts.groupBy(cluster_col, "position").agg(F.avg("x").alias("mean"))
    gaps = parts.join(means, [cluster_col, "position"]).groupBy(id_col, cluster_col).agg(F.sqrt(F.sum((F.col("x") - F.col("mean")) ** 2)).alias("distance"))
    group = Window.partitionBy(cluster_col)
    ranked = gaps.withColumns({
        "nearest": F.row_number().over(group.orderBy("distance", id_col)), "farthest": F.row_number().over(group.orderBy(F.desc("distance"), id_col)),
    })
    return ranked.where((F.col("nearest") <= near) | (F.col("farthest") <= far))
