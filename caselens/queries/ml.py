"""Features, clusters, outliers and samples of the deviations of the order lines, and of the embeddings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators.ml import clusters as c
from caselens.operators.ml import epsjoin
from caselens.operators.ml import features as f
from caselens.operators.ml import outliers as o
from caselens.operators.ml import sampling as s
from caselens.registry import query
from caselens.sources import tables as t
from caselens.sources.tables import DEVIATIONS

# Cluster, score and distance of every deviation, by arithmetic: what summaries and samples are given.
LABELLED = f"""{DEVIATIONS}, given as (select *, substr(expected_behavior, 6, length(expected_behavior) - 14)::bigint as k from devs), rows as (
  select * exclude (k), (k % 7 - 1)::int as cluster, (k % 1000) / 1000.0::double - 0.01::double as score, (k % 1000) < 10 as is_anomaly, (k % 997)::double as distance from given)"""
W = f"with {LABELLED}"


def labelled(spark, sf):
    k = F.regexp_extract("expected_behavior", r"(\d+)", 1).cast("long")
    return t.deviations(spark, sf).withColumns({
        "cluster": (k % 7 - 1).cast("int"), "score": (k % 1000) / 1000.0 - 0.01, "is_anomaly": (k % 1000) < 10, "distance": (k % 997).cast("double"),
    })


def vectors(spark, sf):
    return t.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _vocabulary(table: str, key: str, text: str) -> str:
    """SQL of term, documents and times of the vocabulary of a table's texts."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in vocab.STOP_WORDS)
    return f"""words as (select {key}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in ({stop})) as w from {table}),
terms as (select {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from words),
vocabulary as (select term, count(distinct {key}) as documents, count(*) as times from terms group by term having count(distinct {key}) between 2 and 0.8 * (select count(*) from {table}) order by times desc, term limit 100)"""


@query("h1_vocabulary", f"with {_vocabulary('documents', 'doc_id', 'text')} select * from vocabulary")
def h1_vocabulary(spark, sf):
    return f.vocabulary(t.read(spark, sf, "documents").select(F.col("text").alias("description")))


WEIGHTS = f"""{_vocabulary('documents', 'doc_id', 'text')}, n as (select count(*) as n from documents),
counted as (select doc_id, term, count(*) as tf, any_value(documents) as documents from terms join vocabulary using (term) group by doc_id, term),
raw as (select doc_id, term, tf, tf * (ln((n + 1.0::double) / (documents + 1)) + 1) as w from counted cross join n),
weights as (select doc_id, term, tf, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)"""


@query("h1_text_features", f"with {WEIGHTS} select doc_id, (select count(*) from vocabulary)::int as terms, round(coalesce((select sum(weight * weight) from weights w where w.doc_id = d.doc_id), 0), 6) as squared_length from documents d")
def h1(spark, sf):
    devs = t.read(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    rows = f.fitted_text(devs).transform(devs)
    v = vector_to_array("text_features")
    return rows.select("doc_id", F.size(v).alias("terms"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_length"))


@query("h1_term_weights", f"with {WEIGHTS} select doc_id, term, round(weight, 6) as weight from weights")
def h1_weights(spark, sf):
    devs = t.read(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    model = f.fitted_text(devs)
    words = F.array(*map(F.lit, f.terms_in(model)))
    each = model.transform(devs).select("doc_id", F.posexplode(vector_to_array("text_features")).alias("at", "weight")).where("weight > 0")
    return each.select("doc_id", F.get(words, F.col("at")).alias("term"), F.round("weight", 6).alias("weight"))


def _slots(column: str) -> str:
    return f"""with {DEVIATIONS}, top as (select {column}, row_number() over (order by count(*) desc, {column}) - 1 as slot from devs group by {column} order by count(*) desc, {column} limit 20)
select deviation_id, coalesce(slot, -1)::int as slot from devs left join top using ({column})"""


@query("h2_type_slots", _slots("deviation_type"))
def h2(spark, sf):
    devs = t.deviations(spark, sf)
    return devs.select("deviation_id", f.slot("deviation_type", f.top_values(devs, "deviation_type")).alias("slot"))


@query("h3_numeric_features", f"with {DEVIATIONS} select deviation_id, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end::double as severity_score, length(description)::double as description_length from devs")
def h3(spark, sf):
    return t.deviations(spark, sf).select("deviation_id", *[v.alias(n) for n, v in f.numeric().items()])


@query("h4_time_features", f"with {DEVIATIONS} select deviation_id, round(hour(detected_at) / 24, 6) as hour_part, round((isodow(detected_at) - 1) / 7, 6) as weekday_part from devs")
def h4(spark, sf):
    devs = t.deviations(spark, sf)
    return devs.select("deviation_id", *[F.round(v, 6).alias(n) for n, v in f.temporal(devs).items()])


@query("h5_officer_slots", _slots("officer_id"))
def h5(spark, sf):
    devs = t.deviations(spark, sf)
    return devs.select("deviation_id", f.slot("officer_id", f.top_values(devs, "officer_id")).alias("slot"))


def _top(column: str) -> str:
    return f"top_{column} as (select {column}, row_number() over (order by count(*) desc, {column}) - 1 as slot from devs group by {column} order by count(*) desc, {column} limit 20)"


# The hot places of types and officers, and the four numbers after them, stand at known places of the assembled vector.
@query("h6_features", f"""with {DEVIATIONS}, {_vocabulary('devs', 'deviation_id', 'description')}, {_top('deviation_type')}, {_top('officer_id')}, n as (select (select count(*) from vocabulary) as terms, (select count(*) from top_deviation_type) as types, (select count(*) from top_officer_id) as officers)
select deviation_id, (terms + types + officers + 4)::int as width, coalesce(a.slot, -1)::int as type_slot, coalesce(b.slot, -1)::int as officer_slot, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end::double as severity_score,
  length(description)::double as description_length, round(hour(detected_at) / 24, 6) as hour_part, round((isodow(detected_at) - 1) / 7, 6) as weekday_part
from devs left join top_deviation_type a using (deviation_type) left join top_officer_id b using (officer_id) cross join n""")
def h6(spark, sf):
    devs = t.deviations(spark, sf)
    made = f.fit(devs)
    types, officers = len(made.types), len(made.officers)
    rows = made.transform(devs).select("deviation_id", vector_to_array("features").alias("v")).select("deviation_id", "v", F.size("v").alias("width"))
    first = F.col("width") - (types + officers + 4)

    def hot(start, n: int):
        return (F.array_position(F.slice("v", start + 1, F.lit(n)), 1.0) - 1).cast("int")

    numbers = ("severity_score", "description_length", "hour_part", "weekday_part")
    return rows.select("deviation_id", "width", hot(first, types).alias("type_slot"), hot(first + types, officers).alias("officer_slot"), *[F.round(F.get("v", F.col("width") - 4 + i), 6).alias(c) for i, c in enumerate(numbers)])


Z = """parts as (select vec_id, unnest(range(0, len(embedding))) as position, unnest(embedding)::double as x from embeddings), stats as (select position, avg(x) as mean, stddev_pop(x) as sd from parts group by position)"""


@query("h7_standardised", f"with {Z} select vec_id, position::int as position, round(case when sd > 0 then (x - mean) / sd else 0 end, 6) + 0.0 as z from parts join stats using (position)")
def h7(spark, sf):
    return f.standardised_components(vectors(spark, sf), "vec_id", "v").select("vec_id", "position", (F.round("z", 6) + 0.0).alias("z"))


# Parts by size and price, on scales on which some stand together and some alone.
@query("h8_density_clusters", """with recursive rows as (select p_partkey as id, p_size / 10.0::double as x, p_retailprice / 100.0::double as y from part),
points as materialized (select x, y, min(id) as id, count(*) as w from rows group by x, y),
pairs as materialized (select a.id as a, b.id as b, b.w from points a join points b on a.id <> b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.095::double * 0.095::double),
core as materialized (select p.id from points p left join (select a, sum(w) as around from pairs group by a) n on n.a = p.id where p.w + coalesce(around, 0) >= 5),
inside as materialized (select a, b from pairs where a in (select id from core) and b in (select id from core)),
reach as (select id as x, id as y from core union select r.x, i.b from reach r join inside i on r.y = i.a),
labels as (select x as id, min(y) as cluster from reach group by x),
border as (select a as id, min(cluster) as cluster from pairs join labels on labels.id = pairs.b where a not in (select id from core) group by a),
every as (select * from labels union all select * from border)
select r.id as p_partkey, coalesce(e.cluster, -1) as cluster from rows r join points p using (x, y) left join every e on e.id = p.id""")
def h8(spark, sf):
    rows = t.read(spark, sf, "part").select("p_partkey", F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 100.0).alias("v"))
    return c.density_clusters(rows, "p_partkey", "v", eps=0.095)


def _density(rows: str, square: str, eps: str) -> str:
    """SQL of density clusters of points (id, w) in `points`, named by their smallest dense id; square: squared distance of points a and b."""
    return f"""{rows},
pairs as materialized (select a.id as a, b.id as b, b.w from points a join points b on a.id <> b.id and {square} <= {eps}::double * {eps}::double),
core as materialized (select p.id from points p left join (select a, sum(w) as around from pairs group by a) n on n.a = p.id where p.w + coalesce(around, 0) >= 5),
inside as materialized (select a, b from pairs where a in (select id from core) and b in (select id from core)),
reach as (select id as x, id as y from core union select r.x, i.b from reach r join inside i on r.y = i.a),
labels as (select x as id, min(y) as cluster from reach group by x),
border as (select a as id, min(cluster) as cluster from pairs join labels on labels.id = pairs.b where a not in (select id from core) group by a),
every as (select * from labels union all select * from border)"""


EMBEDDED = _density("points as materialized (select min(vec_id) as id, embedding::double[] as v, count(*) as w from embeddings group by embedding)", "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))", "1.08")


@query("h8_pairs_of_embeddings", "select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id and list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double))) <= 1.08::double * 1.08::double")
def h8_pairs(spark, sf):
    return epsjoin.pairs(vectors(spark, sf).select(F.col("vec_id").alias("id"), "v"), 1.08)


@query("h8_density_of_embeddings", f"with recursive {EMBEDDED} select r.vec_id, coalesce(e.cluster, -1) as cluster from embeddings r join points p on p.v = r.embedding::double[] left join every e on e.id = p.id")
def h8_embeddings(spark, sf):
    return c.density_clusters(vectors(spark, sf), "vec_id", "v", eps=1.08)


@query("h9_clusters")
def h9(spark, sf):
    return c.clustered(vectors(spark, sf), "vec_id", "v")[0]


# Customers by segment and balance: dense within each segment, which is what the choice is for.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_HOT = [f"(c_mktsegment = '{x}')::int" for x in SEGMENTS]
_MOMENTS = ", ".join(f"avg({x}) as m{i}, stddev_pop({x}) as s{i}" for i, x in enumerate([*_HOT, "c_acctbal"]))
_SCALED = ", ".join(f"case when s{i} > 0 then ({x} - m{i}) / s{i} else 0 end as x{i}" for i, x in enumerate([*_HOT, "c_acctbal"]))
_SQUARE = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(6))
CUSTOMERS = _density(f"moments as (select {_MOMENTS} from customer), points as materialized (select c_custkey as id, 1 as w, {_SCALED} from customer cross join moments)", _SQUARE, "0.5")


@query("h9_density_of_customers", f"with recursive {CUSTOMERS}, numbers as (select cluster, row_number() over (order by cluster) - 1 as number from (select distinct cluster from every)) select p.id as c_custkey, coalesce(number, -1)::int as cluster, 'density' as method from points p left join every e using (id) left join numbers using (cluster)")
def h9_customers(spark, sf):
    hot = [(F.col("c_mktsegment") == x).cast("double") for x in SEGMENTS]
    rows = t.read(spark, sf, "customer").select("c_custkey", F.array(*hot, F.col("c_acctbal").cast("double")).alias("v"))
    found, method = c.clustered(rows, "c_custkey", "v")
    return found.withColumn("method", F.lit(method))


@query("h10_kmeans")
def h10(spark, sf):
    from pyspark.ml.functions import array_to_vector

    rows, cost = c.kmeans(vectors(spark, sf).select("vec_id", array_to_vector("v").alias("features")))
    return rows.select("vec_id", "cluster", F.lit(cost).alias("cost"))


def _most(column: str, name: str) -> str:
    return f"{name} as (select cluster, first({column} order by n desc, {column}) as {name} from (select cluster, {column}, count(*) as n from rows group by all) group by cluster)"


@query("h11_cluster_summary", f"""{W}, sizes as (select cluster, count(*) as size, {", ".join(f"count_if(severity = '{x}')::bigint as {x}" for x in vocab.SEVERITIES)} from rows group by cluster),
{_most('severity', 'top_severity')}, {_most('deviation_type', 'top_type')}, {_most('officer_id', 'top_officer')},
three as (select cluster, string_agg(deviation_type, ',' order by n desc, deviation_type) as top_types from (select *, row_number() over (partition by cluster order by n desc, deviation_type) as r from (select cluster, deviation_type, count(*) as n from rows group by cluster, deviation_type)) where r <= 3 group by cluster)
select cluster, size, critical, high, medium, low, round(100.0 * size / (select count(*) from rows), 2) as percentage, top_severity, top_type, top_officer, top_types
from sizes join top_severity using (cluster) join top_type using (cluster) join top_officer using (cluster) join three using (cluster)""")
def h11(spark, sf):
    return c.summary(labelled(spark, sf))


@query("h12_representatives", """with parts as (select vec_id, label, unnest(range(0, len(embedding))) as position, unnest(embedding)::double as x from embeddings), means as (select label, position, avg(x) as mean from parts group by all),
gaps as (select vec_id, label, round(sqrt(sum((x - mean) * (x - mean))), 6) as distance, sqrt(sum((x - mean) * (x - mean))) as d from parts join means using (label, position) group by all),
ranked as (select vec_id, label, distance, row_number() over (partition by label order by d, vec_id)::int as nearest, row_number() over (partition by label order by d desc, vec_id)::int as farthest from gaps)
select * from ranked where nearest <= 2 or farthest <= 3""")
def h12(spark, sf):
    rows = f.nearest_and_farthest(vectors(spark, sf), "vec_id", "v", "label")
    return rows.select("vec_id", "label", F.round("distance", 6).alias("distance"), "nearest", "farthest")


@query("h13_isolation_forest")
def h13(spark, sf):
    return o.scored(vectors(spark, sf), "vec_id", "v")


@query("h13_score_ranges")
def h13_score_ranges(spark, sf):
    return o.score_ranges(o.scored(vectors(spark, sf), "vec_id", "v"))


# Raw scores by arithmetic, many of them equal.
@query("h13_flagged", """with raw as (select o_orderkey, -((o_orderkey * 7919) % 100003) / 100003.0::double - (o_custkey % 5) as raw from orders), cut as (select quantile_cont(raw, 0.1) as t from raw)
select o_orderkey, round(raw - t, 9) + 0.0 as score, raw < t as is_anomaly from raw cross join cut""")
def h13_flagged(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = t.read(spark, sf, "orders").select("o_orderkey", (-((k * 7919) % 100003) / F.lit(100003.0) - (c % 5)).alias("raw"))
    return o.flagged(raw).select("o_orderkey", (F.round("score", 9) + 0.0).alias("score"), "is_anomaly")


@query("h14_top_anomalies", f"{W} select deviation_id, score from rows where is_anomaly order by score, deviation_id limit 10")
def h14(spark, sf):
    return o.top_anomalies(labelled(spark, sf)).select("deviation_id", "score")


@query("h15_anomaly_profile", f"""{W}, bad as (select * from rows where is_anomaly), worst as (select * from bad order by score, deviation_id limit 1)
select (select count(*) from bad) as count, round(100.0 * (select count(*) from bad) / (select count(*) from rows), 2) as percentage, {", ".join(f"(select count_if(severity = '{x}')::bigint from bad) as {x}" for x in vocab.SEVERITIES)},
  (select string_agg(x, ',' order by n desc, x) from (select deviation_type as x, count(*) as n from bad group by x order by n desc, x limit 5)) as top_types,
  (select string_agg(x, ',' order by n desc, x) from (select officer_id as x, count(*) as n from bad group by x order by n desc, x limit 5)) as top_officers,
  deviation_id as worst_id, score as worst_score, substr(description, 1, 100) as worst_description from worst""")
def h15(spark, sf):
    return o.profile(labelled(spark, sf))


@query("h16_sample_anomalies", f"{W} select deviation_id, 'anomaly' as reason from rows where is_anomaly")
def h16(spark, sf):
    return s.anomalies(labelled(spark, sf))


def _allocation(budget: str) -> str:
    return """sizes as (select cluster, count(*) as size from rows where not is_anomaly and cluster <> -1 group by cluster),
dealt as (select cluster, size, least(greatest(1, round_even(size / (select sum(size) from sizes) * BUDGET, 0)::int), size::int) as dealt from sizes),
cut as (select *, greatest((select sum(dealt) from dealt) - BUDGET, 0) as over, coalesce(sum(dealt - 1) over (order by dealt desc, cluster rows between unbounded preceding and 1 preceding), 0) as before from dealt),
allocated as (select cluster, size, (dealt - greatest(0, least(dealt - 1, over - before)))::int as allocated from cut)""".replace("BUDGET", budget)


ALLOCATION = _allocation("75")


@query("h17_allocation", f"{W}, {ALLOCATION} select * from allocated")
def h17(spark, sf):
    return s.allocation(labelled(spark, sf), 75)


REPRESENTATIVES = """ranked as (select deviation_id, cluster, row_number() over (partition by cluster order by distance, deviation_id) as near, row_number() over (partition by cluster order by distance desc, deviation_id) as far
  from rows where not is_anomaly and cluster <> -1),
representatives as (select deviation_id, 'representative' as reason from ranked join allocated using (cluster) where near <= greatest(1, allocated // 2) or far <= allocated - greatest(1, allocated // 2))"""


@query("h18_representatives", f"{W}, {ALLOCATION}, {REPRESENTATIVES} select * from representatives")
def h18(spark, sf):
    rows = labelled(spark, sf)
    return s.representatives(rows, s.allocation(rows, 75))


PERIOD = "case when hour(detected_at) < 6 then 'night' when hour(detected_at) < 12 then 'morning' when hour(detected_at) < 18 then 'afternoon' else 'evening' end"


def _uncovered(value: str, reason: str, most: str = "") -> str:
    return f"""{W}, sample as (select deviation_id from rows where is_anomaly and severity = 'low'), valued as (select deviation_id, {value} as value from rows),
have as (select distinct value from valued where deviation_id in (select deviation_id from sample)), firsts as (select value, min(deviation_id) as deviation_id from valued where value not in (select value from have) group by value {most})
select deviation_id, '{reason}' as reason from firsts"""


def _small(spark, sf):
    rows = labelled(spark, sf)
    return rows, rows.where("is_anomaly and severity = 'low'").select("deviation_id")


@query("h19_severity_coverage", _uncovered("severity", "severity"))
def h19(spark, sf):
    return s.uncovered(*_small(spark, sf), F.col("severity"), "severity")


@query("h20_period_coverage", _uncovered(PERIOD, "period").replace("is_anomaly and severity = 'low'", "is_anomaly and severity = 'low' and hour(detected_at) < 6"))
def h20(spark, sf):
    from caselens.functions import times

    rows, sample = _small(spark, sf)
    sample = rows.where("is_anomaly and severity = 'low' and hour(detected_at) < 6").select("deviation_id")
    return s.uncovered(rows, sample, times.period(F.col("detected_at")), "period")


@query("h21_officer_coverage", _uncovered("officer_id", "officer", "order by value limit 5"))
def h21(spark, sf):
    return s.uncovered(*_small(spark, sf), F.col("officer_id"), "officer", 5)


def _next(name: str, value: str, before: str, most: str = "") -> str:
    """SQL of the first rows of values that what is chosen before doesn't cover, and of what is chosen then."""
    firsts = f"select '{name}' as reason, min(deviation_id) as deviation_id from (select deviation_id, {value} as value from rows) where value is not null and value not in (select {value} from rows where deviation_id in (select deviation_id from {before}) and {value} is not null) group by value {most}"
    return f"{name}_firsts as ({firsts}), with_{name} as (select deviation_id, reason from {before} union all select deviation_id, reason from {name}_firsts)"


# Representatives fill what the anomalies leave of the target; they may leave nothing.
SAMPLED = f"""{_allocation("(2000 - (select count(*) from rows where is_anomaly))")}, {REPRESENTATIVES},
chosen as (select deviation_id, 'anomaly' as reason from rows where is_anomaly union all select deviation_id, reason from representatives where (select count(*) from rows where is_anomaly) < 2000),
{_next('severity', 'severity', 'chosen')}, {_next('period', PERIOD, 'with_severity')}, {_next('officer', 'officer_id', 'with_period', 'order by value limit 5')}"""
REASONS = ("anomaly", "representative", "severity", "period", "officer")


@query("h22_sampling_report", f"""{W}, {SAMPLED}, met as (select rows.* from rows join with_officer using (deviation_id))
select (select count(*) from rows) as total, (select count(*) from with_officer) as selected, {", ".join(f"(select count(*) from with_officer where reason = '{x}') as {x}" for x in REASONS)},
  (select count(distinct severity) from met) as severities, (select count(distinct cluster) from met where cluster <> -1) as clusters, (select count(distinct officer_id) from met) as officers,
  round((select count(*) from rows) / (select count(*) from with_officer), 2) as compression""")
def h22(spark, sf):
    rows = labelled(spark, sf)
    return s.report(rows, s.sampled(rows, target=2000))


@query("h23_labelled_sample", f"{W} select deviation_id, case when cluster = -1 then 'noise' else 'cluster_' || cluster::varchar end as cluster, is_anomaly, score from rows where is_anomaly")
def h23(spark, sf):
    rows = labelled(spark, sf)
    return s.labelled(rows, s.anomalies(rows)).select("deviation_id", "ml_labels.*")


@query("h24_pipeline")
def h24(spark, sf):
    from caselens.plans.analysis import ml_sample

    return ml_sample(t.deviations(spark, sf))
