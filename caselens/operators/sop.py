"""Procedure texts to rule tables: sentences, kinds of rules, numbers in them, validation, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import vocab
from caselens.operators.clean import stripped


def _cut(text_col: str) -> Column:
    return F.transform(F.split(text_col, r"[.!?]+"), stripped)


def sentences(docs: DataFrame, id_col: str = "sop_id", text_col: str = "text") -> DataFrame:
    """(id, position, sentence): texts cut at runs of . ! ? with outer white space off; empty ones are left out."""
    return docs.select(F.col(id_col), F.posexplode(_cut(text_col)).alias("position", "sentence")).where("sentence != ''")


def kind(sentence: Column) -> Column:
    """struct(rule_type, severity) of the first kind with a pattern that the lower-case sentence matches anywhere; null of none."""
    found = F.lit(None).cast("struct<rule_type:string,severity:string>")
    for name, level, patterns in reversed(vocab.RULE_PATTERNS):
        found = F.when(_matches(sentence, patterns), F.struct(F.lit(name).alias("rule_type"), F.lit(level).alias("severity"))).otherwise(found)
    return found


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern matches. Those that are words, or alternatives of words, are looked up as they are; only the rest are regular expressions."""
    hit, rest = F.lit(False), []
    for p in patterns:
        words = p.removeprefix("(").removesuffix(")").split("|")
        if all(w.isalpha() for w in words):
            for w in words:
                hit = hit | F.contains(text, F.lit(w))
        else:
            rest.append(p)
    return hit | text.rlike("|".join(rest)) if rest else hit


def kind_of(sentence: Column) -> tuple[Column, Column]:
    """(rule_type, severity) of the first kind that the sentence matches; null of none."""
    found = kind(F.lower(sentence))
    return found["rule_type"], found["severity"]


def step_number(sentence: Column) -> Column:
    return F.regexp_extract(F.lower(sentence), r"step\s+(\d+)", 1).try_cast("int")


def timing_constraint(sentence: Column) -> Column:
    """struct(duration, unit) of the first span of time that the sentence names, null of none."""
    pattern = r"(\d+)\s+(days?|hours?|weeks?|months?)"
    duration = F.regexp_extract(F.lower(sentence), pattern, 1).try_cast("int")
    return F.when(duration.isNotNull(), F.struct(duration.alias("duration"), F.regexp_extract(F.lower(sentence), pattern, 2).alias("unit")))


def extracted_rules(docs: DataFrame, id_col: str = "sop_id", text_col: str = "text") -> DataFrame:
    """(id, position, rule_type, rule_description, step_number, severity, condition_logic) of every sentence that is a rule.

    Sentences are cut, lower-cased and matched within the array of each text, each once, and only rules leave it.
    """
    lowered = F.transform(_cut(text_col), lambda s, i: F.struct(i.alias("position"), s.alias("sentence"), F.lower(s).alias("low")))
    matched = F.transform(lowered, lambda x: F.struct(x["position"].alias("position"), x["sentence"].alias("sentence"), kind(x["low"]).alias("kind")))
    found = docs.select(id_col, F.explode(F.filter(matched, lambda x: x["kind"].isNotNull())).alias("r")).select(id_col, "r.position", "r.sentence", "r.kind.rule_type", "r.kind.severity")
    s = F.col("sentence")
    return found.select(id_col, "position", "rule_type", s.alias("rule_description"), step_number(s).alias("step_number"), "severity", F.when(F.col("rule_type") == "timing", timing_constraint(s)).alias("condition_logic"))


def rule_sets(rules: DataFrame, id_col: str = "sop_id", types: tuple[str, ...] = vocab.RULE_TYPES) -> DataFrame:
    """(id, n_rules, is_valid): a set is valid if every rule of it has a description that isn't blank, a known type and a known severity."""
    ok = F.coalesce((stripped(F.col("rule_description")) != "") & F.col("rule_type").isin(*types) & F.col("severity").isin(*vocab.SEVERITIES), F.lit(False))
    return rules.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_rules"), F.bool_and(ok).alias("is_valid"))


def rule_faults(rules: DataFrame, id_col: str = "sop_id", rule_col: str = "rule_id", types: tuple[str, ...] = vocab.RULE_TYPES) -> DataFrame:
    """(id, rule, fault) of what makes a rule set invalid: an absent or blank field, by its name, or an unknown type or severity."""
    def absent(c: str) -> Column:
        return F.col(c).isNull() | (stripped(F.col(c)) == "")

    faults = [F.when(absent(c), F.lit(f"no {c}")) for c in ("rule_type", "rule_description", "severity")]
    faults += [F.when(~absent(c) & ~F.col(c).isin(*known), F.concat(F.lit(f"unknown {c}: "), c)) for c, known in (("rule_type", types), ("severity", vocab.SEVERITIES))]
    return rules.select(id_col, rule_col, F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def confidences(rules: DataFrame, id_col: str = "sop_id") -> DataFrame:
    """(id, n_rules, confidence): mean over rules of how complete each is, two places.

    0.5 for being there, 0.15 each for a step number and for required fields, 0.1 each for the constraint of a timing rule and
    for a condition.
    """
    def has(name: str, test: Column, worth: float) -> Column:
        return F.when(test, worth).otherwise(0.0) if name in rules.columns else F.lit(0.0)

    parts = [
        has("step_number", F.col("step_number") != 0, 0.15), has("required_fields", F.size("required_fields") > 0, 0.15),
        has("timing_constraint", (F.col("rule_type") == "timing") & F.col("timing_constraint").isNotNull(), 0.10), has("condition_logic", F.col("condition_logic").isNotNull(), 0.10),
    ]
    score = F.least(sum(parts, F.lit(0.5)), F.lit(1.0))
    return rules.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_rules"), F.round(F.avg(score), 2).alias("confidence"))


def compared(rules: DataFrame, id_col: str = "sop_id") -> DataFrame:
    """(id, pattern, model, pattern_confidence, model_confidence, more_rules): the rules that two methods found, side by side.

    rules have a column method; a method without rules counts 0 and has no confidence. more_rules names the method that found more.
    """
    sides = []
    for m in ("pattern", "model"):
        found = confidences(rules.where(F.col("method") == m), id_col)
        sides.append(found.select(id_col, F.col("n_rules").alias(m), F.col("confidence").alias(f"{m}_confidence")))
    both = sides[0].join(sides[1], id_col, "full").na.fill(0, ["pattern", "model"])
    more = F.when(F.col("pattern") > F.col("model"), "pattern").when(F.col("model") > F.col("pattern"), "model").otherwise("equal")
    return both.select(id_col, "pattern", "model", "pattern_confidence", "model_confidence", more.alias("more_rules"))


def json_in(text: Column) -> Column:
    """The JSON in a text: a fenced block, else from the first brace or bracket to the last; commas before a closing one go."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.nullif(F.regexp_replace(F.when(fenced != "", fenced).otherwise(bare), r",(\s*[}\]])", "$1"), F.lit(""))


def stored(rules: DataFrame) -> DataFrame:
    """Rules as they are stored: whole step numbers, 0 for none; medium severity where there is none."""
    return rules.withColumns({"step_number": F.nullif(F.floor("step_number").cast("int"), F.lit(0)), "severity": F.coalesce("severity", F.lit("medium"))})


def run_metadata(sops: DataFrame, rules: DataFrame, id_col: str = "sop_id") -> DataFrame:
    """Procedures with the number of their rules and their status after the run: completed with rules, failed without."""
    n = rules.groupBy(id_col).agg(F.count(F.lit(1)).alias("rules_count"))
    rows = sops.join(n, id_col, "left").withColumn("rules_count", F.coalesce("rules_count", F.lit(0).cast("long")))
    return rows.withColumns({"processed": F.col("rules_count") > 0, "status": F.when(F.col("rules_count") > 0, "completed").otherwise("failed")})


def rules_of(rules: DataFrame, sop_id, id_col: str = "sop_id") -> DataFrame:
    """One procedure's rules by step, those without a step first."""
    return rules.where(F.col(id_col) == sop_id).orderBy(F.asc_nulls_first("step_number"), "position")


def with_rules(sops: DataFrame, rules: DataFrame, id_col: str = "sop_id") -> DataFrame:
    """Every procedure with its rules nested, as (position, rule_type, severity)."""
    nested = rules.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("position", "rule_type", "severity"))).alias("rules"))
    return sops.join(nested, id_col, "left")
