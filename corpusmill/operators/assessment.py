"""Layers B and C and what is read from them: criterion notes, consistency alerts with evidence, findings, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.numbers import rounded
from corpusmill.rules import DEFAULT, Rules


def answers(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """questions (query_id, criterion, graded, note) with documented: a graded question is documented by its note, another
    by having candidates."""
    found = candidates.select(F.col("query_id").alias("_q")).distinct()
    both = questions.join(found, F.col("query_id") == F.col("_q"), "left")
    return both.withColumn("documented", F.when(F.col("graded"), F.col("note").isNotNull()).otherwise(F.col("_q").isNotNull())).drop("_q")


def final_notes(answers_: DataFrame, criteria: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Per criterion of criteria why it concludes or not, its note (1 digit) and whether its answers disagree: one is contradictory,
    or their spread is large."""
    a = answers_.groupBy("criterion").agg(
        F.count("*").alias("total"), F.count_if("documented").alias("documented"), F.bool_or("graded").alias("graded"), rounded(F.avg("note"), 1).alias("mean"),
        (F.coalesce(F.bool_or("contradictory"), F.lit(False)) | ((F.count("note") >= 2) & (F.stddev_pop("note") > rules.ambiguity))).alias("apart"),
    )
    a = criteria.join(a, "criterion", "left").fillna(0, ["total", "documented"]).fillna(False, ["graded", "apart"])
    few = F.col("documented") < rules.documented_ratio * F.col("total")
    reason = F.when(F.col("total") == 0, "no_questions").when(few, "insufficient").when(~F.col("graded"), "ai_unavailable").otherwise("concluded")
    done = reason == "concluded"
    return a.select("criterion", "total", "documented", reason.alias("reason"), F.when(done, F.col("mean")).alias("note"), (done & F.col("apart")).alias("ambiguous"))


def latest_scored_rows(scores: DataFrame) -> DataFrame:
    """The last row with a score of each pillar."""
    last = F.row_number().over(W.partitionBy("pillar").orderBy(F.desc("order_index")))
    return scores.where("score is not null").withColumn("_n", last).where("_n = 1").drop("_n")


def rule_of(score: Column, note: Column, code: Column, rules: Rules = DEFAULT) -> Column:
    """The rule of the criterion itself first, then the general ones; NULL where score and note agree."""
    low = note <= rules.low_note
    out = F.when(F.lit(False), "")
    for own, (name, least) in rules.criterion_rules.items():
        out = out.when((code == own) & (score >= least) & low, name)
    return out.when((score >= rules.high_score) & low, "ALERT-01").when((score <= rules.low_score) & (note >= rules.high_note), "ALERT-02")


def alerts(scores: DataFrame, notes: DataFrame, links: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """rule, severity, pillar, order_index, criterion, score, note, confidence: latest scores against the notes of linked
    criteria, and every strengthened version of poor confidence. Poor confidence makes an alert minor."""
    columns = ["rule", "pillar", "order_index", "criterion", "score", "note", "confidence"]
    concluded = notes.where("note is not null").select("criterion", "note")
    gaps = latest_scored_rows(scores).join(links, "pillar").join(concluded, "criterion")
    gaps = gaps.withColumn("rule", rule_of(F.col("score"), F.col("note"), F.col("criterion"), rules)).where("rule is not null").select(*columns)
    weak = scores.where((F.col("delta") >= rules.evolution_step) & (F.col("confidence") < rules.poor_confidence))
    weak = weak.withColumns({"rule": F.lit("ALERT-06"), "criterion": F.lit(None).cast("bigint"), "note": F.lit(None).cast("double")}).select(*columns)
    major = F.col("rule").isin("ALERT-01", "ALERT-02") & (F.col("confidence") >= rules.poor_confidence)
    return gaps.unionByName(weak).withColumn("severity", F.when(major, "majeure").otherwise("mineure"))


def with_evidence(alerts_: DataFrame, by_pillar: DataFrame, by_criterion: DataFrame) -> DataFrame:
    """The alerts that some segment of their criterion or of their pillar's version supports."""
    of_criterion = by_criterion.select("criterion").distinct().withColumn("_c", F.lit(True))
    of_pillar = by_pillar.select("pillar", "order_index").distinct().withColumn("_p", F.lit(True))
    both = alerts_.join(of_criterion, "criterion", "left").join(of_pillar, ["pillar", "order_index"], "left")
    return both.where("_c or _p").select(*alerts_.columns)


def pillar_evidence(selected: DataFrame) -> DataFrame:
    """Best similarity of each segment selected as evidence of a pillar's variables."""
    return selected.groupBy("pillar", "order_index", "segment_id").agg(F.max("similarity").alias("similarity"))


def criterion_evidence(candidates: DataFrame, answers_: DataFrame) -> DataFrame:
    return candidates.join(answers_.where("documented"), "query_id").groupBy("criterion", "segment_id").agg(F.max("similarity").alias("similarity"))


def evidence_of(alerts_: DataFrame, by_pillar: DataFrame, by_criterion: DataFrame, most: int = 4) -> DataFrame:
    """Up to most segments of each alert: those of its criterion first, then those of its pillar that are not among them."""
    key = ["rule", "pillar", "order_index", "criterion"]
    a = alerts_.select(*key)
    own = a.join(by_criterion, "criterion").select(*key, "segment_id", "similarity", F.lit(0).alias("side"))
    rest = a.join(by_pillar, ["pillar", "order_index"]).select(*key, "segment_id", "similarity", F.lit(1).alias("side"))
    once = F.row_number().over(W.partitionBy(*key, "segment_id").orderBy("side"))
    place = F.row_number().over(W.partitionBy(*key).orderBy("side", F.desc("similarity"), "segment_id"))
    both = own.unionByName(rest).withColumn("_n", once).where("_n = 1").drop("_n")
    return both.withColumn("place", place).where(F.col("place") <= most)


def progresses(scores: DataFrame, by_pillar: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """key P1.., pillar, delta: the latest scored versions that gained most, with evidence."""
    s = latest_scored_rows(scores).where(F.col("delta") >= rules.evolution_step).join(by_pillar.select("pillar", "order_index").distinct(), ["pillar", "order_index"], "left_semi")
    return _keyed(s.select("pillar", F.round("delta", 6).alias("delta")), "P", [F.desc("delta"), F.col("pillar")], rules)


def weaknesses(scores: DataFrame, notes: DataFrame, alerts_: DataFrame, by_pillar: DataFrame, by_criterion: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """key W1.., origin, id, level (0 to 1): weak pillars and criteria with evidence, those with a major alert first."""
    major = alerts_.where("severity = 'majeure'")
    p = latest_scored_rows(scores).where(F.col("score") < rules.weak_score).join(by_pillar.select("pillar", "order_index").distinct(), ["pillar", "order_index"], "left_semi")
    p = p.join(major.select("pillar").distinct().withColumn("_m", F.lit(0)), "pillar", "left").select(F.lit("pillar").alias("origin"), F.col("pillar").cast("bigint").alias("id"), F.round(F.col("score") / 100, 6).alias("level"), "_m")
    c = notes.where(F.col("note") < rules.weak_note).join(by_criterion.select("criterion").distinct(), "criterion", "left_semi")
    c = c.join(major.where("criterion is not null").select("criterion").distinct().withColumn("_m", F.lit(0)), "criterion", "left").select(F.lit("criterion").alias("origin"), F.col("criterion").cast("bigint").alias("id"), F.round(F.col("note") / 3, 6).alias("level"), "_m")
    return _keyed(p.unionByName(c), "W", [F.coalesce("_m", F.lit(1)), F.col("level"), F.col("id"), F.col("origin")], rules).drop("_m")


def _keyed(rows: DataFrame, letter: str, order: list[Column], rules: Rules) -> DataFrame:
    """The first few rows, a top-k before they are numbered, so that the window sees only these."""
    first = rows.orderBy(*order).limit(rules.items_per_section)
    return first.withColumn("key", F.concat(F.lit(letter), F.row_number().over(W.orderBy(*order)).cast("string")))


def limits(scores: DataFrame, notes: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row: criteria without conclusion, all criteria, mean confidence of latest versions (2 digits), whether limits lead the text."""
    last = scores.groupBy("pillar").agg(F.max_by("confidence", "order_index").alias("c")).agg(rounded(F.coalesce(F.avg("c"), F.lit(0.0)), 2).alias("confidence"))
    n = notes.agg(F.count_if(F.col("reason") != "concluded").alias("not_concluded"), F.count("*").alias("criteria"))
    return n.join(last, how="cross").withColumn("leads", (F.col("not_concluded") >= rules.limits_from) | (F.col("confidence") < rules.poor_confidence))


def placed(alerts_: DataFrame) -> DataFrame:
    """alerts with their place in the report: major ones first, then by rule. There are few: at most one for each pair of a
    pillar and a criterion linked to it, so that one ordered window holds them."""
    order = [(F.col("severity") != "majeure"), F.col("rule"), F.col("pillar"), F.col("order_index"), F.col("criterion").asc_nulls_last()]
    return alerts_.withColumn("place", F.row_number().over(W.orderBy(*order)))


def verifications(alerts_: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """key V1.., rule, severity, pillar, order_index, criterion: the first alerts with evidence in the report's order."""
    order = [(F.col("severity") != "majeure"), F.col("rule"), F.col("pillar"), F.col("order_index"), F.col("criterion").asc_nulls_last()]
    return _keyed(alerts_.select("rule", "severity", "pillar", "order_index", "criterion"), "V", order, rules)


def partials(notes: DataFrame, by_criterion: DataFrame, weak: DataFrame, verify: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """key N1.., criterion, documented, total: criteria without a note but with evidence, the best documented first, as many as
    weaknesses and verifications leave of the actions."""
    taken = weak.select("key").union(verify.select("key")).agg(F.count("*").alias("_taken"))
    some = notes.where("reason <> 'concluded'").join(by_criterion.select("criterion").distinct(), "criterion", "left_semi")
    order = [F.desc("documented"), F.col("criterion")]
    first = some.orderBy(*order).limit(rules.actions).withColumn("_n", F.row_number().over(W.orderBy(*order)))
    kept = first.join(taken, how="cross").where(F.col("_n") <= rules.actions - F.col("_taken"))
    return kept.select(F.concat(F.lit("N"), F.col("_n").cast("string")).alias("key"), "criterion", "documented", "total")


def origins(weak: DataFrame, verify: DataFrame, partial: DataFrame) -> DataFrame:
    """key, origin, id: what actions may start from."""
    w = weak.select("key", "origin", "id")
    v = verify.select("key", F.lit("alert").alias("origin"), F.col("pillar").cast("bigint").alias("id"))
    return w.union(v).union(partial.select("key", F.lit("criterion").alias("origin"), F.col("criterion").cast("bigint").alias("id")))


def complete_actions(projections: DataFrame, known: DataFrame, personas: list[str], rules: Rules = DEFAULT) -> DataFrame:
    """action, origin, reason_chars of actions whose origin is known and for which every persona has a text and a reason of enough
    characters: projections (action, origin, pos, persona, text, reason); of several for a persona the first counts."""
    p = projections.where(F.col("persona").isin(personas)).join(known.select("origin").distinct(), "origin", "left_semi")
    first = p.groupBy("action", "origin", "persona").agg(F.min_by(F.struct("text", "reason"), "pos").alias("x"))
    size = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0))
    good = first.where((size("x.text") > 0) & (size("x.reason") >= rules.reason_chars))
    return good.groupBy("action", "origin").agg(F.count("*").alias("_n"), F.sum(size("x.reason")).alias("reason_chars")).where(F.col("_n") == len(personas)).drop("_n")
