"""Frameworks of pillars: which business rules they break, and the reference pillars that a template takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What an applicability of a reference pillar counts.
APPLIES = {"obligatoire": 4, "prospectif": 3, "optionnel": 2}


def faults(frameworks: DataFrame, pillars: DataFrame, criteria: list[str], references: list[str], achieved: list[str], expected: list[str], least: int = 20) -> DataFrame:
    """framework, faults of (framework, rationale, before the event) and (framework, pillar, reference, criterion, variable).

    size: not five to eight pillars; criteria, references: some that are not allowed; rationale: a new pillar without
    one of least characters; before the event, achieved: variables of results that are there, expected: none of those to come.
    """
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = pillars.groupBy("framework").agg(
        F.countDistinct("pillar").alias("n"), some(~F.col("criterion").isin(criteria)).alias("_c"), some(~F.col("reference").isin([*references, "new"])).alias("_r"),
        some(F.col("reference") == "new").alias("_new"), some(F.col("variable").isin(achieved)).alias("_a"), some(F.col("variable").isin(expected)).alias("_e"),
    )
    f = frameworks.join(per, "framework", "left").fillna(0, ["n"]).fillna(False, ["_c", "_r", "_new", "_a", "_e"])
    short = F.coalesce(F.length(F.trim("rationale")), F.lit(0)) < least
    named = {"size": ~F.col("n").between(5, 8), "criteria": F.col("_c"), "references": F.col("_r"), "rationale": F.col("_new") & short, "achieved": F.col("before") & F.col("_a"), "expected": F.col("before") & ~F.col("_e")}
    return f.select("framework", F.concat_ws(",", *[F.when(c, name) for name, c in named.items()]).alias("faults"))


def template(candidates: DataFrame, most: int = 8) -> DataFrame:
    """framework, pillar, place: the reference pillars (applies, tokens, weight) that fit a framework (wanted tokens) best."""
    fits = F.coalesce(*[F.when(F.col("applies") == x, n) for x, n in APPLIES.items()], F.lit(1))
    score = fits + 2 * F.size(F.array_intersect("tokens", "wanted")) + (F.col("weight") / 100).cast("decimal(10,2)")
    place = F.row_number().over(W.partitionBy("framework").orderBy(F.desc("score"), "pillar"))
    return candidates.withColumn("score", score).withColumn("place", place).where(F.col("place") <= most).select("framework", "pillar", "place")


def kept_translations(candidates: DataFrame, locales: list[str]) -> DataFrame:
    """pillar, locale, name: the first translation (pillar, locale, pos, name) of each expected locale that has a name; of equal pos the smallest
    name. pos is any value with an order, so that it can hold what parts equal numbers."""
    valid = candidates.where(F.col("locale").isin(locales) & (F.trim("name") != ""))
    return valid.groupBy("pillar", "locale").agg(F.min_by("name", F.struct("pos", "name")).alias("name"))


def reused_translations(pillars: DataFrame, kept: DataFrame, references: DataFrame, official: DataFrame) -> DataFrame:
    """pillar, locale, name, official: kept translations (pillar, locale, name), and the official ones (reference, locale, name) in
    their place for pillars (pillar, reference, name, description) that have the reference's name and description unchanged."""
    same = pillars.join(references, ["reference", "name", "description"], "left_semi").select("pillar", "reference")
    taken = same.join(official, "reference").select("pillar", "locale", F.col("name").alias("_official"))
    both = kept.join(taken, ["pillar", "locale"], "full")
    return both.select("pillar", "locale", F.coalesce("_official", "name").alias("name"), F.col("_official").isNotNull().alias("official"))
