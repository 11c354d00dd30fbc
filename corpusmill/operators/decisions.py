"""Rules: relevance score and decision cascade, complexity class, criterion notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import contains_phrase, count_phrase, mentions


def relevance(semantic: Column, country: Column, financier: Column, theme: Column, language: Column, off_topic: Column) -> Column:
    """Clamped semantic score with bonuses and maluses (country 1 match, -1 other, 0 none; others are flags)."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    add = F.when(country > 0, 10).when(country < 0, -30).otherwise(0)
    flags = sum((F.when(f, n).otherwise(0) for f, n in ((financier, 5), (theme, 5), (language, 5), (off_topic, -20))), F.lit(0))
    return clamp(clamp(semantic) + add + flags)


def decision(score: Column, country: Column, partial: Column) -> Column:
    """The first rule that fits: reject below 40, verify other or unknown countries and scores below 70, else conform."""
    return (
        F.when(score < 40, F.when(country < 0, "rejected_country").otherwise("rejected_score")).when(country < 0, "verify_country")
        .when(country == 0, "verify_no_country").when(score < 70, "verify_score").when(partial, "conform_partial").otherwise("conform")
    )


def complexity(points: Column) -> Column:
    return F.when(points <= 3, "simple").when(points <= 6, "complique").otherwise("complexe")


def criterion_notes(answers: DataFrame) -> DataFrame:
    """Per criterion the mean note if at least half of the questions are documented, and whether it is ambiguous."""
    a = answers.groupBy("criterion").agg(F.count("*").alias("total"), F.count("note").alias("documented"), F.avg("note").alias("mean"), F.stddev_pop("note").alias("spread"))
    enough = F.col("documented") >= 0.5 * F.col("total")
    return a.select("criterion", "total", "documented", F.when(enough, F.col("mean")).alias("note"), ((F.col("documented") >= 2) & (F.col("spread") > 1.0)).alias("ambiguous"))


def normalised(weights: DataFrame, group: str, key: str, weight: str) -> DataFrame:
    """group, key, cents: whole weights as hundredths of a percent of their group, halves up; the first of the largest takes what
    is missing to 10000."""
    w, total = F.col(weight), F.sum(weight).over(W.partitionBy(group))
    c = weights.withColumn("_t", total).withColumn("cents", F.expr(f"(2 * {weight} * 10000 + _t) div (2 * _t)"))
    first = F.row_number().over(W.partitionBy(group).orderBy(F.desc("cents"), key)) == 1
    rest = F.lit(10000) - F.sum("cents").over(W.partitionBy(group))
    return c.where(w.isNotNull()).select(group, key, (F.col("cents") + F.when(first, rest).otherwise(0)).alias("cents"))


def signals(text: Column, norm: Column, head: Column, financiers: tuple[str, ...], themes: dict[str, tuple[str, ...]], off_topic: tuple[str, ...], least: int = 3) -> dict[str, Column]:
    """Sorted terms found in a text (norm and head: its normal form, and that of its beginning): financiers, themes by their
    terms, and words off the topic that are in the head or at least `least` times in the text."""
    def kept(found: list[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(c, name) for name, c in sorted(found, key=lambda x: x[0])]))

    any_of = lambda terms: F.exists(F.array(*[contains_phrase(norm, t) for t in terms]), lambda x: x)
    return {
        "financiers": kept([(t, mentions(text, norm, t)) for t in financiers]),
        "themes": kept([(name, any_of(terms)) for name, terms in themes.items()]),
        "off_topic": kept([(t, contains_phrase(head, t) | (count_phrase(norm, t) >= least)) for t in off_topic]),
    }
