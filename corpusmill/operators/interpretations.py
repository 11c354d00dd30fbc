"""Interpretations that stored answers give: JSON texts as variants, from which items, their texts and translations are taken
by path, with nothing for what is missing or of another kind. Texts cite excerpts; marks become numbered sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import plain, shortened, squeezed
from corpusmill.operators import passages


@dataclass(frozen=True)
class Length:
    """Characters of an interpretation: shown, stored with its marks, and the least; own: it may cite its own excerpt alone, and needs no mark."""

    shown: int
    stored: int
    least: int
    own: bool = False


#: What an interpretation of each kind may have.
LENGTHS = {"segments": Length(850, 1500, 150, own=True), "variables": Length(850, 1500, 150), "pillars": Length(1200, 2000, 250)}


def answers(stored: DataFrame, kinds=tuple(LENGTHS)) -> DataFrame:
    """(batch, kind, item, version, locale, text) of stored answers (batch, answer, locales): version 0 is the answer itself, then its translations in
    the order of the wanted locales. Items are compared in capitals without white space around them; of equal ones the last in the answer's
    order of keys counts. What isn't JSON, or isn't an object of texts, gives nothing; neither do blank texts."""
    v = stored.withColumn("_v", F.try_parse_json("answer"))
    wanted = F.concat(F.array(F.struct(F.lit(0).alias("version"), F.lit(None).cast("string").alias("locale"), F.col("_v").alias("v"))), F.transform(
        F.coalesce("locales", F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).alias("version"), x.alias("locale"), F.expr("try_variant_get(_v, '$.translations', 'map<string, variant>')")[x].alias("v"))))
    rows = v.select("batch", F.explode(wanted).alias("w")).select("batch", "w.version", "w.locale", "w.v").where("v is not null")
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(f"try_variant_get(v, '$.{k}', 'map<string, string>')").alias("texts")) for k in kinds])
    rows = rows.select("batch", "version", "locale", F.explode(parts).alias("p")).select("batch", "version", "locale", "p.kind", F.explode("p.texts").alias("raw", "text"))
    item = F.upper(F.trim("raw")).alias("item")
    last = rows.groupBy("batch", "kind", item, "version", "locale").agg(F.max_by("text", "raw").alias("text"))
    return last.where(F.col("text").rlike("\\S"))


def _of_kind(name: str, default: object = None) -> Column:
    out = F.lit(default)
    for kind, length in LENGTHS.items():
        out = F.when(F.col("kind") == kind, F.lit(getattr(length, name))).otherwise(out)
    return out


def _cut(c: str) -> Column:
    out = F.col(c)
    for kind, length in LENGTHS.items():
        out = F.when(F.col("kind") == kind, passages.cut(squeezed(c), length.shown)).otherwise(out)
    return out


def _fitted(c: Column) -> Column:
    """A text too long to be stored with its marks is shortened without them."""
    out = c
    for kind, length in LENGTHS.items():
        out = F.when((F.col("kind") == kind) & (F.length(c) > length.stored), shortened(plain(c), length.stored)).otherwise(out)
    return out


def interpreted(texts: DataFrame, subjects: DataFrame, excerpts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The interpretations (batch, kind, item, version, locale, text) that are published, and their sources (batch, kind, item, number, excerpt, spans).

    texts are as answers gives them; subjects (batch, kind, item, allowed) tell which excerpts (batch, excerpt, spans of its sentences) an item may
    cite. An interpretation needs enough characters without its marks, and a source; a segment's cites its own excerpt alone, and
    without a mark the whole of it. Translations have the same sources, numbered by first citation over all versions; of
    variables and pillars short ones go. Items that aren't subjects give nothing.
    """
    by = ["batch", "kind", "item"]
    own = texts.join(subjects.select(*by), by).withColumn("id", F.to_json(F.struct(*by)))
    offered = subjects.select(F.to_json(F.struct(*by)).alias("id"), "batch", F.explode("allowed").alias("excerpt")).distinct().join(excerpts, ["batch", "excerpt"]).select("id", "excerpt", "spans")
    marked, sources = passages.cited(own.select("id", *by, "version", "locale", "text"), offered, "id")
    marked = marked.withColumn("text", _cut("text")).withColumn("_long", F.length(F.trim(plain("text"))) >= _of_kind("least"))
    good = marked.where("version = 0 and _long").select("id")
    kept = marked.join(good, "id", "left_semi").where((F.col("version") == 0) | F.col("_long") | _of_kind("own", False)).drop("_long")
    new, known = passages.compacted(kept, sources, "id")
    # A segment that cites nothing leads to the whole of its excerpt; other texts without a source aren't published.
    cites = known.select("id").distinct().withColumn("_cites", F.lit(True))
    new = new.join(cites, "id", "left").where(F.col("_cites").isNotNull() | _of_kind("own", False))
    whole = new.where("_cites is null").select("id").distinct().join(offered, "id").select("id", F.lit(1).alias("number"), "excerpt", passages._joined_spans(F.col("spans")).alias("spans"))
    with_mark = F.concat(F.regexp_replace("text", "\\s*[.!?…]*\\s*$", ""), F.lit("⟦1⟧"), F.regexp_extract("text", "([.!?…]*)\\s*$", 1))
    new = new.withColumn("text", F.when(F.col("_cites").isNull(), with_mark).otherwise(F.col("text"))).drop("_cites")
    out = new.withColumn("text", _fitted(F.col("text"))).select(*by, "version", "locale", "text")
    every = known.select("id", "number", "excerpt", "spans").union(whole).join(own.select("id", *by).distinct(), "id")
    return out, every.select(*by, "number", "excerpt", "spans")
