"""Answers that come from outside: which grades and qualifications count, statuses, flags, limits and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.numbers import number, rounded
from corpusmill.functions.text import shortened


def valid_grades(grades: DataFrame, offered: DataFrame) -> DataFrame:
    """The first answer of each question (seq) whose note is 0 to 3 and that cites an excerpt offered for the question:
    question, note, excerpts (those offered, in order of citation, joined by commas)."""
    cited = grades.where(F.col("note").between(0, 3)).select("question", "seq", "note", F.posexplode("excerpts").alias("pos", "excerpt"))
    cited = cited.join(offered.select("question", "excerpt").distinct(), ["question", "excerpt"], "left_semi")
    once = cited.groupBy("question", "seq", "note", "excerpt").agg(F.min("pos").alias("pos"))
    rows = once.groupBy("question", "seq", "note").agg(F.array_sort(F.collect_list(F.struct("pos", "excerpt"))).alias("e"))
    first = F.row_number().over(W.partitionBy("question").orderBy("seq"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    return rows.select("question", "note", F.array_join(F.transform("e", lambda x: x["excerpt"]), ",").alias("excerpts"))


def qualified(alerts: DataFrame, answers: DataFrame, poor: float) -> DataFrame:
    """alerts (id, severity, confidence) after the first answer to each (seq): unconfirmed ones go, a severity of the list
    is taken, poor confidence makes an alert minor. Column qualified says whether there was an answer."""
    first = F.row_number().over(W.partitionBy("id").orderBy("seq"))
    one = answers.withColumn("_n", first).where("_n = 1").select("id", "confirmed", F.col("severity").alias("_said"))
    both = alerts.join(one, "id", "left").where(F.coalesce("confirmed", F.lit(True)))
    said = F.when(F.col("_said").isin("mineure", "majeure"), F.col("_said")).otherwise(F.col("severity"))
    answered = F.col("confirmed").isNotNull()
    severity = F.when(answered & (F.col("confidence") < poor), "mineure").when(answered, said).otherwise(F.col("severity"))
    return both.select("id", severity.alias("severity"), answered.alias("qualified"))


def language_flags(value: Column, confidence: Column, source: Column, expected: Column, least: float = 0.7) -> tuple[Column, Column]:
    """Whether a language is to be confirmed (found, not given, and unsure), and whether it is expected (NULL if unknown)."""
    return (source == "auto") & (confidence < least), F.when(value.isNotNull(), F.array_contains(expected, value))


def restitution_status(qualified_: Column, needed: Column, disabled: Column) -> Column:
    return F.when(qualified_, "completed").when(~needed, "not_needed").when(disabled, "disabled").otherwise("failed")


def run_gate(pending: Column, failed: Column, changed: Column, waited: Column, longest: int) -> Column:
    """fail for a failed or changed input, else defer while some is pending, but not for longer than longest seconds."""
    return F.when(failed | changed, "fail").when(pending & (waited >= longest), "timeout").when(pending, "defer").otherwise("run")


def affordable(estimated: Column, most: Column) -> Column:
    """A call is made unless its estimated cost is beyond a limit; no limit, or one of 0, allows all."""
    return ~F.coalesce((most > 0) & (estimated > most), F.lit(False))


def cost_status(tokens: Column, price: Column) -> Column:
    """What is known of a processing's cost: completed, partial (some calls without a price) or unavailable."""
    known = F.count_if(tokens.isNotNull() & price.isNotNull())
    return F.when(known == F.count("*"), "completed").when(known > 0, "partial").otherwise("unavailable")


def confidence_of(pages: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """key, ocr_pages, ocr_confidence (mean of those known, 3 digits), low_pages, weighted_confidence (by words' length)."""
    known = F.col("confidence").isNotNull()
    weighted = F.sum(F.col("confidence") * F.when(known, F.col("size"))) / F.nullif(F.sum(F.when(known, F.col("size"))), F.lit(0))
    return pages.groupBy(key).agg(
        F.count("confidence").alias("ocr_pages"), rounded(F.avg("confidence"), 3).alias("ocr_confidence"), F.count_if(F.col("confidence") < least).alias("low_pages"), F.round(weighted, 6).alias("weighted_confidence"),
    )


def header_rows(rows: DataFrame, sheet: str, row: str, first: int = 10) -> DataFrame:
    """sheet, header: the first of the first rows of a sheet (cells array<string>) with two labels or more and no number."""
    numeric = lambda x: x.rlike("^-?\\d+([.,]\\d+)?$")
    filled = F.filter("cells", lambda x: x.rlike("\\S"))
    good = (F.size(filled) >= 2) & ~F.exists(filled, numeric)
    return rows.where(F.col(row) <= first).groupBy(sheet).agg(F.min(F.when(good, F.col(row))).alias("header"))


def dataset_faults(items: DataFrame, documents: DataFrame, least: int = 12) -> DataFrame:
    """item_id, faults of (item_id, doc_id, quote): a repeated key, a short quote, a document that is not in the corpus."""
    n = F.count("*").over(W.partitionBy("item_id"))
    known = documents.select("doc_id").distinct().withColumn("_known", F.lit(True))
    both = items.withColumn("_n", n).join(known, "doc_id", "left")
    faults = F.concat_ws(",", F.when(F.col("_n") > 1, "repeated"), F.when(F.length(F.trim("quote")) < least, "short"), F.when(F.col("_known").isNull(), "unknown"))
    return both.select("item_id", "doc_id", faults.alias("faults"))


def report_limits(variables: DataFrame, scores: DataFrame, notes: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: criteria that are ambiguous or without a note, variables not documented in their latest version, pillars
    without a score, alerts that are not major."""
    last = variables.groupBy("variable_id").agg(F.max_by("state", "order_index").alias("state")).agg(F.count_if(F.col("state") == "non_renseigne").alias("undocumented"))
    n = notes.agg(F.count_if("ambiguous").alias("ambiguous"), F.count_if(F.col("note").isNull()).alias("without_note"))
    s = scores.groupBy("pillar").agg(F.max("score").alias("s")).agg(F.count_if(F.col("s").isNull()).alias("unscored"))
    a = alerts.agg(F.count_if(F.col("severity") == "mineure").alias("minor_alerts"))
    return n.join(s, how="cross").join(last, how="cross").join(a, how="cross")


#: Fixed value: the order in which a report names its limits.
LIMITS = ("not_concluded", "ambiguous", "confidence", "unscored", "undocumented", "pending", "unqualified")


def limit_lines(variables: DataFrame, scores: DataFrame, notes: DataFrame, alerts: DataFrame) -> DataFrame:
    """place, kind, n, total of the limits that a report names: criteria without conclusion or ambiguous, the mean confidence of latest versions in
    percent, pillars without a score and variables not documented in their latest version, alerts (pending, qualified) to be looked into
    or not qualified. Every row becomes one row of each kind that it may count for, so that one aggregate counts all of
    them; kinds that count nothing aren't named, the confidence is where there is a score."""
    kinds = lambda df, **flags: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("counts"), v.alias("value")) for k, (c, v) in flags.items()])).alias("x")).select("x.*")
    none, whole = F.lit(None).cast("double"), F.lit(False)
    last_scores = scores.groupBy("pillar").agg(F.max_by(F.struct("score", "confidence"), "order_index").alias("x")).select("x.*")
    last_states = variables.groupBy("variable_id").agg(F.max_by("state", "order_index").alias("state"))
    rows = kinds(notes, not_concluded=(F.col("reason") != "concluded", none), ambiguous=(F.col("ambiguous"), none))
    rows = rows.union(kinds(last_scores, confidence=(whole, F.col("confidence").cast("double")), unscored=(F.col("score").isNull(), none)))
    rows = rows.union(kinds(last_states, undocumented=(F.col("state") == "non_renseigne", none))).union(kinds(alerts, pending=(F.col("pending"), none), unqualified=(~F.col("qualified"), none)))
    counts = rows.groupBy("kind").agg(F.count_if("counts").alias("n"), F.count("*").alias("total"), rounded(F.avg("value") * 100, 0).cast("long").alias("mean"))
    place = F.array_position(F.array(*map(F.lit, LIMITS)), F.col("kind")).cast("int")
    named = counts.withColumn("n", F.when(F.col("kind") == "confidence", F.col("mean")).otherwise(F.col("n")))
    return named.where((F.col("n") > 0) | (F.col("kind") == "confidence")).select(place.alias("place"), "kind", "n", "total")


#: Statuses whose documents are indexed.
INDEXED = ("conforme", "integre_decision_humaine")


def index_eligible(status: Column) -> Column:
    """Whether a document of this status is indexed; one without a status isn't."""
    return F.coalesce(status.isin(*INDEXED), F.lit(False))


def layers_available(runs: DataFrame, steps: DataFrame, layers: list[str]) -> DataFrame:
    """run and a flag for each layer of every run (run): the last status (run, step, seq, status) of its step is not 'skipped', or it has no such step."""
    last = steps.where(F.col("step").isin(layers)).groupBy("run", "step").agg(F.max_by("status", "seq").alias("status"))
    skipped = last.groupBy("run").agg(*[F.bool_or((F.col("step") == x) & (F.col("status") == "skipped")).alias(x) for x in layers])
    return runs.select("run").distinct().join(skipped, "run", "left").select("run", *[~F.coalesce(F.col(x), F.lit(False)) for x in layers]).toDF("run", *layers)


def country_names(codes: DataFrame, countries: DataFrame, translations: DataFrame, locale: str) -> DataFrame:
    """code, name of codes (code): the name of countries (code, name, common) in a locale, of translations (locale, name, translated); where it has none, or
    the same, the common name before the official one. Codes count in any case; unknown and null ones have NULL."""
    own = countries.join(translations.where(F.col("locale") == locale).select("name", "translated"), "name", "left")
    translated = F.when(F.col("translated") != F.col("name"), F.col("translated"))
    named = own.select(F.upper("code").alias("_code"), F.coalesce(translated, "common", "name").alias("name")).dropDuplicates(["_code"])
    return codes.join(named, F.upper(codes["code"]) == named["_code"], "left").select(codes["code"], "name")


def default_messages(alerts: DataFrame, templates: DataFrame, locale: str, most: int = 500) -> DataFrame:
    """alerts with a message: the template (locale, rule, template) of their rule, in English where the locale has none, with {pillar}, {criterion}, {score}, {note},
    {delta} and {confidence} filled in, numbers rounded, missing ones empty; cut at most characters."""
    wanted = templates.where(F.col("locale").isin(locale, "en")).groupBy("rule").agg(F.max_by("template", F.col("locale") == locale).alias("_t"))
    filled = F.col("_t")
    values = {"pillar": F.col("pillar").cast("string"), "criterion": F.col("criterion").cast("string"), "score": number(F.col("score")), "note": number(F.col("note"), 1), "delta": number(F.col("delta")), "confidence": number(F.col("confidence") * 100)}
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), F.when(F.col(name).isNull(), "").otherwise(F.coalesce(value, F.lit(""))))
    return alerts.join(wanted, "rule").withColumn("message", shortened(filled, most)).drop("_t")
