"""Sentences of texts, passages, and the sources that marks in texts refer to: marks and sentences are exploded with their
places, numbered in windows, and put back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import plain, shortened
from corpusmill.operators.ordered import merged_spans

# Words before a full stop that doesn't end a sentence; what may end a sentence, close it and begin the next; what begins a point of a list.
SHORT_FORMS = "m mm mme mmes mlle dr pr me st ste p pp art al cf ex fig vol no n° nº env min max approx réf ref chap sect mr mrs ms vs e.g i.e jan fév feb av apr sept oct nov déc dec inc ltd co".split()
STOPS, CLOSERS, BEGINS, POINT = "[.!?…]", "[\"»”’)\\]]", "[\"«“(\\[]?[A-ZÀ-ÖØ-Þ0-9•▪◦●\\-–]", "(?:[•▪◦●\\-–*]|\\d{1,2}[.)])\\s"
LONGEST, LEAST_PART = 500, 80
# References as they are written, and source numbers in finished texts.
REFERENCES = "(?i)\\s*[\\[(]\\s*(E\\d+(?:\\.\\d+)?(?:\\s*[,;]\\s*E\\d+(?:\\.\\d+)?)*)\\s*[\\])]"
NUMBERS = "⟦(\\d+(?:,\\d+)*)⟧"
# Fixed value: a word cut at the end of a line.
CUT_WORD = "([\\p{L}\\p{N}_]+-[ \\t]*\\n[ \\t]*[\\p{L}\\p{N}_]+)"


def _sentence_ends() -> str:
    """Places where a sentence ends: after a stop that white space and a beginning follow, unless the word before a full stop is a
    short form, one letter, or a number of one or two digits; before a blank line; before a point of a list."""
    short = "|".join(map(re.escape, sorted(SHORT_FORMS, key=len, reverse=True)))
    is_short = f"(?<!\\S)(?iu:{short}|\\p{{L}}|\\d{{1,2}})\\.{STOPS}{{0,3}}{CLOSERS}{{0,4}}"
    return f"(?<={STOPS}{CLOSERS}{{0,4}})(?<!{is_short})(?=\\s+{BEGINS})|(?=\\n\\s*\\n)|(?=\\n\\s*{POINT})"


def cleaned(c: Column | str) -> Column:
    """Words parted at line ends joined, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])", "$1$2"), "(?U)\\s+", " "))


def sentences(texts: DataFrame, key: str) -> DataFrame:
    """key, sentence (from 0), start, end, text: the sentences of texts (key, text), trimmed, with their places. One of more than
    LONGEST characters is parted after semicolons, each part of LEAST_PART characters at least."""
    pieces = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), _sentence_ends())).alias("_k", "_piece"))
    at = F.coalesce(F.sum(F.length("_piece")).over(W.partitionBy(key).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lead = lambda c: F.length(F.regexp_extract(c, "(?U)^\\s*", 0))
    body = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    pieces = pieces.select(key, (at + lead(F.col("_piece"))).alias("_at"), body(F.col("_piece")).alias("_piece")).where("_piece <> ''")
    # The parts of a long sentence that are too short join the next one.
    joined = F.aggregate(
        F.split("_piece", "(?<=;)(?=\\s)"), F.array(F.lit("")),
        lambda done, x: F.when(F.length(F.element_at(done, -1)) >= LEAST_PART, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), x)))),
    )
    parts = F.when(F.length("_piece") > LONGEST, joined).otherwise(F.array("_piece"))
    rows = pieces.select(key, "_at", F.posexplode(parts).alias("_j", "_part"))
    before = F.coalesce(F.sum(F.length("_part")).over(W.partitionBy(key, "_at").orderBy("_j").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", (F.col("_at") + before + lead(F.col("_part"))).cast("int")).withColumn("text", body(F.col("_part"))).where("text <> ''")
    number = F.row_number().over(W.partitionBy(key).orderBy("start")) - 1
    return rows.select(key, number.alias("sentence"), "start", (F.col("start") + F.length("text")).alias("end"), "text")


def excerpts(sentences_: DataFrame, key: str, limit: int) -> DataFrame:
    """key, sentence (from 0), start, end, text: the first sentences, cleaned, that fit the limit together; a first one beyond it is shortened."""
    s = sentences_.withColumn("text", cleaned("text")).where("text <> ''")
    in_order = W.partitionBy(key).orderBy("start")
    s = s.withColumn("sentence", F.row_number().over(in_order) - 1).withColumn("_used", F.coalesce(F.sum(F.length("text") + 1).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    beyond = (F.col("sentence") > 0) & (F.col("_used") + F.length("text") > limit)
    kept = s.withColumn("_beyond", F.max(beyond).over(in_order.rowsBetween(W.unboundedPreceding, 0))).where(~F.col("_beyond"))
    return kept.select(key, "sentence", "start", "end", shortened(F.col("text"), limit).alias("text"))


def passages(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, text: the spans (key, start, end) of texts (key, text), those that touch or overlap as one, cleaned, with an
    ellipsis between others. Texts without spans have no row."""
    parts = merged_spans(spans, key).join(texts, key).select(key, "start", cleaned(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("part")).where("part <> ''")
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), " … ").alias("text"))


def _put_back(texts: DataFrame, keys: list[str], pattern: str, new: DataFrame) -> DataFrame:
    """texts (keys, text) with the i-th place of the pattern replaced by new (keys, i, mark); places without a row go."""
    marks = new.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "mark"))).alias("_marks"))
    both = texts.join(marks, keys, "left").withColumn("_parts", F.split("text", pattern))
    between = lambda i: F.when(i + 1 < F.size("_parts"), F.coalesce(F.element_at("_marks", i), F.lit(""))).otherwise("")
    whole = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, between(i))), "")
    return both.withColumn("text", whole).drop("_marks", "_parts")


def _joined_spans(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap as one."""
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        F.array_sort(spans), F.slice(spans, 1, 0),
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= last(done)["end"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), one(last(done)["start"], F.greatest(last(done)["end"], x["end"])))).otherwise(F.concat(done, one(x["start"], x["end"]))),
    )


def cited(texts: DataFrame, offered: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """texts (key, text) with references to offered excerpts (key, excerpt, spans of its sentences) as numbers of sources, and
    the sources (key, number, excerpt, spans).

    A mark's sentences of one excerpt are one source, a reference without a known sentence is to all of them. Sources of the same
    spans are one, numbered by first citation; references to what isn't offered go, and marks of such alone. Texts with a
    column version are versions of one text: their sources are numbered together, versions in order.
    """
    by = [key, "version"] if "version" in texts.columns else [key]
    own = texts.withColumn("text", F.translate("text", "⟦⟧", ""))
    marks = own.select(*by, F.posexplode(F.regexp_extract_all("text", F.lit(REFERENCES), 1)).alias("i", "mark"))
    refs = marks.select(*by, "i", F.posexplode(F.split("mark", "[,;]")).alias("j", "ref"))
    number = lambda part: F.regexp_extract("ref", f"(?i){part}", 1)
    refs = refs.select(*by, "i", "j", number("E(\\d+)").cast("int").alias("excerpt"), F.nullif(number("\\.(\\d+)"), F.lit("")).cast("int").alias("sentence")).join(offered, [key, "excerpt"])
    chosen = F.when(F.col("sentence").between(1, F.size("spans")), F.slice("spans", F.col("sentence"), F.lit(1))).otherwise(F.col("spans"))
    found = refs.select(*by, "i", "j", "excerpt", chosen.alias("spans")).groupBy(*by, "i", "excerpt").agg(F.min("j").alias("j"), F.flatten(F.collect_list("spans")).alias("spans"))
    found = found.withColumn("spans", _joined_spans(F.col("spans")))
    sources = found.groupBy(key, "excerpt", "spans").agg(F.min(F.struct(*by[1:], "i", "j")).alias("_at"))
    sources = sources.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("_at"))).drop("_at")
    numbers = found.join(sources, [key, "excerpt", "spans"]).groupBy(*by, "i").agg(F.sort_array(F.collect_list(F.struct("j", "number"))).alias("n"))
    new = numbers.select(*by, "i", F.concat(F.lit("⟦"), F.array_join("n.number", ","), F.lit("⟧")).alias("mark"))
    return _put_back(own, by, REFERENCES, new), sources.select(key, "number", "excerpt", "spans")


def compacted(texts: DataFrame, sources: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """texts (key, version, text) with the sources (key, number and others) that they cite numbered by first citation, versions in
    order, and those sources; numbers without a source go."""
    cites = texts.select(key, "version", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBERS), 1)).alias("i", "mark"))
    cites = cites.select(key, "version", "i", F.posexplode(F.split("mark", ",")).alias("j", "n")).select(key, "version", "i", "j", F.col("n").cast("int").alias("number")).join(sources.select(key, "number"), [key, "number"], "left_semi")
    first = cites.groupBy(key, "number").agg(F.min(F.struct("version", "i", "j")).alias("_at"))
    order = first.select(key, "number", F.row_number().over(W.partitionBy(key).orderBy("_at")).alias("_new"))
    new = cites.join(order, [key, "number"]).groupBy(key, "version", "i", "_new").agg(F.min("j").alias("j"))
    new = new.groupBy(key, "version", "i").agg(F.sort_array(F.collect_list(F.struct("j", "_new"))).alias("n"))
    new = new.select(key, "version", "i", F.concat(F.lit("⟦"), F.array_join("n._new", ","), F.lit("⟧")).alias("mark"))
    kept = sources.join(order, [key, "number"]).withColumn("number", F.col("_new")).drop("_new")
    return _put_back(texts, [key, "version"], NUMBERS, new), kept


def cut(c: Column | str, limit: int) -> Column:
    """As it is if it has at most limit characters besides its source numbers, which count nothing and stay whole; else cut at the
    last white space beyond half of the limit, with an ellipsis."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.regexp_extract(c, f"(?s)^((?:(?:⟦\\d+(?:,\\d+)*⟧)*+.){{{limit - 1}}})", 1)
    before = F.regexp_extract(head, "(?s)^(.*)[ \\n]", 1)
    kept = F.when(F.length(plain(before)) > limit // 2, before).otherwise(head)
    return F.when(F.length(plain(c)) <= limit, c).otherwise(F.concat(F.regexp_replace(kept, "\\s+$", ""), F.lit("…")))


def rejoined(pages: DataFrame, vocabulary: DataFrame, document: str, page: str) -> DataFrame:
    """pages (document, page, text) with words cut at line ends joined if the rest begins in lower case and no digit comes
    before; a compound keeps its hyphen if the document's vocabulary (document, w, in lower case) has it with the hyphen only."""
    marks = pages.select(document, page, F.posexplode(F.regexp_extract_all("text", F.lit(CUT_WORD), 1)).alias("i", "mark"))
    side = lambda pattern: F.regexp_extract("mark", pattern, 1)
    marks = marks.withColumn("left", side("^([\\p{L}\\p{N}_]+)-")).withColumn("right", side("([\\p{L}\\p{N}_]+)$"))
    known = lambda name, w: vocabulary.select(document, F.col("w").alias(name), F.lit(True).alias(f"has_{name}")).distinct().join(marks.select(document, w.alias(name)).distinct(), [document, name])
    whole, compound = F.lower(F.concat("left", "right")), F.lower(F.concat_ws("-", "left", "right"))
    marks = marks.withColumn("whole", whole).withColumn("compound", compound).join(known("whole", whole), [document, "whole"], "left").join(known("compound", compound), [document, "compound"], "left")
    new = F.when(~F.col("right").rlike("^\\p{Ll}") | F.col("left").rlike("\\d$"), F.col("mark")).when(F.col("has_compound") & F.col("has_whole").isNull(), F.concat_ws("-", "left", "right")).otherwise(F.concat("left", "right"))
    return _put_back(pages, [document, page], CUT_WORD, marks.select(document, page, "i", new.alias("mark")))


def aligned(pairs: DataFrame, words: DataFrame, excerpts_: DataFrame, run: int = 4, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, words, first_word, last_word for pairs (doc_id, item_id): the page's words (doc_id, words) that stand in runs of
    at least `run` words of the excerpt (item_id, words) in the same order, where these are at least a share of the excerpt."""
    grams = lambda df, key, at: df.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - run + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, run), " "))).alias(at, "gram"), F.size("words").alias(f"n_{key}")).where(F.size(F.split("gram", " ")) == F.least(F.lit(run), F.col(f"n_{key}")))
    page = grams(words.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "p").join(pairs, "doc_id")
    both = page.join(grams(excerpts_, "item_id", "e"), ["item_id", "gram"])
    width = F.least(F.lit(run), F.col("n_item_id")) - 1
    both = both.select("doc_id", "item_id", F.col("n_item_id").alias("n"), F.explode(F.sequence(F.lit(0), width)).alias("o"), "p", "e").select("doc_id", "item_id", "n", (F.col("p") + F.col("o")).alias("p"), (F.col("e") + F.col("o")).alias("e"))
    found = both.groupBy("doc_id", "item_id", "n").agg(F.countDistinct("p").alias("words"), F.countDistinct("e").alias("_found"), F.min("p").alias("first_word"), F.max("p").alias("last_word"))
    return found.where(F.col("_found") >= share * F.col("n")).drop("_found", "n")
