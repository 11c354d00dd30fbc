"""Pages to segments: repeated margins, headings, page typing, votes, samples, and folds over ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpusmill.functions.numbers import rounded
from corpusmill.functions.text import margin_key, normalised
from corpusmill.rules import DEFAULT, Rules

#: Fixed value: how numbered headings begin.
NUMBERED = "(?i)^((\\d+(\\.\\d+)*\\.?)|([IVXLC]+\\.)|((chapitre|chapter|section|annexe|annex|partie|part)\\s+\\S+))\\s*[-–:]?\\s*\\S"


def margins(pages: DataFrame, share: float = 0.5, rules: Rules = DEFAULT) -> DataFrame:
    """document, side, key, pages: lines among the first or last of a page (document, page, text, title) that at least share of
    the document's pages repeat; a line counts once a page and side. Pages with a title of their own are not compared."""
    n = rules.margin_lines
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("\\S"))
    p = pages.where("title is null").select("document", "page", lines.alias("lines")).where(F.size("lines") > 0)
    total = p.groupBy("document").agg(F.countDistinct("page").alias("total"))
    last = F.slice("lines", F.greatest(F.size("lines") - n + 1, F.lit(1)), F.lit(n))
    sides = [p.select("document", "page", F.lit(side).alias("side"), F.explode(F.transform(part, margin_key)).alias("key")) for side, part in (("top", F.slice("lines", 1, n)), ("bottom", last))]
    counts = sides[0].union(sides[1]).where(F.length("key") <= rules.margin_chars).distinct().groupBy("document", "side", "key").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(rules.margin_pages), F.ceil(F.col("total") * share))
    return counts.join(total, "document").where((F.col("total") >= rules.margin_pages) & (F.col("pages") >= least)).drop("total")


def stripped(pages: DataFrame, found: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """document, page, text: pages without those of their first and last lines whose key is among the document's repeated
    margins of that side. Pages with a title, and texts without such lines, stay as they are."""
    sides = found.groupBy("document").agg(*[F.collect_set(F.when(F.col("side") == x, F.col("key"))).alias(f"_{x}") for x in ("top", "bottom")])
    n, lines = rules.margin_lines, F.split("text", "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("\\S"), i)), lambda i: i.isNotNull())
    last = F.slice("_filled", F.greatest(F.size("_filled") - n + 1, F.lit(1)), F.lit(n))
    # Keys are of bounded number: a margin stands on a share of all pages.
    p = pages.join(sides, "document", "left").withColumns({"_lines": lines, "_filled": filled})
    among = lambda part, keys: F.filter(part, lambda i: F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), margin_key(F.element_at("_lines", i + 1))))
    p = p.withColumn("_gone", F.array_union(among(F.slice("_filled", 1, n), F.col("_top")), among(last, F.col("_bottom"))))
    kept = F.array_join(F.filter("_lines", lambda _, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("title").isNull() & (F.size("_gone") > 0), F.regexp_replace(kept, "^\\s+|\\s+$", "")).otherwise(F.col("text"))
    return p.select("document", "page", text.alias("text"))


def is_heading(line: Column) -> Column:
    """At most 120 characters and 14 words, numbered or without lower case (4 letters at least); one that ends in
    . , or ; must be numbered."""
    v = F.regexp_replace(line, "^\\s+|\\s+$", "")
    words = F.size(F.split(v, "\\s+"))
    numbered = v.rlike(NUMBERED)
    capitals = (F.length(F.regexp_replace(v, "[^\\p{L}]", "")) >= 4) & ~v.rlike("\\p{Ll}")
    return (v != "") & (F.length(v) <= 120) & (words <= 14) & (~v.rlike("[.,;]$") | numbered) & ((numbered & (words >= 2)) | capitals)


def page_typing(pages: DataFrame, least: int = 100) -> DataFrame:
    """document, type of (document, text, has_images): scan, mixte or natif."""
    size = F.coalesce(F.length("text"), F.lit(0))
    p = pages.groupBy("document").agg(F.sum(size).alias("size"), F.count("*").alias("n"), F.bool_or((size < least) & F.col("has_images")).alias("mixed"))
    return p.select("document", F.when(F.col("size") < least * F.col("n"), "scan").when(F.col("mixed"), "mixte").otherwise("natif").alias("type"))


def majority(votes: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """key, value, confidence: the most frequent value of each key, of equals the one met first. NULL values don't vote."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    won = counts.groupBy(key).agg(F.max_by(F.col(value), F.struct("n", -F.col("at"))).alias(value), (F.max("n") / F.sum("n")).alias("confidence"))
    return won


#: Names that a gazetteer may hold: it is sent to each task.
MOST_NAMES = 1_000_000


def names_of(names: DataFrame) -> DataFrame:
    """(name, code) of names (place, name, code) as they are sought: normalised, with what stands before 'republic of' or 'republique' too, of four
    letters at least; of equal ones the first place counts."""
    n = names.where("name is not null and code is not null").select("place", "code", normalised("name").alias("n"))
    cuts = F.array("n", *[F.trim(F.split("n", x)[0]) for x in (" republic of", " republique")])
    return n.select("place", "code", F.explode(F.array_distinct(cuts)).alias("name")).where(F.length("name") >= 4).groupBy("name").agg(F.min_by("code", "place").alias("code"))


def gazetteer(texts: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, pos, country: the names (name, code) met in normalised texts (doc_id, norm), from left to right the longest at each
    place, none within another. Names are a trie over words; null texts have none. More than MOST_NAMES names are refused."""
    known = names.limit(MOST_NAMES + 1).collect()
    if len(known) > MOST_NAMES:
        raise ValueError(f"a gazetteer holds at most {MOST_NAMES} names")
    trie: dict = {}
    for name, code in known:
        at = trie
        for word in name.split():
            at = at.setdefault(word, {})
        at[""] = code
    shared = texts.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for batch in batches:
            docs, places, codes = [], [], []
            for doc, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (norm or "").split(" ")
                i, met = 0, 0
                while i < len(words):
                    at, j, end, code = top, i, i + 1, None
                    while j < len(words) and (at := at.get(words[j])) is not None:
                        j += 1
                        if "" in at:
                            end, code = j, at[""]
                    if code is not None:
                        docs.append(doc)
                        places.append(met)
                        codes.append(code)
                        met += 1
                    i = end
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(places, pa.int32()), pa.array(codes, pa.string())], names=["doc_id", "pos", "country"])

    return texts.select("doc_id", "norm").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, pos int, country string")


def decided(texts: DataFrame, votes: DataFrame, value: str) -> DataFrame:
    """doc_id, value, confidence of every text: the majority of its votes (doc_id, pos, value), of equals the first, with its share rounded to 4
    digits; NULL and 0 without votes."""
    won = majority(votes, "doc_id", value, "pos").withColumn("confidence", rounded(F.col("confidence"), 4))
    return texts.select("doc_id").join(won, "doc_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def sample_positions(n: Column, s: int) -> Column:
    """Evenly spread positions among n rows, halves rounded to even; all if n <= s, the middle one if s is 1."""
    if s == 1:
        return F.array((n / 2).cast("bigint"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(s - 1)), lambda i: F.bround(i * (n - 1) / F.lit(s - 1), 0).cast("bigint"))
    return F.when(n <= s, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array_distinct(spread))


def pooled(windows: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """key, dim, value: sum of the unit vectors times their weight, of length 1 again. A zero vector adds nothing."""
    flat = windows.withColumn("_l", F.sqrt(F.aggregate(F.transform(vector, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))).where("_l > 0")
    flat = flat.select(key, F.posexplode(F.transform(vector, lambda x: x / F.col("_l") * F.col(weight))).alias("dim", "value"))
    sums = flat.groupBy(key, "dim").agg(F.sum("value").alias("value"))
    length = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_l"))
    return sums.join(length, key).select(key, "dim", F.when(F.col("_l") == 0, F.col("value")).otherwise(F.col("value") / F.col("_l")).alias("value"))


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[Any], Any], schema: str) -> DataFrame:
    """A fold over each key's ordered rows that windows can't express. start(key) gives an object with step(*values), called with
    the other columns of rows, and end(); both give result tuples. Partitions are sorted and read in Arrow batches: only the
    fold's own state is held, however many rows a key has."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at, any_yet = None, None, False

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            done: list[tuple] = []
            for k, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not any_yet or k != at:
                    done += fold.end() if fold else []
                    fold, at, any_yet = start(k), k, True
                done += fold.step(*values)
            yield out(done)
        if fold:
            yield out(list(fold.end()))

    keyed = rows.where(F.col(key).isNotNull()).select(key, *[c for c in rows.columns if c != key])
    return keyed.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Batches:
    """Rows (pos, tokens). A batch closes when one more row would exceed the count or the tokens; a row beyond the tokens goes alone."""

    def __init__(self, key, most_rows: int, most_tokens: int):
        self.key, self.most, self.tokens, self.no, self.n, self.sum = key, most_rows, most_tokens, 0, 0, 0

    def step(self, pos, tokens, *_):
        if self.n and (self.n + 1 > self.most or self.sum + tokens > self.tokens):
            self.no, self.n, self.sum = self.no + 1, 0, 0
        self.n, self.sum = self.n + 1, self.sum + tokens
        return [(self.key, pos, self.no)]

    def end(self):
        return []


def vote_starts(size: Column, window: int = 5_000, most: int = 20) -> Column:
    """Where the windows of a text of so many characters begin, at most `most` of them, spread evenly."""
    n = F.ceil(size / window).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= most, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * window)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * n / most).cast("int") * window)
    )


def semantic_score(segments: DataFrame, key: str, similarity: str, weight: str) -> DataFrame:
    """key, score: the weighted mean similarity as a whole percent from 0 to 100, cut, not rounded; 0 without weight."""
    mean = F.sum(F.col(similarity) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))
    return segments.groupBy(key).agg(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce((mean * 100).cast("int"), F.lit(0)))).alias("score"))


class Ban:
    """Rows (event_id, us). More than limit attempts in (now - window, now] ban a client for ban microseconds; a ban clears the count."""

    def __init__(self, key, limit: int, window: int, ban: int):
        self.key, self.limit, self.window, self.ban, self.until, self.seen = key, limit, window, ban, None, []

    def step(self, event_id, us):
        if self.until is not None and us < self.until:
            return [(self.key, event_id, True)]
        self.until = None
        self.seen = [t for t in self.seen if t > us - self.window] + [us]
        if len(self.seen) > self.limit:
            self.until, self.seen = us + self.ban, []
        return [(self.key, event_id, self.until is not None)]

    def end(self):
        return []
