"""Pages to segments with their texts: paragraphs and headings by windows over lines, long paragraphs cut at sentences and then
by tokens, and units packed to about a target size with an overlap inside a section.

Tokens are runs of letters, runs of digits, and other characters that aren't white space, a declared substitute for a
model's tokens; a text's tokens are the sum of those of its parts. One shuffle by document serves all windows and the packing,
which sees numbers and titles only: it assigns units to segments, and the segments' texts are put together by an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.ingestion import is_heading
from corpusmill.rules import DEFAULT, Rules

#: The places before tokens: before a character that isn't white space, but not inside a run of letters or of digits.
_BEFORE_TOKEN = r"(?<!^)(?=\S)(?!(?<=\p{L})(?=\p{L}))(?!(?<=\p{N})(?=\p{N}))"
#: Fixed value: what ends a sentence before white space.
_SENTENCE_END = "^[.!?;:]\\s+$"
UNIT = "document, unit, page, paragraph, title, heading, text, tokens, char_start, char_end"


def pieces(text: Column | str) -> Column:
    """The tokens of a text, each with the white space after it."""
    return F.split(text, _BEFORE_TOKEN)


def count_tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike("\\S"), F.size(pieces(text))).otherwise(0)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def paragraphs(pages: DataFrame) -> DataFrame:
    """(document, page, title, paragraph, heading, text, char_start, char_end) of pages (document, page, text, char_start, title,
    headings), in each document a number from 0 for each paragraph.

    Blank lines part paragraphs, and so does a heading, which stands alone; headings are lines that look like one, or are
    among the page's own. Title is the section: the last heading, or the page's title where that came later. A page of no
    text has no paragraphs, its title goes on; null texts are empty.
    """
    in_page = W.partitionBy("document", "page").orderBy("line")
    in_document = W.partitionBy("document").orderBy("page", "line").rowsBetween(W.unboundedPreceding, 0)
    lines = pages.repartition("document").select("document", "page", F.col("title").alias("page_title"), "headings", "char_start", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    at = F.coalesce(F.sum(F.length("text") + 1).over(in_page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.array_contains("headings", _stripped(F.col("text"))), F.lit(False))
    lines = lines.select("document", "page", "line", "page_title", "text", (F.col("char_start") + at).alias("at"), F.col("text").rlike("\\S").alias("filled"), (is_heading(F.col("text")) | own).alias("heading"))
    opens = F.col("filled") & (F.col("heading") | ~F.coalesce(F.lag("filled").over(in_page), F.lit(False)) | F.coalesce(F.lag("heading").over(in_page), F.lit(False)))
    lines = lines.withColumn("heading", F.col("heading") & F.col("filled")).withColumn("opens", opens)
    # A page's title counts from its first line on, filled or not; a heading in the same line comes after it.
    section = F.when(F.col("heading"), _stripped(F.col("text"))).when(F.col("line") == 0, F.nullif(F.col("page_title"), F.lit("")))
    lines = lines.withColumn("paragraph", F.sum(F.col("opens").cast("int")).over(in_document) - 1).withColumn("title", F.last(section, ignorenulls=True).over(in_document))
    lead = F.length(F.regexp_extract("text", "^\\s*", 0))
    first = F.min_by(F.struct(F.col("at") + lead, F.col("title"), F.col("heading")), F.col("line"))
    rows = lines.where("filled").groupBy("document", "page", "paragraph").agg(first.alias("first"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("lines"))
    rows = rows.select("document", "page", "paragraph", "first.title", "first.heading", _stripped(F.array_join("lines.text", "\n")).alias("text"), F.col("first.col1").alias("char_start"))
    return rows.withColumn("char_end", F.col("char_start") + F.length("text"))


def units(paragraphs_: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """UNIT columns: paragraphs of at most segment_max tokens, the sentences of longer ones, and windows of segment_target tokens of
    sentences that are longer still, each with the last segment_overlap tokens of the one before. Windows have the place of
    their sentence."""
    zero, step, target = F.lit(0), rules.segment_target - rules.segment_overlap, rules.segment_target
    # A paragraph that stays whole is one piece with all its tokens.
    p = paragraphs_.withColumn("n", count_tokens("text")).withColumn("whole", F.col("n") <= rules.segment_max)
    p = p.select("document", "page", "paragraph", "title", "heading", "char_start", F.when(F.col("whole"), F.col("n")).otherwise(1).alias("n"), F.posexplode(F.when(F.col("whole"), F.array("text")).otherwise(pieces("text"))).alias("k", "piece"))
    before = W.partitionBy("document", "page", "paragraph").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), zero)).withColumn("sentence", F.coalesce(F.count_if(F.col("piece").rlike(_SENTENCE_END)).over(before), zero))
    sentence = W.partitionBy("document", "page", "paragraph", "sentence")
    p = p.withColumn("i", F.row_number().over(sentence.orderBy("k")) - 1).withColumn("size", F.count("*").over(sentence))
    p = p.withColumn("from", F.min("at").over(sentence)).withColumn("to", F.max(F.col("at") + F.length(_stripped(F.col("piece")))).over(sentence))
    first, last = F.greatest(zero, F.ceil((F.col("i") - target + 1) / step).cast("int")), F.floor(F.col("i") / step).cast("int")
    p = p.withColumn("window", F.explode(F.when(F.col("size") <= rules.segment_max, F.array(zero)).otherwise(F.sequence(first, last))))
    every = p.groupBy("document", "page", "paragraph", "sentence", "window").agg(
        F.first("title").alias("title"), F.first("heading").alias("heading"), _stripped(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "")).alias("text"),
        F.sum("n").cast("int").alias("tokens"), F.first(F.col("char_start") + F.col("from")).alias("char_start"), F.first(F.col("char_start") + F.col("to")).alias("char_end"),
    )
    number = F.row_number().over(W.partitionBy("document").orderBy("page", "paragraph", "sentence", "window")) - 1
    return every.withColumn("unit", number).select(*UNIT.split(", "))


class Packing:
    """Assigns the ordered units of one document to segments. A unit that would take the open segment beyond the target opens the
    next one, which begins with the overlap; a new title closes it without, unless it has headings only, which go
    with what follows. A segment of fewer than the least tokens that ends a section joins the one before of the same title."""

    def __init__(self, rules: Rules):
        self.r, self.number = rules, -1
        self.before: tuple[str | None, int] | None = None  # title and tokens of the last closed segment
        self.open: list[tuple[int, bool]] = []  # tokens and heading of the open segment's units
        self.title, self.overlap = None, 0

    def _closed(self, ends: bool) -> list[tuple]:
        """For each unit of the open segment: segment, title, overlap of the segment, whether the unit is of a tail that joined."""
        body, n, overlap = sum(t for t, _ in self.open), len(self.open), self.overlap
        size = body + overlap
        joins = ends and self.before is not None and size < self.r.segment_min and self.before[0] == self.title and self.before[1] + size <= self.r.segment_max
        if joins:
            self.before = (self.title, self.before[1] + body)
        else:
            self.number, self.before = self.number + 1, (self.title, size)
        self.overlap = self.r.segment_overlap if not ends and body > self.r.segment_overlap else 0
        self.open = []
        return [(self.number, self.title, 0 if joins else overlap, joins)] * n

    def step(self, tokens: int, heading: bool, title: str | None) -> list[tuple]:
        done = []
        if self.open and title != self.title:
            if all(h for _, h in self.open):
                self.overlap = 0
            else:
                done += self._closed(ends=True)
        if self.open and sum(t for t, _ in self.open) + self.overlap + tokens > self.r.segment_target:
            # Headings alone that are full take the title that they were to open.
            self.title = title
            done += self._closed(ends=False)
        self.open.append((tokens, heading))
        self.title = title
        return done

    def end(self) -> list[tuple]:
        return self._closed(ends=True) if self.open else []


def _packed(rules: Rules, names: list[str]):
    given = ["segment", "section", "overlap", "tail"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at, none = None, None, True
        waiting: pa.Table | None = None  # rows of the open segment

        def out(done: list[tuple]):
            nonlocal waiting
            ready, waiting = waiting.slice(0, len(done)), waiting.slice(len(done))
            columns = [pa.chunked_array([pa.array([d[i] for d in done], t)]) for i, t in enumerate(types)]
            table = pa.table([*ready.columns, *columns], names=[*names, *given])
            return table.combine_chunks().to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            done: list[tuple] = []
            for document, tokens, heading, title in zip(*[batch.column(names.index(c)).to_pylist() for c in ("document", "tokens", "heading", "title")], strict=True):
                if none or document != at:
                    done += fold.end() if fold else []
                    fold, at, none = Packing(rules), document, False
                done += fold.step(tokens, heading, title)
            if done:
                yield from out(done)
        if fold:
            yield from out(fold.end())

    return run


def packed(units_: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(document, segment, page, section, paragraph, text, char_start, char_end, tokens) of units (UNIT) of each document.

    Page, paragraph and char_start are those of the first unit, char_end that of the last. A text that continues a section
    begins with the last segment_overlap tokens of the one before. A document is packed by one task, which holds one segment's rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in units_.schema.fields}
    names = UNIT.split(", ")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", segment int, section string, overlap int, tail boolean"
    rows = units_.select(*names).repartition("document").sortWithinPartitions("document", "unit").mapInArrow(_packed(rules, names), schema)
    first = F.min_by(F.struct("page", "paragraph", "section", "char_start", "overlap"), F.col("unit"))
    segments = rows.groupBy("document", "segment").agg(
        first.alias("first"), F.max_by("char_end", "unit").alias("char_end"), F.sum("tokens").alias("tokens"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit", "text"))), lambda x: x["text"]), "\n").alias("body"),
    )
    # Only a segment without a tail is followed by an overlap, so that its body is what the overlap is taken from.
    rest = F.array_join(F.slice(pieces("body"), -rules.segment_overlap, rules.segment_overlap), "")
    in_order = W.partitionBy("document").orderBy("segment")
    follows = F.coalesce(F.lead("first.overlap").over(in_order) > 0, F.lit(False))
    segments = segments.withColumn("rest", F.when(follows, rest)).withColumn("rest", F.lag("rest").over(in_order))
    text = F.when(F.col("first.overlap") > 0, F.concat_ws("\n", _stripped(F.col("rest")), "body")).otherwise(F.col("body"))
    return segments.select("document", "segment", "first.page", "first.section", "first.paragraph", text.alias("text"), "first.char_start", "char_end", (F.col("tokens") + F.col("first.overlap")).alias("tokens"))


def segmented(pages: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The segments of pages (document, page, text, char_start, title, headings)."""
    return packed(units(paragraphs(pages), rules), rules)
