"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the benchmark items.

Texts are normalised (A-Z to lower case, words of letters and digits joined by one space), each document is scanned
once, and hits are mapped back to words and character offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import saved

WINDOW = 10
#: Characters of windows that one automaton holds; more items make more automata, each of which scans the texts.
MAX_CHARS = 30_000_000
_TABLE = bytes(c if 0x30 <= c < 0x3A or 0x61 <= c < 0x7B or c >= 0x80 else c + 32 if 0x41 <= c < 0x5B else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "doc_id long, n_words long, n_hit long, hit_words array<int>, spans array<struct<start:int,end:int>>, items array<string>"


def normalised(text: str) -> tuple[str, int]:
    """' w1 w2 … ' and the number of words."""
    w = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return (b" " + b" ".join(w) + b" ").decode("utf-8", "surrogatepass") if w else "", len(w)


def windows(text: str | None, size: int) -> list[str]:
    norm, n = normalised(text or "")
    w = norm.split(" ")[1:-1] if n else []
    return [" " + " ".join(w[i : i + size]) + " " for i in range(max(1, n - size + 1))] if n else []


def automaton(items: list[tuple[str, str]], size: int) -> ahocorasick.Automaton:
    patterns: dict[str, set[str]] = {}
    for item, text in items:
        for x in windows(text, size):
            patterns.setdefault(x, set()).add(item)
    a = ahocorasick.Automaton()
    for x, found in patterns.items():
        a.add_word(x, (x.count(" ") - 1, tuple(sorted(found))))
    a.make_automaton()
    return a


def _scan(items_of, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(items_of.value, size)
        live = len(a) > 0
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                norm, n = normalised(text)
                found = [(end, width, items) for end, (width, items) in a.iter(norm)] if live and n else []
                if not found:
                    rows.append((doc, n, 0, [], [], []))
                    continue
                spaces = np.cumsum(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)
                hit = np.zeros(n, dtype=bool)
                items = set()
                for end, width, of in found:
                    last = int(spaces[end]) - 1
                    hit[last - width : last] = True
                    items.update(of)
                at = np.flatnonzero(hit)
                places = [m.span() for m in _WORD.finditer(text)]
                breaks = np.flatnonzero(np.diff(at) > 1) + 1
                spans = [{"start": places[g[0]][0], "end": places[g[-1]][1]} for g in np.split(at, breaks)]
                rows.append((doc, n, len(at), at.tolist(), spans, sorted(items)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_hit", "hit_words", "spans", "items"])

    return run


def find(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, hit_words, spans (character offsets), items.

    Items of a null item_id are left out. An item's windows are all runs of size consecutive words; an item with fewer words, but not none, is one window.
    A document's word inside any occurrence of a window is hit. Null or empty texts have no words and no hits; items
    without words match nothing; other columns are ignored; an empty documents table gives an empty result, an empty
    benchmark no hits. Rows are kept as they are, repeated doc_ids included. Items are broadcast in groups of at most
    max_chars characters of windows (bounded); with more than one group the documents are saved once with a number for each row, and scanned once for each.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    cost = F.length("text").cast("long") * size
    groups = int((items.agg(F.sum(cost)).first()[0] or 0) // max_chars) + 1
    if groups == 1:
        return docs.mapInArrow(_scan(spark.sparkContext.broadcast([tuple(r) for r in items.collect()]), size), HITS)
    docs = saved(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    parts = []
    for g in range(groups):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()]
        keyed = docs.select(F.struct("row", "doc_id").alias("doc_id"), "text")
        parts.append(keyed.select(F.col("doc_id.row").alias("doc_id"), "text").mapInArrow(_scan(spark.sparkContext.broadcast(own), size), HITS))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return docs.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "hit_words", "spans", "items")


def digest(hits: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, a row for each of hits. Without
    items the digest is that of the empty text, and contaminated is false."""
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_hits(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no word is hit, with their columns as they are. doc_id identifies a document here: of rows
    with equal doc_id all go if one is hit; rows with a null doc_id stay only if no row with a null doc_id is hit."""
    bad = find(documents, benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias("_hit_id")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_hit_id"]), "left_anti")
