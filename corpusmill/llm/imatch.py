"""Document fingerprints by I-Match: terms within a band of inverse document frequency, sorted and distinct, hashed for
several randomised subsets of the lexicon.

The lexicon is the set of terms whose document frequency lies between a share LOW and a share HIGH of all documents, so
that it has at most (mean number of distinct terms of a document) / LOW terms whatever the number of documents.
Subsets differ in how much of the lexicon they keep (halves down to 1/1024), so that short and long documents both have
subsets that an edit leaves alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import partitions
from corpusmill.llm.words import SPACED, as_long, chunks, mix, utf8, words

LOW, HIGH = 1e-3, 0.1
#: A document with fewer terms in the band is hashed over all its terms: few terms would be those of other texts too.
FEWEST = 5
#: Characters of texts that one bucket of edits has, about.
BUCKET_CHARS = 32_000_000
RATES, PER_RATE = 10, 4
_EMPTY = "00000000"
#: Subset s of rate r keeps the terms whose hash, mixed with the subset's number, begins with r zero bits.
_SUBSETS = np.array([0xA5A5A5A5 * n + 1 for n in range(PER_RATE, (RATES + 1) * PER_RATE)], dtype=np.uint64)
_SHIFTS = np.repeat(np.arange(63, 63 - RATES, -1), PER_RATE).astype(np.uint64)


def _terms(column) -> Iterator[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        w = words(data, offsets, i, j, SPACED)
        h = mix(w.hash)
        for d in range(j - i):
            yield np.unique(h[w.first[d] : w.first[d + 1]])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        k, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(as_long(k)), pa.array(c)], names=["term", "n"])

    for batch in batches:
        for t in _terms(batch.column(0)):
            held.append(t)
            size += len(t)
            if size > 8_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def lexicon(documents: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted term hashes with low * N <= document frequency <= high * N, and at least 2, over all N documents."""
    n = documents.count()
    df = documents.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = df.where((F.col("n") >= max(2.0, low * n)) & (F.col("n") <= max(2.0, high * n))).select("term").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def fingerprint(terms: np.ndarray, lex: np.ndarray) -> str:
    """Eight hex digits a subset; zeros where no term of the document is in the subset."""
    if len(lex) and len(terms):
        at = np.minimum(np.searchsorted(lex, terms), len(lex) - 1)
        banded = terms[lex[at] == terms]
        terms = banded if len(banded) >= FEWEST else terms
    out = []
    for chosen in (mix(terms[None, :] ^ _SUBSETS[:, None]) >> _SHIFTS[:, None]) == 0:
        own = terms[chosen]
        out.append(hashlib.blake2b(own.tobytes(), digest_size=4).hexdigest() if len(own) else _EMPTY)
    return "".join(out)


def likeness(a: str, b: str) -> float:
    """Share of the subsets, of those that are not empty in both, whose hashes agree; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    full = [(x, y) for x, y in pairs if x != _EMPTY or y != _EMPTY]
    return sum(x == y for x, y in full) / len(full) if full else 0.0


def _prepare(lex_of, firsts_of):
    """(bucket, extra, doc_id, n_chars, text, fingerprint): the texts compressed, each once in its own bucket; the first of a
    bucket also, as extra, in the bucket before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, firsts = lex_of.value, firsts_of.value
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for doc, text, terms in zip(ids, texts, _terms(batch.column(1)), strict=True):
                text = text or ""
                place = -(2**63) if doc is None else doc
                b = max(0, int(np.searchsorted(firsts, place, "right")) - 1)
                row = (doc, len(text), press.compress(text.encode("utf-8", "surrogatepass")), fingerprint(terms, lex))
                rows.append((b, 0, *row))
                if firsts[b] == place:
                    rows.append(((b - 1) % len(firsts), 1, *row))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "extra", "doc_id", "n_chars", "body", "fingerprint"])

    return run


def _edit(lex_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, open_ = lex_of.value, zstandard.ZstdDecompressor()
        last = None
        done: list[tuple] = []

        def close(row, after):
            doc, text, own = row
            k = len(text) // 4
            text = text[: len(text) - k] + after[1][:k]
            other = fingerprint(next(_terms(pa.array([text], pa.string())), np.zeros(0, np.uint64)), lex)
            sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            done.append((doc, len(row[1]), sha, own, other, likeness(own, other), likeness(own, after[2])))

        def flush():
            cols = list(zip(*done, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for bucket, extra, doc, _, body, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (doc, open_.decompress(body).decode("utf-8", "surrogatepass") if body else "", own)
                if last and last[0] == bucket and last[1] == 0:
                    close(last[2], row)
                last = (bucket, extra, row)
                if len(done) >= 2000:
                    yield flush()
        yield flush()

    return run


def fingerprints(documents: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of documents.

    The edited text has the last quarter of the code points replaced by the first as many of the next document
    (ascending doc_id, after the last the first; rows of equal doc_id in an order of their text's length and bytes; null
    doc_ids come first). A null text is empty. A lone document is its own next. Other columns are ignored.
    A text with fewer than FEWEST terms in the band (short ones, mostly) is hashed over all its terms, with the same subsets.
    A text without terms has zeros for all subsets; two of them have a likeness of 1. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    lex = spark.sparkContext.broadcast(lexicon(docs, low, high))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, 3 * partitions(spark), chars // BUCKET_CHARS)
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.001) if n > 1 else []
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))
    bounds = F.array(*[F.lit(int(c)) for c in sorted({int(c) for c in cuts})]) if cuts else F.array().cast("array<bigint>")
    firsts = ids.groupBy(F.size(F.filter(bounds, lambda x: x <= F.col("doc_id")))).agg(F.min("doc_id").alias("first")).collect()
    firsts = np.array(sorted(r["first"] for r in firsts) or [0], dtype=np.int64)
    kept = docs.mapInArrow(_prepare(lex, spark.sparkContext.broadcast(firsts)), "bucket long, extra int, doc_id long, n_chars long, body binary, fingerprint string")
    order = kept.repartition(-(-n // 3), "bucket").withColumn("turn", F.when((F.col("bucket") == len(firsts) - 1) | (F.col("extra") == 0), F.col("extra")).otherwise(1))
    order = order.sortWithinPartitions("bucket", "turn", F.col("doc_id").asc_nulls_first(), "n_chars", "body")
    return order.select("bucket", "extra", "doc_id", "n_chars", "body", "fingerprint").mapInArrow(
        _edit(lex), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
