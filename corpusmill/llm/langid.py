"""Language ID by rank-order profiles: a document's most frequent n-grams against those of each language, by
out-of-place distance. N-grams are 1 to 3 lower-cased letters of a word, the space at its ends included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.shared import tidy

TOP = 300
UNKNOWN = "und"
#: Similarity below which the filtering stage rejects a document, besides those without letters.
MIN_SCORE = 0.02
_NONE = 0x1FFFFF
_FLUSH = 2_000_000
_luts: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for what is no letter."""
    if not _luts:
        lut = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                lut[c] = ord(low) if len(low) == 1 else c
        _luts.append(lut)
    return _luts[0]


def _grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, int]:
    """For n = 1, 2, 3 the keys and the bounds of each text; then the code points that keys stand for, and bits a code."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letters()[codes]
    marks = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=marks[1:])
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    keep[marks] = True
    place = np.cumsum(keep) - 1
    marks = place[marks]
    codes = codes[keep]
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    points = np.flatnonzero(seen)
    dense = np.zeros(0x110000, dtype=np.uint32)
    dense[points] = np.arange(len(points), dtype=np.uint32)
    c = dense[codes] if seen[0] else dense[codes] + np.uint32(1)
    points = points if seen[0] else np.concatenate([[0], points])
    bits = 10 if len(points) <= 1024 else 20
    c = c.astype(np.uint32 if bits == 10 else np.uint64)
    b = c.dtype.type(bits)
    out = []
    for n in (1, 2, 3):
        key = c[: len(c) - n + 1].copy()
        for q in range(1, n):
            key = (key << b) | c[q : len(c) - n + 1 + q]
        m = len(key)
        good = c[:m] > 0 if n == 1 else (c[:m] > 0) | (c[1 : m + 1] > 0) if n == 2 else c[1 : m + 1] > 0
        at = np.flatnonzero(good)
        out.append((key[at], np.searchsorted(at, marks)))
    return out, points, bits


def _canonical(key: np.ndarray, n: int, points: np.ndarray, bits: int) -> np.ndarray:
    key = key.astype(np.int64)
    parts = [points[(key >> (bits * (n - 1 - q))) & ((1 << bits) - 1)] for q in range(n)] + [np.full(len(key), _NONE)] * (3 - n)
    return (parts[0] << 42) | (parts[1] << 21) | parts[2]


def _runs(batch_texts: list, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    i = 0
    while i < len(batch_texts):
        j, total = i, 0
        while j < len(batch_texts) and (j == i or total + len(batch_texts[j] or "") <= limit):
            total += len(batch_texts[j] or "")
            j += 1
        yield i, [t or "" for t in batch_texts[i:j]]
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)

    def rows():
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, run in _runs([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                found, points, bits = _grams(run)
                for n, (key, _) in enumerate(found, 1):
                    k, c = np.unique(key, return_counts=True)
                    held.setdefault(lang, []).append((_canonical(k, n, points, bits), c))
                if len(held[lang]) > 60:
                    held[lang] = [merged(held[lang])]
        size = sum(len(k) for parts in held.values() for k, _ in parts)
        if size > _FLUSH:
            yield from rows()
            held = {}
    yield from rows()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def profiles(labelled: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the top most frequent n-grams of each non-null lang, counted over all rows of labelled
    (text, lang). Ties go to the smaller n-gram key. Null texts add nothing; no rows: no profiles."""
    counts = labelled.where("lang is not null and text is not null").select("text", "lang").mapInArrow(tidy(_count), "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", "rank")


def _predict(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, ranks = shared.value  # ranks: gram x language, top where a language lacks the n-gram
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for low, run_texts in _runs(texts):
                found, points, bits = _grams(run_texts)
                keys, places, bounds = [], [], [0]
                for d in range(len(run_texts)):
                    own, counts = [], []
                    for n, (key, at) in enumerate(found, 1):
                        k, c = np.unique(key[at[d] : at[d + 1]], return_counts=True)
                        if len(k) > top:  # only the top of each n can be in the top of all
                            cut = np.argsort(-c, kind="stable")[:top]
                            cut.sort()
                            k, c = k[cut], c[cut]
                        own.append(k.astype(np.int64) | (n << 60))
                        counts.append(c)
                    counts = np.concatenate(counts)
                    order = np.argsort(-counts, kind="stable")[:top]
                    keys.append(np.concatenate(own)[order])
                    places.append(np.arange(1, len(order) + 1))
                    bounds.append(bounds[-1] + len(order))
                keys, places, bounds = np.concatenate(keys), np.concatenate(places), np.array(bounds)
                if not len(keys) or not len(langs):
                    continue
                n_of, real = keys >> 60, np.empty(len(keys), dtype=np.int64)
                for n in (1, 2, 3):
                    real[n_of == n] = _canonical(keys[n_of == n] & ((1 << 60) - 1), n, points, bits)
                at = np.minimum(np.searchsorted(grams, real), len(grams) - 1)
                known = grams[at] == real
                far = np.full((len(keys), len(langs)), top, dtype=np.int64)
                far[known] = np.where(ranks[at[known]] > top, top, np.abs(ranks[at[known]] - places[known][:, None]))
                total = np.zeros((len(keys) + 1, len(langs)), dtype=np.int64)
                np.cumsum(far, axis=0, out=total[1:])
                total = total[bounds[1:]] - total[bounds[:-1]]
                sizes = np.diff(bounds)
                for d in np.flatnonzero(sizes):
                    x = int(np.argmin(total[d]))
                    best[low + d] = langs[x]
                    score[low + d] = max(0.0, 1.0 - total[d, x] / (sizes[d] * top))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(documents: DataFrame, learned: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score) per row of documents, from its text alone.

    score is 1 less the out-of-place distance as a share of the largest possible. A null text, a text without a letter
    and any text when nothing was learned give 'und' and 0. Ties go to the first language in alphabetical order.
    The profiles are broadcast: top rows a language. Repeated rows give repeated results; other columns are ignored.
    """
    rows = learned.collect()
    langs = sorted({r.lang for r in rows})
    grams = np.array(sorted({r.gram for r in rows}), dtype=np.int64)
    ranks = np.full((len(grams), len(langs)), top + 1, dtype=np.int64)
    if rows:
        ranks[np.searchsorted(grams, [r.gram for r in rows]), [langs.index(r.lang) for r in rows]] = [r.rank for r in rows]
    shared = documents.sparkSession.sparkContext.broadcast((langs, grams, ranks))
    return documents.select("doc_id", "text").mapInArrow(tidy(_predict(shared, top)), "doc_id long, lang_pred string, score double")


def learn_and_predict(documents: DataFrame, top: int = TOP) -> DataFrame:
    """Learns from the documents that aren't held out, predicts all: doc_id, held_out, lang_pred, score. A null doc_id
    is in no fold: it is not held out, and is not learned from."""
    learned = profiles(documents.where(~held_out(F.col("doc_id"))), top)
    return predict(documents, learned, top).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def recognised(documents: DataFrame, min_score: float = MIN_SCORE, top: int = TOP) -> DataFrame:
    """The documents whose language is recognised: those with letters, whose best similarity is at least min_score.
    Columns and repeated rows are kept; a document is known by its doc_id (of rows with equal doc_id all go if one does)."""
    found = learn_and_predict(documents, top)
    bad = found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_score)).select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_id"]), "left_anti")
