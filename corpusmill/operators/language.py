"""The language of texts by letters in a row: a smoothed model of n-grams, and the decision on a text's head, on a vote of its windows where the
head is not clear, or on the head's first guess. N-grams are numbers that are counted where the text is read: the model's counts and
the decisions alone leave a task, neither n-grams nor texts are shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions.numbers import rounded
from corpusmill.functions.text import _decomposed
from corpusmill.operators.quotes import SPACES
from corpusmill.sources.tables import kept

#: Letters of an n-gram; characters of the head and of a window; the least of a sample, and the most windows.
GRAM, HEAD, WINDOW, LEAST, MOST_WINDOWS = 3, 10_000, 5_000, 20, 20
CLEAR = 0.7
#: What a normalised text is made of, the space first, and characters that are counted at once.
LETTERS, CHARACTERS = " abcdefghijklmnopqrstuvwxyz0123456789", 4_000_000
_END, _SEVERAL, _GONE, _TOP = len(LETTERS), -2, -1, 0x20000


@cache
def _numbers() -> tuple[np.ndarray, dict[int, str]]:
    """The number of what each character is normalised to (see functions.text.normalised), and those that leave several characters."""
    one, to, several = _decomposed(False)
    out = np.full(_TOP + 2, _GONE, np.int8)
    number = lambda c: max(0, LETTERS.find(c.lower()))
    out[:0x80] = [number(chr(c)) for c in range(0x80)]
    out[[ord(c) for c in one]] = [number(c) for c in to]
    out[[ord(c) for c in several]] = _SEVERAL
    out[_TOP + 1] = _END
    return out, {ord(c): x for c, x in several.items()}


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of normalised texts, a space at their ends included, as numbers, and the place of the text of each."""
    table, several = _numbers()
    end = np.array([_TOP + 1], np.uint32)
    coded = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = [end]
    for t in texts:
        x = table[np.minimum(coded(t), _TOP)] if not t.isascii() else None
        parts += [coded(t.translate(several) if x is not None and (x == _SEVERAL).any() else t), end]
    every = np.concatenate(parts)
    beyond = every > _TOP + 1
    x = table[np.where(beyond, np.uint32(_TOP), every) if beyond.any() else every]
    x = x[x != _GONE]
    # Spaces in a row are one, and none stands at the ends, which are a space themselves.
    space, end = x == 0, x == _END
    x = x[~(space & np.r_[True, (space | end)[:-1]])]
    space, end = x == 0, x == _END
    x = x[~(space & np.r_[end[1:], True])]
    end = x == _END
    inner, no = ~end[1:-1], np.cumsum(end)[1:-1] - 1
    x = np.where(end, np.int8(0), x).astype(np.int32)
    gram = sum(x[k : len(x) - GRAM + 1 + k] * len(LETTERS) ** (GRAM - 1 - k) for k in range(GRAM))
    return gram[inner].astype(np.int64), no[inner]


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Runs of texts of so many characters together."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHARACTERS:
            yield slice(a, i)
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield slice(a, len(sizes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n of the batches (lang, text) of a task."""
    kinds, total = len(LETTERS) ** GRAM, {}

    def found() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            at = np.flatnonzero(n)
            names = ["".join(LETTERS[g // len(LETTERS) ** k % len(LETTERS)] for k in reversed(range(GRAM))) for g in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(names, pa.string()), pa.array(n[at])], names=["lang", "gram", "n"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in _slices([len(t) for t in texts]):
            gram, no = grams(texts[part])
            own, at = np.unique(np.array(langs[part], object), return_inverse=True)
            for i, lang in enumerate(own):
                if lang not in total and len(total) >= 100:  # so many languages are held at once
                    yield from found()
                    total.clear()
                total[lang] = total.get(lang, 0) + np.bincount(gram[at[no] == i], minlength=kinds)
    yield from found()


def model(texts: DataFrame) -> DataFrame:
    """gram, weights (lang to the logarithm of the n-gram's probability) of texts (lang, text): counts plus one. Grams are few,
    bounded by the letters. Null languages and texts teach nothing."""
    counts = texts.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kinds = counts.select("gram").distinct()
    every = kinds.join(langs, how="cross").join(counts, ["lang", "gram"], "left")
    distinct = F.count("*").over(W.partitionBy("lang"))
    weight = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + distinct))
    return every.select("gram", "lang", weight.alias("w")).groupBy("gram").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "w")))).alias("weights"))


def _decided(shared, clear: float, id_type: pa.DataType):
    """doc_id, lang, confidence, a row for each text, of the batches (doc_id, texts)."""

    def guesses(samples: list[list[str]]) -> list[tuple[str, float] | None]:
        """The likeliest language of each sample (parts of at least LEAST characters count) and its probability, all languages as likely before. N-grams that
        the model doesn't know say nothing; a sample without known ones has no guess."""
        langs, weights, known = shared.value
        parts = [(i, t) for i, sample in enumerate(samples) for t in sample if len(t.strip(SPACES)) >= LEAST]
        sums, some = np.zeros((len(samples), len(langs))), np.zeros(len(samples))
        for part in _slices([len(t) for _, t in parts]):
            gram, no = grams([t for _, t in parts[part]])
            at = np.array([i for i, _ in parts[part]])[no]
            if not len(at):
                continue
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            some[at[start]] += np.add.reduceat(known[gram], start)
            for j in range(len(langs)):
                sums[at[start], j] += np.add.reduceat(weights[j][gram], start)
        if not len(langs):
            return [None] * len(samples)
        best = len(langs) - 1 - np.argmax(sums[:, ::-1], axis=1)  # of equals the last
        prob = 1 / np.exp(sums - sums.max(axis=1)[:, None]).sum(axis=1)
        return [(langs[j], p) if n else None for j, p, n in zip(best.tolist(), prob.tolist(), some.tolist(), strict=True)]

    def voted(texts: list[str]) -> tuple[str, float] | None:
        windows: dict[int, list[str]] = {}
        for t in texts:
            n = -(-len(t) // WINDOW)
            for i in range(min(n, MOST_WINDOWS)):
                a = WINDOW * (i if n <= MOST_WINDOWS else i * n // MOST_WINDOWS)
                windows.setdefault(i, []).append(t[a : a + WINDOW])
        votes = [g[0] for g in guesses([windows[i] for i in sorted(windows)]) if g]
        if not votes:
            return None
        lang = max(dict.fromkeys(votes), key=votes.count)  # of equals the one met first
        return lang, votes.count(lang) / len(votes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [[t for t in own if t is not None] if i is not None else [] for i, own in zip(ids, texts, strict=True)]
            out = []
            for own, head in zip(rows, guesses([[t[:HEAD] for t in own] for own in rows]), strict=True):
                out.append(head if head and head[1] >= clear else (voted(own) if own else None) or head or (None, 0.0))
            at = [i for i, own in enumerate(texts) for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], id_type), pa.array([out[i][0] for i in at], pa.string()), pa.array([out[i][1] for i in at], pa.float64())], names=["doc_id", "lang", "confidence"])

    return run


def decided(texts: DataFrame, model_: DataFrame, clear: float = CLEAR) -> DataFrame:
    """doc_id, lang, confidence of each text (doc_id, text): the guess on its head if that is clear; else the majority of the guesses on windows spread
    over it, with its share; else the head's guess; else NULL and 0. Confidences have 4 digits. Texts of one doc_id are decided together."""
    learnt = model_.select("gram", F.explode("weights").alias("lang", "w")).toArrow()
    langs, at = np.unique(np.array(learnt["lang"].to_pylist(), object), return_inverse=True)
    gram = np.array([sum(LETTERS.index(c) * len(LETTERS) ** (GRAM - 1 - k) for k, c in enumerate(g)) for g in learnt["gram"].to_pylist()], np.int64)
    weights, known = np.zeros((len(langs), len(LETTERS) ** GRAM)), np.zeros(len(LETTERS) ** GRAM)
    weights[at, gram], known[gram] = learnt["w"].to_numpy(), 1
    shared = texts.sparkSession.sparkContext.broadcast((langs.tolist(), weights, known))
    each = texts.select("doc_id", F.array("text").alias("texts"))
    repeated = kept(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.take(1):
        together = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("text")).alias("t"))
        each = texts.join(repeated, "doc_id", "left_anti").select("doc_id", F.array("text").alias("texts")).union(together.select("doc_id", F.col("t.text").alias("texts")))
    kind = texts.schema["doc_id"].dataType
    out = each.mapInArrow(_decided(shared, clear, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, lang string, confidence double")
    return out.withColumn("confidence", rounded(F.col("confidence"), 4))
