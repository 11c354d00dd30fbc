"""Importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.shared import partitions, saved
from corpusmill.llm.words import LETTERS, chunks, mix, utf8, words

BUCKETS = 1 << 17
#: Labelled rows that mark the target text, at most (a bounded sample by hash of doc_id).
MAX_LABELS = 200_000
KEEP = 0.75
SEED = 7
_Q = np.uint64(0xD6E8FEB86659FD93)


def _features(column) -> Iterator[np.ndarray]:
    """Buckets of the words and word pairs of each text."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        w = words(data, offsets, i, j, LETTERS)
        one = (mix(w.hash) % np.uint64(BUCKETS)).astype(np.int64)
        two = (mix(w.hash[:-1] * _Q + w.hash[1:]) % np.uint64(BUCKETS)).astype(np.int64)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            yield np.concatenate([one[a:b], two[a : max(a, b - 1)]])


def _count(targets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = targets.value
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            at = np.minimum(np.searchsorted(good, ids), max(0, len(good) - 1))
            is_target = good[at] == ids if len(good) else np.zeros(len(ids), bool)
            for f, t in zip(_features(batch.column(1)), is_target, strict=True):
                np.add.at(raw, f, 1)
                if t:
                    np.add.at(target, f, 1)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(target[full])], names=["bucket", "raw", "target"])

    return run


def _score(ratio_of, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = ratio_of.value
        for batch in batches:
            sums, sizes = [], []
            for f in _features(batch.column(1)):
                sums.append(float(ratio[f].sum()))
                sizes.append(len(f))
            ids = batch.column(0).fill_null(-(2**63)).to_numpy().astype(np.int64).view(np.uint64)
            u = ((mix(mix(ids + np.uint64(seed))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            sums = np.array(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(sums - np.log(-np.log(u)))], names=["doc_id", "n_features", "log_ratio", "gumbel_key"])

    return run


def scored(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_ratio, gumbel_key per row of documents. The target model counts the documents labelled of
    quality 1 and not toxic (at most max_labels of them), the raw model all documents; both are smoothed by one."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    ids = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).toArrow().column(0).to_numpy()
    counts = docs.mapInArrow(_count(spark.sparkContext.broadcast(np.sort(ids).astype(np.int64))), "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = rows.column(0).to_numpy()
    raw[at] += rows.column(1).to_numpy()
    target[at] += rows.column(2).to_numpy()
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return docs.mapInArrow(_score(spark.sparkContext.broadcast(ratio), seed), "doc_id long, n_features long, log_ratio double, gumbel_key double")


def resampled(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Every document with its score and whether the Gumbel top-k (k = ceil(keep * N)) selects it.

    Null and empty texts have no features and a log ratio of 0. Without labels of target text every ratio is of the
    smoothed target. Ties of the key go to the smaller doc_id. The noise depends on doc_id and the seed alone, so
    a rerun selects the same; repeated rows get equal keys. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    rows = saved(scored(documents, labels), "importance")
    k = -int(-keep * rows.count() // 1)
    ranged = saved(rows.repartitionByRange(partitions(spark), F.desc("gumbel_key"), F.asc("doc_id")).withColumn("part", F.spark_partition_id()), "importance-ranked")
    before = ranged.groupBy("part").count()
    total = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("part").orderBy(F.desc("gumbel_key"), "doc_id"))
    out = ranged.withColumn("own", own).join(F.broadcast(before.select("part", total.alias("before"))), "part")
    return out.select("doc_id", "n_features", "log_ratio", "gumbel_key", (F.col("before") + F.col("own") <= k).alias("selected"))
