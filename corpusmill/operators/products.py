"""Inner products of many vectors with few, as matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many of the few vectors are broadcast at once; more are taken in several passes.
MOST = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def products(segments: DataFrame, few: DataFrame, name: str, least: float | None = None, k: int | None = None, most: int = MOST) -> DataFrame:
    """segment_id, document_id, name, similarity of segments (segment_id, document_id, vector) with few (column name, vector),
    without pairs of equal ids: those of at least least, or a superset of the k best of each of few, or all pairs.

    few is a stated set: it is broadcast in passes of about most rows, each a scan of segments. Vectors have one length.
    """
    schema = f"segment_id long, document_id long, {name} long, similarity double"
    few = few.select(F.col(name).cast("long"), "vector")
    spark, total = segments.sparkSession, few.count()
    passes = -(-total // most)
    out = []
    for p in range(passes):
        rows = few.where(F.pmod(F.xxhash64(name), F.lit(passes)) == p).toArrow()
        out.append(segments.select(F.col("segment_id").cast("long"), F.col("document_id").cast("long"), "vector").mapInArrow(_multiply(spark.sparkContext.broadcast((rows.column(0).to_numpy(), _matrix(rows.column(1)))), name, least, k), schema))
    if not out:
        return spark.createDataFrame([], schema)
    both = out[0]
    for x in out[1:]:
        both = both.union(x)
    return both


def _multiply(shared, name: str, least: float | None, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, few = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(own), 1000):
                x = _matrix(batch.column(2).slice(a, 1000)) @ few.T
                keep = own[a : a + 1000, None] != ids[None, :]
                if least is not None:
                    keep &= x >= least
                if k is not None and len(x) > k:
                    # The k-th best of each column, itself possibly of an equal id, so that one more is kept.
                    keep &= x >= np.partition(x, -min(len(x), k + 1), axis=0)[-min(len(x), k + 1)]
                at, of = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(own[a + at]), pa.array(doc[a + at]), pa.array(ids[of]), pa.array(x[at, of])], names=["segment_id", "document_id", name, "similarity"])

    return run
