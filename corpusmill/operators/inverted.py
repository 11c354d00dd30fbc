"""Exact nearest neighbours by an inverted file. Vectors are in the cell of their nearest centroid; a query first searches the
cells nearest to it, and then, with the similarity of its k-th best as the mark, only cells that may hold a better one: by the
triangle inequality no vector of a cell is more similar to q than q.c + |q| r, with the cell's centroid c and radius r.

Cells are cut in blocks by a hash of the id, and so are the queries of a cell, so that a task multiplies one block of
each, however many vectors or queries fall in one cell, and passes on the best of the block alone. The driver sees a bounded
sample, the centroids and a row for each cell; queries are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.products import _matrix
from corpusmill.sources.tables import kept

#: Vectors that a cell has on average, and at most so many cells; rows and queries of a block.
CELL_ROWS, MAX_CELLS, BLOCK = 4096, 4096, 4096
#: The centroids are fitted on at most so many vectors a cell and bytes, in so many rounds.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 32, 64 << 20, 5
#: A query first searches its nearest cells: so many at least, that have so many times k vectors together.
FIRST_CELLS, FIRST_TIMES = 2, 4
#: Two products of the same vectors in different places of a matrix differ by less.
SLACK = 1e-9
PAIRS = "query_id long, segment_id long, document_id long, similarity double"


@dataclass
class Cells:
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row."""
        return np.argmin((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T, axis=1) if len(self.centroids) > 1 else np.zeros(len(x), np.int64)

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query searches first."""
        if len(self.rows) == 1:
            return np.ones((len(q), 1), dtype=bool)
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        enough = (held - self.rows[order] < FIRST_TIMES * k) | (np.arange(len(self.rows)) < FIRST_CELLS)
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, enough, axis=1)
        return out & (self.rows > 0)

    def within(self, q: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Which cells may hold a vector at least as similar as the mark."""
        if len(self.rows) == 1:
            return np.ones((len(q), 1), dtype=bool)
        most = q @ self.centroids.T + np.linalg.norm(q, axis=1)[:, None] * self.radius
        return (most >= mark[:, None] - SLACK) & (self.rows > 0)


def fitted(segments: DataFrame, total: int, cell_rows: int = CELL_ROWS) -> Cells:
    """Centroids by Lloyd's rounds over a sample, then each cell's radius and number of rows over all segments."""
    n = max(1, min(MAX_CELLS, total // cell_rows))
    if n == 1:  # every query searches the one cell
        return Cells(np.zeros((1, 0)), np.array([np.inf]), np.array([total]))
    wanted = SAMPLE_ROWS * n
    rows = segments.where(F.pmod(F.xxhash64("segment_id"), F.lit(max(1, total // (2 * wanted)))) == 0)
    size = len(rows.select("vector").first()[0])
    x = _matrix(rows.select("vector").limit(max(n, min(wanted, SAMPLE_BYTES // (8 * size)))).toArrow().column(0))
    centroids = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        at = Cells(centroids, np.zeros(n), np.zeros(n)).of(x)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=n)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    cells = Cells(centroids, np.zeros(n), np.zeros(n, np.int64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            at = cells.of(x)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.linalg.norm(x - cells.centroids[at], axis=1))], names=["cell", "far"])

    stats = segments.select("vector").mapInArrow(measured, "cell long, far double").groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).toArrow()
    where = stats["cell"].to_numpy()
    cells.radius[where], cells.rows[where] = stats["far"].to_numpy(), stats["n"].to_numpy()
    return cells


def _dealt(rows: DataFrame, key: str, others: list[str], choose, own: np.ndarray, other: np.ndarray, first: str, second: str) -> DataFrame:
    """rows repeated for each of their cells and each block of the other side there: cell, own block, other block. choose(matrix,
    batch) gives the cells as a boolean matrix; own and other are the numbers of blocks of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                at, cell = np.nonzero(choose(_matrix(part.column(1)), part) & (other > 0) & (own > 0))
                at, cell = np.repeat(at, other[cell]), np.repeat(cell, other[cell])
                if not len(at):
                    continue
                new = np.r_[True, (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])]
                start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                hashes = part.column(2).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.mod(hashes, own[cell])), pa.array(np.arange(len(at)) - start), *[part.column(i).take(pa.array(at)) for i in (0, 1, *range(3, part.num_columns))]], names=["cell", first, second, key, "vector", *others])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"cell long, {first} long, {second} long, {key} long, vector array<double>" + "".join(f", {c} {kinds[c]}" for c in others)
    return rows.select(F.col(key).cast("long").alias(key), "vector", F.xxhash64(key).alias("hash"), *others).mapInArrow(run, schema)


def _best(own: np.ndarray, doc: np.ndarray, x: np.ndarray, k: int, per_document: int | None) -> np.ndarray:
    """Places of the k best by similarity x, ties by id, and with per_document also of the k best when each document has so
    many at most."""
    order = np.lexsort((own, -x))
    out = order[:k]
    if per_document is not None:
        by_doc = order[np.argsort(doc[order], kind="stable")]
        d = doc[by_doc]
        start = np.maximum.accumulate(np.where(np.r_[True, d[1:] != d[:-1]], np.arange(len(d)), 0))
        few = np.zeros(len(x), dtype=bool)
        few[by_doc] = np.arange(len(d)) - start < per_document
        out = np.union1d(out, order[few[order]][:k])
    return out


def _above(queries: pa.Table, segments: pa.Table) -> pa.Table:
    """How many segments of the block come before each wanted one: more similar, or as similar with a smaller id."""
    ids, own = queries.column("query_id").to_numpy(), segments.column("segment_id").to_numpy()
    q, s = _matrix(queries.column("vector")), _matrix(segments.column("vector"))
    out: list[tuple[int, int, int]] = []
    for a in range(0, len(ids), 256):
        every = q[a : a + 256] @ s.T if len(s) else np.zeros((len(ids[a : a + 256]), 0))
        for i, x in enumerate(every):
            for wanted, value in zip(queries.column("ids")[a + i].as_py(), queries.column("values")[a + i].as_py(), strict=True):
                close = np.flatnonzero((np.abs(x - value) <= SLACK) & (own != ids[a + i]))
                exact = np.einsum("ij,j->i", s[close], q[a + i], optimize=False)
                n = int(((x > value + SLACK) & (own != ids[a + i])).sum() + ((exact > value) | (exact == value) & (own[close] < wanted)).sum())
                out.append((int(ids[a + i]), wanted, n))
    return pa.table({name: pa.array([r[k] for r in out], pa.int64()) for k, name in enumerate(("query_id", "segment_id", "above"))})


def _multiplied(k: int, per_document: int | None):
    def run(queries: pa.Table, segments: pa.Table) -> pa.Table:
        ids, own, doc = (t.column(c).to_numpy() for t, c in ((queries, "query_id"), (segments, "segment_id"), (segments, "document_id")))
        q, s = _matrix(queries.column("vector")), _matrix(segments.column("vector"))
        rows: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(ids), 256):
            every = q[a : a + 256] @ s.T if len(s) else np.zeros((len(ids[a : a + 256]), 0))
            for i, x in enumerate(every):
                at = np.flatnonzero(own != ids[a + i])
                # With a limit a document the k-th best alone doesn't tell who may be among the best.
                if per_document is None and len(at) > k:
                    at = at[x[at] >= np.partition(x[at], -k)[-k] - SLACK]
                exact = np.einsum("ij,j->i", s[at], q[a + i], optimize=False)
                at, exact = (v[_best(own[at], doc[at], exact, k, per_document)] for v in (at, exact))
                rows.append((np.full(len(at), ids[a + i]), own[at], doc[at], exact))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "segment_id", "document_id", "similarity"), columns, strict=True)))

    return run


class Inverted:
    """An inverted file over segments (segment_id, document_id, vector). Vectors are of one length and any norm; null vectors
    and ids are left out."""

    def __init__(self, segments: DataFrame, cell_rows: int = CELL_ROWS, block: int = BLOCK):
        self.segments = segments.where("vector is not null and segment_id is not null").select("segment_id", F.col("document_id").cast("long").alias("document_id"), F.col("vector").cast("array<double>").alias("vector"))
        self.block, total = block, self.segments.count()
        self.cells = fitted(self.segments, total, cell_rows) if total else None

    def _searched(self, queries: DataFrame, choose, others: list[str], work, schema: str) -> DataFrame:
        cells, block = self.cells, self.block

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(cells.rows), np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    part = batch.slice(a, 1000)
                    total += choose(_matrix(part.column(1)), part).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["cell", "n"])

        of_queries, of_rows = np.zeros(len(cells.rows), np.int64), -(-cells.rows // block)
        if len(cells.rows) == 1:
            of_queries[0] = -(-queries.count() // block)
        else:
            asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector", F.xxhash64("query_id").alias("hash"), *others)
            found = asked.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
            of_queries[found["cell"].to_numpy()] = -(-found["n"].to_numpy() // block)
        own = lambda x, _: np.arange(len(cells.rows)) == cells.of(x)[:, None]
        left = _dealt(queries, "query_id", others, choose, of_queries, of_rows, "qb", "sb")
        right = _dealt(self.segments, "segment_id", ["document_id"], own, of_rows, of_queries, "sb", "qb")
        keys = ["cell", "sb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)

    def nearest(self, queries: DataFrame, k: int, per_document: int | None = None) -> DataFrame:
        """PAIRS: a superset of the k most similar segments of each query (query_id, vector), itself excluded, ties by segment
        id; with per_document also of the k that remain when each document keeps its so many best. Exact. Without
        segments or queries there are no pairs."""
        queries = queries.where("vector is not null and query_id is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        cells = self.cells
        if cells is None:
            return queries.sparkSession.createDataFrame([], PAIRS)
        near = self._searched(queries, lambda x, _: cells.first(x, k), [], _multiplied(k, per_document), PAIRS)
        if len(cells.rows) == 1:
            return near
        near = kept(near, "near")
        few, by_value = near, (F.desc("similarity"), F.col("segment_id"))
        if per_document is not None:
            few = few.withColumn("r", F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(*by_value))).where(F.col("r") <= per_document)
        best = few.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(*by_value))).where(F.col("r") <= k).where(F.col("r") == k)
        marked = queries.join(best.select("query_id", F.col("similarity").alias("mark")), "query_id", "left").withColumn("mark", F.coalesce("mark", F.lit(float("-inf"))))

        def rest(x: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            return cells.within(x, part.column(3).to_numpy()) & ~cells.first(x, k)

        return near.union(self._searched(marked, rest, ["mark"], _multiplied(k, per_document), PAIRS))

    def ranks(self, queries: DataFrame, wanted: DataFrame) -> DataFrame:
        """query_id, segment_id, rank (from 1) of wanted (query_id, segment_id, similarity, as nearest gives it; few a query)
        among all segments of their query: only cells that may hold a better one are searched, and blocks give counts."""
        cells = self.cells
        lists = wanted.groupBy("query_id").agg(F.min("similarity").alias("mark"), F.sort_array(F.collect_list(F.struct("segment_id", "similarity"))).alias("w"))
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).join(lists, "query_id").select("query_id", "vector", "mark", F.col("w.segment_id").alias("ids"), F.col("w.similarity").alias("values"))
        if cells is None:
            return asked.select("query_id", F.explode("ids").alias("segment_id"), F.lit(1).cast("long").alias("rank"))
        above = self._searched(asked, lambda x, part: cells.within(x, part.column(3).to_numpy()), ["mark", "ids", "values"], _above, "query_id long, segment_id long, above long")
        return above.groupBy("query_id", "segment_id").agg((F.sum("above") + 1).alias("rank"))
