"""An index of segment vectors that is brought up to date by what changed: rows are appended to a ledger's table, and the last
row of a segment counts. A segment is stale when its text's hash or the model differs, or it isn't there; gone segments get a
row without a vector. Runs go on in passes, each committed at once: a run that dies has done its passes, and the next one goes on
with what is stale then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.ledger import Ledger

_INDEX = "segment_id long, text_hash string, model string, vector array<double>, pass int"
TABLE = "segment_vectors"


def indexed(ledger: Ledger, version: int | None = None) -> DataFrame:
    """segment_id, text_hash, model, vector, pass (which committed pass wrote it): the index as of a version."""
    rows = ledger.read(TABLE, version)
    if rows is None:
        return ledger.spark.createDataFrame([], _INDEX)
    last = rows.groupBy("segment_id").agg(F.max_by(F.struct("text_hash", "model", "vector", "pass"), "pass").alias("x"))
    return last.select("segment_id", "x.*").where("vector is not null")


def stale(segments: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """segment_id, text, text_hash of the segments (segment_id, text) that the index has to take anew, and with a NULL text
    those that it has to lose. Rows of a null id or text aren't segments."""
    own = segments.where("segment_id is not null and text is not null").select("segment_id", "text", F.sha2("text", 256).alias("text_hash"))
    known = index.select("segment_id", F.col("text_hash").alias("_hash"), F.col("model").alias("_model"))
    both = own.join(known, "segment_id", "full")
    return both.where(F.col("text").isNull() | ~F.col("_hash").eqNullSafe(F.col("text_hash")) | ~F.col("_model").eqNullSafe(F.lit(model))).select("segment_id", "text", "text_hash")


def reindex(ledger: Ledger, segments: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, passes: int = 1, seconds: float = 3600.0) -> list[int]:
    """Brings the index up to date, and returns how many rows each pass wrote; a pass takes the stale segments of a share of all hashes. Texts are
    embedded once each, and not at all where the index has a vector of this model for the same text. embed takes (text) and
    returns (text, vector)."""
    token, written = ledger.claim(TABLE, seconds), []
    for number in range(passes):
        index = indexed(ledger)
        todo = stale(segments, index, model).where(F.pmod(F.xxhash64("segment_id"), F.lit(passes)) == number)
        if not todo.take(1):
            continue
        texts = todo.where("text is not null").select("text", "text_hash").distinct()
        have = index.where(F.col("model") == model).groupBy("text_hash").agg(F.first("vector").alias("vector"))
        new = embed(texts.join(have, "text_hash", "left_anti").select("text")).select(F.sha2("text", 256).alias("text_hash"), "vector")
        vectors = texts.select("text_hash").join(have, "text_hash").union(new)
        last = ledger.version()
        rows = todo.join(vectors, "text_hash", "left").select("segment_id", "text_hash", F.lit(model).alias("model"), "vector", F.lit(last + 1).cast("int").alias("pass"))
        version = ledger.commit(TABLE, token, appended={TABLE: rows})
        own = ledger.read(TABLE, version).where(F.col("pass") == last + 1)
        written.append(own.count())
    ledger.release(TABLE, token)
    return written
