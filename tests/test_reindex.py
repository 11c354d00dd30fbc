"""What a re-index writes and embeds, over changes, reruns and a run that dies."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources.ledger import Ledger
from corpusmill.sources.reindex import TABLE, indexed, reindex


def embedder(factor, seen=None):
    def embed(texts):
        if seen is not None:
            seen.extend(r.text for r in texts.collect())
        return texts.select("text", F.array((F.length("text") * factor).cast("double")).alias("vector"))

    return embed


def frame(spark, rows):
    return spark.createDataFrame(rows, "segment_id long, text string")


def content(ledger):
    return {r.segment_id: (r.model, r.vector[0]) for r in indexed(ledger).collect()}


def test_only_stale_rows_are_written(spark, tmp_path):
    ledger, seen = Ledger(spark, f"file://{tmp_path}/l"), []
    first = frame(spark, [(i, "x" * (i % 4 + 1)) for i in range(12)] + [(None, "y"), (50, None)])
    assert reindex(ledger, first, embedder(1, seen), "m1") == [12] and sorted(seen) == ["x", "xx", "xxx", "xxxx"]
    assert reindex(ledger, first, embedder(1, seen), "m1") == [] and len(seen) == 4
    # One text is changed to a known one, one to a new one, one segment is new and one is gone.
    then = frame(spark, [(0, "xx"), (1, "new text"), *[(i, "x" * (i % 4 + 1)) for i in range(2, 11)], (20, "x")])
    assert reindex(ledger, then, embedder(1, seen), "m1") == [4] and seen[4:] == ["new text"]
    assert content(ledger) == {0: ("m1", 2.0), 1: ("m1", 8.0), 20: ("m1", 1.0), **{i: ("m1", float(i % 4 + 1)) for i in range(2, 11)}}
    assert reindex(ledger, then, embedder(1, seen), "m1") == []


def test_another_model_takes_all_anew_and_goes_on(spark, tmp_path):
    """The second pass of a run dies: the next run writes only what that one left."""
    ledger, rows = Ledger(spark, f"file://{tmp_path}/l"), frame(spark, [(i, f"text {i}") for i in range(20)])
    assert sum(reindex(ledger, rows, embedder(1), "m1")) == 20
    calls = []

    def dies(texts):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return embedder(10)(texts)

    with pytest.raises(RuntimeError):
        reindex(ledger, rows, dies, "m2", passes=3, seconds=-1.0)
    done = sum(m == "m2" for m, _ in content(ledger).values())
    assert 0 < done < 20
    assert sum(reindex(ledger, rows, embedder(10), "m2", passes=3)) == 20 - done
    assert content(ledger) == {i: ("m2", 10.0 * len(f"text {i}")) for i in range(20)}
    assert ledger.read(TABLE).count() == 40
