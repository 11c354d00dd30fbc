"""Streams with state, taken in two runs, against the same work on whole tables."""

import random
import time
from functools import partial

from pyspark.sql import functions as F

from corpusmill.operators import ingestion
from corpusmill.plans import catalogue, catalogue_assess, catalogue_findings  # noqa: F401  the others add to the first
from corpusmill.sources.tables import probes
from corpusmill.streaming import classified, guard

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


def test_guard_goes_on_from_its_state(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    # All clients as ten, so that bans and counts reach over the cut.
    events = events.withColumn("user_id", F.col("user_id") % 10)
    at = events.select(F.expr("approx_percentile(unix_micros(ts::timestamp), 0.5)")).first()[0]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    got = []
    for name, part in (("a", us <= at), ("b", us > at)):
        events.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        got = guard.guarded(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", 5, 24 * HOUR, 12 * HOUR).collect()
    events.write.parquet(f"{tmp_path}/whole/events.parquet")
    want = catalogue.QUERIES["ban_state"](spark, f"{tmp_path}/whole").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.blocked for r in got} == {True, False}


def _in_files(spark, path, files):
    for name, rows in files:
        spark.createDataFrame(rows, "user_id long, event_id long, s double").selectExpr("user_id", "event_id", "timestamp_micros(cast(s * 1e6 as bigint)) AS ts").coalesce(1).write.parquet(f"{path}/{name}")


def test_guard_counts_in_order_of_time(spark, tmp_path):
    """A file with earlier times than the one before: no window of 600 seconds has more than four attempts."""
    _in_files(spark, f"{tmp_path}/in", [("a", [(1, i, 1000.0 + i) for i in range(3)]), ("b", [(1, 10 + i, 10.0 + i) for i in range(4)])])
    got = guard.guarded(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", 5, 600_000_000, 1_000_000)
    assert {r.event_id: r.blocked for r in got.collect()} == dict.fromkeys([0, 1, 2, 10, 11, 12, 13], False)


def test_guard_over_shuffled_files_in_two_runs(spark, tmp_path):
    """Files out of the order of time within the delay, a null client, idle clients whose state isn't written again."""
    draw, rows = random.Random(5), []
    for e in range(600):
        rows.append((draw.choice((1, 1, 1, 2, 3)), e, e * 7 + draw.random() * 30))
    late = lambda r: r[2] + draw.random() * 400  # noqa: E731  how late each event is read
    rows = [r for _, r in sorted((late(r), r) for r in rows)]
    rows[100] = (None, *rows[100][1:])
    parts = [(f"f{i}", rows[i * 100 : i * 100 + 100]) for i in range(6)]
    parts[0][1].append((77, 9999, 1.0))
    for run in (parts[:3], parts[3:]):
        _in_files(spark, f"{tmp_path}/in", run)
        time.sleep(1.1)  # the order of the files' times is that of their reading
        got = guard.guarded(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", 4, 60_000_000, 90_000_000, delay="20 minutes").collect()
    every = [r for _, part in parts for r in part if r[0] is not None]
    spark.createDataFrame(every, "user_id long, event_id long, s double").selectExpr("user_id", "event_id", "cast(s * 1e6 as bigint) AS us").createOrReplaceTempView("guard_rows")
    want = ingestion.folded(spark.table("guard_rows"), "user_id", ["us", "event_id"], partial(ingestion.Ban, limit=4, window=60_000_000, ban=90_000_000), "user_id long, event_id long, blocked boolean").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.blocked for r in got} == {True, False}
    # The idle client was decided when it came, settled once by its timer, and not written again.
    idle = spark.read.parquet(f"{tmp_path}/out/decisions").where("user_id = 77").collect()
    assert sorted((r.settled, r.turn) for r in idle) == [(False, 0), (True, 1)]


def test_segments_are_classified_once(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = probes(e)
    for name, part in (("a", "vec_id % 3 = 0"), ("b", "vec_id % 3 <> 0")):
        e.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        got = classified.classified(spark, f"{tmp_path}/in/*", p, f"{tmp_path}/out").collect()
    want = catalogue.QUERIES["probe_matches"](spark, SF).collect()
    ids = lambda rows: sorted((r.segment_id, r.variable_id, r.pillar) for r in rows)
    assert ids(got) == ids(want)
