import random

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.operators import ingestion
from corpusmill.plans import catalogue, catalogue_assess  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_batches_close_at_caps(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([100, 350, 10, 10, 500, 1])], "conv_id long, pos long, tokens int")
    got = ingestion.folded(rows, "conv_id", ["pos"], lambda k: ingestion.Batches(k, 3, 400), "conv_id long, turn long, batch int").orderBy("turn").collect()
    assert [r.batch for r in got] == [0, 1, 1, 1, 2, 3]


def test_bans_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = sorted((k, rng.randrange(1000), i) for i, k in enumerate([1, 2] * 60))
    df = spark.createDataFrame([(k, e, t) for k, t, e in rows], "user_id long, event_id long, us long")
    got = ingestion.folded(df, "user_id", ["us", "event_id"], lambda k: ingestion.Ban(k, 3, 50, 80), "user_id long, event_id long, blocked boolean").collect()
    want, until, seen = {}, {}, {}
    for k, t, e in rows:
        if t < until.get(k, -1):
            want[e] = True
            continue
        seen[k] = [x for x in seen.get(k, []) if x > t - 50] + [t]
        want[e] = len(seen[k]) > 3
        if want[e]:
            until[k], seen[k] = t + 80, []
    assert {r.event_id: r.blocked for r in got} == want and any(want.values())


def test_headings(spark):
    lines = ["3.1 Activities", "RESULTS AND IMPACT", "A plain sentence.", "THE END.", "Annexe A : budget", "", "1. Introduction."]
    got = spark.createDataFrame(pd.DataFrame({"i": range(len(lines)), "x": lines})).orderBy("i").select(ingestion.is_heading(F.col("x"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, True, False, True]


def test_majority_and_samples(spark):
    votes = spark.createDataFrame([(1, "fr", 2), (1, "en", 1), (1, "en", 4), (1, "fr", 3), (1, None, 0)], "k long, v string, pos long")
    assert [tuple(r) for r in ingestion.majority(votes, "k", "v", "pos").collect()] == [(1, "en", 0.5)]
    n = spark.createDataFrame([(3,), (10,), (2,)], "n long")
    assert [r[0] for r in n.select(ingestion.sample_positions(F.col("n"), 4)).collect()] == [[0, 1, 2], [0, 3, 6, 9], [0, 1]]
