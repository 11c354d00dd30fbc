"""Diversified top-k where few documents hold the nearest segments."""

import math

import pytest

from corpusmill.plans import catalogue


def test_diversified_beyond_the_nearest(spark, tmp_path):
    """Documents 1 and 2 hold the 60 nearest segments: two places go to others, by rank."""
    ids = [50 * k + d for k in range(1, 31) for d in (1, 2)] + [3, 4, 5, 6]
    rows = [(0, [1.0, 0.0])] + [(v, [math.cos(0.01 * (n + 1)), math.sin(0.01 * (n + 1))]) for n, v in enumerate(ids) if v % 25]
    spark.createDataFrame([(v, e, 0) for v, e in rows], "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.diversified_topk(spark, str(tmp_path)).where("query_id = 0").collect()
    assert sorted(r.document_id for r in got) == [1, 1, 1, 2, 2, 2, 3, 4]


def test_hybrid_takes_what_is_far_down_in_both_rankings(spark):
    import random

    from corpusmill.operators.retrieval import hybrid

    draw = random.Random(3)
    n, lists = 400, []
    for common in range(2):
        # The first 20 of each list are its own; those that follow are ranked in both.
        order = [f for f in range(common * 20, common * 20 + 20)] + [40 + i for i in range(n - 40)]
        tail = order[30:]
        draw.shuffle(tail)
        lists.append(order[:30] + tail)
    frames = [spark.createDataFrame([(q, s, float(n - i - i % 2)) for q in (1, 2) for i, s in enumerate(ids)], "query_id long, segment_id long, value double") for ids in lists]
    want = []
    for q in (1, 2):
        score = {}
        for ids in lists:
            ranked = sorted(((n - i - i % 2, -s) for i, s in enumerate(ids)), reverse=True)
            for r, (_, s) in enumerate(ranked, 1):
                score[-s] = score.get(-s, 0) + 1 / (60 + r)
        best = sorted(score, key=lambda s: (-round(score[s], 9), s))[:8]
        assert any(40 <= s < 50 for s in best)  # beyond place 20 of both
        want += [(q, s, place) for place, s in enumerate(best, 1)]
    got = hybrid(*frames)
    assert sorted((r.query_id, r.segment_id, r.place) for r in got.collect()) == want


def vectors(n, size, seed, shapes):
    """Vectors around some centres, of different lengths, a third of them copies of one."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(shapes, size))
    x = centres[rng.integers(shapes, size=n)] + rng.normal(scale=0.1, size=(n, size))
    x[rng.random(n) < 0.33] = centres[0]
    return x * rng.choice([0.5, 1.0, 2.0], size=(n, 1)), rng.integers(7, size=n)


@pytest.mark.parametrize(("n", "cell_rows", "block"), [(600, 40, 16), (600, 10_000, 50), (50, 5, 1000)])
def test_inverted_file_is_exact(spark, n, cell_rows, block):
    import numpy as np

    from corpusmill.operators.inverted import Inverted

    x, doc = vectors(n, 6, n, 12)
    rows = [(i, int(d), v.tolist()) for i, (v, d) in enumerate(zip(x, doc, strict=True))]
    segments = spark.createDataFrame([*rows, (None, 1, [0.0] * 6), (n + 5, 2, None)], "segment_id long, document_id long, vector array<double>").repartition(3)
    queries = segments.where("segment_id % 5 = 0").selectExpr("segment_id AS query_id", "vector")
    index = Inverted(segments, cell_rows=cell_rows, block=block)
    assert len(index.cells.rows) == max(1, (n + 1) // cell_rows) and index.cells.rows.sum() == n
    got, capped = {}, {}
    for per, out in ((None, got), (2, capped)):
        for r in index.nearest(queries, 8, per).collect():
            out.setdefault(r.query_id, set()).add((r.similarity, r.segment_id, r.document_id))
    wanted = []
    for q in range(0, n, 5):
        value = np.einsum("ij,j->i", x, x[q], optimize=False)
        order = [int(i) for i in np.lexsort((np.arange(n), -value)) if i != q]
        assert [s for _, s, _ in sorted(got[q], key=lambda r: (-r[0], r[1]))[:8]] == order[:8]
        few = [i for k, i in enumerate(order) if sum(doc[j] == doc[i] for j in order[:k]) < 2]
        assert {s for _, s, _ in capped[q]} >= {*few[:8], *order[:8]}
        wanted += [(q, i, float(value[i]), order.index(i) + 1) for i in (*order[5:9], order[-1])]
    frame = spark.createDataFrame([w[:3] for w in wanted], "query_id long, segment_id long, similarity double")
    assert {(r.query_id, r.segment_id): r.rank for r in index.ranks(queries, frame).collect()} == {(q, s): r for q, s, _, r in wanted}


def test_cells_beyond_the_mark_are_not_searched(spark):
    import numpy as np

    from corpusmill.operators.inverted import Cells

    cells = Cells(np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), np.array([0.1, 0.1, 0.1]), np.array([5, 5, 5]))
    assert cells.within(np.array([[1.0, 0.0]]), np.array([0.5])).tolist() == [[True, False, False]]
    assert cells.within(np.array([[1.0, 0.0]]), np.array([-np.inf])).all()


def test_ranks_of_chosen_segments_count_deferred_ones(spark):
    """Document 1 holds the twenty nearest: the first of another has rank 21."""
    import math

    from corpusmill.operators.retrieval import diversified_nearest

    rows = [(i, 1 if i < 20 else i, [math.cos(0.01 * (i + 1)), math.sin(0.01 * (i + 1))]) for i in range(40)]
    s = spark.createDataFrame(rows, "segment_id long, document_id long, vector array<double>")
    q = spark.createDataFrame([(99, [1.0, 0.0])], "query_id long, vector array<double>")
    for cell_rows in (1000, 4):
        got = diversified_nearest(q, s, cell_rows=cell_rows).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2, 3, 21, 22, 23, 24, 25]


def test_nothing_to_search(spark):
    from corpusmill.operators.retrieval import diversified_nearest, nearest

    s = spark.createDataFrame([], "segment_id long, document_id long, vector array<double>")
    one = spark.createDataFrame([(1, 1, [1.0])], s.schema)
    q, none = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), spark.createDataFrame([], "query_id long, vector array<double>")
    for a, b in ((q, s), (none, one), (none, s), (q, one)):
        assert nearest(a, b, 3).collect() == [] and diversified_nearest(a, b).collect() == []
