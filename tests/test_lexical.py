"""Lexical ranks against a plain sum over all segments, and which candidates are relevant."""

import math
import random
from collections import Counter

from corpusmill.operators import lexical


def test_ranks_are_those_of_all_segments(spark, monkeypatch):
    """Words of very different frequency; one stands in nearly every segment, so that its postings are cut in parts."""
    monkeypatch.setattr(lexical, "PART_ROWS", 20)
    draw, vocabulary = random.Random(2), [f"w{i}" for i in range(60)]
    segments = [(i, " ".join([*(["the"] if i % 10 else []), *draw.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=draw.randrange(1, 30))])) for i in range(150)] + [(998, None), (999, "")]
    questions = [(i, " ".join(["the", *draw.choices(vocabulary, k=draw.randrange(1, 8))])) for i in range(0, 150, 10)] + [(700, "unknown words"), (701, "the"), (702, None)]
    counts = {i: Counter(t.split()) for i, t in segments if t is not None}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log1p((len(segments) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    index = lexical.postings(spark.createDataFrame(segments, "segment_id long, text string")).cache()
    assert {r.parts for r in index.where("term = 'the'").collect()} == {7} and len({r.part for r in index.where("term = 'the'").collect()}) == 7
    got = {}
    for r in lexical.ranked(spark.createDataFrame(questions, "query_id long, text string"), index, 6).collect():
        got.setdefault(r.query_id, {})[r.lexical_rank] = (r.segment_id, r.value)
    for q, text in questions:
        score = {i: round(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2) for w in set((text or "").split()) if w in c), 9) for i, c in counts.items() if i != q}
        want = sorted(((-v, i) for i, v in score.items() if v > 0))[:6]
        assert {k: i for k, (i, _) in got.get(q, {}).items()} == {k: i for k, (_, i) in enumerate(want, 1)}, q


def test_relevance_and_best_rows(spark):
    rows = [
        (1, 10, 1, 0.30, None, 0.9), (1, 10, 1, 0.30, 2, 0.8), (1, 11, 1, 0.20, 1, 0.7), (1, 12, 1, 0.20, None, 0.99), (1, 13, 1, 0.01, 1, 0.99),
        (1, 14, 1, 0.40, None, 0.6), (1, 15, 1, 0.40, None, 0.5), (1, 16, 2, 0.29, None, None),
    ]
    df = spark.createDataFrame(rows, "query_id int, segment_id int, document_id int, similarity double, lexical_rank int, score double")
    got = lexical.retrieved(df, 0.1).orderBy("rank").collect()
    assert [(r.segment_id, r.score, r.doc_rank) for r in got] == [(10, 0.9, 1), (11, 0.7, 2), (14, 0.6, 3), (15, 0.5, 4), (16, None, 1)]
    assert lexical.retrieved(df.limit(0), 0.1).collect() == []
