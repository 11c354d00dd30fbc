"""Rankings for stated questions against plain ones: equal vectors and counts, repeated rows, blocks, passes, and what is shuffled."""

import random
import re
from dataclasses import replace

import numpy as np
from test_lexical_blocks import written

from corpusmill.operators import stated
from corpusmill.rules import DEFAULT

RULES = replace(DEFAULT, rrf_k=3, top_k=4)


def plain(vectors, texts, questions):
    words = lambda t: set(re.findall("[a-z]+", (t or "").lower()))
    of, asked = {}, {}
    for i, t in texts:
        of[i] = of.get(i, set()) | words(t)
    for i, t in questions:
        asked[i] = asked.get(i, set()) | words(t)
    out = {}
    for q in asked.keys() | {q for q in vectors if q in asked}:
        by = [[(-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q] if q in vectors else [], [(-len(w & asked[q]), i) for i, w in of.items() if w & asked[q]]]
        score = {}
        for pairs in by:
            for rank, (_, i) in enumerate(sorted(pairs), 1):
                score[i] = score.get(i, 0) + 1 / (RULES.rrf_k + rank)
        out[q] = [i for _, i in sorted((-round(s, 9), i) for i, s in score.items())[: RULES.top_k]]
    return {q: x for q, x in out.items() if x}


def test_hybrid_equals_plain_rankings(spark, monkeypatch):
    monkeypatch.setattr(stated, "VALUES", 90)
    monkeypatch.setattr(stated, "MOST", 7)
    draw, vocabulary = random.Random(3), [f"w{chr(97 + i)}" for i in range(20)]
    vectors = {i: [float(draw.randrange(-1, 2)) for _ in range(3)] for i in range(80)}  # whole numbers: many equal products
    texts = [(draw.randrange(100), " ".join(draw.choices(vocabulary, k=draw.randrange(0, 12))).upper()) for _ in range(120)] + [(7, None), (101, "ÉK wa")]
    questions = [(i, " ".join(draw.choices(vocabulary, k=5))) for i in range(0, 100, 5)] + [(5, "k wb"), (10, "k"), (300, None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    asked = [(i, vectors[i]) for i, _ in {i: 0 for i, _ in questions}.items() if i in vectors]
    got = {}
    found = stated.hybrid(frame(list(vectors.items()), "segment_id long, vector array<double>"), frame(asked, "query_id long, vector array<double>"), frame(texts, "segment_id long, text string"), frame(questions, "query_id long, text string"), RULES)
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.segment_id)
    assert got == plain(vectors, texts, questions)


def test_pairs_are_not_shuffled(spark, tmp_path):
    """Every item shares words with every document: 60,000 pairs, with which 1.04 MB were shuffled."""
    import pandas as pd

    import __spark_entry__

    words = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    pd.DataFrame({"doc_id": range(600), "text": [f"{words} x{'y' * (i % 9)}" for i in range(600)]}).to_parquet(f"{tmp_path}/documents.parquet")
    pd.DataFrame({"item_id": range(100), "text": [" ".join(words.split()[::-1])] * 100}).to_parquet(f"{tmp_path}/benchmark.parquet")
    pd.DataFrame({"vec_id": range(600), "embedding": [[float(i % 7), float(i % 5), 1.0] for i in range(600)], "label": 0}).to_parquet(f"{tmp_path}/embeddings.parquet")
    before = written(spark)
    row = __spark_entry__.queries()["retrieval_metrics"](spark, str(tmp_path)).collect()[0]
    assert row.questions == 100 and row.extracts == 8
    assert written(spark) - before < 700_000
