"""Lexical ranks of segments without an index: blocks, passes, repeated rows, and what is shuffled."""

import math
import random
from collections import Counter, defaultdict

from corpusmill.operators import lexical


def written(spark):
    """Bytes of shuffle files written so far."""
    every = spark._jsc.sc().statusStore().executorList(True)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_ranks_in_blocks_and_passes_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SCORES", 40)
    monkeypatch.setattr(lexical, "MOST", 5)
    draw, vocabulary = random.Random(4), [f"w{i}" for i in range(40)]
    segments = [(i % 90, " ".join(["the", *draw.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=draw.randrange(0, 20))])) for i in range(120)] + [(91, None), (92, ""), (93, "É, the THE"), (94, "the e the")]
    questions = [(i, " ".join(["The", *draw.choices(vocabulary, k=4)])) for i in range(0, 60, 5)] + [(5, "the w1 w2"), (200, "unknown"), (201, "the"), (202, None)]
    counts, asked = defaultdict(Counter), defaultdict(set)
    for i, t in segments:
        counts[i].update((t or "").lower().replace("é,", "e").split())
    for i, t in questions:
        asked[i] |= set((t or "").lower().split())
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log1p((len(segments) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    got = defaultdict(list)
    found = lexical.nearest_by_words(spark.createDataFrame(questions, "query_id int, text string"), spark.createDataFrame(segments, "segment_id int, text string"), 6)
    for r in found.orderBy("query_id", "lexical_rank").collect():
        got[r.query_id].append((r.segment_id, r.value))
    for q, words in asked.items():
        score = {i: round(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2) for w in sorted(words) if w in c), 9) for i, c in counts.items() if i != q}
        want = sorted((-v, i) for i, v in score.items() if v > 0)[:6]
        assert [i for i, _ in got[q]] == [i for _, i in want], q
        assert all(abs(a - b) < 1e-8 for (_, a), (b, _) in zip(got[q], [(-v, i) for v, i in want], strict=True))


def test_pairs_of_common_words_are_not_shuffled(spark):
    """Every question shares its words with every segment; pairs met by their words were shuffled, 0.78 MB."""
    common = " ".join(f"w{i}" for i in range(12))
    segments = spark.createDataFrame([(i, f"{common} own{i}") for i in range(300)], "segment_id long, text string")
    questions = segments.selectExpr("segment_id AS query_id", "text")
    index = lexical.postings(segments).cache()
    for search, given in ((lexical.ranked, index), (lexical.nearest_by_words, segments)):
        before = written(spark)
        assert search(questions, given, 5).count() == 1500
        assert written(spark) - before < 300_000


def test_nothing_asked_and_nothing_there(spark):
    some, none = spark.createDataFrame([(1, "a b")], "query_id long, text string"), spark.createDataFrame([], "segment_id long, text string")
    assert lexical.nearest_by_words(some, none, 5).collect() == [] and lexical.ranked(some, lexical.postings(none), 5).collect() == []
    assert lexical.nearest_by_words(some.limit(0), none.unionByName(some.withColumnRenamed("query_id", "segment_id")), 5).collect() == []
