"""Sentences, citations, line ends, alignments; text columns and numbers on literal cases."""

from pyspark.sql import functions as F

from corpusmill.functions import numbers, text
from corpusmill.operators import ingestion, ordered, passages


def parts(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    out = [[] for _ in texts]
    for r in passages.sentences(df, "k").orderBy("k", "sentence").collect():
        assert texts[r.k][r.start : r.end] == r.text and r.sentence == len(out[r.k])
        out[r.k].append(r.text)
    return out


#: As extraction gives it: lines cut inside sentences and words, a short form, points of a list.
PAGE = "Le taux atteint 60 % par an, selon M. Durand,\nchef de projet. Les responsables sont rempla-\ncés souvent.\n• Trois missions ont eu lieu\n• Le budget est validé"
CLEAN = ["Le taux atteint 60 % par an, selon M. Durand, chef de projet.", "Les responsables sont remplacés souvent.", "• Trois missions ont eu lieu", "• Le budget est validé"]


def test_sentences(spark):
    long = "; ".join(f"point {k} " + "x" * 60 for k in range(9))
    got = parts(spark, "Un. Deux ! «Trois ?» Quatre", "M. Dupont et J. Martin, cf. Annexe. Voir art. 12. Fin", "Titre\n\nSuite\n- un\n- deux", " \n ", None or "", long, "Fin etc. Suite (voir p. 3.) Autre… Encore.\n\n1. Un point\nsuite")
    assert got[0] == ["Un.", "Deux !", "«Trois ?»", "Quatre"] and got[1] == ["M. Dupont et J. Martin, cf. Annexe.", "Voir art. 12. Fin"]
    assert got[2] == ["Titre", "Suite", "- un", "- deux"] and got[3] == got[4] == []
    assert len(got[5]) > 3 and all(len(p) <= 500 for p in got[5]) and "".join("".join(got[5]).split()) == "".join(long.split())
    assert got[6] == ["Fin etc.", "Suite (voir p. 3.) Autre…", "Encore.", "1. Un point\nsuite"]


def test_excerpts_and_passages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "mot " * 50), (3, None)], "k int, text string")
    s = passages.sentences(df, "k").cache()
    rows = passages.excerpts(s, "k", 1000).where("k = 1").orderBy("sentence").collect()
    assert [r.text for r in rows] == CLEAN
    short = passages.excerpts(s, "k", 110).orderBy("k", "sentence").collect()
    assert [r.text for r in short if r.k == 1] == CLEAN[:2]
    assert [r.text for r in passages.excerpts(s, "k", 20).where("k = 2").collect()] == ["mot mot mot mot…"]
    spans = [(1, r.start, r.end) for r in rows]
    cited = lambda *at: passages.passages(df, spark.createDataFrame([spans[i] for i in at], "k int, start int, end int"), "k").collect()[0].text
    assert cited(3, 1) == f"{CLEAN[1]} … {CLEAN[3]}" and " … " not in cited(0, 1)


def cite(spark, *texts, offered=("E1", "E2")):
    spans = {"E1": [(0, 9), (10, 20), (21, 30)], "E2": [(0, 9), (12, 20)]}
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, text string")
    o = spark.createDataFrame([(i, int(e[1:]), spans[e]) for i in range(len(texts)) for e in offered], "k int, excerpt int, spans array<struct<start:int,end:int>>")
    new, sources = passages.cited(t, o, "k")
    found = {}
    for r in sources.orderBy("k", "number").collect():
        found.setdefault(r.k, []).append((r.excerpt, [tuple(s) for s in r.spans]))
    return [r.text for r in new.orderBy("k").collect()], found


def test_references_become_numbers(spark):
    texts, found = cite(spark, "Un [E1.1, E2] deux [E1.2; e2.1] et [E9] (E1.7).", "Constat [E1.1, E1.2, E1.1].", "Constat [E1.2, E1.3] puis [E01], (E1.99) ⟦7⟧.", "rien", None)
    assert texts == ["Un⟦1,2⟧ deux⟦3,4⟧ et⟦5⟧.", "Constat⟦1⟧.", "Constat⟦1⟧ puis⟦2⟧,⟦2⟧ 7.", "rien", None]
    assert found[0] == [(1, [(0, 9)]), (2, [(0, 9), (12, 20)]), (1, [(10, 20)]), (2, [(0, 9)]), (1, [(0, 30)])]
    assert found[1] == [(1, [(0, 20)])] and found[2] == [(1, [(10, 30)]), (1, [(0, 30)])] and 3 not in found and 4 not in found
    assert cite(spark, "Constat [E1, E2].", offered=("E2",)) == (["Constat⟦1⟧."], {0: [(2, [(0, 9), (12, 20)])]})


def test_sources_are_renumbered_over_versions(spark):
    t = spark.createDataFrame([(1, 0, "B⟦2⟧ puis A⟦2,1⟧."), (1, 1, "B⟦2⟧ then A⟦1⟧."), (2, 0, "x⟦9⟧ y"), (2, 1, None)], "k int, version int, text string")
    s = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 1, "u")], "k int, number int, name string")
    new, kept = passages.compacted(t, s, "k")
    assert [r.text for r in new.orderBy("k", "version").collect()] == ["B⟦1⟧ puis A⟦1,2⟧.", "B⟦1⟧ then A⟦2⟧.", "x y", None]
    assert sorted((r.k, r.number, r.name) for r in kept.collect()) == [(1, 1, "y"), (1, 2, "x")]


def test_a_cut_leaves_numbers_whole(spark):
    rows = [("aa bb⟦1,2⟧ cc dd⟦3⟧", "aa bb⟦1,2⟧…"), ("aa⟦1⟧", "aa⟦1⟧"), ("abcdefghijkl", "abcdefg…"), ("ab cdefghijkl", "ab cdef…"), ("⟦1⟧a⟦2⟧bcdefg h i", "⟦1⟧a⟦2⟧bcdefg…")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select("t", passages.cut("t", 8).alias("c")).collect()
    assert {r.t: r.c for r in got} == dict(rows)


def test_rejoined(spark):
    pages = [(1, 1, "œu-\nvre et suivi-\névaluation, 2020-\nfin, A-\nB"), (2, 1, "suivi-\névaluation"), (3, 1, None)]
    words = [(1, "suivi-évaluation"), (2, "suivi-évaluation"), (2, "suiviévaluation"), (3, "x")]
    got = passages.rejoined(spark.createDataFrame(pages, "d int, p int, text string"), spark.createDataFrame(words, "d int, w string"), "d", "p")
    assert {r.d: r.text for r in got.collect()} == {1: "œuvre et suivi-évaluation, 2020-\nfin, A-\nB", 2: "suiviévaluation", 3: None}


def test_alignment(spark):
    page = [f"w{i}" for i in range(30)]
    excerpts = [(1, [*page[5:12], "x", *page[12:15]]), (2, [*page[:3], *["y"] * 9]), (3, page[3:5]), (4, [])]
    pairs = spark.createDataFrame([(7, i) for i, _ in excerpts], "doc_id int, item_id int")
    got = passages.aligned(pairs, spark.createDataFrame([(7, page)], "doc_id int, words array<string>"), spark.createDataFrame(excerpts, "item_id int, words array<string>"))
    # Three words alone are no run of four.
    assert [(r.item_id, r.words, r.first_word, r.last_word) for r in got.orderBy("item_id").collect()] == [(1, 7, 5, 11)]


def test_columns(spark):
    keys = {"Page 3 / 40": "#", "- 7 -": "#", "Rapport annuel 2025 | 14": "rapport annuel 2025", "p. 3 sur 40": "#", "12 of 40": "#", "• 12 •": "#", "Rapport  Annuel": "rapport annuel"}
    df = spark.createDataFrame([(k,) for k in keys], "t string").select("t", text.margin_key("t").alias("k"))
    assert {r.t: r.k for r in df.collect()} == keys
    one = spark.createDataFrame([("Côte d'Ivoire – œuvre", 0.125, 1234.5, "UE et ue")], "t string, x double, y double, s string")
    r = one.select(text.normalised("t").alias("n"), numbers.rounded(F.col("x"), 2).alias("r"), numbers.number(F.col("y"), 1, True).alias("f"), numbers.signed(F.col("y")).alias("g"), numbers.percent(F.col("x"), True).alias("p"), text.mentions(F.col("s"), F.col("s"), "UE").alias("m"), text.mentions(F.lit("EUE"), F.lit(""), "UE").alias("o")).first()
    assert tuple(r) == ("cote d ivoire uvre", 0.12, "1234,5", "+1234", "12\u202f%", True, False)
    spans = spark.createDataFrame([("0-154,155-300",), ("5-2",), ("a-3",), (",".join(["1-2"] * 21),)], "s string").select(text.parsed_spans("s").alias("x"))
    assert [r.x and [tuple(s) for s in r.x] for r in spans.collect()] == [[(0, 154), (155, 300)], None, None, None]


def test_samples_and_ranges(spark):
    n = spark.createDataFrame([(10,), (5,)], "n int")
    assert [r.p for r in n.select(ingestion.sample_positions(F.col("n"), 4).alias("p")).collect()][0] == [0, 3, 6, 9]
    assert [r.p for r in n.select(ingestion.sample_positions(F.col("n"), 1).alias("p")).collect()] == [[5], [2]]
    for values, label in (([140, *range(131, 140)], "[131–140]"), ([3, 7, 8, 9, 12, 13, 15], "[3] [7–9] [12] [13] [15]")):
        df = spark.createDataFrame([(1, v) for v in values], "g int, n int")
        assert ordered.joined_ranges(ordered.reference_ranges(df, "g", "n"), "g").first().label == label


def test_stream_goes_on(spark, tmp_path):
    from corpusmill.streaming import counts

    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in/first")
    assert [r.events for r in counts.ingested(spark, f"{tmp_path}/in/*", f"{tmp_path}/out").collect()] == [2]
    events.limit(1).coalesce(1).write.parquet(f"{tmp_path}/in/second")
    assert [r.events for r in counts.ingested(spark, f"{tmp_path}/in/*", f"{tmp_path}/out").collect()] == [3]
