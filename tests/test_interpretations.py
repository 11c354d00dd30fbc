"""Stored answers to published interpretations."""

import json

from corpusmill.operators import interpretations

PAD = " Le suivi décrit ce que le programme fait dans chaque commune et comment il le mesure." * 2
PAD_EN = " The monitoring tells what the programme does in each commune and how it measures that." * 2
SPANS = {1: [(0, 9), (10, 20), (22, 30)], 2: [(0, 5)], 3: [(0, 7), (8, 12)]}


def published(spark, answer, locales=("en", "es"), subjects=None):
    stored = spark.createDataFrame([(1, answer if isinstance(answer, str) or answer is None else json.dumps(answer, ensure_ascii=False), list(locales))], "batch int, answer string, locales array<string>")
    subjects = subjects or [("segments", "E1", [1]), ("segments", "E2", [2]), ("segments", "E3", [3]), ("variables", "V1", [1, 3]), ("pillars", "P1", [2])]
    of = spark.createDataFrame([(1, *s) for s in subjects], "batch int, kind string, item string, allowed array<int>")
    excerpts = spark.createDataFrame([(1, e, s) for e, s in SPANS.items()], "batch int, excerpt int, spans array<struct<start:int,end:int>>")
    texts, sources = interpretations.interpreted(interpretations.answers(stored), of, excerpts)
    found = {}
    for r in sources.orderBy("number").collect():
        found.setdefault(r.item, []).append((r.excerpt, [tuple(s) for s in r.spans]))
    return {(r.item, r.locale): r.text for r in texts.collect()}, found


def test_texts_cite_their_own_sources_and_are_translated(spark):
    texts, sources = published(spark, {
        "segments": {" e1 ": "Le projet exécute son budget [E1.1, E3]." + PAD, "E2": "Trop court [E2].", "E3": "Le projet analyse les besoins." + PAD, "E9": "Inconnu." + PAD},
        "variables": {"V1": "Le projet suit ses dépenses [E1.2, E3]." + PAD, "V2": "Pas un sujet [E1]." + PAD}, "pillars": {"P1": "Le projet gère ses finances [E2]." + PAD * 2},
        "translations": {"en": {"segments": {"E1": "The project spends its budget [E1.1]." + PAD_EN, "E3": "Needs."}, "pillars": {"P1": "The project manages [E2]." + PAD_EN * 2}, "variables": {"V1": "Short [E1]."}}, "es": {"segments": {"E1": "El proyecto" + PAD + " [E1.2]."}}, "pt": {"segments": {"E1": "O projeto." + PAD}}},
    })
    assert texts == {
        ("E1", None): "Le projet exécute son budget⟦1⟧." + PAD, ("E1", "en"): "The project spends its budget⟦1⟧." + PAD_EN, ("E1", "es"): "El proyecto" + PAD + "⟦2⟧.",
        ("E3", None): ("Le projet analyse les besoins." + PAD)[:-1] + "⟦1⟧.", ("E3", "en"): "Needs⟦1⟧.",
        ("V1", None): "Le projet suit ses dépenses⟦1,2⟧." + PAD, ("P1", None): "Le projet gère ses finances⟦1⟧." + PAD * 2, ("P1", "en"): "The project manages⟦1⟧." + PAD_EN * 2,
    }
    assert sources == {"E1": [(1, [(0, 9)]), (1, [(10, 20)])], "E3": [(3, [(0, 12)])], "V1": [(1, [(10, 20)]), (3, [(0, 12)])], "P1": [(2, [(0, 5)])]}


def test_what_is_no_answer_gives_nothing(spark):
    for answer in (None, "", "{broken", "[1, 2]", "7", {"segments": [1], "variables": "x", "translations": 3}, {"variables": {"V1": "Sans source." + PAD, "V2": None}}):
        assert published(spark, answer) == ({}, {}), answer


def test_long_texts_are_cut_and_lose_the_sources_of_what_is_cut(spark):
    text = "mot " * 300
    texts, sources = published(spark, {"variables": {"V1": text[:400] + "[E3] " + text[400:] + "[E1.1]"}, "pillars": {"P1": "a" * 240 + " [E2]"}})
    assert set(texts) == {("V1", None)} and sources == {"V1": [(3, [(0, 12)])]}
    shown = texts["V1", None].replace("⟦1⟧", "")
    assert shown.endswith("mot…") and 840 < len(shown) <= 850


def test_too_many_marks_are_dropped(spark):
    """Within the shown length, but too long to be stored with its marks."""
    subjects = [("variables", "V1", [1, 2, 3])]
    texts, _ = published(spark, {"variables": {"V1": "ab [E1,E2,E3,E1.1] " * 250}}, subjects=subjects)
    assert "⟦" not in texts["V1", None] and texts["V1", None].startswith("ab ab ab") and len(texts["V1", None]) <= 850
