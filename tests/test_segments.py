"""Segmentation on literal pages, and what must hold of every segment."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import segments
from corpusmill.rules import DEFAULT

PAGES = "document long, page int, text string, char_start int, title string, headings array<string>, extra string"
SF = "/root/testdata/sf0.001"


def segmented(spark, *pages):
    rows = [(1, *p, "x") for p in pages]
    return segments.segmented(spark.createDataFrame(rows, PAGES)).orderBy("segment").collect()


def test_target_overlap_and_offsets(spark):
    text = "\n\n".join(f"Partie {i}. " + "Les cultures irriguées avancent bien. " * 30 for i in range(30))
    got = segmented(spark, (1, text, 0, None, None))
    assert len(got) > 5 and all(s.tokens <= DEFAULT.segment_target + DEFAULT.segment_overlap for s in got[:-1]) and all(s.tokens <= DEFAULT.segment_max for s in got)
    assert " ".join(got[0].text.split()[-5:]) in got[1].text
    assert got[0].char_start == 0 and [s.segment for s in got] == list(range(len(got)))
    for before, s in zip(got, got[1:], strict=False):
        assert s.char_start > before.char_start and s.text.endswith(text[s.char_start : s.char_end].replace(" \n\n", "\n"))


def test_sections_and_pages(spark):
    got = segmented(spark, (1, "1. Contexte\n\n" + "Le contexte du pays. " * 80, 0, None, []), (2, "2. Budget\n\n" + "Le budget prévu. " * 80, 5000, None, []))
    assert [(s.section, s.page, s.char_start) for s in got] == [("1. Contexte", 1, 0), ("2. Budget", 2, 5000)]


def test_section_goes_on_and_titles_open_theirs(spark):
    got = segmented(spark, (1, "3.2 Mise en oeuvre\n" + "Le travail avance. " * 30, 0, None, None), (2, "Il se poursuit. " * 30, 2000, None, None))
    assert [s.section for s in got] == ["3.2 Mise en oeuvre"] and "Il se poursuit." in got[0].text
    got = segmented(spark, (1, "Le budget annuel. " * 30, 0, "Budget", None), (2, "Les indicateurs. " * 30, 2000, "Suivi", None), (3, None, 4000, "Fin", None), (4, "Reste.", 4000, "", None))
    assert [(s.section, s.page) for s in got] == [("Budget", 1), ("Suivi", 2), ("Fin", 4)]


def test_headings_join_what_follows(spark):
    got = segmented(spark, (1, "3. RÉSULTATS\n\n3.1 Travaux agricoles\n\n" + "Les parcelles avancent. " * 30, 0, None, None))
    assert len(got) == 1 and got[0].section == "3.1 Travaux agricoles" and got[0].char_start == 0 and got[0].text.startswith("3. RÉSULTATS\n3.1 Travaux agricoles\nLes")


def test_styled_headings(spark):
    text = "\n\n".join(["Contexte du projet", "Le contexte du pays. " * 40, "Dispositif de suivi", "Les indicateurs suivis. " * 40])
    own = ["Contexte du projet", "Dispositif de suivi"]
    assert [s.section for s in segmented(spark, (1, text, 0, own[0], own))] == own


def test_long_paragraphs_are_cut_at_sentences(spark):
    text = "Une phrase sur le suivi des indicateurs. " * 400
    got = segmented(spark, (1, text, 7, None, None))
    assert len(got) > 1 and all(s.tokens <= DEFAULT.segment_max for s in got) and all(s.text.endswith(".") for s in got)
    assert all(text[s.char_start - 7 : s.char_end - 7].startswith("Une phrase") for s in got)


def test_sentences_too_long_are_cut_in_windows(spark):
    """Paragraphs of 300, 1345 and 50 tokens."""
    got = segmented(spark, (1, "\n\n".join(["a b " * 150, "c d " * 672 + "e", "f g " * 25]), 0, None, None))
    assert [s.tokens for s in got] == [300, 576, 576, 564]
    assert got[1].text.split("\n")[0] == ("a b " * 32).strip() and got[3].text.endswith("e\ne\n" + ("f g " * 25).strip())


def test_small_tail_joins(spark):
    got = segmented(spark, (1, "\n\n".join(["Les cultures avancent. " * 80, "Fin."]), 0, None, None))
    assert got[-1].text.endswith("\nFin.") and got[-1].tokens == 322
    got = segmented(spark, (1, "\n\n".join(["mot " * 500, "mot " * 40]), 0, None, None))
    assert [s.tokens for s in got] == [540] and got[0].text.count("mot") == 540  # without the overlap it would have had alone


@pytest.mark.parametrize("text", [None, "", " \n\t\n "])
def test_nothing_to_segment(spark, text):
    assert segmented(spark, (1, text, 0, None, None)) == []


def test_every_line_is_in_a_segment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    zero = F.lit(0)
    pages = docs.select(F.col("doc_id").alias("document"), zero.alias("page"), "text", zero.alias("char_start"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("headings"))
    got = {}
    for s in segments.segmented(pages).orderBy("document", "segment").collect():
        got.setdefault(s.document, []).append(s)
    words = re.compile(r"[^\W\d_]+|\d+").findall
    for d in docs.collect():
        own = got.get(d.doc_id, [])
        assert set(words(d.text or "")) == set(words("\n".join(s.text for s in own))) and [s.segment for s in own] == list(range(len(own)))
