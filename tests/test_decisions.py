"""Language and country decisions, limits of a report."""

from pyspark.sql import functions as F

from corpusmill.functions.text import normalised
from corpusmill.operators import ingestion, judgements, language

FRENCH = "Le programme appuie les communes rurales par la gestion de l'eau, le suivi des cultures et la formation des ménages. " * 20
ENGLISH = "The programme supports rural communities through water management, crop monitoring and training for the households. " * 20


def decide(spark, *texts, clear=0.7):
    model = language.model(spark.createDataFrame([("fr", FRENCH), ("en", ENGLISH), (None, "x"), ("fr", None)], "lang string, text string"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [(r.lang, r.confidence) for r in language.decided(df, model, clear).orderBy("doc_id").collect()]


def test_language_of_clear_texts_and_of_none(spark):
    assert decide(spark, FRENCH, ENGLISH, "   ", None, "short", "??????? ????????? ??????? ????") == [("fr", 1.0), ("en", 1.0), (None, 0.0), (None, 0.0), (None, 0.0), (None, 0.0)]


def test_unclear_heads_are_voted_on(spark):
    """Windows of 5,000 characters, three in French for one in English; a short text keeps its first guess."""
    (lang, share), (first, prob) = decide(spark, FRENCH * 6 + ENGLISH * 2, "the household water", clear=1.01)
    assert lang == "fr" and 0.7 <= share < 1
    assert first is None and prob == 0.0  # of fewer than 20 characters


def test_votes_are_bounded(spark):
    long = (FRENCH * 3 + ENGLISH) * 60
    starts = spark.range(1).select(ingestion.vote_starts(F.lit(len(long)), language.WINDOW, language.MOST_WINDOWS).alias("s")).first().s
    assert len(starts) == 20 and decide(spark, long, clear=1.01)[0][0] == "fr"


def countries(spark, *texts):
    names = [(1, "Éthiopie", "ET"), (2, "Etiopía", "ET"), (3, "Kenya", "KE"), (4, "Papouasie-Nouvelle-Guinée", "PG"), (5, "Guinée", "GN"), (6, "Moçambique", "MZ"), (7, "Moldova, Republic of", "MD"), (8, "Guinée", "XX"), (9, "Oz", "OZ"), (10, None, "N")]
    known = ingestion.names_of(spark.createDataFrame(names, "place int, name string, code string"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").select("doc_id", normalised("text").alias("norm"))
    return [(r.country, r.confidence) for r in ingestion.decided(docs, ingestion.gazetteer(docs, known), "country").orderBy("doc_id").collect()]


def test_countries_by_their_longest_names(spark):
    got = countries(spark, "Le programme couvre l'Éthiopie. En Éthiopie, une mission du Kenya.", "Projet en Papouasie-Nouvelle-Guinée", "Projeto em Moçambique e no Moçambique", "Programa en Etiopía", "Moldova et Republic of Moldova", "Rapport annuel, Oz", None, "Nouvelle Guinée, Papouasie Nouvelle")
    assert got == [("ET", 0.6667), ("PG", 1.0), ("MZ", 1.0), ("ET", 1.0), ("MD", 1.0), (None, 0.0), (None, 0.0), ("GN", 1.0)]


def test_limits_in_the_order_of_a_report(spark):
    variables = spark.createDataFrame([(1, 1, "present"), (1, 2, "non_renseigne"), (2, 2, "present")], "variable_id int, order_index int, state string")
    scores = spark.createDataFrame([(1, 1, 50.0, 0.9), (1, 2, 60.0, 0.28), (2, 2, None, 0.5)], "pillar int, order_index int, score double, confidence double")
    notes = spark.createDataFrame([(1, "concluded", False), (2, "insufficient", False)], "criterion int, reason string, ambiguous boolean")
    alerts = spark.createDataFrame([(True, True), (True, False), (False, True)], "pending boolean, qualified boolean")
    got = [tuple(r) for r in judgements.limit_lines(variables, scores, notes, alerts).orderBy("place").collect()]
    assert got == [(1, "not_concluded", 1, 2), (3, "confidence", 39, 2), (4, "unscored", 1, 2), (5, "undocumented", 1, 2), (6, "pending", 2, 3), (7, "unqualified", 1, 3)]
    assert judgements.limit_lines(*[x.limit(0) for x in (variables, scores, notes, alerts)]).collect() == []


def test_layers_statuses_names_and_messages(spark):
    steps = spark.createDataFrame([(1, "b", "done", 1), (1, "b", "skipped", 2), (1, "c", "skipped", 1), (1, "c", "done", 2), (3, "other", "skipped", 1)], "run int, step string, status string, seq int")
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run int")
    assert {r.run: (r.b, r.c) for r in judgements.layers_available(runs, steps, ["b", "c"]).collect()} == {1: (False, True), 2: (True, True), 3: (True, True)}
    statuses = spark.createDataFrame([("conforme",), ("integre_decision_humaine",), ("autre",), (None,)], "s string")
    assert [r.e for r in statuses.select(judgements.index_eligible(F.col("s")).alias("e")).collect()] == [True, True, False, False]
    countries = spark.createDataFrame([("BO", "Bolivia, Plurinational State of", "Bolivia"), ("KE", "Kenya", None), ("ET", "Ethiopia", None)], "code string, name string, common string")
    translations = spark.createDataFrame([("fr", "Ethiopia", "Éthiopie"), ("fr", "Kenya", "Kenya"), ("es", "Kenya", "Kenia")], "locale string, name string, translated string")
    codes = spark.createDataFrame([("bo",), ("KE",), ("et",), ("xx",), (None,)], "code string")
    names = lambda locale: {r.code: r.name for r in judgements.country_names(codes, countries, translations, locale).collect()}
    assert names("fr") == {"bo": "Bolivia", "KE": "Kenya", "et": "Éthiopie", "xx": None, None: None} and names("es")["KE"] == "Kenia"
    alerts = spark.createDataFrame([("A", "Eau", None, 62.5, None, 7.0, 0.385), ("B", "Sol", "Durée", 61.5, 0.96, None, 0.5), ("C", "x", "y", 1.0, 1.0, 1.0, 1.0)], "rule string, pillar string, criterion string, score double, note double, delta double, confidence double")
    templates = spark.createDataFrame([("en", "A", "{pillar}{criterion}: {score} (+{delta}, {confidence}%)"), ("fr", "B", "{pillar} {criterion} {note}/3 {score}{delta}"), ("en", "B", "no")], "locale string, rule string, template string")
    assert {r.rule: r.message for r in judgements.default_messages(alerts, templates, "fr").collect()} == {"A": "Eau: 62 (+7, 38%)", "B": "Sol Durée 1.0/3 62"}
