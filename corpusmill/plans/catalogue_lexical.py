"""Queries of lexical candidates. Imported for its effect on the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import assessment, lexical, retrieval
from corpusmill.plans.catalogue import query
from corpusmill.plans.catalogue_assess import _rounded
from corpusmill.plans.catalogue_text import _NORM
from corpusmill.sources.tables import kept, segments, table

#: Segments have the text of the document of their id; every 25th is a question, whose text is the 3rd to 14th word of the next document.
_LEXICAL = f"""WITH n AS (SELECT doc_id AS id, string_split({_NORM}, ' ') AS w FROM documents), e AS (SELECT vec_id, vec_id % 50 AS document_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sw AS (SELECT id, unnest(w) AS term FROM n JOIN e ON vec_id = id), tf AS (SELECT term, id, count(*) AS n FROM sw WHERE term <> '' GROUP BY ALL), total AS (SELECT count(*) AS t FROM n JOIN e ON vec_id = id),
df AS (SELECT term, ln(1 + (t - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, total GROUP BY term, t),
qt AS (SELECT DISTINCT vec_id AS query_id, unnest(w[3:14]) AS term FROM e JOIN n ON n.id = vec_id + 1 WHERE vec_id % 25 = 0),
sc AS (SELECT query_id, id AS segment_id, round(sum(idf * n * 2.2 / (n + 1.2)), 9) AS value FROM qt JOIN tf USING (term) JOIN df USING (term) WHERE id <> query_id GROUP BY ALL),
lx AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY value DESC, segment_id) AS INTEGER) AS lexical_rank FROM sc QUALIFY lexical_rank <= 20),
pr AS (SELECT q.vec_id AS query_id, s.vec_id AS segment_id, s.document_id, list_inner_product(s.v, q.v) AS similarity FROM e q, e s WHERE q.vec_id % 25 = 0 AND s.vec_id <> q.vec_id),
ne AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, segment_id) AS rank FROM pr QUALIFY rank <= 20),
ca AS (SELECT query_id, segment_id, pr.document_id, pr.similarity, lexical_rank, coalesce(1.0 / (60 + ne.rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0) AS score
  FROM pr LEFT JOIN ne USING (query_id, segment_id) LEFT JOIN lx USING (query_id, segment_id) WHERE ne.rank IS NOT NULL OR lexical_rank IS NOT NULL),
rl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, similarity DESC, segment_id) AS rank FROM ca WHERE similarity >= 0.28 OR lexical_rank IS NOT NULL AND similarity >= 0.05),
dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS doc_rank FROM rl),
rt AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_rank > 3 THEN 1 ELSE 0 END, rank) <= 8)
"""
#: A segment found by its words needs this similarity.
LEAST_LEXICAL = 0.05


def _ranked(spark, sf_dir):
    e = segments(table(spark, sf_dir, "embeddings"))
    d = table(spark, sf_dir, "documents")
    texts = lexical.texts_of(e.select("segment_id"), d.select(F.col("doc_id").alias("segment_id"), "text"), "segment_id")
    asked = e.where("segment_id % 25 = 0").select(F.col("segment_id").alias("query_id"))
    asked = lexical.texts_of(asked, d.select((F.col("doc_id") - 1).alias("query_id"), "text"), "query_id")
    # Written, since a filter on the words would go below the join and normalise every document.
    asked = kept(asked.select("query_id", F.array_join(F.slice(F.split(lexical.normalised("text"), " "), 3, 12), " ").alias("text")), "asked")
    return e, lexical.nearest_by_words(asked, texts, 20)


def _retrieved(spark, sf_dir):
    e, by_words = _ranked(spark, sf_dir)
    near = retrieval.nearest(e.where("segment_id % 25 = 0").select(F.col("segment_id").alias("query_id"), "vector"), e, 20)
    return lexical.retrieved(lexical.candidates(near, by_words, e), LEAST_LEXICAL)


@query(_LEXICAL + "SELECT query_id, segment_id, round(value, 6) AS value, lexical_rank FROM lx")
def lexical_topk(spark, sf_dir):
    return _rounded(_ranked(spark, sf_dir)[1], "value")


@query(_LEXICAL + "SELECT query_id, segment_id, document_id, round(similarity, 6) AS similarity, lexical_rank, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM rt")
def retrieved_candidates(spark, sf_dir):
    return _rounded(_retrieved(spark, sf_dir), "similarity", "score").drop("doc_rank")


@query(_LEXICAL + """SELECT vec_id AS query_id, vec_id % 7 AS criterion, (vec_id % 7) % 4 <> 3 AS graded, CASE WHEN (vec_id % 7) % 4 <> 3 AND vec_id % 3 <> 0 THEN (vec_id * 7) % 4 END AS note, vec_id % 11 = 0 AS contradictory,
CASE WHEN (vec_id % 7) % 4 <> 3 THEN vec_id % 3 <> 0 ELSE vec_id IN (SELECT query_id FROM rt) END AS documented FROM e WHERE vec_id % 25 = 0""")
def subquestion_status_hybrid(spark, sf_dir):
    """subquestion_status with segments found by their words too, at the lower similarity."""
    v = F.col("vec_id")
    graded = (v % 7) % 4 != 3
    asked = table(spark, sf_dir, "embeddings").where(v % 25 == 0).select(v.alias("query_id"), (v % 7).alias("criterion"), graded.alias("graded"), F.when(graded & (v % 3 != 0), (v * 7) % 4).alias("note"), (v % 11 == 0).alias("contradictory"))
    return assessment.answers(asked, _retrieved(spark, sf_dir))
