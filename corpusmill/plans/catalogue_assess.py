"""Queries of layers B and C, findings, ingestion, retrieval metrics and streams. Imported for its effect on the catalogue."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import assessment, decisions, ingestion, layer_a, retrieval, stated
from corpusmill.operators.products import products
from corpusmill.plans.catalogue import ORACLES, _LAYER_A, _layer_a, _nearest, query
from corpusmill.sources.tables import segments, spread, table
from corpusmill.streaming import counts

_B = _LAYER_A + """, nn AS (SELECT q.vec_id AS query_id, s.segment_id, list_inner_product(s.v, CAST(q.embedding AS DOUBLE[])) AS similarity FROM seg s, embeddings q WHERE q.vec_id % 25 = 0 AND s.segment_id <> q.vec_id),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, segment_id) AS rank FROM nn) WHERE rank <= 8 AND similarity >= 0.28),
qu AS (SELECT vec_id AS query_id, vec_id % 7 AS criterion, (vec_id % 7) % 4 <> 3 AS graded, CASE WHEN (vec_id % 7) % 4 <> 3 AND vec_id % 3 <> 0 THEN (vec_id * 7) % 4 END AS note, vec_id % 11 = 0 AS contradictory FROM embeddings WHERE vec_id % 25 = 0),
an AS (SELECT *, CASE WHEN graded THEN note IS NOT NULL ELSE query_id IN (SELECT query_id FROM ca) END AS documented FROM qu),
ct AS (SELECT criterion, count(*) AS total, count(*) FILTER (WHERE documented) AS documented, bool_or(graded) AS graded, CAST(round_even(CAST(avg(note) AS DECIMAL(30,12)), 1) AS DOUBLE) AS mean, bool_or(contradictory) OR count(note) >= 2 AND stddev_pop(note) > 1 AS apart FROM an GROUP BY criterion),
cq AS (SELECT criterion, coalesce(total, 0) AS total, coalesce(documented, 0) AS documented, coalesce(graded, false) AS graded, mean, coalesce(apart, false) AS apart FROM (SELECT DISTINCT vec_id % 8 AS criterion FROM embeddings) LEFT JOIN ct USING (criterion)),
cr AS (SELECT *, CASE WHEN total = 0 THEN 'no_questions' WHEN documented < 0.5 * total THEN 'insufficient' WHEN NOT graded THEN 'ai_unavailable' ELSE 'concluded' END AS reason FROM cq),
nt AS (SELECT criterion, total, documented, reason, CASE WHEN reason = 'concluded' THEN mean END AS note, reason = 'concluded' AND apart AS ambiguous FROM cr),
lt AS (SELECT * FROM ev WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pillar ORDER BY order_index DESC) = 1),
li AS (SELECT DISTINCT label AS pillar, CAST(unnest([label % 7, (label + 3) % 7]) AS BIGINT) AS criterion FROM embeddings),
ga AS (SELECT CASE WHEN criterion = 2 AND score >= 50 AND note <= 1 THEN 'ALERT-03' WHEN criterion = 3 AND score >= 40 AND note <= 1 THEN 'ALERT-04' WHEN criterion = 4 AND score >= 50 AND note <= 1 THEN 'ALERT-05'
  WHEN score >= 60 AND note <= 1 THEN 'ALERT-01' WHEN score <= 40 AND note >= 2 THEN 'ALERT-02' END AS rule, pillar, order_index, criterion, score, note, confidence FROM lt JOIN li USING (pillar) JOIN nt USING (criterion) WHERE note IS NOT NULL),
ax AS (SELECT *, CASE WHEN rule IN ('ALERT-01', 'ALERT-02') AND confidence >= 0.5 THEN 'majeure' ELSE 'mineure' END AS severity FROM
  (SELECT * FROM ga WHERE rule IS NOT NULL UNION ALL SELECT 'ALERT-06', pillar, order_index, NULL, score, NULL, confidence FROM ev WHERE delta >= 5 AND confidence < 0.5)),
pe AS (SELECT pillar, order_index, segment_id, max(similarity) AS similarity FROM es GROUP BY ALL),
ce AS (SELECT criterion, segment_id, max(similarity) AS similarity FROM ca JOIN an USING (query_id) WHERE documented GROUP BY ALL),
al AS (SELECT * FROM ax WHERE EXISTS (SELECT 1 FROM pe WHERE pe.pillar = ax.pillar AND pe.order_index = ax.order_index) OR EXISTS (SELECT 1 FROM ce WHERE ce.criterion = ax.criterion))
"""


def _layer_b(spark, sf_dir):
    e, v = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    graded = (v % 7) % 4 != 3
    questions = e.where(v % 25 == 0).select(v.alias("query_id"), (v % 7).alias("criterion"), graded.alias("graded"), F.when(graded & (v % 3 != 0), (v * 7) % 4).alias("note"), (v % 11 == 0).alias("contradictory"))
    candidates = _nearest(spark, sf_dir, 8).where("similarity >= 0.28")
    a = assessment.answers(questions, candidates)
    return candidates, a, assessment.final_notes(a, e.select((v % 8).alias("criterion")).distinct())


def _layer_c(spark, sf_dir, turned=False):
    """Scores, notes, alerts and evidence; turned: with the later version first."""
    _, p, dv, m = _layer_a(spark, sf_dir)
    dv = dv.withColumn("order_index", 3 - F.col("order_index")) if turned else dv
    s = layer_a.scores(layer_a.variables(m, p, dv))
    candidates, a, notes = _layer_b(spark, sf_dir)
    links = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pillar")).distinct().select("pillar", F.explode(F.array(F.col("pillar") % 7, (F.col("pillar") + 3) % 7).cast("array<bigint>")).alias("criterion"))
    by_pillar, by_criterion = assessment.pillar_evidence(layer_a.evidence(m, dv)), assessment.criterion_evidence(candidates, a)
    return s, notes, assessment.with_evidence(assessment.alerts(s, notes, links), by_pillar, by_criterion), by_pillar, by_criterion


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_B + "SELECT query_id, criterion, graded, note, contradictory, documented FROM an")
def subquestion_status(spark, sf_dir):
    return _layer_b(spark, sf_dir)[1]


@query(_B + "SELECT criterion, total, documented, reason, round(note, 6) AS note, ambiguous FROM nt")
def final_criterion_notes(spark, sf_dir):
    return _rounded(_layer_b(spark, sf_dir)[2], "note")


@query(_B + "SELECT rule, severity, pillar, order_index, criterion, round(score, 6) AS score, round(note, 6) AS note, round(confidence, 6) AS confidence FROM al")
def consistency_alerts(spark, sf_dir):
    return _rounded(_layer_c(spark, sf_dir)[2], "score", "note", "confidence")


@query(_B + """, ae AS (SELECT rule, pillar, order_index, al.criterion, segment_id, similarity, 0 AS side FROM al JOIN ce ON al.criterion = ce.criterion
UNION ALL SELECT rule, al.pillar, al.order_index, criterion, segment_id, similarity, 1 FROM al JOIN pe ON al.pillar = pe.pillar AND al.order_index = pe.order_index),
ao AS (SELECT * FROM ae QUALIFY row_number() OVER (PARTITION BY rule, pillar, order_index, criterion, segment_id ORDER BY side) = 1)
SELECT rule, pillar, order_index, criterion, segment_id, side, round(similarity, 6) AS similarity, CAST(row_number() OVER w AS INTEGER) AS place FROM ao
WINDOW w AS (PARTITION BY rule, pillar, order_index, criterion ORDER BY side, similarity DESC, segment_id) QUALIFY row_number() OVER w <= 4""")
def alert_evidence(spark, sf_dir):
    _, _, found, by_pillar, by_criterion = _layer_c(spark, sf_dir)
    return _rounded(assessment.evidence_of(found, by_pillar, by_criterion), "similarity")


#: Versions in turned order, so that pillars gain.
@query(_B.replace("1 + document_id % 2 AS order_index", "2 - document_id % 2 AS order_index") + """, x AS (SELECT pillar, round(delta, 6) AS delta FROM lt WHERE delta >= 5 AND (pillar, order_index) IN (SELECT (pillar, order_index) FROM pe))
SELECT 'P' || row_number() OVER (ORDER BY delta DESC, pillar) AS key, pillar, delta FROM x QUALIFY row_number() OVER (ORDER BY delta DESC, pillar) <= 3""")
def findings_progress(spark, sf_dir):
    s, _, _, by_pillar, _ = _layer_c(spark, sf_dir, turned=True)
    return assessment.progresses(s, by_pillar)


@query(_B + """, x AS (SELECT 'pillar' AS origin, CAST(pillar AS BIGINT) AS id, round(score / 100, 6) AS level, pillar NOT IN (SELECT pillar FROM al WHERE severity = 'majeure') AS later FROM lt
  WHERE score < 80 AND (pillar, order_index) IN (SELECT (pillar, order_index) FROM pe)
UNION ALL SELECT 'criterion', criterion, round(note / 3, 6), criterion NOT IN (SELECT criterion FROM al WHERE severity = 'majeure' AND criterion IS NOT NULL) FROM nt WHERE note < 2.4 AND criterion IN (SELECT criterion FROM ce))
SELECT 'W' || row_number() OVER w AS key, origin, id, level FROM x WINDOW w AS (ORDER BY later, level, id, origin) QUALIFY row_number() OVER w <= 3""")
def findings_weakness_topk(spark, sf_dir):
    return assessment.weaknesses(*_layer_c(spark, sf_dir))


@query(_B + """SELECT n.*, round(confidence, 6) AS confidence, not_concluded >= 2 OR confidence < 0.5 AS leads FROM (SELECT count(*) FILTER (WHERE reason <> 'concluded') AS not_concluded, count(*) AS criteria FROM nt) n,
(SELECT CAST(round_even(CAST(coalesce(avg(c), 0) AS DECIMAL(30,12)), 2) AS DOUBLE) AS confidence FROM (SELECT max_by(confidence, order_index) AS c FROM sc GROUP BY pillar))""")
def corpus_limits(spark, sf_dir):
    s, notes, *_ = _layer_c(spark, sf_dir)
    return _rounded(assessment.limits(s, notes), "confidence")


@query(_B + """SELECT 'A' AS layer, pillar || '/' || order_index AS item, CAST(CAST(score AS DECIMAL(18,2)) AS VARCHAR) AS value FROM sc
UNION ALL SELECT 'B', CAST(criterion AS VARCHAR), CASE WHEN note IS NULL THEN reason ELSE CAST(CAST(note AS DECIMAL(18,2)) AS VARCHAR) END FROM nt UNION ALL SELECT 'C', pillar || '/' || order_index || '/' || rule, severity FROM al""")
def report_csv_rows(spark, sf_dir):
    s, notes, found, *_ = _layer_c(spark, sf_dir)
    two = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    a = s.select(F.lit("A").alias("layer"), F.concat_ws("/", "pillar", "order_index").alias("item"), two("score").alias("value"))
    b = notes.select(F.lit("B").alias("layer"), F.col("criterion").cast("string").alias("item"), F.coalesce(two("note"), "reason").alias("value"))
    return a.union(b).union(found.select(F.lit("C"), F.concat_ws("/", "pillar", "order_index", "rule"), "severity"))


@query(_LAYER_A + """, bp AS (SELECT segment_id, document_id, max_by(pillar, similarity) AS pillar FROM (SELECT segment_id, document_id, pillar, list_inner_product(seg.v, pr.v) AS similarity FROM seg, pr WHERE r = 1 AND segment_id <> variable_id) GROUP BY ALL)
SELECT m.segment_id, m.variable_id, m.pillar, round(m.similarity, 6) AS similarity FROM m JOIN bp USING (segment_id, pillar)""")
def segment_classification(spark, sf_dir):
    s, p, _, m = _layer_a(spark, sf_dir)
    first = p.where("rank = 1").select("variable_id", F.col("pillar").alias("own"), "vector")
    best = products(s, first, "variable_id", k=None).join(first.drop("vector"), "variable_id").groupBy("segment_id").agg(F.max_by("own", "similarity").alias("pillar"))
    return m.join(best, ["segment_id", "pillar"]).select("segment_id", "variable_id", "pillar", F.round("similarity", 6).alias("similarity"))


@query(_LAYER_A + "SELECT segment_id, document_id FROM seg WHERE segment_id NOT IN (SELECT segment_id FROM m)")
def segments_without_match(spark, sf_dir):
    s, _, _, m = _layer_a(spark, sf_dir)
    return s.select("segment_id", "document_id").join(m, "segment_id", "left_anti")


_HYBRID = r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark),
n AS (SELECT item_id, doc_id, count(*) AS n FROM q JOIN t USING (w) WHERE w <> '' GROUP BY ALL), rw AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM n),
v AS (SELECT q.vec_id AS item_id, s.vec_id AS doc_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) AS similarity FROM embeddings q, embeddings s WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND s.vec_id <> q.vec_id),
rv AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM v),
fu AS (SELECT item_id, doc_id, coalesce(1.0 / (60 + rv.rank), 0) + coalesce(1.0 / (60 + rw.rank), 0) AS score FROM rv FULL JOIN rw USING (item_id, doc_id)),
hy AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS place FROM fu QUALIFY place <= 8)
"""


def _hybrid(spark, sf_dir):
    s = segments(table(spark, sf_dir, "embeddings"))
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    queries = s.join(b.select(F.col("item_id").alias("segment_id")).distinct(), "segment_id", "left_semi").select(F.col("segment_id").alias("query_id"), "vector")
    both = stated.hybrid(s, queries, spread(d.select(F.col("doc_id").alias("segment_id"), "text")), b.select(F.col("item_id").alias("query_id"), "text"))
    return both.select(F.col("query_id").alias("item_id"), F.col("segment_id").alias("doc_id"), "score", "place")


@query(_HYBRID + "SELECT item_id, doc_id, round(CAST(score AS DOUBLE), 6) AS score, place FROM hy")
def hybrid_rrf_topk(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir), "score")


@query(_HYBRID + ", gh AS (" + ORACLES["gold_hits"] + """), x AS (SELECT b.item_id, (SELECT count(*) FROM hy WHERE hy.item_id = b.item_id) AS sent, (SELECT count(*) FROM gh WHERE gh.item_id = b.item_id) AS quotes,
(SELECT count(*) FROM hy JOIN gh USING (item_id, doc_id) WHERE hy.item_id = b.item_id) AS found, (SELECT min(place) FROM hy JOIN gh USING (item_id, doc_id) WHERE hy.item_id = b.item_id) AS first FROM benchmark b)
SELECT count(*) AS questions, round(avg(found / quotes) FILTER (WHERE quotes > 0), 6) AS recall, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END) FILTER (WHERE quotes > 0), 6) AS hit_rate, round(avg(found / sent) FILTER (WHERE sent > 0), 6) AS precision,
round(avg(coalesce(1 / first, 0)) FILTER (WHERE quotes > 0), 6) AS mrr, round(avg(CASE WHEN sent = 0 THEN 1 ELSE 0 END) FILTER (WHERE quotes = 0), 6) AS empty_rate, round(avg(sent), 6) AS extracts FROM x""")
def retrieval_metrics(spark, sf_dir):
    from corpusmill.plans.catalogue import gold_hits

    gold = gold_hits(spark, sf_dir).withColumn("relevant", F.lit(True))
    return retrieval.metrics(table(spark, sf_dir, "benchmark").select("item_id"), _hybrid(spark, sf_dir), gold)


_NUMBER = r"[-–—|·•\s]*(page|p\.)?\s*\d+(\s*(/|sur|of|de)\s*\d+)?[-–—|·•\s]*"
_KEY = rf"""trim(regexp_replace(CASE WHEN regexp_full_match(v, '{_NUMBER}') THEN '' ELSE regexp_replace(v, '(\D){_NUMBER}$', '\1') END, '^{_NUMBER}', ''))"""
_MARGINS = rf"""WITH n AS (SELECT source, doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'sheet' END AS title FROM documents), li AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM n WHERE title IS NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS z, trim(lower(regexp_replace(line, '\s+', ' ', 'g'))) AS v FROM li WHERE regexp_matches(line, '\S')),
t AS (SELECT source, count(DISTINCT doc_id) AS total FROM f GROUP BY source), kx AS (SELECT *, CASE WHEN {_KEY} = '' THEN '#' ELSE {_KEY} END AS key FROM f WHERE a <= 3 OR z <= 3),
k AS (SELECT DISTINCT source, doc_id, 'top' AS side, key FROM kx WHERE a <= 3 UNION SELECT DISTINCT source, doc_id, 'bottom', key FROM kx WHERE z <= 3), c AS (SELECT source, side, key, count(*) AS pages FROM k WHERE length(key) <= 150 GROUP BY ALL),
ma AS (SELECT source, side, key, pages FROM c JOIN t USING (source) WHERE total >= 3 AND pages >= greatest(3, ceil(total * 0.01)))
"""


def _pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text", F.when(F.col("doc_id") % 7 == 0, "sheet").alias("title"))


@query(_MARGINS + "SELECT source AS document, side, key, pages FROM ma")
def repeated_margins(spark, sf_dir):
    return ingestion.margins(_pages(spark, sf_dir), 0.01)


@query(_MARGINS + r""", g AS (SELECT DISTINCT doc_id, i FROM kx WHERE a <= 3 AND (source, key) IN (SELECT (source, key) FROM ma WHERE side = 'top') UNION SELECT doc_id, i FROM kx WHERE z <= 3 AND (source, key) IN (SELECT (source, key) FROM ma WHERE side = 'bottom')),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM li WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM g) GROUP BY doc_id)
SELECT n.source AS document, n.doc_id AS page, sha256(CASE WHEN n.doc_id IN (SELECT doc_id FROM g) THEN regexp_replace(coalesce(kept, ''), '^\s+|\s+$', '', 'g') ELSE text END) AS text_sha256 FROM n LEFT JOIN s USING (doc_id)""")
def stripped_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return ingestion.stripped(pages, ingestion.margins(pages, 0.01)).select("document", "page", F.sha2("text", 256).alias("text_sha256"))


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS v FROM documents), f AS (SELECT doc_id, v, len(regexp_split_to_array(v, '\s+')) AS words,
regexp_matches(v, '(?i)^((\d+(\.\d+)*\.?)|([IVXLC]+\.)|((chapitre|chapter|section|annexe|annex|partie|part)\s+\S+))\s*[-–:]?\s*\S') AS numbered FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE v <> '' AND length(v) <= 120 AND words <= 14 AND (NOT regexp_matches(v, '[.,;]$') OR numbered) AND ((numbered AND words >= 2)
OR (length(regexp_replace(v, '[^\p{L}]', '', 'g')) >= 4 AND NOT regexp_matches(v, '\p{Ll}')))) AS headings FROM f GROUP BY doc_id""")
def heading_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(ingestion.is_heading(F.col("line"))).alias("headings"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def section_carry_forward(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    title = F.when(F.col("role") == "user", F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(title, ignorenulls=True).over(w).alias("section"))


@query("""SELECT conv_id AS document, CASE WHEN sum(length(text)) < 100 * count(*) THEN 'scan' WHEN bool_or(length(text) < 100 AND role = 'assistant') THEN 'mixte' ELSE 'natif' END AS type FROM conversations GROUP BY conv_id""")
def pdf_typing(spark, sf_dir):
    return ingestion.page_typing(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), "text", (F.col("role") == "assistant").alias("has_images")))


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS met FROM documents WHERE lang IS NOT NULL GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM c)
SELECT source, lang, round(n / total, 6) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, met) = 1""")
def language_vote(spark, sf_dir):
    return _rounded(ingestion.majority(table(spark, sf_dir, "documents"), "source", "lang", "doc_id"), "confidence")


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT DISTINCT o_custkey, CAST(position AS BIGINT) AS position FROM (SELECT o_custkey, unnest(CASE WHEN n <= 4 THEN range(n) ELSE [CAST(round_even(CAST(i AS DOUBLE) * (n - 1) / 3, 0) AS BIGINT) FOR i IN range(4)] END) AS position FROM n)""")
def sample_indices(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", F.explode(ingestion.sample_positions(F.col("n"), 4)).alias("position"))


@query("""WITH e AS (SELECT vec_id % 50 AS document_id, label + 1 AS words, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT document_id, unnest(v) / sqrt(list_inner_product(v, v)) * words AS x, unnest(range(len(v))) AS dim FROM e WHERE list_inner_product(v, v) > 0),
s AS (SELECT document_id, dim, sum(x) AS x FROM u GROUP BY ALL)
SELECT document_id, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY document_id)), 6) AS value FROM s""")
def window_pooling(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("document_id"), (F.col("label") + 1).alias("words"), F.col("embedding").cast("array<double>").alias("vector"))
    return _rounded(ingestion.pooled(s, "document_id", "vector", "words"), "value")


@query("""WITH w AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS w, CAST(sum(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS total FROM part), c AS (SELECT *, (2 * w * 10000 + total) // (2 * total) AS cents FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cents DESC, p_partkey) AS n, CAST(10000 - sum(cents) OVER (PARTITION BY p_brand) AS BIGINT) AS rest FROM c)
SELECT p_brand, p_partkey, CASE WHEN n = 1 THEN cents + rest ELSE cents END AS cents FROM r""")
def weight_normalisation(spark, sf_dir):
    return decisions.normalised(table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("bigint").alias("w")), "p_brand", "p_partkey", "w")


@query("SELECT s_nationkey, s_suppkey, CAST(row_number() OVER w AS INTEGER) AS place FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) QUALIFY row_number() OVER w <= 8")
def reference_topk(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", place.alias("place")).where("place <= 8")


@query("""SELECT n_nationkey, n_name, count(s_suppkey) AS pillars, count(s_suppkey) BETWEEN 5 AND 8 AS size_ok, count(*) FILTER (WHERE s_suppkey IS NOT NULL AND s_acctbal < 0) AS unfunded
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def framework_checks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") < 0).alias("u"))
    both = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return both.select("n_nationkey", "n_name", n.alias("pillars"), n.between(5, 8).alias("size_ok"), F.coalesce("u", F.lit(0)).alias("unfunded"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS themes, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey),
x AS (SELECT c_custkey, c_nationkey % 3 + CASE WHEN n = 1 THEN 0 WHEN n <= 3 THEN 1 ELSE 2 END + CASE WHEN themes = 1 THEN 0 WHEN themes <= 3 THEN 1 ELSE 2 END + c_custkey % 3 + CASE WHEN total < 500000 THEN 0 WHEN total <= 2000000 THEN 1 ELSE 2 END AS points
FROM customer JOIN o ON o_custkey = c_custkey) SELECT c_custkey, CAST(points AS BIGINT) AS points, CASE WHEN points <= 3 THEN 'simple' WHEN points <= 6 THEN 'complique' ELSE 'complexe' END AS class FROM x""")
def complexity_class(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("themes"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    band = lambda c, a, b: F.when(a, 0).when(b, 1).otherwise(2)
    n, t, s = F.col("n"), F.col("themes"), F.col("total")
    points = F.col("c_nationkey") % 3 + band(n, n == 1, n <= 3) + band(t, t == 1, t <= 3) + F.col("c_custkey") % 3 + band(s, s < 500000, s <= 2000000)
    both = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).withColumn("points", points.cast("bigint"))
    return both.select("c_custkey", "points", decisions.complexity(F.col("points")).alias("class"))


@query("SELECT l_orderkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS INTEGER) AS number FROM lineitem GROUP BY l_orderkey, l_suppkey")
def citation_numbers(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("seq"))
    return cited.select("l_orderkey", "l_suppkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy("seq", "l_suppkey")).alias("number"))


_TOKENS = "regexp_extract_all(text, '\\\\p{L}+|\\\\p{N}+|[^\\\\s\\\\p{L}\\\\p{N}]', 0)"


#: Batches as a recursion over each conversation's turns; a relation t (conv_id, pos, tokens) comes before it.
def _batches(most_rows: int, most_tokens: int) -> str:
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS r FROM t WHERE conv_id IS NOT NULL),
f AS (SELECT conv_id, pos, r, 0 AS batch, 1 AS held, tokens AS total FROM n WHERE r = 1
UNION ALL SELECT conv_id, pos, r, CASE WHEN goes THEN batch + 1 ELSE batch END, CASE WHEN goes THEN 1 ELSE held + 1 END, CASE WHEN goes THEN tokens ELSE total + tokens END
  FROM (SELECT n.conv_id, n.pos, n.r, n.tokens, f.batch, f.held, f.total, f.held + 1 > {most_rows} OR f.total + n.tokens > {most_tokens} AS goes FROM f JOIN n ON n.conv_id = f.conv_id AND n.r = f.r + 1))"""


@query("WITH RECURSIVE t AS (SELECT conv_id, turn AS pos, coalesce(len(regexp_extract_all(text, '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')), 0) AS tokens FROM conversations), " + _batches(3, 400) + " SELECT conv_id, pos AS turn, batch FROM f")
def token_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn AS pos", f"coalesce(size({_TOKENS}), 0) AS tokens")
    return ingestion.folded(rows, "conv_id", ["pos"], partial(ingestion.Batches, most_rows=3, most_tokens=400), "conv_id long, turn long, batch int")


#: The guard as a recursion over each user's events.
_GUARD = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL),
f AS (SELECT user_id, event_id, r, false AS blocked, CAST(NULL AS BIGINT) AS until, [us] AS seen FROM e WHERE r = 1
UNION ALL SELECT user_id, event_id, r, banned OR len(seen) > 5, CASE WHEN banned THEN until WHEN len(seen) > 5 THEN us + 43200000000 END, CASE WHEN NOT banned AND len(seen) > 5 THEN [] ELSE seen END
  FROM (SELECT e.user_id, e.event_id, e.r, e.us, f.until, coalesce(e.us < f.until, false) AS banned,
    CASE WHEN coalesce(e.us < f.until, false) THEN f.seen ELSE list_append(list_filter(f.seen, lambda x: x > e.us - 86400000000), e.us) END AS seen FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))
SELECT user_id, event_id, blocked FROM f"""


@query(_GUARD)
def ban_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hour = 3_600_000_000
    return ingestion.folded(e, "user_id", ["us", "event_id"], partial(ingestion.Ban, limit=5, window=24 * hour, ban=12 * hour), "user_id long, event_id long, blocked boolean")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_ingest_counts(spark, sf_dir):
    out = counts.ingested(spark, f"{sf_dir}/events*.parquet", counts.place(spark, "stream"))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
