"""Further registered queries: ordered analytics, rules, text functions. Imported for its effect on the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import decisions, layer_a, ordered
from corpusmill.plans.catalogue import _LAYER_A, _layer_a, query
from corpusmill.sources.tables import table


@query(_LAYER_A + "SELECT pillar, max(order_index) AS latest, max(order_index) FILTER (WHERE score IS NOT NULL) AS latest_scored, round(max_by(score, order_index) FILTER (WHERE score IS NOT NULL), 6) AS score FROM sc GROUP BY pillar")
def latest_scored_version(spark, sf_dir):
    _, p, dv, m = _layer_a(spark, sf_dir)
    return ordered.latest_scored(layer_a.scores(layer_a.variables(m, p, dv))).withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey // 10 AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS k FROM d),
r AS (SELECT l_suppkey, k, min(n) AS low, max(n) AS high FROM i GROUP BY ALL)
SELECT l_suppkey, low, high, CASE WHEN high - low >= 2 THEN '[' || low || '–' || high || ']' WHEN high > low THEN '[' || low || '] [' || high || ']' ELSE '[' || low || ']' END AS label FROM r""")
def reference_ranges(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor(F.col("l_partkey") / 10).cast("bigint").alias("n"))
    return ordered.reference_ranges(n, "l_suppkey", "n")


@query("""WITH s AS (SELECT l_suppkey, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) % 7 AS e FROM lineitem), f AS (SELECT * FROM s WHERE e > s),
g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM f),
p AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT l_suppkey, min(s) AS start, max(e) AS "end" FROM p GROUP BY l_suppkey, part""")
def span_merge(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.rint("l_quantity").cast("bigint") % 7).alias("end"))  # rounded, halves to even, as the SQL's cast does
    return ordered.merged_spans(s, "l_suppkey")


@query("""WITH e AS (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) - 1 AS stored FROM events WHERE event_type = 'purchase')
SELECT event_id, stored, stored >= 2 AS refused FROM e""")
def global_hourly_cap(spark, sf_dir):
    return ordered.hourly_cap(table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp")), 2)


@query("""WITH a AS (SELECT vec_id % 7 AS criterion, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id * 7) % 4 END AS note FROM embeddings)
SELECT criterion, count(*) AS total, count(note) AS documented, CASE WHEN count(note) >= 0.5 * count(*) THEN round(avg(note), 6) END AS note, count(note) >= 2 AND coalesce(stddev_pop(note), 0) > 1.0 AS ambiguous FROM a GROUP BY criterion""")
def criterion_notes(spark, sf_dir):
    v = F.col("vec_id")
    a = table(spark, sf_dir, "embeddings").select((v % 7).alias("criterion"), F.when(v % 3 != 0, (v * 7) % 4).alias("note"))
    return decisions.criterion_notes(a).withColumn("note", F.round("note", 6)).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


@query("""WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice / 4000) AS INTEGER) AS semantic, CAST(o_custkey % 3 AS INTEGER) - 1 AS country, o_orderpriority LIKE '1%' AS fin, o_orderstatus = 'O' AS theme, o_custkey % 2 = 0 AS lang, o_orderkey % 11 = 0 AS off FROM orders),
y AS (SELECT *, greatest(0, least(100, greatest(0, least(100, semantic)) + CASE country WHEN 1 THEN 10 WHEN -1 THEN -30 ELSE 0 END + CASE WHEN fin THEN 5 ELSE 0 END + CASE WHEN theme THEN 5 ELSE 0 END + CASE WHEN lang THEN 5 ELSE 0 END - CASE WHEN off THEN 20 ELSE 0 END)) AS score FROM x)
SELECT o_orderkey, score, CASE WHEN score < 40 AND country < 0 THEN 'rejected_country' WHEN score < 40 THEN 'rejected_score' WHEN country < 0 THEN 'verify_country' WHEN country = 0 THEN 'verify_no_country' WHEN score < 70 THEN 'verify_score' WHEN off THEN 'conform_partial' ELSE 'conform' END AS decision FROM y""")
def ingestion_decision(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("country", (F.col("o_custkey") % 3).cast("int") - 1).withColumn("off", F.col("o_orderkey") % 11 == 0)
    score = decisions.relevance(F.floor(F.col("o_totalprice") / 4000).cast("int"), F.col("country"), F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "O", F.col("o_custkey") % 2 == 0, F.col("off"))
    return o.withColumn("score", score).select("o_orderkey", "score", decisions.decision(F.col("score"), F.col("country"), F.col("off")).alias("decision"))


_CELL = "CASE c_custkey % 7 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN chr(13) ELSE '' END || c_name"


@query(f"""SELECT c_custkey, CASE WHEN left(x, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN chr(39) || x ELSE x END AS cell,
left(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM (SELECT c_custkey, c_name, {_CELL} AS x FROM customer)""")
def report_cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("x", F.expr(_CELL))
    return c.select("c_custkey", text.csv_cell("x").alias("cell"), text.slug("c_name").alias("slug"))
