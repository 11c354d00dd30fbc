"""Queries of findings and actions, variants of the retrieval, translations, meters and streams with state. Imported for its effect on the catalogue."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corpusmill.operators import assessment, frameworks, records, retrieval
from corpusmill.plans.catalogue import ORACLES, gold_hits, query
from corpusmill.plans.catalogue_assess import _B, _GUARD, _HYBRID, _hybrid, _layer_c
from corpusmill.rules import DEFAULT
from corpusmill.sources.tables import probes, segments, table
from corpusmill.streaming import classified, counts, guard

_FINDINGS = _B + """, wx AS (SELECT 'pillar' AS origin, CAST(pillar AS BIGINT) AS id, round(score / 100, 6) AS level, pillar NOT IN (SELECT pillar FROM al WHERE severity = 'majeure') AS later FROM lt
  WHERE score < 80 AND (pillar, order_index) IN (SELECT (pillar, order_index) FROM pe)
UNION ALL SELECT 'criterion', criterion, round(note / 3, 6), criterion NOT IN (SELECT criterion FROM al WHERE severity = 'majeure' AND criterion IS NOT NULL) FROM nt WHERE note < 2.4 AND criterion IN (SELECT criterion FROM ce)),
we AS (SELECT origin, id, row_number() OVER (ORDER BY later, level, id, origin) AS n FROM wx QUALIFY n <= 3),
ve AS (SELECT rule, severity, pillar, order_index, criterion, row_number() OVER (ORDER BY severity <> 'majeure', rule, pillar, order_index, criterion NULLS LAST) AS n FROM al QUALIFY n <= 3),
nx AS (SELECT criterion, documented, total, row_number() OVER (ORDER BY documented DESC, criterion) AS n FROM nt WHERE reason <> 'concluded' AND criterion IN (SELECT criterion FROM ce)),
ne AS (SELECT * FROM nx WHERE n <= 6 - (SELECT count(*) FROM we) - (SELECT count(*) FROM ve))
"""


def _findings(spark, sf_dir, rules=DEFAULT):
    found = _layer_c(spark, sf_dir)
    _, notes, alerts, _, by_criterion = found
    weak, verify = assessment.weaknesses(*found), assessment.verifications(alerts)
    return weak, verify, assessment.partials(notes, by_criterion, weak, verify, rules)


@query(_FINDINGS + "SELECT 'V' || n AS key, rule, severity, pillar, order_index, criterion FROM ve")
def findings_to_verify(spark, sf_dir):
    return assessment.verifications(_layer_c(spark, sf_dir)[2])


@query(_FINDINGS.replace("n <= 6 -", "n <= 10 -") + "SELECT 'N' || n AS key, criterion, documented, total FROM ne")
def findings_partial(spark, sf_dir):
    """With room for ten actions, since weaknesses and alerts take the usual six in these tables."""
    return _findings(spark, sf_dir, replace(DEFAULT, actions=10))[2]


@query(_FINDINGS + "SELECT 'W' || n AS key, origin, id FROM we UNION ALL SELECT 'V' || n, 'alert', CAST(pillar AS BIGINT) FROM ve UNION ALL SELECT 'N' || n, 'criterion', criterion FROM ne")
def action_origins(spark, sf_dir):
    return assessment.origins(*_findings(spark, sf_dir))


@query("""WITH p AS (SELECT conv_id // 2 AS action, conv_id // 2 % 30 AS origin, conv_id % 2 * 1000 + turn AS pos, ['decideur', 'pmu', 'analyste', 'autre'][1 + turn % 4] AS persona, text FROM conversations),
f AS (SELECT action, origin, persona, arg_min(struct_pack(t := text), pos).t AS t FROM p WHERE persona <> 'autre' AND origin IN (SELECT n_nationkey FROM nation) GROUP BY ALL)
SELECT action, origin, CAST(sum(length(trim(t))) AS BIGINT) AS reason_chars FROM f WHERE length(trim(t)) >= 120 GROUP BY ALL HAVING count(*) = 3""")
def complete_actions(spark, sf_dir):
    """Turns are projections, whose text is also their reason; nations are the known origins."""
    action = F.floor(F.col("conv_id") / 2)
    persona = F.element_at(F.array(*[F.lit(x) for x in ("decideur", "pmu", "analyste", "autre")]), (1 + F.col("turn") % 4).cast("int"))
    p = table(spark, sf_dir, "conversations").select(action.alias("action"), (action % 30).alias("origin"), (F.col("conv_id") % 2 * 1000 + F.col("turn")).alias("pos"), persona.alias("persona"), "text", F.col("text").alias("reason"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("origin"))
    return assessment.complete_actions(p, known, ["decideur", "pmu", "analyste"])


def _measured(of):
    return f"""SELECT '{of}' AS variant, count(*) AS questions, round(avg(found / quotes) FILTER (WHERE quotes > 0), 6) AS recall, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END) FILTER (WHERE quotes > 0), 6) AS hit_rate,
round(avg(found / sent) FILTER (WHERE sent > 0), 6) AS precision, round(avg(coalesce(1 / first, 0)) FILTER (WHERE quotes > 0), 6) AS mrr, round(avg(CASE WHEN sent = 0 THEN 1 ELSE 0 END) FILTER (WHERE quotes = 0), 6) AS empty_rate, round(avg(sent), 6) AS extracts
FROM (SELECT b.item_id, (SELECT count(*) FROM {of} WHERE {of}.item_id = b.item_id) AS sent, (SELECT count(*) FROM gh WHERE gh.item_id = b.item_id) AS quotes, (SELECT count(*) FROM {of} JOIN gh USING (item_id, doc_id) WHERE {of}.item_id = b.item_id) AS found,
(SELECT min(place) FROM {of} JOIN gh USING (item_id, doc_id) WHERE {of}.item_id = b.item_id) AS first FROM benchmark b)"""


@query(_HYBRID + ", gh AS (" + ORACLES["gold_hits"] + "), hybrid AS (SELECT * FROM hy), vectors AS (SELECT item_id, doc_id, rank AS place FROM rv WHERE rank <= 8) " + _measured("vectors") + " UNION ALL " + _measured("hybrid"))
def variant_comparison(spark, sf_dir):
    """The search by vectors alone, and by both rankings."""
    gold = gold_hits(spark, sf_dir).withColumn("relevant", F.lit(True))
    b = table(spark, sf_dir, "benchmark")
    s = segments(table(spark, sf_dir, "embeddings"))
    asked = s.join(b.select(F.col("item_id").alias("segment_id")).distinct(), "segment_id", "left_semi").select(F.col("segment_id").alias("query_id"), "vector")
    vectors = retrieval.nearest(asked, s, 8).select(F.col("query_id").alias("item_id"), F.col("segment_id").alias("doc_id"), F.col("rank").alias("place"))
    both = [retrieval.metrics(b.select("item_id"), sent, gold).withColumn("variant", F.lit(name)) for name, sent in (("vectors", vectors), ("hybrid", _hybrid(spark, sf_dir)))]
    return both[0].unionByName(both[1])


@query("""WITH p AS (SELECT p_partkey AS pillar, p_partkey % 25 AS reference, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE n_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE n_name || '.' END AS description FROM part JOIN nation ON n_nationkey = p_partkey % 25),
c AS (SELECT l_partkey AS pillar, ['fr', 'en', 'de'][1 + l_linenumber % 3] AS locale, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE 'T' || l_suppkey END AS name FROM lineitem),
k AS (SELECT pillar, locale, arg_min(name, pos) AS name FROM c WHERE locale <> 'de' AND trim(name) <> '' GROUP BY ALL),
o AS (SELECT p.pillar, locale, locale || ' ' || n_name AS official FROM p JOIN nation ON n_nationkey = reference AND n_name = p.name AND n_name || '.' = p.description, (VALUES ('fr'), ('en')) l(locale) WHERE (locale = 'fr' AND n_nationkey < 20) OR (locale = 'en' AND n_nationkey >= 5))
SELECT pillar, locale, coalesce(official, k.name) AS name, official IS NOT NULL AS official FROM k FULL JOIN o USING (pillar, locale)""")
def reused_translations(spark, sf_dir):
    """Nations are reference pillars; parts take their texts, changed in some."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("reference"), F.col("n_name").alias("name"), F.concat("n_name", F.lit(".")).alias("description"))
    own = table(spark, sf_dir, "part").withColumn("reference", F.col("p_partkey") % 25).join(n, "reference")
    pillars = own.select(F.col("p_partkey").alias("pillar"), "reference", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("name")).alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.col("description")).alias("description"))
    official = n.select("reference", F.explode(F.array(F.lit("fr"), F.lit("en"))).alias("locale"), "name").where("(locale = 'fr' AND reference < 20) OR (locale = 'en' AND reference >= 5)").withColumn("name", F.concat_ws(" ", "locale", "name"))
    locale = F.element_at(F.array(F.lit("fr"), F.lit("en"), F.lit("de")), (1 + F.col("l_linenumber") % 3).cast("int"))
    name = F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.concat(F.lit("T"), "l_suppkey"))
    # Line numbers repeat within an order: of equal ones the first row of the table counts.
    pos = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pillar"), locale.alias("locale"), pos.alias("pos"), name.alias("name"))
    return frameworks.reused_translations(pillars, frameworks.kept_translations(candidates, ["fr", "en"]), n, official)


@query("""WITH u AS (SELECT user_id, count(*) AS calls, CAST(sum(floor(abs(value) * 100)) AS BIGINT) AS tokens FROM events WHERE event_id % 9 <> 0 GROUP BY user_id),
x AS (SELECT c_custkey AS user_id, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens FROM customer LEFT JOIN u ON user_id = c_custkey)
SELECT *, round_even(CAST(CAST(tokens AS DECIMAL(18,0)) * CAST(0.02 AS DECIMAL(6,2)) AS DOUBLE), 0) / 1000000 AS cost_eur FROM x""")
def embedding_meter(spark, sf_dir):
    """Customers are tasks, events their calls; every ninth call failed."""
    calls = table(spark, sf_dir, "events").select("user_id", F.floor(F.abs("value") * 100).alias("tokens"), (F.col("event_id") % 9 != 0).alias("ok"))
    return records.metered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), calls, "user_id", "0.02")


@query(ORACLES["probe_matches"])
def stream_probe_matches(spark, sf_dir):
    out = classified.classified(spark, f"{sf_dir}/embeddings*.parquet", probes(table(spark, sf_dir, "embeddings")), counts.place(spark, "matches"))
    return out.withColumn("similarity", F.round("similarity", 6))


@query(_GUARD)
def stream_guard(spark, sf_dir):
    hour = 3_600_000_000
    return guard.guarded(spark, f"{sf_dir}/events*.parquet", counts.place(spark, "guard"), 5, 24 * hour, 12 * hour)
