"""Queries of records, judgements and reports: merges, leases, settings, grades, statuses, limits, summaries. Imported for its
effect on the catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import assessment, ingestion, judgements, layer_a, records
from corpusmill.operators.products import products
from corpusmill.plans.catalogue import _LAYER_A, _layer_a, query
from corpusmill.plans.catalogue_assess import _B, _layer_b, _layer_c
from corpusmill.sources import ledger
from corpusmill.sources.tables import segments, table
from corpusmill.streaming.counts import place


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upserted_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return records.upserted(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")), ["o_orderkey"])


@query("SELECT user_id AS job, event_type AS lease, min(event_id) AS event_id FROM events WHERE event_type = CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' ELSE 'error' END GROUP BY ALL")
def lease_commits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("lease"), "event_id")
    job = F.col("job") % 3
    leases = e.select("job").distinct().withColumn("lease", F.when(job == 0, "click").when(job == 1, "purchase").otherwise("error"))
    return records.under_lease(e, leases, "job", "lease", "event_id")


@query("SELECT 'pages' AS name, doc_id AS id, n_chars AS n FROM documents UNION ALL SELECT 'sources', CAST(substr(source, 4) AS BIGINT), count(*) FROM documents GROUP BY source")
def published_run(spark, sf_dir):
    """A run's two tables, published at once by the second holder of its lease; the first one comes too late and is refused."""
    d, run = table(spark, sf_dir, "documents"), ledger.Ledger(spark, place(spark, "ledger"))
    late = run.claim("run", 300, now=0.0)
    token = run.claim("run", 300, now=301.0)
    pages = d.select("doc_id", "n_chars")
    run.commit("run", token, replaced={"pages": pages, "sources": d.groupBy(F.substring("source", 4, 10).cast("long").alias("source")).agg(F.count("*").alias("n"))})
    try:
        run.commit("run", late, replaced={"pages": pages.where("doc_id < 0")})
    except ledger.Refused:
        pass
    return run.read("pages").select(F.lit("pages").alias("name"), F.col("doc_id").alias("id"), F.col("n_chars").alias("n")).union(run.read("sources").select(F.lit("sources"), "source", "n"))


@query("SELECT doc_id, upper(lang) AS lang FROM documents")
def published_generation(spark, sf_dir):
    """The second of three generations is the one published; the third is written, published and withdrawn."""
    d, g = table(spark, sf_dir, "documents"), records.Generations(spark, place(spark, "generations"))
    g.write(d.select("doc_id", "lang"), 1)
    g.publish(1, 1)
    g.write(d.select("doc_id", F.upper("lang").alias("lang")), 2)
    g.publish(2, 2)
    g.write(d.select("doc_id", "lang").limit(0), 3)
    g.publish(3, 3)
    g.publish(2, 4)
    return g.read()


_SETTINGS = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END AS owner, o_custkey % 40 AS key, o_orderkey AS version, o_orderpriority AS value FROM orders"


@query(f"""WITH s AS ({_SETTINGS}) SELECT w.owner, key, version, value FROM (SELECT unnest(range(6)) AS owner) w JOIN s ON s.owner = w.owner OR s.owner IS NULL
QUALIFY row_number() OVER (PARTITION BY w.owner, key ORDER BY s.owner IS NULL, version DESC) = 1""")
def config_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    s = o.select(F.when(k % 3 != 0, k % 5).alias("owner"), (F.col("o_custkey") % 40).alias("key"), k.alias("version"), F.col("o_orderpriority").alias("value"))
    return records.settings_of(spark.range(6).select(F.col("id").alias("owner")), s, "owner", "key", "version")


@query("""WITH s AS (SELECT doc_id, text, doc_id % 3 = 0 AS known FROM documents), k AS (SELECT text, bool_or(known) AS known FROM s GROUP BY text)
SELECT doc_id, k.known AS reused, CAST(length(text) AS DOUBLE) AS size, CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) AS INTEGER) AS copy FROM s JOIN k USING (text)""")
def vector_reuse(spark, sf_dir):
    """A third of the texts have a vector; the model that makes the others' is a stand-in that measures the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    embed = lambda x: x.withColumn("vector", F.array(F.length("text").cast("double")))
    out = records.reused(d, embed(d.where("doc_id % 3 = 0").select("text")), embed)
    return out.select("doc_id", "reused", F.element_at("vector", 1).alias("size"), F.row_number().over(W.partitionBy("text").orderBy("doc_id")).alias("copy"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) || ' fr' WHEN 1 THEN 'EN ' || n_name WHEN 2 THEN 'FR ' || n_name ELSE n_name END AS text FROM nation""")
def localised_text(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4
    entry = F.when(k == 0, F.create_map(F.lit("pt"), F.concat(F.lower("n_name"), F.lit("⟦1,2⟧ fr")), F.lit("en"), F.lit("x"))).when(k == 1, F.create_map(F.lit("pt"), F.lit(""), F.lit("en"), F.concat(F.lit("EN "), "n_name")))
    entry = entry.when(k == 2, F.create_map(F.lit("fr"), F.concat(F.lit("FR "), "n_name", F.lit("⟦3⟧")))).otherwise(F.create_map().cast("map<string,string>"))
    return n.select("n_nationkey", records.localised(entry, F.col("n_name"), "pt").alias("text"))


_GRADES = """g AS (SELECT l_orderkey AS question, (l_linenumber * 1000000 + l_partkey) * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq, CAST(l_quantity AS INTEGER) % 6 - 1 AS note, ['E' || (l_partkey % 7), 'E' || (l_suppkey % 5), 'E' || (l_partkey % 7)] AS excerpts FROM lineitem)"""


@query(f"""WITH {_GRADES}, c AS (SELECT question, seq, note, unnest(excerpts) AS excerpt, unnest([1, 2, 3]) AS pos FROM g WHERE note BETWEEN 0 AND 3),
o AS (SELECT question, seq, note, excerpt, min(pos) AS pos FROM c WHERE CAST(substr(excerpt, 2) AS INTEGER) <= question % 4 GROUP BY ALL)
SELECT question, note, string_agg(excerpt, ',' ORDER BY pos) AS excerpts FROM o GROUP BY question, seq, note QUALIFY row_number() OVER (PARTITION BY question ORDER BY seq) = 1""")
def grade_validation(spark, sf_dir):
    """Offered to a question are E0 up to its key modulo 4."""
    li = table(spark, sf_dir, "lineitem")
    e = lambda c, n: F.concat(F.lit("E"), (F.col(c) % n).cast("string"))
    grades = li.select(F.col("l_orderkey").alias("question"), F.expr("(l_linenumber * 1000000L + l_partkey) * 1000000L + l_suppkey * 100 + CAST(l_quantity AS BIGINT)").alias("seq"), (F.col("l_quantity").cast("int") % 6 - 1).alias("note"), F.array(e("l_partkey", 7), e("l_suppkey", 5), e("l_partkey", 7)).alias("excerpts"))
    offered = li.select(F.col("l_orderkey").alias("question")).distinct()
    offered = offered.select("question", F.explode(F.sequence(F.lit(0), (F.col("question") % 4).cast("int"))).alias("n")).select("question", F.concat(F.lit("E"), "n").alias("excerpt"))
    return judgements.valid_grades(grades, offered)


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'majeure' ELSE 'mineure' END AS severity, (o_custkey % 10) / 10.0 AS confidence FROM orders),
s AS (SELECT l_orderkey AS id, l_partkey % 4 <> 0 AS confirmed, CASE l_suppkey % 3 WHEN 0 THEN 'majeure' WHEN 1 THEN 'mineure' ELSE 'grave' END AS said FROM lineitem WHERE l_orderkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1)
SELECT a.id, CASE WHEN s.id IS NULL THEN severity WHEN confidence < 0.5 THEN 'mineure' WHEN said <> 'grave' THEN said ELSE severity END AS severity, s.id IS NOT NULL AS qualified FROM a LEFT JOIN s USING (id) WHERE coalesce(confirmed, true)""")
def alert_qualification(spark, sf_dir):
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 0, "majeure").otherwise("mineure").alias("severity"), (F.col("o_custkey") % 10 / 10).alias("confidence"))
    s = F.col("l_suppkey") % 3
    answers = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), (F.col("l_partkey") % 4 != 0).alias("confirmed"), F.when(s == 0, "majeure").when(s == 1, "mineure").otherwise("grave").alias("severity"))
    return judgements.qualified(a, answers, 0.5)


@query("""SELECT doc_id, source = 'src0' OR NOT (doc_id % 100) / 100.0 < 0.7 AS sure, CASE WHEN source = 'src0' THEN false ELSE (doc_id % 100) / 100.0 < 0.7 END AS to_confirm, CASE WHEN l IS NOT NULL THEN l IN ('en', 'fr') END AS expected FROM (SELECT *, CASE WHEN source = 'src0' THEN 'en' ELSE nullif(lang, 'es') END AS l FROM documents)""")
def language_flags(spark, sf_dir):
    """The user gave the language of documents of src0; Spanish is not recognised."""
    d = table(spark, sf_dir, "documents")
    given = F.col("source") == "src0"
    value = F.coalesce(F.when(given, "en"), F.nullif(F.col("lang"), F.lit("es")))
    confidence = F.when(given, 1.0).otherwise(F.col("doc_id") % 100 / 100)
    confirm, expected = judgements.language_flags(value, confidence, F.when(given, "user").otherwise("auto"), F.array(F.lit("en"), F.lit("fr")))
    return d.select("doc_id", (~confirm).alias("sure"), confirm.alias("to_confirm"), expected.alias("expected"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'completed' WHEN o_orderkey % 5 = 0 THEN 'not_needed' WHEN o_orderkey % 3 = 0 THEN 'disabled' ELSE 'failed' END AS restitution,
CASE WHEN o_orderstatus = 'F' OR o_orderkey % 11 = 0 THEN 'fail' WHEN o_custkey % 2 = 0 AND o_custkey % 100 >= 60 THEN 'timeout' WHEN o_custkey % 2 = 0 THEN 'defer' ELSE 'run' END AS gate, NOT (o_custkey % 4 > 0 AND o_totalprice > (o_custkey % 4) * 100000) AS called FROM orders""")
def run_statuses(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", judgements.restitution_status(k % 7 == 0, k % 5 != 0, k % 3 == 0).alias("restitution"),
        judgements.run_gate(c % 2 == 0, F.col("o_orderstatus") == "F", k % 11 == 0, c % 100, 60).alias("gate"), judgements.affordable(F.col("o_totalprice"), c % 4 * 100000).alias("called"),
    )


@query("""SELECT user_id, count(*) AS calls, CAST(sum(CASE WHEN event_id % 6 <> 0 THEN CAST(CAST(floor(abs(value) * 100) AS BIGINT) AS DECIMAL(18,0)) * 2.5 END) / 1000000 AS DECIMAL(18,6)) AS cost_eur,
CASE WHEN count(*) FILTER (WHERE event_id % 6 <> 0) = count(*) THEN 'completed' WHEN count(*) FILTER (WHERE event_id % 6 <> 0) > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM events GROUP BY user_id""")
def usage_by_user(spark, sf_dir):
    """Every sixth call has no price."""
    tokens, price = F.floor(F.abs("value") * 100).cast("decimal(18,0)"), F.when(F.col("event_id") % 6 != 0, F.lit("2.5").cast("decimal(3,1)"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), (F.sum(tokens * price) / 1000000).cast("decimal(18,6)").alias("cost_eur"), judgements.cost_status(tokens, price).alias("status"))


_PAGES = "SELECT conv_id, length(text) AS size, CASE WHEN turn % 4 = 3 THEN NULL ELSE ((turn * 13 + conv_id * 7) % 100) / 100.0 END AS confidence FROM conversations"


@query(f"""SELECT conv_id, count(confidence) AS ocr_pages, CAST(round_even(CAST(avg(CAST(confidence AS DOUBLE)) AS DECIMAL(30,12)), 3) AS DOUBLE) AS ocr_confidence, count(*) FILTER (WHERE confidence < 0.6) AS low_pages,
round(sum(CAST(confidence AS DOUBLE) * size) / sum(CASE WHEN confidence IS NOT NULL THEN size END), 6) AS weighted_confidence FROM ({_PAGES}) GROUP BY conv_id""")
def extraction_metadata(spark, sf_dir):
    c = F.when(F.col("turn") % 4 != 3, (F.col("turn") * 13 + F.col("conv_id") * 7) % 100 / 100)
    return judgements.confidence_of(table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("size"), c.alias("confidence")), "conv_id")


@query("""WITH r AS (SELECT c_nationkey AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line, c_custkey AS k, c_mktsegment AS s FROM customer)
SELECT sheet, min(line) FILTER (WHERE k % 3 = 0 AND s <> 'BUILDING') AS header FROM r WHERE line <= 10 GROUP BY sheet""")
def sheet_headers(spark, sf_dir):
    """Rows of a sheet are the customers of a nation; a third of them have no number, and one segment is blank."""
    line = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    cells = F.array("c_name", F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("12,5"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), line.alias("line"), cells.alias("cells"))
    return judgements.header_rows(rows, "sheet", "line").withColumn("header", F.col("header").cast("bigint"))


_ITEMS = "SELECT item_id - item_id % 7 % 2 AS item_id, item_id * 50 AS doc_id, CASE WHEN item_id % 5 = 0 THEN left(text, 8) ELSE text END AS quote FROM benchmark"


@query(f"""SELECT item_id, i.doc_id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY item_id) > 1 THEN 'repeated' END, CASE WHEN length(trim(quote)) < 12 THEN 'short' END, CASE WHEN d.doc_id IS NULL THEN 'unknown' END) AS faults
FROM ({_ITEMS}) i LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = i.doc_id""")
def dataset_faults(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id - item_id % 7 % 2 AS item_id", "item_id * 50 AS doc_id", "CASE WHEN item_id % 5 = 0 THEN left(text, 8) ELSE text END AS quote")
    return judgements.dataset_faults(items, table(spark, sf_dir, "documents"))


@query("""SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 8))), 6) AS total FROM embeddings""")
def vector_codec(spark, sf_dir):
    """Vectors written as text of 8 digits and read again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumn("text", F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: F.format_number(x, 8)), ","), F.lit("]")))
    back = F.from_json("text", "array<double>")
    return e.select("vec_id", F.size(back).alias("dims"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH e AS (SELECT vec_id, vec_id % 50 AS document_id, 1 + vec_id % 7 AS size, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 0)
SELECT document_id, greatest(0, least(100, CAST(trunc(sum(list_inner_product(e.v, q.v) * 4 * size) / sum(size) * 100) AS INTEGER))) AS score FROM e, q WHERE vec_id <> 0 GROUP BY document_id""")
def semantic_scores(spark, sf_dir):
    """The profile is the first vector; similarities are taken four-fold, since those of the given vectors are small."""
    s = segments(table(spark, sf_dir, "embeddings"))
    found = products(s, s.where("segment_id = 0").select(F.col("segment_id").alias("profile"), "vector"), "profile")
    return ingestion.semantic_score(found.select("document_id", (F.col("similarity") * 4).alias("similarity"), (1 + F.col("segment_id") % 7).alias("size")), "document_id", "similarity", "size")


@query(_LAYER_A + """, s AS (SELECT variable_id, order_index, CASE WHEN value IS NULL THEN 'non_renseigne' WHEN value = 1 THEN 'present' ELSE 'partiel' END AS state FROM va)
SELECT order_index, count(*) FILTER (WHERE state <> 'non_renseigne') AS documented, coalesce(string_agg(CASE WHEN state = 'non_renseigne' THEN CAST(variable_id AS VARCHAR) END, ',' ORDER BY variable_id), '') AS missing FROM s GROUP BY order_index""")
def documented_variables(spark, sf_dir):
    _, p, dv, m = _layer_a(spark, sf_dir)
    v = layer_a.variables(m, p, dv)
    missing = F.array_sort(F.collect_list(F.when(F.col("state") == "non_renseigne", F.col("variable_id"))))
    return v.groupBy("order_index").agg(F.count_if(F.col("state") != "non_renseigne").alias("documented"), F.array_join(missing.cast("array<string>"), ",").alias("missing"))


@query(_LAYER_A + "SELECT CAST(round_even(CAST(avg(score) AS DECIMAL(30,12)), 0) AS BIGINT) AS average FROM (SELECT max_by(score, order_index) AS score FROM sc WHERE score IS NOT NULL GROUP BY pillar)")
def average_score(spark, sf_dir):
    _, p, dv, m = _layer_a(spark, sf_dir)
    last = assessment.latest_scored_rows(layer_a.scores(layer_a.variables(m, p, dv)))
    return last.agg(F.bround(F.avg("score").cast("decimal(38,12)"), 0).cast("bigint").alias("average"))


@query(_B + """SELECT 'A' AS layer, CASE WHEN value IS NULL THEN 'non_renseigne' WHEN value = 1 THEN 'present' ELSE 'partiel' END AS state, count(*) AS n FROM va GROUP BY ALL
UNION ALL SELECT 'B', reason, count(*) FROM nt GROUP BY ALL UNION ALL SELECT 'C', severity, count(*) FROM al GROUP BY ALL""")
def step_summaries(spark, sf_dir):
    _, p, dv, m = _layer_a(spark, sf_dir)
    _, notes, found, *_ = _layer_c(spark, sf_dir)
    parts = (("A", layer_a.variables(m, p, dv), "state"), ("B", notes, "reason"), ("C", found, "severity"))
    a, b, c = (df.groupBy(F.lit(layer).alias("layer"), F.col(name).alias("state")).agg(F.count("*").alias("n")) for layer, df, name in parts)
    return a.unionByName(b).unionByName(c)


@query(_B + """SELECT count(*) FILTER (WHERE ambiguous) AS ambiguous, count(*) FILTER (WHERE note IS NULL) AS without_note, (SELECT count(*) FROM (SELECT max(score) AS s FROM sc GROUP BY pillar) WHERE s IS NULL) AS unscored,
(SELECT count(*) FROM (SELECT variable_id, max_by(value IS NULL, order_index) AS u FROM va GROUP BY variable_id) WHERE u) AS undocumented, (SELECT count(*) FROM al WHERE severity = 'mineure') AS minor_alerts FROM nt""")
def report_limits(spark, sf_dir):
    _, p, dv, m = _layer_a(spark, sf_dir)
    s, notes, found, *_ = _layer_c(spark, sf_dir)
    return judgements.report_limits(layer_a.variables(m, p, dv), s, notes, found)


@query(_B + "SELECT segment_id, min(place) AS place FROM (SELECT DISTINCT segment_id, 1 AS place FROM es UNION SELECT segment_id, 2 FROM ce) GROUP BY segment_id")
def segments_to_read(spark, sf_dir):
    """Segments of variables' evidence, then those of criteria; each once, where it is met first."""
    _, _, dv, m = _layer_a(spark, sf_dir)
    candidates, a, _ = _layer_b(spark, sf_dir)
    both = layer_a.evidence(m, dv).select("segment_id", F.lit(1).alias("place")).unionByName(assessment.criterion_evidence(candidates, a).select("segment_id", F.lit(2).alias("place")))
    return both.groupBy("segment_id").agg(F.min("place").alias("place"))


@query(_B + """SELECT rule, severity, pillar, order_index, criterion, CAST(row_number() OVER (ORDER BY severity <> 'majeure', rule, pillar, order_index, criterion) AS INTEGER) AS place FROM al""")
def alerts_ordered(spark, sf_dir):
    found = _layer_c(spark, sf_dir)[2]
    return assessment.placed(found).select("rule", "severity", "pillar", "order_index", "criterion", "place")


@query("""SELECT n_nationkey, n_name, coalesce(r_name, '—') AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 3""")
def labels_with_default(spark, sf_dir):
    r = table(spark, sf_dir, "region").where("r_regionkey <> 3")
    return table(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("—")).alias("region"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def shared_nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("""SELECT n_nationkey, string_agg(t, ',' ORDER BY t) AS terms FROM (SELECT n_nationkey, unnest(list_distinct([n_name, left(n_name, 2), 'N' || n_nationkey, n_name])) AS t FROM nation) GROUP BY n_nationkey""")
def known_terms(spark, sf_dir):
    terms = F.array_union(F.array_union(F.array("n_name"), F.array(F.substring("n_name", 1, 2))), F.array(F.concat(F.lit("N"), "n_nationkey"), F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.array_sort(terms), ",").alias("terms"))


@query("SELECT user_id, least(count(*), 3) AS recent FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def recent_counts(spark, sf_dir):
    recent = table(spark, sf_dir, "events").where(F.col("ts").cast("timestamp_ntz") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return recent.groupBy("user_id").agg(F.least(F.count("*"), F.lit(3).cast("bigint")).alias("recent"))


@query("""SELECT event_id, event_type IN ('error', 'signup') AS retried, event_type = 'purchase' AS abandoned FROM events""")
def retry_classes(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", e.isin("error", "signup").alias("retried"), e.isin("purchase").alias("abandoned"))


@query("""SELECT s.vec_id AS segment_id, s.label AS model FROM embeddings s WHERE s.label <> 3""")
def stale_vectors(spark, sf_dir):
    """Rows whose model (their label) is not the current one: what a re-index has to write again."""
    return table(spark, sf_dir, "embeddings").where("label <> 3").select(F.col("vec_id").alias("segment_id"), F.col("label").alias("model"))


@query(_B + """SELECT line FROM (SELECT concat_ws(';', 'A', pillar, order_index, coalesce(replace(CAST(CAST(score AS DECIMAL(18,2)) AS VARCHAR), '.', ','), ''), coalesce(replace(CAST(CAST(confidence AS DECIMAL(18,4)) AS VARCHAR), '.', ','), ''), documented, '', '') AS line FROM sc
UNION ALL SELECT concat_ws(';', 'B', criterion, '', coalesce(replace(CAST(CAST(note AS DECIMAL(18,1)) AS VARCHAR), '.', ','), ''), '', documented, reason, CASE WHEN ambiguous THEN 'oui' ELSE '' END) FROM nt
UNION ALL SELECT concat_ws(';', 'C', pillar, order_index, coalesce(CAST(criterion AS VARCHAR), ''), replace(CAST(CAST(confidence AS DECIMAL(18,4)) AS VARCHAR), '.', ','), '', rule, severity) FROM al)""")
def report_csv_lines(spark, sf_dir):
    """The eight columns of the CSV report as lines: layer, item, version, value, confidence, documented, reason or rule, remark."""
    s, notes, found, *_ = _layer_c(spark, sf_dir)
    dec = lambda c, d: F.coalesce(F.replace(F.col(c).cast(f"decimal(18,{d})").cast("string"), F.lit("."), F.lit(",")), F.lit(""))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = F.lit("")
    line = lambda *c: F.concat_ws(";", *[text.csv_cell(x) for x in c]).alias("line")
    a = s.select(line(F.lit("A"), own("pillar"), own("order_index"), dec("score", 2), dec("confidence", 4), own("documented"), none, none))
    b = notes.select(line(F.lit("B"), own("criterion"), none, dec("note", 1), none, own("documented"), own("reason"), F.when(F.col("ambiguous"), "oui").otherwise("")))
    return a.union(b).union(found.select(line(F.lit("C"), own("pillar"), own("order_index"), own("criterion"), dec("confidence", 4), none, own("rule"), own("severity"))))
