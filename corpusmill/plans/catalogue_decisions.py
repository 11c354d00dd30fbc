"""Queries of language decisions, re-indexed vectors, report limits and stored answers. Imported for its effect on the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import interpretations, judgements, language, layer_a, passages
from corpusmill.plans.catalogue import _layer_a, query
from corpusmill.plans.catalogue_assess import _B, _layer_c
from corpusmill.plans.catalogue_text import _NORM
from corpusmill.sources import ledger, reindex
from corpusmill.sources.tables import place, spread, table


_PADDED = f"' ' || {_NORM} || ' ' AS p"
_RUNS = "unnest(list_transform(range(1, length(p) - 1), lambda i: p[i:i + 2])) AS gram"
_LANGUAGE = f"""WITH t AS (SELECT lang, {_RUNS} FROM (SELECT lang, {_PADDED} FROM documents WHERE lang IS NOT NULL)), c AS (SELECT lang, gram, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), k AS (SELECT DISTINCT gram FROM c), w AS (SELECT gram, l.lang, ln((coalesce(n, 0) + 1) / (total + (SELECT count(*) FROM k))) AS w FROM k CROSS JOIN l LEFT JOIN c USING (lang, gram)),
sa AS (SELECT doc_id, -1 AS no, substr(text, 1, 10000) AS text FROM documents UNION ALL SELECT doc_id, i, substr(text, 1 + 5000 * CASE WHEN n <= 20 THEN i ELSE i * n // 20 END, 5000) FROM
  (SELECT doc_id, text, n, CAST(unnest(range(least(n, 20))) AS INTEGER) AS i FROM (SELECT doc_id, text, CAST(ceil(length(text) / 5000.0) AS INTEGER) AS n FROM documents))),
g AS (SELECT doc_id, no, {_RUNS} FROM (SELECT doc_id, no, {_PADDED} FROM sa WHERE length(trim(text)) >= 20)),
s AS (SELECT doc_id, no, lang, sum(w) AS ll FROM g JOIN w USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, no, arg_max(lang, ll) AS lang, 1 / sum(exp(ll - m)) AS prob FROM (SELECT *, max(ll) OVER (PARTITION BY doc_id, no) AS m FROM s) GROUP BY ALL),
v AS (SELECT doc_id, lang, count(*) AS n, min(no) AS met FROM b WHERE no >= 0 GROUP BY ALL),
vo AS (SELECT doc_id, lang, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, met) = 1)
"""


@query(_LANGUAGE + """SELECT d.doc_id, CASE WHEN coalesce(h.prob, 0) >= 0.7 OR vo.lang IS NULL THEN h.lang ELSE vo.lang END AS lang,
CAST(round_even(CAST(coalesce(CASE WHEN coalesce(h.prob, 0) >= 0.7 OR vo.lang IS NULL THEN h.prob ELSE share END, 0) AS DECIMAL(30,12)), 4) AS DOUBLE) AS confidence
FROM documents d LEFT JOIN b h ON h.doc_id = d.doc_id AND h.no = -1 LEFT JOIN vo ON vo.doc_id = d.doc_id""")
def language_decision(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return language.decided(spread(d.select("doc_id", "text")), language.model(d.select("lang", "text")))


@query("""SELECT doc_id AS segment_id, 'm1' AS model, CAST(length(text) AS DOUBLE) AS size, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS run FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 5 = 0""")
def reindexed_vectors(spark, sf_dir):
    """Documents indexed, then every fifth changed and every eleventh of the others gone: the second run writes these alone."""
    d, log = table(spark, sf_dir, "documents"), ledger.Ledger(spark, place(spark, "index"))
    embed = lambda t: t.select("text", F.array(F.length("text").cast("double")).alias("vector"))
    key = F.col("doc_id")
    reindex.reindex(log, d.select(key.alias("segment_id"), "text"), embed, "m1")
    first = log.version()
    changed = d.where((key % 11 != 0) | (key % 5 == 0)).select(key.alias("segment_id"), F.when(key % 5 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"))
    reindex.reindex(log, changed, embed, "m1")
    # A text that reads alike both ways isn't changed, but none of the tables is.
    return reindex.indexed(log).select("segment_id", "model", F.col("vector")[0].alias("size"), F.when(F.col("pass") > first, 2).otherwise(1).alias("run"))


@query(_B + """, va2 AS (SELECT variable_id, max_by(value IS NULL, order_index) AS empty FROM va GROUP BY variable_id), sc2 AS (SELECT pillar, max_by(score IS NULL, order_index) AS empty, max_by(confidence, order_index) AS confidence FROM sc GROUP BY pillar),
r AS (SELECT 1 AS place, 'not_concluded' AS kind, count(*) FILTER (reason <> 'concluded') AS n, count(*) AS total FROM nt UNION ALL SELECT 2, 'ambiguous', count(*) FILTER (ambiguous), count(*) FROM nt
UNION ALL SELECT 3, 'confidence', CAST(round_even(CAST(avg(confidence) * 100 AS DECIMAL(30,10)), 0) AS BIGINT), count(*) FROM sc2 UNION ALL SELECT 4, 'unscored', count(*) FILTER (empty), count(*) FROM sc2
UNION ALL SELECT 5, 'undocumented', count(*) FILTER (empty), count(*) FROM va2 UNION ALL SELECT 6, 'pending', count(*) FILTER ((pillar + order_index) % 2 = 0), count(*) FROM al UNION ALL SELECT 7, 'unqualified', count(*) FILTER (pillar % 3 = 0), count(*) FROM al)
SELECT place, kind, n, total FROM r WHERE total > 0 AND (n > 0 OR kind = 'confidence')""")
def report_limit_lines(spark, sf_dir):
    """Alerts of an even pillar and version are pending, those of every third pillar not qualified."""
    _, p, dv, m = _layer_a(spark, sf_dir)
    s, notes, found, *_ = _layer_c(spark, sf_dir)
    alerts = found.select(((F.col("pillar") + F.col("order_index")) % 2 == 0).alias("pending"), (F.col("pillar") % 3 != 0).alias("qualified"))
    return judgements.limit_lines(layer_a.variables(m, p, dv), s, notes, alerts)


def _head(limit: str, size: int) -> str:
    """The first size - 1 characters besides numbers, in two steps, as a repetition has 1,000 at most."""
    one = "(?:(?:⟦[0-9]+⟧)*[^⟦])"
    return f"regexp_extract({limit}, '^({one}{{{(size - 1) // 2}}}{one}{{{size - 1 - (size - 1) // 2}}})', 1)"


_PLAIN = lambda x: f"regexp_replace({x}, '⟦[0-9]+⟧', '', 'g')"
#: Turns are items of an answer: its text, mostly with references, and a translation of every second one.
_ANSWERS = rf"""WITH tt AS (SELECT conv_id AS c, turn AS t, CASE turn % 3 WHEN 0 THEN 'segments' WHEN 1 THEN 'variables' ELSE 'pillars' END AS kind, text FROM conversations WHERE conv_id % 7 <> 3),
tx AS (SELECT c, t, kind, 0 AS version, text || CASE WHEN t % 6 = 0 THEN ' fin.' ELSE ' [E' || (t + 1) || '.1, E' || (t + 2) || '] fin (e' || (t + 2) || '.9).' END AS text FROM tt UNION ALL SELECT c, t, kind, 1, 'EN ' || text || ' (E' || (t + 1) || '.2; E' || (t + 2) || '.1).' FROM tt WHERE t % 2 = 0),
al AS (SELECT c, t, unnest(CASE kind WHEN 'segments' THEN [t + 1] WHEN 'variables' THEN [t + 1, t + 2] ELSE [t + 2] END) AS e FROM tt),
o AS (SELECT c, t, e, list_transform(range(1 + (c + e) % 3), lambda s: {{'a': s * w, 'z': s * w + 9}}) AS spans FROM (SELECT *, CASE WHEN e % 2 = 0 THEN 20 ELSE 10 END AS w FROM al)),
m AS (SELECT c, t, version, unnest(regexp_extract_all(text, '{passages.REFERENCES}', 1)) AS mark, generate_subscripts(regexp_extract_all(text, '{passages.REFERENCES}', 1), 1) AS i FROM tx),
r AS (SELECT c, t, version, i, unnest(regexp_split_to_array(mark, '[,;]')) AS ref, generate_subscripts(regexp_split_to_array(mark, '[,;]'), 1) AS j FROM m),
x AS (SELECT c, t, version, i, j, CAST(regexp_extract(ref, '(?i)E(\d+)', 1) AS BIGINT) AS e, TRY_CAST(regexp_extract(ref, '\.(\d+)', 1) AS INTEGER) AS n FROM r),
y AS (SELECT c, t, version, i, j, e, unnest(CASE WHEN n BETWEEN 1 AND len(spans) THEN [spans[n]] ELSE spans END) AS s FROM x JOIN o USING (c, t, e)),
z AS (SELECT *, CASE WHEN s.a <= max(s.z) OVER (PARTITION BY c, t, version, i, e ORDER BY s.a, s.z, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM y),
v AS (SELECT *, sum(opens) OVER (PARTITION BY c, t, version, i, e ORDER BY s.a, s.z, j ROWS UNBOUNDED PRECEDING) AS part FROM z),
q AS (SELECT c, t, version, i, e, part, min(j) AS j, min(s.a) AS a, max(s.z) AS z FROM v GROUP BY ALL),
f AS (SELECT c, t, version, i, min(j) AS j, 'E' || e || ':' || string_agg(a || '-' || z, ';' ORDER BY a) AS source FROM q GROUP BY c, t, version, i, e),
sp AS (SELECT c, t, kind, version, unnest(regexp_split_to_array(text, '{passages.REFERENCES}')) AS part, generate_subscripts(regexp_split_to_array(text, '{passages.REFERENCES}'), 1) AS i FROM tx),
pu AS (SELECT c, t, kind, version, trim(regexp_replace(string_agg(part || CASE WHEN (c, t, version, i) IN (SELECT (c, t, version, i) FROM f) THEN '⟦' || i || '⟧' ELSE '' END, '' ORDER BY i), '[ \t\n\r]+', ' ', 'g')) AS text FROM sp GROUP BY ALL),
hd AS (SELECT *, length({_PLAIN("text")}) > CASE kind WHEN 'pillars' THEN 1200 ELSE 850 END AS long, CASE WHEN kind = 'pillars' THEN {_head("text", 1200)} ELSE {_head("text", 850)} END AS head, CASE WHEN kind = 'pillars' THEN 600 ELSE 425 END AS half FROM pu),
cu AS (SELECT c, t, kind, version, CASE WHEN NOT long THEN text WHEN length({_PLAIN("regexp_extract(head, '^(.*) ', 1)")}) > half THEN rtrim(regexp_extract(head, '^(.*) ', 1)) || '…' ELSE rtrim(head) || '…' END AS text FROM hd),
lo AS (SELECT *, length(trim({_PLAIN("text")})) >= CASE kind WHEN 'pillars' THEN 250 ELSE 150 END AS ok FROM cu),
ke AS (SELECT * FROM lo WHERE (c, t) IN (SELECT (c, t) FROM lo WHERE version = 0 AND ok) AND (version = 0 OR ok OR kind = 'segments')),
mk AS (SELECT c, t, version, CAST(unnest(regexp_extract_all(text, '⟦([0-9]+)⟧', 1)) AS INTEGER) AS i FROM ke), us AS (SELECT f.* FROM f JOIN mk USING (c, t, version, i)),
nu AS (SELECT c, t, source, row_number() OVER (PARTITION BY c, t ORDER BY min((version, i, j))) AS number FROM us GROUP BY c, t, source),
nm AS (SELECT c, t, version, i, '⟦' || string_agg(number, ',' ORDER BY j) || '⟧' AS mark FROM us JOIN nu USING (c, t, source) GROUP BY ALL),
pp AS (SELECT c, t, kind, version, unnest(regexp_split_to_array(text, '⟦[0-9]+⟧')) AS part, unnest(list_concat(regexp_extract_all(text, '⟦([0-9]+)⟧', 1), ['0'])) AS i FROM ke),
pn AS (SELECT *, row_number() OVER (PARTITION BY c, t, version ORDER BY CASE WHEN i = '0' THEN 1000000 ELSE CAST(i AS INTEGER) END) AS k FROM pp),
fi AS (SELECT pn.c, pn.t, kind, pn.version, string_agg(part || coalesce(mark, ''), '' ORDER BY k) AS text FROM pn LEFT JOIN nm ON nm.c = pn.c AND nm.t = pn.t AND nm.version = pn.version AND nm.i = CAST(pn.i AS INTEGER) GROUP BY ALL),
ou AS (SELECT *, (SELECT string_agg(source, ',' ORDER BY number) FROM nu WHERE nu.c = fi.c AND nu.t = fi.t) AS sources FROM fi)
SELECT c AS batch, kind, CAST(t AS INTEGER) AS turn, version, sha256(CASE WHEN sources IS NULL THEN regexp_replace(text, '\s*[.!?…]*\s*$', '') || '⟦1⟧' || regexp_extract(text, '([.!?…]*)\s*$', 1) ELSE text END) AS text_sha256,
coalesce(sources, (SELECT max('E' || e || ':' || CASE WHEN e % 2 = 1 THEN '0-' || (len(spans) * 10 - 1) ELSE array_to_string(list_transform(spans, lambda s: s.a || '-' || s.z), ';') END) FROM o WHERE o.c = ou.c AND o.t = ou.t)) AS sources
FROM ou WHERE sources IS NOT NULL OR kind = 'segments'"""


@query(_ANSWERS)
def reading_interpretation(spark, sf_dir):
    """Conversations are answers, as JSON; those of every seventh are cut off. An excerpt of an even number has sentences that don't touch."""
    t = F.col("turn")
    kind = F.when(t % 3 == 0, "segments").when(t % 3 == 1, "variables").otherwise("pillars").alias("kind")
    ref = lambda n, part="": F.concat(F.lit("E"), (t + n).cast("string"), F.lit(part))
    own = F.concat("text", F.when(t % 6 == 0, " fin.").otherwise(F.concat(F.lit(" ["), ref(1, ".1, "), ref(2), F.lit("] fin ("), F.lower(ref(2)), F.lit(".9)."))))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch"), "turn", kind, F.concat(F.lit(" i"), t.cast("string")).alias("item"), own.alias("own"), F.when(t % 2 == 0, F.concat(F.lit("EN "), "text", F.lit(" ("), ref(1, ".2; "), ref(2, ".1)."))).alias("en"))
    texts = lambda kind, of: F.map_from_entries(F.collect_list(F.when((F.col("kind") == kind) & F.col(of).isNotNull(), F.struct("item", of))))
    of_all = lambda of: F.struct(*[texts(k, of).alias(k) for k in ("segments", "variables", "pillars")])
    stored = c.groupBy("batch").agg(of_all("own").alias("o"), of_all("en").alias("en"))
    whole = F.to_json(F.struct("o.segments", "o.variables", "o.pillars", F.struct("en").alias("translations")))
    stored = stored.select("batch", F.when(F.col("batch") % 7 == 3, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole).alias("answer"), F.array(F.lit("en"), F.lit("es")).alias("locales"))
    allowed = F.when(t % 3 == 0, F.array(t + 1)).when(t % 3 == 1, F.array(t + 1, t + 2)).otherwise(F.array(t + 2))
    subjects = c.select("batch", "kind", F.upper(F.trim("item")).alias("item"), allowed.alias("allowed"))
    n, w = (F.col("batch") + F.col("excerpt")) % 3, F.when(F.col("excerpt") % 2 == 0, 20).otherwise(10)
    spans = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda s: F.struct((s * w).alias("start"), (s * w + 9).alias("end")))
    excerpts = subjects.select("batch", F.explode("allowed").alias("excerpt")).distinct().select("batch", "excerpt", spans.alias("spans"))
    found, sources = interpretations.interpreted(interpretations.answers(stored), subjects, excerpts)
    name = F.concat(F.lit("E"), F.col("excerpt").cast("string"), F.lit(":"), F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ";"))
    names = sources.groupBy("batch", "kind", "item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", name.alias("name")))), lambda x: x["name"]), ",").alias("sources"))
    return found.join(names, ["batch", "kind", "item"]).select("batch", "kind", F.substring("item", 2, 9).cast("int").alias("turn"), "version", F.sha2("text", 256).alias("text_sha256"), "sources")


_STATUS = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ['conforme', 'a_verifier', 'non_conforme', 'integre_decision_humaine'][1 + doc_id % 4] END"


@query(f"SELECT source, count(*) AS documents, count(*) FILTER ({_STATUS} IN ('conforme', 'integre_decision_humaine')) AS indexed FROM documents GROUP BY source")
def indexed_documents(spark, sf_dir):
    """Statuses by id; every eleventh document has none."""
    key = F.col("doc_id")
    status = F.when(key % 11 != 0, F.get(F.array(*map(F.lit, ("conforme", "a_verifier", "non_conforme", "integre_decision_humaine"))), (key % 4).cast("int")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(judgements.index_eligible(status)).alias("indexed"))


@query("""WITH l AS (SELECT user_id, event_type, arg_max(CASE WHEN event_id % 3 = 0 THEN 'skipped' ELSE 'done' END, event_id) AS status FROM events GROUP BY ALL)
SELECT user_id AS run, coalesce(bool_and(status <> 'skipped') FILTER (event_type = 'click'), true) AS click, coalesce(bool_and(status <> 'skipped') FILTER (event_type = 'view'), true) AS view,
coalesce(bool_and(status <> 'skipped') FILTER (event_type = 'purchase'), true) AS purchase FROM l GROUP BY user_id""")
def available_layers(spark, sf_dir):
    """Users are runs, their events steps; every third is skipped."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("step"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "skipped").otherwise("done").alias("status"))
    return judgements.layers_available(e, e, ["click", "view", "purchase"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'Pays ' || n_name WHEN n_nationkey % 4 = 1 THEN lower(n_name) ELSE n_name END AS country
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def customer_countries(spark, sf_dir):
    """Nations of every third key have a name in French, some of the others a common one; codes come in lower case."""
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    countries = n.select(F.concat(F.lit("N"), key.cast("string")).alias("code"), F.col("n_name").alias("name"), F.when(key % 4 == 1, F.lower("n_name")).alias("common"))
    translations = n.select(F.lit("fr").alias("locale"), F.col("n_name").alias("name"), F.when(key % 3 == 0, F.concat(F.lit("Pays "), "n_name")).otherwise(F.col("n_name")).alias("translated"))
    codes = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("code"))
    return codes.join(judgements.country_names(codes.select("code").distinct(), countries, translations, "fr"), "code", "left").select("c_custkey", F.col("name").alias("country"))


#: Templates of the query: half of the rules have one in French.
_TEMPLATES = [("en", f"ALERT-0{i}", "{pillar}/{criterion}: {score} points, note {note}, {delta} points, confidence {confidence}%") for i in range(1, 7)] + [("fr", f"ALERT-0{i}", "{pillar}/{criterion} : {score} points ({confidence} %)") for i in range(1, 4)]


@query(_B + """SELECT al.rule, al.pillar, al.order_index, al.criterion, CASE WHEN al.rule <= 'ALERT-03' THEN al.pillar || '/' || coalesce(CAST(al.criterion AS VARCHAR), '') || ' : ' || CAST(CAST(round_even(CAST(al.score AS DECIMAL(30,12)), 0) AS BIGINT) AS VARCHAR) || ' points (' || CAST(round_even(CAST(al.confidence * 100 AS DECIMAL(30,12)), 0) AS BIGINT) || ' %)'
ELSE al.pillar || '/' || coalesce(CAST(al.criterion AS VARCHAR), '') || ': ' || CAST(CAST(round_even(CAST(al.score AS DECIMAL(30,12)), 0) AS BIGINT) AS VARCHAR) || ' points, note ' || coalesce(CAST(CAST(al.note AS DECIMAL(18,1)) AS VARCHAR), '') || ', ' || coalesce(CAST(CAST(round_even(CAST(ev.delta AS DECIMAL(30,12)), 0) AS BIGINT) AS VARCHAR), '') || ' points, confidence ' || CAST(round_even(CAST(al.confidence * 100 AS DECIMAL(30,12)), 0) AS BIGINT) || '%' END AS message
FROM al JOIN ev ON ev.pillar = al.pillar AND ev.order_index = al.order_index""")
def alert_messages(spark, sf_dir):
    s, _, found, *_ = _layer_c(spark, sf_dir)
    alerts = found.select("rule", "pillar", "order_index", "criterion", "score", "note", "confidence").join(s.select("pillar", "order_index", "delta"), ["pillar", "order_index"])
    return judgements.default_messages(alerts, spark.createDataFrame(_TEMPLATES, "locale string, rule string, template string"), "fr").select("rule", "pillar", "order_index", "criterion", "message")
