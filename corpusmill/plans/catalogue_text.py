"""Queries of text functions: normal forms, phrases, votes, citations, windows, formats. Imported for its effect on the catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import numbers, text
from corpusmill.operators import decisions, ingestion, ordered
from corpusmill.plans.catalogue import query
from corpusmill.sources.tables import table

_NORM = r"trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_NORM}) AS norm_sha256 FROM documents")
def normalised_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalised("text"), 256).alias("norm_sha256"))


#: Terms of the tables' invented prose.
PHRASES = ("of the", "the", "la", "und der", "de la")
FINANCIERS, THEMES, OFF_TOPIC = ("THE", "LA", "Of the", "UE", "und die"), {"articles": ("the", "la", "der"), "links": ("of the", "de la", "und der"), "none": ("zzz",)}, ("by the", "et le", "in the")


@query(f"""WITH n AS (SELECT doc_id, ' ' || {_NORM} || ' ' AS t FROM documents) SELECT doc_id, p AS phrase, contains(t, ' ' || p || ' ') AS found,
CAST((length(t) - length(replace(t, ' ' || p || ' ', ''))) / (length(p) + 2) AS INTEGER) AS n FROM n, (SELECT unnest({list(PHRASES)}) AS p)""")
def phrase_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalised("text").alias("t"))
    each = F.array(*[F.struct(F.lit(p).alias("phrase"), text.contains_phrase(F.col("t"), p).alias("found"), text.count_phrase(F.col("t"), p).alias("n")) for p in PHRASES])
    return d.select("doc_id", F.inline(each))


@query(rf"""WITH n AS (SELECT doc_id, text, ' ' || {_NORM} || ' ' AS t, ' ' || {_NORM.replace('text', 'left(text, 6000)')} || ' ' AS h FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9])LA([^A-Za-z0-9]|$)') THEN 'LA' END, CASE WHEN contains(t, ' of the ') THEN 'Of the' END,
CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9])THE([^A-Za-z0-9]|$)') THEN 'THE' END, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9])UE([^A-Za-z0-9]|$)') THEN 'UE' END, CASE WHEN contains(t, ' und die ') THEN 'und die' END) AS financiers,
concat_ws(',', CASE WHEN contains(t, ' the ') OR contains(t, ' la ') OR contains(t, ' der ') THEN 'articles' END, CASE WHEN contains(t, ' of the ') OR contains(t, ' de la ') OR contains(t, ' und der ') THEN 'links' END) AS themes,
concat_ws(',', CASE WHEN contains(h, ' by the ') OR (length(t) - length(replace(t, ' by the ', ''))) / 8 >= 3 THEN 'by the' END, CASE WHEN contains(h, ' et le ') OR (length(t) - length(replace(t, ' et le ', ''))) / 7 >= 3 THEN 'et le' END,
CASE WHEN contains(h, ' in the ') OR (length(t) - length(replace(t, ' in the ', ''))) / 8 >= 3 THEN 'in the' END) AS off_topic FROM n""")
def signals(spark, sf_dir):
    """The head of a text is its first 6,000 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.normalised("text").alias("t"), text.normalised(F.substring("text", 1, 6000)).alias("h"))
    found = decisions.signals(F.col("text"), F.col("t"), F.col("h"), FINANCIERS, THEMES, OFF_TOPIC)
    return d.select("doc_id", *[F.array_join(c, ",").alias(name) for name, c in found.items()])


#: Nations have their name, and as alias the second to (2 + key % 3)th word of the document of their key, in its language.
_NAMES = rf"""n AS (SELECT doc_id, {_NORM} AS norm FROM documents), al AS (SELECT n_nationkey AS place, lower(replace(n_name, '_', ' ')) AS name, 'N' || n_nationkey AS code FROM nation
UNION ALL SELECT 100 + n_nationkey, array_to_string(string_split(norm, ' ')[2:2 + n_nationkey % 3], ' '), 'N' || n_nationkey FROM nation JOIN n ON doc_id = n_nationkey),
na AS (SELECT name, arg_min(code, place) AS code FROM al WHERE length(name) >= 4 GROUP BY name),
pa AS (SELECT '\b(' || string_agg(name, '|' ORDER BY len(string_split(name, ' ')) DESC, name) || ')\b' AS p FROM na)"""


def _country_names(spark, sf_dir):
    key, words = F.col("n_nationkey"), F.split(text.normalised("text"), " ")
    nation, code = table(spark, sf_dir, "nation"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("code")
    alias = nation.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n_nationkey"), "text"), "n_nationkey")
    alias = alias.select((key + 100).alias("place"), F.array_join(F.slice(words, F.lit(2), (1 + key % 3).cast("int")), " ").alias("name"), code)
    return ingestion.names_of(nation.select(key.alias("place"), F.col("n_name").alias("name"), code).union(alias))


@query("WITH " + _NAMES + """, m AS (SELECT doc_id, unnest(regexp_extract_all(norm, p)) AS name, generate_subscripts(regexp_extract_all(norm, p), 1) AS pos FROM n, pa),
c AS (SELECT doc_id, code AS country, count(*) AS n, min(pos) AS met FROM m JOIN na USING (name) GROUP BY ALL),
w AS (SELECT doc_id, country, CAST(round_even(CAST(n / sum(n) OVER (PARTITION BY doc_id) AS DECIMAL(30,12)), 4) AS DOUBLE) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, met) = 1)
SELECT doc_id, country, coalesce(confidence, 0) AS confidence FROM n LEFT JOIN w USING (doc_id)""")
def country_vote(spark, sf_dir):
    """The country of each document by the names in it, nations' names and aliases in four languages; NULL without a name."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalised("text").alias("norm"))
    return ingestion.decided(d, ingestion.gazetteer(d, _country_names(spark, sf_dir)), "country")


@query("""WITH n AS (SELECT doc_id, CAST(ceil(length(text) / 100.0) AS INTEGER) AS n FROM documents), i AS (SELECT doc_id, n, CAST(unnest(range(least(n, 20))) AS INTEGER) AS i FROM n)
SELECT DISTINCT doc_id, CASE WHEN n <= 20 THEN i * 100 ELSE (i * n // 20) * 100 END AS start FROM i""")
def vote_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    return d.select("doc_id", F.explode(ingestion.vote_starts(F.col("size"), 100)).alias("start"))


@query(r"""WITH c AS (SELECT conv_id, string_agg(text, chr(10) || ' ' || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, unnest(regexp_split_to_array(t, '\n\s*\n')) AS p FROM c)
SELECT conv_id, count(*) AS paragraphs, CAST(sum(length(trim(p))) AS BIGINT) AS chars FROM p WHERE trim(p) <> '' GROUP BY conv_id""")
def paragraphs(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    whole = pages.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n \n").alias("text"))
    parts = whole.select("conv_id", F.explode(text.paragraphs("text")).alias("p"))
    return parts.groupBy("conv_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS t FROM documents), h AS (SELECT doc_id, t, left(t, 119) AS h, strpos(reverse(left(t, 119)), ' ') AS back FROM s)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN back > 0 AND 119 - back > 60 THEN rtrim(left(h, 119 - back)) || '…' ELSE rtrim(h) || '…' END AS short FROM h""")
def short_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened("text", 120).alias("short"))


_CITED = "'Claim [E' || (o_orderkey % 5 + 1) || '.' || (o_custkey % 3 + 1) || ', E' || (o_custkey % 7 + 1) || '] and more [E' || (o_orderkey % 4 + 1) || '; E9.1] end [x] [E0a]'"
_REFS = rf"""WITH t AS (SELECT o_orderkey, {_CITED} AS t FROM orders), b AS (SELECT o_orderkey, list_transform(regexp_extract_all(t, '\[(E\d+(\.\d+)?(\s*[,;]\s*E\d+(\.\d+)?)*)\]', 1), lambda x: regexp_split_to_array(x, '[,;]')) AS b FROM t),
r AS (SELECT o_orderkey, trim(unnest(flatten(b))) AS ref, generate_subscripts(flatten(b), 1) AS seq FROM b)
"""


def _cited(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CITED).alias("t"))
    return o.select("o_orderkey", F.posexplode(text.references("t")).alias("seq", "ref")).withColumn("seq", F.col("seq") + 1)


@query(_REFS + "SELECT o_orderkey, CAST(seq AS INTEGER) AS seq, ref FROM r")
def cited_references(spark, sf_dir):
    return _cited(spark, sf_dir)


@query(_REFS + """, k AS (SELECT o_orderkey, split_part(ref, '.', 1) AS excerpt, min(seq) AS met FROM r WHERE CAST(substr(split_part(ref, '.', 1), 2) AS INTEGER) <= 1 + o_orderkey % 6 GROUP BY ALL)
SELECT o_orderkey, excerpt, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY met) AS INTEGER) AS number FROM k""")
def cited_sources(spark, sf_dir):
    """Only the first excerpts are offered: E1 to E6, by the order's key."""
    offered = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), (1 + F.col("o_orderkey") % 6).cast("int"))).alias("e"))
    offered = offered.select("o_orderkey", F.concat(F.lit("E"), "e").alias("excerpt"))
    cited = _cited(spark, sf_dir).withColumn("excerpt", F.substring_index("ref", ".", 1)).join(offered, ["o_orderkey", "excerpt"], "left_semi")
    return ordered.numbered(cited, "o_orderkey", "excerpt", "seq")


@query(r"SELECT o_orderkey, regexp_replace(t, '⟦\d+(,\d+)*⟧', '', 'g') AS plain FROM (SELECT o_orderkey, 'a⟦' || o_custkey || ',2⟧ b⟦⟧ c⟦' || o_orderkey || '⟧' AS t FROM orders)")
def plain_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.plain(F.expr("'a⟦' || o_custkey || ',2⟧ b⟦⟧ c⟦' || o_orderkey || '⟧'")).alias("plain"))


_SET = r"list_distinct(list_filter(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'), lambda x: length(x) > 2))"


@query(f"""WITH q AS (SELECT list_distinct(flatten(list({_SET}))) AS q FROM benchmark), t AS (SELECT doc_id, {_SET} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_intersect(t, q)) AS INTEGER) AS shared FROM t, q""")
def token_overlap(spark, sf_dir):
    """Tokens of each document, and how many of them the benchmark has: an intersection by a join of exploded tokens."""
    t = table(spark, sf_dir, "documents").select("doc_id", text.token_set("text").alias("t"))
    q = table(spark, sf_dir, "benchmark").select(F.explode(text.token_set("text")).alias("w")).distinct()
    shared = t.select("doc_id", F.explode("t").alias("w")).join(q, "w", "left_semi").groupBy("doc_id").agg(F.count("*").cast("int").alias("shared"))
    return t.select("doc_id", F.size("t").alias("tokens")).join(shared, "doc_id", "left").fillna(0, ["shared"])


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT doc_id, w, CAST(unnest(range(greatest(1, CAST(ceil(len(w) / 64.0) AS BIGINT)))) AS INTEGER) AS i FROM w)
SELECT doc_id, i AS "window", sha256(array_to_string(w[i * 64 + 1 : i * 64 + 64], ' ')) AS text_sha256 FROM i""")
def word_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.windows("text", 64)).alias("window", "w"))
    return d.select("doc_id", "window", F.sha2("w", 256).alias("text_sha256"))


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 101) / 100.0 END AS p FROM customer)
SELECT c_custkey, coalesce(replace(CAST(CAST(round_even(CAST(v AS DECIMAL(30,12)), 2) AS DECIMAL(30,2)) AS VARCHAR), '.', ','), '—') AS number, CASE WHEN v > 0 THEN '+' ELSE '' END || coalesce(CAST(CAST(round_even(CAST(v AS DECIMAL(30,12)), 0) AS BIGINT) AS VARCHAR), '—') AS signed,
CASE WHEN p IS NULL THEN '—' ELSE CAST(CAST(round_even(CAST(p * 100 AS DECIMAL(30,12)), 0) AS BIGINT) AS VARCHAR) || chr(8239) || '%' END AS percent FROM x""")
def number_formats(spark, sf_dir):
    known = F.col("c_custkey") % 9 != 0
    v, p = F.when(known, F.col("c_acctbal")), F.when(known, (F.col("c_custkey") % 101) / 100)
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.number(v, 2, comma=True).alias("number"), numbers.signed(v).alias("signed"), numbers.percent(p, narrow=True).alias("percent"))


_SPANS = "(o_orderkey % 90) || '-' || (o_orderkey % 90 + o_custkey % 40) || ',' || (o_custkey % 200 + 100) || CASE WHEN o_orderkey % 13 = 0 THEN '-x' ELSE '-400' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_SPANS} AS s FROM orders), p AS (SELECT o_orderkey, unnest(string_split(s, ',')) AS p FROM s WHERE s NOT LIKE '%x' )
SELECT o_orderkey, CAST(split_part(p, '-', 1) AS INTEGER) AS start, CAST(split_part(p, '-', 2) AS INTEGER) AS "end" FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p WHERE CAST(split_part(p, '-', 1) AS INTEGER) >= CAST(split_part(p, '-', 2) AS INTEGER))""")
def parsed_spans(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(text.parsed_spans(F.expr(_SPANS))))


_IP = "CASE user_id % 4 WHEN 0 THEN '10.0.' || user_id % 256 || '.7' WHEN 1 THEN '2001:db8:' || user_id % 10 || ':1:0:0:0:' || event_id % 10 WHEN 2 THEN '300.1.2.3' ELSE 'host' END"


@query(f"SELECT event_id, CASE user_id % 4 WHEN 0 THEN '10.0.' || user_id % 256 || '.7' WHEN 1 THEN '2001:db8:' || user_id % 10 || ':1::/64' ELSE 'unknown' END AS client FROM events")
def client_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.client_key(F.expr(_IP)).alias("client"))


@query("""SELECT c_custkey, 'Programme ' || lower(c_mktsegment) || ' en ' || coalesce(n_name, '—') || ', financé par ' || CASE WHEN c_custkey % 3 = 0 THEN 'non précisé' ELSE 'A, B' END || CASE WHEN c_custkey % 2 = 0 THEN ', années 2020-2024' ELSE '' END || ', langues FR, EN' AS text
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0""")
def fingerprint_texts(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(names), "c_nationkey", "left")
    c = c.withColumns({"financiers": F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B"))), "years": F.when(F.col("c_custkey") % 2 == 0, "2020-2024")})
    return c.select("c_custkey", text.fingerprint(F.lower("c_mktsegment"), F.col("country"), F.col("financiers"), F.col("years"), F.array(F.lit("fr"), F.lit("en"))).alias("text"))


@query("SELECT doc_id, CAST(len(w) AS INTEGER) AS words, sha256(array_to_string(list_sort(w), ' ')) AS words_sha256 FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents)")
def vocabularies(spark, sf_dir):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("words"), F.sha2(F.array_join(F.array_sort("w"), " "), 256).alias("words_sha256"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey // 10 AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS k FROM d), r AS (SELECT l_suppkey, min(n) AS low, max(n) AS high FROM i GROUP BY l_suppkey, k)
SELECT l_suppkey, string_agg(CASE WHEN high - low >= 2 THEN '[' || low || '–' || high || ']' WHEN high > low THEN '[' || low || '] [' || high || ']' ELSE '[' || low || ']' END, ' ' ORDER BY low) AS label FROM r GROUP BY l_suppkey""")
def reference_labels(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor(F.col("l_partkey") / 10).cast("bigint").alias("n"))
    return ordered.joined_ranges(ordered.reference_ranges(n, "l_suppkey", "n"), "l_suppkey")


@query("""SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY met, l_suppkey) AS "values" FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS met FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def suppliers_first_seen(spark, sf_dir):
    return ordered.first_seen(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS place FROM (SELECT DISTINCT doc_id, source, lang, n_chars FROM documents))
SELECT source, lang, doc_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""")
def excerpts_of_notes(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").distinct().withColumn("place", place).where("place <= 2").select("source", "lang", "doc_id", "place")
