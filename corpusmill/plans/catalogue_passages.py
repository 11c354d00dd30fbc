"""Queries of sentences, citations, line ends, alignments, framework rules and call packing. Imported for its effect on the catalogue."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import frameworks, ingestion, passages
from corpusmill.plans.catalogue import query
from corpusmill.plans.catalogue_assess import _batches
from corpusmill.plans.catalogue_text import _CITED, _NORM
from corpusmill.sources.tables import spread, table


# Fixed values of the sentences, for their oracle.
_SHORT = "|".join(map(re.escape, sorted(passages.SHORT_FORMS, key=len, reverse=True)))
_SENTENCES = rf"""WITH RECURSIVE m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n(\s*\n)', chr(1) || chr(10) || '\1', 'g'), '\n(\s*{passages.POINT})', chr(1) || chr(10) || '\1', 'g'),
  '({passages.STOPS}+{passages.CLOSERS}*)(\s+{passages.BEGINS})', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS piece, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM m),
c AS (SELECT *, NOT regexp_matches(piece, '(?i)(^|\s)({_SHORT}|\p{{L}}|\d{{1,2}})\.{passages.STOPS}*{passages.CLOSERS}*$') OR regexp_matches(lead(piece, 1, '') OVER w, '^\n(\s*\n|\s*{passages.POINT})') AS closes FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
g AS (SELECT doc_id, k, piece, coalesce(sum(closes::INT) OVER w, 0) AS g, coalesce(sum(length(piece)) OVER w, 0) AS at0 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT doc_id, min(at0) AS at0, string_agg(piece, '' ORDER BY k) AS raw FROM g GROUP BY doc_id, g),
b AS (SELECT doc_id, at0 + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS at0, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS body FROM n),
d AS (SELECT doc_id, at0, string_split(regexp_replace(body, ';(\s)', ';' || chr(1) || '\1', 'g'), chr(1)) AS parts FROM b WHERE length(body) > 500),
f AS (SELECT doc_id, at0, parts, 1 AS i, 0 AS cursor, length(parts[1]) AS now, CAST([] AS BIGINT[]) AS cuts FROM d
  UNION ALL SELECT doc_id, at0, parts, i + 1, CASE WHEN now - cursor >= 80 THEN now ELSE cursor END, now + length(parts[i + 1]), CASE WHEN now - cursor >= 80 THEN list_append(cuts, now) ELSE cuts END FROM f WHERE i < len(parts)),
u AS (SELECT doc_id, at0, list_concat([0], cuts) AS a, list_concat(cuts, [now]) AS z, array_to_string(parts, '') AS body FROM f WHERE i = len(parts)),
y AS (SELECT doc_id, at0, body FROM b WHERE length(body) BETWEEN 1 AND 500 UNION ALL SELECT doc_id, at0 + x, body[x + 1 : y] FROM (SELECT doc_id, at0, body, unnest(a) AS x, unnest(z) AS y FROM u)),
se AS (SELECT doc_id, CAST(at0 + length(body) - length(regexp_replace(body, '^\s+', '')) AS INTEGER) AS "start", regexp_replace(body, '^\s+|\s+$', '', 'g') AS s FROM y),
ss AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start") - 1 AS INTEGER) AS sentence, "start", CAST("start" + length(s) AS INTEGER) AS "end", s FROM se WHERE s <> ''),
cl AS (SELECT *, trim(regexp_replace(regexp_replace(s, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s+', ' ', 'g')) AS clean FROM ss)
"""


def _sentences(spark, sf_dir):
    return passages.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(_SENTENCES + 'SELECT doc_id, sentence, "start", "end" FROM ss')
def sentence_spans(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "sentence", "start", "end")


@query(_SENTENCES + """, us AS (SELECT *, coalesce(sum(length(clean) + 1) OVER (PARTITION BY doc_id ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM cl),
be AS (SELECT *, bool_or(sentence > 0 AND used + length(clean) > 400) OVER (PARTITION BY doc_id ORDER BY sentence) AS beyond FROM us)
SELECT doc_id, sentence, CASE WHEN length(clean) <= 400 THEN clean WHEN position(' ' IN reverse(clean[:399])) > 0 AND 399 - position(' ' IN reverse(clean[:399])) > 200 THEN clean[:399 - position(' ' IN reverse(clean[:399]))] || '…' ELSE rtrim(clean[:399]) || '…' END AS text FROM be WHERE NOT beyond""")
def first_sentences(spark, sf_dir):
    return passages.excerpts(_sentences(spark, sf_dir), "doc_id", 400).select("doc_id", "sentence", "text")


@query(_SENTENCES + """, ch AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence) AS r FROM ss WHERE sentence % 3 <> 2),
is_ AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sentence) AS part FROM (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY sentence) AS before FROM ch)),
sp AS (SELECT doc_id, min("start") AS a, max("end") AS z FROM is_ GROUP BY doc_id, part), pa AS (SELECT doc_id, a, trim(regexp_replace(regexp_replace(text[a + 1 : z], '([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS part FROM sp JOIN documents USING (doc_id))
SELECT doc_id, sha256(string_agg(part, ' … ' ORDER BY a)) AS text_sha256 FROM pa GROUP BY doc_id""")
def cited_passages(spark, sf_dir):
    """Every third sentence isn't cited."""
    spans = _sentences(spark, sf_dir).where("sentence % 3 <> 2").select("doc_id", "start", "end")
    return passages.passages(table(spark, sf_dir, "documents").select("doc_id", "text"), spans, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


#: Where each page of a conversation is cut in its first word of four letters and more: 'th-\nis'.
_BROKEN = r"regexp_replace(text, '^([^ ]*?[a-zà-ÿ]{2})([a-zà-ÿ]{2})', '\1-' || chr(10) || '\2')"


@query(f"SELECT conv_id, turn, sha256(text) AS text_sha256 FROM (SELECT conv_id, turn, text, {_BROKEN} AS broken FROM conversations)")
def dehyphenated_pages(spark, sf_dir):
    """Pages with a cut word: joined again, they are the pages before."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "^([^ ]*?[a-zà-ÿ]{2})([a-zà-ÿ]{2})", "$1-\n$2").alias("text"))
    words = c.select("conv_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]+(?:-[\\p{L}\\p{N}_]+)*"), 0))).alias("w")).distinct()
    return passages.rejoined(c, words, "conv_id", "turn").select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))


#: Excerpts E1 to E6 are offered to the text of an order, each of up to three sentences; those of even excerpts don't touch.
_OFFERED = "SELECT o_orderkey, excerpt, list_transform(range(1 + (o_custkey + excerpt) % 3), lambda s: {'a': s * w, 'z': s * w + 9}) AS spans FROM (SELECT o_orderkey, o_custkey, unnest(range(1, 2 + o_orderkey % 6)) AS excerpt FROM orders), LATERAL (SELECT CASE WHEN excerpt % 2 = 0 THEN 20 ELSE 10 END AS w)"
_SOURCES = rf"""WITH t AS (SELECT o_orderkey, {_CITED} AS t FROM orders), o AS ({_OFFERED}),
m AS (SELECT o_orderkey, unnest(regexp_extract_all(t, '{passages.REFERENCES}', 1)) AS mark, generate_subscripts(regexp_extract_all(t, '{passages.REFERENCES}', 1), 1) AS i FROM t),
r AS (SELECT o_orderkey, i, unnest(regexp_split_to_array(mark, '[,;]')) AS ref, generate_subscripts(regexp_split_to_array(mark, '[,;]'), 1) AS j FROM m),
x AS (SELECT o_orderkey, i, j, CAST(regexp_extract(ref, '(?i)E(\d+)', 1) AS BIGINT) AS excerpt, TRY_CAST(regexp_extract(ref, '\.(\d+)', 1) AS INTEGER) AS n FROM r),
y AS (SELECT o_orderkey, i, j, excerpt, unnest(CASE WHEN n BETWEEN 1 AND len(spans) THEN [spans[n]] ELSE spans END) AS s FROM x JOIN o USING (o_orderkey, excerpt)),
z AS (SELECT *, CASE WHEN s.a <= max(s.z) OVER (PARTITION BY o_orderkey, i, excerpt ORDER BY s.a, s.z, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM y),
v AS (SELECT *, sum(opens) OVER (PARTITION BY o_orderkey, i, excerpt ORDER BY s.a, s.z, j ROWS UNBOUNDED PRECEDING) AS part FROM z),
q AS (SELECT o_orderkey, i, excerpt, part, min(j) AS j, min(s.a) AS a, max(s.z) AS z FROM v GROUP BY ALL),
f AS (SELECT o_orderkey, i, min(j) AS j, 'E' || excerpt || ':' || string_agg(a || '-' || z, ';' ORDER BY a) AS source FROM q GROUP BY o_orderkey, i, excerpt),
u AS (SELECT o_orderkey, source, row_number() OVER (PARTITION BY o_orderkey ORDER BY min((i, j))) AS number FROM f GROUP BY o_orderkey, source),
k AS (SELECT o_orderkey, i, '⟦' || string_agg(number, ',' ORDER BY j) || '⟧' AS mark FROM f JOIN u USING (o_orderkey, source) GROUP BY o_orderkey, i),
e AS (SELECT o_orderkey, unnest(regexp_split_to_array(t, '{passages.REFERENCES}')) AS part, generate_subscripts(regexp_split_to_array(t, '{passages.REFERENCES}'), 1) AS i FROM t),
w AS (SELECT o_orderkey, string_agg(part || coalesce(mark, ''), '' ORDER BY i) AS text FROM e LEFT JOIN k USING (o_orderkey, i) GROUP BY o_orderkey)"""


@query(_SOURCES + " SELECT o_orderkey, text, coalesce(sources, '') AS sources FROM w LEFT JOIN (SELECT o_orderkey, string_agg(source, ',' ORDER BY number) AS sources FROM u GROUP BY o_orderkey) USING (o_orderkey)")
def cited_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), (1 + F.col("o_orderkey") % 6).cast("int"))).alias("excerpt"))
    w = F.when(F.col("excerpt") % 2 == 0, 20).otherwise(10)
    spans = F.transform(F.sequence(F.lit(0), ((F.col("o_custkey") + F.col("excerpt")) % 3).cast("int")), lambda s: F.struct((s * w).alias("start"), (s * w + 9).alias("end")))
    texts, sources = passages.cited(o.select("o_orderkey", F.expr(_CITED).alias("text")), n.select("o_orderkey", "excerpt", spans.alias("spans")), "o_orderkey")
    name = F.concat(F.lit("E"), "excerpt", F.lit(":"), F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ";"))
    names = sources.groupBy("o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", name.alias("name")))), lambda x: x["name"]), ",").alias("sources"))
    return texts.join(names, "o_orderkey", "left").select("o_orderkey", "text", F.coalesce("sources", F.lit("")).alias("sources"))


_VERSIONS = "SELECT o_orderkey, 0 AS version, 'B⟦' || (o_custkey % 4 + 1) || '⟧ puis A⟦' || (o_orderkey % 4 + 1) || ',' || (o_custkey % 3 + 1) || '⟧.' AS text FROM orders UNION ALL SELECT o_orderkey, 1, 'B⟦' || (o_orderkey % 3 + 1) || '⟧ then A⟦4⟧⟦9⟧.' FROM orders"


@query(f"""WITH t AS ({_VERSIONS}), m AS (SELECT o_orderkey, version, unnest(regexp_extract_all(text, '⟦([0-9,]+)⟧', 1)) AS mark, generate_subscripts(regexp_extract_all(text, '⟦([0-9,]+)⟧', 1), 1) AS i FROM t),
c AS (SELECT o_orderkey, version, i, unnest(string_split(mark, ',')) AS n, generate_subscripts(string_split(mark, ','), 1) AS j FROM m), k AS (SELECT * FROM c WHERE CAST(n AS INTEGER) <= 3),
o AS (SELECT o_orderkey, n, row_number() OVER (PARTITION BY o_orderkey ORDER BY min((version, i, j))) AS new FROM k GROUP BY o_orderkey, n),
d AS (SELECT o_orderkey, version, i, new, min(j) AS j FROM k JOIN o USING (o_orderkey, n) GROUP BY ALL), g AS (SELECT o_orderkey, version, i, '⟦' || string_agg(new, ',' ORDER BY j) || '⟧' AS mark FROM d GROUP BY ALL),
e AS (SELECT o_orderkey, version, unnest(regexp_split_to_array(text, '⟦[0-9,]+⟧')) AS part, generate_subscripts(regexp_split_to_array(text, '⟦[0-9,]+⟧'), 1) AS i FROM t),
w AS (SELECT o_orderkey, version, string_agg(part || coalesce(mark, ''), '' ORDER BY i) AS text FROM e LEFT JOIN g USING (o_orderkey, version, i) GROUP BY ALL)
SELECT o_orderkey, version, text, (SELECT string_agg(n, ',' ORDER BY new) FROM o WHERE o.o_orderkey = w.o_orderkey) AS sources FROM w""")
def renumbered_texts(spark, sf_dir):
    """Texts in two languages, which cite sources 1 to 3 and others that are unknown."""
    o = table(spark, sf_dir, "orders")
    texts = o.selectExpr("o_orderkey", "0 AS version", "concat('B⟦', o_custkey % 4 + 1, '⟧ puis A⟦', o_orderkey % 4 + 1, ',', o_custkey % 3 + 1, '⟧.') AS text").union(o.selectExpr("o_orderkey", "1", "concat('B⟦', o_orderkey % 3 + 1, '⟧ then A⟦4⟧⟦9⟧.')"))
    sources = o.select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("number")).withColumn("name", F.col("number").cast("string"))
    new, kept = passages.compacted(texts, sources, "o_orderkey")
    names = kept.groupBy("o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "name"))), lambda x: x["name"]), ",").alias("sources"))
    return new.join(names, "o_orderkey").select("o_orderkey", "version", "text", "sources")


@query(f"""WITH t AS ({_VERSIONS}), x AS (SELECT o_orderkey, version, text, regexp_replace(text, '⟦[0-9,]+⟧', '', 'g') AS plain, regexp_extract(text, '^((?:(?:⟦[0-9,]+⟧)*[^⟦]){{6}})', 1) AS head FROM t),
y AS (SELECT *, CASE WHEN contains(head, ' ') THEN regexp_extract(head, '^(.*) ', 1) ELSE '' END AS before FROM x)
SELECT o_orderkey, version, CASE WHEN length(plain) <= 7 THEN text WHEN length(regexp_replace(before, '⟦[0-9,]+⟧', '', 'g')) > 3 THEN before || '…' ELSE rtrim(head) || '…' END AS text FROM y""")
def cut_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    texts = o.selectExpr("o_orderkey", "0 AS version", "concat('B⟦', o_custkey % 4 + 1, '⟧ puis A⟦', o_orderkey % 4 + 1, ',', o_custkey % 3 + 1, '⟧.') AS text").union(o.selectExpr("o_orderkey", "1", "concat('B⟦', o_orderkey % 3 + 1, '⟧ then A⟦4⟧⟦9⟧.')"))
    return texts.select("o_orderkey", "version", passages.cut("text", 7).alias("text"))


_ALIGNED = r"""WITH nd AS (SELECT doc_id, string_split(NORM, ' ') AS w FROM documents), nb AS (SELECT item_id, string_split(NORM, ' ') AS w FROM benchmark),
xd AS (SELECT DISTINCT doc_id, unnest(w) AS x FROM nd), xb AS (SELECT DISTINCT item_id, x FROM (SELECT item_id, unnest(w) AS x FROM nb) WHERE length(x) > 3), of AS (SELECT item_id, count(*) AS n FROM xb GROUP BY ALL),
ne AS (SELECT doc_id, item_id FROM xd JOIN xb USING (x) JOIN of USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) * 10 >= n * 9),
gd AS (SELECT doc_id, unnest(range(len(w) - 3)) AS p, w FROM nd WHERE doc_id IN (SELECT doc_id FROM ne) AND len(w) >= 4), gb AS (SELECT item_id, unnest(range(len(w) - 3)) AS e, w, len(w) AS n FROM nb WHERE len(w) >= 4),
bo AS (SELECT ne.doc_id, ne.item_id, n, p, e FROM ne JOIN gd ON gd.doc_id = ne.doc_id JOIN gb ON gb.item_id = ne.item_id AND gd.w[p + 1 : p + 4] = gb.w[e + 1 : e + 4]),
ex AS (SELECT doc_id, item_id, n, p + o AS p, e + o AS e FROM bo, unnest([0, 1, 2, 3]) t(o))
SELECT doc_id, item_id, count(DISTINCT p) AS words, CAST(min(p) AS INTEGER) AS first_word, CAST(max(p) AS INTEGER) AS last_word FROM ex GROUP BY doc_id, item_id, n HAVING count(DISTINCT e) >= 0.5 * n"""


@query(_ALIGNED.replace("NORM", _NORM))
def aligned_items(spark, sf_dir):
    """Benchmark items aligned with the documents that have most of their words of four letters and more."""
    words = lambda c: F.split(text.normalised(c), " ")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", words("text").alias("words"))
    b = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("words"))
    keys = lambda df, key: df.select(key, F.explode(F.array_distinct(F.filter("words", lambda x: F.length(x) > 3))).alias("w"))
    own = keys(b, "item_id")
    least = own.groupBy("item_id").agg(F.count("*").alias("of"))
    near = keys(d, "doc_id").join(own, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).join(least, "item_id").where("n * 10 >= of * 9")
    return passages.aligned(near.select("doc_id", "item_id"), d, b)


_SUPPLIED = "SELECT s_nationkey AS framework, s_suppkey AS pillar, CASE WHEN s_suppkey % 11 = 0 THEN 'new' ELSE 'R' || s_suppkey % 13 END AS reference, 'C' || s_suppkey % 9 AS criterion, 'V' || s_suppkey % 17 AS variable FROM supplier"


@query(f"""WITH p AS ({_SUPPLIED}) SELECT n_nationkey AS framework, concat_ws(',', CASE WHEN count(pillar) NOT BETWEEN 5 AND 8 THEN 'size' END, CASE WHEN bool_or(criterion IN ('C7', 'C8')) THEN 'criteria' END,
CASE WHEN bool_or(reference = 'R12') THEN 'references' END, CASE WHEN bool_or(reference = 'new') AND n_nationkey % 2 = 0 THEN 'rationale' END, CASE WHEN n_nationkey % 3 = 0 AND bool_or(variable = 'V3') THEN 'achieved' END,
CASE WHEN n_nationkey % 3 = 0 AND NOT coalesce(bool_or(variable = 'V5'), false) THEN 'expected' END) AS faults FROM nation LEFT JOIN p ON framework = n_nationkey GROUP BY n_nationkey""")
def framework_faults(spark, sf_dir):
    """Frameworks are nations, every third one before the event; their pillars are suppliers."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("framework"), k.alias("pillar"), F.when(k % 11 == 0, "new").otherwise(F.concat(F.lit("R"), k % 13)).alias("reference"), F.concat(F.lit("C"), k % 9).alias("criterion"), F.concat(F.lit("V"), k % 17).alias("variable"))
    n = F.col("n_nationkey")
    f = table(spark, sf_dir, "nation").select(n.alias("framework"), F.when(n % 2 == 1, "a rationale of some length").alias("rationale"), (n % 3 == 0).alias("before"))
    return frameworks.faults(f, p, [f"C{i}" for i in range(7)], [f"R{i}" for i in range(12)], ["V3"], ["V5"])


@query("""WITH t AS (SELECT n_nationkey, list_distinct(list_filter(regexp_extract_all(lower(n_name), '[a-z0-9]+'), lambda x: length(x) > 2)) AS t FROM nation),
s AS (SELECT t.n_nationkey AS framework, s_suppkey AS pillar, CASE s_suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END + 2 * len(list_intersect(t.t, o.t)) + CAST((s_suppkey % 50) / 100.0 AS DECIMAL(10,2)) AS score FROM t, supplier JOIN t o ON o.n_nationkey = s_nationkey WHERE s_suppkey % 5 = t.n_nationkey % 5)
SELECT framework, pillar, CAST(row_number() OVER (PARTITION BY framework ORDER BY score DESC, pillar) AS INTEGER) AS place FROM s QUALIFY row_number() OVER (PARTITION BY framework ORDER BY score DESC, pillar) <= 8""")
def template_pillars(spark, sf_dir):
    """Reference pillars are suppliers, named as their nation; a framework chooses among those of its rest modulo 5."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), text.token_set("n_name").alias("tokens"))
    k = F.col("s_suppkey") % 4
    applies = F.when(k == 0, "obligatoire").when(k == 1, "prospectif").when(k == 2, "optionnel").otherwise("autre")
    refs = table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("pillar"), "tokens", applies.alias("applies"), (F.col("s_suppkey") % 50).alias("weight"), (F.col("s_suppkey") % 5).alias("part"))
    f = names.select(F.col("n_nationkey").alias("framework"), F.col("tokens").alias("wanted"), (F.col("n_nationkey") % 5).alias("part"))
    return frameworks.template(f.join(refs, "part"))


@query("WITH RECURSIVE t AS (SELECT conv_id, turn AS pos, CAST(ceil(length(text) / 3.0) AS INTEGER) AS tokens, sha256(text) AS excerpt FROM conversations), " + _batches(10, 300) + """,
x AS (SELECT f.*, excerpt, row_number() OVER (PARTITION BY f.conv_id, batch ORDER BY f.pos) AS q, min(f.pos) OVER (PARTITION BY f.conv_id, batch, excerpt) AS first FROM f JOIN t ON t.conv_id = f.conv_id AND t.pos = f.pos)
SELECT conv_id, batch, 'Q' || q AS question, 'E' || dense_rank() OVER (PARTITION BY conv_id, batch ORDER BY first) AS excerpt FROM x""")
def call_batches(spark, sf_dir):
    """Turns of a conversation packed into calls of at most 300 tokens in, with keys of questions and of distinct texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.ceil(F.length("text") / 3).cast("int").alias("tokens"), F.sha2("text", 256).alias("excerpt"))
    calls = ingestion.folded(c, "conv_id", ["pos"], partial(ingestion.Batches, most_rows=10, most_tokens=300), "conv_id long, pos long, batch int")
    rows = c.join(calls, ["conv_id", "pos"])
    question = F.row_number().over(W.partitionBy("conv_id", "batch").orderBy("pos"))
    first = F.min("pos").over(W.partitionBy("conv_id", "batch", "excerpt"))
    rows = rows.withColumns({"question": F.concat(F.lit("Q"), question), "first": first})
    return rows.select("conv_id", "batch", "question", F.concat(F.lit("E"), F.dense_rank().over(W.partitionBy("conv_id", "batch").orderBy("first"))).alias("excerpt"))
