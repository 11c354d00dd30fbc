"""Queries of the segmentation, each with an oracle that packs by recursion. Imported for its effect on the catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import segments
from corpusmill.plans.catalogue import query
from corpusmill.sources.tables import table


def _segments(pages: str) -> str:
    """DuckDB SQL for the segments of a relation pg (document, page, text, char_start, title, headings)."""
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    pieces = lambda x: rf"string_split(regexp_replace({x}, '(\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}])', chr(1) || '\1', 'g'), chr(1))[2:]"
    # Fixed value: how numbered headings begin.
    numbered = r"(?i)^((\d+(\.\d+)*\.?)|([IVXLC]+\.)|((chapitre|chapter|section|annexe|annex|partie|part)\s+\S+))\s*[-–:]?\s*\S"
    return rf"""WITH RECURSIVE pg AS ({pages}),
l AS (SELECT document, page, char_start, title, headings, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM pg),
v AS (SELECT *, {strip("line")} AS v FROM l),
h AS (SELECT *, v <> '' AS filled, v <> '' AND (coalesce(list_contains(headings, v), false) OR length(v) <= 120 AND len(regexp_split_to_array(v, '\s+')) <= 14 AND (NOT regexp_matches(v, '[.,;]$') OR regexp_matches(v, '{numbered}'))
  AND (regexp_matches(v, '{numbered}') AND len(regexp_split_to_array(v, '\s+')) >= 2 OR length(regexp_replace(v, '[^\p{{L}}]', '', 'g')) >= 4 AND NOT regexp_matches(v, '\p{{Ll}}'))) AS heading,
  char_start + coalesce(sum(length(line) + 1) OVER (PARTITION BY document, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM v),
o AS (SELECT *, filled AND (heading OR NOT lag(filled, 1, false) OVER w OR lag(heading, 1, false) OVER w) AS opens FROM h WINDOW w AS (PARTITION BY document, page ORDER BY i)),
s AS (SELECT *, sum(opens::INT) OVER w - 1 AS paragraph, last_value(CASE WHEN heading THEN v WHEN i = 0 THEN nullif(title, '') END IGNORE NULLS) OVER w AS section FROM o
  WINDOW w AS (PARTITION BY document ORDER BY page, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT document, page, paragraph, {strip("string_agg(line, chr(10) ORDER BY i)")} AS text, arg_min(coalesce(section, chr(0)), i) AS section, bool_or(heading) AS heading, min(pos + length(line) - length(regexp_replace(line, '^\s+', ''))) AS pos FROM s WHERE filled GROUP BY ALL),
t AS (SELECT *, {pieces("text")} AS k FROM p),
e AS (SELECT document, page, paragraph, section, heading, pos, unnest(k) AS piece, unnest(range(len(k))) AS i FROM t WHERE len(k) > 1024),
c AS (SELECT *, coalesce(sum(length(piece)) OVER w, 0) AS f, coalesce(sum(CASE WHEN regexp_matches(piece, '^[.!?;:]\s+$') THEN 1 ELSE 0 END) OVER w, 0) AS sentence FROM e WINDOW w AS (PARTITION BY document, page, paragraph ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT document, page, paragraph, sentence, section, heading, list(piece ORDER BY i) AS k, pos + min(f) AS a, pos + max(f + length({strip("piece")})) AS b FROM c GROUP BY document, page, paragraph, sentence, section, heading, pos),
x AS (SELECT document, page, paragraph, 0 AS sentence, 0 AS x, section, heading, text, len(k) AS tokens, pos AS a, pos + length(text) AS b FROM t WHERE len(k) <= 1024
  UNION ALL SELECT document, page, paragraph, sentence, x, section, heading, {strip("array_to_string(k[x + 1 : x + size], '')")}, len(k[x + 1 : x + size]), a, b
  FROM (SELECT *, unnest(CASE WHEN len(k) <= 1024 THEN [0] ELSE range(0, len(k), 448) END) AS x, CASE WHEN len(k) <= 1024 THEN 1024 ELSE 512 END AS size FROM q)),
u AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY page, paragraph, sentence, x) AS r FROM x),
g AS (SELECT document, r, 0 AS segment, section, heading AS heads, tokens AS body, 0 AS overlap, false AS ends FROM u WHERE r = 1
  UNION ALL SELECT document, r, segment + CASE WHEN ends OR full_ THEN 1 ELSE 0 END, section, CASE WHEN ends OR full_ THEN heading ELSE heads AND heading END, CASE WHEN ends OR full_ THEN tokens ELSE body + tokens END,
    CASE WHEN ends THEN 0 WHEN full_ AND body > 64 THEN 64 WHEN full_ THEN 0 ELSE kept END, ends
  FROM (SELECT *, NOT ends AND body + kept + tokens > 512 AS full_ FROM (SELECT u.document, u.r, u.section, u.heading, u.tokens, g.segment, g.heads, g.body, u.section <> g.section AND NOT g.heads AS ends,
    CASE WHEN u.section <> g.section THEN 0 ELSE g.overlap END AS kept FROM g JOIN u ON u.document = g.document AND u.r = g.r + 1))),
m AS (SELECT g.document, segment, arg_max(g.section, r) AS section, arg_min(ends, r) AS closed, arg_min(g.section, r) AS opened, arg_min(overlap, r) AS overlap, sum(tokens) AS body_tokens,
  string_agg(text, chr(10) ORDER BY r) AS body, arg_min(page, r) AS page, arg_min(paragraph, r) AS paragraph, arg_min(a, r) AS a, arg_max(b, r) AS b FROM g JOIN u USING (document, r) GROUP BY g.document, segment),
n AS (SELECT *, lead(closed, 1, true) OVER w AS ends, CASE WHEN lead(closed) OVER w = false THEN lead(opened) OVER w ELSE section END AS title, CASE WHEN overlap > 0 THEN {strip(f"array_to_string(({pieces('lag(body) OVER w')})[-64:], '')")} || chr(10) ELSE '' END AS before,
  body_tokens + overlap AS tokens FROM m WINDOW w AS (PARTITION BY document ORDER BY segment)),
z AS (SELECT document, segment, 0 AS no, title, tokens AS size, false AS tail FROM n WHERE segment = 0
  UNION ALL SELECT document, segment, no + CASE WHEN tail THEN 0 ELSE 1 END, title, CASE WHEN tail THEN size + body_tokens ELSE tokens END, tail
  FROM (SELECT n.document, n.segment, z.no, n.title, n.tokens, n.body_tokens, z.size, n.ends AND n.tokens < 128 AND z.title = n.title AND z.size + n.tokens <= 1024 AS tail FROM z JOIN n ON n.document = z.document AND n.segment = z.segment + 1))
SELECT document, CAST(no AS INTEGER) AS segment, arg_min(page, segment) AS page, nullif(arg_min(n.title, segment), chr(0)) AS section, CAST(arg_min(paragraph, segment) AS BIGINT) AS paragraph, CAST(min(a) AS BIGINT) AS char_start, CAST(arg_max(b, segment) AS BIGINT) AS char_end,
CAST(arg_max(size, segment) AS BIGINT) AS tokens, sha256(string_agg(CASE WHEN tail THEN body ELSE before || body END, chr(10) ORDER BY segment)) AS text_sha256 FROM z JOIN n USING (document, segment) GROUP BY document, no"""


def _digested(rows):
    return rows.select("document", "segment", "page", "section", "paragraph", "char_start", "char_end", F.col("tokens"), F.sha2("text", 256).alias("text_sha256"))


@query(_segments("SELECT doc_id AS document, 0 AS page, text, 0 AS char_start, CASE WHEN doc_id % 7 = 0 THEN 'sheet' END AS title, CAST([] AS VARCHAR[]) AS headings FROM documents"))
def segment_pages(spark, sf_dir):
    """Each document as one page; every seventh has a title."""
    zero = F.lit(0)
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), zero.alias("page"), "text", zero.alias("char_start"), F.when(F.col("doc_id") % 7 == 0, "sheet").alias("title"), F.array().cast("array<string>").alias("headings"))
    return _digested(segments.segmented(pages))


@query(_segments("""SELECT conv_id AS document, turn AS page, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start,
CASE WHEN role = 'system' THEN 'Instructions' END AS title, CASE WHEN turn % 3 = 2 THEN [trim(string_split(text, chr(10))[1])] ELSE [] END AS headings FROM conversations"""))
def segment_conversations(spark, sf_dir):
    """Conversations as documents, turns as pages: system turns bring a title, the first line of every third turn is a styled heading."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").withColumn("char_start", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)))
    first = F.array(F.trim(F.split("text", "\n")[0]))
    pages = c.select(F.col("conv_id").alias("document"), F.col("turn").alias("page"), "text", "char_start", F.when(F.col("role") == "system", "Instructions").alias("title"), F.when(F.col("turn") % 3 == 2, first).otherwise(F.array().cast("array<string>")).alias("headings"))
    return _digested(segments.segmented(pages))
