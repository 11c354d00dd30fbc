"""The report's eight tables as lines. Imported for its effect on the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import assessment, layer_a
from corpusmill.plans.catalogue import _layer_a, query
from corpusmill.plans.catalogue_assess import _layer_b, _layer_c
from corpusmill.plans.catalogue_findings import _FINDINGS
from corpusmill.sources.report import lines
from corpusmill.sources.tables import kept

TABLES = ("actions", "alerts", "criteria", "evidence", "overview", "questions", "synthesis", "variables")


def _number(c: str, digits: int):
    return F.replace(F.col(c).cast(f"decimal(18,{digits})").cast("string"), F.lit("."), F.lit(","))


def report(spark, sf_dir) -> DataFrame:
    """LINES of all eight tables, in the order that each has on its page."""
    _, p, dv, m = _layer_a(spark, sf_dir)
    variables = layer_a.variables(m, p, dv)
    s, notes, found, by_pillar, by_criterion = (kept(x, "report") for x in _layer_c(spark, sf_dir))
    answers = _layer_b(spark, sf_dir)[1]
    weak, verify = kept(assessment.weaknesses(s, notes, found, by_pillar, by_criterion), "report"), kept(assessment.verifications(found), "report")
    origins = assessment.origins(weak, verify, assessment.partials(notes, by_criterion, weak, verify))
    c, yes = F.col, lambda x: F.when(F.col(x), "oui").otherwise("")
    letter, number = F.ascii(F.substring("key", 1, 1)), F.substring("key", 2, 9).cast("long")
    parts = [
        lines(s, "overview", {"Pilier": c("pillar"), "Version": c("order_index"), "Score": _number("score", 2), "Écart": _number("delta", 2), "Évolution": c("evolution"), "Confiance": _number("confidence", 4), "Variables": c("documented")}, [c("pillar"), c("order_index")]),
        lines(variables, "variables", {"Pilier": c("pillar"), "Variable": c("variable_id"), "Version": c("order_index"), "État": c("state"), "Documents": c("documents"), "Confiance": _number("confidence", 4)}, [c("pillar"), c("variable_id"), c("order_index")]),
        lines(notes, "criteria", {"Critère": c("criterion"), "Note": _number("note", 1), "Statut": c("reason"), "Documentées": c("documented"), "Questions": c("total"), "Ambigu": yes("ambiguous")}, [c("criterion")]),
        lines(answers, "questions", {"Critère": c("criterion"), "Question": c("query_id"), "Note": c("note"), "Documentée": yes("documented"), "Contradiction": yes("contradictory")}, [c("criterion"), c("query_id")]),
        lines(assessment.placed(found), "alerts", {"Rang": c("place"), "Règle": c("rule"), "Gravité": c("severity"), "Pilier": c("pillar"), "Version": c("order_index"), "Critère": c("criterion"), "Confiance": _number("confidence", 4)}, [c("place")]),
        lines(weak, "synthesis", {"Constat": c("key"), "Origine": c("origin"), "Élément": c("id"), "Niveau": _number("level", 4)}, [number]),
        lines(origins, "actions", {"Constat": c("key"), "Origine": c("origin"), "Élément": c("id")}, [letter, number]),
        lines(assessment.evidence_of(found, by_pillar, by_criterion), "evidence", {"Règle": c("rule"), "Pilier": c("pillar"), "Version": c("order_index"), "Critère": c("criterion"), "Rang": c("place"), "Extrait": c("segment_id"), "Similarité": _number("similarity", 4)},
              [F.substring("rule", 7, 2), c("pillar"), c("order_index"), c("criterion"), c("place")]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _lines(name: str, header: str, cells: list[str], source: str) -> str:
    texts = [f"coalesce(CAST({x} AS VARCHAR), '')" for x in cells]
    guarded = ", ".join(f"CASE WHEN regexp_matches({t}, '^[=+\\-@\\t\\r]') THEN '''' || {t} ELSE {t} END" for t in texts)
    return f"SELECT '{name}' AS name, '{header}' AS line UNION ALL SELECT '{name}', concat_ws(';', {guarded}) FROM {source}"


def _decimal(x: str, digits: int) -> str:
    return f"replace(CAST(CAST({x} AS DECIMAL(18,{digits})) AS VARCHAR), '.', ',')"


_EVIDENCE = """ae AS (SELECT rule, pillar, order_index, al.criterion, segment_id, similarity, 0 AS side FROM al JOIN ce ON al.criterion = ce.criterion
UNION ALL SELECT rule, al.pillar, al.order_index, criterion, segment_id, similarity, 1 FROM al JOIN pe ON al.pillar = pe.pillar AND al.order_index = pe.order_index),
ao AS (SELECT * FROM ae QUALIFY row_number() OVER (PARTITION BY rule, pillar, order_index, criterion, segment_id ORDER BY side) = 1),
ao4 AS (SELECT *, row_number() OVER (PARTITION BY rule, pillar, order_index, criterion ORDER BY side, similarity DESC, segment_id) AS place FROM ao QUALIFY place <= 4)"""
_REPORT = _FINDINGS + ", " + _EVIDENCE + " " + " UNION ALL ".join((
    _lines("overview", "Pilier;Version;Score;Écart;Évolution;Confiance;Variables", ["pillar", "order_index", _decimal("score", 2), _decimal("delta", 2), "CASE WHEN delta >= 5 THEN 'renforce' WHEN delta <= -5 THEN 'affaibli' WHEN delta IS NOT NULL THEN 'maintenu' END", _decimal("confidence", 4), "documented"], "ev"),
    _lines("variables", "Pilier;Variable;Version;État;Documents;Confiance", ["pillar", "variable_id", "order_index", "CASE WHEN value IS NULL THEN 'non_renseigne' WHEN value = 1 THEN 'present' ELSE 'partiel' END", "documents", _decimal("confidence", 4)], "va"),
    _lines("criteria", "Critère;Note;Statut;Documentées;Questions;Ambigu", ["criterion", _decimal("note", 1), "reason", "documented", "total", "CASE WHEN ambiguous THEN 'oui' ELSE '' END"], "nt"),
    _lines("questions", "Critère;Question;Note;Documentée;Contradiction", ["criterion", "query_id", "note", "CASE WHEN documented THEN 'oui' ELSE '' END", "CASE WHEN contradictory THEN 'oui' ELSE '' END"], "an"),
    _lines("alerts", "Rang;Règle;Gravité;Pilier;Version;Critère;Confiance", ["place", "rule", "severity", "pillar", "order_index", "criterion", _decimal("confidence", 4)], "(SELECT *, row_number() OVER (ORDER BY severity <> ''majeure'', rule, pillar, order_index, criterion NULLS LAST) AS place FROM al)".replace("''", "'")),
    _lines("synthesis", "Constat;Origine;Élément;Niveau", ["'W' || n", "origin", "id", _decimal("level", 4)], "(SELECT wx.*, row_number() OVER (ORDER BY later, level, id, origin) AS n FROM wx QUALIFY n <= 3)"),
    _lines("actions", "Constat;Origine;Élément", ["key", "origin", "id"], "(SELECT 'W' || n AS key, origin, id FROM we UNION ALL SELECT 'V' || n, 'alert', CAST(pillar AS BIGINT) FROM ve UNION ALL SELECT 'N' || n, 'criterion', criterion FROM ne)"),
    _lines("evidence", "Règle;Pilier;Version;Critère;Rang;Extrait;Similarité", ["rule", "pillar", "order_index", "criterion", "place", "segment_id", _decimal("similarity", 4)], "ao4"),
))


@query(_REPORT)
def report_tables(spark, sf_dir):
    """What sources/report.py writes as eight files."""
    return report(spark, sf_dir).select("name", "line")
