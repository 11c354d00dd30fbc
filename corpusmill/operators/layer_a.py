"""Layer A: detections to documented variables, pillar scores, confidence and evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.numbers import rounded
from corpusmill.operators.products import products
from corpusmill.rules import DEFAULT, Rules


def matches(segments: DataFrame, probes: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """segment_id, document_id, variable_id, pillar, similarity of pairs above the weak threshold."""
    found = products(segments, probes, "variable_id", rules.weak)
    return found.join(probes.select(F.col("variable_id").cast("long"), "pillar"), "variable_id").select("segment_id", "document_id", "variable_id", "pillar", "similarity")


def evidence(found: DataFrame, document_versions: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The matches kept for each (variable, version), with their place: the best of each document first, then the rest."""
    m = found.join(document_versions, "document_id")
    of_doc = F.row_number().over(W.partitionBy("variable_id", "order_index", "document_id").orderBy(F.desc("similarity"), "segment_id"))
    place = F.row_number().over(W.partitionBy("variable_id", "order_index").orderBy((F.col("dr") > 1).cast("int"), F.desc("similarity"), "document_id", "segment_id"))
    return m.withColumn("dr", of_doc).withColumn("place", place).where(F.col("place") <= rules.evidences).drop("dr")


def documents_of(found: DataFrame, probes: DataFrame, document_versions: DataFrame) -> DataFrame:
    """pillar, order_index, documents (of the version), detected (documents with a detection of the pillar)."""
    versions = document_versions.groupBy("order_index").agg(F.countDistinct("document_id").alias("documents"))
    seen = found.join(document_versions, "document_id").groupBy("pillar", "order_index").agg(F.countDistinct("document_id").alias("detected"))
    every = probes.select("pillar").distinct().join(versions, how="cross")
    return every.join(seen, ["pillar", "order_index"], "left").select("pillar", "order_index", "documents", F.coalesce("detected", F.lit(0)).alias("detected"))


def variables(found: DataFrame, probes: DataFrame, document_versions: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row per (variable, version), with none detected too: value NULL, 0.5 or 1.0, state, documents, confidence."""
    versions = document_versions.select("order_index").distinct()
    per_doc = (
        found.join(document_versions, "document_id")
        .groupBy("variable_id", "order_index", "document_id")
        .agg(F.countDistinct("segment_id").alias("n"), F.max("similarity").alias("best"))
    )
    per = per_doc.groupBy("variable_id", "order_index").agg(
        F.count("*").alias("documents"), F.count(F.when(F.col("best") >= rules.strong, 1)).alias("strong_documents"),
        rounded(1 - F.product(1 - F.least(F.lit(1.0), F.col("n") / rules.convergence)), 4).alias("confidence"),
    )
    every = probes.select("variable_id", "pillar", "weight").join(versions, how="cross")
    out = every.join(per, ["variable_id", "order_index"], "left")
    value = F.when(F.col("documents").isNull(), None).when(F.col("strong_documents") >= rules.independent_sources, 1.0).otherwise(0.5)
    return out.select(
        "variable_id", "pillar", "order_index", "weight", value.alias("value"),
        F.when(value.isNull(), "non_renseigne").when(value == 1.0, "present").otherwise("partiel").alias("state"),
        F.coalesce("documents", F.lit(0)).alias("documents"), "confidence",
    )


def scores(variables_: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Weighted pillar score per version (NULL without a value, 2 digits), confidence (4 digits), change from the adjacent
    version (2 digits) and its label."""
    known = F.when(F.col("value").isNotNull(), F.col("weight"))
    s = variables_.groupBy("pillar", "order_index").agg(
        rounded(F.sum(F.col("weight") * F.col("value")) / F.sum(known) * 100, 2).alias("score"), rounded(F.avg(F.coalesce("confidence", F.lit(0.0))), 4).alias("confidence"), F.count("value").alias("documented"),
    )
    delta = rounded(F.col("score") - F.lag("score").over(W.partitionBy("pillar").orderBy("order_index")), 2)
    step = rules.evolution_step
    label = F.when(F.col("delta") >= step, "renforce").when(F.col("delta") <= -step, "affaibli").when(F.col("delta").isNotNull(), "maintenu")
    return s.withColumn("delta", delta).withColumn("evolution", label)
