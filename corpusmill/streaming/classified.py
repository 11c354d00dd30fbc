"""Segments classified as they arrive: a stream of vector files against a static table of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.products import products
from corpusmill.rules import DEFAULT, Rules
from corpusmill.sources.tables import segments


def classified(spark: SparkSession, pattern: str, probes: DataFrame, out: str, rules: Rules = DEFAULT) -> DataFrame:
    """segment_id, document_id, variable_id, pillar, similarity of all segments in vector files of a path pattern with the probes (variable_id,
    pillar, vector) they match. Another run with the same out goes on from its checkpoint, with the probes as they then are, and takes
    new files only; the file sink writes each micro-batch once."""
    schema = spark.read.parquet(pattern).schema
    stream = segments(spark.readStream.schema(schema).parquet(pattern))
    found = products(stream, probes.select("variable_id", "vector"), "variable_id", least=rules.weak).join(probes.select("variable_id", "pillar"), "variable_id")
    query = found.select("segment_id", "document_id", "variable_id", "pillar", "similarity").writeStream.format("parquet")
    query.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema("segment_id long, document_id long, variable_id long, pillar int, similarity double").parquet(f"{out}/rows")
