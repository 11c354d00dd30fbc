"""Five stages that prepare documents; each reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, jaccard, langid, pieces, substrings
from corpusmill.llm.shared import saved, settled, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language, columns as they are. Null texts and texts without a letter go; rows of equal or null doc_id are
    judged one by one; an empty table stays empty; other columns, whatever their names, stay."""
    return langid.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one whose doc_id is the group's. Null and empty texts are like nothing,
    and stay; of rows of equal doc_id all stay or go; rows of a null doc_id stay; an empty table stays empty; other columns, whatever their names, stay."""
    others = settled(spark, lambda: jaccard.joined(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "duplicates")
    return docs.join(others, docs["doc_id"] == others["_id"], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller doc_id has too; n_chars follows. Texts that lose every word go; null and empty texts and rows of a
    null doc_id stay; rows of equal doc_id lose the same words; an empty table stays empty; other columns, whatever their names, stay."""
    return substrings.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item hits. Null and empty texts stay; rows of equal doc_id, nulls among them, stay or go together; an empty
    table stays empty, and without items all stay; other columns, whatever their names, stay."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document with the pieces of its text (pieces.encoded): null texts count as empty; repeated rows and null doc_ids have rows of their own;
    an empty table gives an empty result; other columns are ignored."""
    return pieces.encoded(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("tokens", tokens)]
#: Language ID, joins on similarity, chaining and pieces are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each reading what the one before has written; the last one's rows are the result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
