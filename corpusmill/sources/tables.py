"""Scans of the given tables, and the domain tables derived from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where they are read in fewer splits (a small file of one row group); a table of many splits
    is left as it is, so that nothing large is shuffled. For texts on which much work is done."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def place(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one where it is unset, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for what several jobs read. It goes when the application ends."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def segments(embeddings: DataFrame) -> DataFrame:
    """segment_id, document_id, vector (double)."""
    return embeddings.select(F.col("vec_id").alias("segment_id"), (F.col("vec_id") % 50).alias("document_id"), F.col("embedding").cast("array<double>").alias("vector"))


def probes(embeddings: DataFrame, per_label: int = 4) -> DataFrame:
    """The per_label smallest vec_id of each label: variable_id, pillar, rank, weight, vector."""
    rank = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    return embeddings.withColumn("rank", rank).where(F.col("rank") <= per_label).select(
        F.col("vec_id").alias("variable_id"), F.col("label").alias("pillar"), "rank", (1 + F.col("rank") % 3).alias("weight"), F.col("embedding").cast("array<double>").alias("vector"),
    )


def document_versions(segments_: DataFrame) -> DataFrame:
    """document_id, order_index of documents with a version (document % 10 = 9 has none)."""
    return segments_.select("document_id").distinct().where("document_id % 10 <> 9").select("document_id", (1 + F.col("document_id") % 2).alias("order_index"))
