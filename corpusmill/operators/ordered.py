"""Ordered analytics: latest rows, ranges of consecutive numbers, merged spans, repeated margins, abuse caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_scored(scores: DataFrame) -> DataFrame:
    """Per pillar the last version, and the last with a score."""
    return scores.groupBy("pillar").agg(
        F.max("order_index").alias("latest"), F.max(F.when(F.col("score").isNotNull(), F.col("order_index"))).alias("latest_scored"),
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("order_index"))).alias("score"),
    )


def reference_ranges(numbers: DataFrame, group: str, n: str) -> DataFrame:
    """Sorted distinct numbers of each group as runs: '[a–b]' for more than two in a row, else one by one."""
    d = numbers.select(group, n).distinct()
    island = F.col(n) - F.row_number().over(W.partitionBy(group).orderBy(n))
    runs = d.withColumn("island", island).groupBy(group, "island").agg(F.min(n).alias("low"), F.max(n).alias("high"))
    label = F.when(F.col("high") - F.col("low") >= 2, F.format_string("[%d–%d]", "low", "high")).when(F.col("high") > F.col("low"), F.format_string("[%d] [%d]", "low", "high")).otherwise(F.format_string("[%d]", "low"))
    return runs.select(group, "low", "high", label.alias("label"))


def merged_spans(spans: DataFrame, group: str) -> DataFrame:
    """Touching or overlapping spans (start <= end before + 1) become one; empty spans go."""
    w = W.partitionBy(group).orderBy("start", "end")
    s = spans.where(F.col("end") > F.col("start"))
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("new", F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(1)))
    s = s.withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(group, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def hourly_cap(events: DataFrame, limit: int) -> DataFrame:
    """event_id, stored (others in the hour before, the event at exactly an hour before excluded), refused (the limit is
    reached). Each event is in its own hour's partition and in the next one's, so that no window spans all rows."""
    hour = 3_600_000_000
    e = events.withColumn("us", F.unix_micros("ts")).withColumn("own", F.floor(F.col("us") / hour))
    e = e.select("event_id", "us", "own", F.explode(F.array("own", F.col("own") + 1)).alias("bucket"))
    before = F.count("*").over(W.partitionBy("bucket").orderBy("us").rangeBetween(1 - hour, 0)) - 1
    return e.withColumn("stored", before).where("own = bucket").select("event_id", "stored", (F.col("stored") >= limit).alias("refused"))


def joined_ranges(ranges: DataFrame, group: str) -> DataFrame:
    """group, label: the ranges of each group in order, in one label."""
    rows = ranges.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("low", "label"))).alias("r"))
    return rows.select(group, F.array_join(F.transform("r", lambda x: x["label"]), " ").alias("label"))


def first_seen(rows: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """group, values: distinct values of each group in the order in which they are first met, joined by commas."""
    once = rows.groupBy(group, value).agg(F.min(pos).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v"))))
    return once.groupBy(group).agg(ordered.alias("_r")).select(group, F.array_join(F.transform("_r", lambda x: x["v"].cast("string")), ",").alias("values"))


def numbered(rows: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """group, value, number: distinct values of each group, numbered in the order in which they are first met."""
    once = rows.groupBy(group, value).agg(F.min(pos).alias("_at"))
    return once.select(group, value, F.row_number().over(W.partitionBy(group).orderBy("_at")).alias("number"))
