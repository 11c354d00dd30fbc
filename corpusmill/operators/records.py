"""Tables that change: merges, leases, published generations, versioned settings, reuse of what is known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows, those with a change replaced by it, and changes of new keys added. changes have one row for each key."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*rows.columns))


def under_lease(writes: DataFrame, leases: DataFrame, job: str, lease: str, seq: str) -> DataFrame:
    """The writes that count: the first of each job by its current lease; those of an older lease are refused."""
    first = F.row_number().over(W.partitionBy(job).orderBy(seq))
    return writes.join(leases.select(job, lease), [job, lease], "left_semi").withColumn("_n", first).where("_n = 1").drop("_n")


class Generations:
    """Whole tables below a root, one folder for each generation; an append to the journal of pointers publishes one.

    A generation that was not published, or is unpublished, is not read. Writers put whole generations, so that a job that
    fails leaves nothing behind that readers see.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/generation={number}")

    def publish(self, number: int | None, step: int) -> None:
        """Points readers to a generation, or to none. step orders the journal; a repeated step replaces itself."""
        self.spark.createDataFrame([(step, number)], "step long, generation long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pointers/step={step}")

    def current(self) -> int | None:
        return self.spark.read.schema("generation long, step long").parquet(f"{self.root}/pointers").agg(F.max_by("generation", "step")).first()[0]

    def read(self) -> DataFrame | None:
        number = self.current()
        return None if number is None else self.spark.read.parquet(f"{self.root}/generation={number}")


def settings_of(owners: DataFrame, settings: DataFrame, owner: str, key: str, version: str) -> DataFrame:
    """The setting of each (owner, key): the owner's own before the common one (owner NULL), the latest version first. Both are
    reduced to their latest before they meet; every owner has every common key, so that its rows are the result itself."""
    rest = [c for c in settings.columns if c not in (owner, key)]
    latest = lambda rows, *by: rows.groupBy(*by).agg(F.max_by(F.struct(*rest), version).alias("_s"))
    every = owners.select(owner).distinct()
    own = latest(settings.where(F.col(owner).isNotNull()), owner, key).join(every, owner, "left_semi")
    common = every.crossJoin(latest(settings.where(F.col(owner).isNull()), key)).withColumnRenamed("_s", "_c")
    both = own.join(common, [owner, key], "full").withColumn("_s", F.coalesce("_s", "_c"))
    return both.select(owner, key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def reused(segments: DataFrame, known: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """segments with the vector of their text: that of known (text, vector) where there is one; other texts are embedded,
    each once. embed takes (text) and returns (text, vector). Column reused says which."""
    own = known.dropDuplicates(["text"]).select("text", F.col("vector"))
    missing = segments.select("text").distinct().join(own, "text", "left_anti")
    every = own.withColumn("reused", F.lit(True)).unionByName(embed(missing).select("text", "vector").withColumn("reused", F.lit(False)))
    return segments.join(every, "text", "left")


def localised(translations: Column, text: Column, locale: str) -> Column:
    """A text in a locale, else in English, else in French, else the source text, without its source markers."""
    from corpusmill.functions.text import plain

    return plain(F.coalesce(*[F.nullif(F.try_element_at(translations, F.lit(x)), F.lit("")) for x in (locale, "en", "fr")], text))


def metered(tasks: DataFrame, calls: DataFrame, key: str, price: str) -> DataFrame:
    """key, calls, tokens, cost_eur of each task, those without calls included: what its successful calls (key, tokens, ok) used, at a
    price for a million tokens; halves of the sixth digit go to the even one."""
    used = calls.where("ok").groupBy(key).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    every = tasks.select(key).distinct().join(used, key, "left").fillna(0, ["calls", "tokens"])
    micro = F.bround(F.col("tokens").cast("decimal(20,0)") * F.lit(price).cast("decimal(6,2)"), 0)
    return every.withColumn("cost_eur", micro.cast("double") / 1_000_000)
