"""Retrieval: nearest neighbours, diversified top-k, rank fusion, gold quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.inverted import Inverted
from corpusmill.rules import DEFAULT, Rules
from corpusmill.sources.tables import kept


def nearest(queries: DataFrame, segments: DataFrame, k: int, **cells) -> DataFrame:
    """The k most similar segments of each query (query_id, vector), itself excluded; ties by segment id."""
    pairs = Inverted(segments, **cells).nearest(queries, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "segment_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def diversified_nearest(queries: DataFrame, segments: DataFrame, rules: Rules = DEFAULT, **cells) -> DataFrame:
    """The diversified top_k of each query, with the rank among all its segments and the rank in its document."""
    index = Inverted(segments, **cells)
    pairs = index.nearest(queries, rules.top_k, rules.per_document)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "segment_id"))
    chosen = kept(diversified(pairs.withColumn("rank", rank), rules), "diversified")
    # Up to place top_k ranks among the candidates are those among all; later ones are counted.
    beyond = chosen.where(F.col("rank") > rules.top_k)
    if not beyond.take(1):
        return chosen
    later = index.ranks(queries, beyond).withColumnRenamed("rank", "_rank")
    return chosen.join(later, ["query_id", "segment_id"], "left").withColumn("rank", F.coalesce("_rank", "rank").cast("int")).drop("_rank")


def diversified(candidates: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """top_k per query, at most per_document of a document first; places left go to the deferred in order of rank."""
    of_doc = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("rank"))
    d = candidates.withColumn("doc_rank", of_doc).withColumn("deferred", (F.col("doc_rank") > rules.per_document).cast("int"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("deferred", "rank"))
    return d.withColumn("place", place).where(F.col("place") <= rules.top_k).drop("place", "deferred")


def fused(by_vector: DataFrame, by_words: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, segment_id, rank)."""
    v = by_vector.select("query_id", "segment_id", F.col("rank").alias("rv"))
    w = by_words.select("query_id", "segment_id", F.col("rank").alias("rw"))
    part = lambda c: F.coalesce(1.0 / (rules.rrf_k + F.col(c)), F.lit(0.0))
    return v.join(w, ["query_id", "segment_id"], "full").select("query_id", "segment_id", (part("rv") + part("rw")).alias("score"))


def ranks(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, segment_id, rank of the wanted (query_id, segment_id) among all pairs (query_id, segment_id, value) of their query,
    higher values first, ties by segment id. Pairs are counted between the wanted ones, not sorted: no task holds a ranking."""
    key = F.struct((-F.col("value")).alias("v"), F.col("segment_id").alias("s"))
    marks = pairs.join(wanted, ["query_id", "segment_id"], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(key)).alias("marks"))
    before = F.size(F.filter("marks", lambda m: m < key))
    counts = pairs.join(marks, "query_id").groupBy("query_id", before.alias("at")).agg(F.count("*").alias("n"))
    upto = counts.select("query_id", "at", F.sum("n").over(W.partitionBy("query_id").orderBy("at")).alias("rank"))
    return marks.select("query_id", F.posexplode("marks").alias("at", "m")).join(upto, ["query_id", "at"]).select("query_id", F.col("m.s").alias("segment_id"), "rank")


def hybrid(by_vector: DataFrame, by_words: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """query_id, segment_id, score, place: the top_k of each query by reciprocal rank fusion of two whole rankings (query_id,
    segment_id, value). Beyond place rrf_k + 2 * top_k of both, a score is below that of place top_k of one alone, so that
    only segments above it in some ranking are fused, each with its rank among all."""
    reach = rules.rrf_k + 2 * rules.top_k
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("value"), "segment_id"))
    top = lambda x: x.withColumn("_n", best).where(F.col("_n") <= reach).select("query_id", "segment_id")
    wanted = top(by_vector).union(top(by_words)).distinct()
    both = fused(ranks(by_vector, wanted), ranks(by_words, wanted), rules)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "segment_id"))
    return both.withColumn("place", place).where(F.col("place") <= rules.top_k)


def metrics(questions: DataFrame, sent: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of means, each over its own questions (NULL if there are none): recall, hit rate and reciprocal rank over questions with
    gold, precision over those with extracts, the share without extracts over those without gold."""
    hits = sent.join(gold, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count("*").alias("sent"), F.count("relevant").alias("found"), F.min(F.when(F.col("relevant"), F.col("place"))).alias("first"))
    q = questions.join(hits, "item_id", "left").join(gold.groupBy("item_id").agg(F.count("*").alias("quotes")), "item_id", "left").fillna(0, ["sent", "found", "quotes"])
    known = F.col("quotes") > 0
    mean = lambda where, what, name: F.round(F.avg(F.when(where, what)), 6).alias(name)
    return q.agg(
        F.count("*").alias("questions"), mean(known, F.col("found") / F.col("quotes"), "recall"), mean(known, F.col("first").isNotNull().cast("int"), "hit_rate"),
        mean(F.col("sent") > 0, F.col("found") / F.col("sent"), "precision"), mean(known, F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"),
        mean(~known, (F.col("sent") == 0).cast("int"), "empty_rate"), mean(F.lit(True), F.col("sent"), "extracts"),
    )
