"""URL filtering by association rules: FP-growth mines combinations of URL tokens that go with bad labels; pruned rules
are matched by an inverted index from tokens to rules. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import looked_up, saved

#: Fixed rules: (host and path, verdict). A rule fits its host and all subdomains; the longest that fits wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 1.5
#: Rules of so many tokens together are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
_BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct host suffix parts and path segments, digits generalised to one 0: a set of items."""
    parts = F.transform(F.filter(F.split(host_, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h="), x))
    steps = F.transform(F.filter(F.split(path_, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), F.regexp_replace(x, r"\d+", "0")))
    return F.array_sort(F.array_distinct(F.concat(parts, steps)))


def mined(pages: DataFrame, labels: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """(rule_id, tokens) of token sets that go with bad labels (toxic, or quality 0) of the pages labelled by page_id = doc_id.

    Kept are rules of at least these shares of support and confidence, and of this lift. A rule that is a token
    more than another is dropped: where it fits, the other fits. Null labels are good; a page with several labels is bad if
    one is. Null urls and ids, an empty table or no labels add nothing: without baskets there are no rules.
    """
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    baskets = pages.where("url is not null").select("page_id", tokens(host(), path()).alias("t")).join(bad, F.col("page_id") == F.col("doc_id"))
    baskets = baskets.select(F.when(F.col("bad") == 1, F.array_append("t", F.lit(_BAD))).otherwise(F.col("t")).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.element_at("consequent", 1) == _BAD) & (F.col("lift") >= lift))
    kept = saved(rules.select(F.array_sort("antecedent").alias("tokens")).distinct().withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    less_one = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.filter("tokens", lambda _, k: k != i))
    wider = kept.where(F.size("tokens") > 1).select("rule_id", F.explode(less_one).alias("tokens")).join(kept.select("tokens"), "tokens", "left_semi")
    return saved(kept.join(wider.select("rule_id").distinct(), "rule_id", "left_anti"), "url-rules")


def by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(t, n, mined) of the distinct token sets (column t, in n rows) of urls; mined is true for those that hold all tokens of
    some rule: an inverted index from a token to the rules with it, and a count of the tokens met. An index of at most
    MAX_BROADCAST rows is broadcast."""
    index = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    if index.count() <= MAX_BROADCAST:
        index = F.broadcast(index)
    sets = urls.groupBy("t").agg(F.count("*").alias("n"))
    met = sets.select("t", F.explode("t").alias("token")).join(index, "token").groupBy("t", "rule_id").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    return sets.join(met.where("met = need").select("t", F.lit(True).alias("mined")).distinct(), "t", "left")


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    A null url or one without '://' has an empty host and path and is allowed. Repeated rows give repeated results;
    empty tables give an empty result, and without labels nothing is mined. Other columns are ignored.
    """
    fixed, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(RULES, key=lambda x: len(x[0])):  # the longest comes last, so it is the outermost condition
        h, _, p = rule.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        fixed, verdict = F.when(fits, rule).otherwise(fixed), F.when(fits, what).otherwise(verdict)
    every = pages.select("page_id", host().alias("host"), path().alias("path")).withColumn("t", tokens(F.col("host"), F.col("path")))
    sets = saved(by_rules(every, mined(pages.select("page_id", "url"), labels)), "url-sets")
    out = looked_up(every.withColumn("rule", fixed).withColumn("fixed", verdict), sets, ["t"], "n", pages.count())
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))
