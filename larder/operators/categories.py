"""External category names mapped to known categories: exactly, by rules, by rules within, by categories within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.runtime import small_broadcast

#: Categories too general to be found inside another name.
GENERAL = ["продукты", "продукт", "еда", "food", "foods", "products", "product", "прочее", "другое", "other"]
#: Confidence of each way, the surest first.
CONFIDENCE = {"database_exact": 100.0, "rule_exact": 97.0, "rule_contains": 90.0, "database_contains": 82.0}


def category_text(col: Column) -> Column:
    """The normal form of a category name; empty for null."""
    return F.coalesce(T.normalize_text(col), F.lit(""))


def _words(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(category_text(col), " "), lambda w: w != ""))


def incoming_values(records: DataFrame, key: str, name: str, others: str | None = None) -> DataFrame:
    """(key, pos, value, n): the distinct non-empty category values of each record in order, its own name first."""
    every = F.concat(F.array(name), F.coalesce(F.col(others), F.array().cast("array<string>"))) if others else F.array(name)
    rows = records.select(key, F.posexplode(every).alias("p", "value")).withColumn("n", category_text(F.col("value"))).filter("n <> ''")
    first = rows.groupBy(key, "n").agg(F.min("p").alias("pos"), F.min_by(T.squeeze(F.col("value")), "p").alias("value"))
    return first.select(key, "pos", "value", "n")


def _within(values: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Pairs of a value and a term (n, ...) all of whose words the value has: they meet on the term's rarest word."""
    listed = terms.withColumn("_tw", _words(F.col("n")))
    seen = listed.select(F.explode("_tw").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_f"))
    each = listed.select("*", F.explode("_tw").alias("_word")).join(seen, "_word")
    rest = [c for c in listed.columns]
    rare = each.groupBy(*rest).agg(F.min_by("_word", F.struct("_f", "_word")).alias("_word"))
    met = values.withColumn("_vw", _words(F.col("n"))).select(key, "pos", "value", "_vw", F.explode("_vw").alias("_word")).join(small_broadcast(rare.withColumnRenamed("n", "_term"), 400), "_word")
    return met.filter(F.size(F.array_except("_tw", "_vw")) == 0).drop("_word", "_vw", "_tw")


def map_categories(values: DataFrame, categories: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, category_id, matched_by, confidence, source_value): the known category of each record.

    ``values`` as by ``incoming_values``; ``categories`` has id and name; ``rules`` has place, rule, targets and aliases (arrays),
    the rule's name being an alias too. The ways are tried in the order of ``CONFIDENCE`` over all values of a record before the
    next way: a known category of the same name; a rule with just this alias; a rule whose alias stands in the value by all its
    words, the longest; a known category that does, the longest, unless it is a general one or one word under three letters.
    A rule means the first of its targets that is known. A record without a match gets null and its first value."""
    known = categories.select("id", category_text(F.col("name")).alias("n")).filter("n <> ''")
    unique = known.groupBy("n").agg(F.min("id").alias("category_id"))
    terms = rules.select("place", "rule", F.posexplode(F.concat(F.array("rule"), "aliases")).alias("at", "alias")).withColumn("n", category_text(F.col("alias"))).filter("n <> ''")
    targets = rules.select("rule", F.posexplode("targets").alias("t", "name")).withColumn("n", category_text(F.col("name"))).join(small_broadcast(unique), "n")
    meant = targets.groupBy("rule").agg(F.min_by("category_id", "t").alias("category_id"))
    way = lambda df, n, by: df.select(key, F.lit(n).alias("way"), "pos", "value", "category_id", by.alias("by"))
    exact = way(values.join(small_broadcast(unique), "n"), 0, F.lit("database_exact"))
    first_rule = terms.groupBy("n").agg(F.min_by("rule", F.struct("place", "at")).alias("rule"))
    by_rule = way(values.join(small_broadcast(first_rule), "n").join(small_broadcast(meant), "rule"), 1, F.concat(F.lit("rule_exact:"), "rule"))
    inside = _within(values, terms.select("n", "rule", "place", "at"), key)
    longest = inside.groupBy(key, "pos", "value").agg(F.min_by("rule", F.struct((-F.length("_term")).alias("l"), "place", "at")).alias("rule"))
    within = way(longest.join(small_broadcast(meant), "rule"), 2, F.concat(F.lit("rule_contains:"), "rule"))
    telling = known.filter(~F.col("n").isin(*GENERAL) & ((F.size(F.split("n", " ")) > 1) | (F.length("n") >= 3)))
    holds = _within(values, telling, key).groupBy(key, "pos", "value").agg(F.min_by("id", F.struct((-F.length("_term")).alias("l"), F.col("id").alias("i"))).alias("category_id"))
    found = exact.unionByName(by_rule).unionByName(within).unionByName(way(holds, 3, F.lit("database_contains")))
    best = found.groupBy(key).agg(F.min(F.struct("way", "pos", "value", "category_id", "by")).alias("m"))
    firsts = values.groupBy(key).agg(F.min_by("value", "pos").alias("_first"))
    confidence = F.get(F.array(*[F.lit(c) for c in CONFIDENCE.values()]), F.col("m.way"))
    return firsts.join(best, key, "left").select(key, F.col("m.category_id").alias("category_id"), F.coalesce("m.by", F.lit("not_found")).alias("matched_by"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.coalesce("m.value", "_first").alias("source_value"))
