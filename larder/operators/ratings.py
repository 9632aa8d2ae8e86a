"""Ratings and prices per product: shrunken means, trust by votes, and price statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Votes that the global mean counts as, and the mean of an empty table.
PRIOR_VOTES, DEFAULT_MEAN = 20, 7.0


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The latest row per key by ``order`` (last write wins), as a maximum that is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def shrunken_ratings(ratings: DataFrame) -> DataFrame:
    """(product_id, votes, average, weighted): means drawn towards the global mean by ``PRIOR_VOTES`` votes.

    Products are aggregated once, map-side first; the global mean is the sum of the products' sums, a single row."""
    by = ratings.groupBy("product_id").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("total"))
    whole = by.agg(F.sum("total").alias("_t"), F.sum("votes").alias("_v"))
    mean = F.coalesce(F.col("_t") / F.col("_v"), F.lit(DEFAULT_MEAN))
    met = by.crossJoin(F.broadcast(whole))  # a single row
    v = F.col("votes")
    average = F.col("total") / v
    return met.select("product_id", "votes", average.alias("average"), (v / (v + PRIOR_VOTES) * average + F.lit(PRIOR_VOTES) / (v + PRIOR_VOTES) * mean).alias("weighted"))


def clamp(col: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def votes_trust(votes: Column) -> Column:
    """0 to 100 on the logarithm of the votes, full at 100."""
    return F.when(votes > 0, clamp(F.log(votes + 1.0) / F.log(F.lit(101.0)) * 100)).otherwise(0.0)


def trust_score(votes: Column, quality: Column) -> Column:
    """Trust from votes and data quality, capped while votes are few."""
    plain = votes_trust(votes) * 0.85 + clamp(quality) * 0.15
    cap = F.when(votes < 5, 30.0).when(votes < 20, 55.0).when(votes < 100, 79.0).otherwise(100.0)
    return F.when(votes <= 0, 0.0).otherwise(F.least(plain, cap))


def trust_level(votes: Column) -> Column:
    return F.when(votes <= 0, "no_data").when(votes < 5, "very_low").when(votes < 20, "low").when(votes < 100, "medium").otherwise("high")


def price_statistics(prices: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, low, high, middle, spread): exact figures of positive prices; the median is the mean of the middle two."""
    good = prices.filter("price > 0")
    found = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.expr("percentile(cast(price as double), 0.5)").alias("middle"))
    return found.withColumn("spread", F.col("high") - F.col("low"))


def relevance(position: Column, n: Column) -> Column:
    """100 for the first of a list, falling to 65 for the last."""
    return F.when(n <= 1, 100.0).otherwise(F.greatest(F.lit(100.0) - F.lit(35.0) * position / (n - 1), F.lit(65.0)))
