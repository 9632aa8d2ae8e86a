"""Filling fixed-capacity containers by sum-of-squares online packing.

Items arrive one after the other in each shard; an array counts the open containers at each fill level, and an item goes to
the level that makes the sum of squared counts over partially filled levels least, the fullest of equal ones. Shards hold
about the same number of items by hash, so a skewed corpus packs evenly, and each leaves only a few containers open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.encode import encode_texts
from larder.runtime import Scratch

#: Tokens a shard packs, about; its open containers are the price, its length the work of one task.
SHARD_TOKENS = 16_000_000


class Levels:
    """Open containers by fill level: how many, and which."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.open = capacity, np.zeros(capacity + 1, np.int64), {}
        self.made = 0

    def place(self, size: int) -> int:
        """Container of an item of ``size``; a new one is level 0, which has no count of its own, like a full one."""
        c, n = self.capacity, self.count
        if size >= c:
            self.made += 1
            return self.made - 1
        # change of the sum of squares by moving a container from level h to h + size
        levels = np.flatnonzero(n[: c - size + 1])
        best, gain = 0, 2 * n[size] + 1
        if len(levels):
            after = levels + size
            change = 1 - 2 * n[levels] + np.where(after < c, 2 * n[after] + 1, 0)
            k = len(levels) - 1 - int(np.argmin(change[::-1]))  # the fullest of equal ones
            if change[k] <= gain:
                best = int(levels[k])
        if best:
            container = self.open[best].pop()
            n[best] -= 1
        else:
            container, self.made = self.made, self.made + 1
        if best + size < c:
            n[best + size] += 1
            self.open.setdefault(best + size, []).append(container)
        return container


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in order; no size may exceed the capacity."""
    levels = Levels(capacity)
    return np.fromiter((levels.place(int(s)) for s in sizes), np.int64, len(sizes))


def pack_items(items: DataFrame, key: str, size: str, plans: DataFrame) -> DataFrame:
    """(plan_id, container_id, key, part, first_token, n_tokens): every item in a container of each plan's ``capacity_tokens``.

    Defined cases: an item longer than the capacity is cut into full containers and a rest, numbered by ``part`` from 0,
    others have one part; an item of size zero or null takes no space and gets the container null; repeated keys are items
    of their own; a plan without positive capacity packs nothing; equal inputs in equal files pack alike; an empty table
    gives an empty one. Extra columns do not matter."""
    spark = items.sparkSession
    rows = plans.select("plan_id", "capacity_tokens").filter("capacity_tokens > 0").collect()  # a table of parameters
    kind = dict(items.dtypes)[key]
    schema = f"plan_id int, container_id bigint, `{key}` {kind}, part int, first_token int, n_tokens int"
    if not rows:
        return spark.createDataFrame([], schema)
    own = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size).cast("int"), F.lit(0)).alias("_size"), F.monotonically_increasing_id().alias("_row"))
    own = Scratch(spark, "packing").save(own, "items")  # sizes and row numbers are fixed from here on
    total = own.agg(F.sum("_size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    plan = F.explode(F.array(*[F.struct(F.lit(r["plan_id"]).alias("plan_id"), F.lit(r["capacity_tokens"]).alias("cap")) for r in rows]))
    each = own.select("_key", "_size", "_row", plan.alias("_p")).select("_key", "_size", "_row", "_p.plan_id", "_p.cap")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / F.col("cap")).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("part"), (i * F.col("cap")).alias("first")))
    parts = each.filter("_size > 0").select("_key", "_size", "_row", "plan_id", "cap", F.explode(cuts).alias("_c"))
    parts = parts.select("_key", "_row", "plan_id", "cap", "_c.part", F.col("_c.first").alias("first_token"), F.least(F.col("cap"), F.col("_size") - F.col("_c.first")).alias("n_tokens"))
    parts = parts.withColumn("_shard", F.pmod(F.xxhash64("_row", "part"), F.lit(shards)).cast("int"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_row", "part"], kind="stable")  # in order of arrival
        number = pack(frame["n_tokens"].to_numpy(), int(frame["cap"].iloc[0]))
        out = pd.DataFrame({"plan_id": frame["plan_id"], "container_id": (frame["_shard"].to_numpy().astype(np.int64) << 32) | number})
        out[key] = frame["_key"].to_numpy()
        for c in ("part", "first_token", "n_tokens"):
            out[c] = frame[c].to_numpy()
        return out

    packed = parts.groupBy("plan_id", "_shard").applyInPandas(fill, schema)
    empty = each.filter("_size <= 0").select("plan_id", F.lit(None).cast("bigint").alias("container_id"), F.col("_key").alias(key), F.lit(0).alias("part"), F.lit(0).alias("first_token"), F.lit(0).alias("n_tokens"))
    return packed.unionByName(empty)


def pack_texts(documents: DataFrame, key: str, text: str, plans: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """``pack_items`` with the sizes of the texts in tokens of a public tokenizer."""
    return pack_items(encode_texts(documents, key, text, tokenizer, sizes_only=True), key, "n_tokens", plans)


def fill_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, capacity_tokens, containers, tokens, unused_share) of a packing."""
    used = packed.filter("container_id is not null").groupBy("plan_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    total = used.groupBy("plan_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    found = plans.select("plan_id", "capacity_tokens").join(total, "plan_id")
    return found.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
