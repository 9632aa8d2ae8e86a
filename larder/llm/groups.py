"""Consolidating pairwise matches into groups: minimum labels propagated along edges, pointer jumping, contraction.

Each round every node points to the smallest id among itself and its neighbours, the pointers are jumped twice, and the
edges are rewritten to the pointers of their ends. A component shrinks by at least half its depth a round and its smallest
id always survives, so the rounds are logarithmic and the remaining edges get fewer. Each round is written to the shared
folder; nothing is gathered on the driver but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.runtime import Scratch

#: More rounds than any graph needs whose longest shortest path fits a 64-bit count; a guard against a fault, not a limit.
MAX_ROUNDS = 64


def _jump(pointers: DataFrame) -> DataFrame:
    """Each node's pointer replaced by the pointer of that pointer. A hot target is one key of the left side only: adaptive
    skew splitting divides it, as the right side has one row per node."""
    target = pointers.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    return pointers.join(target, "p").select("v", F.col("pp").alias("p"))


def connected_groups(pairs: DataFrame, left: str, right: str, id_type: str = "int") -> DataFrame:
    """(product_id, group_id): every id that occurs in a pair with both sides set, with the smallest id linked to it directly or indirectly.

    Defined cases: a pair with a null side links nothing and names no one; a pair of an id with itself makes a group of one;
    repeated pairs, either order and extra columns change nothing; an empty table gives an empty one."""
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    ends = pairs.select(F.col(left).cast("bigint").alias("a"), F.col(right).cast("bigint").alias("b")).filter("a is not null and b is not null")
    edges = scratch.save(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
    steps: list[DataFrame] = []
    for n in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        pointers = both.groupBy("v").agg(F.min("u").alias("p")).select("v", F.least("v", "p").alias("p"))
        pointers = scratch.save(_jump(_jump(scratch.save(pointers, f"near-{n}"))), f"step-{n}")
        steps.append(pointers)
        to_a, to_b = pointers.select(F.col("v").alias("a"), F.col("p").alias("x")), pointers.select(F.col("v").alias("b"), F.col("p").alias("y"))
        moved = edges.join(to_a, "a").select("b", "x").join(to_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = scratch.save(moved, f"edges-{n + 1}")
        scratch.drop(f"edges-{n}", f"near-{n}")
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("labels still change after the last round")
    # compose the steps from the last, which has the fewest nodes, to the first, which has all
    labels = steps[-1]
    for n in range(len(steps) - 2, -1, -1):
        later = labels.select(F.col("v").alias("p"), F.col("p").alias("g"))
        labels = steps[n].join(later, "p", "left").select("v", F.coalesce("g", "p").alias("p"))
        if n:
            labels = scratch.save(labels, f"label-{n}")
    return labels.select(F.col("v").cast(id_type).alias("product_id"), F.col("p").cast(id_type).alias("group_id"))
