"""Percentiles of very large numeric columns by merging centroid digests with a certified rank error.

Each task clusters the sorted values of a group into centroids whose size is bounded by a quantile-dependent scale
(``k(q) = delta / (2 pi) * asin(2 q - 1)``: small at both tails), holds only the digests of its groups, and emits them as
rows. Digests of tasks, files or days are rows of one table and merge by re-clustering. A second pass counts the values
below and at each estimate, which gives its true rank: the rank error of every percentile is certified, and where it
exceeds the bound the exact value replaces the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.runtime import Scratch, bounded, salted_join

#: Scale of the digests (about this many centroids at most), and the bound on the certified rank error as a share of the count.
DELTA, MAX_ERROR = 400, 0.005
#: Digests merge in two levels: first by this many salts a group, then by group, so that one group is never merged by one task at once.
SALTS = 8
#: Ranges into which the values of a group are cut where its exact percentiles are wanted.
CUTS = 64


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of weighted points by group: sort by (group, mean), cut each group where the scale function passes a whole number.

    A cluster spans at most one unit of the scale unless it is a single point. Returns (group, mean, weight)."""
    if not len(group):
        return group, mean, weight
    order = np.lexsort((mean, group))
    g, m, w = group[order], mean[order], weight[order].astype(np.float64)
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[first, len(g)])
    total = np.repeat(np.add.reduceat(w, first), sizes)
    before = np.cumsum(w)
    before -= np.repeat(before[first] - w[first], sizes)
    middle = np.clip((before - w / 2) / total, 0.0, 1.0)
    scale = np.floor(delta / (2 * np.pi) * (np.arcsin(2 * middle - 1) + np.pi / 2))
    cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (scale[1:] != scale[:-1])])
    weights = np.add.reduceat(w, cut)
    return g[cut], np.add.reduceat(m * w, cut) / weights, weights


class _Merger:
    """Digests of the groups of one task; points are buffered and clustered once the buffer is full. ``full`` tells that the digests
    themselves fill half of it: they are then to be emitted and forgotten, so memory and time stay linear whatever the groups."""

    LIMIT = 1 << 19

    @property
    def full(self) -> bool:
        return self.held > self.LIMIT // 2 and len(self.parts) == 1

    def __init__(self, delta: float):
        self.delta, self.names, self.codes, self.parts, self.held = delta, [], {}, [], 0

    def add(self, keys: list[tuple], mean: np.ndarray, weight: np.ndarray, code: np.ndarray) -> None:
        """Points whose group is ``keys[code]``."""
        ids = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys):
            if k not in self.codes:
                self.codes[k] = len(self.names)
                self.names.append(k)
            ids[i] = self.codes[k]
        self.parts.append((ids[code], mean, weight))
        self.held += len(mean)
        if self.held > self.LIMIT:
            self.pack()

    def pack(self) -> None:
        if self.parts:
            self.parts = [cluster(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.delta)]
            self.held = len(self.parts[0][0])

    def batch(self, schema: pa.Schema) -> pa.RecordBatch | None:
        self.pack()
        if not self.parts:
            return None
        g, m, w = self.parts[0]
        columns = [pa.array([self.names[i][k] for i in g], schema.field(k).type) for k in range(len(schema) - 2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(m), pa.array(w)], schema=schema)


def _codes(batch: pa.RecordBatch, keys: list[str]) -> tuple[list[tuple], np.ndarray]:
    """Distinct keys of a batch and the code of each row; keys may be null."""
    code, names = np.zeros(batch.num_rows, np.int64), [()]
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        column = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
        values = [*column.dictionary.to_pylist(), None]
        index = column.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * len(values) + index
        unique, code = np.unique(code, return_inverse=True)
        names = [(*names[u // len(values)], values[u % len(values)]) for u in unique]
    return names, code


def _digester(keys: list[str], value: str, weight: str | None, delta: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _Merger(delta)
        for batch in batches:
            if batch.num_rows:
                names, code = _codes(batch, keys)
                points = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.float64)
                mass = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False) if weight else np.ones(len(points))
                merger.add(names, points, mass, code)
                if merger.full:
                    yield merger.batch(schema)
                    merger = _Merger(delta)
        out = merger.batch(schema)
        if out is not None:
            yield out

    return run


def _schema(df: DataFrame, keys: list[str]) -> tuple[str, pa.Schema]:
    kinds = dict(df.dtypes)
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32()}
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "mean double", "weight double"])
    return ddl, pa.schema([*(pa.field(k, arrow[kinds[k]]) for k in keys), pa.field("mean", pa.float64()), pa.field("weight", pa.float64())])


def build_digests(values: DataFrame, keys: list[str], value: str, delta: float = DELTA) -> DataFrame:
    """(keys, mean, weight): the digests of each task, one row per centroid; no shuffle. Null and NaN values are left out.

    Such tables of several days or files may be united and merged with ``merge_digests``. Keys may be strings, integers or dates."""
    used = values.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ddl, schema = _schema(used, keys)
    return used.mapInArrow(_digester(keys, "_v", None, delta, schema), ddl)


def merge_digests(digests: DataFrame, keys: list[str], delta: float = DELTA) -> DataFrame:
    """(keys, mean, weight): one digest per group. Centroids meet by group and salt first and by group then, so a task reads
    at most the digests of its salt; both shuffles move centroids, never values."""
    ddl, schema = _schema(digests, keys)
    merge = _digester(keys, "mean", "weight", delta, schema)
    salted = digests.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    level = salted.repartition(*keys, "_salt").select(*keys, "mean", "weight").mapInArrow(merge, ddl)
    last = level.repartition(*[F.col(k) for k in keys]) if keys else level.coalesce(1)
    return last.sortWithinPartitions(*keys).mapInArrow(merge, ddl)  # in order, so at most one group is emitted in two pieces


def digest_percentiles(digests: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, estimates ARRAY<DOUBLE>): estimates by interpolation between the middles of neighbouring centroids; one row per group."""
    cells = F.array_sort(F.collect_list(F.struct("mean", "weight")))  # a merged digest has at most about 2 * DELTA centroids
    grouped = digests.groupBy(*keys).agg(cells.alias("_c"), F.sum("weight").alias("n"))
    with_middle = F.aggregate(
        "_c", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<m:double,at:double>>").alias("a")),
        lambda acc, c: F.struct((acc["s"] + c["weight"]).alias("s"), F.array_append(acc["a"], F.struct(c["mean"].alias("m"), (acc["s"] + c["weight"] / 2).alias("at"))).alias("a")),
    )["a"]
    staged = grouped.select(*keys, "n", with_middle.alias("_a"))

    def at(share: float) -> Column:
        target = F.col("n") * share
        below = F.array_max(F.transform(F.filter("_a", lambda c: c["at"] <= target), lambda c: F.struct(c["at"].alias("at"), c["m"].alias("m"))))
        above = F.array_min(F.transform(F.filter("_a", lambda c: c["at"] > target), lambda c: F.struct(c["at"].alias("at"), c["m"].alias("m"))))
        mixed = below["m"] + (above["m"] - below["m"]) * (target - below["at"]) / (above["at"] - below["at"])
        return F.coalesce(mixed, below["m"], above["m"])

    return staged.select(*keys, F.col("n").cast("bigint").alias("n"), F.array(*[at(s) for s in shares]).alias("estimates"))


def exact_percentiles(rows: DataFrame, groups: DataFrame, keys: list[str], plain: list[str], shares: list[float], scratch: Scratch) -> DataFrame:
    """(keys, n, estimates, errors, exact) of the groups by counted narrowing: no task holds a group.

    Values are counted by group and value, then by group and ``CUTS`` ranges between its quantiles of the counted values; the
    running counts tell the range that each wanted rank falls into, and only values of these ranges are ranked, each range
    by itself. A value that occurs often is one row with its count. ``rows`` and ``groups`` share the null-free keys ``plain``."""
    met = rows.join(F.broadcast(groups.select(*plain)) if bounded(groups, 100_000) else groups.select(*plain), plain, "left_semi")
    counted = scratch.save(met.groupBy(*plain, "_v").agg(F.count(F.lit(1)).alias("c")), "counted")
    cuts = counted.groupBy(*plain).agg(F.percentile_approx("_v", F.array(*[F.lit((i + 1) / CUTS) for i in range(CUTS - 1)]), F.lit(10 * CUTS)).alias("_cuts"))
    side = F.broadcast(cuts) if bounded(cuts, 10_000) else cuts
    ranged = scratch.save(counted.join(side, plain).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts"), "ranged")
    by_range = Window.partitionBy(*plain).orderBy("_b")
    sizes = ranged.groupBy(*plain, "_b").agg(F.sum("c").alias("m")).withColumn("_to", F.sum("m").over(by_range)).withColumn("_from", F.col("_to") - F.col("m"))  # at most CUTS rows a group
    at = [(i, j) for i in range(len(shares)) for j in (0, 1)]
    rank = lambda i, j: F.least(F.floor((F.col("n") - 1) * F.lit(shares[i])) + j, F.col("n") - 1).cast("bigint")
    wanted = groups.select(*plain, F.explode(F.array(*[F.struct(F.lit(2 * i + j).alias("t"), rank(i, j).alias("k")) for i, j in at])).alias("x")).select(*plain, "x.*")
    placed = wanted.join(sizes, plain).filter("k >= _from and k < _to").select(*plain, "_b", "t", (F.col("k") - F.col("_from")).alias("k"))
    chosen = ranged.join(placed.select(*plain, "_b").distinct(), [*plain, "_b"], "left_semi")
    running = chosen.withColumn("_to", F.sum("c").over(Window.partitionBy(*plain, "_b").orderBy("_v"))).withColumn("_from", F.col("_to") - F.col("c"))
    hit = placed.join(running, [*plain, "_b"]).filter("k >= _from and k < _to").groupBy(*plain).agg(F.map_from_entries(F.collect_list(F.struct("t", "_v"))).alias("_m"))  # two values a share
    part = lambda i: (F.col("n") - 1) * F.lit(shares[i]) - F.floor((F.col("n") - 1) * F.lit(shares[i]))
    value = lambda i: F.col("_m")[F.lit(2 * i)] + (F.col("_m")[F.lit(2 * i + 1)] - F.col("_m")[F.lit(2 * i)]) * part(i)
    found = groups.join(hit, plain)
    return found.select(*keys, "n", F.array(*[value(i) for i in range(len(shares))]).alias("estimates"), F.array(*[F.lit(0.0)] * len(shares)).alias("errors"), F.lit(True).alias("exact"))


def certified_percentiles(values: DataFrame, keys: list[str], value: str, shares: list[float], delta: float = DELTA, max_error: float = MAX_ERROR) -> DataFrame:
    """(keys, n, estimates, errors, exact): percentiles of each group with the certified rank error of each, as a share of n.

    The error of an estimate is the distance from its wanted rank to the ranks it truly holds among the values. A group with
    an error over ``max_error`` gets exact percentiles (``exact`` true, errors 0). Defined cases: null and NaN values are
    left out; a group without values gives no row; null keys are a group; ties share their ranks; an empty table gives an
    empty one. ``values`` should be cheap to read twice: write it first if it is not."""
    spark, scratch = values.sparkSession, Scratch(values.sparkSession, "digests")
    used = values.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    found = scratch.save(digest_percentiles(merge_digests(build_digests(used, keys, "_v", delta), keys, delta), keys, shares), "estimates")
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    plain = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("\x00"))
    side = found.select(*[plain(k).alias(n) for k, n in names.items()], F.col("estimates").alias("_e"))
    rows = used.select(*keys, "_v", *[plain(k).alias(n) for k, n in names.items()])
    small = bounded(side, 100_000)
    met = rows.join(F.broadcast(side), list(names.values())) if small else salted_join(rows, side, list(names.values()))
    counts = [c for i in range(len(shares)) for c in (F.sum((F.col("_v") < F.col("_e")[i]).cast("bigint")).alias(f"_lt{i}"), F.sum((F.col("_v") <= F.col("_e")[i]).cast("bigint")).alias(f"_le{i}"))]
    ranks = met.groupBy(*keys).agg(*counts)
    error = lambda i, s: F.greatest(F.col(f"_lt{i}") - F.col("n") * s, F.col("n") * s - F.col(f"_le{i}"), F.lit(0.0)) / F.col("n")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    both = found.alias("f").join(ranks.alias("r"), same) if keys else found.crossJoin(ranks)
    certified = scratch.save(both.select(*[F.col(f"f.{k}").alias(k) for k in keys], "n", "estimates", F.array(*[error(i, s) for i, s in enumerate(shares)]).alias("errors")), "certified")
    # an error under one rank is as near as a value of the group can come
    wrong = certified.filter(F.exists("errors", lambda e: e > F.greatest(F.lit(max_error), 1.0 / F.col("n"))))
    good = certified.withColumn("exact", F.lit(False))
    if wrong.isEmpty():
        return good
    bad = scratch.save(wrong.select(*keys, *[plain(k).alias(n) for k, n in names.items()], F.col("n").cast("bigint").alias("n")), "wrong")
    exact = exact_percentiles(rows, bad, keys, list(names.values()), shares, scratch)
    kept = good.filter(~F.exists("errors", lambda e: e > F.greatest(F.lit(max_error), 1.0 / F.col("n"))))
    return kept.unionByName(exact)
