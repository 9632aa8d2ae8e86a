"""Quantities recorded in different units, brought to grams, millilitres or pieces.

Stated units are read by expressions. For a bare number the unit is assigned by a mixture on the logarithm of the value:
the stated amounts give, for each base unit, a log-scale mixture density; each candidate unit is that density moved by its
known conversion factor; weights are fitted to the bare numbers by expectation maximisation on a histogram, and every bare
number gets the unit of greatest posterior, flagged as uncertain below a threshold. What is stated for goods of the same
kind (first word of the name) shifts the weights of the base units: milk is stated in millilitres, cheese in grams.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import units
from larder.runtime import small_broadcast

#: Bins of the log10 histograms: steps of 1/BIN over LOW..HIGH, in thousandths of a base unit or in bare values.
BIN, LOW, HIGH = 20, -4.0, 12.0
#: Components of each base unit's density, rounds of fitting, and the posterior below which a unit is uncertain if nothing tells better.
COMPONENTS, ROUNDS, CERTAIN = 4, 60, 0.9
#: Share of right amounts that numbers not flagged as uncertain are to have, by the stated numbers read without their units.
CERTAIN_SHARE, CERTAIN_ROWS = 0.98, 200
#: Records of all kinds that count as much as one kind's own.
KIND_PRIOR = 2.0
#: Weight of the amounts that goods of a kind usually have, and the share of a kind's records from which an amount is usual.
USUAL, USUAL_SHARE = 0.9, 0.005
#: Units a bare number may stand for: name, base unit, thousandths of the base unit.
CANDIDATES = [(words[0], base, float(factor)) for base, factor, words in units.UNITS]
#: Stated numbers that count as many as every unit of a base gets beforehand.
UNIT_PRIOR = 20.0


def stated_amounts(df: DataFrame, key: str, text: str, value: str, unit: str, text_first: bool, name: str | None = None) -> DataFrame:
    """(key, base_unit, amount_milli, stated_in, bare, written, kind): the stated net content of each record, the number a stated unit
    stood beside and, where no unit is stated, the bare number.

    A number with unit in ``text`` and ``value`` with ``unit`` are the two places; ``text_first`` says which goes before. A
    ``text`` that is only a number belongs to ``unit`` if ``text_first``. Null, empty, zero or negative values state
    nothing. ``kind`` is the first word of ``name``. Records are kept as they are, repeated ones too; other columns do not
    matter."""
    kind = F.nullif(F.regexp_extract(F.lower(F.col(name)), r"\p{L}+", 0), F.lit("")) if name else F.lit(None).cast("string")
    own = df.select(F.col(key), kind.alias("_kind"), F.col(text).alias("_text"), F.col(value).cast("string").alias("_value"), units.unit_of(F.col(unit)).alias("_own"))
    read = units.with_amount(own, "_text", "_in_text")
    bare = units.number(units.plain_text(F.col("_text"))) if text_first else F.lit(None).cast("decimal(14,6)")
    read = read.withColumn("_bare", bare).withColumn("_number", units.number(F.col("_value")))
    one = F.lit("1").cast("decimal(7,2)")

    def pair(v: str):
        milli = (F.col(v) * F.col("_own.factor") * one).try_cast(units.MILLI)
        return F.when((milli > 0) & F.col("_own").isNotNull(), F.struct(F.col("_own.base").alias("base"), milli.alias("milli"), F.lit("pair").alias("place")))

    in_text = F.when(F.col("_in_text").isNotNull(), F.struct(F.col("_in_text.base").alias("base"), F.col("_in_text.milli").alias("milli"), F.lit("text").alias("place")))
    found = F.coalesce(in_text, pair("_bare"), pair("_number")) if text_first else F.coalesce(pair("_number"), in_text)
    positive = lambda v: F.when(F.col(v) > 0, F.col(v))
    out = read.withColumn("_a", found).withColumn("_m", units.rounded_milli(F.col("_a.milli")))
    stated = F.col("_m") > 0
    row = F.struct(
        F.when(stated, F.col("_a.base")).alias("base_unit"), F.when(stated, F.col("_m")).alias("amount_milli"), F.when(stated, F.col("_a.place")).alias("stated_in"),
        F.when(F.col("_a").isNull(), F.coalesce(positive("_bare"), positive("_number"))).cast("double").alias("bare"),
        F.when(stated & (F.col("_a.place") == "pair"), F.coalesce(positive("_bare"), positive("_number")) if text_first else positive("_number")).cast("double").alias("written"),
    )
    # the generator keeps later filters from being inlined into the parsing expressions, which would repeat them
    return out.select(key, "_kind", F.explode(F.array(row)).alias("_r")).select(key, "_r.*", F.col("_kind").alias("kind"))


def _histogram(df: DataFrame, base, value) -> dict[str, np.ndarray]:
    """Counts per bin of log10(value) for each base; at most 3 x bins rows reach the driver, whatever the input."""
    n = int((HIGH - LOW) * BIN)
    at = F.least(F.greatest(F.floor((F.log10(value) - LOW) * BIN), F.lit(0)), F.lit(n - 1)).cast("int")
    out: dict[str, np.ndarray] = {}
    for r in df.groupBy(base.alias("b"), at.alias("i")).count().collect():
        if r["i"] is not None:
            out.setdefault(r["b"], np.zeros(n))[r["i"]] += r["count"]
    return out


def _centres() -> np.ndarray:
    return LOW + (np.arange(int((HIGH - LOW) * BIN)) + 0.5) / BIN


def fit_density(counts: np.ndarray) -> list[tuple[float, float, float]]:
    """(weight, mean, deviation) of normal components fitted to a histogram of logarithms."""
    x, n = _centres(), counts.sum()
    if n == 0:
        return []
    cum = np.cumsum(counts) / n
    means = np.array([x[np.searchsorted(cum, (k + 0.5) / COMPONENTS)] for k in range(COMPONENTS)])
    devs, weights = np.full(COMPONENTS, 0.4), np.full(COMPONENTS, 1 / COMPONENTS)
    for _ in range(ROUNDS):
        dens = weights * np.exp(-0.5 * ((x[:, None] - means) / devs) ** 2) / devs
        resp = dens / np.maximum(dens.sum(1, keepdims=True), 1e-300) * counts[:, None]
        mass = np.maximum(resp.sum(0), 1e-9)
        weights, means = mass / mass.sum(), (resp * x[:, None]).sum(0) / mass
        devs = np.sqrt(np.maximum((resp * (x[:, None] - means) ** 2).sum(0) / mass, (1.0 / BIN) ** 2))
    return list(zip(weights.tolist(), means.tolist(), devs.tolist(), strict=True))


def fit_units(stated: dict[str, np.ndarray], bare: np.ndarray, used: dict[tuple[str, float], int] | None = None) -> list[tuple[str, str, float, float, list]]:
    """(unit, base, factor, weight, density) of each candidate unit; weights by expectation maximisation on the bare numbers.

    ``used`` counts the units that stated numbers stand beside, by base and factor: what the weights are before the bare numbers are seen."""
    parts = [(u, b, f, fit_density(stated[b])) for u, b, f in CANDIDATES if b in stated and stated[b].sum()]
    if not parts:
        return []
    x = _centres()
    dens = np.stack([sum(w * np.exp(-0.5 * ((x + math.log10(f) - m) / s) ** 2) / s for w, m, s in d) for _, _, f, d in parts], 1)
    total = sum(stated[b].sum() for b in stated)
    seen = np.array([(used or {}).get((b, f), 0) + UNIT_PRIOR / sum(p[1] == b for p in parts) for _, b, f, _ in parts])
    of_base = np.array([sum(n for n, p in zip(seen, parts, strict=True) if p[1] == b) for _, b, _, _ in parts])
    prior = np.array([stated[b].sum() / total for _, b, _, _ in parts]) * seen / of_base
    weights = prior.copy()
    for _ in range(ROUNDS):
        resp = weights * dens
        resp = resp / np.maximum(resp.sum(1, keepdims=True), 1e-300) * bare[:, None]
        weights = (resp.sum(0) + 10 * prior) / (resp.sum() + 10)
    return [(u, b, f, float(w), d) for (u, b, f, d), w in zip(parts, weights, strict=True)]


def guess_units(amounts: DataFrame) -> DataFrame | None:
    """``amounts`` with ``_g``, the unit of greatest posterior, amount and posterior of each bare or written number; None without a stated amount.

    A stated record does not vote on itself: its own unit is not counted among those of its kind."""
    milli = F.col("amount_milli").cast("double")
    stated = _histogram(amounts.filter("amount_milli is not null"), F.col("base_unit"), milli)
    bare = _histogram(amounts.filter("bare is not null"), F.lit("bare"), F.col("bare")).get("bare", np.zeros(int((HIGH - LOW) * BIN)))
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.log(milli / F.col("written") / f)).alias("d"), F.lit(b).alias("b"), F.lit(f).alias("f")) for _, b, f in CANDIDATES]))
    beside = amounts.filter("written > 0 and amount_milli > 0").select("base_unit", nearest.alias("u")).filter("u.b = base_unit or u.d < 0.01").groupBy("base_unit", "u.f").count().collect()  # at most a row a unit
    parts = fit_units(stated, bare, {(r["base_unit"], r["f"]): r["count"] for r in beside})
    if not parts:
        return None
    bases = sorted({b for _, b, *_ in parts})
    share = {b: sum(w for _, c, _, w, _ in parts if c == b) for b in bases}
    told = amounts.groupBy("kind").agg(*[F.count(F.when(F.col("base_unit") == b, 1)).alias(f"_n{i}") for i, b in enumerate(bases)])
    total_of = sum((F.col(f"_n{i}") for i in range(len(bases))), F.lit(0))
    told = told.filter("kind is not null").withColumn("_all", total_of).filter("_all > 0")
    # amounts that goods of a kind usually have: of each kind at most 1 / USUAL_SHARE
    same = amounts.filter("kind is not null and amount_milli is not null").groupBy("kind", "base_unit", "amount_milli").agg(F.count(F.lit(1)).alias("n"))
    usual = same.join(told.select("kind", "_all"), "kind").filter((F.col("n") >= 2) & (F.col("n") >= USUAL_SHARE * F.col("_all")))
    usual = usual.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("base_unit", F.col("amount_milli").cast("string")).alias("k"), "n"))).alias("_usual"))
    told = told.join(usual, "kind", "left")
    met = amounts.join(small_broadcast(told), "kind", "left")
    own = lambda b: F.when(F.col("base_unit") == b, 1).otherwise(0)
    every = F.when(F.col("base_unit").isNotNull(), 1).otherwise(0)
    lift = {b: F.coalesce((F.col(f"_n{i}") - own(b) + KIND_PRIOR * share[b]) / (F.col("_all") - every + KIND_PRIOR) / F.lit(max(share[b], 1e-9)), F.lit(1.0)) for i, b in enumerate(bases)}
    number = F.coalesce("bare", "written")
    x = F.log10(number)
    at = lambda f: F.floor(number * f + 0.5).try_cast("bigint")
    met_before = lambda b, f: F.greatest(F.coalesce(F.try_element_at("_usual", F.concat(F.lit(b), at(f).cast("string"))), F.lit(0)) - F.when((F.col("base_unit") == b) & (F.col("amount_milli") == at(f)), 1).otherwise(0), F.lit(0))
    # a usual amount of the kind is a point of its density, spread over one bin of the histograms
    points = lambda b, f: F.coalesce(met_before(b, f) / F.greatest(F.col("_all") - every, F.lit(1)), F.lit(0.0)) * (BIN * math.sqrt(2 * math.pi))
    score = lambda b, f, w, d: F.lit(w) * (lift[b] * F.lit(1 - USUAL) * sum((F.lit(cw / s) * F.exp(F.lit(-0.5) * F.pow((x + math.log10(f) - m) / s, F.lit(2.0))) for cw, m, s in d), F.lit(1e-300)) + F.lit(USUAL / max(share[b], 1e-9)) * points(b, f))
    options = F.array(*[F.struct(score(b, f, w, d).alias("p"), F.lit(b).alias("base_unit"), F.lit(f).alias("f")) for _, b, f, w, d in parts])
    found = met.withColumn("_o", F.when(number > 0, options))
    best = F.array_max("_o")
    total = F.aggregate("_o", F.lit(0.0), lambda acc, o: acc + o["p"])
    told = found.withColumn("_g", F.struct(best["base_unit"].alias("base_unit"), best["f"].alias("f"), F.floor(number * best["f"] + 0.5).try_cast("bigint").alias("milli"), (best["p"] / total).alias("p")))
    return told.drop("_o", "_all", "_usual", *[f"_n{i}" for i in range(len(bases))])


def _calibration(guessed: DataFrame) -> dict[tuple[str, float], list[tuple[float, int, int, int]]]:
    """By guessed unit: (least posterior, rows, right bases, right amounts) of the stated numbers read without their units, by steps of the posterior."""
    known = guessed.filter("written > 0 and amount_milli > 0")
    right = F.col("_g.base_unit") == F.col("base_unit")
    near = right & (F.abs(F.col("_g.milli") - F.col("amount_milli")) <= F.col("amount_milli") * 0.001 + 1)
    step = F.least(F.floor(F.col("_g.p") * 200), F.lit(199)).cast("int")
    rows = known.groupBy("_g.base_unit", "_g.f", step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("b"), F.count_if(near).alias("a")).collect()  # at most 200 rows a unit
    out: dict[tuple[str, float], list] = {}
    for r in sorted((r for r in rows if r["s"] is not None), key=lambda r: -r["s"]):
        out.setdefault((r["base_unit"], r["f"]), []).append((r["s"] / 200, r["n"], r["b"], r["a"]))
    return out


def certain_from(steps: list[tuple[float, int, int, int]]) -> float:
    """The least posterior from which ``CERTAIN_SHARE`` of the stated amounts are met; over 1 if none is, ``CERTAIN`` if too few are known."""
    if sum(n for _, n, _, _ in steps) < CERTAIN_ROWS:
        return CERTAIN
    least, rows, right = 1.01, 0, 0
    for p, n, _, a in steps:
        rows, right = rows + n, right + a
        if right >= CERTAIN_SHARE * rows:
            least = p
    return least


def infer_units(amounts: DataFrame) -> DataFrame:
    """``amounts`` of ``stated_amounts`` with bare numbers brought to base units; adds ``confidence`` and ``uncertain``.

    Stated amounts have confidence 1. A bare number gets the candidate unit of greatest posterior. It is flagged below the
    posterior from which ``CERTAIN_SHARE`` of the stated numbers that are guessed to have the same unit, read without their
    units and without their own vote, get their stated amount back. With no stated amount to learn from, bare numbers stay without unit. An empty table gives an
    empty one."""
    guessed = guess_units(amounts)
    if guessed is None:
        return amounts.withColumn("confidence", F.when(F.col("amount_milli").isNotNull(), 1.0)).withColumn("uncertain", F.col("amount_milli").isNull())
    bounds = {unit: certain_from(steps) for unit, steps in _calibration(guessed).items()}
    least = F.lit(CERTAIN)
    for (base, f), bound in bounds.items():
        least = F.when((F.col("_g.base_unit") == base) & (F.col("_g.f") == f), bound).otherwise(least)
    inferred = F.col("bare").isNotNull()
    return guessed.select(
        *[c for c in amounts.columns if c not in ("base_unit", "amount_milli", "stated_in")],
        F.when(inferred, F.col("_g.base_unit")).otherwise(F.col("base_unit")).alias("base_unit"), F.when(inferred, F.col("_g.milli")).otherwise(F.col("amount_milli")).alias("amount_milli"),
        F.when(inferred, "inferred").otherwise(F.col("stated_in")).alias("stated_in"), F.when(inferred, F.col("_g.p")).when(F.col("amount_milli").isNotNull(), 1.0).alias("confidence"),
        F.when(inferred, F.col("_g.p") < least).otherwise(F.col("amount_milli").isNull()).alias("uncertain"),
    )


def holdout_units(amounts: DataFrame) -> DataFrame:
    """(numbers, base_right, amount_right, certain, certain_right): how well stated numbers get their units back without them, and the
    share that would not be flagged and how many of these are right."""
    spark, schema = amounts.sparkSession, "numbers bigint, base_right double, amount_right double, certain double, certain_right double"
    guessed = guess_units(amounts)
    by_unit = _calibration(guessed) if guessed is not None else {}
    steps = [s for found in by_unit.values() for s in found]
    sure = [s for found in by_unit.values() for s in found if s[0] >= certain_from(found)]
    n, k = sum(s[1] for s in steps), sum(s[1] for s in sure)
    share = lambda a, b: a / b if b else None
    return spark.createDataFrame([(n, share(sum(s[2] for s in steps), n), share(sum(s[3] for s in steps), n), share(k, n), share(sum(s[3] for s in sure), k))], schema)


def catalogue_amounts(off: DataFrame, prepared: DataFrame) -> DataFrame:
    """Stated amounts of both record tables: (src_table, rec_id, base_unit, amount_milli, stated_in, bare)."""
    first = stated_amounts(off, "rec_id", "quantity", "product_quantity", "product_quantity_unit", True, "product_name_ru").withColumn("src_table", F.lit("off_products"))
    second = stated_amounts(prepared, "rec_id", "name", "package_value", "package_unit", False, "name").withColumn("src_table", F.lit("prepared_products"))
    return first.unionByName(second)
