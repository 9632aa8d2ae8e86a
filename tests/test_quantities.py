"""Quantities: every written form, rounding, places, inference of missing units."""

import random

import pytest

from larder.functions import units
from larder.operators.quantities import catalogue_amounts, fit_density, infer_units, stated_amounts

CASES = [
    ("350 G", "г", 350_000), ("0.55 Кг", "г", 550_000), ("3kg/уп", "г", 3_000_000), ("масса нетто 350 gram, без жидкости 210 г", "г", 350_000), ("37,5сл", "мл", 375_000),
    ("полтора литра", "мл", 1_500_000), ("2 уп. по 100 шт", "шт", 200_000), ("4х600 G", "г", 2_400_000), ("2*75г.", "г", 150_000), ("2 кг. 250 gram", "г", 2_250_000),
    ("3 шт. по 12 FL OZ", "мл", 1_064_647), ("70 CL * 8", "мл", 5_600_000), ("0,2 л (200 мл)", "мл", 200_000), ("180 G, 18+", "г", 180_000), ("1/2 л", "мл", 500_000), ("¼ л", "мл", 250_000),
    ("1 ½ л", "мл", 1_500_000), ("900мг", "г", 900), ("по 0.1 кг, 3 шт.", "г", 300_000), ("2 pcs of 9,9 kg", "г", 19_800_000), ("1 500 г", "г", 1_500_000), ("150gram / 3,2 %", "г", 150_000),
    ("600 gram (арт. 20417)", "г", 600_000), ("(1 упаковка) 6 шт", "шт", 6_000), ("дюжина", "шт", 12_000), ("два десятка", "шт", 20_000), ("пол-литра", "мл", 500_000), ("полкило", "г", 500_000),
    ("Творог 9% 7,5 вёрст 500 г", "г", 500_000), ("2lb", "г", 907_185), ("50 lb", "г", 22_679_619), ("800 G х 6 шт", "г", 4_800_000), ("Йогурт (500 г)", "г", 500_000), ("10 шт, 18+", "шт", 10_000),
    ("500", None, None), ("на развес", None, None), ("0 г", None, None), ("15%", None, None), ("", None, None), (None, None, None), ("2 года", None, None), ("4.73176 л", "мл", 4_731_760), ("0.00045 кг", "г", 450), ("１２３ г", "г", 123_000), ("150000 x 2 г", None, None), ("9" * 30 + " кг", None, None), ("слово " * 20000 + "5 г", "г", 5_000), ("1500000 мг", "г", 1_500_000),
]


def test_written_amounts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: (r["a"]["base"], r["m"]) if r["a"] else (None, None) for r in units.with_amount(df, "t", "a").withColumn("m", units.rounded_milli(units.F.col("a.milli"))).collect()}
    assert {i: got[i] for i in got} == {i: (b, m) for i, (_, b, m) in enumerate(CASES)}


def test_places_of_an_amount(spark):
    df = spark.createDataFrame([(1, "350 г", "350", "кг"), (2, "600", None, "гр."), (3, None, "0,5", "кг"), (4, "500", None, ""), (5, "на развес", "-1", "г"), (6, "?", "n/a", None), (7, None, None, None)], "rec_id bigint, q string, v string, u string")
    got = {r["rec_id"]: (r["base_unit"], r["amount_milli"], r["stated_in"], r["bare"]) for r in stated_amounts(df, "rec_id", "q", "v", "u", True).collect()}
    assert got[1] == ("г", 350_000, "text", None) and got[2] == ("г", 600_000, "pair", None) and got[3] == ("г", 500_000, "pair", None)
    assert got[4] == (None, None, None, 500.0) and got[5] == got[6] == got[7] == (None, None, None, None)


def test_missing_units_are_inferred_and_flagged(spark):
    rng = random.Random(5)
    stated = [(i, f"{round(rng.lognormvariate(5.8, 0.5))} г", None, None) for i in range(400)]
    bare = [(1000, "450", None, None), (1001, "0.45", None, None)]
    df = spark.createDataFrame(stated + bare, "rec_id bigint, q string, v string, u string")
    got = {r["rec_id"]: r for r in infer_units(stated_amounts(df, "rec_id", "q", "v", "u", True)).filter("rec_id >= 1000").collect()}
    assert got[1000]["amount_milli"] == 450_000 and not got[1000]["uncertain"] and got[1001]["amount_milli"] == 450_000
    assert all(r["stated_in"] == "inferred" and 0 < r["confidence"] <= 1 for r in got.values())


def test_kind_shifts_the_unit(spark):
    rows = [(i, f"{400 + i % 90} {'мл' if i % 2 else 'г'}", None, None, "Молоко" if i % 2 else "Сыр") for i in range(200)] + [(900, "450", None, None, "молоко топлёное"), (901, "450", None, None, "Сыр"), (902, "450", None, None, None)]
    df = spark.createDataFrame(rows, "rec_id bigint, q string, v string, u string, n string")
    got = {r["rec_id"]: (r["base_unit"], r["uncertain"]) for r in infer_units(stated_amounts(df, "rec_id", "q", "v", "u", True, "n")).filter("rec_id >= 900").collect()}
    assert got[900] == ("мл", False) and got[901] == ("г", False) and got[902][1]


def test_empty_and_untaught(spark):
    off, prepared = "rec_id bigint, quantity string, product_quantity string, product_quantity_unit string, product_name_ru string, bare int", "rec_id bigint, name string, package_value decimal(10,3), package_unit string"
    assert infer_units(catalogue_amounts(spark.createDataFrame([], off), spark.createDataFrame([], prepared))).count() == 0
    only = infer_units(catalogue_amounts(spark.createDataFrame([(1, "500", None, None, None, 3)], off), spark.createDataFrame([], prepared))).first()
    assert only["amount_milli"] is None and only["uncertain"]


def test_density_needs_counts():
    import numpy as np

    assert fit_density(np.zeros(320)) == []
    assert sum(w for w, _, _ in fit_density(np.eye(1, 320, 100)[0] * 10)) == pytest.approx(1)
