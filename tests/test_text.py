"""Text forms, trigrams and identity features against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from larder.functions import identity as I
from larder.functions import text as T
from larder.functions import trigram as G


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("f", "value", "expected"), [
    (T.normalize_text, "Ёлка №5 — Milk 3,2%", "елка 5 milk 3 2"), (T.to_russian_layout, "vjkjrj", "молоко"), (T.to_english_layout, "ащку", "fore"), (T.to_latin, "щука", "schuka"),
    (T.to_cyrillic, "moloko", "молоко"), (T.to_cyrillic, "shchuka", "щука"), (T.normalize_text, None, None), (T.digits_code, "4 600000 002019", "4600000002019"), (T.digits_code, "12", None),
    (T.from_tag, "en:dark-chocolates", "Dark chocolates"), (T.unescape, "&laquo;A&amp;B&raquo;", "«A&B»"), (T.search_variants, "   ", []), (T.search_variants, "Барилла", ["барилла", ",fhbkkf".strip(","), "barilla", "фхбккф"]),
])
def test_forms(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_normal_form_is_idempotent(spark):
    df = spark.createDataFrame([("Ёж, 5%",), ("«A»  b",), ("",), (None,), ("x" * 50_000,)], "v string")
    assert df.filter(~T.normalize_text(T.normalize_text(F.col("v"))).eqNullSafe(T.normalize_text(F.col("v")))).count() == 0


def test_similarity_values(spark):
    df = spark.createDataFrame([("word", "two words"), ("", "a"), ("молоко", "молоко"), (None, "x")], "a string, b string")
    got = [tuple(r) for r in df.select(G.similarity(F.col("a"), F.col("b")), G.word_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0][0] == pytest.approx(4 / 11) and got[0][1] == pytest.approx(0.8) and got[2] == (1.0, 1.0) and got[1] == (0.0, 0.0)


def brute_extent(q, t):
    wanted, seen = set(G._ordered(q)), G._ordered(t)
    best = 0.0
    for i in range(len(seen)):
        for j in range(i + 1, len(seen) + 1):
            run = set(seen[i:j])
            best = max(best, len(wanted & run) / len(wanted | run))
    return best


def test_extent_equals_brute_force():
    for q, t in (("сыр козий", "сыр копчёный козий 200 г"), ("word", "two words"), ("abc", "xbc abd abc"), ("молоко", "мол око молоко"), ("аа", "ааа аа")):
        assert G.best_extent(q, t) == pytest.approx(brute_extent(q, t))


def test_packages_and_markers(spark):
    df = spark.createDataFrame([(980, "г", 1, "кг"), (900, "мл", 1, "л"), (1, "г", 1, "мл"), (None, "г", 1, "кг"), (1, "шт", 1, "шт")], "a int, u string, b int, w string")
    unit = lambda c: I.package_unit(F.col(c))
    got = [r[0] for r in df.select(I.packages_compatible(I.package_base(F.col("a"), unit("u")), I.package_family(unit("u")), I.package_base(F.col("b"), unit("w")), I.package_family(unit("w")))).collect()]
    assert got == [True, False, False, None, None]
    assert one(spark, "Молоко 3,20% 2,5 % 10 шт 900 мл 0,9 л", I.percentages) == ["2.5", "3.2"]
    assert one(spark, "10 шт и 6шт", I.counts) == ["10:шт", "6:шт"]
    assert one(spark, "900 мл 0,9 л 2 гречка", I.name_packages) == ["0.9:л", "900:мл"]
    assert one(spark, None, I.percentages) is None and one(spark, None, I.name_quality) == 0
