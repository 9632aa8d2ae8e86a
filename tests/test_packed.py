"""Packed fields: delimiters, protected spans, defined cases."""

from pyspark.sql import functions as F

from larder.operators.packed import CANDIDATES, found_packed, packed_fields, score_signs, split_by, split_packed

SCHEMA = "rec_id bigint, brands string, packaging string"


def cut(spark, text, signs=",;/|\n\t•\x02"):
    return spark.createDataFrame([(text,)], "t string").select(split_by(F.col("t"), signs).alias("v")).first()["v"]


def test_protected_spans(spark):
    assert cut(spark, "ПЭТ-бутылка 0,5 л, Туба") == ["ПЭТ-бутылка 0,5 л", "Туба"]
    assert cut(spark, "ПЭТ-бутылка 0,5 л/Стекло") == ["ПЭТ-бутылка 0,5 л", "Стекло"]
    assert cut(spark, "бутылка 33/50/пакет 1/2 кг") == ["бутылка 33/50", "пакет 1/2 кг"]
    assert cut(spark, "Крышка (металл, лак); Can") == ["Крышка (металл, лак)", "Can"]
    assert cut(spark, '"Коробка ""с окошком""",«Картон; переработка»,“a, b”') == ['Коробка "с окошком"', "Картон; переработка", "a, b"]
    assert cut(spark, '["Can", "Коробка \\"с окошком\\""]') == ["Can", 'Коробка "с окошком"']
    assert cut(spark, "PP 5 + «бумага + фольга» + Кисель+Компот") == ["PP 5", "бумага + фольга", "Кисель+Компот"]
    assert cut(spark, "н/д, Остамир") == ["н/д", "Остамир"]
    assert cut(spark, "АО Завод \"Чернобрус\",  Лад ") == ['АО Завод "Чернобрус"', "Лад"]


def test_empty_places_and_unbalanced_marks(spark):
    assert cut(spark, ", Sleeve|,Can;; ") == ["Sleeve", "Can"]
    assert cut(spark, 'a "b, c') == ['a "b', "c"]
    assert cut(spark, "    ") == []
    assert cut(spark, '"", x') == ["x"]


def rows(n=60):
    out = [(i, ["A b", "C", "D e", "Lux", "Mir"][i % 5], None) for i in range(n)]
    out += [(n + i, f"{['A b', 'C', 'D e', 'Lux', 'Mir'][i % 5]}, {['C', 'Lux', 'Mir'][i % 3]}", "x/y") for i in range(n)]
    out += [(2 * n, "ко-ко, C", ""), (2 * n + 1, None, None), (2 * n + 2, "ко-ко", "   ")]
    return out


def test_signs_are_inferred_per_field(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    scores = {(r["field_name"], r["sign"]): r["score"] for r in score_signs(packed_fields(df, "rec_id", ["brands", "packaging"]), "field_name", "raw").collect()}
    assert scores["brands", "comma"] > 0.5 and scores["brands", "hyphen"] < 0.25 and scores["packaging", "stroke"] == 0
    found = {(r["rec_id"], r["pos"]): r["val"] for r in found_packed(df, "rec_id", ["brands", "packaging"]).filter("field_name = 'brands'").collect()}
    assert found[120, 1] == "ко-ко" and found[120, 2] == "C" and (122, 1) not in found


def test_other_columns_empty_tables_and_long_values(spark):
    df = spark.createDataFrame([(1, "a, b", "k", 9, "v")], "rec_id int, raw string, source string, pos int, val string").unionByName(
        spark.createDataFrame([(2, ", ".join(["a", "b"] * 30_000), "k", 9, "v"), (2, "a", "k", 9, "v"), (5, "b", "k", 9, "v"), (3, "b", None, 1, ""), (4, "a, a", "k", 1, None)], "rec_id int, raw string, source string, pos int, val string")
    )
    out = split_packed(df, "source", "raw")
    assert set(out.columns) == {"rec_id", "raw", "source", "pos", "val", "n_values"}
    assert out.filter("rec_id = 2 and n_values > 1").count() == 60_000
    assert [r["val"] for r in out.filter("rec_id = 4").orderBy("pos").collect()] == ["a", "a"]
    empty = spark.createDataFrame([], SCHEMA)
    assert found_packed(empty, "rec_id", ["brands", "packaging"]).count() == 0
    assert len(CANDIDATES) > 10
