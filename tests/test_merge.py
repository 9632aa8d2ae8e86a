"""Match stages, merged fields, links and names on small tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from larder.operators import merge as M

ROW = "name string, brand string, barcode string, package_value decimal(10,3), package_unit string, provider string, source_id string"


def rows(spark, key, data):
    return spark.createDataFrame([(i, n, b, c, None if v is None else Decimal(v), u, p, s) for i, n, b, c, v, u, p, s in data], f"{key} int, {ROW}")


def test_stages(spark):
    old = rows(spark, "id", [
        (1, "Сыр козий мягкий ореховый", "Лад", "4600000000015", None, None, None, None), (2, "Сыр козий твёрдый", "Лад", None, 200, "г", None, None), (3, "Хлеб бородинский", None, None, None, None, None, None), (4, "Сок", "Лад", None, None, None, None, None),
        (5, "Сок", "Мир", None, None, None, None, None), (6, None, None, None, None, None, None, None), (7, "Варенье вишнёвое густое", "Лад", None, 500, "г", None, None), (8, "Варенье вишнёвое густое", "Лад", None, 500, "г", None, None),
        (9, "Кефир деревенский живой 2,5%", "Луг", None, 1, "л", None, None),
    ])
    new = rows(spark, "rec_id", [
        (1, "что угодно", None, "4 600000 000015", None, None, None, None),  # code
        (2, "сыр козий ТВЁРДЫЙ", "лад", None, 198, "г", None, None),  # brand and name, package within three per cent
        (3, "сыр козий твёрдый", "Лад", None, 400, "г", None, None),  # another package
        (4, "Хлеб бородинский", "без бренда", None, None, None, None, None),  # name, no brand on either side
        (5, "Сок", None, None, None, None, None, None),  # only a kind of goods
        (6, "Варенье вишнёвое густое", "Лад", None, 500, "г", None, None),  # two listings
        (7, None, None, None, None, None, None, None),
        (8, "живой деревенский кефир 2,5%", "Луг", None, 1000, "мл", None, None),  # similar: the order differs
        (9, "живой деревенский кефир 3,2%", "Луг", None, 1000, "мл", None, None),  # another percentage
        (10, "живой деревенский кефир греческий 2,5%", "Луг", None, 1000, "мл", None, None),  # one more variant word
        (11, "ничего общего", None, None, None, None, "a", "5"),  # link
        (12, "сыр козий ТВЁРДЫЙ", "лад", "4600000000022", 198, "г", None, None),  # a code of no listing
    ])
    links = spark.createDataFrame([("a ", "5", 4), ("a", "6", 999)], "provider string, source_id string, product_id int")
    got = {r["rec_id"]: (r["product_id"], r["stage"], r["match_type"]) for r in M.match_cascade(new, old, links).collect()}
    assert got == {
        1: (1, 2, "barcode"), 2: (2, 3, "brand_and_name"), 4: (3, 5, "name"), 8: (9, 4, "brand_and_similar_name"), 11: (4, 1, "source_link"), 12: (2, 3, "brand_and_name"),
    }
    assert M.match_cascade(new.limit(0), old).count() == 0


def test_fields(spark):
    s = ", ".join(f"{p}{c} {t}" for p in ("", "new_") for c, t in (("name", "string"), ("barcode", "string"), ("package_value", "int"), ("package_unit", "string"), ("image_url", "string"), ("keywords", "string"), ("brand", "string"), ("category", "string"), ("subtype", "string"), ("description", "string")))
    df = spark.createDataFrame([
        (1, "Сыр", None, None, "г", "https://a/placeholder.png", "сыр", None, "Продукты", None, None, "Сыр козий мягкий 200 г", "46000001", 200, "г", "https://a/b.jpg", "СЫР; козий", "Лад", "Сыры", "козий", "Мягкий сыр из козьего молока"),
        (2, "А", "46000001", 5, "г", None, None, "Лад", "Сыры", "козий", None, None, "46000002", 6, "кг", None, None, "Мир", "Соки", "овечий", None),
    ], "product_id int, " + s)
    got = {r["product_id"]: r for r in M.merge_fields(df).collect()}
    assert got[1]["name"].startswith("Сыр козий") and got[1]["package_value"] == 200 and got[1]["image_url"].endswith("b.jpg") and got[1]["keywords"] == "сыр, козий" and got[1]["brand"] == "Лад" and got[1]["category"] == "Сыры"
    assert set(got[1]["changed"]) == {"name", "brand", "category", "barcode", "package_value", "subtype", "description", "image_url", "keywords"} and got[1]["conflicts"] == []
    assert got[1]["search_text"] == "сыр козий мягкий 200 г лад сыры козий сыр козий мягкий сыр из козьего молока 200 г 46000001"
    assert got[2]["changed"] == [] and set(got[2]["conflicts"]) == {"barcode_conflict", "package_conflict", "brand_conflict", "category_conflict", "subtype_conflict"} and got[2]["barcode"] == "46000001"
    assert M.merge_fields(df, consolidating=True).filter("product_id = 2").first()["conflicts"] == ["subtype_conflict"]
    assert df.select(M.joined_keywords(F.lit(None).cast("string"), F.lit(" , ;"))).first()[0] == ", ;" and df.select(M.joined_keywords(F.lit("а, б"), F.lit("Б; в"))).first()[0] == "а, б, в"


def test_links_and_names(spark):
    links = spark.createDataFrame([("a", "1", 10, "u1"), ("a", "2", 20, None)], "provider string, source_id string, product_id int, source_url string")
    new = spark.createDataFrame([(1, 10, "a", "1", "u2"), (2, 99, "a", "2", "u3"), (3, 30, "b", " 7 ", None), (4, 31, "b", "7", "u4"), (5, 1, None, "1", None), (6, 10, "a", "1", "u1")], "rec_id int, product_id int, provider string, source_id string, source_url string")
    got = {(r["provider"], r["source_id"]): (r["product_id"], r["source_url"], r["status"]) for r in M.link_sources(links, new).collect()}
    assert got == {("a", "1"): (10, "u1", "kept"), ("a", "2"): (20, None, "conflict"), ("b", "7"): (30, None, "inserted")}
    names = spark.createDataFrame([("Лад",), ("лад!",), ("  Мир",), ("мир",), (None,), ("!",)], "name string")
    assert [tuple(r) for r in M.new_names(spark.createDataFrame([("ЛАД",)], "name string"), names).collect()] == [("Мир", "мир")]
