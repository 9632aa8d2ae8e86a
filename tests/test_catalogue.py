"""Open records, category mapping, canonical families, intents, tokens and cards on small tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import cards as C
from larder.operators import categories as G
from larder.operators import families as A
from larder.sources import open_records as O


def test_payloads(spark):
    rows = [
        ("1", {"product_name_ru": " ", "product_name_fi": "Maito", "product_name_de": "Milch", "generic_name": "x", "brands": "A, a ,B", "categories": "Milk,milk, Cheese", "quantity": "1 l"}),
        ("2", {"generic_name_fr": "Lait", "ingredients_text_fr": "lait", "product_quantity": "12.5"}), ("3", None), ("4", {"product_name_en": "Soap", "product_name": "Мыло"}),
    ]
    df = spark.createDataFrame(rows, "code string, payload map<string,string>")
    got = {r["code"]: r for r in O.normalized_payloads(df).collect()}
    assert got["1"]["name"] == "Milch" and got["1"]["categories"] == ["Milk", "Cheese"] and not got["1"]["sparse"] and got["1"]["name_ru"] is None
    assert got["2"]["name"] == got["2"]["generic"] == "Lait" and got["2"]["ingredients"] == "lait" and got["2"]["quantity"] == 12.5 and got["2"]["sparse"]
    assert got["3"]["name"] is None and got["3"]["sparse"] in (True, None) and got["4"]["name"] == "Мыло"
    merged = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "", "b": "3", "c": "[]", "d": "4"})], "x map<string,string>, y map<string,string>").select(O.merged_payload(F.col("x"), F.col("y"))).first()[0]
    assert {k: v for k, v in merged.items() if v is not None} == {"a": "1", "b": "3", "d": "4"}


def test_open_listings(spark):
    schema = "rec_id int, product_name_ru string, product_name string, generic_name string, brands string, categories string, countries_tags array<string>, amount decimal(10,3), unit string"
    rows = [
        (1, "Кофе", "Jardin растворимый тёмный", "coffee", "без бренда; Жардин", "en:instant-coffees, Instant coffee, Кофе", ["en:russia"], Decimal("95.50"), "г"), (2, "Молоко", None, None, "Лад", "milk", None, Decimal(1), "л"),
        (3, None, None, None, None, None, None, None, None), (4, "Молоко Лад 1 л", None, "Напиток", "Лад", None, None, Decimal(1), "л"),
    ]
    got = {r["rec_id"]: r for r in O.open_listings(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["brand"], got[1]["name"], got[1]["kind"], got[1]["subtype"]) == ("Жардин", "Jardin растворимый тёмный", "Кофе", "Растворимый")
    assert got[1]["full_name"] == "Жардин Jardin растворимый тёмный 95.5 г" and got[1]["keywords"] == "Instant coffees, Instant coffee, Кофе, Russia, Жардин" and got[1]["description"] is None
    assert got[2]["full_name"] == "Молоко Лад 1 л" and got[4]["full_name"] == "Молоко Лад 1 л" and got[4]["description"] == "Напиток"
    assert all(got[3][c] is None for c in ("brand", "name", "kind", "full_name", "keywords"))


def test_category_ways(spark):
    known = spark.createDataFrame([(1, "Молочные продукты"), (2, "Рыба"), (3, "Продукты"), (4, "Сок")], "id bigint, name string")
    rules = spark.createDataFrame([(1, "молоко", ["нет", "молочные продукты"], ["milk", "whole milk"]), (2, "рыба и икра", ["рыба"], ["fish"]), (3, "пусто", ["нет"], ["void"])], "place int, rule string, targets array<string>, aliases array<string>")
    rows = [(1, "РЫБА!", None), (2, "Milk", None), (3, "fresh whole milk", ["fish"]), (4, "томатный сок", None), (5, "void", ["другие продукты"]), (6, None, None), (7, "fish and milk", ["сок"])]
    values = G.incoming_values(spark.createDataFrame(rows, "k int, name string, more array<string>"), "k", "name", "more")
    got = {r["k"]: (r["category_id"], r["matched_by"], r["confidence"], r["source_value"]) for r in G.map_categories(values, known, rules, "k").collect()}
    assert got == {
        1: (2, "database_exact", 100.0, "РЫБА!"), 2: (1, "rule_exact:молоко", 97.0, "Milk"), 3: (2, "rule_exact:рыба и икра", 97.0, "fish"), 4: (4, "database_contains", 82.0, "томатный сок"), 5: (None, "not_found", 0.0, "void"),
        7: (4, "database_exact", 100.0, "сок"),
    }
    assert G.map_categories(values.limit(0), known, rules, "k").count() == 0


def test_canonical_families(spark):
    rows = [(1, 1, "Молоко пастеризованное Лад 1 л", "Лад", None, None), (2, 1, "Молоко ультрапастеризованное", None, None, None), (3, 1, "Кофе Лад", "Лад", "в зёрнах", None), (4, 1, "Морс клюквенный Лад 2 л", "Лад", None, None), (5, 1, None, None, None, None), (6, 2, "Напиток", None, None, "овсяное молоко")]
    got = {r["id"]: (r["family"], r["canonical"]) for r in A.named_families(spark.createDataFrame(rows, "id int, category_id int, name string, brand string, subtype string, keywords string")).collect()}
    assert got == {1: ("молоко пастеризованное", True), 2: ("молоко ультрапастеризованное", True), 3: ("кофе в зернах", True), 4: ("морс клюквенный", False), 6: ("молоко овсяное", True)}


def test_readable_intents(spark):
    rows = [
        (1, "молоко", "молоко топленое", 9), (1, "молоко", "ультрапастеризованное", 7), (1, "молоко", "ультравысокотемпературно", 8), (1, "молоко", "milk", 50), (1, "молоко", "молоко", 60), (1, "молоко", "натуральное деревенское", 5), (1, "молоко", "козье", 9), (1, "молоко", "", 3),
        (2, "кофе", "кофе в зернах", 4), (2, "кофе", "зерновой", 6), (2, "кофе", "x", 0),
    ]
    got = [(r["query_id"], r["title"], r["n"], r["rank"]) for r in A.human_intents(spark.createDataFrame(rows, "query_id int, query string, phrase string, n int")).orderBy("query_id", "rank").collect()]
    assert got == [(1, "Козье", 9, 1), (1, "Топлёное", 9, 2), (1, "Ультрапастеризованное", 8, 3), (1, "Деревенское", 5, 4), (2, "Зерновой", 6, 1)]


def test_tokens(spark):
    df = spark.createDataFrame([("Молоко 3,2% для детей 930мл и 2 шт",), ("",), (None,)], "t string").withColumn("k", T.query_tokens(F.col("t")))
    rows = df.select("t", F.transform("k", lambda t: t["value"]).alias("v"), T.query_package(F.col("k")).alias("p"), F.transform(T.without_package(F.col("k")), lambda t: t["value"]).alias("w"), T.phrase(F.col("t")).alias("f")).collect()
    assert rows[0]["v"] == ["молоко", "3", "2", "детей", "930", "мл", "2", "шт"] and (rows[0]["p"]["value"], rows[0]["p"]["unit"]) == (930.0, "мл") and rows[0]["w"] == ["молоко", "3", "2", "детей", "2", "шт"]
    assert rows[1]["v"] == [] and rows[1]["p"] is None and rows[2]["v"] is None and rows[1]["f"] == rows[2]["f"] == ""
    pairs = spark.createDataFrame([("сыр", "козий"), ("Сыр козий", "КОЗИЙ"), ("", "а"), ("а", "")], "q string, t string")
    assert [r[0] for r in pairs.select(T.refined(F.col("q"), F.col("t"))).collect()] == ["сыр козий", "Сыр козий", "а", "а"]


def test_cards(spark):
    schema = "id int, name string, brand string, category string, barcode string, package_value decimal(10,3), package_unit string, image_url string, description string, subtype string, keywords string, image_valid boolean"
    rows = [
        (1, "Сыр козий мягкий", "Лад", "Сыры", "4600000000015", Decimal(200), "г", "https://a/b.jpg", "x" * 150, "козий", "сыр", True), (2, "Сыр", "без бренда", "Продукты", "12", None, "г", "https://a/b.jpg", "коротко", None, None, None),
        (3, None, None, None, None, None, None, None, None, None, None, None), (4, "Сыр козий мягкий", "Лад", "Сыры", "4600000000015", Decimal(200), "г", "img/stub.png", "x" * 150, "козий", "сыр", None),
    ]
    got = {r["id"]: r for r in C.evaluate_cards(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["score"], got[1]["identity"], got[1]["presentation"], got[1]["complete"], got[1]["missing"]) == (100.0, 100.0, 100.0, True, [])
    assert got[2]["weak"] == ["name", "brand", "category", "package", "image_url", "description", "barcode"] and got[2]["missing"] == ["subtype", "keywords"] and got[2]["next"][:2] == ["brand", "name"] and got[2]["score"] == 6 + 2 + 3 + 5 + 3 + 3 + 2
    assert got[3]["score"] == 0 and len(got[3]["missing"]) == 9 and got[4]["weak"] == ["image_url"] and not got[4]["complete"]


def test_candidate_identity(spark):
    base = ("Сыр козий мягкий ореховый", "Лад", None, Decimal(200), "г", ["image_url"])
    def case(**new):
        row = {"name": "сыр козий мягкий ореховый", "brand": "Лад", "barcode": None, "value": Decimal(200), "unit": "г", "image": "i", "text": None} | new
        return (row["name"], row["brand"], row["barcode"], row["value"], row["unit"], row["image"], row["text"])
    code = ("Сыр козий мягкий ореховый", "Лад", "4600000000015", Decimal(200), "г", [])
    pairs = [
        (base, case(), "brand_name_package", 105.0), (base, case(brand="Мир"), "brand_conflict", 0), (base, case(value=Decimal(202)), "package_conflict", 0), (base, case(value=None), "package_not_confirmed", 0), (base, case(brand=None), "missing_external_brand", 0),
        (base, case(name="ореховый"), "weak_name_common_tokens", 0), (code, case(barcode="4600000000022"), "barcode_conflict", 0), (code, case(barcode="4600000000015"), "exact_barcode", 103.0), (code, case(barcode="4600000000015", name="хлеб"), "barcode_name_mismatch", 0),
        (("Сыр козий", None, None, None, None, []), case(brand=None), "no_brand_evidence", 0),
    ]
    schema = "n int, name string, brand string, barcode string, package_value decimal(10,3), package_unit string, needed array<string>, new_name string, new_brand string, new_barcode string, new_package_value decimal(10,3), new_package_unit string, new_image_url string, new_description string"
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b, *_) in enumerate(pairs)], schema)
    got = {r["n"]: (r["why"], r["points"]) for r in C.candidate_identity(df).collect()}
    assert got == {i: (why, float(points)) for i, (*_, why, points) in enumerate(pairs)}


def test_candidate_pairs_are_neither_shuffled_nor_doubled(spark, monkeypatch):
    """Each meeting pair once, by code or by brand and word, hot keys in blocks, repeated ids as often as both sides have them; no shuffle after the join."""
    monkeypatch.setattr(C, "BLOCK_PAIRS", 20)
    card = "id int, name string, brand string, barcode string, package_value decimal(10,3), package_unit string, needed array<string>"
    cards = [(i, f"Молоко отборное {i % 3}", "Остамир", f"460000000{i:04d}" if i % 2 else None, Decimal(1), "л", ["image_url"]) for i in range(12)]
    cards += [(3, "Сыр козий", "Остамир", None, None, None, []), (50, "Кефир", None, "4600000000001", None, None, []), (None, "Молоко", "Остамир", None, None, None, []), (51, None, "", None, None, None, [])]
    record = "rec_id bigint, new_name string, new_brand string, new_barcode string, new_package_value decimal(10,3), new_package_unit string, new_image_url string, new_description string"
    records = [(i, f"Молоко отборное {i % 3}", "остамир", f"460000000{i:04d}", Decimal(1000), "мл", "u", None) for i in range(9)] + [(70, "Сыр козий", "Остамир", None, None, None, None, None), (None, "Молоко", "Остамир", None, None, None, None, None), (71, None, "", None, None, None, None, None)]
    a, r = spark.createDataFrame(cards, card), spark.createDataFrame(records, record)
    found = C.candidate_pairs(a, r)
    word = lambda name: name.lower().split()[0] if name else None
    ends = {(x[0], y[0]) for x in cards for y in records if x[0] is not None and y[0] is not None and (x[3] and x[3] == y[3] or x[1] and y[1] and x[2] and x[2].lower() == y[2].lower() and word(x[1]) == word(y[1]))}
    own = a.select(*[F.col(c) for c in a.columns if c != "needed"]).join(a.select("id", "needed"), "id")
    pairs = spark.createDataFrame(sorted(ends), "id int, rec_id bigint").join(own, "id").join(r, "rec_id")
    plain = C.candidate_identity(pairs).select("id", "rec_id", "accepted", "points", "why")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and len(ends) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("Join")].count("Aggregate") == 0
