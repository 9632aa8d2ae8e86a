"""Blocking, evidence, each rule of the classification, consolidation, families and search on small tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from larder.operators import families as A
from larder.operators import ratings as M
from larder.operators import resolution as R
from larder.operators import search as Q

LISTING = "id int, name string, brand_id int, brand string, category_id int, barcode string, package_value decimal(10,3), package_unit string, subtype string, is_active boolean, image_url string, keywords string, search_text string, category string"


def listing(i, name, code=None, value=None, unit=None, brand="Лад", category="Сыры", subtype=None):
    return (i, name, 1, brand, 1, code, None if value is None else Decimal(value), unit, subtype, True, None, None, None, category)


def numbered(cases, schema, spark):
    """The listings of all pairs with ids 1 and 2, 3 and 4, ..., and the pairs: one run for all cases."""
    rows = [(2 * n + k, *side[1:]) for n, sides in enumerate(cases) for k, side in enumerate(sides, 1)]
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(2 * n + 1, 2 * n + 2) for n in range(len(cases))], "left_id int, right_id int")


CODE, OTHER = "4600682001286", "4607010741555"
SAME = "Сыр мраморный пряный ореховый"


def test_scanner_rules(spark):
    """One case for each branch; the numbers are those of the fixtures."""
    turned, hard = "ореховый пряный мраморный", "hard_identity_conflict"
    cases = [
        (listing(1, SAME, CODE), listing(2, SAME + " сыр", "4 600682 001286"), "same_barcode", 100.0, None),  # 1
        (listing(1, SAME, value=900, unit="г"), listing(2, SAME, value=900, unit="г"), "exact_name_and_package", 97.0, None),  # 2
        (listing(1, SAME, value=900, unit="г", category="Продукты"), listing(2, SAME, value=900, unit="г"), "exact_name_package_generic_category", 90.0, None),  # 3
        (listing(1, "Сметана отборная 3,2%"), listing(2, "Сметана отборная 2,5%"), hard, 0.0, "different_percentage"),  # 4
        (listing(1, SAME, value=900, unit="мл"), listing(2, SAME, value=1, unit="л"), hard, 0.0, "different_package"),  # 5
        (listing(1, SAME, value=980, unit="г"), listing(2, SAME, value=1, unit="кг"), "exact_name_and_package", 97.0, None),  # 6
        (listing(1, SAME, CODE, 900, "г"), listing(2, SAME, OTHER, 900, "г"), "exact_identity_but_different_barcode", 92.0, None),  # 7
        (listing(1, SAME, CODE, 900, "г"), listing(2, SAME, OTHER), "exact_name_but_different_barcode_package_unknown", 82.0, "package_present_only_on_one_side"),  # 8
        (listing(1, "Сыр козий", CODE), listing(2, "козий"), "one_barcode_plus_related_identity", 87.0, "barcode_present_only_on_one_side"),  # 9
        (listing(1, "Сыр козий пряный"), listing(2, "Сыр козий ореховый"), hard, 0.0, "different_variant_tokens"),  # 10
        (listing(1, SAME, CODE), listing(2, SAME + " лёгкий", OTHER), "different_barcode_and_variant", 0.0, "one_sided_variant_tokens"),  # 11
        (listing(1, SAME, value=900, unit="г"), listing(2, SAME, value=900, unit="мл"), hard, 0.0, "different_package"),  # 12
        (listing(1, SAME, CODE, 900, "г"), listing(2, turned, OTHER, 900, "г"), "near_identical_but_different_barcode", 90.0, None),
        (listing(1, SAME, CODE), listing(2, turned, OTHER), "different_barcode", 0.0, None),
        (listing(1, SAME, value=900, unit="г"), listing(2, turned, value=900, unit="г"), "very_strong_identity", 96.0, None),
        (listing(1, SAME, value=900, unit="г", category="еда"), listing(2, turned, value=900, unit="г"), "very_strong_identity_generic_category", 94.0, None),
        (listing(1, SAME), listing(2, turned), "strong_similarity_needs_review", 83.0, None),
        (listing(1, "Сыр"), listing(2, "сыр!"), "exact_name_but_identity_incomplete", 78.0, None),
        (listing(1, "Сыр козий"), listing(2, "Сыр"), "insufficient_identity_evidence", 0.0, "one_sided_variant_tokens"),
        (listing(1, "Упаковка 6 шт пряная"), listing(2, "Упаковка 4 шт пряная"), hard, 0.0, "different_count"),
        (listing(1, None), listing(2, None), "exact_name_but_identity_incomplete", 78.0, None),
    ]
    df, pairs = numbered([c[:2] for c in cases], LISTING, spark)
    got = {r["left_id"]: r for r in R.scan(pairs, R.features(df)).collect()}
    for n, (*_, reason, score, tag) in enumerate(cases):
        r = got[2 * n + 1]
        assert (r["reason"], r["score"]) == (reason, score) and tag in [*r["hard_conflicts"], *r["soft_differences"], None], (n, r)


LINKED = LISTING + ", links array<struct<provider:string,source_id:string>>"


def test_verifier_rules(spark):
    pack = dict(value=900, unit="г")
    linked = lambda row, *links: (*row, list(links))
    cases = [
        (listing(1, SAME, **pack), listing(2, SAME, brand="Мир", **pack), "hard_identity_conflict", 99.0, None),
        (listing(1, SAME, CODE), listing(2, SAME + " лёгкий", OTHER), "different_barcode_plus_variant_difference", 99.0, None),
        (listing(1, SAME, CODE), listing(2, SAME, OTHER), "barcode_conflict_requires_external_confirmation", 75.0, None),
        (listing(1, SAME), listing(2, SAME + " лёгкий"), "one_sided_sku_variant_requires_confirmation", 70.0, None),
        (listing(1, SAME, subtype="козий"), listing(2, SAME, subtype="овечий"), "subtype_difference_requires_confirmation", 70.0, None),
        (listing(1, SAME, CODE, **pack), listing(2, SAME, CODE, subtype="козий", **pack), "same_barcode_plus_core_identity", 100.0, 2),
        (linked(listing(1, SAME, **pack), ("a", "1")), linked(listing(2, SAME, **pack), ("A", "1"), ("b", "2")), "same_external_identity_plus_core_identity", 99.0, 2),
        (linked(listing(1, SAME, **pack), ("a", "1")), linked(listing(2, SAME, **pack), ("b", "2")), "independent_sources_plus_exact_core_identity", 98.0, 1),
        (listing(1, SAME, **pack), listing(2, SAME, **pack), "core_identity_matches_but_no_independent_confirmation", 85.0, None),
        (listing(1, SAME), listing(2, SAME), "related_core_identity_needs_more_evidence", 75.0, None),
        (listing(1, "Сыр"), listing(2, "Чай", category="Чаи"), "weak_name_and_incompatible_category", 95.0, None),
        (listing(1, None), listing(2, "Чай"), "insufficient_evidence_for_safe_decision", 60.0, None),
    ]
    full = [tuple(side if isinstance(side[-1], list) else linked(side) for side in c[:2]) for c in cases]
    df, pairs = numbered(full, LINKED, spark)
    got = {r["left_id"]: r for r in R.verify(pairs, R.features(df), R.completeness(df)).collect()}
    for n, (*_, reason, confidence, side) in enumerate(cases):
        r = got[2 * n + 1]
        assert (r["reason"], r["confidence"], r["canonical_product_id"]) == (reason, confidence, side and 2 * n + side), (n, r)


def test_consolidation_safety_and_aliases(spark):
    df = spark.createDataFrame([listing(1, SAME, CODE), listing(2, SAME, OTHER, category="Соки"), listing(3, "сыр")], LISTING)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "canonical_id int, duplicate_id int")
    got = {r["duplicate_id"]: (r["blocked"], r["conflicts"]) for r in R.safety(pairs, R.features(df)).collect()}
    assert got == {2: (["barcode_conflict", "category_conflict"], ["package_not_confirmed"]), 3: (["name_similarity_too_weak"], ["package_not_confirmed"])}
    aliases = spark.createDataFrame([(1, "Мраморный"), (2, "мраморный!"), (2, "Пряный")], "product_id int, alias string")
    ids = spark.createDataFrame([(2, 1)], "id int, canonical_id int")
    assert {(r["product_id"], r["alias"]) for r in R.kept_aliases(aliases, df, ids).collect()} == {(1, "Мраморный"), (1, "Пряный"), (1, SAME)}


def test_blocking(spark):
    df = spark.createDataFrame([listing(1, "Сыр козий ореховый"), listing(2, "козий ореховый сыр мягкий"), listing(3, "Хлеб"), listing(4, "Хлеб"), listing(5, "Хлеб"), listing(6, None), listing(7, "козий", CODE), listing(8, "козий ореховый", brand="unknown")], LISTING)
    pairs = lambda **k: {(r["left_id"], r["right_id"]): (r["common"], r["same_name"]) for r in R.blocking_pairs(df, **k).collect()}
    got = pairs()
    assert got[1, 2] == (2, False) and got[3, 4] == got[3, 5] == (0, True) and (4, 5) not in got
    assert got[1, 7] == (1, False) and not any(8 in k for k in got)
    assert (1, 2) not in pairs(most=1) and pairs(most=None)[1, 2] == (2, False) and (4, 5) not in pairs(most=None) and pairs(most=None)[1, 7] == (1, False)
    assert R.blocking_pairs(df.limit(0)).count() == 0 and R.blocking_pairs(df.limit(0), most=None).count() == 0


def test_consolidation_keeps_own_rows(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "a"), (3, 20, "b"), (4, None, "c")], "id int, product_id int, source_id string")
    ids = spark.createDataFrame([(20, 10)], "id int, canonical_id int")
    got = {(r["product_id"], r["source_id"]): r["id"] for r in R.repoint(rows, ids, "product_id", ["product_id", "source_id"], F.col("id")).collect()}
    assert got == {(10, "a"): 1, (10, "b"): 3, (None, "c"): 4}
    assert R.repoint(rows, ids, "product_id").groupBy("product_id").count().filter("product_id = 10").first()["count"] == 3


def test_best_pairs_and_canonical(spark):
    c = spark.createDataFrame([(1, 5, 3, 0.5), (2, 3, 5, 0.5), (3, 3, 5, None), (4, 7, 7, 1.0), (5, None, 3, 1.0)], "cand_id int, left_id int, right_id int, score double")
    best = R.best_pairs(c, F.col("cand_id")).collect()
    assert [(r["left_id"], r["right_id"], r["cand_id"]) for r in best] == [(3, 5, 1)]
    scored = spark.createDataFrame([(3, 10, False, 2), (5, 10, True, 0)], "id int, score int, coded boolean, sources int")
    assert R.choose_canonical(R.best_pairs(c, F.col("cand_id")), scored).first()["canonical_id"] == 5


def test_families_and_intents(spark):
    df = spark.createDataFrame([listing(1, "Новинка Молоко Лад топлёное 3,2% 900 мл"), listing(2, "Молоко топлёное молоко Лад"), listing(3, None)], LISTING)
    got = {r["id"]: (r["family"], r["family_id"]) for r in A.assign_families(df).collect()}
    assert got == {1: ("молоко топленое", 1), 2: ("молоко топленое", 1)}
    hits = spark.createDataFrame([(1, "сыр", f"сыр козий мягкий {i}") for i in range(6)] + [(2, "сыр", "сыр козий")], "query_id int, query string, text string")
    assert {(r["query_id"], r["phrase"], r["n"]) for r in A.intents(hits).collect()} == {(1, "козий", 6), (1, "мягкий", 6), (1, "козий мягкий", 6)}


def test_search_stages(spark):
    products = spark.createDataFrame([listing(1, "Молоко топлёное Лад"), listing(2, "Молоко"), listing(3, "Сыр топлёный"), listing(4, None)], LISTING).drop("brand")
    cat = Q.catalogue(products, spark.createDataFrame([(1, "Лад", None)], "id int, name string, aliases string"))
    asked = spark.createDataFrame([(1, "молоко"), (2, "молако топлёное"), (3, "")], "query_id int, query string")
    strict = {(r["query_id"], r["id"]): r["rank"] for r in Q.strict_search(asked, cat).collect()}
    assert strict == {(1, 1): 1, (1, 2): 2}
    fuzzy = [(r["query_id"], r["id"]) for r in Q.fuzzy_search(asked, cat).filter("query_id = 2").orderBy("rank").collect()]
    assert fuzzy[0] == (2, 1)
    merged = Q.merge_stages(Q.strict_search(asked, cat), Q.fuzzy_search(asked, cat)).filter("query_id = 1").orderBy("rank").collect()
    assert [r["id"] for r in merged][:2] == [1, 2] and len({r["id"] for r in merged}) == len(merged)


def test_ratings(spark):
    votes = spark.createDataFrame([(1, 10, 9, 1), (1, 10, 7, 2), (2, 10, 8, 1), (3, 11, 1, 1)], "user_id int, product_id int, score int, t int")
    last = M.latest(votes, ["user_id", "product_id"], "t")
    assert {(r["user_id"], r["score"]) for r in last.collect()} == {(1, 7), (2, 8), (3, 1)}
    got = {r["product_id"]: r["weighted"] for r in M.shrunken_ratings(last).collect()}
    mean = 16 / 3
    assert abs(got[10] - (2 / 22 * 7.5 + 20 / 22 * mean)) < 1e-12
    levels = spark.createDataFrame([(0, 100.0), (4, 100.0), (19, 100.0), (99, 100.0), (100, 100.0)], "v int, q double").select(M.trust_score(F.col("v"), F.col("q")).alias("t"), M.trust_level(F.col("v")).alias("l")).collect()
    assert [round(r["t"], 1) for r in levels] == [0.0, 30.0, 55.0, 79.0, 100.0] and [r["l"] for r in levels] == ["no_data", "very_low", "low", "medium", "high"]
