"""Combined search: forms of a query, codes, exact brands, first-seen order."""

from larder.operators import search as Q

LISTING = "id int, name string, brand_id int, barcode string, package_value decimal(10,3), package_unit string, subtype string, is_active boolean, image_url string, keywords string, search_text string"


def listing(i, name, brand, code=None):
    return (i, name, brand, code, None, None, None, True, None, None, None)


def test_combined_search(spark):
    rows = [listing(1, "Молоко топлёное", 1, "4 600000-002019"), listing(2, "Сыр Barilla", 1), listing(3, "Рыба", 2), listing(4, "Рыба Доброфлот", 3), listing(5, "Сок добрый", 3), listing(6, "Вода 4600000002019 ключевая", 1), listing(7, "Молоко 99 злаков", 1)]
    cat = Q.catalogue(spark.createDataFrame(rows, LISTING), spark.createDataFrame([(1, "Лад", None), (2, "Доброфлот", None), (3, "Добрый", None)], "id int, name string, aliases string"))
    asked = [(1, "vjkjrj"), (2, "барилла"), (3, " 4600000002019"), (4, "Доброфлот"), (5, "99"), (6, "moloko"), (7, "молако"), (8, "!")]
    got = {}
    for r in Q.combined_search(spark.createDataFrame(asked, "query_id int, query string"), cat).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["stage"], r["rank"]))
    ids = {q: [x[0] for x in v] for q, v in got.items()}
    assert ids[1] == ids[6] and set(ids[1]) == {1, 7}  # other layout, transliteration
    assert got[2][0][:2] == (2, 1)
    assert got[3] == [(1, 0, 1)]  # a code, and not the listing that holds it as a word
    assert got[4] == [(3, 1, 1)]  # the brand's listings only
    assert got[5][0][:2] == (7, 1)  # digits that are no code
    assert {x[:2] for x in got[7]} == {(1, 2), (7, 2)} and 8 not in got
    for v in got.values():
        assert [x[2] for x in v] == list(range(1, len(v) + 1)) and len({x[0] for x in v}) == len(v)


def test_first_seen_over_forms(spark):
    rows = [listing(i, f"Молоко {i}", 1) for i in range(1, 4)] + [listing(i, f"moloko {i}", 1) for i in range(4, 8)]
    cat = Q.catalogue(spark.createDataFrame(rows, LISTING), spark.createDataFrame([(1, "Лад", None)], "id int, name string, aliases string"))
    found = Q.combined_search(spark.createDataFrame([(1, "moloko")], "query_id int, query string"), cat, limit=6).orderBy("rank").collect()
    assert [r["id"] for r in found] == [4, 5, 6, 7, 1, 2] and {r["stage"] for r in found} == {1}
