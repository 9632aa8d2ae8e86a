"""Fuzzy search against a brute force over all pairs of query and listing, with the reference's weights and thresholds."""

import itertools

from larder.functions import trigram as G
from larder.operators import search as Q

LISTING = "id int, name string, brand_id int, barcode string, package_value decimal(10,3), package_unit string, subtype string, is_active boolean, image_url string, keywords string, search_text string"
#: (weight, least extent, least whole similarity) of each field of the reference that the tables have.
RULES = {"combined": (1.55, 0.42, 9), "search": (1.50, 0.40, 0.3), "name": (1.40, 0.45, 0.3), "brand": (1.30, 0.45, 0.3), "aliases": (1.15, 0.50, 0.3), "keywords": (0.60, 0.55, 0.3), "subtype": (0.55, 9, 0.3)}
BRANDS = {1: ("Лад", "Остамир, Лада"), 2: ("Горная Радуга", None)}


def listing(i, name, brand, subtype=None, keywords=None, text=None):
    return (i, name, brand, None, None, None, subtype, True, None, keywords, text)


ROWS = [
    listing(1, "Молоко", 1), listing(2, "Каша", 2, subtype="овсяная"), listing(3, "Каша рисовая", 2, keywords="завтрак быстрый овёс"), listing(4, "Сыр", 2, text="длинный текст о том как долго зреет мраморный сыр в горах " * 3),
    listing(5, "Хлеб ржаной", 2, text="хлеб ржаной"), listing(6, None, None), listing(7, "Творог", 1, "зернёный", "белок", "творог зерненый"), listing(8, "Хлебцы", 2),
]


def whole(a, b):
    x, y = set(G._ordered(a)), set(G._ordered(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def brute(query, row):
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower().replace("ё", "е")).split())
    brand, aliases = BRANDS.get(row[2], (None, None))
    f = {"name": norm(row[1]), "brand": norm(brand), "aliases": norm(aliases), "subtype": norm(row[6]), "keywords": norm(row[9]), "search": norm(row[10])}
    f["combined"] = f"{f['brand']} {f['name']}"
    at = {k: (G.best_extent(query, f[k]), whole(query, f[k])) for k in RULES}
    if not any(at[k][0] >= e or at[k][1] >= w for k, (_, e, w) in RULES.items()):
        return None
    bonus = next((b for k, b in (("combined", 0.45), ("name", 0.40), ("brand", 0.35)) if f[k].startswith(query)), 0.0)
    return round(max(max(at[k]) * w for k, (w, _, _) in RULES.items()) + bonus, 9)


def test_fuzzy_equals_brute_force(spark):
    cat = Q.catalogue(spark.createDataFrame(ROWS, LISTING), spark.createDataFrame([(k, *v) for k, v in BRANDS.items()], "id int, name string, aliases string"))
    asked = {1: "остамир", 2: "овсяная", 3: "завтрак", 4: "мраморный сыр", 5: "хлеб", 6: "зерненый творог", 7: "горная", 8: "лад молоко"}
    got = {(r["query_id"], r["id"]): round(r["score"], 9) for r in Q.fuzzy_search(spark.createDataFrame(list(asked.items()), "query_id int, query string"), cat).collect()}
    wanted = {(q, row[0]): s for (q, text), row in itertools.product(asked.items(), ROWS) if (s := brute(text, row)) is not None}
    assert {(1, 1), (1, 7), (2, 2), (3, 3), (4, 4)} <= set(wanted)
    assert got == wanted
