"""Result and item pages."""

from pyspark.sql import functions as F

from larder.sources import catalogue_pages as K
from larder.sources.html import Page

RESULTS = """<a href="/products/kofe-leggenda?x=1">Кофе Poetti Leggenda 250 г  199 ₽ В корзину</a><a href='/products/kofe-leggenda'>ещё раз</a><a href="/catalog/kofe/">Кофе</a>
<a href="https://s.example/catalog/kofe/poetti-12345678/"><img alt="Poetti Original молотый"></a><a href="/product/chai">Чай зелёный</a><a href="/products/x">abc</a>"""
ITEM = """<h1>Кофе Poetti Leggenda молотый 0,25 кг</h1><p>Бренд</p><p>Poetti</p><p>Штрихкод: 4600000000015</p><h2>Описание</h2><p>Тёмный кофе.</p><p>Для турки</p><h2>Состав</h2><p>зерно</p><meta property="og:image" content="/i/1.svg">"""


def test_links_and_items(spark):
    pages = spark.createDataFrame([(1, "кофе poetti", "https://s.example/search", RESULTS), (2, "кофе", "https://s.example/search", None)], "page_id int, query string, url string, html string")
    got = [(r["url"], r["text"], r["rank"]) for r in K.result_links(pages).orderBy("rank").collect()]
    assert got == [("https://s.example/products/kofe-leggenda", "Кофе Poetti Leggenda 250 г", 1), ("https://s.example/catalog/kofe/poetti-12345678", "Poetti Original молотый", 2)]
    items = spark.createDataFrame([(1, "кофе poetti", "https://s.example/product/a-12345678/?q", ITEM), (2, "кофе чабан", "https://s.example/product/b", ITEM), (3, "кофе", "https://s.example/product/c", None)], "page_id int, query string, url string, html string")
    r = {x["page_id"]: x for x in K.item_records(items, "shop").collect()}
    assert set(r) == {1, 2} and r[1]["relevant"] and not r[2]["relevant"] and r[1]["source_id"] == "12345678" and r[2]["source_id"] == "b"
    assert (r[1]["brand_name"], r[1]["barcode"], float(r[1]["package_value"]), r[1]["package_unit"], r[1]["subtype"], r[1]["description"], r[1]["image_url"]) == ("Poetti", "4600000000015", 0.25, "кг", "Молотый", "Тёмный кофе. Для турки", None)
    assert Page(ITEM).section("состав") == "зерно" and Page("").section("x") is None


def test_relevance(spark):
    cases = [("сметана чабан", "Сметана Простоквашино", False), ("сметана чабан", "Сметана Чабанская 20%", True), ("сметан", "Сметана 20%", True), ("сыр", "Сырок", False), ("", "Сыр", False), ("сыр", "", False), ("растворимый кофе", "Кофе молотый", True)]
    df = spark.createDataFrame([(q, n, i) for i, (q, n, _) in enumerate(cases)], "q string, n string, i int")
    assert [r[0] for r in df.orderBy("i").select(K.is_relevant(F.col("q"), F.col("n"))).collect()] == [x for *_, x in cases]
