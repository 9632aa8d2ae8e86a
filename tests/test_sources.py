"""Reading with quarantine, preparation, upsert, pages, paged source, constraints, keyed state and streams."""

import gzip
import json
import time

from pyspark.sql import functions as F

from larder.sources import ingest as N
from larder.sources.html import extract_pages
from larder.sources.paged import PagedRecords
from larder.sources.schemas import broken, duplicates, orphans
from larder.streaming.state import state_as_of, ttl_stream, upsert_stream, windowed_counts


def test_dump_with_quarantine(spark, tmp_path):
    good = [{"code": "46", "product_name": "A", "quantity": "33 cl", "brands": " X , Y"}, {"code": "47", "product_name_ru": "Б", "product_quantity": "2", "product_quantity_unit": "cl", "countries_tags": ["en:russia"]}, {"code": "x", "product_name": "C"}, {"code": "48"}]
    with gzip.open(tmp_path / "d.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join([*map(json.dumps, good), "[1]", "{broken", "", '"text"']))
    records, bad = N.read_dump(spark, str(tmp_path / "d.jsonl.gz"))
    assert records.count() == 4 and bad.count() == 3
    got = {r["barcode"]: r for r in N.prepare(records).collect()}
    assert set(got) == {"46", "47"} and float(got["46"]["package_value"]) == 330 and got["46"]["package_unit"] == "мл" and got["46"]["brand_name"] == "X"
    assert float(got["47"]["package_value"]) == 2 and got["47"]["package_unit"] == "мл" and got["47"]["category_name"] == "Продукты"
    assert records.filter(N.of_country(F.col("countries_tags"))).count() == 1


def test_upsert(spark):
    s = "barcode string, name string, image_url string"
    old = spark.createDataFrame([("1", "a", "i"), ("2", "b", None)], s)
    new = spark.createDataFrame([("1", "c", None), ("3", None, "k")], s)
    assert {tuple(r) for r in N.upsert(old, new, "barcode", ["image_url"]).collect()} == {("1", "c", "i"), ("2", "b", None), ("3", None, "k")}


def test_candidates_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"candidates": [{"classification": "REVIEW", "reason": "a", "score": 1.0, "left_id": 2, "right_id": 1}, {"classification": "REVIEW", "reason": "b", "score": 2.0, "left_id": 1, "right_id": 2}, {"classification": "X", "left_id": 1, "right_id": 3}]}))
    pairs = N.read_candidates(spark, str(tmp_path / "c.json"))
    assert [(r["left_id"], r["right_id"], r["reason"]) for r in pairs.collect()] == [(1, 2, "b")]
    N.write_candidates(pairs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_pages(spark):
    html = """<html><head><meta property="og:image" content="/i.png"><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Сыр","brand":{"name":"Лад"},"gtin13":"46"}]}</script></head>
    <body><h1>Заголовок</h1><p>Категория:</p><p>Сыры</p><a href="/p/1">Один <b>два</b></a><a href="x"><img alt="алт"></a><script>var a = 1;</script></body></html>"""
    pages = spark.createDataFrame([(1, "https://s.example/c/", html), (2, None, "<h1>Только"), (3, "u", None)], "id int, url string, html string")
    got = {r["id"]: r for r in extract_pages(pages, "id", "url", "html").collect()}
    assert (got[1]["name"], got[1]["brand"], got[1]["barcode"], got[1]["category"], got[1]["image_url"]) == ("Сыр", "Лад", "46", "Сыры", "https://s.example/i.png")
    assert [(x["url"], x["text"]) for x in got[1]["links"]] == [("https://s.example/p/1", "Один два"), ("https://s.example/c/x", "алт")]
    assert got[3]["name"] is None and got[3]["links"] == []


def test_paged_source(spark, tmp_path):
    (tmp_path / "page-1.json").write_text('[{"code": 1, "brands": "b"}, 5]')
    (tmp_path / "page-2.json").write_text("broken")
    spark.dataSource.register(PagedRecords)
    df = spark.read.format("paged_records").option("path", str(tmp_path)).option("pages", "3").load()
    assert [(r["code"], r["brands"], r["quantity"]) for r in df.collect()] == [("1", "b", None)]


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "k int, p int")
    assert [tuple(r) for r in duplicates(df, "k").collect()] == [(1, 2)]
    assert orphans(df, "p", spark.createDataFrame([(5,)], "id int"), "id").count() == 1
    assert {tuple(r) for r in broken(df, set_p="p is not null", big="k > 1").collect()} == {("set_p", 1), ("big", 2)}


def test_state_as_of(spark):
    rows = [(1, "2024-01-01 00:00:00", "save", "a"), (1, "2024-01-01 00:05:00", "save", "b"), (2, "2024-01-01 00:00:00", "save", "c"), (2, "2024-01-01 00:01:00", "clear", None), (3, "2023-12-31 23:59:59", "save", "d"), (4, "2024-01-01 00:20:00", "save", "e"), (None, "2024-01-01 00:14:00", "save", "f")]
    events = spark.createDataFrame(rows, "k int, ts string, a string, p string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["k"], r["payload"]) for r in state_as_of(events, "k", "ts", "a", "p", "2024-01-01 00:15:00").collect()}
    assert got == {(1, "b"), (None, "f")}


def run(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    schema = "k int, a string, p string, ts timestamp"
    (tmp_path / "in").mkdir()
    write = lambda n, rows: spark.createDataFrame(rows, "k int, a string, p string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(0, [(1, "save", "x", "2024-01-01 00:00:00"), (1, "get", None, "2024-01-01 00:00:01"), (2, "get", None, "2024-01-01 00:00:02"), (1, "clear", None, "2024-01-01 00:00:03"), (1, "get", None, "2024-01-01 00:00:04")])
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ttl_stream(stream(), "k", "a", "p").writeStream.format("memory").queryName("ttl").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    end = time.time() + 60  # timeouts keep such a query busy, so its table is watched instead
    while time.time() < end and spark.table("ttl").count() < 3:
        time.sleep(0.5)
    q.stop()
    assert {(r["k"], r["found"]) for r in spark.table("ttl").collect()} == {(1, True), (2, False), (1, False)}
    q = upsert_stream(stream(), str(tmp_path / "t"), ["k"], "ts", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    write(1, [(2, "save", "new", "2024-01-02 00:00:00")])
    time.sleep(1)
    run(q)
    got = {r["k"]: r["a"] for r in spark.read.parquet(str(tmp_path / "t" / "v1")).collect()}
    assert got == {1: "get", 2: "save"}
    counted = windowed_counts(spark.read.schema(schema).parquet(str(tmp_path / "in")), "ts", "a")
    assert counted.agg(F.sum("n")).first()[0] == 6
