"""Canonical mapping, survivors, percentiles, groups, listings: brute force and defined cases on small tables."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import canonical as C
from larder.llm import digests as D
from larder.llm import groups as G
from larder.llm import listings as L
from larder.llm import survivors as S

BRANDS = [(1, "Сметливый Трактир", "Smetlivyy Traktir / Сме. Трактир"), (2, "Остамир", "Ostamir"), (3, "Velnezza", "Велнезза, Рудесан"), (4, "7,5 вёрст", None), (5, "Артель \"Семь Вёдер\"", ""), (6, "Junrodale", None)]


def mapped(spark, values):
    ref = spark.createDataFrame(BRANDS, "id int, name string, aliases string")
    df = spark.createDataFrame(list(enumerate(values)), "i int, val string")
    return [r["b"] for r in C.map_values(df, "val", ref, "id", "name", "aliases", "b").orderBy("i").collect()]


def test_spellings_reach_their_brand(spark):
    cases = {
        "СМЕТЛИВЫЙ  ТРАКТИР": 1, "Сметливлй Трактср": 1, "СметливыйТрактир": 1, "Cvtnkbdsq Nhfrnbh": 1, "Сме. Трактир": 1, "ООО Сметливый Трактир (РФ)": 1, "Cметливый Tрактиp": 1, "Smetlivyy Traktir": 1,
        "Осатмир": 2, "Оста-мир®": 2, "Jcnfvbh": 2, "ТМ «Остамир»": 2, "Рудесан": 3, "Велнезза": 3, "7,5 вёрст": 4, "Артель \"Семь Вёдер\"": 5, "Джунродале": 6, "Junrodale Premium": 6,
        "н/д": 0, "": 0, None: 0, "Боноборг": 0, "-": 0, "Остобир": 0, "x" * 5000: 0,
    }
    assert dict(zip(cases, mapped(spark, list(cases)), strict=True)) == cases


def test_mapping_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, name string, aliases string")
    df = spark.createDataFrame([(1, "a", 7)], "i int, val string, b int")
    out = C.map_values(df, "val", empty, "id", "name", "aliases", "b")
    assert [tuple(r) for r in out.select("i", "b").collect()] == [(1, 0)] and C.map_values(df.limit(0), "val", empty, "id", "name", "aliases", "b").count() == 0


def brute_distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 2, j - 2] + 1 if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else 99)
    return d[len(a), len(b)]


def test_deletes_find_what_a_scan_finds():
    rng = random.Random(2)
    names = [(i, "".join(rng.choice("абвгде") for _ in range(rng.randint(6, 14)))) for i in range(1, 60)]
    book = C.Dictionary(names, {})
    for _ in range(150):
        word = list(rng.choice(names)[1])
        for _ in range(rng.randint(0, 2)):
            word[rng.randrange(len(word))] = rng.choice("абвгде")
        word = "".join(word)
        near = [i for i, n in names if brute_distance(word, n) <= min(C.allowed(word), C.allowed(n))]
        found, cost = book.look_up(word)
        if near:
            best = min(C.weighted_distance(word, n)[0] for i, n in names if i in near)
            assert found in near or cost <= best  # a nearer one in Latin letters may win, none farther
        else:
            assert found == 0 or any(C.weighted_distance(C.skeleton(word), C.skeleton(n))[1] <= C.allowed("~" + C.skeleton(n)) for i, n in names if i == found)


STATES = "card_id bigint, product_id int, provider string, name string, product_name_ru string, barcode string, image_url string, completeness double, display_ready boolean, updated_at timestamp_ntz"


def states(spark, rows):
    t = lambda s: datetime.fromisoformat(s) if s else None
    df = spark.createDataFrame([(*r[:8], True, t(r[8])) for r in rows], STATES)
    trust = spark.createDataFrame([("manual", 95), ("off_dump", 40), ("user_photo", 15)], "provider string, trust int")
    return {(r["product_id"], r["field_name"]): r["val"] for r in S.surviving_fields(df, trust).collect()}


def test_survivors(spark):
    ok, url = "4900000010725", "https://i.example/a/1.jpg"
    got = states(spark, [
        (1, 1, "manual", "Сыр козий", None, "123", "img.jpg", 0.9, "2025-03-01"), (2, 1, " Off_dump ", "Сыр коз…", "Сыр", ok + " ", url, 70.0, "2025-02-01"), (3, 1, None, "Сыр старый", "Syr", "0000000000000", "http://", None, "2025-01-01"),
        (4, 2, None, "  Б  ", "??", None, None, None, "1970-01-01"), (5, 2, "manual", "А", "тест", None, None, 999.0, "2098-12-14"), (6, 3, "manual", "Один", "Один", ok, url, 50.0, "2025-01-01"),
        (7, 4, "manual", "Ð¡Ñ‹Ñ€", "Мо?око", "-", "n/a", 90.0, "2025-01-01"), (8, 4, "manual", None, "", "", " ", 90.0, "2025-01-01"), (9, None, "manual", "x", "x", ok, url, 1.0, None), (10, 5, "x", "В", "В", None, None, None, None), (11, 5, "x", "Г", "Г", None, None, None, None),
    ])
    assert got == {(1, "name"): "Сыр козий", (1, "product_name_ru"): "Сыр", (1, "barcode"): ok, (1, "image_url"): url, (2, "name"): "А", (5, "name"): "Г", (5, "product_name_ru"): "Г"}


def test_survivor_order_bridges_missing_reasons(spark):
    # the best has no completeness, the second no time: trust decides between them
    got = states(spark, [(1, 1, "manual", "Лучший", None, None, None, None, "2025-03-01"), (2, 1, "off_dump", "Второй", None, None, None, 80.0, None), (3, 1, "user_photo", "Третий", None, None, None, 40.0, "2025-01-01")])
    assert got[1, "name"] == "Лучший"


def test_digest_ranks_are_bounded_and_merge():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 1, 60_000), np.full(20_000, 7.0)])
    parts = [D.cluster(np.zeros(len(p), int), p, np.ones(len(p))) for p in np.array_split(rng.permutation(values), 7)]
    g, m, w = D.cluster(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    assert len(m) <= D.DELTA + 2 and w.sum() == len(values) and (np.diff(m) >= 0).all()
    at = np.cumsum(w) - w / 2
    for q in (0.01, 0.5, 0.95, 0.99):
        x = np.interp(q * len(values), at, m)
        lo, hi = (values < x).mean(), (values <= x).mean()
        assert lo - 0.01 <= q <= hi + 0.01


def test_certified_percentiles(spark):
    rng = random.Random(3)
    rows = [("a", "x", rng.lognormvariate(3, 1)) for _ in range(5000)] + [("a", None, 5.0)] * 50 + [("b", "x", float(i)) for i in (1, 2, 3)] + [("c", "x", None), ("c", "x", float("nan"))]
    df = spark.createDataFrame(rows, "r string, g string, v double").withColumn("mean", F.lit(1)).repartition(5)
    got = {(r["r"], r["g"]): r for r in D.certified_percentiles(df, ["r", "g"], "v", [0.5, 0.95]).collect()}
    assert set(got) == {("a", "x"), ("a", None), ("b", "x")} and got["a", None]["estimates"] == [5.0, 5.0] and got["b", "x"]["n"] == 3
    exact = np.percentile([v for r, g, v in rows if (r, g) == ("a", "x")], [50, 95])
    assert np.allclose(got["a", "x"]["estimates"], exact, rtol=0.05) and max(got["a", "x"]["errors"]) <= D.MAX_ERROR
    tight = D.certified_percentiles(df, ["r", "g"], "v", [0.5], delta=4, max_error=1e-9).filter("r = 'a' and g = 'x'").first()
    assert tight["exact"] and tight["estimates"][0] == pytest.approx(exact[0])
    assert D.certified_percentiles(df.limit(0), ["r", "g"], "v", [0.5]).count() == 0
    every = {(r["r"], r["g"]): r for r in D.certified_percentiles(df, ["r", "g"], "v", [0.0, 0.37, 0.95, 1.0], delta=4, max_error=1e-9).filter("exact").collect()}
    for k, r in every.items():
        assert np.allclose(r["estimates"], np.percentile([v for x, g, v in rows if (x, g) == k], [0, 37, 95, 100]))
    assert ("a", "x") in every
    days = D.build_digests(df.filter("v < 20"), ["r", "g"], "v").unionByName(D.build_digests(df.filter("not v < 20"), ["r", "g"], "v"))
    assert D.merge_digests(days, ["r", "g"]).filter("r = 'a' and g = 'x'").agg(F.sum("weight")).first()[0] == 5000


def test_many_groups_are_emitted_in_pieces(spark, monkeypatch):
    """With a buffer far smaller than the groups every digest is still whole: weights and medians are those of the values."""
    monkeypatch.setattr(D._Merger, "LIMIT", 400)
    df = spark.range(30_000).select((F.col("id") % 3000).cast("int").alias("g"), (F.col("id") / 3000).cast("double").alias("v"))
    merged = D.merge_digests(D.build_digests(df, ["g"], "v"), ["g"])
    out = D.digest_percentiles(merged, ["g"], [0.5]).agg(F.count(F.lit(1)), F.sum("n"), F.min(F.expr("estimates[0]")), F.max(F.expr("estimates[0]"))).first()
    assert out[0] == 3000 and out[1] == 30_000 and 3.9 < out[2] and out[3] < 6.1


def test_groups_equal_union_find(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 560)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)] + [(7, 7), (9000, 9000), (None, 3), (8000, None), (2, 1), (1, 2)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(*p, "g", 1) for p in pairs], "left_id int, right_id int, group_id string, v int")
    got = {r["product_id"]: r["group_id"] for r in G.connected_groups(df, "left_id", "right_id").collect()}
    assert got == {x: find(x) for x in root} and 8000 not in got
    assert G.connected_groups(df.limit(0), "left_id", "right_id").count() == 0


def listing_rows():
    lines, kinds = ["утренняя застава", "горная долина", "золотая пасека"], ["отборное", "козье"]
    out, n = [], 0
    for b, line, kind, pct, amount in itertools.product((1, 2), lines, kinds, ("2,5", "3,2"), ("500 мл", "1 л")):
        brand = {1: "Сметливый Трактир", 2: "Остамир"}[b]
        for text, bid, v, u, sub in ((f"Молоко {kind} {pct}% серия {line} {brand} {amount}", b, None, None, kind), (f"АКЦИЯ! «{line.upper()}» молоко, {kind[:4]}., {pct} проц., {brand}", None, amount.split()[0], amount.split()[1], None)):
            n += 1
            out.append((n, text, bid, 1, v, u, sub))
    return out


SCHEMA = "id int, name string, brand_id int, category_id int, package_value double, package_unit string, subtype string, group_id int"


def grouped(spark, rows):
    brands = spark.createDataFrame(BRANDS, "id int, name string, aliases string")
    return {r["id"]: r["group_id"] for r in L.group_listings(spark.createDataFrame(rows, SCHEMA), brands).collect()}


def test_listings_of_one_item(spark):
    rows = [(*r[:4], float(r[4]) if r[4] else None, *r[5:], 0) for r in listing_rows()]
    rows += [(9001, None, None, None, None, None, None, 0), (9002, "", None, None, None, None, None, 0), (9003, "слово " * 3000, None, 1, None, None, None, 0), (9004, rows[0][1], 1, 1, None, None, "отборное", 0)]
    found = grouped(spark, rows)
    assert found == {i: i - (i + 1) % 2 for i in range(1, 97)} | {9001: 9001, 9002: 9001, 9003: 9003, 9004: 1}
    assert L.group_listings(spark.createDataFrame([], SCHEMA), spark.createDataFrame(BRANDS, "id int, name string, aliases string")).count() == 0


def test_more_copies_than_neighbours(spark):
    """Forty wordings of one item stay one group, though a title keeps only twelve neighbours."""
    own = {1: "утренняя", 2: "золотая"}  # one line a brand
    rows = [(*r[:4], float(r[4]) if r[4] else None, *r[5:], 0) for r in listing_rows() if own[1 if r[0] <= 48 else 2] in r[1].lower()]
    extra = ["акция", "новинка", "выгодно", "хит", "топ", "цена"]
    many = [(1000 + n, " ".join([e for k, e in enumerate(extra) if n >> k & 1] + ["Молоко козье 2,5% серия золотая пасека Остамир 500 мл"]), 2, 1, None, None, "козье", 0) for n in range(40)]
    found = grouped(spark, rows + many)
    assert len({found[r[0]] for r in many}) == 1 and len(set(found.values())) == 16


def test_numbers_and_variants_veto(spark):
    stated = np.array([[1, 5, 7, 0], [1, 5, 7, 3], [1, 6, 7, 3], [2, 5, 7, 0]])
    vec = (np.ones((4, L.WIDTH)) / np.sqrt(L.WIDTH)).astype(np.float16)
    data = [(i, *map(int, stated[i]), bytearray(vec[i].tobytes()), 0) for i in range(4)]
    df = spark.createDataFrame(data, "rep int, k0 bigint, k1 bigint, k2 bigint, k3 bigint, vec binary, list int")
    found = L.search_lists(df, np.ones((1, L.WIDTH), np.float32), 1, 0.9, L.Scratch(spark, "veto"))
    assert {(r["q"], r["r"]) for r in found.collect()} == {(0, 1), (1, 0)}  # another percentage and another kind are vetoed; no variant contradicts none


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(300, L.WIDTH)).astype(np.float32)
    vec = (vec / np.linalg.norm(vec, axis=1, keepdims=True)).astype(np.float16)
    centres = L.fit_centroids(vec.astype(np.float32), 12)
    own = L._nearest_lists(vec.astype(np.float32), centres, 1)[:, 0]
    df = spark.createDataFrame([(i, 0, 0, 0, 0, bytearray(vec[i].tobytes()), int(own[i])) for i in range(300)], "rep int, k0 bigint, k1 bigint, k2 bigint, k3 bigint, vec binary, list int")
    wide = vec.astype(np.float32)
    score = wide @ wide.T
    np.fill_diagonal(score, -9)
    vectors, exact = L.exact_neighbours(df, df.filter("rep < 20"), 3)
    got = {(r["q"], r["r"]) for r in exact.collect()}
    order = [next(j for j in range(300) if np.array_equal(wide[j], v)) for v in vectors]
    assert got == {(q, int(j)) for q, i in enumerate(order) for j in sorted(range(300), key=lambda j: (-score[i, j], j))[:3]}
    probes, recall = L.tune_probes(df, 300, centres)
    assert recall >= L.RECALL and probes <= 12
    near = {(r["q"], r["r"]) for r in L.search_lists(df, centres, 12, 0.15, L.Scratch(spark, "all")).filter("kind = 0").collect()}
    assert near == {(i, int(j)) for i in range(300) for j in [j for j in sorted(range(300), key=lambda j: (-score[i, j], j)) if score[i, j] >= 0.15 - 1e-6][: L.NEIGHBOURS]}


def test_full_cells_do_not_blur_the_lines(spark, monkeypatch):
    """Where many titles share brand and numbers, titles of one line score above the least score and those of two lines below."""
    monkeypatch.setattr(L, "FIT_ROWS", 700)
    rng = random.Random(6)
    left, right = "утренняя старинная золотая вечерняя горная душистая цветущая лунная".split(), "гармония слободка береза околица ярмарка застава мельница радуга".split()
    extra = ["хит продаж", "топ цена", "вкусно как дома", "свежая поставка", "для всей семьи", "суперцена", "новинка", "акция", "выгодно", "в подарок", "питьевое", "м д серия"]
    rows = []
    for brand in range(1, 241):  # a brand in four has all lines, the others two
        lines = list(itertools.product(left, right)) if brand % 4 == 0 else [(rng.choice(left), rng.choice(right)) for _ in range(2)]
        for line in lines:
            for _ in range(3):
                rows.append((1, brand, "2.5", "мл500000", "козье", " ".join(sorted({"молоко", *line, *rng.choice(extra).split(), *rng.choice(extra).split()}))))
    rows = sorted(set(rows))
    titles = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "cat int, brand bigint, pct string, amount string, variant string, title string, rep int")
    embedded, _, least = L._index(titles, len(rows), L.Scratch(spark, "cells"))
    got = {r["rep"]: r["vec"] for r in embedded.select("rep", "vec").collect()}
    vec = L._vectors([bytes(got[i]) for i in range(len(rows))])
    line = [tuple(w for w in r[5].split() if w in left or w in right) for r in rows]
    same, other = [], []
    for brand in range(4, 241, 16):
        own = [i for i, r in enumerate(rows) if r[1] == brand]
        for i, j in itertools.combinations(own, 2):
            (same if line[i] == line[j] else other).append(float(vec[i] @ vec[j]))
    assert min(same) >= least > max(other)
