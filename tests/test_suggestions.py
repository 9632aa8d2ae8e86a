"""Suggestions against a brute force over all pairs of query and text."""

from larder.functions import trigram as G
from larder.plans import search_queries as P


def test_suggestions_equal_brute_force(spark, tmp_path, monkeypatch):
    long = " ".join(f"слово{chr(1072 + i)}{chr(1080 + i % 7)}ный{chr(1075 + i % 5)}" for i in range(24))
    texts = {1: "сыр", 2: f"{long} сыр", 3: f"сырный {long}", 4: "хлеб", 5: f"{long} молоко", 6: None, 7: f"хлебный {long}"}
    spark.createDataFrame([(i, t, True) for i, t in texts.items()] + [(8, "сыр", False)], "id int, search_text string, is_active boolean").write.parquet(f"{tmp_path}/products.parquet")
    asked = {1: "сыр", 2: "хлеб"}
    monkeypatch.setattr(P, "ASKED", list(asked.items()))
    got = {(r["query_id"], r["id"]): round(r["score"], 9) for r in P.suggestions_topk(spark, str(tmp_path)).collect()}
    scores = {(q, i): round(G.best_extent(v, t), 9) for q, v in asked.items() for i, t in texts.items() if t is not None}
    wanted = {k: v for k, v in scores.items() if v >= 0.3}
    assert wanted[1, 2] == 1.0 and (2, 7) in wanted
    assert got == wanted
