"""Catalogue search for a table of queries at once: strict, fuzzy and suggested hits, merged first seen first.

A query is matched through letters of its longest word or through shared trigrams, so hits come from equi-joins on an
exploded index and never from a product of queries and listings. The query table is broadcast if its counted size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import text as T
from larder.functions import trigram as G
from larder.runtime import small_broadcast

#: Letters of a query's longest word that its hits are found by.
GRAM = 3
#: Weights of the fields a fuzzy hit is scored on.
FUZZY_WEIGHTS = {"combined": 1.55, "search_text": 1.50, "name": 1.40, "brand": 1.30, "aliases": 1.15, "keywords": 0.60, "subtype": 0.55}
PREFIX_BONUS = {"combined": 0.45, "name": 0.40, "brand": 0.35}
#: A fuzzy hit has in one field at least this extent, or in one of the fields ``FUZZY_WHOLE`` at least the whole similarity ``WHOLE_LEAST``.
FUZZY_EXTENT = {"combined": 0.42, "search_text": 0.40, "name": 0.45, "brand": 0.45, "aliases": 0.50, "keywords": 0.55}
FUZZY_WHOLE, WHOLE_LEAST = ["name", "brand", "search_text", "aliases", "keywords", "subtype"], 0.30
#: Least extent of a suggestion.
SUGGEST_LEAST = 0.30


def catalogue(products: DataFrame, brands: DataFrame) -> DataFrame:
    """Active listings with brand and the normal forms that search reads."""
    named = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand"), F.col("aliases").alias("brand_aliases"))
    met = products.filter("is_active").join(small_broadcast(named), "brand_id", "left")
    norm = lambda c: F.coalesce(T.normalize_text(F.col(c)), F.lit(""))
    return met.select(
        "id", "name", "brand", "barcode", "image_url", "package_value", "package_unit", norm("name").alias("n_name"), norm("brand").alias("n_brand"), norm("brand_aliases").alias("n_aliases"),
        norm("subtype").alias("n_subtype"), norm("keywords").alias("n_keywords"), norm("search_text").alias("n_search"),
    )


def order_keys(norm_query: F.Column) -> list[F.Column]:
    """Columns of the final order after relevance: real brand, informative name, missing card fields, short name, names, id."""
    missing = F.col("image_url").isNull().cast("int") + F.col("barcode").isNull().cast("int") + (F.col("package_value").isNull() | F.col("package_unit").isNull()).cast("int")
    return [
        T.is_unknown_brand(F.col("brand")).cast("int"), (F.length(F.trim("name")) <= F.length(norm_query) + 3).cast("int"), missing, F.length("name"),
        F.coalesce("brand", F.lit("")), F.col("name"), F.col("id"),
    ]


def strict_search(queries: DataFrame, cat: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, id, rank): listings that hold every word of the query in some field, best first, ``limit`` a query.

    ``queries`` has query_id and query, any number of them; words may stand inside others. A query without words finds nothing.
    A one-word query equal to a listing's whole name puts that listing last."""
    return _strict_ranked(queries, cat, limit).select("query_id", "id", "rank")


def _strict_ranked(queries: DataFrame, cat: DataFrame, limit: int) -> DataFrame:
    """The hits of ``strict_search`` with their n_brand: listings meet a query on the first letters of its longest word."""
    q = queries.select("query_id", T.normalize_text(F.col("query")).alias("nq")).filter("nq <> ''").withColumn("words", F.split("nq", " "))
    longest = F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    q = q.withColumn("_gram", F.substring(longest, 1, GRAM))
    sizes = sorted(r[0] for r in q.select(F.length("_gram").alias("n")).distinct().collect())  # at most GRAM lengths
    fields = F.concat_ws(" ", "n_name", "n_brand", "n_aliases", "n_subtype", "n_keywords", "n_search")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_all") - n + 1, F.lit(1))), lambda i: F.substr(F.col("_all"), i, F.lit(n)))
    every = F.array_distinct(F.filter(F.concat(*[grams(n) for n in sizes or [GRAM]]), lambda g: ~F.contains(g, F.lit(" "))))
    met = cat.withColumn("_all", fields).withColumn("_gram", F.explode(every)).join(small_broadcast(q, 300), "_gram")
    hit = met.filter(F.expr("forall(words, w -> contains(_all, w))"))
    plain = (F.size("words") == 1) & (F.col("n_name") == F.col("nq"))
    relevance = (
        F.when(F.col("n_name") == F.col("nq"), 1).when(F.col("n_brand") == F.col("nq"), 2).when(F.col("n_name").startswith(F.col("nq")), 3)
        .when(F.expr("forall(words, w -> contains(n_name, w))"), 4).when(F.expr("forall(words, w -> contains(concat_ws(' ', n_name, n_brand), w))"), 5).otherwise(6)
    )
    ranked = hit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(plain.cast("int"), relevance, *order_keys(F.col("nq")))))
    return ranked.filter(F.col("rank") <= limit).select("query_id", "id", "rank", "n_brand")


def _shared_trigrams(queries: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, _qn, _tn, _s): trigrams of the query, of the text and shared ones of every pair that shares any."""
    qt = queries.select("query_id", G.trigrams(F.col("query")).alias("_t")).withColumn("_qn", F.size("_t"))
    tt = texts.select(key, G.trigrams(F.col(text)).alias("_t")).withColumn("_tn", F.size("_t"))
    met = tt.select(key, "_tn", F.explode("_t").alias("g")).join(small_broadcast(qt.select("query_id", "_qn", F.explode("_t").alias("g"))), "g")
    return met.groupBy("query_id", key, "_qn", "_tn").agg(F.count(F.lit(1)).alias("_s"))


def trigram_candidates(queries: DataFrame, texts: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(query_id, key) of every pair that can have a similarity or an extent of ``least``: both are at most the shared trigrams
    as a share of the query's, however long the text is, so no such pair is left out."""
    return _shared_trigrams(queries, texts, key, text).filter(F.col("_s") >= least * F.col("_qn") - 1e-9).select("query_id", key)


def trigram_hits(queries: DataFrame, texts: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(query_id, key, similarity) of every pair with similarity of at least ``least``.

    Pairs meet on shared trigrams, counted by pair; the sizes of both sets then give the similarity, as a pair without shared
    trigram has similarity 0."""
    shared = _shared_trigrams(queries, texts, key, text)
    return shared.withColumn("similarity", F.col("_s") / (F.col("_qn") + F.col("_tn") - F.col("_s"))).filter(F.col("similarity") >= least).select("query_id", key, "similarity")


def fuzzy_search(queries: DataFrame, cat: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, id, score, rank): listings by weighted trigram and extent similarity of their fields with a prefix bonus."""
    q = queries.select("query_id", T.normalize_text(F.col("query")).alias("query")).filter("length(query) >= 3")
    texts = cat.withColumn("_combined", F.concat_ws(" ", "n_brand", "n_name"))
    fields = {"combined": "_combined", "search_text": "n_search", "name": "n_name", "brand": "n_brand", "aliases": "n_aliases", "keywords": "n_keywords", "subtype": "n_subtype"}
    near = trigram_candidates(q, texts.select("id", F.concat_ws(" ", *fields.values()).alias("_any")), "id", "_any", min(WHOLE_LEAST, *FUZZY_EXTENT.values()))
    met = near.join(small_broadcast(q), "query_id").join(texts, "id")
    whole = [G.similarity(F.col("query"), F.col(c)).alias(f"w_{f}") for f, c in fields.items()]
    extent = [G.word_similarity(F.col("query"), F.col(c)).alias(f"e_{f}") for f, c in fields.items()]
    scored = met.select("query_id", "id", "query", "name", "brand", "barcode", "image_url", "package_value", "package_unit", *whole, *extent, *fields.values())
    best = F.greatest(*[F.greatest(F.col(f"w_{f}"), F.col(f"e_{f}")) * w for f, w in FUZZY_WEIGHTS.items()])
    bonus = F.greatest(*[F.when(F.col(fields[f]).startswith(F.col("query")), b).otherwise(0.0) for f, b in PREFIX_BONUS.items()])
    alike = F.greatest(*[(F.col(f"e_{f}") >= least).cast("int") for f, least in FUZZY_EXTENT.items()], *[(F.col(f"w_{f}") >= WHOLE_LEAST).cast("int") for f in FUZZY_WHOLE]) == 1
    kept = scored.filter(alike).withColumn("score", best + bonus)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order_keys(F.col("query")))))
    return ranked.filter(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def merge_stages(*stages: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, id, stage, rank): hits of ordered stages, each listing where it was seen first, then cut to ``limit``."""
    tagged = [s.select("query_id", "id", F.lit(n).alias("stage"), F.col("rank").alias("_r")) for n, s in enumerate(stages)]
    union = tagged[0]
    for s in tagged[1:]:
        union = union.unionByName(s)
    first = union.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("stage", "_r"))).filter("_k = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "_r", "id"))).filter(F.col("rank") <= limit).select("query_id", "id", "stage", "rank")


def combined_search(queries: DataFrame, cat: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, id, stage, rank): hits of each query over all its forms (other keyboard layout, transliterations).

    Stage 0: a query of digits that is a listing's code gives the listings of that code only. Stage 1: strict hits of each form
    in order; if some are of a brand named just as the query, only these are given. Stage 2: fuzzy hits of each form in order.
    A listing stands where it was first seen. Each form gives its best ``limit``, which suffices, as fewer were seen before."""
    asked = queries.select("query_id", F.trim("query").alias("_raw"), T.normalize_text(F.col("query")).alias("_asked")).filter("_asked <> ''")
    forms = queries.select("query_id", F.posexplode(T.search_variants(F.col("query"))).alias("variant", "query"))
    keyed = forms.select(F.struct("query_id", "variant").alias("query_id"), "query")
    code = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(13))
    wanted = asked.filter(F.col("_raw").rlike("^[0-9]+$")).select("query_id", code("_raw").alias("_code"))
    coded = cat.select("id", code("barcode").alias("_code")).join(small_broadcast(wanted), "_code")
    none = F.lit(None).cast("string").alias("n_brand")
    stages = [
        coded.select("query_id", "id", F.lit(0).alias("stage"), F.lit(0).alias("variant"), F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("_r"), none),
        _strict_ranked(keyed, cat, limit).select("query_id.query_id", "id", F.lit(1).alias("stage"), "query_id.variant", F.col("rank").alias("_r"), "n_brand"),
        fuzzy_search(keyed, cat, limit).select("query_id.query_id", "id", F.lit(2).alias("stage"), "query_id.variant", F.col("rank").alias("_r"), none),
    ]
    seen = stages[0].unionByName(stages[1]).unionByName(stages[2])
    place = ["stage", "variant", "_r"]
    first = seen.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*place))).filter("_k = 1")
    of_query = Window.partitionBy("query_id")
    ranked = first.withColumn("rank", F.row_number().over(of_query.orderBy(*place))).filter(F.col("rank") <= limit)
    told = ranked.join(small_broadcast(asked.select("query_id", "_asked")), "query_id").withColumn("_brand", (F.col("stage") == 1) & (F.col("n_brand") == F.col("_asked")))
    flagged = told.withColumn("_coded", F.min("stage").over(of_query) == 0).withColumn("_exact", F.max(F.coalesce("_brand", F.lit(False))).over(of_query))
    kept = flagged.filter(F.when(F.col("_coded"), F.col("stage") == 0).when(F.col("_exact"), F.col("_brand")).otherwise(True))
    return kept.select("query_id", "id", "stage", F.row_number().over(of_query.orderBy("rank")).alias("rank"))


def page(ranked: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Rows of one page of ranked hits, pages from 0."""
    return ranked.filter(F.col("rank").between(number * size + 1, (number + 1) * size))
