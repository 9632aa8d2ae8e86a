"""Queries of the operators for training data; ``SQL`` has those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.canonical import map_values
from larder.llm.digests import build_digests, certified_percentiles, merge_digests
from larder.llm.encode import encode_texts
from larder.llm.groups import connected_groups
from larder.llm.language import doubtful_labels, label_spans
from larder.llm.listings import group_listings, group_pairs, search_recall
from larder.llm.packing import fill_report, pack_texts
from larder.llm.survivors import surviving_fields
from larder.operators.packed import packed_fields, split_packed
from larder.runtime import Scratch, table

GROUP = ["retailer_name", "region"]
SHARES = [0.5, 0.9, 0.95, 0.99]


def _brands(spark: SparkSession, folder: str) -> DataFrame:
    values = split_packed(packed_fields(table(spark, folder, "off_products", "rec_id", "brands"), "rec_id", ["brands"]), "field_name", "raw")
    return map_values(values.select("rec_id", "pos", "val"), "val", table(spark, folder, "brands", "id", "name", "aliases"), "id", "name", "aliases", "brand_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each value of off_products.brands with the id of the brand it means, 0 for none."""
    return _brands(spark, folder).select("rec_id", "pos", F.col("brand_id").cast("int").alias("brand_id"))


def p3_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Values without entry and how often they occur."""
    return _brands(spark, folder).filter("brand_id = 0").groupBy("val").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving name, product_name_ru, barcode and image_url of each product with two or more card states."""
    states = table(spark, folder, "card_states", "card_id", "product_id", "provider", "name", "product_name_ru", "barcode", "image_url", "completeness", "updated_at")
    return surviving_fields(states, table(spark, folder, "provider_trust", "provider", "trust"))


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    """Valid observations, each once, as (retailer_name, region, price), null keys included: written to the shared folder, as they are read twice."""
    seen = table(spark, folder, "price_observations", "product_id", "retailer_name", "region", "price", "observed_at")
    once = seen.filter("price > 0").distinct()
    return Scratch(spark, "prices").save(once.select("retailer_name", "region", F.col("price").cast("double").alias("price")), "valid")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Retailer and region with at least 40 valid observations whose 95th percentile of price is at least five times the median."""
    named = _prices(spark, folder).filter("region is not null and retailer_name is not null")
    found = certified_percentiles(named, GROUP, "price", [0.5, 0.95])
    return found.filter("n >= 40 and estimates[1] >= 5 * estimates[0]").select("retailer_name", "region")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile of price by retailer and region, null ones being groups too, each with its certified rank error."""
    found = certified_percentiles(_prices(spark, folder), GROUP, "price", SHARES)
    columns = [x for i, s in enumerate(("p50", "p90", "p95", "p99")) for x in (F.col("estimates")[i].alias(s), F.col("errors")[i].alias(f"{s}_error"))]
    return found.select(*GROUP, "n", *columns, "exact")


def p5_daily_digests(spark: SparkSession, folder: str) -> DataFrame:
    """The combinable state: one digest per retailer, region and day, as centroid rows."""
    seen = table(spark, folder, "price_observations", "product_id", "retailer_name", "region", "price", "observed_at")
    once = seen.filter("price > 0").distinct().withColumn("day", F.to_date("observed_at"))
    keys = [*GROUP, "day"]
    return merge_digests(build_digests(once, keys, "price"), keys)


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products", "id", "name", "brand_id", "category_id", "package_value", "package_unit", "subtype")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of listings of products that describe the same item."""
    return group_pairs(group_listings(_products(spark, folder), table(spark, folder, "brands", "id", "name", "aliases")))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per listing with the identifier of its item: the groups themselves, without their pairs."""
    return group_listings(_products(spark, folder), table(spark, folder, "brands", "id", "name", "aliases"))


def p6_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the tuned search against unfiltered exact neighbours, and the least score of an edge."""
    return search_recall(_products(spark, folder), table(spark, folder, "brands", "id", "name", "aliases"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each product of a pair of duplicate_candidates with the smallest product id of its group."""
    return connected_groups(table(spark, folder, "duplicate_candidates", "left_id", "right_id"), "left_id", "right_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its token ids by byte_bpe_50k."""
    return encode_texts(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in a container of each plan of packing_plans, sizes in tokens of byte_bpe_50k."""
    return pack_texts(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "packing_plans"))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and unused share of each plan."""
    return fill_report(p9_packed(spark, folder), table(spark, folder, "packing_plans"))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return label_spans(table(spark, folder, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of each document whose label is missing or wrong or whose text mixes languages."""
    return doubtful_labels(_spans(spark, folder), "doc_id")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    spans = _spans(spark, folder)
    return spans.select("doc_id", F.posexplode("spans").alias("segment", "_s")).select("doc_id", "segment", "_s.*")


QUERIES = {
    "p3_found": p3_found, "p3_misses": p3_misses, "p4_found": p4_found, "p5_found": p5_found, "p5_percentiles": p5_percentiles, "p5_daily_digests": p5_daily_digests, "p6_found": p6_found, "p6_groups": p6_groups, "p6_recall": p6_recall, "p7_found": p7_found,
    "p8_ids": p8_ids, "p9_packed": p9_packed, "p9_fill": p9_fill, "p10_found": p10_found, "p10_segments": p10_segments,
}
SQL: dict[str, str] = {
    "p5_found": """with v as (select distinct product_id, retailer_name, region, price, observed_at from price_observations where price > 0 and region is not null and retailer_name is not null)
    select retailer_name, region from v group by retailer_name, region having count(*) >= 40 and quantile_cont(cast(price as double), 0.95) >= 5 * quantile_cont(cast(price as double), 0.5)""",
    "p7_found": """with recursive e as (select left_id as a, right_id as b from duplicate_candidates where left_id is not null and right_id is not null
      union select right_id, left_id from duplicate_candidates where left_id is not null and right_id is not null),
    r(n, m) as (select a, a from e union select r.n, e.b from r join e on r.m = e.a) select n as product_id, min(m) as group_id from r group by n""",
}
