"""Record shapes of the sources and the constraints that plain files cannot enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line of a catalogue dump.
DUMP = (
    "code string, product_name_ru string, product_name string, generic_name string, brands string, categories string, categories_tags array<string>, countries_tags array<string>, quantity string, "
    "product_quantity string, product_quantity_unit string, image_front_url string, image_url string, image_front_small_url string"
)
#: A record of an external provider.
EXTERNAL = (
    "provider string, source_id string, name string, brand_name string, barcode string, category_name string, external_category_values array<string>, package_value decimal(12,3), package_unit string, "
    "subtype string, description string, image_url string, source_url string, keywords array<string>, raw string"
)
#: A candidate pair of a scanner document.
CANDIDATE = "classification string, reason string, score double, left_id int, right_id int"


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is set but not among the parent's."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def broken(df: DataFrame, **checks: str) -> DataFrame:
    """(check, n) for each named SQL condition: rows for which it is not true."""
    sums = df.agg(*[F.sum(F.when(F.expr(rule), 0).otherwise(1)).cast("bigint").alias(name) for name, rule in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in checks])).alias("c")).select("c.*")
