"""Queries of packed fields and of quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.operators.packed import found_packed, packed_fields, score_signs, split_packed
from larder.operators.quantities import catalogue_amounts, holdout_units, infer_units
from larder.runtime import table


def _off(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "off_products", *columns)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each value of a field of off_products that holds two or more values."""
    return found_packed(_off(spark, folder, "rec_id", "brands", "packaging"), "rec_id", ["brands", "packaging"])


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of brands and packaging, single ones included."""
    long = packed_fields(_off(spark, folder, "rec_id", "brands", "packaging"), "rec_id", ["brands", "packaging"])
    return split_packed(long, "field_name", "raw").select("rec_id", "field_name", "pos", "val")


def p1_signs(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of the candidate delimiters of each field."""
    return score_signs(packed_fields(_off(spark, folder, "rec_id", "brands", "packaging"), "rec_id", ["brands", "packaging"]), "field_name", "raw")


def _amounts(spark: SparkSession, folder: str) -> DataFrame:
    off = _off(spark, folder, "rec_id", "quantity", "product_quantity", "product_quantity_unit", "product_name_ru")
    return catalogue_amounts(off, table(spark, folder, "prepared_products", "rec_id", "name", "package_value", "package_unit"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The stated net content of each record in thousandths of г, мл or шт."""
    return _amounts(spark, folder).filter("amount_milli is not null").select("src_table", "rec_id", "base_unit", "amount_milli")


def p2_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with a number: stated amounts, and bare numbers with the unit of greatest posterior, flagged where uncertain."""
    found = infer_units(_amounts(spark, folder)).filter("amount_milli is not null")
    return found.select("src_table", "rec_id", "base_unit", "amount_milli", "stated_in", "confidence", "uncertain")


def p2_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """How well the mixture gives stated numbers their units back, over all records with a stated pair of number and unit."""
    return holdout_units(_amounts(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p1_signs": p1_signs, "p2_found": p2_found, "p2_amounts": p2_amounts, "p2_holdout": p2_holdout}
SQL: dict[str, str] = {}
