"""Dump lines to catalogue records: reading with quarantine, preparation, and upsert by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.units import BLANK
from larder.sources.schemas import CANDIDATE, DUMP

#: Tags of the country whose records are taken, and the category of a record without one.
COUNTRY_TAGS = ["en:russia", "ru:россия", "en:russian-federation"]
DEFAULT_CATEGORY, DEFAULT_BRAND = "Продукты", "Без бренда"
#: Unit spellings of the structured fields and of quantity texts (unit, factor).
UNIT_SPELLINGS = {
    "г": ["г", "гр", "г.", "гр.", "g", "gr", "gram", "грамм"], "кг": ["кг", "kg", "кг.", "килограмм"], "мл": ["мл", "ml", "мл.", "миллилитров", "cl"], "л": ["л", "l", "л.", "ltr", "литр"],
    "шт": ["шт", "pcs", "шт.", "штук"],
}


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of JSON lines, gzip or plain: lines that are no JSON object or have no object's shape are kept apart.

    A gzip file is one task by its format; many files are read side by side. Blank lines are neither."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = lines.withColumn("record", F.from_json("value", DUMP + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("record").isNotNull() & F.col("record._bad").isNull() & F.col("value").rlike(r"^\s*\{")
    return parsed.filter(good).select("record.*").drop("_bad"), parsed.filter(~F.coalesce(good, F.lit(False))).select("value")


def of_country(tags: Column) -> Column:
    """Whether a tag names the country; null and empty lists do not."""
    return F.coalesce(F.arrays_overlap(F.transform(tags, lambda t: F.lower(F.trim(t))), F.array(*[F.lit(t) for t in COUNTRY_TAGS])), F.lit(False))


def first_item(col: Column) -> Column:
    """The first filled item of a comma list."""
    return F.try_element_at(F.filter(F.transform(F.split(col, ","), T.squeeze), lambda v: v != ""), F.lit(1))


def last_item(col: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(F.split(col, ","), T.squeeze), lambda v: v != ""), F.lit(-1))


def package_unit(col: Column) -> Column:
    """The unit of a structured field; a spelling unknown here as it is, in lower case, at most 20 characters."""
    key = F.lower(T.squeeze(col))
    pairs = [x for unit, spelled in UNIT_SPELLINGS.items() for s in spelled for x in (F.lit(s), F.lit(unit))]
    return F.nullif(F.substring(F.coalesce(F.try_element_at(F.create_map(*pairs), key), key), 1, 20), F.lit(""))


def prepare(records: DataFrame, *kept: str) -> DataFrame:
    """One projection from raw records to (``kept``, barcode, name, brand_name, category_name, package_value, package_unit, image_url).

    Records without a code of digits or without any name are left out."""
    name = F.coalesce(*[T.filled(F.col(c)) for c in ("product_name_ru", "product_name", "generic_name")])
    amount = F.lower(F.regexp_replace("quantity", f"{BLANK}+", " "))
    pattern = r"([0-9]+(?:[.,][0-9]+)?) ?(кг|мл|гр|г|л|kg|ml|cl|g|l)(?![\p{L}])"
    number = F.nullif(F.replace(F.regexp_extract(amount, pattern, 1), F.lit(","), F.lit(".")), F.lit("")).try_cast("decimal(12,3)")
    spelled = F.nullif(F.regexp_extract(amount, pattern, 2), F.lit(""))
    given = F.when(F.replace("product_quantity", F.lit(","), F.lit(".")).rlike(r"^[0-9]+(?:\.[0-9]+)?$"), F.replace("product_quantity", F.lit(","), F.lit("."))).try_cast("decimal(12,3)")
    structured = (given > 0) & T.filled(F.col("product_quantity_unit")).isNotNull()
    cl = spelled == "cl"
    code = F.trim("code")
    out = records.select(
        *kept, code.alias("barcode"), F.substring(name, 1, 255).alias("name"), F.substring(F.coalesce(first_item(F.col("brands")), F.lit(DEFAULT_BRAND)), 1, 128).alias("brand_name"),
        F.substring(F.coalesce(last_item(F.col("categories")), F.lit(DEFAULT_CATEGORY)), 1, 128).alias("category_name"),
        F.when(structured, given).otherwise(F.when(cl, number * 10).otherwise(number)).try_cast("decimal(12,3)").alias("package_value"),
        F.when(structured, package_unit(F.col("product_quantity_unit"))).otherwise(package_unit(spelled)).alias("package_unit"),
        F.when(F.col("image_front_url").rlike("^https?://"), F.substring("image_front_url", 1, 2000)).alias("image_url"),
    )
    return out.filter(F.col("barcode").rlike("^[0-9]+$") & F.col("name").isNotNull())


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep_if_null: list[str]) -> DataFrame:
    """``current`` with ``incoming`` rows in place of those with the same key; columns of ``keep_if_null`` keep the old value
    where the new one is null. Both sides have one row per key and the same columns; one shuffle on the key."""
    old, new = current.select(F.col(key), F.struct(*current.columns).alias("_o")), incoming.select(F.col(key), F.struct(*incoming.columns).alias("_n"))
    met = old.join(new, key, "full")
    pick = lambda c: F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")) if c in keep_if_null else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return met.select(*[F.col(key) if c == key else pick(c).alias(c) for c in current.columns])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pairs of JSON documents: known classes only, one row per pair, the best score."""
    documents = spark.read.schema(f"candidates array<struct<{CANDIDATE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").json(path, multiLine=True)
    rows = documents.select(F.explode("candidates").alias("c")).select("c.*").filter("classification in ('AUTO_SAFE', 'REVIEW', 'BARCODE_CONFLICT_REVIEW') and left_id <> right_id")
    rest = F.struct("classification", "reason", "score")
    best = rows.groupBy(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).agg(F.max_by(rest, F.struct("score", "classification", "reason")).alias("r"))
    return best.select("left_id", "right_id", "r.*")


def write_candidates(pairs: DataFrame, path: str) -> None:
    """Candidate pairs as JSON lines, one object a pair, written by all tasks at once."""
    pairs.select("left_id", "right_id", "classification", "reason", "score").write.mode("overwrite").json(path)
