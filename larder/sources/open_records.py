"""Records of an open product catalogue: values picked from raw payloads, and the fields of a listing built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T

#: Names that are no more than a kind of goods, and brands that are none.
KIND_NAMES = ["кофе", "coffee", "молоко", "milk", "пицца", "pizza", "чай", "tea", "вода", "water", "сыр", "cheese", "масло", "butter", "йогурт", "yogurt", "yoghurt", "кефир", "kefir", "сельдь", "herring", "продукт", "product"]
NO_BRANDS = ["", "unknown", "no brand", "без бренда", "бренд не указан", "не указан"]
#: Kinds and subtypes by what the categories contain; the first that matches counts.
KINDS = [
    ("Кофе", ["coffee", "кофе"]), ("Молоко", ["milk", "молоко"]), ("Пицца", ["pizza", "пицца"]), ("Чай", ["tea", "чай"]), ("Сельдь", ["herring", "сельдь", "селед"]), ("Сыр", ["cheese", "сыр"]),
    ("Йогурт", ["yogurt", "yoghurt", "йогурт"]),
]
SUBTYPES = [
    ("Растворимый", ["instant coffee", "soluble coffee", "растворим"]), ("Молотый", ["ground coffee", "ground coffees", "молот"]), ("В зёрнах", ["coffee beans", "whole bean", "whole beans", "зернах", "зёрнах"]),
    ("Без кофеина", ["decaf", "decaffeinated", "без кофеина"]), ("Пастеризованное", ["pasteurized milk", "pasteurised milk", "пастеризован"]), ("Ультрапастеризованное", ["uht milk", "ультрапастеризован"]),
]
#: Keys of a payload in the order in which a name, a generic name and the ingredients are looked for.
NAME_KEYS = ["product_name_ru", "product_name", "product_name_en", "abbreviated_product_name"]
GENERIC_KEYS = ["generic_name_ru", "generic_name", "generic_name_en"]
INGREDIENT_KEYS = ["ingredients_text_ru", "ingredients_text", "ingredients_text_en"]


def folded(col: Column) -> Column:
    """Single blanks, lower case, ё as е; null is empty."""
    return F.translate(F.lower(F.coalesce(T.squeeze(col), F.lit(""))), "ё", "е")


def distinct_by(values: Column, key) -> Column:
    """The filled values of an array, each once by ``key``, the first spelling kept, in order."""
    clean = F.filter(F.transform(values, T.squeeze), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.filter(clean, lambda v, i: (key(v) != "") & ~F.exists(F.slice(clean, F.lit(1), i), lambda u: key(u) == key(v)))


def unique_values(values: Column) -> Column:
    """Distinct values by their folded form."""
    return distinct_by(values, folded)


def clean_list(col: Column) -> Column:
    """The distinct values of a comma list in order, letter case aside; null gives an empty list."""
    return distinct_by(F.split(F.coalesce(col, F.lit("")), ","), F.lower)


def first_filled(payload: Column, keys: list[str]) -> Column:
    """The first filled value of a map's keys."""
    return F.coalesce(*[T.filled(F.try_element_at(payload, F.lit(k))) for k in keys])


def prefixed_values(payload: Column, prefix: str) -> Column:
    """The distinct filled values of all keys with a prefix, in the order of the keys."""
    chosen = F.array_sort(F.map_entries(F.map_filter(payload, lambda k, v: F.startswith(k, F.lit(prefix)))))
    return distinct_by(F.transform(chosen, lambda e: e["value"]), F.lower)


def payload_name(payload: Column) -> Column:
    """The name of a raw payload: preferred keys, then any other language, then the generic name."""
    return F.coalesce(first_filled(payload, NAME_KEYS), F.get(prefixed_values(payload, "product_name_"), F.lit(0)), payload_generic(payload))


def payload_generic(payload: Column) -> Column:
    return F.coalesce(first_filled(payload, GENERIC_KEYS), F.get(prefixed_values(payload, "generic_name_"), F.lit(0)))


def payload_ingredients(payload: Column) -> Column:
    return F.coalesce(first_filled(payload, INGREDIENT_KEYS), F.get(prefixed_values(payload, "ingredients_text_"), F.lit(0)))


def merged_payload(first: Column, second: Column) -> Column:
    """Both payloads as one; a value of the second counts unless it is null, empty or an empty list."""
    return F.map_zip_with(F.coalesce(first, F.create_map().cast("map<string,string>")), F.coalesce(second, F.create_map().cast("map<string,string>")), lambda k, a, b: F.when(b.isNotNull() & ~b.isin("", "[]"), b).otherwise(a))


def payload_is_sparse(payload: Column) -> Column:
    """Whether at most one of the eight telling fields is filled."""
    keys = ["brands", "quantity", "product_quantity", "generic_name", "categories", "ingredients_text", "brands_tags", "categories_tags"]
    return sum((T.filled(F.try_element_at(payload, F.lit(k))).isNotNull().cast("int") for k in keys), F.lit(0)) <= 1


def normalized_payloads(raw: DataFrame) -> DataFrame:
    """(code, name, name_ru, generic, ingredients, brands, brand_tags, categories, category_tags, quantity, sparse) of raw payloads
    (code, payload MAP<STRING,STRING>); lists are distinct, empty texts null. A null payload gives a record without values."""
    at = lambda k: T.filled(F.try_element_at("payload", F.lit(k)))
    lists = {c: clean_list(F.try_element_at("payload", F.lit(k))) for c, k in (("brand_tags", "brands_tags"), ("categories", "categories"), ("category_tags", "categories_tags"))}
    return raw.select(
        "code", payload_name(F.col("payload")).alias("name"), at("product_name_ru").alias("name_ru"), payload_generic(F.col("payload")).alias("generic"), payload_ingredients(F.col("payload")).alias("ingredients"), at("brands").alias("brands"),
        *[v.alias(c) for c, v in lists.items()], F.try_element_at("payload", F.lit("product_quantity")).try_cast("double").alias("quantity"), payload_is_sparse(F.col("payload")).alias("sparse"),
    )


def humanize(tag: Column) -> Column:
    """A tag as text: a prefix of up to three letters off, hyphens as blanks, the first letter large; empty for none."""
    clean = F.coalesce(T.squeeze(tag), F.lit(""))
    bare = T.squeeze(F.replace(F.regexp_replace(clean, "^[^:]{0,3}:(?=.)", ""), F.lit("-"), F.lit(" ")))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))


def _generic(col: Column) -> Column:
    return folded(col).isin(*KIND_NAMES)


def _real(col: Column) -> Column:
    return ~folded(col).isin(*NO_BRANDS)


def chosen_brand(brands: Column, tags: Column) -> Column:
    """The first real brand of a list with any of the usual signs, else of the tags."""
    listed = F.filter(F.transform(F.split(F.coalesce(brands, F.lit("")), "[,;/|]"), T.squeeze), _real)
    return F.coalesce(F.get(listed, F.lit(0)), F.get(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), humanize), _real), F.lit(0)))


def specific_name(names: Column) -> Column:
    """Of the distinct names the one with most words, then letters, that is more than a kind of goods; else the first."""
    every = unique_values(names)
    good = F.filter(every, lambda v: ~_generic(v))
    best = F.array_max(F.transform(good, lambda v, i: F.struct(F.size(F.split(v, " ")).alias("w"), F.length(v).alias("n"), (-i).alias("i"), v.alias("v"))))["v"]
    return F.coalesce(best, F.get(every, F.lit(0)))


def by_rules(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The title of the first rule of which a term stands in the text."""
    return F.coalesce(*[F.when(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)), F.lit(title)) for title, terms in rules])


def package_for_name(value: Column, unit: Column) -> Column:
    """Number and unit as they stand in a name; null if either is missing."""
    plain = F.regexp_replace(value.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    return F.concat(plain, F.lit(" "), F.nullif(unit, F.lit("")))


def informative_name(name: Column, kind: Column, brand: Column, package: Column) -> Column:
    """Brand, name and package, each only where the rest does not hold it; a name that is a kind of goods stands before its brand."""
    base = F.coalesce(name, kind)
    bare = _generic(base)
    lacks = lambda what, text: F.coalesce(~F.contains(folded(text), folded(what)), F.lit(False)) & what.isNotNull()
    before = F.when(~bare & lacks(brand, base), brand)
    after = F.when(bare & lacks(brand, base), brand)
    whole = F.concat_ws(" ", before, base, after)
    return F.when(base.isNotNull(), F.array_join(unique_values(F.array_compact(F.array(before, base, after, F.when(lacks(package, whole), package)))), " "))


def open_listings(records: DataFrame) -> DataFrame:
    """(rec_id, brand, name, kind, subtype, full_name, keywords, description) of records with rec_id, product_name_ru, product_name,
    generic_name, brands, categories, countries_tags, amount and unit; null fields count as empty ones."""
    tags = F.coalesce("countries_tags", F.array().cast("array<string>"))
    staged = records.select(
        "rec_id", "generic_name", "amount", "unit", tags.alias("_tags"), clean_list(F.col("categories")).alias("_cats"), chosen_brand(F.col("brands"), F.lit(None).cast("array<string>")).alias("brand"),
        specific_name(F.array("product_name_ru", "product_name", "generic_name")).alias("name"),
    )
    text = folded(F.array_join("_cats", " "))
    staged = staged.withColumn("kind", by_rules(text, KINDS)).withColumn("subtype", by_rules(text, SUBTYPES))
    full = F.coalesce(informative_name(F.col("name"), F.col("kind"), F.col("brand"), package_for_name(F.col("amount"), F.col("unit"))), F.col("name"))
    words = unique_values(F.concat(F.transform(F.concat("_cats", "_tags"), humanize), F.array_compact(F.array("brand", "kind"))))
    described = F.when(~_generic(F.col("generic_name")), T.filled(F.col("generic_name")))
    return staged.select("rec_id", "brand", "name", "kind", "subtype", full.alias("full_name"), F.nullif(F.array_join(words, ", "), F.lit("")).alias("keywords"), described.alias("description"))
