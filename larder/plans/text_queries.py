"""Queries of text forms, tokens, packages and field quality over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import identity as I
from larder.functions import text as T
from larder.plans import identity_sql as Z
from larder.plans import sqltext as S
from larder.runtime import small_broadcast, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"select id, {S.norm('name')} as norm, {S.is_latin('name')} as has_latin, {S.is_cyrillic('name')} as has_cyrillic, {S.norm('name')} <> normalized_name as stale from products")
def text_normalize_products(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form of every product name, scripts, and whether the stored form is stale (2.8.1-2.8.3)."""
    name = F.col("name")
    return table(spark, folder, "products", "id", "name", "normalized_name").select(
        "id", T.normalize_text(name).alias("norm"), T.contains_latin(name).alias("has_latin"), T.contains_cyrillic(name).alias("has_cyrillic"), (T.normalize_text(name) != F.col("normalized_name")).alias("stale")
    )


@query(
    f"select id, {S.to_russian('name')} as russian_layout, {S.to_english('name')} as english_layout, {S.to_latin('name')} as latin, {S.to_cyrillic('name')} as cyrillic from brands"
)
def text_layouts_brands(spark: SparkSession, folder: str) -> DataFrame:
    """Other keyboard layouts and transliterations of the brand names (2.8.4-2.8.7)."""
    n = F.col("name")
    return table(spark, folder, "brands", "id", "name").select("id", T.to_russian_layout(n).alias("russian_layout"), T.to_english_layout(n).alias("english_layout"), T.to_latin(n).alias("latin"), T.to_cyrillic(n).alias("cyrillic"))


_FORMS = (
    f"[{S.norm('name')}, case when {S.is_latin('name')} then {S.to_russian('name')} end, case when {S.is_latin('name')} then {S.to_cyrillic(S.norm('name'))} end, "
    f"case when {S.is_latin('name')} then {S.to_latin(S.to_russian('name'))} end, case when {S.is_cyrillic('name')} then {S.to_english('name')} end, "
    f"case when {S.is_cyrillic('name')} then {S.to_latin(S.norm('name'))} end, case when {S.is_cyrillic('name')} then {S.to_cyrillic(S.to_english('name'))} end]"
)


@query(
    f"""with f as (select id, unnest({_FORMS}) as v, generate_subscripts({_FORMS}, 1) as p from brands),
    d as (select id, v, min(p) as p from f where v is not null and v <> '' group by id, v)
    select id, cast(row_number() over (partition by id order by p) as integer) as pos, v as variant from d"""
)
def search_variants_brands(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered distinct query forms of each brand name, one a row (2.8.8)."""
    found = table(spark, folder, "brands", "id", "name").select("id", F.posexplode(T.search_variants(F.col("name"))).alias("p", "variant"))
    return found.select("id", (F.col("p") + 1).alias("pos"), "variant")


_UNITS = ["г", "гр", "кг", "мл", "л", "шт", "g", "kg", "ml", "l"]
_STOP = ["и", "в", "во", "на", "с", "со", "из", "для", "по", "под", "без", "от", "до", "к", "у", "а", "или"]
_TOKENS = lambda c: f"regexp_extract_all({S.norm(c)}, '[0-9]+|[a-zа-я]+')"


@query(
    f"""with w as (select id, unnest({_TOKENS('name')}) as value, generate_subscripts({_TOKENS('name')}, 1) - 1 as position from products)
    select id, cast(position as integer) as position, value, regexp_matches(value, '^([0-9]+|nan|inf|infinity)$') as is_number, value in {S.in_list(_UNITS)} as is_unit from w where value not in {S.in_list(_STOP)}"""
)
def query_tokens_products(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of each name with their kind, stop words left out (2.8.11, 2.8.12, 2.8.37)."""
    return table(spark, folder, "products", "id", "name").select("id", F.explode(T.query_tokens(F.col("name"))).alias("t")).select("id", "t.position", "t.value", "t.is_number", "t.is_unit")


@query(
    f"""with w as (select id, {_TOKENS('search_text')} as w from products where search_text is not null)
    select id, len(w) as tokens, len(list_filter(w, lambda t: t in {S.in_list(_STOP)})) as stop_words, len(list_filter(w, lambda t: t in {S.in_list(_UNITS)})) as units, array_to_string(list_filter(w, lambda t: t not in {S.in_list(_STOP)}), ' ') as joined from w"""
)
def text_token_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each search text by kind and joined, without a shuffle (2.8.13, 2.8.14)."""
    found = table(spark, folder, "products", "id", "search_text").filter("search_text is not null").select("id", T.query_tokens(F.col("search_text"), keep_stop_words=True).alias("t"))
    count = lambda test: F.size(F.filter("t", test)).cast("bigint")
    joined = F.array_join(F.transform(F.filter("t", lambda t: ~t["is_stop_word"]), lambda t: t["value"]), " ")
    return found.select("id", F.size("t").cast("bigint").alias("tokens"), count(lambda t: t["is_stop_word"]).alias("stop_words"), count(lambda t: t["is_unit"]).alias("units"), joined.alias("joined"))


@query(
    f"""with w as (select id, list_filter({_TOKENS('name')}, lambda t: t not in {S.in_list(_STOP)}) as w from products),
    f as (select id, w, list_filter(range(1, len(w)), lambda i: regexp_matches(w[i], '^[0-9]+$') and try_cast(w[i] as double) > 0 and w[i + 1] in {S.in_list(_UNITS)})[1] as spot from w)
    select id, try_cast(w[spot] as double) as package_value, case w[spot + 1] when 'гр' then 'г' when 'g' then 'г' when 'kg' then 'кг' when 'ml' then 'мл' when 'l' then 'л' else w[spot + 1] end as package_unit,
      array_to_string(list_filter(w, lambda t, i: i <> spot and i <> spot + 1), ' ') as rest from f where spot is not null"""
)
def query_package_products(spark: SparkSession, folder: str) -> DataFrame:
    """The package among the tokens of a name, and the name's other tokens (2.8.15-2.8.17)."""
    found = table(spark, folder, "products", "id", "name").select("id", T.query_tokens(F.col("name")).alias("t")).withColumn("p", T.query_package(F.col("t"))).filter("p is not null")
    return found.select("id", F.col("p.value").alias("package_value"), F.col("p.unit").alias("package_unit"), F.array_join(F.transform(T.without_package(F.col("t")), lambda t: t["value"]), " ").alias("rest"))


@query(
    f"""select id, array_to_string(list_filter(list_transform(string_split(replace(lower(coalesce({S.squeeze('name')}, '')), 'ё', 'е'), ' '), lambda w: trim(w, '.,:;!?()[]{{}}"''«»')), lambda w: w <> ''), ' ') as phrase,
    case when contains(replace(lower({S.squeeze('name')}), 'ё', 'е'), 'новинка') then {S.squeeze('name')} else {S.squeeze('name')} || ' новинка' end as refined from products"""
)
def pipeline_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Names as the search pipeline folds them, and as queries refined by a term (2.8.18-2.8.21, 2.9.10)."""
    name = F.col("name")
    return table(spark, folder, "products", "id", "name").select("id", T.phrase(name).alias("phrase"), T.refined(name, F.lit("новинка")).alias("refined"))


@query(
    """with d as (select id, regexp_replace(barcode, '[^0-9]', '', 'g') as digits from products where barcode is not null),
    g as (select id, digits as code from d where length(digits) between 8 and 14)
    select code, count(*) as listings, min(id) as first_id from g group by code having count(*) > 1"""
)
def shared_barcodes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of 8 to 14 digits that several listings have once their spelling is folded (2.8.27, 2.8.88, 2.8.115)."""
    codes = table(spark, folder, "products", "id", "barcode").select("id", T.digits_code(F.col("barcode")).alias("code")).filter("code is not null")
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("listings"), F.min("id").alias("first_id")).filter("listings > 1")


_UNIT = Z.unit('package_unit')


@query(
    f"""with u as (select id, package_value, {_UNIT} as unit from products),
    b as (select id, unit, case when unit in ('г', 'кг') then 'mass' when unit in ('мл', 'л') then 'volume' end as family,
      cast(case when unit in ('кг', 'л') and package_value > 0 then package_value * 1000 when unit in ('г', 'мл') and package_value > 0 then package_value end as decimal(18, 3)) as base from u)
    select id, unit, family, base from b"""
)
def package_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Unit, family and base amount of each listing's package (2.8.28-2.8.30)."""
    p = table(spark, folder, "products", "id", "package_value", "package_unit").withColumn("unit", I.package_unit(F.col("package_unit")))
    return p.select("id", "unit", I.package_family(F.col("unit")).alias("family"), I.package_base(F.col("package_value"), F.col("unit")).alias("base"))


_BASES = SQL["package_bases"]


@query(
    f"""with b as ({_BASES}), d as (select distinct least(left_id, right_id) as a, greatest(left_id, right_id) as z from duplicate_candidates where left_id is not null and right_id is not null and left_id <> right_id)
    select d.a as left_id, d.z as right_id, case when x.base is not null and y.base is not null then case when x.family <> y.family then false
      else abs(x.base - y.base) <= greatest(x.base, y.base) * cast(0.03 as decimal(3, 2)) end end as compatible
    from d join b x on x.id = d.a join b y on y.id = d.z"""
)
def package_compatibility(spark: SparkSession, folder: str) -> DataFrame:
    """Three-valued package compatibility of every candidate pair (2.8.31)."""
    b = package_bases(spark, folder)
    pairs = table(spark, folder, "duplicate_candidates", "left_id", "right_id").filter("left_id is not null and right_id is not null and left_id <> right_id")
    pairs = pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
    side = lambda key, tag: b.select(F.col("id").alias(key), F.col("base").alias(f"{tag}b"), F.col("family").alias(f"{tag}f"))
    met = pairs.join(side("left_id", "l"), "left_id").join(side("right_id", "r"), "right_id")
    return met.select("left_id", "right_id", I.packages_compatible(F.col("lb"), F.col("lf"), F.col("rb"), F.col("rf")).alias("compatible"))


@query(
    f"""select id, array_to_string({Z.percentages('name')}, ' ') as percentages, array_to_string({Z.counts('name')}, ' ') as counts, array_to_string({Z.packages('name')}, ' ') as packages, array_to_string({Z.markers('name')}, ' ') as markers from products"""
)
def name_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Percentages, piece counts, packages and other numbers written in each name (2.8.41-2.8.44, 2.8.111)."""
    name = F.col("name")
    found = {"percentages": I.percentages(name), "counts": I.counts(name), "packages": I.name_packages(name), "markers": I.numeric_markers(name)}
    return table(spark, folder, "products", "id", "name").select("id", *[F.array_join(v, " ").alias(c) for c, v in found.items()])


@query(
    f"""with t as (select p.id, {Z.variants('p.name')} as scan, {Z.variants('p.name', 'merge')} as merge, {Z.brand_tokens('b.name')} as own, {Z.name_tokens('p.name')} as core, {Z.text_tokens('p.name')} as words from products p left join brands b on b.id = p.brand_id)
    select id, array_to_string({Z.without('scan', 'own')}, ' ') as scan_variants, array_to_string({Z.without('merge', 'own')}, ' ') as merge_variants, array_to_string(list_sort(core), ' ') as core_words, array_to_string(list_sort(words), ' ') as words from t"""
)
def variant_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each name that may tell its variant by both sets of rules, its core words and all its words (2.8.36-2.8.40, 2.8.110, 2.8.113)."""
    brands = table(spark, folder, "brands", "id", "name").select(F.col("id").alias("brand_id"), F.col("name").alias("_brand"))
    met, name, brand = table(spark, folder, "products", "id", "name", "brand_id").join(small_broadcast(brands), "brand_id", "left"), F.col("name"), F.col("_brand")
    found = {"scan_variants": I.variant_tokens(name, brand), "merge_variants": I.variant_tokens(name, brand, "merge"), "core_words": I.name_tokens(name), "words": I.text_tokens(name)}
    return met.select("id", *[F.array_join(F.array_sort(v), " ").alias(c) for c, v in found.items()])


@query(f"select id, {Z.name_quality('name')} as name_quality, {Z.image_quality('image_url')} as image_quality, {Z.plain('name')} as plain from products")
def field_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the name and the image of each listing, and whether the name is only a kind of goods (2.8.34, 2.8.45, 2.8.47)."""
    p = table(spark, folder, "products", "id", "name", "image_url")
    return p.select("id", I.name_quality(F.col("name")).cast("bigint").alias("name_quality"), I.image_quality(F.col("image_url")).alias("image_quality"), I.is_generic_name(F.col("name")).alias("plain"))


@query(
    f"""select id, array_to_string(list_sort(list_distinct(list_filter(list_concat([{S.norm('name')}], list_concat(string_split({S.norm('name')}, ' '), list_concat([coalesce({S.norm('keywords')}, '')], string_split(coalesce({S.norm('keywords')}, ''), ' ')))), lambda v: v <> ''))), ' ') as words from products"""
)
def search_words(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct words and whole fields of name and keywords, sorted: the part of the search index that SQL can state (2.8.9, 2.8.10, 2.8.48)."""
    parts = F.concat(F.array(T.normalize_text(F.col("name"))), T.words(F.col("name")), F.array(F.coalesce(T.normalize_text(F.col("keywords")), F.lit(""))), F.coalesce(T.words(F.col("keywords")), F.array().cast("array<string>")))
    return table(spark, folder, "products", "id", "name", "keywords").select("id", F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda v: v != ""))), " ").alias("words"))


@query()
def search_index_products(spark: SparkSession, folder: str) -> DataFrame:
    """The search index of each listing from name, brand, subtype and keywords, forms and transliterations included (2.1.34, 2.8.9)."""
    brands = table(spark, folder, "brands", "id", "name").select(F.col("id").alias("brand_id"), F.col("name").alias("_brand"))
    met = table(spark, folder, "products", "id", "name", "brand_id", "subtype", "keywords").join(brands, "brand_id", "left")
    return met.select("id", T.search_index(F.col("name"), F.col("_brand"), F.col("subtype"), F.col("keywords")).alias("search_index"))
