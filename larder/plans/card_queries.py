"""Queries of card gaps, candidate relevance and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import cards as C
from larder.plans import identity_sql as Z
from larder.plans import sqltext as S
from larder.plans.search_queries import _ASKED_SQL, _asked
from larder.runtime import small_broadcast, table
from larder.sources import catalogue_pages as K


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    brands = table(spark, folder, "brands", "id", "name").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    columns = ["id", "name", "brand_id", "category_id", "barcode", "package_value", "package_unit", "subtype", "image_url", "keywords"]
    listed = table(spark, folder, "products", *columns).join(small_broadcast(brands), "brand_id", "left")
    return listed.withColumn("category", F.concat(F.lit("категория "), F.col("category_id"))).withColumn("description", F.lit(None).cast("string"))


_LISTS = ["missing", "weak", "critical", "next"]


def card_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Score, identity, presentation and the missing, weak, critical and next fields of each card (2.13.17, 2.13.19, 2.13.27, 2.8.90-2.8.95)."""
    found = C.evaluate_cards(_cards(spark, folder))
    return found.select(*[F.array_join(c, ",").alias(c) if c in _LISTS else F.col(c) for c in found.columns])


def missing_fields(spark: SparkSession, folder: str) -> DataFrame:
    """How many cards lack each field or hold a weak value of it."""
    return C.evaluate_cards(_cards(spark, folder)).select(F.explode("next").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("cards"))


def targeted_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each prepared record may fill the card its code or its brand and name lead to, with points and reason (2.13.22, 2.13.23)."""
    columns = ["name", "brand", "barcode", "package_value", "package_unit"]
    cards = C.evaluate_cards(_cards(spark, folder), *columns).select("id", *columns, F.col("next").alias("needed"))
    records = table(spark, folder, "prepared_products", "rec_id", "name", "brand_name", "barcode", "package_value", "package_unit", "image_url").withColumnRenamed("brand_name", "brand")
    new = records.select("rec_id", F.lit(None).cast("string").alias("new_description"), *[F.col(c).alias(f"new_{c}") for c in (*columns, "image_url")])
    return C.candidate_pairs(cards, new).withColumn("points", F.round("points", 6)).select("id", "rec_id", "accepted", "points", "why")


def candidate_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Records that answer each query with a score of 0.42 or more (2.1.15, 2.8.84-2.8.86, 2.14.8-2.14.13)."""
    records = table(spark, folder, "prepared_products", "rec_id", "name", "brand_name", "category_name", "image_url")
    text = F.concat_ws(" ", "name", "brand_name", "category_name")
    met = records.withColumn("_text", text).join(F.broadcast(_asked(spark)), F.lit(True))  # the stated queries against all records
    scored = met.select("query_id", "rec_id", F.round(C.relevance(F.col("query"), F.col("_text"), F.col("image_url"), F.col("brand_name"), F.col("name")), 6).alias("relevance"))
    return scored.filter("relevance >= 0.42")


def provider_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Records relevant to each stated query by its telling words, with their scores (2.14.8-2.14.13, 2.14.28, 2.14.38-2.14.44)."""
    records = table(spark, folder, "prepared_products", "rec_id", "name")
    met = records.join(F.broadcast(_asked(spark)), F.lit(True))  # the stated queries against all records
    found = met.select("query_id", "rec_id", K.is_relevant(F.col("query"), F.col("name")).alias("relevant"), F.round(K.name_score(F.col("query"), F.col("name")), 6).alias("score"), F.round(K.coverage(F.col("query"), F.col("name")), 6).alias("coverage"), K.query_kind(F.col("query")).alias("kind"))
    return found.filter("relevant or score >= 0.2")


def provider_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Package and subtype read from each record's name (2.14.14, 2.14.15, 2.14.35)."""
    found = table(spark, folder, "prepared_products", "rec_id", "name").withColumn("p", K.package_in_text(F.col("name")))
    return found.select("rec_id", F.col("p.value").alias("package_value"), F.col("p.unit").alias("package_unit"), K.subtype_in_text(F.col("name")).alias("subtype"))


def source_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Article, clean address and kind of each source link (2.14.16-2.14.18)."""
    url = F.col("source_url")
    return table(spark, folder, "product_sources", "id", "source_url").filter("source_url is not null").select("id", K.source_id(url).alias("article"), K.clean_url(url).alias("address"), K.is_item_url(url).alias("item"))


def enrichment_queries(spark: SparkSession, folder: str) -> DataFrame:
    """What to ask a provider for each card (2.13.24)."""
    return C.enrichment_queries(_cards(spark, folder))


_EMPTY = lambda c: f"nullif({S.squeeze(c)}, '') is null"
_FOLDED = lambda c: f"replace(lower(coalesce({S.squeeze(c)}, '')), 'ё', 'е')"
_PLAIN = ["", "кофе", "молоко", "чай", "вода", "пицца", "сыр", "масло", "йогурт", "кефир", "сельдь", "сок", "сметана", "творог", "сливки", "колбаса", "майонез", "паштет", "печенье", "шоколад", "мороженое"]
_MARKERS = ["placeholder", "no-image", "no_image", "default-product", "default_product", "image-not-found", "image_not_found", "stub"]
_EVALUATED = f"""c as (select p.*, b.name as brand, 'категория ' || category_id as category from products p left join brands b on b.id = p.brand_id),
  t as (select *, {_FOLDED('name')} as fn, {_FOLDED('brand')} as fb, {_FOLDED('category')} as fc, {_FOLDED('image_url')} as fi, coalesce(package_value > 0, false) as hv, not ({_EMPTY('package_unit')}) as hu, {Z.code('barcode')} is not null as coded from c),
  u as (select *, fn not in {S.in_list(_PLAIN)} and (len(regexp_extract_all(fn, '[a-zа-я0-9]+')) >= 2 or length(fn) >= 12) as spec, fb not in {S.in_list(['', 'бренд не указан', 'не указан', 'unknown', 'no brand', 'без бренда'])} as real, fc <> '' as cat,
    case when fi = '' then 0 when {' or '.join(f"contains(fi, '{m}')" for m in _MARKERS)} then 10 when regexp_matches({S.squeeze('image_url')}, '^https?://') then 40 else 90 end as img from t),
  g as (select id, round_even(least(case when fn = '' then 0 when spec then 15 else 6 end + case when fb = '' then 0 when real then 12 else 2 end + case when cat then 10 else 0 end + case when hv and hu then 15 when hv or hu then 5 else 0 end
      + case when img <= 0 then 0 when img < 50 then 3 else img * 0.15 end + case when {_EMPTY('barcode')} then 0 when coded then 12 else 2 end + case when {_EMPTY('subtype')} then 0 else 4 end + case when {_EMPTY('keywords')} then 0 else 5 end, 100), 1)::double as score,
    (case when coded then 45 else 0 end + case when real then 20 else 0 end + case when spec then 20 else 0 end + case when hv and hu then 15 else 0 end)::double as identity,
    round_even(case when spec then 20 when fn <> '' then 8 else 0 end + case when real then 15 else 0 end + case when cat then 15 else 0 end + case when hv and hu then 15 else 0 end + img * 0.2, 1)::double as presentation,
    [case when fn = '' then 'name' end, case when fb = '' then 'brand' end, case when not cat then 'category' end, case when not hv and not hu then 'package' end, case when img <= 0 then 'image_url' end, 'description',
      case when {_EMPTY('barcode')} then 'barcode' end, case when {_EMPTY('subtype')} then 'subtype' end, case when {_EMPTY('keywords')} then 'keywords' end] as gone,
    [case when fn <> '' and not spec then 'name' end, case when fb <> '' and not real then 'brand' end, case when hv <> hu then 'package' end, case when img > 0 and img < 50 then 'image_url' end, case when not ({_EMPTY('barcode')}) and not coded then 'barcode' end] as thin,
    regexp_matches(coalesce({S.squeeze('image_url')}, ''), '^https?://') as unchecked from u),
  e as (select *, list_filter(gone, lambda x: x is not null) as missing, list_filter(thin, lambda x: x is not null) as weak from g),
  n as (select *, list_filter(['name', 'brand', 'category', 'package', 'image_url'], lambda x: list_contains(missing, x) or list_contains(weak, x)) as critical,
    list_filter(['brand', 'name', 'package', 'category', 'image_url', 'barcode', 'description', 'subtype', 'keywords'], lambda x: list_contains(missing, x) or list_contains(weak, x)) as needed from e)"""
_TARGETS = f"""with {_EVALUATED}, a as (select c.id, c.name, c.brand, {Z.code('barcode')} as code, {S.norm('c.brand')} as b, string_split({S.norm('c.name')}, ' ')[1] as w1, {Z.unit('package_unit')} as unit, package_value, package_unit, n.needed, {Z.name_tokens('c.name')} as w, {Z.brandless('c.brand')} as nobrand from c join n using (id)),
  r as (select rec_id, {Z.code('barcode')} as code, {S.norm('brand_name')} as b, string_split({S.norm('name')}, ' ')[1] as w1, {Z.unit('package_unit')} as unit, package_value, {Z.name_tokens('name')} as w, {Z.brandless('brand_name')} as nobrand, coalesce(image_url, '') <> '' as pictured from prepared_products),
  q as (select id, rec_id from a join r on a.code = r.code union select id, rec_id from a join r on a.b = r.b and a.w1 = r.w1),
  j as (select q.*, {Z.overlap('a.w', 'r.w')}, coalesce(a.code = r.code, false) as same, coalesce(a.code <> r.code, false) as other, a.nobrand, r.nobrand as nobrand2, a.b = r.b as brands, a.package_value is not null and coalesce(a.package_unit, '') <> '' as packed, list_contains(a.needed, 'image_url') and r.pictured as picture, r.pictured,
    {Z.base('a.package_value', 'a.unit')} as x, {Z.base('r.package_value', 'r.unit')} as y, {Z.family('a.unit')} as fx, {Z.family('r.unit')} as fy from q join a using (id) join r using (rec_id)),
  k as (select *, case when x is not null and y is not null then case when fx <> fy then false else abs(x - y) <= greatest(x, y) * 0.005 end end as fits from j),
  z as (select *, case when other then 'barcode_conflict' when not nobrand and not nobrand2 and not brands then 'brand_conflict' when not fits then 'package_conflict' when same and common <= 0 and coverage < 0.5 then 'barcode_name_mismatch' when same then 'exact_barcode'
    when not nobrand and nobrand2 then 'missing_external_brand' when nobrand and nobrand2 then 'no_brand_evidence' when packed and not coalesce(fits, false) then 'package_not_confirmed' when common < 2 then 'weak_name_common_tokens' when coverage < 0.8 then 'weak_name_coverage'
    when jaccard < 0.55 then 'weak_name_jaccard' else 'brand_name_package' end as why from k)
  select id, rec_id, why in ('exact_barcode', 'brand_name_package') as accepted, why, round(case when why = 'exact_barcode' then 100 + case when pictured then 3 else 0 end when why = 'brand_name_package' then 55 + coverage * 20 + jaccard * 15 + case when fits then 10 else 0 end + case when picture then 5 else 0 end else 0 end, 6)::double as points from z"""
_BASE_QUERY = f"nullif(concat_ws(' ', {Z.filled('brand')}, {Z.filled('name')}), '')"
_WORDS = lambda x: f"list_distinct(list_filter(string_split({S.norm(x)}, ' '), lambda w: length(w) >= 2))"

_TOK = lambda x: f"list_filter(regexp_extract_all({_FOLDED(x)}, '[a-zа-я0-9]+'), lambda w: length(w) >= 2)"
_LIKE = "w = x or (length(w) >= 4 and length(x) >= 4 and (contains(w, x) or contains(x, w)))"
_KINDS = [
    "кофе", "чай", "молоко", "сметана", "кефир", "йогурт", "сыр", "масло", "вода", "сок", "пицца", "сельдь", "рыба", "мясо", "колбаса", "макароны", "рис", "гречка", "мука", "сахар", "соль", "хлеб", "печенье", "шоколад", "конфеты", "мороженое", "пельмени",
    "вареники", "творог", "сливки", "яйца", "яйцо", "продукт", "продукты", "напиток", "напитки",
]
_GENERAL = S.in_list([*_KINDS, *"растворимый растворимое молотый молотое зерновой зерновое зернах черный зеленый питьевой питьевое пастеризованный пастеризованное ультрапастеризованный ультрапастеризованное безлактозный безлактозное замороженный замороженная замороженное сливочный сливочная средний средняя жирности гост".split()])
_SUBTYPES = [
    ("Молотый", ["молотый", "молотая", "ground"]), ("В зёрнах", ["в зернах", "зерновой", "зерновая", "beans"]), ("Растворимый", ["растворимый", "instant"]), ("В капсулах", ["в капсулах", "капсулы", "капсульный"]), ("Пастеризованное", ["пастеризован"]),
    ("Безлактозное", ["безлактоз", "без лактозы"]),
]

QUERIES = {f.__name__: f for f in (card_completeness, missing_fields, targeted_candidates, candidate_relevance, provider_matches, provider_fields, source_addresses, enrichment_queries)}
SQL = {
    "card_completeness": f"with {_EVALUATED} select id, score, identity, presentation, array_to_string(missing, ',') as missing, array_to_string(weak, ',') as weak, array_to_string(critical, ',') as critical, array_to_string(needed, ',') as next, unchecked, len(critical) = 0 and not unchecked and score >= 85 and identity >= 55 and presentation >= 80 as complete from n",
    "missing_fields": f"with {_EVALUATED}, f as (select unnest(needed) as field from n) select field, count(*) as cards from f group by field",
    "targeted_candidates": _TARGETS,
    "provider_matches": f"""with t as (select query_id, rec_id, query, name, {_TOK('query')} as a, {_TOK('name')} as h, {_FOLDED('query')} as fq, {_FOLDED('name')} as fn from prepared_products, {_ASKED_SQL}),
      m as (select *, list_filter(a, lambda w: len(list_filter(h, lambda x: {_LIKE})) > 0) as met, list_filter(a, lambda w: w not in {_GENERAL}) as anchors from t),
      s as (select *, len(list_filter(anchors, lambda w: not list_contains(met, w))) = 0 as whole, case when len(a) = 0 or len(h) = 0 then 0.0 else len(met) / len(a) end as coverage, len(list_filter(a, lambda w: list_contains(h, w))) as exact from m),
      r as (select query_id, rec_id, whole and len(a) > 0 and case when len(a) = 1 then coverage >= 1 else coverage >= 0.5 end as relevant, round(coverage, 6) as coverage, list_filter(a, lambda w: w in {S.in_list(_KINDS)})[1] as kind,
        round(case when len(a) = 0 or len(h) = 0 then 0.0 else least((exact + (len(met) - exact) * 0.55) / len(a) + case when contains(fn, fq) then 0.18 else 0 end + case when len(anchors) > 0 and whole then 0.2 else 0 end, 1.0) end, 6) as score from s)
      select * from r where relevant or score >= 0.2""",
    "provider_fields": f"""with f as (select rec_id, name, regexp_extract_all(regexp_replace(lower(name), '([^0-9\\p{{L}}.,])', '\\1\\1', 'g'), '(?:^|[^0-9])([0-9]+(?:[.,][0-9]+)?)\\s*(кг|kg|г|гр|g|л|l|мл|ml)(?:$|[^\\p{{L}}\\p{{N}}_])', 1) as v,
      regexp_extract_all(regexp_replace(lower(name), '([^0-9\\p{{L}}.,])', '\\1\\1', 'g'), '(?:^|[^0-9])([0-9]+(?:[.,][0-9]+)?)\\s*(кг|kg|г|гр|g|л|l|мл|ml)(?:$|[^\\p{{L}}\\p{{N}}_])', 2) as u from prepared_products)
      select rec_id, try_cast(replace(v[-1], ',', '.') as decimal(12, 3)) as package_value, case u[-1] when 'гр' then 'г' when 'g' then 'г' when 'kg' then 'кг' when 'ml' then 'мл' when 'l' then 'л' else u[-1] end as package_unit,
      case {' '.join(f"when {' or '.join(f'contains({_FOLDED(chr(110) + chr(97) + chr(109) + chr(101))}, {chr(39)}{t}{chr(39)})' for t in terms)} then '{title}'" for title, terms in _SUBTYPES)} end as subtype from f""",
    "source_addresses": r"""with a as (select id, source_url, regexp_replace(regexp_replace(trim(source_url), '[?#].*$', ''), '/+$', '') as address from product_sources where source_url is not null), b as (select *, string_split(address, '/')[-1] as last from a),
      c as (select *, list_filter(string_split_regex(last, '[^0-9]+'), lambda d: length(d) between 7 and 14) as n from b)
      select id, case when len(n) > 0 then n[-1] else nullif(last, '') end as article, address, contains(lower(source_url), '/product/') or contains(lower(source_url), '/products/') or (contains(lower(source_url), '/catalog/') and len(n) > 0) as item from c""",
    "enrichment_queries": f"""with c as (select p.*, b.name as brand from products p left join brands b on b.id = p.brand_id),
      q as (select id, {_BASE_QUERY} as base, {_BASE_QUERY} || ' ' || {Z.number('cast(package_value as varchar)')} || ' ' || {Z.filled('package_unit')} as whole from c),
      l as (select id, list_filter([whole, base], lambda x: x is not null) as asked from q where base is not null) select id, cast(generate_subscripts(asked, 1) - 1 as integer) as pos, unnest(asked) as query from l""",
    "candidate_relevance": f"""with r as (select rec_id, name, brand_name, image_url, concat_ws(' ', name, brand_name, category_name) as t from prepared_products),
    m as (select query_id, rec_id, {_WORDS('query')} as a, {_WORDS('t')} as h, contains({S.norm('t')}, {S.norm('query')}) as whole, name, brand_name, image_url from r, {_ASKED_SQL}),
    s as (select *, len(list_intersect(a, h)) as e, len(list_filter(a, lambda w: not list_contains(h, w) and length(w) >= 4 and len(list_filter(h, lambda x: length(x) >= 4 and (contains(x, w) or contains(w, x)))) > 0)) as p from m),
    k as (select query_id, rec_id, round(case when len(a) = 0 then 0.0 else least((e + p * 0.5::double) / len(a) + case when whole then 0.2::double else 0 end + case when not ({_EMPTY('image_url')}) then 0.08::double else 0 end
      + case when not ({_EMPTY('brand_name')}) then 0.07::double else 0 end + case when not ({_EMPTY('name')}) then 0.05::double else 0 end, 1.0::double) end, 6) as relevance from s)
    select query_id, rec_id, relevance from k where relevance >= 0.42""",
}
