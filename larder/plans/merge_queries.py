"""Queries of matching and merging incoming records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import merge as M
from larder.plans import identity_sql as Z
from larder.plans import sqltext as S
from larder.runtime import small_broadcast, table


def _catalogue(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    brands = table(spark, folder, "brands", "id", "name").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    return table(spark, folder, "products", "id", "name", "brand_id", "barcode", "package_value", "package_unit", "is_active", *extra).filter("is_active").join(small_broadcast(brands), "brand_id", "left")


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared records, and as records with negative ids the listings that are no longer active."""
    fields = ["name", "brand", "barcode", "package_value", "package_unit", "image_url", "keywords"]
    new = table(spark, folder, "prepared_products").withColumnRenamed("brand_name", "brand").select("rec_id", *fields)
    brands = table(spark, folder, "brands", "id", "name").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    gone = table(spark, folder, "products").filter("not is_active").join(small_broadcast(brands), "brand_id", "left").select((-F.col("id")).cast("bigint").alias("rec_id"), *fields)
    return new.unionByName(gone)


def match_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """The listing of each prepared record and the stage that found it (2.3.8-2.3.10, 2.12.17-2.12.22, 2.5.3, 2.5.4)."""
    return M.match_cascade(_incoming(spark, folder), _catalogue(spark, folder)).select("rec_id", "product_id", "stage", "match_type")


def merged_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Matched listings with the better value of each field, what changed and what conflicts (2.12.20-2.12.27, 2.7.4, 2.8.48)."""
    fields = ["name", "brand", "barcode", "package_value", "package_unit", "image_url", "keywords"]
    new = _incoming(spark, folder).select("rec_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    old = _catalogue(spark, folder, "subtype", "image_url", "keywords").select(F.col("id").alias("product_id"), "subtype", *fields)
    met = match_cascade(spark, folder).groupBy("product_id").agg(F.min("rec_id").alias("rec_id"))  # one record at a time enters a listing
    out = M.merge_fields(met.join(new, "rec_id").join(old, "product_id"))
    return out.select("product_id", *fields, "search_text", F.array_join("changed", ",").alias("changed"), F.array_join("conflicts", ",").alias("conflicts"))


def consolidated_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Surviving listings of the safe pairs with the better values of their first duplicate (2.12.32, 2.12.35)."""
    fields = ["name", "brand", "barcode", "package_value", "package_unit", "image_url", "keywords"]
    brands = table(spark, folder, "brands", "id", "name").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    listed = table(spark, folder, "products").join(small_broadcast(brands), "brand_id", "left")
    safe = table(spark, folder, "duplicate_candidates", "left_id", "right_id", "classification").filter("left_id <> right_id and classification = 'AUTO_SAFE'")
    pairs = safe.groupBy(F.least("left_id", "right_id").alias("product_id")).agg(F.min(F.greatest("left_id", "right_id")).alias("rec_id"))
    new = listed.select(F.col("id").alias("rec_id"), *[F.col(c).alias(f"new_{c}") for c in fields])
    old = listed.select(F.col("id").alias("product_id"), *fields)
    out = M.merge_fields(pairs.join(new, "rec_id").join(old, "product_id"), consolidating=True)
    return out.select("product_id", *fields, F.array_join("changed", ",").alias("changed"))


def created_records(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared records that match no listing and so become new ones, with the fields they come with (2.12.30, 2.12.45)."""
    left = _incoming(spark, folder).join(match_cascade(spark, folder).select("rec_id"), "rec_id", "left_anti").withColumnRenamed("rec_id", "id").filter(F.trim("name") != "")
    return M.created_fields(left).select("id", F.array_join("fields", ",").alias("fields"))


def new_brands(spark: SparkSession, folder: str) -> DataFrame:
    """Brands of prepared records that the reference list lacks (2.12.28, 2.12.29, 2.12.43, 2.12.44)."""
    names = table(spark, folder, "prepared_products", "brand_name").select(F.col("brand_name").alias("name"))
    return M.new_names(table(spark, folder, "brands", "name"), names)


def linked_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Source links after the same deliveries come again: the first link of each pair stands, others are kept, updated or in conflict (2.12.31, 2.13.13, 2.3.13)."""
    rows = table(spark, folder, "product_sources", "id", "product_id", "provider", "source_id", "source_url")
    firsts = rows.groupBy(F.trim("provider").alias("provider"), "source_id").agg(F.min_by(F.struct("product_id", "source_url"), "id").alias("x")).select("provider", "source_id", "x.*").filter("product_id % 2 = 0")
    return M.link_sources(firsts, rows.withColumnRenamed("id", "rec_id"))


_SHAPE = lambda key, brand: f"""{key}, {Z.code('barcode')} as code, coalesce({S.norm(S.squeeze('name'))}, '') as n, {S.norm(f"coalesce({Z.filled(brand)}, 'Бренд не указан')")} as b, {Z.brandless(brand)} as nobrand, {Z.plain('name')} as plain,
  {Z.brand_tokens(f"coalesce({Z.filled(brand)}, 'Бренд не указан')")} as bt, {Z.variants('name', 'merge')} as vr, {Z.name_tokens('name')} as w, {Z.percentages("coalesce(name, '')")} as pct, {Z.counts("coalesce(name, '')")} as cnt,
  {Z.packages("coalesce(name, '')", 'merge')} as pk, {Z.markers("coalesce(name, '')")} as num, {Z.family('unit')} as family, {Z.base('package_value', 'unit')} as base, name, {brand} as brand, barcode, package_value, package_unit, image_url, keywords"""  # noqa: E731
_GUARD = f"not ({' or '.join(Z.clash(f'o.{c}', f'r.{c}') for c in ('pct', 'cnt', 'pk', 'num'))}) and {Z.without('o.vr', 'o.bt')} = {Z.without('r.vr', 'o.bt')} and coalesce({Z.compatible('o', 'r')}, true) and coalesce(o.code = r.code, true)"
_MATCHED = f"""o as (select {_SHAPE('id', 'brand')}, subtype from (select p.*, b.name as brand, {Z.unit('package_unit')} as unit from products p left join brands b on b.id = p.brand_id where p.is_active)),
  i as (select rec_id, name, brand_name, barcode, package_value, package_unit, image_url, keywords from prepared_products union all
    select -p.id, p.name, b.name, p.barcode, p.package_value, p.package_unit, p.image_url, p.keywords from products p left join brands b on b.id = p.brand_id where not p.is_active),
  r as (select {_SHAPE('rec_id', 'brand_name')} from (select *, {Z.unit('package_unit')} as unit from i)),
  s2 as (select r.rec_id, min(o.id) as product_id, 2 as stage from r join o on o.code = r.code group by r.rec_id),
  rest as (select * from r where rec_id not in (select rec_id from s2)),
  s3 as (select r.rec_id, min(o.id), 3 from rest r join o on o.b = r.b and o.n = r.n where r.n <> '' and {_GUARD} group by r.rec_id having count(*) = 1),
  c4 as (select r.rec_id, o.id, {Z.overlap('o.w', 'r.w')}, {Z.compatible('o', 'r')} as fits from rest r join o on o.b = r.b where not r.nobrand and len(r.w) >= 2 and {_GUARD}),
  d4 as (select rec_id, id, least(coverage * 0.65 + jaccard * 0.35 + case when fits then 0.08 else 0 end, 1.0) as score from c4 where common >= 2 and coverage >= 0.8 and jaccard >= 0.55),
  k4 as (select *, row_number() over w as k, lead(score) over w as nxt from d4 window w as (partition by rec_id order by score desc, id)),
  s4 as (select rec_id, id, 4 from k4 where k = 1 and score >= 0.78 and (nxt is null or score - nxt >= 0.12)),
  s5 as (select r.rec_id, min(o.id), 5 from rest r join o on o.n = r.n where r.n <> '' and not r.plain and (o.nobrand or r.nobrand or o.b = r.b) and {_GUARD} group by r.rec_id having count(*) = 1),
  x as (select rec_id, product_id, stage from (select *, row_number() over (partition by rec_id order by stage) as q from (select * from s2 union all select * from s3 union all select * from s4 union all select * from s5)) where q = 1)"""

_GAINS = f"""({Z.plain('o.name')} or len(list_intersect({Z.text_tokens('o.name')}, {Z.text_tokens('r.name')})) / len(list_distinct(list_concat({Z.text_tokens('o.name')}, {Z.text_tokens('r.name')}))) >= 0.2) and {Z.name_quality('r.name')} >= {Z.name_quality('o.name')} + 15"""
_TAKES = f"""case when {Z.filled('r.name')} is null then false when {Z.filled('o.name')} is null then true when {S.norm('o.name')} = {S.norm('r.name')} then false else ({Z.plain('o.name')} and not {Z.plain('r.name')}) or ({_GAINS}) end"""
_PIECES = lambda c: f"case when len(list_filter(string_split(replace({c}, ';', ','), ','), lambda v: trim(v) <> '')) = 1 then [{S.squeeze(c)}] else list_filter(list_transform(string_split(replace({S.squeeze(c)}, ';', ','), ','), lambda v: trim(v)), lambda v: v <> '') end"
_PARTS = f"list_filter(list_concat({_PIECES('o.keywords')}, {_PIECES('r.keywords')}), lambda v: {S.norm('v')} <> '')"
_KEYWORDS = f"""case when {Z.filled('o.keywords')} is not null and {Z.filled('r.keywords')} is not null then nullif(array_to_string(list_filter({_PARTS}, lambda v, i: list_position(list_transform({_PARTS}, lambda u: {S.norm('u')}), {S.norm('v')}) = i), ', '), '')
  else coalesce({Z.filled('o.keywords')}, {Z.filled('r.keywords')}, o.keywords) end"""
_TAIL = f"""m as (select o.id as product_id, o.subtype, o.name as n0, o.brand as b0, o.barcode as c0, o.package_value as v0, o.package_unit as u0, o.image_url as i0, o.keywords as k0, case when {_TAKES} then {S.squeeze('r.name')} else o.name end as name,
    case when o.nobrand and not r.nobrand then r.brand else o.brand end as brand, case when o.code is null and r.code is not null then r.code else o.barcode end as barcode,
    case when coalesce({Z.compatible('o', 'r')}, true) and o.package_value is null and r.package_value > 0 then r.package_value else o.package_value end as package_value,
    case when coalesce({Z.compatible('o', 'r')}, true) and coalesce(o.package_unit, '') = '' and {Z.unit('r.package_unit')} is not null then {Z.unit('r.package_unit')} else o.package_unit end as package_unit,
    case when {Z.filled('r.image_url')} is not null and ({Z.filled('o.image_url')} is null or {Z.image_quality('r.image_url')} >= {Z.image_quality('o.image_url')} + 20) then {S.squeeze('r.image_url')} else o.image_url end as image_url, {_KEYWORDS} as keywords,
    concat_ws(',', case when o.code <> r.code then 'barcode_conflict' end, case when not {Z.compatible('o', 'r')} then 'package_conflict' end, case when not o.nobrand and not r.nobrand and {S.norm('o.brand')} <> {S.norm('r.brand')} then 'brand_conflict' end) as conflicts
    from y join o on o.id = y.product_id join r on r.rec_id = y.rec_id)
  select product_id, name, brand, barcode, package_value, package_unit, image_url, keywords, conflicts,
    array_to_string(list_filter([{', '.join(S.norm(c if c != 'package_value' else 'cast(package_value as varchar)') for c in ('name', 'brand', 'subtype', 'keywords', 'package_value', 'package_unit', 'barcode'))}], lambda v: v is not null and v <> ''), ' ') as search_text,
    concat_ws(',', case when name is distinct from n0 then 'name' end, case when brand is distinct from b0 then 'brand' end, case when barcode is distinct from c0 then 'barcode' end, case when package_value is distinct from v0 then 'package_value' end,
      case when package_unit is distinct from u0 then 'package_unit' end, case when image_url is distinct from i0 then 'image_url' end, case when keywords is distinct from k0 then 'keywords' end) as changed from m"""
_MERGED = f"with {_MATCHED}, y as (select product_id, min(rec_id) as rec_id from x group by product_id), {_TAIL}"
_ALL = f"(select p.*, b.name as brand, p.id as rec_id, b.name as brand_name, {Z.unit('package_unit')} as unit from products p left join brands b on b.id = p.brand_id)"
_JOINED = f"""with o as (select {_SHAPE('id', 'brand')}, subtype from {_ALL}), r as (select {_SHAPE('rec_id', 'brand_name')}, subtype as subtype_2 from {_ALL}),
  y as (select least(left_id, right_id) as product_id, min(greatest(left_id, right_id)) as rec_id from duplicate_candidates where left_id <> right_id and classification = 'AUTO_SAFE' group by 1), {_TAIL}"""

QUERIES = {"match_cascade": match_cascade, "merged_cards": merged_cards, "consolidated_cards": consolidated_cards, "created_records": created_records, "new_brands": new_brands, "linked_sources": linked_sources}
SQL = {
    "match_cascade": f"with {_MATCHED} select rec_id, product_id, stage, ['source_link', 'barcode', 'brand_and_name', 'brand_and_similar_name', 'name'][stage] as match_type from x",
    "merged_cards": _MERGED,
    "consolidated_cards": f"select * exclude (conflicts, search_text) from ({_JOINED})",
    "created_records": f"""with {_MATCHED} select rec_id as id, concat_ws(',', 'name', 'brand', 'category', case when trim(barcode) <> '' then 'barcode' end, case when package_value is not null then 'package_value' end, case when trim(package_unit) <> '' then 'package_unit' end,
      case when trim(image_url) <> '' then 'image_url' end, case when trim(keywords) <> '' then 'keywords' end) as fields from i where rec_id not in (select rec_id from x) and trim(name) <> ''""",
    "new_brands": f"""with f as (select {S.squeeze('brand_name')} as name, {S.norm('brand_name')} as normalized_name from prepared_products), k as (select {S.norm('name')} as n from brands)
      select min(name) as name, normalized_name from f where normalized_name <> '' and normalized_name not in (select n from k where n is not null) group by normalized_name""",
    "linked_sources": f"""with r as (select id, product_id, {S.squeeze('provider')} as provider, {S.squeeze('source_id')} as source_id, {Z.filled('source_url')} as url, source_url from product_sources),
      g as (select provider, source_id, arg_min(product_id, id) as owner, arg_min(coalesce(source_url, chr(1)), id) as first_url from (select *, trim(provider) as tp from r) group by provider, source_id),
      h as (select *, owner % 2 = 0 as had, case when owner % 2 = 0 then nullif(first_url, chr(1)) end as u from g),
      j as (select h.provider, h.source_id, owner, had, u, arg_max(r.url, r.id) filter (r.product_id = owner and r.url is not null) as url, bool_or(r.product_id <> owner) as other from h join r using (provider, source_id) group by all)
      select provider, source_id, owner as product_id, coalesce(url, u) as source_url, case when not had then 'inserted' when url is not null and url is distinct from u then 'updated' when other then 'conflict' else 'kept' end as status from j""",
}
