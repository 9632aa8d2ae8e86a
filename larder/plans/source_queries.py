"""Queries of ingestion, constraints, categories and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import text as T
from larder.operators import categories as G
from larder.plans import sqltext as S
from larder.runtime import table
from larder.sources import ingest as N
from larder.sources import open_records as O
from larder.sources.schemas import broken, duplicates, orphans
from larder.streaming.state import state_as_of

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FILLED = lambda c: f"nullif({S.squeeze(c)}, '')"
_ITEMS = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda v: {S.squeeze('v')}), lambda v: v <> '')"
_UNIT_SQL = lambda x: "case " + " ".join(f"when {x} in {S.in_list(spelled)} then '{u}'" for u, spelled in N.UNIT_SPELLINGS.items()) + f" else nullif({x}, '') end"
_AMOUNT = r"([0-9]+(?:[.,][0-9]+)?) ?(кг|мл|гр|г|л|kg|ml|cl|g|l)(?:$|[^\p{L}])"
_PREPARED = f"""with r as (select *, lower(regexp_replace(quantity, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')) as q, replace(product_quantity, ',', '.') as pq from off_products),
  s as (select *, coalesce({_FILLED('product_name_ru')}, {_FILLED('product_name')}, {_FILLED('generic_name')}) as name, try_cast(nullif(replace(regexp_extract(q, '{_AMOUNT}', 1), ',', '.'), '') as decimal(12, 3)) as n,
    nullif(regexp_extract(q, '{_AMOUNT}', 2), '') as u, case when regexp_matches(pq, '^[0-9]+(?:\\.[0-9]+)?$') then cast(pq as decimal(12, 3)) end as g from r),
  p as (select rec_id, last_modified_at, trim(code) as barcode, name, coalesce({_ITEMS('brands')}[1], '{N.DEFAULT_BRAND}') as brand_name, coalesce({_ITEMS('categories')}[-1], '{N.DEFAULT_CATEGORY}') as category_name,
    cast(case when g > 0 and {_FILLED('product_quantity_unit')} is not null then g when u = 'cl' then n * 10 else n end as decimal(12, 3)) as package_value,
    case when g > 0 and {_FILLED('product_quantity_unit')} is not null then {_UNIT_SQL(f"lower({S.squeeze('product_quantity_unit')})")} else {_UNIT_SQL('u')} end as package_unit,
    case when regexp_matches(image_front_url, '^https?://') then image_front_url end as image_url from s where regexp_matches(trim(code), '^[0-9]+$') and name is not null)"""


@query(_PREPARED + " select rec_id, barcode, name, brand_name, category_name, package_value, package_unit, image_url from p")
def prepared_records(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records as catalogue records (2.1.8, 2.8.52-2.8.60)."""
    return _prepared(spark, folder).drop("last_modified_at")


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "off_products", "rec_id", "code", "product_name_ru", "product_name", "generic_name", "brands", "categories", "quantity", "product_quantity", "product_quantity_unit", "image_front_url", "last_modified_at")
    return N.prepare(raw, "rec_id", "last_modified_at")


@query("select rec_id from off_products where len(list_intersect(list_transform(coalesce(countries_tags, []), lambda t: lower(trim(t))), ['en:russia', 'ru:россия', 'en:russian-federation'])) > 0")
def country_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the country by their tags (2.1.2)."""
    return table(spark, folder, "off_products", "rec_id", "countries_tags").filter(N.of_country(F.col("countries_tags"))).select("rec_id")


@query(
    _PREPARED
    + """, k as (select *, row_number() over (partition by barcode order by last_modified_at desc nulls last, rec_id desc) as k from p)
    select barcode, rec_id, name, brand_name, image_url from k where k = 1"""
)
def latest_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each code: records sent again replace earlier ones (2.1.9, 2.5.2)."""
    order = F.struct(F.coalesce("last_modified_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "rec_id")
    best = _prepared(spark, folder).groupBy("barcode").agg(F.max_by(F.struct("rec_id", "name", "brand_name", "image_url"), order).alias("r"))
    return best.select("barcode", "r.*")


#: Rules of the mapping queries: place, rule, targets, aliases.
RULES = [
    (1, "рыба", ["рыба", "рыба и морепродукты"], ["скумбрия", "сельдь", "fish"]), (2, "хлебобулочные изделия", ["хлебобулочные", "хлеб"], ["хлеб", "батон", "bread"]), (3, "чай", ["чай"], ["tea", "teas"]), (4, "кофе", ["кофе"], ["coffee"]),
    (5, "сок", ["сок"], ["juice", "соки морсы"]), (6, "шоколад", ["шоколад"], ["плитка шоколадная", "chocolate"]), (7, "молоко", ["молоко"], ["milk", "молоко питьевое"]), (8, "нет такой", ["нигде"], ["печенье"]),
]
_RULES_SQL = "u(place, rule, targets, aliases) as (values " + ", ".join(f"({p}, '{r}', {t!r}, {a!r})" for p, r, t, a in RULES) + ")"
_MAPPED = f"""k as (select row_number() over (order by category_name) as id, {S.norm('category_name')} as n from (select distinct category_name from prepared_products where {S.norm('category_name')} <> '')), {_RULES_SQL},
  tt as (select place, rule, unnest(list_concat([rule], aliases)) as alias, generate_subscripts(list_concat([rule], aliases), 1) as spot from u), t as (select place, rule, spot, {S.norm('alias')} as n from tt),
  gg as (select rule, unnest(targets) as target, generate_subscripts(targets, 1) as t from u), mt as (select rule, arg_min(k.id, t) as cid from gg join k on k.n = {S.norm('gg.target')} group by rule),
  w0 as (select key, 0 as way, pos, value, id as cid, 'database_exact' as by from v join k using (n)),
  w1 as (select key, 1, pos, value, mt.cid, 'rule_exact:' || r.rule from v join (select n, arg_min(rule, place * 1000 + spot) as rule from t group by n) r using (n) join mt on mt.rule = r.rule),
  i2 as (select key, pos, value, rule, row_number() over (partition by key, pos order by length(t.n) desc, place, spot) as q from v, t where len(list_filter(string_split(t.n, ' '), lambda w: not list_contains(string_split(v.n, ' '), w))) = 0),
  w2 as (select key, 2, pos, value, cid, 'rule_contains:' || rule from i2 join mt using (rule) where q = 1),
  i3 as (select key, pos, value, id, row_number() over (partition by key, pos order by length(k.n) desc, id) as q from v, k where k.n not in ('продукты', 'продукт', 'еда', 'food', 'foods', 'products', 'product', 'прочее', 'другое', 'other')
    and (contains(k.n, ' ') or length(k.n) >= 3) and len(list_filter(string_split(k.n, ' '), lambda w: not list_contains(string_split(v.n, ' '), w))) = 0),
  w3 as (select key, 3, pos, value, id, 'database_contains' from i3 where q = 1),
  b as (select *, row_number() over (partition by key order by way, pos) as q from (select * from w0 union all select * from w1 union all select * from w2 union all select * from w3)), fs as (select key, arg_min(value, pos) as first_value from v group by key)
  select fs.key as {{key}}, b.cid as category_id, coalesce(b.by, 'not_found') as matched_by, case b.way when 0 then 100.0::double when 1 then 97 when 2 then 90 when 3 then 82 else 0 end as confidence, coalesce(b.value, first_value) as source_value from fs left join b on b.key = fs.key and b.q = 1"""


def _mapped(spark: SparkSession, folder: str, values: DataFrame, key: str) -> DataFrame:
    names = table(spark, folder, "prepared_products", "category_name").select(F.col("category_name").alias("name")).distinct().filter(T.normalize_text(F.col("name")) != "")
    known = names.withColumn("id", F.row_number().over(Window.orderBy("name")).cast("bigint"))  # a list of categories is small
    return G.map_categories(values, known, spark.createDataFrame(RULES, "place int, rule string, targets array<string>, aliases array<string>"), key)


@query(f"with v as (select id as key, 0 as pos, {S.squeeze('name')} as value, {S.norm('name')} as n from products where {S.norm('name')} <> ''), " + _MAPPED.replace("{key}", "product_id"))
def category_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The category each product name leads to, by which way and how surely (2.13.2-2.13.7, 2.8.49-2.8.51)."""
    named = table(spark, folder, "products", "id", "name").select(F.col("id").alias("product_id"), "name")
    return _mapped(spark, folder, G.incoming_values(named, "product_id", "name"), "product_id")


@query(
    f"""with e as (select rec_id, unnest(string_split(categories, ',')) as x, generate_subscripts(string_split(categories, ','), 1) as p from off_products), m as (select rec_id, p as pos, {S.squeeze('x')} as value, {S.norm('x')} as n from e where {S.norm('x')} <> ''),
    v as (select rec_id as key, pos, value, n from (select *, row_number() over (partition by rec_id, n order by pos) as q from m) where q = 1), """
    + _MAPPED.replace("{key}", "rec_id")
)
def record_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The known category of each record by its list of categories (2.13.1, 2.13.31, 2.7.8)."""
    records = table(spark, folder, "off_products", "rec_id", "categories").select("rec_id", F.lit(None).cast("string").alias("own"), F.split("categories", ",").alias("others"))
    return _mapped(spark, folder, G.incoming_values(records, "rec_id", "own", "others"), "rec_id")


_SPLIT = f"list_filter(list_transform(regexp_split_to_array(coalesce(brands, ''), '[,;/|]'), lambda v: {S.squeeze('v')}), lambda v: replace(lower(v), 'ё', 'е') not in ('', 'unknown', 'no brand', 'без бренда', 'бренд не указан', 'не указан'))"
_FOLD = lambda x: f"replace(lower(coalesce({S.squeeze(x)}, '')), 'ё', 'е')"
_ONCE = lambda xs: f"list_filter({xs}, lambda v, i: {_FOLD('v')} <> '' and list_position(list_transform({xs}, lambda u: {_FOLD('u')}), {_FOLD('v')}) = i)"
_PLAIN = "('кофе', 'coffee', 'молоко', 'milk', 'пицца', 'pizza', 'чай', 'tea', 'вода', 'water', 'сыр', 'cheese', 'масло', 'butter', 'йогурт', 'yogurt', 'yoghurt', 'кефир', 'kefir', 'сельдь', 'herring', 'продукт', 'product')"
_KIND = """case when contains(ct, 'coffee') or contains(ct, 'кофе') then 'Кофе' when contains(ct, 'milk') or contains(ct, 'молоко') then 'Молоко' when contains(ct, 'pizza') or contains(ct, 'пицца') then 'Пицца' when contains(ct, 'tea') or contains(ct, 'чай') then 'Чай'
  when contains(ct, 'herring') or contains(ct, 'сельдь') or contains(ct, 'селед') then 'Сельдь' when contains(ct, 'cheese') or contains(ct, 'сыр') then 'Сыр' when contains(ct, 'yogurt') or contains(ct, 'yoghurt') or contains(ct, 'йогурт') then 'Йогурт' end"""
_HUMAN = lambda x: f"(upper(left({x}, 1)) || substr({x}, 2))"
_BARE = lambda x: S.squeeze(f"replace(regexp_replace({S.squeeze(x)}, '^[^:]{{0,3}}:(.)', '\\1'), '-', ' ')")


@query(
    f"""with a as (select rec_id, {_SPLIT}[1] as brand, {_ONCE("list_transform([product_name_ru, product_name, generic_name], lambda v: coalesce(" + S.squeeze('v') + ", ''))")} as names, generic_name,
      list_filter(list_transform(string_split(coalesce(categories, ''), ','), lambda v: {S.squeeze('v')}), lambda v: v <> '') as c0, coalesce(countries_tags, []) as tags from off_products),
    b as (select *, list_filter(c0, lambda v, i: list_position(list_transform(c0, lambda u: lower(u)), lower(v)) = i) as cats, list_filter(names, lambda v: {_FOLD('v')} not in {_PLAIN}) as good from a),
    c as (select *, {_FOLD("array_to_string(cats, ' ')")} as ct, case when len(good) > 0 then list_sort(list_transform(range(1, len(good) + 1), lambda i: struct_pack(w := -len(string_split(good[i], ' ')), n := -length(good[i]), i := i, v := good[i])))[1].v else names[1] end as name from b),
    d as (select *, {_KIND} as kind from c)
    select rec_id, brand, name, kind, nullif(array_to_string({_ONCE("list_concat(list_transform(list_concat(cats, tags), lambda v: " + _HUMAN(_BARE('v')) + "), list_filter([brand, kind], lambda v: v is not null))")}, ', '), '') as keywords,
      case when {_FOLD('generic_name')} not in {_PLAIN} then nullif({S.squeeze('generic_name')}, '') end as description from d"""
)
def open_listing_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Brand, name, kind, keywords and description of each open record (2.8.62, 2.8.70, 2.8.73-2.8.77, 2.8.81, 2.8.82, 2.7.6)."""
    return O.open_listings(_open(spark, folder)).select("rec_id", "brand", "name", "kind", "keywords", "description")


@query()
def open_listing_names(spark: SparkSession, folder: str) -> DataFrame:
    """The full name and the subtype of each open record (2.8.78-2.8.80, 2.8.83); their rules are tested one by one."""
    return O.open_listings(_open(spark, folder)).select("rec_id", "full_name", "subtype")


def _open(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "off_products", "rec_id", "product_name_ru", "product_name", "generic_name", "brands", "categories", "countries_tags", "product_quantity", "product_quantity_unit")
    return raw.withColumn("amount", F.col("product_quantity").try_cast("decimal(12,3)")).withColumn("unit", F.lower(T.filled(F.col("product_quantity_unit"))))


@query(
    """select 'brand' as reference, count(*) as missing from products p where brand_id is not null and not exists (select 1 from brands b where b.id = p.brand_id)
    union all select 'source', count(*) from product_sources s where product_id is not null and not exists (select 1 from products p where p.id = s.product_id)
    union all select 'price', count(*) from price_observations s where product_id is not null and not exists (select 1 from products p where p.id = s.product_id)
    union all select 'card', count(*) from card_states s where product_id is not null and not exists (select 1 from products p where p.id = s.product_id)"""
)
def fk_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each reference that point nowhere (constraints of 1.2)."""
    products = table(spark, folder, "products", "id", "brand_id")
    count = lambda df, name: df.agg(F.lit(name).alias("reference"), F.count(F.lit(1)).alias("missing"))
    out = count(orphans(products, "brand_id", table(spark, folder, "brands", "id"), "id"), "brand")
    for name, source in (("source", "product_sources"), ("price", "price_observations"), ("card", "card_states")):
        out = out.unionByName(count(orphans(table(spark, folder, source, "product_id"), "product_id", products, "id"), name))
    return out


@query("select lower(trim(provider)) as provider, source_id, count(*) as n from product_sources group by 1, 2 having count(*) > 1")
def source_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Source links that were sent more than once (UNIQUE provider, source_id)."""
    return duplicates(table(spark, folder, "product_sources", "provider", "source_id").select(F.lower(F.trim("provider")).alias("provider"), "source_id"), "provider", "source_id")


@query("select 'price_positive' as \"check\", count(*) filter (price is null or price <= 0) as n from price_observations union all select 'region_known', count(*) filter (region is null) from price_observations union all select 'retailer_known', count(*) filter (retailer_name is null) from price_observations")
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break a check, by check, from one scan (CHECK constraints of 1.2)."""
    prices = table(spark, folder, "price_observations", "price", "region", "retailer_name")
    return broken(prices, price_positive="price > 0", region_known="region is not null", retailer_known="retailer_name is not null")


_NOW = "2024-01-15 12:00:00"


@query(
    f"""with l as (select user_id, event_type, props, ts, row_number() over (partition by user_id order by ts desc, props desc) as k from events where ts <= timestamp '{_NOW}')
    select user_id, props as payload from l where k = 1 and event_type <> 'error' and epoch(timestamp '{_NOW}') - floor(epoch(ts)) <= 90000"""
)
def ttl_state_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each user at a moment: the last event unless it clears it or is too old (2.15.1-2.15.4)."""
    events = table(spark, folder, "events", "user_id", "ts", "event_type", "props").withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withColumn("action", F.when(F.col("event_type") == "error", "clear").otherwise("save"))
    return state_as_of(marked, "user_id", "ts", "action", "props", _NOW, ttl=90_000)


@query("select event_type, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint)) as total from events group by event_type")
def event_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Semi-structured payloads read by schema and summed by kind."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, folder, "events", "event_type", "props").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))
