"""Queries of families, facets, intents, entity resolution and consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import families as A
from larder.operators import resolution as R
from larder.operators import search as Q
from larder.plans import identity_sql as Z
from larder.plans import sqltext as S
from larder.plans.search_queries import RATINGS_SQL, ratings, strict_sql
from larder.runtime import small_broadcast, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _listings(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    brands = table(spark, folder, "brands", "id", "name").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    columns = ["id", "name", "brand_id", "category_id", "barcode", "package_value", "package_unit", "subtype", *extra]
    return table(spark, folder, "products", *columns).join(small_broadcast(brands), "brand_id", "left")


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Listings with brand, category name and source links, as resolution reads them; the tables name no category but by number."""
    links = table(spark, folder, "product_sources", "product_id", "provider", "source_id").groupBy("product_id").agg(F.collect_list(F.struct("provider", "source_id")).alias("links"))  # the links of one listing
    listed = _listings(spark, folder, "image_url", "keywords").withColumn("category", F.concat(F.lit("категория "), F.col("category_id")))
    return listed.join(links.withColumnRenamed("product_id", "id"), "id", "left")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored candidate pair once, the smaller id left."""
    pairs = table(spark, folder, "duplicate_candidates", "left_id", "right_id").filter("left_id is not null and right_id is not null and left_id <> right_id")
    return pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()


_DROP = S.in_list([*A.MARKETING, *A.PACKAGING, *A.TECHNICAL])
_FAMILY = f"""with s as (select p.id, p.category_id, {S.norm('p.name')} as n, {S.norm('b.name')} as b, {Z.brandless('b.name')} as raw, coalesce({S.norm('p.subtype')}, '') as st from products p left join brands b on b.id = p.brand_id),
  c as (select id, category_id, st, case when b is null or b = '' or raw then n else trim(regexp_replace(replace(' ' || n || ' ', ' ' || b || ' ', ' '), ' +', ' ', 'g')) end as n from s),
  w as (select id, category_id, list_filter(list_concat(string_split(n, ' '), string_split(st, ' ')), lambda x: x <> '' and not regexp_matches(x, '^[0-9]+$') and x not in {_DROP}) as w from c),
  f as (select id, category_id, nullif(array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5), ' '), '') as family from w)"""


@query(_FAMILY + " select id, family, min(id) over (partition by family, category_id) as family_id from f where family is not null")
def family_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Family name and id of each listing (2.10.1-2.10.7, 2.10.11, 2.10.12, 2.1.35)."""
    return A.assign_families(_listings(spark, folder))


_BOUND = lambda p: f"(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])"
_SOURCE = S.norm("replace(concat_ws(' ', p.name, p.subtype, p.keywords), ' ', '  ')")
_FAMILY_RULES = " ".join(
    "when " + " and ".join([*([f"contains(t, '{must}')"] if must else []), *([f"({' or '.join(f'contains(t, {chr(39)}{x}{chr(39)})' for x in parts)})"] if parts else []), *([f"not contains(t, '{never}')"] if never else [])]) + f" then '{name}'"
    for name, must, parts, never in A.CANONICAL
)


def _without_phrases(x: str) -> str:
    x = f"replace({x}, ' ', '  ')"
    for p in A.FAMILY_PHRASES:
        x = f"regexp_replace({x}, '{_BOUND(p.replace(' ', ' +'))}', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


@query(
    _FAMILY + f""", t as (select p.id, {_without_phrases(S.norm("concat_ws(' ', p.name, p.subtype, p.keywords)"))} as t from products p), k as (select id, case {_FAMILY_RULES} end as c from t),
    g as (select f.id, f.category_id, coalesce({S.norm('k.c')}, f.family) as family, k.c is not null as canonical from f join k using (id))
    select id, family, min(id) over (partition by family, category_id) as family_id, canonical from g where family is not null"""
)
def canonical_families(spark: SparkSession, folder: str) -> DataFrame:
    """Families by canonical rules, else by the name (2.10.1, 2.10.2, 2.10.8-2.10.14)."""
    return A.named_families(_listings(spark, folder, "keywords"))


@query(_FAMILY + " select family, category_id, count(*) as products, min(id) as family_id from f where family is not null group by family, category_id having count(*) > 1")
def family_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Families of more than one listing (2.3.4, 2.4.9)."""
    found = A.assign_families(_listings(spark, folder))
    met = found.join(table(spark, folder, "products", "id", "category_id"), "id")
    return met.groupBy("family", "category_id").agg(F.count(F.lit(1)).alias("products"), F.min("id").alias("family_id")).filter("products > 1")


FACET_QUERIES = [(0, "молоко"), (1, "кофе"), (2, "сельдь"), (3, "молоко топлёное"), (4, "milk 3,2%"), (5, "сыр"), (6, "coffee")]
_FACET_ASKED = "(values " + ", ".join(f"({i}, '{q}')" for i, q in FACET_QUERIES) + ") as asked(query_id, query)"
_PARTS = lambda f: "concat_ws(' ', " + ", ".join(f"nullif({f(c)}, '')" for c in ("p.name", "p.normalized_name", "p.subtype", "p.keywords", "p.search_text", "b.name")) + ")"
_RAW = lambda c: f"replace(lower({S.squeeze(c)}), 'ё', 'е')"
_FACET_VALUES = ", ".join(f"('{k}', '{f}', {p}, '{o}', '{t}', '{m}', {list(dict.fromkeys([A._plain(m), *ws]))!r}, {ws!r})" for k, f, p, o, t, m, ws in A.FACETS)
_HOLDS = lambda text, terms: f"len(list_filter({terms}, lambda t: case when contains(t, ' ') then contains({text}, t) else list_contains(string_split({text}, ' '), t) end)) > 0"
_USEFUL = "case when n < 2 or n / candidates >= 0.96 then 0.0 else greatest(1 - abs(n / candidates - 0.35), 0) * 0.45 + least(n / 12.0, 1) * 0.25 + (1 - n / candidates) * 0.30 end"
_FACETS_SQL = f"""with hits as ({strict_sql(_FACET_ASKED, 200)}), o(kind, facet, priority, option, title, term, mine, terms) as (values {_FACET_VALUES}),
  h as (select asked.query_id, asked.query, {S.norm('asked.query')} as q, {_PARTS(S.norm)} as text, {_PARTS(_RAW)} as raw from hits join {_FACET_ASKED} using (query_id) join products p on p.id = hits.id left join brands b on b.id = p.brand_id),
  k as (select *, case when {_HOLDS('q', "['молоко', 'milk']")} then 'молоко' when {_HOLDS('q', "['кофе', 'coffee', 'кофейный']")} then 'кофе' when {_HOLDS('q', "['сельдь', 'селедка', 'herring']")} then 'сельдь' end as kind from h),
  c as (select query_id, count(*) as candidates from k where kind is not null group by 1),
  d as (select k.query_id, k.query, o.facet, o.priority, o.option, o.title, o.term, count(*) as n from k join o using (kind) where not ({_HOLDS('q', 'mine')}) and {_HOLDS('text', 'terms')} group by all),
  g as (select query_id, query, unnest(list_distinct(list_transform(regexp_extract_all(raw, '(?:^|[^0-9])([0-9]{{1,2}}(?:[.,][0-9]{{1,2}})?)\\s*%', 1), lambda v: cast(replace(v, ',', '.') as double)))) as v from k where kind = 'молоко' and not regexp_matches(query, '[0-9]\\s*%')),
  w as (select query_id, query, regexp_replace(cast(cast(v as decimal(9, 4)) as varchar), '\\.?0+$', '') as v from g where v between 0 and 20),
  x as (select query_id, query, 'fat_percent' as facet, 15 as priority, 'fat_' || replace(v, '.', '_') as option, replace(v, '.', ',') || '%' as title, replace(v, '.', ',') || '%' as term, count(*) as n from w group by all),
  u as (select *, {_USEFUL} as usefulness from (select * from d union all select * from x) join c using (query_id)),
  r as (select *, row_number() over (partition by query_id, facet order by usefulness desc, n desc, case when facet = 'fat_percent' then abs(cast(replace(replace(title, ',', '.'), '%', '') as double) - 3.2) end, title desc) as place from u where usefulness > 0),
  f as (select *, count(*) over (partition by query_id, facet) as k from r where place <= 5)
  select query_id, facet, priority, option, title, case when contains(replace(lower(query), 'ё', 'е'), replace(lower(term), 'ё', 'е')) then query else query || ' ' || term end as refined, n, candidates, round(usefulness, 6) as usefulness, cast(place as integer) as place from f where k >= 2"""


def _facets(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame(FACET_QUERIES, "query_id int, query string")
    hits = Q.strict_search(asked, Q.catalogue(table(spark, folder, "products"), table(spark, folder, "brands", "id", "name", "aliases")), limit=200)
    texts = A.facet_texts(_listings(spark, folder, "normalized_name", "keywords", "search_text"))
    return A.facet_options(hits.join(F.broadcast(asked), "query_id").join(texts, "id").select("query_id", "query", "text", "raw"))


@query(_FACETS_SQL)
def facet_options(spark: SparkSession, folder: str) -> DataFrame:
    """The options of each facet among the up to 200 hits of each query, percentages included (2.4.10, 2.4.11, 2.9.1-2.9.11, 2.9.13, 2.9.14, 2.8.108)."""
    return _facets(spark, folder).withColumn("usefulness", F.round("usefulness", 6))


@query(
    f"with y as ({_FACETS_SQL}), z as (select query_id, facet, avg(usefulness) as a, sum(n) as t, min(priority) as p from y group by all), q as (select *, row_number() over (partition by query_id order by p, a desc, t desc, facet) as k from z) select y.* from y join q using (query_id, facet) where q.k = 1"
)
def next_facet(spark: SparkSession, folder: str) -> DataFrame:
    """The one facet of each query to offer next (2.4.14, 2.4.15, 2.6.9)."""
    return A.next_group(_facets(spark, folder)).withColumn("usefulness", F.round("usefulness", 6)).select("query_id", "facet", "priority", "option", "title", "refined", "n", "candidates", "usefulness", "place")


_INTENT_QUERIES = ["молоко", "сыр", "йогурт", "шоколад"]


@query(
    f"""with q(query_id, query) as (values {", ".join(f"({i}, '{q}')" for i, q in enumerate(_INTENT_QUERIES))}),
    h as (select query_id, list_filter(list_distinct(string_split({S.norm('name')}, ' ')), lambda x: false) as z, string_split({S.norm('name')}, ' ') as w, query from q, products where list_contains(string_split({S.norm('name')}, ' '), query)),
    d as (select query_id, list_filter(w, lambda x, i: list_position(w, x) = i and x <> query and length(x) >= 3 and not regexp_matches(x, '^[0-9]+$') and x not in {S.in_list(A.INTENT_STOP)}) as w from h),
    n as (select query_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) as phrase from d),
    c as (select query_id, phrase, count(*) as n from n group by query_id, phrase having count(*) >= 2)
    select query_id, phrase, n from (select *, row_number() over (partition by query_id order by n desc, phrase) as k from c) where k <= 8"""
)
def intent_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """The eight most frequent one- and two-word phrases among the hits of each query (2.4.12, 2.10.15, 2.10.16)."""
    asked = spark.createDataFrame(list(enumerate(_INTENT_QUERIES)), "query_id int, query string")
    texts = table(spark, folder, "products", "name").select(T.normalize_text(F.col("name")).alias("text")).withColumn("word", F.explode(F.array_distinct(F.split("text", " "))))
    hits = texts.join(F.broadcast(asked), F.col("word") == F.col("query")).select("query_id", "query", "text")
    return A.intents(hits)


@query()
def readable_intents(spark: SparkSession, folder: str) -> DataFrame:
    """The intents of each query under readable titles, one of those that mean the same (2.10.17-2.10.26); its rules are tested one by one."""
    asked = spark.createDataFrame(list(enumerate(_INTENT_QUERIES)), "query_id int, query string")
    return A.human_intents(intent_ngrams(spark, folder).join(F.broadcast(asked), "query_id"))


_PAIRS = """select distinct least(left_id, right_id) as left_id, greatest(left_id, right_id) as right_id from duplicate_candidates where left_id is not null and right_id is not null and left_id <> right_id"""
_BASE = "y as (select id, nb, bucket, n, code is not null as coded, w from f where not nobrand and bucket is not null and bucket <> '')"
_EXACT = "ex as (select g.left_id, y.id as right_id from y join (select nb, bucket, n, min(id) as left_id from y where n <> '' group by all) g using (nb, bucket, n) where y.id > g.left_id)"
_UNITED = "select left_id, right_id, max(common) as common, max(same) = 1 as same_name from (select left_id, right_id, common, 0 as same from sh union all select left_id, right_id, 0, 1 from ex) group by all"
_TOKENS = f"""{Z.LISTINGS}, {_BASE}, x as (select id, nb, bucket, coded, unnest(w) as word from y), z as (select nb, bucket, word from x group by all having count(*) between 2 and 50), sm as (select x.* from x join z using (nb, bucket, word)),
  st as (select a.id as left_id, b.id as right_id, count(*) as common, bool_or(a.coded <> b.coded) as one from sm a join sm b using (nb, bucket, word) where a.id < b.id group by all),
  sh as (select left_id, right_id, common from st where common >= 2 or one), {_EXACT}, pairs as ({_UNITED})"""


@query(f"with {_TOKENS} select left_id, right_id, common, same_name from pairs")
def blocking_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate pairs within brand and category by the rule of words in blocks of up to 50 listings (2.3.7)."""
    return R.blocking_pairs(_catalogue(spark, folder))


@query(
    f"""with {Z.LISTINGS}, {_BASE}, c as (select nb, bucket, list_sort(w) as w, min(id) as rep, bool_or(coded) as some, bool_and(coded) as every from y where len(w) > 0 group by all),
    o as (select a.rep as left_id, b.rep as right_id, {Z.overlap('a.w', 'b.w')}, not ((a.every and b.every) or (not a.some and not b.some)) as one from c a join c b using (nb, bucket) where a.rep < b.rep),
    sh as (select left_id, right_id, common from o where coverage >= 0.70 and (common >= 2 or one) union all select c.rep, y.id, len(y.w) from y join c on c.nb = y.nb and c.bucket = y.bucket and c.w = list_sort(y.w) where y.id > c.rep),
    {_EXACT} select left_id, right_id, common, same_name from ({_UNITED})"""
)
def blocking_pairs_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate pairs without a bound on blocks: all that a similarity rule can accept, between classes of equal words (2.3.7)."""
    return R.blocking_pairs(_catalogue(spark, folder), most=None)


@query(
    f"with {Z.LISTINGS}, pairs as ({_PAIRS}), {Z.COMPARED} select left_id, right_id, fits as package_compatible, cast(common as integer) as common_count, coverage, jaccard, same_name, same_code, other_code as different_codes, one_code, pct as pct_conflict, cnt as cnt_conflict, pk as pk_conflict from m"
)
def pair_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What the decisions compare, for every stored candidate pair (2.7.1-2.7.3, 2.12.1, 2.3.3)."""
    found = R.evidence(_stored(spark, folder), R.features(_catalogue(spark, folder)))
    return found.select("left_id", "right_id", "package_compatible", "common_count", "coverage", "jaccard", "same_name", "same_code", "different_codes", "one_code", "pct_conflict", "cnt_conflict", "pk_conflict")


@query(f"with {_TOKENS}, {Z.COMPARED}, {Z.SCANNED} select left_id, right_id, x.c as classification, x.w as reason, cast(x.s as double) as score, hard, soft from r")
def pair_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class, reason, score, conflicts and differences of every blocked pair by the scanner's rules (2.12.1, 2.12.2, 2.12.5)."""
    found = R.scan(blocking_pairs(spark, folder).select("left_id", "right_id"), R.features(_catalogue(spark, folder)))
    return found.select("left_id", "right_id", "classification", "reason", "score", F.array_join("hard_conflicts", ",").alias("hard"), F.array_join("soft_differences", ",").alias("soft"))


@query(f"with {_TOKENS}, {Z.COMPARED}, {Z.SCANNED} select x.c as classification, x.w as reason, count(*) as n from r group by all")
def reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many blocked pairs each class and reason has (2.4.13)."""
    return pair_classes(spark, folder).groupBy("classification", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_TOKENS}, {Z.COMPARED}, {Z.SCANNED}, q as (select id, package_value, package_unit, links from l) select r.left_id, r.right_id, x.c as classification, a.brand as left_brand, b.brand as right_brand, a.category as left_category, a.name as left_name, b.name as right_name, a.code as left_barcode, b.code as right_barcode,
      case when c.package_value is not null then cast(c.package_value as varchar) || coalesce(c.package_unit, '') end as left_package, cast(len(d.links) as integer) as right_sources, array_to_string(a.pct, ',') as left_percentages, array_to_string(b.cnt, ',') as right_counts,
      array_to_string(a.pk, ',') as left_name_packages, array_to_string(a.v, ',') as left_variant_tokens, array_to_string({Z.without('a.v', 'b.v')}, ',') as left_only_variants, array_to_string({Z.without('b.v', 'a.v')}, ',') as right_only_variants
    from r join f a on a.id = r.left_id join f b on b.id = r.right_id join q c on c.id = r.left_id join q d on d.id = r.right_id where x.c <> 'REJECT'"""
)
def candidate_records(spark: SparkSession, folder: str) -> DataFrame:
    """The scanner's records of the pairs it does not reject, lists as text (2.12.6, 2.1.31)."""
    found = R.scan(blocking_pairs(spark, folder).select("left_id", "right_id"), R.features(_catalogue(spark, folder))).filter("classification <> 'REJECT'")
    plain = ["left_id", "right_id", "classification", "left_brand", "right_brand", "left_category", "left_name", "right_name", "left_barcode", "right_barcode", "left_package", "right_sources"]
    lists = ["left_percentages", "right_counts", "left_name_packages", "left_variant_tokens", "left_only_variants", "right_only_variants"]
    return found.select(*plain, *[F.array_join(c, ",").alias(c) for c in lists])


@query(
    f"""with {Z.LISTINGS}, pairs as ({_PAIRS}), {Z.COMPARED}, {Z.VERIFIED}, {Z.SCORED} select v.left_id, v.right_id, x.c as classification, x.w as reason, cast(x.s as double) as confidence, positive as positive_evidence, negative as negative_evidence,
      case when x.c = 'CONFIRMED_SAME_SKU' then {Z.CHOSEN} end as canonical_product_id from v join s a on a.id = v.left_id join s b on b.id = v.right_id"""
)
def verified_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The verifier's decision on every stored candidate pair with its evidence and the surviving listing (2.12.7, 2.12.8, 2.12.12-2.12.16, 2.12.47)."""
    listings = _catalogue(spark, folder)
    found = R.verify(_stored(spark, folder), R.features(listings), R.completeness(listings))
    return found.withColumn("positive_evidence", F.array_join("positive_evidence", ",")).withColumn("negative_evidence", F.array_join("negative_evidence", ","))


@query(f"with {Z.LISTINGS}, pairs as ({_PAIRS}), {Z.COMPARED}, {Z.VERIFIED} select x.c as classification, x.w as reason, count(*) as n from v group by all")
def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many stored pairs each verdict and reason has (2.1.32)."""
    return verified_pairs(spark, folder).groupBy("classification", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with d as (select distinct least(left_id, right_id) as left_id, greatest(left_id, right_id) as right_id from duplicate_candidates where left_id is not null and right_id is not null and left_id <> right_id) select left_id, right_id from d where not exists (select 1 from products p where p.id = left_id and p.is_active) or not exists (select 1 from products p where p.id = right_id and p.is_active)"
)
def missing_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pairs of which a side is no active listing (2.12.16)."""
    active = table(spark, folder, "products", "id", "is_active").filter("is_active").select("id")
    pairs = _stored(spark, folder)
    side = lambda key: pairs.join(active.select(F.col("id").alias(key)), key, "left_anti").select("left_id", "right_id")
    return side("left_id").unionByName(side("right_id")).distinct()


@query(
    f"""with {Z.LISTINGS}, pairs as ({_PAIRS}), {Z.COMPARED} select left_id as canonical_id, right_id as duplicate_id, concat_ws(',', case when other_code then 'barcode_conflict' end, case when not fits then 'package_conflict' end, case when other_brand then 'brand_conflict' end,
      case when other_category then 'category_conflict' end, case when common < 2 or coverage < 0.75 or jaccard < 0.45 then 'name_similarity_too_weak' end) as blocked, case when fits is null then 'package_not_confirmed' else '' end as conflicts from m"""
)
def consolidation_safety(spark: SparkSession, folder: str) -> DataFrame:
    """Why each stored pair must not be merged into its smaller id, and what is unsure (2.12.33, 2.12.34)."""
    pairs = _stored(spark, folder).select(F.col("left_id").alias("canonical_id"), F.col("right_id").alias("duplicate_id"))
    found = R.safety(pairs, R.features(_catalogue(spark, folder)))
    return found.withColumn("blocked", F.array_join("blocked", ",")).withColumn("conflicts", F.array_join("conflicts", ","))


_BEST = """select a as left_id, b as right_id, classification, reason, score from (select least(left_id, right_id) as a, greatest(left_id, right_id) as b, classification, reason, score,
  row_number() over (partition by least(left_id, right_id), greatest(left_id, right_id) order by score desc nulls last, cand_id) as k from duplicate_candidates where left_id is not null and right_id is not null and left_id <> right_id) where k = 1"""


@query(_BEST)
def best_candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per unordered pair, the best score, first come on ties (2.1.33, 2.5.5, 2.12.4)."""
    found = R.best_pairs(table(spark, folder, "duplicate_candidates", "cand_id", "left_id", "right_id", "classification", "reason", "score"), F.col("cand_id"))
    return found.select("left_id", "right_id", "classification", "reason", "score")


@query(f"with {Z.LISTINGS}, {Z.SCORED} select id, cast(score as double) as score, coded, cast(sources as integer) as sources from s")
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    """How complete each listing is for the choice of the surviving one (2.12.10, 2.12.11)."""
    return R.completeness(_catalogue(spark, folder))


@query(f"with {Z.LISTINGS}, {Z.SCORED}, d as ({_BEST}) select d.left_id, d.right_id, {Z.CHOSEN} as canonical_id from d join s a on a.id = d.left_id join s b on b.id = d.right_id where d.classification = 'AUTO_SAFE'")
def canonical_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving listing of each safe pair (2.12.9, 2.12.14, 2.3.2)."""
    safe = best_candidate_pairs(spark, folder).filter("classification = 'AUTO_SAFE'").select("left_id", "right_id")
    return R.choose_canonical(safe, R.completeness(_catalogue(spark, folder)))


_MAP = "(select greatest(left_id, right_id) as id, min(least(left_id, right_id)) as canonical_id from duplicate_candidates where left_id is not null and right_id is not null and left_id <> right_id and classification = 'AUTO_SAFE' group by 1)"


def _id_map(spark: SparkSession, folder: str) -> DataFrame:
    safe = table(spark, folder, "duplicate_candidates", "left_id", "right_id", "classification").filter("left_id is not null and right_id is not null and left_id <> right_id and classification = 'AUTO_SAFE'")
    return safe.groupBy(F.greatest("left_id", "right_id").alias("id")).agg(F.min(F.least("left_id", "right_id")).alias("canonical_id"))


@query(f"with m as {_MAP} select coalesce(m.canonical_id, p.product_id) as product_id, count(*) as observations, sum(p.price) as total from price_observations p left join m on m.id = p.product_id group by 1")
def consolidated_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Price observations after duplicates were merged into their smallest partner: none is lost (2.12.41)."""
    moved = R.repoint(table(spark, folder, "price_observations", "product_id", "price"), _id_map(spark, folder), "product_id")
    return moved.groupBy("product_id").agg(F.count(F.lit(1)).alias("observations"), F.sum("price").cast("decimal(38,2)").alias("total"))


@query(
    f"""with m as {_MAP}, r as (select coalesce(m.canonical_id, s.product_id) as product_id, lower(trim(s.provider)) as provider, s.source_id, s.id, m.canonical_id is null as own from product_sources s left join m on m.id = s.product_id)
    select product_id, provider, source_id, id from (select *, row_number() over (partition by product_id, provider, source_id order by own desc, id) as k from r) where k = 1"""
)
def consolidated_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Source links after consolidation, each link of a product once, its own first (2.12.31, 2.12.36-2.12.40, 2.13.13)."""
    rows = table(spark, folder, "product_sources", "id", "product_id", "provider", "source_id").withColumn("provider", F.lower(F.trim("provider")))
    return R.repoint(rows, _id_map(spark, folder), "product_id", ["product_id", "provider", "source_id"], F.col("id")).select("product_id", "provider", "source_id", "id")


@query(
    f"""with m as {_MAP}, r as (select user_id, coalesce(m.canonical_id, q.product_id) as product_id, q.product_id as was, score, m.canonical_id is null as own from ({RATINGS_SQL}) q left join m on m.id = q.product_id)
    select user_id, product_id, was, score from (select *, row_number() over (partition by user_id, product_id order by own desc, was) as k from r) where k = 1"""
)
def consolidated_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings after consolidation: one of a user and product, the surviving product's own first (2.12.36, 2.12.37, 2.12.42)."""
    rows = ratings(spark, folder).withColumn("was", F.col("product_id"))
    ids = _id_map(spark, folder).select(F.col("id").cast("bigint").alias("id"), F.col("canonical_id").cast("bigint").alias("canonical_id"))
    return R.repoint(rows, ids, "product_id", ["user_id", "product_id"], F.col("was")).select("user_id", "product_id", "was", "score")


@query(
    f"""with m as {_MAP}, a as (select id as product_id, trim(unnest(string_split(keywords, ','))) as alias, 0 as n from products where keywords is not null union all select p.id, {S.squeeze('p.name')}, 1 from products p join m on m.id = p.id),
    r as (select coalesce(m.canonical_id, a.product_id) as product_id, alias, {S.norm('alias')} as normalized_alias, n, m.canonical_id is null as own from a left join m on m.id = a.product_id)
    select product_id, alias, normalized_alias from (select *, row_number() over (partition by product_id, normalized_alias order by own desc, n, alias) as k from r where normalized_alias <> '') where k = 1"""
)
def consolidated_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases (here the keywords) after consolidation, the names of merged duplicates among them, each form of a product once (2.12.38, 2.12.39)."""
    products = table(spark, folder, "products", "id", "name", "keywords")
    aliases = products.filter("keywords is not null").select(F.col("id").alias("product_id"), F.explode(F.split("keywords", ",")).alias("alias")).withColumn("alias", F.trim("alias"))
    return R.kept_aliases(aliases, products.select("id", "name"), _id_map(spark, folder))


@query(
    f"""with n as (select id, name, brand_id, package_value, package_unit, barcode, row_number() over (partition by brand_id, {S.norm('name')} order by id) as k, count(*) over (partition by brand_id, {S.norm('name')}) as c from products)
    select id, case when c = 1 then name else name || ' · ' || coalesce(right(regexp_replace(barcode, '[^0-9]', '', 'g'), 4), 'ID ' || id) end as title from n"""
)
def title_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Titles made different where several listings of a brand have one name (2.5.6, 2.8.100)."""
    from pyspark.sql.window import Window

    p = table(spark, folder, "products", "id", "name", "brand_id", "barcode").withColumn("n", T.normalize_text(F.col("name"))).withColumn("b", F.coalesce("brand_id", F.lit(-1)))
    met = p.join(p.groupBy("b", "n").agg(F.count(F.lit(1)).alias("c")), ["b", "n"])
    tail = F.coalesce(F.right(F.regexp_replace("barcode", "[^0-9]", ""), F.lit(4)), F.concat(F.lit("ID "), F.col("id")))
    return met.select("id", F.when(F.col("c") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" · "), tail)).alias("title"))
