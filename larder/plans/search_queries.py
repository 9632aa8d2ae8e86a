"""Queries of search, ratings and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import text as T
from larder.functions import trigram as G
from larder.operators import ratings as R
from larder.operators import search as Q
from larder.plans import identity_sql as Z
from larder.plans import sqltext as S
from larder.runtime import table

QUERIES, SQL = {}, {}
#: Queries that the search queries run, as a table.
ASKED = [(1, "молоко топлёное"), (2, "сыр копчёный"), (3, "Остамир"), (4, "сок томатный 50"), (5, "йогурт вишнёвый утренняя"), (6, "рудольешка"), (7, "шоколад горький"), (8, "хлеб")]
_ASKED_SQL = "(values " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") as asked(query_id, query)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return Q.catalogue(table(spark, folder, "products"), table(spark, folder, "brands", "id", "name", "aliases"))


def _n(x: str) -> str:
    return f"coalesce({S.norm(x)}, '')"


_CATALOGUE = f"""select p.id, p.name, b.name as brand, p.barcode, p.image_url, p.package_value, p.package_unit, {_n('p.name')} as n_name, {_n('b.name')} as n_brand, {_n('b.aliases')} as n_aliases,
  {_n('p.subtype')} as n_subtype, {_n('p.keywords')} as n_keywords, {_n('p.search_text')} as n_search from products p left join brands b on b.id = p.brand_id where p.is_active"""
_ORDER = f"""case when {Z.brandless('brand')} then 1 else 0 end, case when length(trim(name)) <= length(nq) + 3 then 1 else 0 end,
  cast(image_url is null as int) + cast(barcode is null as int) + cast(package_value is null or package_unit is null as int), length(name), coalesce(brand, ''), name, id"""
def strict_sql(asked: str, limit: int = 20) -> str:
    return f"""with c as ({_CATALOGUE}), q as (select query_id, {S.norm('query')} as nq, string_split({S.norm('query')}, ' ') as words from {asked}),
  h as (select *, concat_ws(' ', n_name, n_brand, n_aliases, n_subtype, n_keywords, n_search) as hay from c, q),
  m as (select * from h where len(list_filter(words, lambda w: not contains(hay, w))) = 0),
  r as (select *, case when n_name = nq then 1 when n_brand = nq then 2 when starts_with(n_name, nq) then 3 when len(list_filter(words, lambda w: not contains(n_name, w))) = 0 then 4
    when len(list_filter(words, lambda w: not contains(n_name || ' ' || n_brand, w))) = 0 then 5 else 6 end as rel, case when len(words) = 1 and n_name = nq then 1 else 0 end as plain from m),
  k as (select query_id, id, cast(row_number() over (partition by query_id order by plain, rel, {_ORDER}) as integer) as rank from r)
  select query_id, id, rank from k where rank <= {limit}"""


_STRICT = strict_sql(_ASKED_SQL)


@query(_STRICT)
def strict_search_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Listings with every word of each query, best 20 first (2.2.2, 2.2.7, 2.6.2-2.6.5)."""
    return Q.strict_search(_asked(spark), _catalogue(spark, folder))


@query(
    f"""with q as (select query_id, {S.trigrams('query')} as qt from {_ASKED_SQL}), t as (select id, {S.trigrams('name')} as tt from products),
    s as (select query_id, id, len(list_intersect(qt, tt)) as shared, len(qt) + len(tt) as total from q, t),
    r as (select query_id, id, cast(shared as double) / (total - shared) as similarity from s where shared > 0)
    select query_id, id, similarity from (select *, row_number() over (partition by query_id order by similarity desc, id) as k from r where similarity >= 0.2) where k <= 20"""
)
def trigram_similarity_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 names most similar to each query by trigrams, similarity 0.2 or more (2.2.5)."""
    hits = Q.trigram_hits(_asked(spark), table(spark, folder, "products", "id", "name"), "id", "name", 0.2)
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).filter("_k <= 20").select("query_id", "id", "similarity")


@query()
def fuzzy_search_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted fuzzy hits of each query (2.2.8); extents are not expressible in SQL, so the test has a brute-force version."""
    return Q.fuzzy_search(_asked(spark), _catalogue(spark, folder))


@query()
def combined_search_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Hits by code, else strict, then fuzzy ones of every form of a query, each listing where it was first seen (2.2.9, 2.6.1)."""
    return Q.combined_search(_asked(spark), _catalogue(spark, folder))


@query()
def suggestions_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions: listings whose search text holds an extent like a form of the query; the first form that finds one counts (2.2.10)."""
    forms = _asked(spark).select("query_id", F.posexplode(T.search_variants(F.col("query"))).alias("form", "v")).filter("length(v) >= 2")
    texts = table(spark, folder, "products", "id", "search_text", "is_active").filter("is_active and search_text is not null").select("id", "search_text")
    keyed = forms.select(F.struct("query_id", "form").alias("query_id"), F.col("v").alias("query"))
    near = Q.trigram_candidates(keyed, texts, "id", "search_text", Q.SUGGEST_LEAST)
    met = near.join(F.broadcast(keyed), "query_id").join(texts, "id").select("query_id.*", "id", F.greatest(G.similarity(F.col("query"), F.col("search_text")), G.word_similarity(F.col("query"), F.col("search_text"))).alias("score"))
    first = met.filter(F.col("score") >= Q.SUGGEST_LEAST).withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("form"))).filter("_k = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("rank <= 10").select("query_id", "id", "score", "rank")


CODES = ["4600000000213", "4600000037417", "4600000123516", "4600000002019", "4600000025919"]


@query(f"select id, right(regexp_replace(barcode, '[^0-9]', '', 'g'), 13) as code from products where barcode is not null and right(regexp_replace(barcode, '[^0-9]', '', 'g'), 13) in {S.in_list(CODES)}")
def barcode_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Listings by exact code after folding its spelling (2.2.1, 2.2.17)."""
    listed = table(spark, folder, "products", "id", "barcode").select("id", F.right(F.regexp_replace("barcode", "[^0-9]", ""), F.lit(13)).alias("code"))
    return listed.filter(F.col("code").isin(*CODES))


_ALIASES = f"select b.id, {S.norm('b.name')} as alias from brands b union select id, {S.norm('unnest(string_split(replace(replace(replace(aliases, chr(59), chr(44)), chr(47), chr(44)), chr(124), chr(44)), chr(44)))')} from brands where aliases is not null"


@query(f"with a as ({_ALIASES}), o as (select distinct rec_id, {S.norm('brands')} as alias from off_products where brands is not null) select rec_id from o where exists (select 1 from a where a.alias = o.alias and a.alias <> '')")
def alias_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose whole brand field is a known name or alias (2.2.3, 2.3 semi-joins)."""
    b = table(spark, folder, "brands", "id", "name", "aliases")
    split = F.split(F.coalesce("aliases", F.lit("")), "[,;/|]")
    known = b.select(F.explode(F.concat(F.array("name"), split)).alias("a")).select(T.normalize_text(F.col("a")).alias("alias")).filter("alias <> ''").distinct()
    off = table(spark, folder, "off_products", "rec_id", "brands").filter("brands is not null").select("rec_id", T.normalize_text(F.col("brands")).alias("alias"))
    return off.join(known, "alias", "left_semi").select("rec_id").distinct()


@query("select id from products p where is_active and not exists (select 1 from product_sources s where s.product_id = p.id and lower(trim(s.provider)) = 'off_dump')")
def seen_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Active listings that a provider has not delivered (anti-join, 2.2.7)."""
    seen = table(spark, folder, "product_sources", "product_id", "provider").filter(F.lower(F.trim("provider")) == "off_dump").select(F.col("product_id").alias("id"))
    return table(spark, folder, "products", "id", "is_active").filter("is_active").join(seen, "id", "left_anti").select("id")


RATINGS_SQL = """select user_id, product_id, score from (select o.o_custkey as user_id, l.l_partkey as product_id,
  cast(least(10, greatest(1, 3 + l.l_partkey % 7 + (o.o_custkey + l.l_linenumber) % 3)) as int) as score,
  row_number() over (partition by o.o_custkey, l.l_partkey order by o.o_orderdate desc, l.l_orderkey desc, l.l_linenumber desc, l.l_shipdate desc) as k
  from lineitem l join orders o on o.o_orderkey = l.l_orderkey) where k = 1"""


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    score = F.least(F.lit(10), F.greatest(F.lit(1), F.lit(3) + F.col("l_partkey") % 7 + (F.col("o_custkey") + F.col("l_linenumber")) % 3)).cast("int")
    events = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"), score.alias("score"), "o_orderdate", "l_orderkey", "l_linenumber", "l_shipdate")
    return R.latest(events, ["user_id", "product_id"], "o_orderdate", "l_orderkey", "l_linenumber", "l_shipdate").select("user_id", "product_id", "score")


@query(RATINGS_SQL)
def latest_rating_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last rating of each user and product (2.5.8, 2.15.9)."""
    return ratings(spark, folder)


@query(
    f"""with r as ({RATINGS_SQL}), g as (select sum(score) * 1.0 / count(*) as m from r), p as (select product_id, count(*) as votes, cast(sum(score) as double) / count(*) as average from r group by product_id)
    select product_id, votes, round(average, 6) as average, round(votes / (votes + 20.0) * average + 20.0 / (votes + 20.0) * (select cast(m as double) from g), 6) as weighted from p"""
)
def rating_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Votes, mean and shrunken mean of each product (2.4.1-2.4.6)."""
    return R.shrunken_ratings(ratings(spark, folder)).select("product_id", "votes", F.round("average", 6).alias("average"), F.round("weighted", 6).alias("weighted"))


@query(
    f"""with r as ({RATINGS_SQL}), p as (select product_id, count(*) as votes from r group by product_id),
    t as (select product_id, votes, least(100.0, ln(votes + 1.0) / ln(101.0) * 100) * 0.85 + 90.0 * 0.15 as plain from p)
    select product_id, round(cast(least(plain, case when votes < 5 then 30.0 when votes < 20 then 55.0 when votes < 100 then 79.0 else 100.0 end) as double), 6) as trust,
    case when votes < 5 then 'very_low' when votes < 20 then 'low' when votes < 100 then 'medium' else 'high' end as level from t"""
)
def trust_by_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Trust score and level of each product from its votes (2.11.2-2.11.4, 2.11.11)."""
    votes = ratings(spark, folder).groupBy("product_id").agg(F.count(F.lit(1)).alias("votes"))
    return votes.select("product_id", F.round(R.trust_score(F.col("votes"), F.lit(90.0)), 6).alias("trust"), R.trust_level(F.col("votes")).alias("level"))


@query("select product_id, count(*) as n, min(price) as low, max(price) as high, quantile_cont(cast(price as double), 0.5) as middle, max(price) - min(price) as spread from price_observations where price > 0 group by product_id")
def price_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Count, extremes, exact median and spread of the prices of each product (2.2.11, 2.4.8)."""
    return R.price_statistics(table(spark, folder, "price_observations", "product_id", "price"), "product_id").withColumn("spread", F.col("spread").cast("decimal(13,2)"))


@query(
    f"""with k as (select query_id, id, rank, count(*) over (partition by query_id) as n from ({_STRICT}))
    select query_id, id, case when n <= 1 then 100.0 else greatest(100.0 - 35.0 * (rank - 1) / (n - 1), 65.0) end as relevance from k where rank between 11 and 20"""
)
def page_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of each query's strict hits with their relevance by position (2.5.1, 2.5.11, 2.6.12, 2.11.15)."""
    ranked = strict_search_batch(spark, folder).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return Q.page(ranked, 1).select("query_id", "id", R.relevance(F.col("rank") - 1, F.col("n")).alias("relevance"))
