"""What item pages and result pages of catalogues tell: relevance of names to a query, item addresses, packages, subtypes, links, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import identity as I
from larder.functions import text as T
from larder.sources.html import extract_pages

#: Words of a query that name a kind of goods, and words that only describe one.
KIND_WORDS = [
    "кофе", "чай", "молоко", "сметана", "кефир", "йогурт", "сыр", "масло", "вода", "сок", "пицца", "сельдь", "рыба", "мясо", "колбаса", "макароны", "рис", "гречка", "мука", "сахар", "соль", "хлеб", "печенье", "шоколад", "конфеты",
    "мороженое", "пельмени", "вареники", "творог", "сливки", "яйца", "яйцо", "продукт", "продукты", "напиток", "напитки",
]
MODIFIERS = [
    "растворимый", "растворимое", "молотый", "молотое", "зерновой", "зерновое", "зернах", "черный", "зеленый", "питьевой", "питьевое", "пастеризованный", "пастеризованное", "ультрапастеризованный", "ультрапастеризованное",
    "безлактозный", "безлактозное", "замороженный", "замороженная", "замороженное", "сливочный", "сливочная", "средний", "средняя", "жирности", "гост",
]
#: Subtypes by what a text contains; the first that matches counts.
SUBTYPES = [
    ("Молотый", ["молотый", "молотая", "ground"]), ("В зёрнах", ["в зернах", "зерновой", "зерновая", "beans"]), ("Растворимый", ["растворимый", "instant"]), ("В капсулах", ["в капсулах", "капсулы", "капсульный"]),
    ("Пастеризованное", ["пастеризован"]), ("Ультрапастеризованное", ["ультрапастеризован"]), ("Безлактозное", ["безлактоз", "без лактозы"]),
]
#: Least score of a link, points of the whole phrase and of all telling words, and how many links a wanted one is looked for in.
LEAST_SCORE, PHRASE, ANCHORS, SPARE = 0.20, 0.18, 0.20, 3
_PACKAGE = r"(?iu)(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s*(кг|kg|г|гр|g|л|l|мл|ml)(?![\p{L}\p{N}_])"
_ARTICLE = r"(?<![0-9])([0-9]{7,14})(?![0-9])"
_TAIL = r"(?iu)(?:\s+В корзину|\s+В торговом центре|\s+Товара |\s+[0-9][0-9\s]*[₽р]).*$"


def folded(col: Column) -> Column:
    return F.translate(F.lower(F.coalesce(T.squeeze(col), F.lit(""))), "ё", "е")


def tokens(col: Column) -> Column:
    """Words of two or more letters, repeats kept."""
    return F.filter(F.regexp_extract_all(folded(col), F.lit("[a-zа-я0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def _alike(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a)))


def anchors(query: Column) -> Column:
    """The words of a query that tell more than a kind of goods or its description."""
    return F.filter(tokens(query), lambda w: ~w.isin(*KIND_WORDS, *MODIFIERS))


def query_kind(query: Column) -> Column:
    """The first word of a query that names a kind of goods."""
    return F.get(F.filter(tokens(query), lambda w: w.isin(*KIND_WORDS)), F.lit(0))


def coverage(query: Column, text: Column) -> Column:
    """The share of the query's words that the text has, whole or within a word of four letters; 0 if either has none."""
    asked, have = tokens(query), tokens(text)
    met = F.size(F.filter(asked, lambda w: F.exists(have, lambda h: _alike(w, h))))
    return F.when((F.size(asked) == 0) | (F.size(have) == 0), 0.0).otherwise(met / F.size(asked))


def has_anchors(query: Column, text: Column) -> Column:
    """Whether the text has all telling words of the query; true if there are none."""
    have = tokens(text)
    return F.forall(anchors(query), lambda w: F.exists(have, lambda h: _alike(w, h)))


def is_relevant(query: Column, text: Column) -> Column:
    """All telling words, and half of all words; of a one-word query the word."""
    share = coverage(query, text)
    return has_anchors(query, text) & (F.size(tokens(query)) > 0) & F.when(F.size(tokens(query)) == 1, share >= 1.0).otherwise(share >= 0.5)


def name_score(query: Column, name: Column) -> Column:
    """0 to 1: words met, partly met ones by 0.55, and points for the whole phrase and for all telling words."""
    asked, have = tokens(query), tokens(name)
    exact = F.size(F.filter(asked, lambda w: F.array_contains(have, w)))
    partly = F.size(F.filter(asked, lambda w: ~F.array_contains(have, w) & F.exists(have, lambda h: _alike(w, h))))
    points = (exact + partly * 0.55) / F.size(asked) + F.when(F.contains(folded(name), folded(query)), PHRASE).otherwise(0.0) + F.when((F.size(anchors(query)) > 0) & has_anchors(query, name), ANCHORS).otherwise(0.0)
    return F.when((F.size(asked) == 0) | (F.size(have) == 0), 0.0).otherwise(F.least(points, F.lit(1.0)))


def package_in_text(col: Column) -> Column:
    """struct(value, unit) of the last amount in a text, null if there is none."""
    values, spelled = F.regexp_extract_all(col, F.lit(_PACKAGE), F.lit(1)), F.regexp_extract_all(col, F.lit(_PACKAGE), F.lit(2))
    last = F.size(values) - 1
    value = F.replace(F.get(values, last), F.lit(","), F.lit(".")).try_cast("decimal(12,3)")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), I.package_unit(F.lower(F.get(spelled, last))).alias("unit")))


def subtype_in_text(col: Column) -> Column:
    return F.coalesce(*[F.when(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(folded(col), t)), F.lit(title)) for title, terms in SUBTYPES])


def clean_url(url: Column) -> Column:
    """Without query, fragment and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "/+$", "")


def source_id(url: Column) -> Column:
    """The last article number of an address's last part, else that part."""
    last = F.element_at(F.split(clean_url(url), "/"), -1)
    found = F.regexp_extract_all(last, F.lit(_ARTICLE), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.nullif(last, F.lit("")))


def is_item_url(url: Column) -> Column:
    """An address of a single item: of a product folder, or of a catalogue folder ending with an article number."""
    low = F.lower(url)
    last = F.element_at(F.split(clean_url(url), "/"), -1)
    return F.coalesce(F.contains(low, F.lit("/product/")) | F.contains(low, F.lit("/products/")) | (F.contains(low, F.lit("/catalog/")) & last.rlike(_ARTICLE)), F.lit(False))


def result_links(pages: DataFrame, limit: int = 5) -> DataFrame:
    """(page_id, url, text, score, rank): the items a result page (page_id, query, url, html) links to, the best ``SPARE`` times ``limit``.

    Links that are no item, have fewer than four letters or score too little are left out; an item linked twice counts where
    it was first. Prices and buttons after a name are cut. Null markup gives no links."""
    read = extract_pages(pages, "page_id", "url", "html").select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", clean_url(F.col("l.url")).alias("url"), T.squeeze(F.regexp_replace("l.text", _TAIL, "")).alias("text"))
    items = read.filter(is_item_url(F.col("url")) & (F.length("text") >= 4)).join(pages.select("page_id", "query"), "page_id")
    scored = items.withColumn("score", name_score(F.col("query"), F.col("text"))).filter(F.col("score") >= LEAST_SCORE)
    first = scored.groupBy("page_id", "url").agg(F.min_by(F.struct("text", "score"), "pos").alias("x")).select("page_id", "url", "x.*")
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc(F.length("text")), "url")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SPARE * limit)


def item_records(pages: DataFrame, provider: str) -> DataFrame:
    """(page_id, provider, source_id, name, brand_name, barcode, category_name, package_value, package_unit, subtype, description,
    image_url, source_url, relevant, score) of item pages (page_id, query, url, html); pages without a name give none."""
    read = extract_pages(pages, "page_id", "url", "html").drop("links").join(pages.select("page_id", "query", F.col("url").alias("source_url")), "page_id").filter(T.filled(F.col("name")).isNotNull())
    told = F.concat_ws(" ", "name", "description")
    read = read.withColumn("_p", F.coalesce(package_in_text(F.col("name")), package_in_text(F.col("description"))))
    return read.select(
        "page_id", F.lit(provider).alias("provider"), source_id(F.col("source_url")).alias("source_id"), T.squeeze(F.col("name")).alias("name"), T.filled(F.col("brand")).alias("brand_name"), T.digits_code(F.col("barcode")).alias("barcode"),
        T.filled(F.col("category")).alias("category_name"), F.col("_p.value").alias("package_value"), F.col("_p.unit").alias("package_unit"), subtype_in_text(told).alias("subtype"), T.filled(F.col("description")).alias("description"),
        F.when(~F.col("image_url").rlike(r"(?i)^data:|\.svg$"), F.col("image_url")).alias("image_url"), clean_url(F.col("source_url")).alias("source_url"), is_relevant(F.col("query"), told).alias("relevant"), name_score(F.col("query"), F.col("name")).alias("score"),
    )
