"""Product families, facets and intents: what groups of search hits have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import text as T
from larder.runtime import small_broadcast

#: Words of a name that do not name the family.
MARKETING = [
    "новинка", "премиум", "отборный", "отборная", "отборное", "классический", "классическая", "классическое", "традиционный", "традиционная", "традиционное", "оригинальный", "оригинальная", "оригинальное",
    "натуральный", "натуральная", "натуральное", "домашний", "домашняя", "домашнее", "вкусный", "вкусная", "вкусное", "лучший", "лучшая", "лучшее",
]
PACKAGING = ["г", "гр", "кг", "мл", "л", "шт", "штук", "уп", "упаковка", "упаковке", "банка", "банке", "бутылка", "бутылке", "пачка", "пачке"]
TECHNICAL = ["массовая", "массовой", "доля", "долей", "доли", "жира", "жир", "пищевой", "пищевая", "пищевое", "продукция", "продукт", "товар", "coffees", "coffee", "dried", "instant"]
#: Phrases left out before a canonical family is looked for.
FAMILY_PHRASES = ["массовая доля жира", "массовой долей жира", "массовой доли жира", "массовая доля", "массовой долей", "массовой доли", "пищевая продукция", "продукт пищевой", "готовый продукт", "товар", "продукт"]
#: Canonical families in order: (family, part that must occur, parts of which one must, part that must not); empty asks nothing.
CANONICAL = [
    ("Молоко безлактозное", "молок", ["безлактозн", "без лактоз"], ""), ("Молоко ультрапастеризованное", "молок", ["ультрапастеризован", "ультра пастеризован", "uht"], ""), ("Молоко пастеризованное", "молок", ["пастеризован"], "ультрапастеризован"),
    ("Молоко топлёное", "молок", ["топлен"], ""), ("Молоко питьевое", "молок", ["питьев"], ""), ("Молоко козье", "молок", ["козь"], ""), ("Молоко овсяное", "", ["овсяное молоко", "овсяный напиток"], ""),
    ("Молоко кокосовое", "", ["кокосовое молоко", "кокосовый напиток"], ""), ("Молоко соевое", "", ["соевое молоко", "соевый напиток"], ""), ("Молоко", "молок", [], ""),
    ("Кофе растворимый", "коф", ["растворим", "instant coffee", "instant coffees"], ""), ("Кофе молотый", "коф", ["молот", "ground coffee"], ""), ("Кофе в зёрнах", "коф", ["в зернах", "зернов", "coffee beans"], ""),
    ("Кофе в капсулах", "коф", ["капсул", "capsule"], ""), ("Кофе сублимированный", "коф", ["сублимирован", "freeze dried"], ""), ("Кофе", "коф", [], ""),
    ("Сельдь в масле", "сельд", ["в масле", "маслян"], ""), ("Сельдь слабосолёная", "сельд", ["слабосолен", "малосолен"], ""), ("Сельдь пряного посола", "сельд", ["пряного посола", "пряный посол"], ""),
    ("Сельдь специального посола", "сельд", ["специального посола"], ""), ("Филе сельди", "сельд", ["филе", "филейн"], ""), ("Пресервы из сельди", "сельд", ["пресерв"], ""), ("Сельдь с укропом", "сельд", ["укроп"], ""),
    ("Сельдь в горчичном соусе", "сельд", ["горчиц"], ""), ("Сельдь", "сельд", [], ""),
    ("Сыр плавленый", "сыр", ["плавлен"], ""), ("Сыр творожный", "сыр", ["творожн"], ""), ("Сыр твёрдый", "сыр", ["тверд"], ""), ("Сыр полутвёрдый", "сыр", ["полутверд"], ""), ("Сыр с голубой плесенью", "сыр", ["голубой плесен"], ""),
    ("Моцарелла", "", ["моцарелл"], ""), ("Чеддер", "", ["чеддер"], ""), ("Сыр", "сыр", [], ""),
    ("Спагетти", "", ["спагетти", "spaghetti"], ""), ("Макароны рожки", "макарон", ["рожк"], ""), ("Макароны перья", "макарон", ["перья", "пенне", "penne"], ""), ("Макароны бантики", "макарон", ["бантик", "фарфалле", "farfalle"], ""),
    ("Вермишель", "", ["вермишель"], ""), ("Макароны", "макарон", [], ""),
]
#: Most words of a family name.
FAMILY_WORDS = 5
#: Words of a query that name a kind of product with facets.
FACET_KINDS = {"молоко": ["молоко", "milk"], "кофе": ["кофе", "coffee", "кофейный"], "сельдь": ["сельдь", "селедка", "herring"]}
#: Facets of a kind of product: (kind, facet, priority, option, title, term of a refined query, terms one of which a listing has).
FACETS = [
    ("молоко", "processing", 10, "pasteurized", "Пастеризованное", "пастеризованное", ["пастеризованное", "пастеризованный", "пастеризованная"]),
    ("молоко", "processing", 10, "ultra_pasteurized", "Ультрапастеризованное", "ультрапастеризованное", ["ультрапастеризованное", "ультрапастеризованный", "ультрапастеризованная", "ультравысокотемпературно", "ультравысокотемпературное", "uht"]),
    ("молоко", "processing", 10, "baked", "Топлёное", "топлёное", ["топленое", "топленый", "топленая"]),
    ("молоко", "product_kind", 20, "drinking", "Питьевое", "питьевое", ["молоко питьевое", "питьевое молоко"]),
    ("молоко", "product_kind", 20, "condensed", "Сгущённое", "сгущённое", ["сгущенное", "сгущенка", "condensed milk"]),
    ("молоко", "product_kind", 20, "dry", "Сухое", "сухое", ["сухое молоко", "молоко сухое", "milk powder"]),
    ("молоко", "product_kind", 20, "plant", "Растительное", "растительное", ["растительное молоко", "овсяное молоко", "соевое молоко", "кокосовое молоко", "миндальное молоко", "oat milk", "soy milk", "coconut milk", "almond milk"]),
    ("молоко", "special", 30, "lactose_free", "Безлактозное", "безлактозное", ["безлактозное", "без лактозы", "низколактозное", "low lactose", "lactose free"]),
    ("кофе", "form", 10, "instant", "Растворимый", "растворимый", ["растворимый кофе", "кофе растворимый", "instant coffee"]),
    ("кофе", "form", 10, "ground", "Молотый", "молотый", ["молотый кофе", "кофе молотый", "ground coffee"]),
    ("кофе", "form", 10, "beans", "В зёрнах", "в зёрнах", ["кофе в зернах", "зерновой кофе", "кофе зерновой", "coffee beans"]),
    ("кофе", "form", 10, "capsules", "В капсулах", "в капсулах", ["кофе в капсулах", "кофейные капсулы", "coffee capsules"]),
    ("кофе", "form", 10, "drip", "Дрип-пакеты", "дрип-пакеты", ["дрип пакет", "дрип пакеты", "drip coffee", "coffee drip"]),
    ("кофе", "preparation", 20, "three_in_one", "3 в 1", "3 в 1", ["3 в 1", "три в одном", "3in1"]),
    ("кофе", "preparation", 20, "decaf", "Без кофеина", "без кофеина", ["без кофеина", "декофеинизированный", "декофеинизированное", "decaf"]),
    ("кофе", "preparation", 20, "sublimated", "Сублимированный", "сублимированный", ["сублимированный", "сублимированное", "freeze dried"]),
    ("сельдь", "product_kind", 10, "fillet", "Филе", "филе", ["филе сельди", "сельдь филе", "филе кусочки"]),
    ("сельдь", "product_kind", 10, "preserves", "Пресервы", "пресервы", ["пресервы", "пресерв"]),
    ("сельдь", "product_kind", 10, "pieces", "Кусочки", "кусочки", ["кусочки сельди", "сельдь кусочки", "филе кусочки"]),
    ("сельдь", "preparation", 20, "lightly_salted", "Слабосолёная", "слабосолёная", ["слабосоленая", "слабосоленый", "малосольная"]),
    ("сельдь", "preparation", 20, "spicy_salted", "Пряного посола", "пряного посола", ["пряного посола", "пряный посол"]),
    ("сельдь", "preparation", 20, "in_oil", "В масле", "в масле", ["в масле", "масляной заливке", "масляная заливка"]),
    ("сельдь", "preparation", 20, "with_onion", "С луком", "с луком", ["с луком", "луковая заливка"]),
]
#: Most options of a group, the priority of the percentages, and a percentage of fat in a text.
OPTIONS, FAT_PRIORITY, FAT = 5, 15, r"(?<![0-9])([0-9]{1,2}(?:[.,][0-9]{1,2})?)\s*%"
#: Words that give no intent.
INTENT_STOP = "и в во на с со из для по под без не или от до к у а я это продукт продукты товар товары бренд упаковка г гр кг мл л шт".split()


def without_brand(name: Column, brand: Column) -> Column:
    """The normal form of a name without its brand, unless that is a placeholder."""
    n, b = T.normalize_text(name), T.normalize_text(brand)
    cut = F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" ")), F.lit(" ")), " +", " "))
    return F.when(brand.isNull() | T.is_unknown_brand(brand) | (b == ""), n).otherwise(cut)


def family_source(*fields: Column) -> Column:
    """The fields (name, category, subtype, keywords) as one normal form without technical phrases."""
    text = T.normalize_text(F.concat_ws(" ", *fields))
    for phrase in FAMILY_PHRASES:
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_]){phrase}(?![\p{{L}}\p{{N}}_])", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def canonical_family(source: Column) -> Column:
    """The first canonical family whose parts occur in a ``family_source``, null if none does."""

    def holds(must: str, any_of: list[str], never: str) -> Column:
        test = F.contains(source, F.lit(must)) if must else F.lit(True)
        if any_of:
            test = test & F.exists(F.array(*[F.lit(p) for p in any_of]), lambda p: F.contains(source, p))
        return test & ~F.contains(source, F.lit(never)) if never else test

    return F.coalesce(*[F.when(holds(*rule), F.lit(name)) for name, *rule in CANONICAL])


def named_families(listings: DataFrame) -> DataFrame:
    """(id, family, family_id, canonical): each listing's canonical family in normal form, else the one made from its name.

    ``listings`` has id, category_id, name, brand, subtype and keywords. Families are one within a category; a listing whose
    name leaves nothing has none and no row."""
    # the generators keep each step's expression from being repeated inside the next
    read = listings.select("id", "category_id", F.explode(F.array(F.struct(family_source(F.col("name"), F.col("subtype"), F.col("keywords")).alias("s"), family_name(F.col("name"), F.col("brand"), F.col("subtype")).alias("f")))).alias("_x"))
    told = read.select("id", "category_id", T.normalize_text(canonical_family(F.col("_x.s"))).alias("_c"), F.col("_x.f").alias("_f"))
    named = told.select("id", "category_id", F.explode(F.array(F.struct(F.coalesce("_c", "_f").alias("family"), F.col("_c").isNotNull().alias("canonical")))).alias("_x")).select("id", "category_id", "_x.*").filter("family is not null")
    ids = named.groupBy("family", "category_id").agg(F.min("id").alias("family_id"))
    return named.join(ids, ["family", "category_id"]).select("id", "family", "family_id", "canonical")


def family_name(name: Column, brand: Column, subtype: Column) -> Column:
    """Brand, numbers and words of packaging, marketing and technique removed, the subtype added, each word once, at most five."""
    drop = [*MARKETING, *PACKAGING, *TECHNICAL]
    parts = F.concat(F.split(without_brand(name, brand), " "), F.split(F.coalesce(T.normalize_text(subtype), F.lit("")), " "))
    kept = F.array_distinct(F.filter(parts, lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~w.isin(*drop)))
    return F.nullif(F.array_join(F.slice(kept, 1, FAMILY_WORDS), " "), F.lit(""))


def assign_families(listings: DataFrame) -> DataFrame:
    """(id, family, family_id): families by name and category; the id is the smallest listing id of the family."""
    named = listings.select("id", "category_id", family_name(F.col("name"), F.col("brand"), F.col("subtype")).alias("family")).filter("family is not null")
    ids = named.groupBy("family", "category_id").agg(F.min("id").alias("family_id"))
    return named.join(ids, ["family", "category_id"]).select("id", "family", "family_id")


def has_term(text: Column, term: str) -> Column:
    """Whether a normal-form text holds a term: several words as they stand, a single one as a word of its own."""
    return F.contains(text, F.lit(term)) if " " in term else F.array_contains(F.split(text, " "), term)


def _any(text: Column, terms: list[str]) -> Column:
    out = has_term(text, terms[0])
    for t in terms[1:]:
        out = out | has_term(text, t)
    return out


def facet_kind(query: Column) -> Column:
    """The kind of product with facets that a query names, null if none."""
    text = T.normalize_text(query)
    return F.coalesce(*[F.when(_any(text, names), F.lit(kind)) for kind, names in FACET_KINDS.items()])


def facet_texts(listings: DataFrame) -> DataFrame:
    """(id, text, raw): all text fields of a listing in normal form, and in lower case with their signs."""
    fields = [c for c in ("name", "normalized_name", "subtype", "description", "keywords", "search_text", "brand", "category") if c in listings.columns]
    joined = lambda f: F.concat_ws(" ", *[F.nullif(f(F.col(c)), F.lit("")) for c in fields])
    return listings.select("id", joined(T.normalize_text).alias("text"), joined(lambda c: F.translate(F.lower(T.squeeze(c)), "ё", "е")).alias("raw"))


def facet_options(hits: DataFrame) -> DataFrame:
    """(query_id, facet, priority, option, title, refined, n, candidates, usefulness, place) of the hits (query_id, query, text, raw) of each query.

    Options that the query names already, that hold for fewer than two hits or for nearly all, are none; each facet keeps its
    ``OPTIONS`` most useful and needs two. Milk also has its percentages up to 20 as a facet. Options are tested in the scan by
    constant expressions and counted after a map-side aggregation; a query without a kind gives nothing."""
    kinds = hits.withColumn("_kind", facet_kind(F.col("query"))).filter("_kind is not null")
    asked = T.normalize_text(F.col("query"))
    row = lambda facet, priority, option, title, term: F.struct(F.lit(facet).alias("facet"), F.lit(priority).alias("priority"), option.alias("option"), title.alias("title"), term.alias("term"))
    told = [F.when((F.col("_kind") == k) & ~_any(asked, [T_ for T_ in dict.fromkeys([_plain(term), *terms])]) & _any(F.col("text"), terms), row(f, p, F.lit(o), F.lit(title), F.lit(term))) for k, f, p, o, title, term, terms in FACETS]
    values = F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(FAT), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double")))
    shown = lambda v: F.regexp_replace(v.cast("decimal(9,4)").cast("string"), r"\.?0+$", "")
    fats = F.transform(F.filter(values, lambda v: v.between(0, 20)), lambda v: row("fat_percent", FAT_PRIORITY, F.concat(F.lit("fat_"), F.replace(shown(v), F.lit("."), F.lit("_"))), F.concat(F.replace(shown(v), F.lit("."), F.lit(",")), F.lit("%")), F.concat(F.replace(shown(v), F.lit("."), F.lit(",")), F.lit("%"))))
    fats = F.when((F.col("_kind") == "молоко") & ~F.translate(F.lower("query"), "ё", "е").rlike(FAT), fats).otherwise(F.array().cast(f"array<{_ROW}>"))
    each = kinds.select("query_id", "query", F.explode(F.array_append(F.array_distinct(F.concat(F.array_compact(F.array(*told)), fats)), F.lit(None).cast(_ROW))).alias("o"))
    counted = each.select("query_id", "query", "o.*").groupBy("query_id", "query", "facet", "priority", "option", "title", "term").agg(F.count(F.lit(1)).alias("n"))
    total = counted.filter("facet is null").select("query_id", F.col("n").alias("candidates"))
    met = counted.filter("facet is not null").join(small_broadcast(total), "query_id").withColumn("usefulness", usefulness(F.col("n"), F.col("candidates"))).filter("usefulness > 0")
    fat = F.when(F.col("facet") == "fat_percent", F.abs(F.regexp_replace(F.replace("title", F.lit(","), F.lit(".")), "%", "").cast("double") - 3.2))
    of_facet = Window.partitionBy("query_id", "facet")
    ranked = met.withColumn("place", F.row_number().over(of_facet.orderBy(F.desc("usefulness"), F.desc("n"), fat, F.desc("title")))).filter(F.col("place") <= OPTIONS)
    kept = ranked.withColumn("_k", F.count(F.lit(1)).over(of_facet)).filter("_k >= 2")
    return kept.select("query_id", "facet", "priority", "option", "title", T.refined(F.col("query"), F.col("term")).alias("refined"), "n", "candidates", "usefulness", "place")


_ROW = "struct<facet:string,priority:int,option:string,title:string,term:string>"


def _plain(term: str) -> str:
    """A term in normal form."""
    return " ".join("".join(c if c.isalnum() else " " for c in term.lower().replace("ё", "е")).split())


def next_group(options: DataFrame) -> DataFrame:
    """The options of the one facet of each query to offer next: by priority, then average usefulness, hits and name."""
    groups = options.groupBy("query_id", "facet").agg(F.avg("usefulness").alias("a"), F.sum("n").alias("t"), F.min("priority").alias("p"))
    best = groups.groupBy("query_id").agg(F.min_by("facet", F.struct("p", (-F.col("a")).alias("a"), (-F.col("t")).alias("t"), "facet")).alias("facet"))
    return options.join(small_broadcast(best), ["query_id", "facet"])


def usefulness(n: Column, candidates: Column) -> Column:
    """How well an option divides the candidates: none if it holds for fewer than two or for nearly all."""
    cover = n / candidates
    value = F.greatest(F.lit(1.0) - F.abs(cover - 0.35), F.lit(0.0)) * 0.45 + F.least(n / 12.0, F.lit(1.0)) * 0.25 + (F.lit(1.0) - cover) * 0.30
    return F.when((n < 2) | (cover >= 0.96), 0.0).otherwise(value)


def intents(hits: DataFrame, least_hits: int = 6, least: int = 2, top: int = 8) -> DataFrame:
    """(query_id, phrase, n): one- and two-word phrases that at least two hits of a query share, the ``top`` most frequent.

    ``hits`` has query_id, query and a normal-form text. Words of the query, stop words, numbers and words under three letters
    are left out; a query with fewer than ``least_hits`` hits has no intents."""
    base = F.split(T.normalize_text(F.col("query")), " ")
    kept = hits.select("query_id", F.filter(F.array_except(F.split("text", " "), base), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(*INTENT_STOP)).alias("_w"))
    enough = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits")).filter(F.col("_hits") >= least_hits)
    sized = kept.join(small_broadcast(enough.select("query_id")), "query_id", "left_semi")
    pairs = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat(F.get("_w", i - 1), F.lit(" "), F.get("_w", i)))).otherwise(F.array().cast("array<string>"))
    counted = sized.select("query_id", F.explode(F.array_distinct(F.concat("_w", pairs))).alias("phrase")).groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counted.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "phrase"))).filter(F.col("_k") <= top).drop("_k")


#: Words and phrases that no intent shows, spellings of words, and titles of known phrases.
INTENT_TECHNICAL = [
    "coffee", "coffees", "instant", "freeze", "dried", "food", "foods", "product", "products", "milk", "milks", "drink", "drinks", "beverage", "beverages", "processed", "processing", "natural", "натуральный", "натуральная",
    "натуральное", "продукт", "продукты", "товар", "товары", "обработанный", "обработанное", "обработанная", "пищевой", "пищевая", "пищевое",
]
INTENT_PHRASES = ["массовая доля жира", "массовой долей жира", "массовой доли жира", "ультравысокотемпературно обработанное", "ультравысокотемпературной обработки", "пищевая продукция", "продукт пищевой"]
INTENT_SPELLINGS = {
    "ультравысокотемпературно": "ультрапастеризованное", "ультравысокотемпературный": "ультрапастеризованное", "ультравысокотемпературное": "ультрапастеризованное", "ультрапастеризованный": "ультрапастеризованное",
    "пастеризованный": "пастеризованное", "сгущенное": "сгущённое", "топленое": "топлёное", "безлактозный": "безлактозное", "растворимый": "растворимый",
}
INTENT_TITLES = {
    "молоко питьевое": "Питьевое", "молоко ультрапастеризованное": "Ультрапастеризованное", "молоко пастеризованное": "Пастеризованное", "молоко топленое": "Топлёное", "молоко сгущенное": "Сгущённое", "молоко сухое": "Сухое",
    "молоко безлактозное": "Безлактозное", "молоко козье": "Козье", "молоко кокосовое": "Кокосовое", "молоко овсяное": "Овсяное", "молоко соевое": "Соевое", "кофе растворимый": "Растворимый", "кофе сублимированный": "Сублимированный",
    "кофе молотый": "Молотый", "кофе зерновой": "В зёрнах", "кофе в зернах": "В зёрнах", "кофе капсулы": "В капсулах", "кофе в капсулах": "В капсулах", "кофе дрип": "Дрип-пакеты", "кофе три в одном": "3 в 1", "кофе 3 в 1": "3 в 1",
    "сельдь в масле": "В масле", "сельдь слабосоленая": "Слабосолёная", "сельдь пряного посола": "Пряного посола", "сельдь филе": "Филе", "филе сельди": "Филе", "сельдь пресервы": "Пресервы",
}
#: Titles that mean one intent.
INTENT_SAME = {"ультравысокотемпературное": "ультрапастеризованное", "сублимированный растворимый": "растворимый", "зерновой": "в зернах", "сгущеное": "сгущенное"}
#: Most words and letters of an intent's title.
TITLE_WORDS, TITLE_LENGTH = 4, 48


def intent_title(phrase: Column, query: Column) -> Column:
    """The phrase as a title: phrases and words of technique out, spellings unified, each word once, a known title or, without
    the query before it, its first words; empty if nothing is left."""
    text = T.normalize_text(phrase)
    for p in sorted(INTENT_PHRASES, key=lambda p: (-len(p), p)):
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_]){p}(?![\p{{L}}\p{{N}}_])", " ")
    spelled = F.create_map(*[x for k, v in INTENT_SPELLINGS.items() for x in (F.lit(k), F.lit(v))])
    words = F.transform(F.filter(F.split(text, " +"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(spelled, w), w))
    kept = F.filter(words, lambda w: ~w.isin(*INTENT_TECHNICAL) & ~w.rlike("^[a-z]+$"))
    once = F.filter(kept, lambda w, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda u: F.translate(u, "ё", "е") == F.translate(w, "ё", "е")))
    title, asked = F.array_join(once, " "), T.normalize_text(query)
    known = F.create_map(*[x for k, v in INTENT_TITLES.items() for x in (F.lit(k), F.lit(v))])
    key = T.normalize_text(title)
    rest = F.when(F.coalesce(asked, F.lit("")) == "", key).when(key == asked, F.lit("")).when(F.startswith(key, F.concat(asked, F.lit(" "))), F.trim(F.substr(key, F.length(asked) + 2))).otherwise(key)
    short = F.trim(F.substring(F.array_join(F.slice(F.split(rest, " "), 1, TITLE_WORDS), " "), 1, TITLE_LENGTH))
    return F.coalesce(F.try_element_at(known, key), F.concat(F.upper(F.substring(short, 1, 1)), F.substr(short, F.lit(2))))


def human_intents(found: DataFrame, limit: int = 6) -> DataFrame:
    """(query_id, title, phrase, n, rank): the intents (query_id, query, phrase, n) of each query by readable titles.

    Titles that are empty, hold words of technique or Latin words, or are too long are left out; of titles that mean one thing
    the most frequent stays. The order is by frequency, then the shorter title, then its letters from the end."""
    same = F.create_map(*[x for k, v in INTENT_SAME.items() for x in (F.lit(k), F.lit(v))])
    titled = found.filter("n > 0").withColumn("title", intent_title(F.col("phrase"), F.col("query"))).withColumn("_k", T.normalize_text(F.col("title")))
    titled = titled.select("query_id", "phrase", "n", F.explode(F.array(F.struct("title", "_k"))).alias("_x")).select("query_id", "phrase", "n", "_x.*")
    words = F.split("_k", " ")
    valid = titled.filter((F.col("_k") != "") & (F.length("title") <= TITLE_LENGTH) & (F.size(F.split("title", " ")) <= TITLE_WORDS) & ~F.exists(words, lambda w: w.isin(*INTENT_TECHNICAL) | w.rlike("^[a-z]{2,}$")))
    best = valid.withColumn("_k", F.coalesce(F.try_element_at(same, F.col("_k")), "_k")).groupBy("query_id", "_k").agg(F.min_by(F.struct("title", "phrase", "n"), F.struct((-F.col("n")).alias("m"), "phrase")).alias("b")).select("query_id", "b.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), F.length("title"), F.desc(F.lower("title")))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, min(limit, 8)))
