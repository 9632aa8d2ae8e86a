"""What tells two items apart: packages, percentages, counts, tokens of a name, and scores of a field's quality.

Two sets of rules exist: ``merge`` for records that come in, ``scan`` for pairs of stored listings. They differ in the words
that tell no variant and in the unit letters of a package inside a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import comparable, normalize_text, squeeze, unescape, unicode_words

#: Spellings of package units in normal form; other spellings stay as they are.
PACKAGE_UNITS = {
    "г": ["гр", "грамм", "грамма", "граммов", "gram", "grams", "g"],
    "кг": ["килограмм", "килограмма", "килограммов", "kg"],
    "мл": ["миллилитр", "миллилитра", "миллилитров", "ml"],
    "л": ["литр", "литра", "литров", "l"],
}
#: Names that are no more than a kind of goods.
GENERIC_NAMES = [
    "кофе", "молоко", "чай", "вода", "пицца", "сыр", "масло", "йогурт", "кефир", "сельдь", "сок", "сметана", "творог", "сливки", "колбаса",
    "майонез", "паштет", "печенье", "шоколад", "мороженое", "пельмени", "вареники",
]
#: Words of a name that prove nothing about the item.
NAME_STOP_WORDS = [
    *GENERIC_NAMES, "продукт", "продукты", "товар", "товары", "традиции", "традиционный", "традиционные", "классический", "классическая",
    "классическое", "классические", "охлажденный", "охлажденная", "замороженный", "замороженная", "бзмж", "гост",
]
#: Words of a name that tell no variant, in both sets of rules.
_NO_VARIANT = [
    "кофе", "молоко", "чай", "вода", "сыр", "масло", "йогурт", "кефир", "сметана", "творог", "сливки", "колбаса", "майонез", "пельмени",
    "капсулах", "капсулы", "кофемашин", "nespresso", "вареная", "вареный", "вареное", "варено", "копченая", "копченый", "копченое", "копченые",
    "варенокопченая", "варенокопченый", "ультрапастеризованное", "пастеризованное", "сливочная", "классическая", "классический", "традиции",
    "традиционный", "традиционная", "традиционное", "гост", "бзмж", "для", "из", "на", "с", "со", "без", "quot", "amp", "lt", "gt", "nbsp",
]
#: Such words of one set of rules only.
GENERIC_WORDS = {
    "scan": [*_NO_VARIANT, "сервелат", "напиток", "напитки", "кетчуп"],
    "merge": [
        *_NO_VARIANT, "пицца", "сельдь", "сок", "паштет", "печенье", "шоколад", "мороженое", "вареники", "продукт", "продукты", "товар", "товары",
        "классическое", "классические", "традиционные", "охлажденный", "охлажденная", "замороженный", "замороженная",
    ],
}
#: Categories that say nothing, and names of one category in different sources.
GENERIC_CATEGORIES = ["", "продукты", "продукт", "еда", "food", "foods", "products", "product", "прочее", "другое", "other"]
CATEGORY_GROUPS = [
    ["молочная продукция", "dairy", "dairy products", "milk products", "smetana"],
    ["напитки", "beverages", "drinks"],
    ["чай", "teas", "tea"],
    ["батончики", "bars", "chocolate bars"],
    ["вода", "drinking water", "water"],
    ["кетчуп", "ketchup"],
    ["колбаса", "sausages", "sausage"],
]
#: Words of a description that advertise.
ADVERTISING = ["купить", "заказать", "доставка", "акция", "скидка", "выгодная цена", "лучшая цена"]
#: Greatest difference of two packages of one item, as a share of the larger.
PACKAGE_TOLERANCE = "0.03"
_NUMBER = r"(?<![0-9.,])([0-9]+(?:[.,][0-9]+)?)"
_END = r"(?![\p{L}\p{N}_])"
_AMOUNT = {"scan": rf"{_NUMBER}\s*(кг|г|гр|мл|л){_END}", "merge": rf"{_NUMBER}\s*(кг|г|гр|мл|л|kg|g|ml|l){_END}"}
_COUNT = rf"(?<![0-9.,])([0-9]+)\s*(шт|штук|капсул|пакетик(?:а|ов)?|саше|порц(?:ия|ии|ий)){_END}"
_PERCENT = rf"{_NUMBER}\s*%"
_LONE = rf"{_NUMBER}(?![0-9.,])"
_PACKAGE_WORD = {"scan": r"^[0-9]+(?:г|гр|кг|мл|л)$", "merge": r"^[0-9]+(?:г|гр|кг|мл|л|g|kg|ml|l)$"}


def package_unit(col: Column) -> Column:
    """The unit a spelling stands for; an unknown spelling as it is, in lower case; null if there is none."""
    key = normalize_text(squeeze(col))
    pairs = [x for unit, spelled in PACKAGE_UNITS.items() for s in spelled for x in (F.lit(s), F.lit(unit))]
    return F.when(key != "", F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lower(squeeze(col))))


def package_family(unit: Column) -> Column:
    return F.when(unit.isin("г", "кг"), "mass").when(unit.isin("мл", "л"), "volume")


def package_base(value: Column, unit: Column) -> Column:
    """Grams or millilitres of a package; null for other units and for what is not above zero."""
    amount = F.when(value > 0, value.cast("decimal(12,3)"))
    return F.when(unit.isin("кг", "л"), (amount * 1000).cast("decimal(18,3)")).when(unit.isin("г", "мл"), amount.cast("decimal(18,3)"))


def packages_compatible(left: Column, left_family: Column, right: Column, right_family: Column) -> Column:
    """True, false, or null if either package is unknown: same family and a difference within the tolerance of the larger."""
    known = left.isNotNull() & right.isNotNull()
    near = F.abs(left - right) <= F.greatest(left, right) * F.lit(PACKAGE_TOLERANCE).cast("decimal(3,2)")
    return F.when(known & (left_family != right_family), F.lit(False)).when(known, near)


def canonical_number(v: Column) -> Column:
    """A number text with a decimal point and without needless zeros."""
    point = F.regexp_replace(F.replace(v, F.lit(","), F.lit(".")), r"^0+(?=[0-9])", "")
    return F.when(F.contains(point, F.lit(".")), F.regexp_replace(point, r"\.?0+$", "")).otherwise(point)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _as_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def percentages(col: Column) -> Column:
    """Distinct percentages of a name, sorted as text."""
    return _as_set(F.transform(_found(comparable(col), _PERCENT), canonical_number))


def counts(col: Column) -> Column:
    """Distinct ``number:word`` counts of pieces of a name, sorted as text."""
    text = comparable(col)
    return _as_set(F.zip_with(_found(text, _COUNT), _found(text, _COUNT, 2), lambda n, u: F.concat(n, F.lit(":"), u)))


def name_packages(col: Column, rules: str = "scan") -> Column:
    """Distinct ``value:unit`` packages of a name, sorted as text."""
    text, pattern = comparable(col), _AMOUNT[rules]
    return _as_set(F.zip_with(_found(text, pattern), _found(text, pattern, 2), lambda v, u: F.concat(canonical_number(v), F.lit(":"), package_unit(u))))


def numeric_markers(col: Column) -> Column:
    """Distinct numbers of a name that belong to no package and no count, sorted as text."""
    rest = F.regexp_replace(F.regexp_replace(comparable(col), _AMOUNT["merge"], " "), _COUNT, " ")
    return _as_set(F.transform(_found(rest, _LONE), canonical_number))


def sets_conflict(a: Column, b: Column) -> Column:
    """Both sets are known and differ."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(a) != F.array_sort(b))


def text_tokens(col: Column) -> Column:
    """Distinct words of two or more letters or digits."""
    return F.array_distinct(F.filter(unicode_words(comparable(col)), lambda w: F.length(w) >= 2))


def name_tokens(col: Column) -> Column:
    """Distinct runs of three or more letters of a name that are no stop words; digits part them. Null gives an empty set."""
    runs = _found(comparable(F.coalesce(col, F.lit(""))), r"[\p{L}\p{No}\p{Nl}]+", 0)
    return F.array_distinct(F.filter(runs, lambda w: (F.length(w) >= 3) & ~w.isin(*NAME_STOP_WORDS)))


def variant_tokens(col: Column, brand: Column, rules: str = "scan") -> Column:
    """Distinct words of a name that may tell the variant: neither of the brand, generic, a number nor a package. Null gives an empty set."""
    own = F.filter(unicode_words(comparable(F.coalesce(brand, F.lit("")))), lambda w: F.length(w) >= 3)
    told = F.filter(
        unicode_words(comparable(F.coalesce(col, F.lit("")))),
        lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\p{Nd}+$") & ~w.isin(*GENERIC_WORDS[rules]) & ~w.rlike(_PACKAGE_WORD[rules]),
    )
    return F.array_except(told, own)


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(shared, coverage of the smaller, Jaccard) of two token sets; zero where a set is empty."""
    shared = F.size(F.array_intersect(a, b))
    smaller, total = F.least(F.size(a), F.size(b)), F.size(F.array_union(a, b))
    return shared, F.when(smaller > 0, shared / smaller).otherwise(0.0), F.when(total > 0, shared / total).otherwise(0.0)


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the words of two texts, zero where one has none."""
    return overlap(text_tokens(F.coalesce(a, F.lit(""))), text_tokens(F.coalesce(b, F.lit(""))))[2]


def is_generic_name(col: Column) -> Column:
    return F.coalesce(normalize_text(squeeze(col)), F.lit("")).isin(*GENERIC_NAMES)


def is_generic_category(col: Column) -> Column:
    return F.coalesce(normalize_text(squeeze(unescape(col))), F.lit("")).isin(*GENERIC_CATEGORIES)


def category_key(col: Column) -> Column:
    """The normal form of a category, or the number of its group of equal categories; empty if there is none."""
    key = F.coalesce(normalize_text(squeeze(unescape(col))), F.lit(""))
    pairs = [x for n, group in enumerate(CATEGORY_GROUPS, 1) for name in group for x in (F.lit(name), F.lit(f"equiv:{n}"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def name_quality(col: Column) -> Column:
    """0 to 100: more for a name that is specific, has several words, a number, and a fair length."""
    text, n = squeeze(col), F.length(squeeze(col))
    points = (
        F.lit(20) + F.when(~is_generic_name(col), 30).otherwise(0) + F.least(F.size(text_tokens(col)) * 5, F.lit(25)) + F.when(text.rlike("[0-9]"), 5).otherwise(0)
        + F.when(n >= 12, 10).otherwise(0) - F.when(n > 180, 20).otherwise(0)
    )
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.least(F.greatest(points, F.lit(0)), F.lit(100)))


def description_quality(col: Column) -> Column:
    """0 to 100: by length, less ten for each advertising word, more from 80 and from 200 letters."""
    n, normal = F.length(squeeze(col)), normalize_text(squeeze(col))
    hits = sum((F.contains(normal, F.lit(w)).cast("int") for w in ADVERTISING), F.lit(0))
    points = F.least(n / 8.0, F.lit(70.0)) - hits * 10.0 + F.when(n >= 80, 10.0).otherwise(0.0) + F.when(n >= 200, 10.0).otherwise(0.0)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0)))


def image_quality(col: Column) -> Column:
    """0 none, 10 a placeholder, 70 a web address, 80 one with an image's ending, 95 another identifier."""
    text = squeeze(col)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", 0).when(F.contains(F.lower(text), F.lit("placeholder")), 10)
        .when(text.rlike("^https?://") & text.rlike(r"(?i)\.(?:jpg|jpeg|png|webp)(?:$|\?)"), 80).when(text.rlike("^https?://"), 70).otherwise(95)
    )
