"""Text expressions: normal form, keyboard layouts, transliteration, query variants, tokens, codes. All JVM-side."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.units import BLANK

#: Cyrillic letters in Latin spelling; letters with more than one Latin letter or none come first in ``LATIN_MANY``.
LATIN_ONE = ("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")
LATIN_MANY = {"ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}
#: Latin groups and letters in Cyrillic spelling; groups are replaced in this order before single letters.
CYRILLIC_GROUPS = [("shch", "щ"), ("sch", "щ"), ("yo", "ё"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("ye", "е")]
CYRILLIC_MANY = {"j": "дж", "x": "кс"}
CYRILLIC_ONE = ("abcdefghiklmnopqrstuvwyz", "абкдефгхиклмнопкрстуввйз")
#: The keys of the two keyboard layouts.
LATIN_KEYS, RUSSIAN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,.", "ёйцукенгшщзхъфывапролджэячсмитьбю"
#: Units a query may hold with what they mean, and words a query does not search for.
QUERY_UNITS = {"г": "г", "гр": "г", "g": "г", "кг": "кг", "kg": "кг", "мл": "мл", "ml": "мл", "л": "л", "l": "л", "шт": "шт"}
STOP_WORDS = ["и", "в", "во", "на", "с", "со", "из", "для", "по", "под", "без", "от", "до", "к", "у", "а", "или"]
#: Names that stand for an unknown brand.
UNKNOWN_BRANDS = ["", "бренд не указан", "не указан", "unknown", "no brand", "без бренда"]

# named entities and, as the standard reads them, the numbers 128 to 159 as the letters of a Windows code page
_ENTITIES = "".join(f"\u0001{k}\u0002{v}" for k, v in (html5 | {f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}).items()) + "\u0001"


def squeeze(col: Column) -> Column:
    """Trimmed, with single blanks."""
    return F.trim(F.regexp_replace(col, f"{BLANK}+", " "))


def filled(col: Column) -> Column:
    """Squeezed text, null if nothing is left."""
    return F.nullif(squeeze(col), F.lit(""))


def normalize_text(col: Column) -> Column:
    """The base normal form: lower case, ё as е, everything but Latin and Cyrillic letters and digits a single blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(col), "ё", "е"), "[^a-zа-я0-9]+", " "))


def contains_cyrillic(col: Column) -> Column:
    return F.lower(col).rlike("[а-яё]")


def contains_latin(col: Column) -> Column:
    return F.lower(col).rlike("[a-z]")


def to_russian_layout(col: Column) -> Column:
    """What the keys of an English layout give in the Russian one, in normal form."""
    return normalize_text(F.translate(F.lower(col), LATIN_KEYS, RUSSIAN_KEYS))


def to_english_layout(col: Column) -> Column:
    return normalize_text(F.translate(F.lower(col), RUSSIAN_KEYS, LATIN_KEYS))


def _chain(col: Column, pairs) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def to_latin(col: Column) -> Column:
    """Transliteration to Latin letters, in normal form."""
    return normalize_text(F.translate(_chain(F.lower(col), LATIN_MANY.items()), *LATIN_ONE))


def to_cyrillic(col: Column) -> Column:
    """Transliteration to Cyrillic letters, groups first, in normal form."""
    return normalize_text(F.translate(_chain(_chain(F.lower(col), CYRILLIC_GROUPS), CYRILLIC_MANY.items()), *CYRILLIC_ONE))


def search_variants(col: Column) -> Column:
    """Ordered distinct forms under which a query may be meant: normal form, other layout, transliteration, both."""
    normal, latin, cyrillic = normalize_text(col), contains_latin(col), contains_cyrillic(col)
    russian, english = to_russian_layout(col), to_english_layout(col)
    of = lambda test, value: F.when(test, value)
    forms = [normal, of(latin, russian), of(latin, to_cyrillic(normal)), of(latin, to_latin(russian)), of(cyrillic, english), of(cyrillic, to_latin(normal)), of(cyrillic, to_cyrillic(english))]
    found = F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull() & (v != "")))
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(found)


def words(col: Column) -> Column:
    """Words of the normal form."""
    return F.filter(F.split(normalize_text(col), " "), lambda w: w != "")


def query_tokens(col: Column, keep_stop_words: bool = False) -> Column:
    """Numbers and runs of letters of the normal form as structs (value, position, is_number, is_unit, is_stop_word), positions from 0.

    Stop words are left out unless kept. The normal form has no percent sign, so no token is a percentage. Null gives null."""
    found = F.regexp_extract_all(normalize_text(col), F.lit("[0-9]+|[a-zа-я]+"), F.lit(0))
    told = F.transform(found, lambda w, i: F.struct(w.alias("value"), i.alias("position"), w.rlike("^(?:[0-9]+|nan|inf|infinity)$").alias("is_number"), w.isin(*QUERY_UNITS).alias("is_unit"), w.isin(*STOP_WORDS).alias("is_stop_word")))
    return told if keep_stop_words else F.filter(told, lambda t: ~t["is_stop_word"])


def query_package(tokens: Column) -> Column:
    """struct(at, value, unit) of the first positive number with a unit right after it among the tokens, ``at`` counted from 0; null if none."""
    units = F.create_map(*[x for k, v in QUERY_UNITS.items() for x in (F.lit(k), F.lit(v))])
    pairs = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), F.when(t["is_number"] & F.get(tokens, i + 1)["is_unit"], t["value"].try_cast("double")).alias("value"), F.try_element_at(units, F.get(tokens, i + 1)["value"]).alias("unit")))
    return F.get(F.filter(pairs, lambda p: (p["value"] > 0) & p["unit"].isNotNull()), F.lit(0))


def without_package(tokens: Column) -> Column:
    """The tokens without the number and the unit of their package."""
    at = query_package(tokens)["at"]
    return F.when(at.isNull(), tokens).otherwise(F.filter(tokens, lambda t, i: (i != at) & (i != at + 1)))


def phrase(col: Column) -> Column:
    """Words in lower case, ё as е, without punctuation at their ends, with single blanks; empty for null."""
    words_of = F.split(F.translate(F.lower(F.coalesce(squeeze(col), F.lit(""))), "ё", "е"), " ")
    return F.array_join(F.filter(F.transform(words_of, lambda w: F.btrim(w, F.lit(".,:;!?()[]{}\"'«»"))), lambda w: w != ""), " ")


def refined(query: Column, term: Column) -> Column:
    """The query with a term after it, unless it holds the term already."""
    asked, more = squeeze(F.coalesce(query, F.lit(""))), squeeze(F.coalesce(term, F.lit("")))
    held = F.contains(F.translate(F.lower(asked), "ё", "е"), F.translate(F.lower(more), "ё", "е"))
    return F.when(asked == "", more).when((more == "") | held, asked).otherwise(F.concat(asked, F.lit(" "), more))


def search_index(*cols: Column) -> Column:
    """One string of all forms and words of the given fields, each once, in order."""
    parts = [F.concat(F.array(normalize_text(c)), search_variants(c), words(c)) for c in cols]
    filled_parts = [F.when(c.isNotNull(), p).otherwise(F.array().cast("array<string>")) for c, p in zip(cols, parts, strict=True)]
    return F.array_join(F.array_distinct(F.filter(F.concat(*filled_parts), lambda v: v != "")), " ")


def digits_code(col: Column) -> Column:
    """A code of 8 to 14 digits, whatever stands between them, else null."""
    digits = F.regexp_replace(col, "[^0-9]", "")
    return F.when(F.length(digits).between(8, 14), digits)


def unicode_words(col: Column) -> Column:
    """Runs of letters and digits of any script, lower case."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def unescape(col: Column) -> Column:
    """Named entities (the table of the HTML standard, also without the final sign where that allows it) and numeric ones
    resolved in one pass; what is no entity stays. Texts without an ampersand are not touched."""
    entity = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"
    # one text of all entities: plans compare a text far faster than a map of the same entries
    table, key = F.lit(_ENTITIES), lambda name: F.concat(F.lit("\u0001"), name, F.lit("\u0002"))
    told = lambda name: F.when(F.contains(table, key(name)), F.substring_index(F.substr(table, F.position(key(name), table) + F.length(key(name))), "\u0001", 1))
    point = lambda v: F.decode(F.unhex(F.lpad(F.hex(F.when((v == 0) | (v > 0x10FFFF) | v.between(0xD800, 0xDFFF), 0xFFFD).otherwise(v)), 8, "0")), "UTF-32")
    letter = lambda v: F.coalesce(told(F.concat(F.lit("#"), v)), point(v))
    digits = lambda p: F.regexp_extract(p, "^&#[xX]?([0-9A-Fa-f]+)", 1)
    code = lambda p: F.when(p.rlike("^&#[xX]"), F.conv(digits(p), 16, 10).cast("bigint")).when(p.rlike("^&#"), digits(p).cast("bigint"))
    read = lambda p: F.when(~p.startswith("&"), p).when(p.startswith("&#"), F.coalesce(letter(code(p)), p)).otherwise(F.coalesce(told(F.substring(p, 2, 64)), p))
    return F.when(F.contains(col, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(col, F.lit(entity), F.lit(0)), read), "")).otherwise(col)


def comparable(col: Column) -> Column:
    """Entities resolved, single blanks, lower case, ё as е: the form in which markers of a name are looked for."""
    return F.translate(F.lower(squeeze(unescape(squeeze(col)))), "ё", "е")


def decimal_text(col: Column) -> Column:
    """A decimal without trailing zeros; null if it is no number."""
    text = col.try_cast("decimal(18,6)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def is_unknown_brand(col: Column) -> Column:
    return F.coalesce(normalize_text(col), F.lit("")).isin(*UNKNOWN_BRANDS)


def from_tag(col: Column) -> Column:
    """A taxonomy tag as text: language prefix off, hyphens and underscores as blanks, first letter large."""
    text = squeeze(F.regexp_replace(F.regexp_replace(squeeze(col), "^[a-z]{2}:", ""), "[-_]+", " "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 100000)))
