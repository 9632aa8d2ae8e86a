"""Units of net content: fixed spellings and factors, and the expressions that read an amount out of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A blank of any kind, no-break and thin ones included.
BLANK = r"[\s\u00a0\u2000-\u200a\u202f\u3000]"

#: Fixed values: (base unit, thousandths of the base unit in one such unit, spellings in lower case without full stops).
UNITS = [
    ("г", "1", ["мг", "mg", "миллиграмм", "миллиграмма", "миллиграммов"]),
    ("г", "1000", ["г", "гр", "грамм", "грамма", "граммов", "g", "gr", "gram", "grams", "gramm"]),
    ("г", "1000000", ["кг", "кило", "килограмм", "килограмма", "килограммов", "kg", "kilogram", "kilograms"]),
    ("г", "28349.523125", ["oz", "ounce", "ounces", "унция", "унции", "унций"]),
    ("г", "453592.37", ["lb", "lbs", "pound", "pounds", "фунт", "фунта", "фунтов"]),
    ("мл", "1000", ["мл", "ml", "миллилитр", "миллилитра", "миллилитров", "milliliter", "millilitre"]),
    ("мл", "10000", ["сл", "cl", "сантилитр", "сантилитра", "сантилитров", "centiliter", "centilitre"]),
    ("мл", "100000", ["дл", "dl", "децилитр", "децилитра", "децилитров", "deciliter", "decilitre"]),
    ("мл", "1000000", ["л", "литр", "литра", "литров", "l", "lt", "ltr", "liter", "litre", "liters", "litres"]),
    ("мл", "29573.5295625", ["fl oz", "floz", "fluid ounce", "fluid ounces", "жидких унций"]),
    ("шт", "1000", ["шт", "штука", "штуки", "штук", "pc", "pcs", "piece", "pieces"]),
]
#: Words that say an amount without a number.
SPOKEN = {
    "полтора литра": "1.5 л", "пол-литра": "0.5 л", "поллитра": "0.5 л", "пол литра": "0.5 л", "полкило": "0.5 кг",
    "полкилограмма": "0.5 кг", "полтора килограмма": "1.5 кг", "два десятка": "20 шт", "полдюжины": "6 шт", "дюжина": "12 шт", "десяток": "10 шт",
}
#: Characters and written fractions.
FRACTIONS = {"½": "5", "¼": "25", "¾": "75"}
_WRITTEN = {"1/2": "0.5", "1/4": "0.25", "3/4": "0.75"}

_SPELLED = sorted({s for _, _, words in UNITS for s in words}, key=lambda s: (-len(s), s))
_U = r"(fl\.? ?oz|" + "|".join(s for s in _SPELLED if s not in ("fl oz", "floz")) + r")(?!\p{L})\.?"
_PIECES = r"(?:шт(?:ук[аи]?)?|pcs?|pieces?)(?!\p{L})\.?"
_PACK = r"(?:" + _PIECES + r"|(?:уп(?:аков[а-я]*)?|пак(?:ет[а-я]*)?|бут(?:ыл[а-я]*)?|бан(?:к[а-я]*)?|packs?|bottles?|cans?)(?!\p{L})\.?)"
_N = r"(?<![\p{L}\p{N}.,/])(\p{N}+(?:[.,]\p{N}+)?)"
_TIMES = r"\s*[xх×*]\s*"

#: Packs before content, content before packs, "each ..., count", compound of two units, one amount.
COUNT_FIRST = rf"{_N}\s*{_PACK}?(?:{_TIMES}|\s*(?:по|of)\s+)(\p{{N}}+(?:[.,]\p{{N}}+)?)\s*{_U}"
COUNT_LAST = rf"{_N}\s*{_U}{_TIMES}(\p{{N}}+)(?![\p{{N}}%.,])"
EACH = rf"(?<!\p{{L}})по\s+(\p{{N}}+(?:[.,]\p{{N}}+)?)\s*{_U},?\s*(\p{{N}}+)\s*{_PACK}"
COMPOUND = rf"{_N}\s*{_U}\s*(\p{{N}}+(?:[.,]\p{{N}}+)?)\s*{_U}"
SINGLE = rf"{_N}\s*{_U}"

#: thousandths per unit, 7 decimals; decimals keep halves exact
FACTOR, MILLI = "decimal(16,7)", "decimal(38,13)"


def unit_key(unit: Column) -> Column:
    """A unit spelling folded for lookup: lower case, no full stops, single blanks."""
    key = F.regexp_replace(F.regexp_replace(F.lower(unit), r"\.", ""), rf"{BLANK}+", " ")
    return F.trim(F.when(key.isin("floz", " floz"), F.lit("fl oz")).otherwise(key))


def unit_of(unit: Column) -> Column:
    """struct(base, factor) of a spelling, null if it is no unit; ``factor`` is thousandths of the base unit in one unit."""
    pairs = [x for base, factor, words in UNITS for w in words for x in (F.lit(w), F.struct(F.lit(base).alias("base"), F.lit(factor).cast(FACTOR).alias("factor")))]
    return F.try_element_at(F.create_map(*pairs), unit_key(unit))


def plain_text(text: Column) -> Column:
    """Lower case, single blanks, fractions and thousands as plain decimal numbers, spoken amounts as numbers."""
    out = F.lower(F.regexp_replace(text, rf"{BLANK}+", " "))
    for word, amount in SPOKEN.items():
        out = F.regexp_replace(out, rf"(?<!\p{{L}}){word}(?!\p{{L}})", amount)
    for sign, digits in FRACTIONS.items():
        out = F.regexp_replace(out, rf"(?<=\p{{N}}) ?{sign}", f".{digits}")
        out = F.replace(out, F.lit(sign), F.lit(f"0.{digits}"))
    for written, decimal in _WRITTEN.items():
        out = F.regexp_replace(out, rf"(?<=\p{{N}}) {written}(?![\p{{N}}/])", decimal[1:])
        out = F.regexp_replace(out, rf"(?<![\p{{N}}/.,]){written}(?![\p{{N}}/])", decimal)
    return F.regexp_replace(out, r"(?<![\p{N}.,])(\p{N}{1,3}) (?=\p{N}{3}(?!\p{N}))", "$1")


def number(text: Column, scale: int = 6) -> Column:
    """A plain number with decimal comma or point, null if it is none."""
    return F.when(F.trim(text).rlike(r"^\p{N}{1,8}(?:[.,]\p{N}+)?$"), F.replace(F.trim(text), F.lit(","), F.lit("."))).try_cast(f"decimal(14,{scale})")


def with_amount(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out`` = struct(base, milli): the net content stated in column ``text``, or null.

    Remarks in brackets repeat or explain the amount and are read only if nothing stands outside them; what follows
    "без жидкости" (drained weight) is not the net content as sold. Each step is a column of its own, so that no
    expression is repeated inside another."""
    one = F.lit("1")
    g = lambda pattern, *at: F.array(*[F.regexp_extract("_t", pattern, k) if k else F.lit("") for k in at])
    plain = df.withColumn("_plain", F.regexp_replace(plain_text(F.col(text)), r"без жидкости.*$", ""))
    outside = plain.withColumn("_out", F.regexp_replace("_plain", r"\([^()]*\)", " "))
    chosen = outside.withColumn("_t", F.when(F.col("_out").rlike(SINGLE), F.col("_out")).otherwise(F.col("_plain")))
    # value, unit, count, second value, second unit
    groups = (
        F.when(F.col("_t").rlike(EACH), g(EACH, 1, 2, 3, 0, 0)).when(F.col("_t").rlike(COUNT_FIRST), g(COUNT_FIRST, 2, 3, 1, 0, 0))
        .when(F.col("_t").rlike(COUNT_LAST), g(COUNT_LAST, 1, 2, 3, 0, 0)).when(F.col("_t").rlike(COMPOUND), g(COMPOUND, 1, 2, 0, 3, 4))
        .when(F.col("_t").rlike(SINGLE), g(SINGLE, 1, 2, 0, 0, 0))
    )
    read = chosen.withColumn("_g", groups).withColumn("_u1", unit_of(F.col("_g")[1])).withColumn("_u2", unit_of(F.col("_g")[4]))
    count = number(F.coalesce(F.nullif(F.col("_g")[2], F.lit("")), one), 2).try_cast("decimal(7,2)")
    first = number(F.col("_g")[0]) * F.col("_u1.factor") * count
    rest = F.when((F.col("_u1.base") == F.col("_u2.base")) & (F.col("_u2.factor") < F.col("_u1.factor")), number(F.col("_g")[3]) * F.col("_u2.factor") * F.lit("1").cast("decimal(7,2)"))
    milli = (first + F.coalesce(rest, F.lit(0).cast("decimal(2,1)"))).try_cast(MILLI)
    amount = F.when((milli > 0) & F.col("_u1").isNotNull(), F.struct(F.col("_u1.base").alias("base"), milli.alias("milli")))
    return read.withColumn(out, amount).drop("_plain", "_out", "_t", "_g", "_u1", "_u2")


def rounded_milli(milli: Column) -> Column:
    """Whole thousandths, halves up."""
    return F.floor(milli + F.lit("0.5").cast("decimal(3,1)")).try_cast("bigint")
