"""Best representative of each duplicate group: one surviving value per field, from the most complete, recent and trusted state.

Completeness, time and trust agree on the order of a product's states wherever they are known and credible. The best state
under a partly known order is the best by one of the three, so three map-side combined maxima per product and field keep
every possible winner, whatever the size of the group; the at most three candidates are then ranked in a window by how many
of the others they beat on what both know, then completeness, trust, time and card id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.runtime import blank_trim, small_broadcast

FIELDS = ("name", "product_name_ru", "barcode", "image_url")
#: Times outside these are not credible.
FIRST_TIME, LAST_TIME = "2000-01-01", "2050-01-01"
#: What stands in a field instead of a value, in lower case.
PLACEHOLDERS = [
    "-", "--", "—", "?", "???", ".", "0", "n/a", "na", "none", "null", "nan", "nil", "xxx", "test", "тест", "тест тест", "н/д", "нет", "нет данных",
    "без названия", "без имени", "название отсутствует", "уточняется", "не указано", "не указан", "товар", "штрихкод", "unknown", "no name", "untitled", "img.jpg", "no-image", "no_image",
]


def _readable(v: Column) -> Column:
    """Neither cut off nor garbled: no trailing dots, replacement characters, question marks inside words or UTF-8 read as Latin-1."""
    cut = v.rlike(r"(?:…|\.\.)$")
    garbled = v.rlike("�|\\?\\?|\\p{L}\\?\\p{L}|[\u0080-\u009f]|[ÐÑÃÂ][\u0080-¿]|[ÐÑ].*[ÐÑ]")
    return ~cut & ~garbled


def _ean13(v: Column) -> Column:
    digit = lambda k: F.substring(v, k, 1).try_cast("int")
    total = sum((digit(k) * (3 if k % 2 == 0 else 1) for k in range(2, 14)), digit(1))
    return F.coalesce(v.rlike(r"^[0-9]{13}$") & ~v.rlike(r"^(.)\1*$") & (total % 10 == 0), F.lit(False))


def usable(field: str, v: Column) -> Column:
    """Whether a trimmed value of ``field`` can survive."""
    plain = v.isNotNull() & (F.length(v) > 0) & ~F.lower(v).isin(*PLACEHOLDERS)
    if field == "barcode":
        return plain & _ean13(v)
    if field == "image_url":
        return plain & v.rlike(r"^(?i)https?://[^/\s]+\.[^/\s]+/\S+$") & ~F.lower(v).rlike(r"no[_-]?image|placeholder|/no[_-]?photo|…$|\.\.$|�")
    if field == "product_name_ru":
        return plain & v.rlike("[А-Яа-яЁё]") & _readable(v)
    return plain & v.rlike(r"\p{L}") & _readable(v)


def _keyed(states: DataFrame, trust: DataFrame) -> DataFrame:
    scaled = F.when((F.col("completeness") > 0) & (F.col("completeness") <= 1), F.col("completeness") * 100).when((F.col("completeness") > 1) & (F.col("completeness") <= 100), F.col("completeness"))
    credible = F.when((F.col("updated_at") >= F.lit(FIRST_TIME).cast("timestamp_ntz")) & (F.col("updated_at") < F.lit(LAST_TIME).cast("timestamp_ntz")), F.col("updated_at"))
    known = trust.select(F.lower(blank_trim(F.col("provider"))).alias("_p"), F.col("trust").alias("_t")).groupBy("_p").agg(F.max("_t").alias("_t"))
    own = states.select("product_id", "card_id", *FIELDS, F.round(scaled, 6).alias("_c"), credible.alias("_u"), F.lower(blank_trim(F.col("provider"))).alias("_p"))
    return own.join(small_broadcast(known), "_p", "left")


def surviving_fields(states: DataFrame, trust: DataFrame) -> DataFrame:
    """(product_id, field_name, val): for every product with two or more states, the surviving value of each field that has a usable one.

    Defined cases: states without product are left out; a product of one row gives nothing; a field without usable value
    gives no row; missing or incredible completeness, time or provider only remove that reason of preference; states sent
    twice count as states and change no winner; full ties go to the greater card id; an empty table gives an empty one.
    Extra columns do not matter."""
    keyed = _keyed(states.filter("product_id is not null"), trust)
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), blank_trim(F.col(f)).alias("val"), F.lit(k).alias("k")) for k, f in enumerate(FIELDS)])
    long = keyed.select("product_id", "card_id", "_c", "_u", "_t", F.explode(values).alias("_v")).select("product_id", "card_id", "_c", "_u", "_t", "_v.field_name", "_v.val")
    test = None
    for f in FIELDS:
        hit = F.col("field_name") == f
        test = F.when(hit, usable(f, F.col("val"))) if test is None else test.when(hit, usable(f, F.col("val")))
    state = F.struct("_c", "_u", "_t", "card_id", "val")
    good = F.coalesce(test, F.lit(False))
    # one shuffle on (product, field); each maximum is combined before it
    of = lambda c: F.when(F.col("_ok") & F.col(c).isNotNull(), F.col(c))
    marked = long.withColumn("_ok", good).withColumn("_kc", of("_c")).withColumn("_ku", of("_u")).withColumn("_kt", of("_t"))
    firsts = lambda k, *then: F.max_by(state, F.when(F.col(k).isNotNull(), F.struct(k, *then, "card_id", "val")))
    grouped = marked.groupBy("product_id", "field_name").agg(
        F.count(F.lit(1)).alias("_n"), firsts("_kc", "_kt", "_ku").alias("_b1"), firsts("_ku", "_kc", "_kt").alias("_b2"), firsts("_kt", "_kc", "_ku").alias("_b3"),
        F.max_by(state, F.when(F.col("_ok"), F.struct("card_id", "val"))).alias("_b4"),
    )
    few = F.array_distinct(F.array_compact(F.array("_b1", "_b2", "_b3")))
    few = F.when(F.size(few) == 0, F.array_compact(F.array("_b4"))).otherwise(few)
    candidates = grouped.filter("_n >= 2").select("product_id", "field_name", few.alias("_few")).select("product_id", "field_name", "_few", F.explode("_few").alias("_x"))

    def beats(x: Column, y: Column) -> Column:
        out = None
        for key in ("_c", "_u", "_t"):
            known = x[key].isNotNull() & y[key].isNotNull() & (x[key] != y[key])
            out = F.when(known, x[key] > y[key]) if out is None else out.when(known, x[key] > y[key])
        return F.coalesce(out, F.lit(False))

    ranked = candidates.withColumn("_wins", F.aggregate("_few", F.lit(0), lambda acc, y: acc + F.when(beats(F.col("_x"), y), 1).otherwise(0)))
    down = lambda c: F.col(c).desc_nulls_last()
    order = Window.partitionBy("product_id", "field_name").orderBy(down("_wins"), down("_x._c"), down("_x._t"), down("_x._u"), down("_x.card_id"), down("_x.val"))
    return ranked.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("product_id", "field_name", F.col("_x.val").alias("val"))
