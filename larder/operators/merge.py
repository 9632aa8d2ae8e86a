"""Incoming records against the catalogue: match by an ordered cascade, then keep the better value of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import identity as I
from larder.functions import text as T
from larder.runtime import Scratch

#: How much better a name, description or image must be to replace the present one.
NAME_STEP, DESCRIPTION_STEP, IMAGE_STEP = 15, 15, 20
#: Least score of a similar name, its least lead over the second best, and the least coverage and Jaccard of a candidate.
SIMILAR_LEAST, SIMILAR_LEAD, COVERAGE_LEAST, JACCARD_LEAST = 0.78, 0.12, 0.80, 0.55
#: Fixed value: the brand of a record that names none.
NO_BRAND = "Бренд не указан"
_STAGES = ["source_link", "barcode", "brand_and_name", "brand_and_similar_name", "name"]


def _have(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _shape(df: DataFrame, key: str) -> DataFrame:
    """What the stages compare, with ``k``: one text for rows alike in all of it but the code, of which only ``coded`` counts."""
    unit, name = I.package_unit(F.col("package_unit")), F.coalesce("name", F.lit(""))
    brand = F.coalesce(T.filled(F.col("brand")), F.lit(NO_BRAND))
    rows = df.select(
        F.col(key), T.digits_code(F.col("barcode")).alias("code"), T.normalize_text(T.squeeze(name)).alias("n"), T.normalize_text(brand).alias("b"), T.is_unknown_brand(brand).alias("nobrand"), I.is_generic_name(name).alias("plain"),
        F.filter(T.unicode_words(T.comparable(brand)), lambda w: F.length(w) >= 3).alias("bt"), I.variant_tokens(name, F.lit(None).cast("string"), "merge").alias("vr"), I.name_tokens(name).alias("w"),
        I.percentages(name).alias("pct"), I.counts(name).alias("cnt"), I.name_packages(name, "merge").alias("pk"), I.numeric_markers(name).alias("num"),
        I.package_family(unit).alias("family"), I.package_base(F.col("package_value"), unit).alias("base"), I.category_key(_have(df, "category")).alias("cat"), I.is_generic_category(_have(df, "category")).alias("nocat"),
    )
    rows = rows.withColumn("coded", F.col("code").isNotNull()).withColumn("v", F.array_sort(F.array_except("vr", "bt")))
    return rows.withColumn("k", F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in (key, "code")])))


def _guard(brand_tokens: Column) -> Column:
    """Whether the names of a pair (n_..., o_...) may stand for one item: no differing numbers, and the same variant words."""
    clash = [F.coalesce(I.sets_conflict(F.col(f"o_{c}"), F.col(f"n_{c}")), F.lit(False)) for c in ("pct", "cnt", "pk", "num")]
    left, right = F.array_sort(F.array_except("o_vr", brand_tokens)), F.array_sort(F.array_except("n_vr", brand_tokens))
    return ~(clash[0] | clash[1] | clash[2] | clash[3]) & (left == right)


def _package() -> Column:
    return I.packages_compatible(F.col("o_base"), F.col("o_family"), F.col("n_base"), F.col("n_family"))


def match_cascade(incoming: DataFrame, catalogue: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(rec_id, product_id, stage, match_type): the listing of each record; the first stage that finds one counts.

    1 ``source_link``: the listing that ``links`` (provider, source_id, product_id) names; 2 ``barcode``: the smallest id with the
    code; 3 ``brand_and_name``: the single listing of the brand and name whose package, code and name markers do not conflict;
    4 ``brand_and_similar_name``: the best of a known brand by shared words if it leads clearly; 5 ``name``: as 3 without brand,
    unless both brands are known and differ. Records without match are left out.

    ``incoming`` has rec_id, name, brand, barcode, package_value, package_unit and may have category, provider, source_id;
    ``catalogue`` the same with id. Later stages see only records without match, whose code is in no listing, so only whether a
    listing has a code counts there: rows alike in all else are one class with its size, copies are compared once, and every
    stage is an equi-join on the name or on brand and variant words. Null names or brands match nothing but by code or link."""
    scratch = Scratch(incoming.sparkSession, "match")  # what the stages compare is read from each row once
    new, old = scratch.save(_shape(incoming, "rec_id"), "new"), scratch.save(_shape(catalogue, "id"), "old")
    tagged = lambda df, stage: df.select("rec_id", "product_id", F.lit(stage).alias("stage"))
    found = []
    if links is not None:
        key = lambda df: df.withColumns({"provider": T.squeeze(F.col("provider")), "source_id": T.squeeze(F.col("source_id"))}).filter("provider <> '' and source_id <> ''")
        listed = key(links).join(catalogue.select(F.col("id").alias("product_id")), "product_id", "left_semi").groupBy("provider", "source_id").agg(F.min("product_id").alias("product_id"))
        found.append(tagged(key(incoming.select("rec_id", "provider", "source_id")).join(listed, ["provider", "source_id"]), 1))
    by_code = old.filter("code is not null").groupBy("code").agg(F.min("id").alias("product_id"))
    found.append(tagged(new.join(by_code, "code"), 2))
    rest = new
    for f in found:
        rest = rest.join(f.select("rec_id"), "rec_id", "left_anti")
    asked = rest.dropDuplicates(["k"]).drop("rec_id", "code")
    known = old.groupBy("k").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many")).join(old.dropDuplicates(["k"]).drop("id", "code"), "k")
    n = asked.select(*[F.col(c).alias(f"n_{c}") for c in asked.columns])
    o = known.select(*[F.col(c).alias(f"o_{c}") for c in known.columns])
    fits = F.coalesce(_package(), F.lit(True)) & ~(F.col("n_coded") & F.col("o_coded"))  # a code of a record left over is in no listing
    named = F.col("n_n") != ""

    def single(met: DataFrame) -> DataFrame:
        return met.groupBy("n_k").agg(F.sum("o_many").alias("c"), F.min("o_id").alias("product_id")).filter("c = 1").drop("c")

    third = single(n.filter(named).join(o, (F.col("n_b") == F.col("o_b")) & (F.col("n_n") == F.col("o_n"))).filter(fits & _guard(F.col("o_bt"))))
    category = (F.col("n_cat") == "") | F.col("n_nocat") | F.col("o_nocat") | (F.col("n_cat") == F.col("o_cat"))
    similar = n.filter(~F.col("n_nobrand") & (F.size("n_w") >= 2)).join(o, (F.col("n_b") == F.col("o_b")) & (F.col("n_v") == F.col("o_v"))).filter(fits & category & _guard(F.col("o_bt")))
    common, coverage, jaccard = I.overlap(F.col("n_w"), F.col("o_w"))
    scored = similar.withColumns({"_s": common, "_c": coverage, "_j": jaccard}).filter((F.col("_s") >= 2) & (F.col("_c") >= COVERAGE_LEAST) & (F.col("_j") >= JACCARD_LEAST))
    scored = scored.withColumn("score", F.least(F.col("_c") * 0.65 + F.col("_j") * 0.35 + F.when(F.coalesce(_package(), F.lit(False)), 0.08).otherwise(0.0), F.lit(1.0)))
    best = scored.groupBy("n_k").agg(F.max_by(F.struct("o_id", "o_many", "score"), F.struct("score", (-F.col("o_id")).alias("x"))).alias("t"))
    # the second best: a copy of the best, another class of its score, or the next lower score
    tops = scored.join(best.select("n_k", F.col("t.score").alias("top"), F.col("t.o_id").alias("first")), "n_k").filter("o_id <> first").groupBy("n_k").agg(F.max("score").alias("second"))
    lead = best.join(tops, "n_k", "left").withColumn("second", F.when(F.col("t.o_many") > 1, F.col("t.score")).otherwise(F.col("second")))
    fourth = lead.filter((F.col("t.score") >= SIMILAR_LEAST) & (F.col("second").isNull() | (F.col("t.score") - F.col("second") >= SIMILAR_LEAD))).select("n_k", F.col("t.o_id").alias("product_id"))
    brands = F.col("n_nobrand") | F.col("o_nobrand") | (F.col("n_b") == F.col("o_b"))
    fifth = single(n.filter(named & ~F.col("n_plain")).join(o, F.col("n_n") == F.col("o_n")).filter(fits & brands & _guard(F.col("o_bt"))))
    by_class = third.withColumn("stage", F.lit(3)).unionByName(fourth.withColumn("stage", F.lit(4))).unionByName(fifth.withColumn("stage", F.lit(5)))
    first = by_class.groupBy("n_k").agg(F.min(F.struct("stage", "product_id")).alias("m")).select(F.col("n_k").alias("k"), "m.product_id", "m.stage")
    out = rest.select("rec_id", "k").join(first, "k").select("rec_id", "product_id", "stage")
    for f in found:
        out = out.unionByName(f)
    one = out.groupBy("rec_id").agg(F.min(F.struct("stage", "product_id")).alias("m")).select("rec_id", "m.product_id", "m.stage")
    return one.withColumn("match_type", F.get(F.array(*[F.lit(s) for s in _STAGES]), F.col("stage") - 1))


def better_name(current: Column, incoming: Column) -> Column:
    """The incoming name if the present one is empty or only a kind of goods, or if both share words and the new is clearly better."""
    have, new = T.filled(current), T.filled(incoming)
    plain = I.is_generic_name(have)
    gains = (plain | (I.text_similarity(have, new) >= 0.2)) & (I.name_quality(new) >= I.name_quality(have) + NAME_STEP)
    takes = F.when(new.isNull(), False).when(have.isNull(), True).when(T.normalize_text(have) == T.normalize_text(new), False).otherwise((plain & ~I.is_generic_name(new)) | gains)
    return F.when(takes, new).otherwise(current)


def better_description(current: Column, incoming: Column) -> Column:
    """The incoming description if the present one is empty or clearly worse."""
    takes = T.filled(incoming).isNotNull() & (T.filled(current).isNull() | (I.description_quality(incoming) >= I.description_quality(current) + DESCRIPTION_STEP))
    return F.when(takes, T.squeeze(incoming)).otherwise(current)


def better_image(current: Column, incoming: Column) -> Column:
    """The incoming image if the present one is empty or clearly worse."""
    takes = T.filled(incoming).isNotNull() & (T.filled(current).isNull() | (I.image_quality(incoming) >= I.image_quality(current) + IMAGE_STEP))
    return F.when(takes, T.squeeze(incoming)).otherwise(current)


def joined_keywords(current: Column, incoming: Column) -> Column:
    """Comma or semicolon lists as one, each keyword once by its normal form, in order; one empty list leaves the other as it is."""
    have, new = T.filled(current), T.filled(incoming)
    split = lambda c: F.filter(F.transform(F.split(c, "[,;]"), lambda v: F.trim(v)), lambda v: v != "")
    pieces = lambda c: F.when(F.size(split(c)) == 1, F.array(c)).otherwise(split(c))
    parts = F.filter(F.concat(pieces(have), pieces(new)), lambda v: T.normalize_text(v) != "")
    kept = F.filter(parts, lambda v, i: ~F.exists(F.slice(parts, F.lit(1), i), lambda u: T.normalize_text(u) == T.normalize_text(v)))
    return F.when(have.isNotNull() & new.isNotNull(), F.nullif(F.array_join(kept, ", "), F.lit(""))).otherwise(F.coalesce(have, new))


def search_text(*fields: Column) -> Column:
    """The normal forms of the fields that are there, with single blanks between."""
    return F.array_join(F.filter(F.array(*[T.normalize_text(f.cast("string")) for f in fields]), lambda v: v.isNotNull() & (v != "")), " ")


_FIELDS = [("name", "string"), ("brand", "string"), ("category", "string"), ("barcode", "string"), ("package_value", "decimal(10,3)"), ("package_unit", "string"), ("subtype", "string"), ("description", "string"), ("image_url", "string"), ("keywords", "string"), ("family_id", "bigint")]


def merge_fields(matched: DataFrame, consolidating: bool = False) -> DataFrame:
    """(product_id, every field, search_text, changed, conflicts): listings with an incoming record each (columns with ``new_``) merged
    field by field. ``changed`` names the fields that changed, ``conflicts`` those whose two values differ and were left.

    A better name, description or image replaces; code, package, subtype and family are only filled, a known brand and a
    telling category only replace an unknown and a generic one, keywords are joined. A package that differs fills nothing.
    With ``consolidating`` the record is a duplicate to merge, whose conflicts but that of the subtype were tested before.
    Fields that the rows lack count as null on that side."""
    at = lambda p, c, kind: _have(matched, f"{p}{c}", kind)
    base = matched.select("product_id", *[at(p, c, kind).alias(f"{p}{c}") for p in ("", "new_") for c, kind in _FIELDS])
    now, new = (lambda c: F.col(c)), (lambda c: F.col(f"new_{c}"))
    unit, new_unit = I.package_unit(now("package_unit")), I.package_unit(new("package_unit"))
    compatible = I.packages_compatible(I.package_base(now("package_value"), unit), I.package_family(unit), I.package_base(new("package_value"), new_unit), I.package_family(new_unit))
    fits, code, new_code = F.coalesce(compatible, F.lit(True)), T.digits_code(now("barcode")), T.digits_code(new("barcode"))
    value = F.when(new("package_value") > 0, new("package_value"))
    unknown, new_unknown = T.is_unknown_brand(now("brand")), T.is_unknown_brand(new("brand"))
    generic, new_generic = now("category").isNull() | I.is_generic_category(now("category")), I.is_generic_category(new("category"))
    category = F.when(generic & new("category").isNotNull() & (F.lit(not consolidating) | ~new_generic), new("category")).otherwise(now("category"))
    merged = {
        "name": better_name(now("name"), new("name")), "brand": F.when(unknown & ~new_unknown, new("brand")).otherwise(now("brand")), "category": category,
        "barcode": F.when(code.isNull() & new_code.isNotNull(), new_code).otherwise(now("barcode")), "package_value": F.when(fits & now("package_value").isNull(), value).otherwise(now("package_value")),
        "package_unit": F.when(fits & (F.coalesce(now("package_unit"), F.lit("")) == "") & new_unit.isNotNull(), new_unit).otherwise(now("package_unit")),
        "subtype": F.when(T.filled(now("subtype")).isNull() & T.filled(new("subtype")).isNotNull(), T.squeeze(new("subtype"))).otherwise(now("subtype")),
        "description": better_description(now("description"), new("description")), "image_url": better_image(now("image_url"), new("image_url")),
        "keywords": F.coalesce(joined_keywords(now("keywords"), new("keywords")), now("keywords")), "family_id": F.coalesce(now("family_id"), new("family_id")),
    }
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    tag = lambda test, name: F.when(test, F.lit(name))
    subtype = tag(differ(F.nullif(T.normalize_text(now("subtype")), F.lit("")), F.nullif(T.normalize_text(new("subtype")), F.lit(""))), "subtype_conflict")
    others = [] if consolidating else [
        tag(differ(code, new_code), "barcode_conflict"), tag(~fits, "package_conflict"), tag(differ(now("family_id"), new("family_id")), "family_conflict"),
        tag(~unknown & ~new_unknown & differ(T.normalize_text(now("brand")), T.normalize_text(new("brand"))), "brand_conflict"),
        tag(~generic & ~new_generic & new("category").isNotNull() & differ(I.category_key(now("category")), I.category_key(new("category"))), "category_conflict"),
    ]
    staged = base.withColumn("_m", F.struct(*[v.alias(c) for c, v in merged.items()])).withColumn("conflicts", F.array_compact(F.array(*others, subtype)))
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_m.{c}")), F.lit(c)) for c, _ in _FIELDS]))
    told = staged.select("product_id", "_m.*", changed.alias("changed"), "conflicts")
    order = ["name", "brand", "category", "subtype", "keywords", "description", "package_value", "package_unit", "barcode"]
    return told.withColumn("search_text", search_text(*[F.col(c) for c in order]))


def created_fields(rows: DataFrame) -> DataFrame:
    """(id, fields): the fields a new listing came with; name, brand and category always count."""
    optional = ["family_id", "barcode", "package_value", "package_unit", "subtype", "description", "image_url", "keywords", "search_text"]
    there = [F.when(F.trim(F.col(c).cast("string")) != "", F.lit(c)) for c in optional if c in rows.columns]
    return rows.select("id", F.array_compact(F.array(F.lit("name"), F.lit("brand"), F.lit("category"), *there)).alias("fields"))


def link_sources(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """(provider, source_id, product_id, source_url, status): links after records (rec_id, product_id, provider, source_id, source_url).

    A link never moves to another product: a record of another product is a ``conflict`` and changes nothing; one of the same
    product with another address is ``updated`` by the last of them; unseen pairs are ``inserted`` for the first record's
    product; the rest is ``kept``. Records without provider or id make no link. Each pair gives one row; ``links`` is unique."""
    clean = incoming.select("rec_id", "product_id", T.squeeze(F.col("provider")).alias("provider"), T.squeeze(F.col("source_id")).alias("source_id"), T.filled(F.col("source_url")).alias("url")).filter("provider <> '' and source_id <> ''")
    key = ["provider", "source_id"]
    have = links.select(*key, F.col("product_id").alias("_p"), F.col("source_url").alias("_u"))
    firsts = clean.groupBy(*key).agg(F.min_by("product_id", "rec_id").alias("_f"))
    owner = firsts.join(have, key, "full").withColumn("owner", F.coalesce("_p", "_f")).drop("_f")
    told = owner.join(clean, key, "left").groupBy(*key, "owner", "_p", "_u").agg(
        F.max_by(F.when(F.col("product_id") == F.col("owner"), F.col("url")), F.when((F.col("product_id") == F.col("owner")) & F.col("url").isNotNull(), F.col("rec_id"))).alias("url"), F.max((F.col("product_id") != F.col("owner")).cast("int")).alias("other")
    )
    renewed = F.col("url").isNotNull() & ~F.col("url").eqNullSafe(F.col("_u"))
    status = F.when(F.col("_p").isNull(), "inserted").when(renewed, "updated").when(F.col("other") == 1, "conflict").otherwise("kept")
    return told.select(*key, F.col("owner").alias("product_id"), F.coalesce("url", "_u").alias("source_url"), status.alias("status"))


def new_names(known: DataFrame, names: DataFrame) -> DataFrame:
    """(name, normalized_name): the names whose normal form ``known`` (name) lacks, each form once with its smallest spelling."""
    form = lambda df: df.select(T.squeeze(F.col("name")).alias("name")).withColumn("normalized_name", T.normalize_text(F.col("name"))).filter("normalized_name <> ''")
    fresh = form(names).groupBy("normalized_name").agg(F.min("name").alias("name"))
    return fresh.join(form(known).select("normalized_name").distinct(), "normalized_name", "left_anti").select("name", "normalized_name")
