"""Cards and candidates of providers: what a card lacks, how well a candidate answers a query, which queries fill a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import identity as I
from larder.functions import text as T
from larder.runtime import small_broadcast

#: Points of a candidate for the whole phrase, an image, a brand and a name.
PHRASE, IMAGE, BRAND, NAME = 0.20, 0.08, 0.07, 0.05


def tokens(col: Column) -> Column:
    """Distinct words of two or more letters of the normal form."""
    return F.array_distinct(F.filter(F.split(T.normalize_text(col), " "), lambda w: F.length(w) >= 2))


def matched(asked: Column, have: Column) -> tuple[Column, Column]:
    """(exact, partial): asked words that are among ``have``, and others of four or more letters that contain or are contained in one."""
    exact = F.array_intersect(asked, have)
    rest = F.array_except(asked, have)
    near = F.filter(rest, lambda w: (F.length(w) >= 4) & F.exists(have, lambda h: (F.length(h) >= 4) & (F.contains(h, w) | F.contains(w, h))))
    return F.size(exact), F.size(near)


def relevance(query: Column, text: Column, image: Column, brand: Column, name: Column) -> Column:
    """0 to 1: the share of the query's words met, a partial one half, and points for phrase, image, brand and name."""
    asked, have = tokens(query), tokens(text)
    exact, near = matched(asked, have)
    points = (exact + near * 0.5) / F.size(asked)
    bonus = lambda test, value: F.when(test, value).otherwise(0.0)
    whole = bonus(F.contains(T.normalize_text(text), T.normalize_text(query)), PHRASE)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.least(points + whole + bonus(T.filled(image).isNotNull(), IMAGE) + bonus(T.filled(brand).isNotNull(), BRAND) + bonus(T.filled(name).isNotNull(), NAME), F.lit(1.0)))


#: Parts of an address that show a placeholder.
PLACEHOLDERS = ["placeholder", "no-image", "no_image", "default-product", "default_product", "image-not-found", "image_not_found", "stub"]
#: Names that are no more than a kind of goods on a card, and the order in which a card's fields are to be filled.
PLAIN_NAMES = [n for n in I.GENERIC_NAMES if n not in ("пельмени", "вареники")]
PRIORITY = ["brand", "name", "package", "category", "image_url", "barcode", "description", "subtype", "keywords"]
#: Greatest difference of the packages of a card and of a candidate to fill it, as a share of the larger.
TARGET_TOLERANCE = "0.005"


def _folded(col: Column) -> Column:
    """Single blanks, lower case, ё as е; signs stay. Empty for null."""
    return F.translate(F.lower(F.coalesce(T.squeeze(col), F.lit(""))), "ё", "е")


def is_specific_name(col: Column) -> Column:
    """Two words or twelve letters, and more than a kind of goods."""
    name = _folded(col)
    words = F.size(F.regexp_extract_all(name, F.lit("[a-zа-я0-9]+"), F.lit(0)))
    return (name != "") & ~name.isin(*PLAIN_NAMES) & ((words >= 2) | (F.length(name) >= 12))


def card_image_points(col: Column, valid: Column | None = None) -> Column:
    """0 none, 10 a placeholder, 40 a web address not looked at, 100 a valid and 0 an invalid one, 90 another identifier."""
    image, checked = _folded(col), valid if valid is not None else F.lit(None).cast("boolean")
    web = T.squeeze(col).rlike("^https?://")
    placeholder = F.exists(F.array(*[F.lit(m) for m in PLACEHOLDERS]), lambda m: F.contains(image, m))
    return F.when(image == "", 0.0).when(placeholder, 10.0).when(web & checked, 100.0).when(web & ~checked, 0.0).when(web, 40.0).otherwise(90.0)


def card_description_points(col: Column) -> Column:
    n = F.coalesce(F.length(T.squeeze(col)), F.lit(0))
    return F.when(n == 0, 0.0).when(n < 20, 25.0).when(n < 60, 55.0).when(n < 140, 80.0).otherwise(100.0)


def evaluate_cards(cards: DataFrame, *kept: str) -> DataFrame:
    """(id, ``kept`` columns, score, identity, presentation, missing, weak, critical, next, unchecked, complete): how complete each card is.

    ``cards`` has id, name, brand, category, barcode, package_value, package_unit, image_url, description, subtype, keywords and
    may have image_valid. ``missing`` fields are empty, ``weak`` ones there but say little, ``critical`` those of both that a
    card cannot do without, ``next`` all of both in the order in which to fill them."""
    filled = lambda c: T.filled(F.col(c)).isNotNull()
    staged = cards.withColumns({
        "_value": F.coalesce(F.col("package_value") > 0, F.lit(False)), "_unit": filled("package_unit"), "_specific": is_specific_name(F.col("name")), "_code": T.digits_code(F.col("barcode")).isNotNull(),
        "_real": filled("brand") & ~_folded(F.col("brand")).isin(*T.UNKNOWN_BRANDS), "_cat": filled("category") & ~_folded(F.col("category")).isin(*I.GENERIC_CATEGORIES),
        "_image": card_image_points(F.col("image_url"), F.col("image_valid") if "image_valid" in cards.columns else None), "_text": card_description_points(F.col("description")),
    })
    whole, some = F.col("_value") & F.col("_unit"), F.col("_value") | F.col("_unit")
    image, text = F.col("_image"), F.col("_text")
    # field: (is missing, is weak, points of a weak one, points of a good one)
    fields = {
        "name": (~filled("name"), filled("name") & ~F.col("_specific"), F.lit(6.0), F.lit(15.0)), "brand": (~filled("brand"), filled("brand") & ~F.col("_real"), F.lit(2.0), F.lit(12.0)),
        "category": (~filled("category"), filled("category") & ~F.col("_cat"), F.lit(3.0), F.lit(10.0)), "package": (~some, some & ~whole, F.lit(5.0), F.lit(15.0)),
        "image_url": (image <= 0, (image > 0) & (image < 50), F.lit(3.0), image * 0.15), "description": (text <= 0, (text > 0) & (text < 60), text * 0.12, text * 0.12),
        "barcode": (~filled("barcode"), filled("barcode") & ~F.col("_code"), F.lit(2.0), F.lit(12.0)), "subtype": (~filled("subtype"), F.lit(False), F.lit(0.0), F.lit(4.0)), "keywords": (~filled("keywords"), F.lit(False), F.lit(0.0), F.lit(5.0)),
    }
    named = lambda at, keys: F.array_compact(F.array(*[F.when(at(fields[k]), F.lit(k)) for k in keys]))
    score = sum((F.when(gone, 0.0).when(weak, low).otherwise(high) for gone, weak, low, high in fields.values()), F.lit(0.0))
    points = lambda *pairs: sum((F.when(test, float(n)).otherwise(0.0) for test, n in pairs), F.lit(0.0))
    identity = points((F.col("_code"), 45), (F.col("_real"), 20), (F.col("_specific"), 20), (whole, 15))
    shown = points((F.col("_specific"), 20), (~F.col("_specific") & filled("name"), 8), (F.col("_real"), 15), (F.col("_cat"), 15), (whole, 15)) + image * 0.2 + text * 0.15
    critical = ["name", "brand", "category", "package", "image_url"]
    checked = F.col("image_valid").isNotNull() if "image_valid" in cards.columns else F.lit(False)
    out = staged.select(
        "id", *kept, F.bround(F.least(score, F.lit(100.0)), 1).alias("score"), F.bround(F.least(identity, F.lit(100.0)), 1).alias("identity"), F.bround(F.least(shown, F.lit(100.0)), 1).alias("presentation"),
        named(lambda f: f[0], fields).alias("missing"), named(lambda f: f[1], fields).alias("weak"), named(lambda f: f[0] | f[1], critical).alias("critical"), named(lambda f: f[0] | f[1], PRIORITY).alias("next"),
        (filled("image_url") & T.squeeze(F.col("image_url")).rlike("^https?://") & ~checked).alias("unchecked"),
    )
    whole_card = (F.size("critical") == 0) & ~F.col("unchecked") & (F.col("score") >= 85) & (F.col("identity") >= 55) & (F.col("presentation") >= 80)
    return out.withColumn("complete", whole_card)


_STATED = ("name", "brand", "barcode", "package_value", "package_unit")


def identity_side(prefix: str = "") -> Column:
    """All that ``candidate_identity`` reads of the card, or with ``new_`` of the record: read once before the two are joined."""
    name, brand, barcode, value, unit = [F.col(f"{prefix}{c}") for c in _STATED]
    standard = I.package_unit(unit)
    return F.struct(
        I.name_tokens(name).alias("words"), T.digits_code(barcode).alias("code"), (~T.is_unknown_brand(brand)).alias("real"), T.normalize_text(brand).alias("brand"),
        I.package_base(value, standard).alias("base"), I.package_family(standard).alias("family"), (value.isNotNull() & _has(unit)).alias("packed"),
    )


def _has(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def judged(pairs: DataFrame, card: Column, record: Column, needed: Column, pictured: Column, described: Column) -> DataFrame:
    """``pairs`` with ``_t``, (accepted, points, why) of a card and a record, both as ``identity_side`` reads them, by the first rule that holds.

    Names are compared only where code, brand and package do not decide."""
    base, new_base = card["base"], record["base"]
    near = F.abs(base - new_base) <= F.greatest(base, new_base) * F.lit(TARGET_TOLERANCE).cast("decimal(4,3)")
    package = F.when(base.isNotNull() & new_base.isNotNull(), F.when(card["family"] != record["family"], False).otherwise(near))
    codes = card["code"] == record["code"]
    brands = card["real"] & record["real"] & (card["brand"] != record["brand"])
    decided = F.when(~codes, "barcode_conflict").when(brands, "brand_conflict").when(~package, "package_conflict")
    names = dict(zip(("common", "coverage", "jaccard"), I.overlap(card["words"], record["words"]), strict=True))
    staged = pairs.withColumns({"_why": decided, "_package": F.coalesce(package, F.lit(False))})
    staged = staged.withColumn("_names", F.when(F.col("_why").isNull(), F.struct(*[c.alias(n) for n, c in names.items()])))
    common, coverage, jaccard = [F.col(f"_names.{n}") for n in names]
    same = F.coalesce(codes, F.lit(False))
    gives = lambda field, there, n: F.when(F.array_contains(needed, field) & there, float(n)).otherwise(0.0)
    told = lambda ok, points, why: F.struct(F.lit(ok).alias("accepted"), points.alias("points"), F.lit(why).alias("why"))
    no = lambda why: told(False, F.lit(0.0), why)
    by_code = F.lit(100.0) + F.when(pictured, 3.0).otherwise(0.0) + F.when(described, 1.0).otherwise(0.0)
    by_name = F.lit(55.0) + coverage * 20 + jaccard * 15 + F.when(F.col("_package"), 10.0).otherwise(0.0) + gives("image_url", pictured, 5) + gives("description", described, 2)
    first = (
        F.when(F.col("_why").isNotNull(), F.struct(F.lit(False).alias("accepted"), F.lit(0.0).alias("points"), F.col("_why").alias("why")))
        .when(same & (common <= 0) & (coverage < 0.5), no("barcode_name_mismatch")).when(same, told(True, by_code, "exact_barcode"))
        .when(card["real"] & ~record["real"], no("missing_external_brand")).when(~card["real"] & ~record["real"], no("no_brand_evidence"))
        .when(card["packed"] & ~F.col("_package"), no("package_not_confirmed")).when(common < 2, no("weak_name_common_tokens")).when(coverage < 0.8, no("weak_name_coverage"))
        .when(jaccard < 0.55, no("weak_name_jaccard"))
    )
    return staged.withColumn("_t", first.otherwise(told(True, by_name, "brand_name_package")))


def candidate_identity(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``accepted``, ``points`` and ``why``: whether a record may fill a card, by the first rule that holds.

    A pair has name, brand, barcode, package_value, package_unit of the card, ``needed`` (its fields to fill), and the same with
    ``new_`` of the record and new_image_url and new_description. Nulls are unknown: they never conflict, but what a card
    states and a record does not confirm is not accepted."""
    staged = pairs.withColumns({"_card": identity_side(), "_record": identity_side("new_")})
    out = judged(staged, F.col("_card"), F.col("_record"), F.col("needed"), _has(F.col("new_image_url")), _has(F.col("new_description")))
    return out.select(*pairs.columns, "_t.accepted", "_t.points", "_t.why")


#: Pairs of one key judged by one task; a key with more is cut into blocks of cards.
BLOCK_PAIRS = 2_000_000


def candidate_pairs(cards: DataFrame, records: DataFrame) -> DataFrame:
    """(id, rec_id, accepted, points, why) of each card and each record with an equal code, or an equal brand and first word of the name.

    ``cards`` has id, name, brand, barcode, package_value, package_unit, needed; ``records`` has rec_id and the same, without
    ``needed``, as new_name and so on, and new_image_url and new_description. No pair is shuffled or written: both sides come to
    their keys with all that the rules read, and a pair met by both keys is judged at the smaller. Rows of one id meet as one card
    or record and each is judged, a card's with the needs of each. Null ids meet nothing."""
    word = lambda c: F.get(F.split(T.normalize_text(F.col(c)), " "), F.lit(0))
    cells = lambda p: F.array_compact(F.array(F.concat(F.lit("c"), T.digits_code(F.col(f"{p}barcode"))), F.concat(F.lit("n"), T.normalize_text(F.col(f"{p}brand")), F.lit("|"), word(f"{p}name"))))
    sides = []
    for df, key, prefix, more in ((cards, "id", "", []), (records, "rec_id", "new_", [_has(F.col("new_image_url")).alias("pictured"), _has(F.col("new_description")).alias("described")])):
        needed = F.col("needed") if key == "id" else F.array().cast("array<string>")
        rows = df.filter(F.col(key).isNotNull()).select(key, cells(prefix).alias("keys"), needed.alias("needed"), F.struct(identity_side(prefix).alias("side"), *more).alias("row"))
        whole = rows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), F.collect_list("row").alias("rows"), F.collect_list("needed").alias("needs"))
        each = whole.select(key, "keys", F.explode("rows").alias("row"), "needs")
        sides.append(each.select(key, "keys", "row", F.explode("needs").alias("needed")) if key == "id" else each.drop("needs"))
    sizes = [df.filter(F.col(key).isNotNull()).select(F.explode(cells(p)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias(p or "old_")) for df, key, p in ((cards, "id", ""), (records, "rec_id", "new_"))]
    pairs = F.col("old_").cast("double") * F.col("new_")
    hot = small_broadcast(sizes[0].join(sizes[1], "key").filter(pairs > BLOCK_PAIRS).select("key", F.ceil(pairs / BLOCK_PAIRS).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    left = sides[0].select("id", "needed", F.col("keys").alias("a_keys"), F.col("row").alias("a"), F.explode("keys").alias("key")).join(hot, "key", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).drop("blocks")
    right = sides[1].select("rec_id", F.col("keys").alias("r_keys"), F.col("row").alias("r"), F.explode("keys").alias("key")).join(hot, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    once = (F.size("a_keys") == 1) | (F.size("r_keys") == 1) | (F.col("key") == F.array_min(F.array_intersect("a_keys", "r_keys")))
    met = left.join(right, ["key", "block"]).filter(once)
    found = judged(met, F.col("a.side"), F.col("r.side"), F.col("needed"), F.col("r.pictured"), F.col("r.described"))
    return found.select("id", "rec_id", "_t.accepted", "_t.points", "_t.why")


def enrichment_queries(cards: DataFrame) -> DataFrame:
    """(id, pos, query): what to ask a provider for a card: brand, name and package, then without the package; each once.

    A card without brand and name asks nothing; a package counts if it has a number and a unit."""
    base = F.nullif(F.concat_ws(" ", T.filled(F.col("brand")), T.filled(F.col("name"))), F.lit(""))
    package = F.concat(I.canonical_number(F.col("package_value").cast("string")), F.lit(" "), T.filled(F.col("package_unit")))
    asked = F.array_distinct(F.array_compact(F.array(F.concat(base, F.lit(" "), package), base)))
    return cards.filter(base.isNotNull()).select("id", F.posexplode(asked).alias("pos", "query"))
