"""Entity resolution by rules: blocking, evidence of pairs, the scanner's and the verifier's decisions, canonical choice, consolidation.

Listings of these operators have id, name, brand, category, barcode, package_value and package_unit; subtype, description,
image_url, keywords, family_id and links (an array of struct<provider, source_id>) are read where they are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import identity as I
from larder.functions import text as T

#: Sizes of a block of listings that share a word: the rule pairs nothing by the words of larger blocks. ``most=None`` has no such bound.
BLOCK_LEAST, BLOCK_MOST = 2, 50
#: Least coverage of the smaller name that any rule of similarity asks for.
LEAST_COVERAGE = 0.70
_LINKS = "array<struct<provider:string,source_id:string>>"


def _have(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a null of its kind where the listings lack it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def plain_name(col: Column) -> Column:
    """The normal form of a name with its entities resolved; empty for null."""
    return F.coalesce(T.normalize_text(T.squeeze(T.unescape(col))), F.lit(""))


def _blocked(listings: DataFrame) -> DataFrame:
    """(id, b, c, n, coded, w) of the listings that have a known brand and a category."""
    base = listings.filter(~T.is_unknown_brand(F.col("brand"))).select(
        "id", T.normalize_text(F.col("brand")).alias("b"), I.category_key(F.col("category")).alias("c"), plain_name(F.col("name")).alias("n"), T.digits_code(F.col("barcode")).isNotNull().alias("coded"),
        I.name_tokens(F.col("name")).alias("w"),
    )
    return base.filter("c <> ''").withColumn("coded", F.coalesce("coded", F.lit(False)))


def _word_pairs(base: DataFrame, most: int) -> DataFrame:
    """(left_id, right_id, common) of listings that share words of blocks of two to ``most``: two words, or one if one side only has a code."""
    key = ["b", "c"]
    words = base.select("id", *key, "coded", F.explode("w").alias("word"))
    sized = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k").between(BLOCK_LEAST, most))
    small = words.join(sized.drop("k"), [*key, "word"])
    side = lambda tag: small.select(*key, "word", F.col("id").alias(f"{tag}_id"), F.col("coded").alias(f"{tag}_c"))
    shared = side("left").join(side("right"), [*key, "word"]).filter("left_id < right_id").groupBy("left_id", "right_id")
    return shared.agg(F.count(F.lit(1)).alias("common"), F.max((F.col("left_c") != F.col("right_c")).cast("int")).alias("one")).filter("common >= 2 or one = 1").drop("one")


def _covered_pairs(base: DataFrame) -> DataFrame:
    """(left_id, right_id, common) of all pairs that any similarity rule can accept, whatever their words: a coverage of ``LEAST_COVERAGE``.

    The smaller name then has one of its rarest words in the other (prefix filtering), so pairs meet on rare words and not on
    those that every name of a brand has. Listings of one set of words are one class: its smallest id meets other classes and
    its own members, so copies of a name give no product of pairs."""
    key = ["b", "c"]
    sets = base.filter(F.size("w") > 0).withColumn("w", F.array_sort("w"))
    reps = sets.groupBy(*key, "w").agg(F.min("id").alias("rep"), F.max("coded").alias("any"), F.min("coded").alias("all"))
    exploded = reps.select("rep", *key, F.explode("w").alias("word"))
    seen = exploded.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("f"))
    ranked = exploded.join(seen, [*key, "word"]).groupBy("rep", *key).agg(F.sort_array(F.collect_list(F.struct("f", "word"))).alias("r"))  # the words of one name
    n = F.size("r") - F.ceil(F.size("r") * LEAST_COVERAGE).cast("int") + 1
    prefix = ranked.select("rep", *key, F.explode(F.slice("r", F.lit(1), n)).alias("x")).select("rep", *key, "x.word")
    met = prefix.withColumnRenamed("rep", "a").join(exploded.withColumnRenamed("rep", "z"), [*key, "word"]).filter("a <> z")
    ends = met.select(F.least("a", "z").alias("left_id"), F.greatest("a", "z").alias("right_id")).distinct()
    side = lambda tag: reps.select(F.col("rep").alias(f"{tag}_id"), F.col("w").alias(f"{tag}_w"), F.col("any").alias(f"{tag}_any"), F.col("all").alias(f"{tag}_all"))
    common, coverage, _ = I.overlap(F.col("left_w"), F.col("right_w"))
    # one code only is possible between two classes unless all listings of both have one, or none has
    one = ~((F.col("left_all") & F.col("right_all")) | (~F.col("left_any") & ~F.col("right_any")))
    between = ends.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("common", common).filter((coverage >= LEAST_COVERAGE) & ((F.col("common") >= 2) | one)).select("left_id", "right_id", "common")
    within = sets.join(reps.select(*key, "w", "rep"), [*key, "w"]).filter("id > rep").select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.size("w").alias("common"))
    return between.unionByName(within)


def blocking_pairs(listings: DataFrame, most: int | None = BLOCK_MOST) -> DataFrame:
    """(left_id, right_id, common, same_name): candidate pairs within a known brand and a category key.

    Pairs share two words, or one if exactly one side has a code, or the whole name. Words of blocks over ``most`` listings
    pair nothing, as the rule states; with ``most=None`` pairs are instead all that a similarity rule can accept (coverage
    0.70), between the smallest ids of listings with equal words and from each of these to the others of its words. Listings
    with one whole name pair through the block's smallest id, so copies stay linked without all their pairs. Listings with an
    unknown brand, no category or no name pair nothing; an empty table gives no pairs."""
    base = _blocked(listings)
    near = (_covered_pairs(base) if most is None else _word_pairs(base, most)).select("left_id", "right_id", F.col("common").cast("bigint").alias("common"), F.lit(0).alias("same"))
    key = ["b", "c", "n"]
    first = base.filter("n <> ''").groupBy(*key).agg(F.min("id").alias("left_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    exact = base.select("id", *key).join(first, key).filter("id > left_id").select("left_id", F.col("id").alias("right_id"), F.lit(0).cast("bigint").alias("common"), F.lit(1).alias("same"))
    return near.unionByName(exact).groupBy("left_id", "right_id").agg(F.max("common").alias("common"), (F.max("same") == 1).alias("same_name"))


def features(listings: DataFrame) -> DataFrame:
    """Per listing what the evidence of a pair compares: computed once per listing, not once per pair."""
    unit = I.package_unit(F.col("package_unit"))
    links = F.coalesce(_have(listings, "links", _LINKS), F.array().cast(_LINKS))
    known = F.filter(F.transform(links, lambda x: F.struct(T.normalize_text(x["provider"]).alias("p"), T.squeeze(x["source_id"]).alias("s"))), lambda x: (F.coalesce(x["p"], F.lit("")) != "") & (F.coalesce(x["s"], F.lit("")) != ""))
    package = F.when(F.col("package_value").isNotNull(), F.concat(F.col("package_value").cast("string"), F.coalesce("package_unit", F.lit(""))))
    return listings.select(
        "id", "brand", "category", "name", package.alias("package"), plain_name(F.col("name")).alias("n"), F.coalesce(T.normalize_text(F.col("brand")), F.lit("")).alias("nb"), I.category_key(F.col("category")).alias("bucket"),
        I.is_generic_category(F.col("category")).alias("generic"), T.digits_code(F.col("barcode")).alias("code"), I.package_family(unit).alias("family"), I.package_base(F.col("package_value"), unit).alias("base"),
        (F.col("package_value").isNotNull() & (F.coalesce("package_unit", F.lit("")) != "")).alias("packed"), I.percentages(F.col("name")).alias("pct"), I.counts(F.col("name")).alias("cnt"),
        I.name_packages(F.col("name")).alias("pk"), I.name_tokens(F.col("name")).alias("w"), I.variant_tokens(F.col("name"), F.col("brand")).alias("v"),
        F.nullif(plain_name(_have(listings, "subtype")), F.lit("")).alias("sub"), _have(listings, "family_id", "bigint").alias("fam"), F.size(links).alias("sources"), F.array_distinct(known).alias("links"),
    )


def _tag(test: Column, name: str) -> Column:
    return F.when(test, F.lit(name))


def _tags(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _met(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Pairs with both sides' features and what both decisions compare."""
    side = lambda tag: feats.select(*[F.col(c).alias(f"{tag}_{c}") for c in feats.columns])
    met = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    both = lambda c: (F.col(f"left_{c}"), F.col(f"right_{c}"))
    common, coverage, jaccard = I.overlap(*both("w"))
    lc, rc = both("code")
    out = met.withColumns({
        "package_compatible": I.packages_compatible(F.col("left_base"), F.col("left_family"), F.col("right_base"), F.col("right_family")), "common_count": common, "coverage": coverage, "jaccard": jaccard,
        "same_name": F.col("left_n") == F.col("right_n"), "same_code": F.coalesce(lc == rc, F.lit(False)), "different_codes": F.coalesce(lc != rc, F.lit(False)), "one_code": lc.isNotNull() != rc.isNotNull(),
        "left_only": F.array_sort(F.array_except(*both("v"))), "right_only": F.array_sort(F.array_except(F.col("right_v"), F.col("left_v"))),
    })
    return out.withColumns({f"{c}_conflict": F.coalesce(I.sets_conflict(*both(c)), F.lit(False)) for c in ("pct", "cnt", "pk")})


def _both_equal(c: str) -> Column:
    return F.coalesce((F.size(f"left_{c}") > 0) & (F.col(f"left_{c}") == F.col(f"right_{c}")), F.lit(False))


_TWO_VARIANTS = lambda: (F.size("left_only") > 0) & (F.size("right_only") > 0)
_ONE_VARIANT = lambda: (F.size("left_only") > 0) != (F.size("right_only") > 0)


def evidence(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """The scanner's evidence of each pair (left_id, right_id): overlaps, ``hard`` conflicts and ``soft`` differences by name.

    A side's null name has no words, numbers or variants; a missing package or code is unknown, not different."""
    package_different = F.coalesce(~F.col("package_compatible"), F.lit(False))
    hard = _tags(
        _tag(package_different, "different_package"), _tag(F.col("pct_conflict"), "different_percentage"), _tag(F.col("cnt_conflict"), "different_count"), _tag(F.col("pk_conflict"), "different_name_package"),
        _tag(_TWO_VARIANTS(), "different_variant_tokens"),
    )
    one_package = F.col("package_compatible").isNull() & (F.col("left_packed") != F.col("right_packed"))
    soft = _tags(_tag(_ONE_VARIANT(), "one_sided_variant_tokens"), _tag(F.col("one_code"), "barcode_present_only_on_one_side"), _tag(one_package, "package_present_only_on_one_side"))
    return _met(pairs, feats).withColumn("hard", hard).withColumn("soft", soft)


def _decide(kind: str, *rules: tuple) -> Column:
    """struct(class, reason, ``kind``) of the first rule (test, class, reason, value) that holds; the last rule's test is None."""
    told = lambda cls, why, value: F.struct(F.lit(cls).alias("class"), F.lit(why).alias("reason"), (value if isinstance(value, Column) else F.lit(float(value))).alias(kind))
    *ordered, (_, *last) = rules
    out = F.when(ordered[0][0], told(*ordered[0][1:]))
    for test, *result in ordered[1:]:
        out = out.when(test, told(*result))
    return out.otherwise(told(*last))


def _score(base: float, by_coverage: float, by_jaccard: float, most: float, *more: Column) -> Column:
    total = F.lit(base) + F.col("coverage") * by_coverage + F.col("jaccard") * by_jaccard
    return F.bround(F.least(sum(more, total), F.lit(most)), 1)


def classify() -> Column:
    """The scanner's struct(class, reason, score) of a pair's evidence: the first rule that holds decides."""
    fits, unknown = F.coalesce("package_compatible", F.lit(False)), F.col("package_compatible").isNull()
    alike = F.coalesce((F.col("left_pct") == F.col("right_pct")) & (F.col("left_cnt") == F.col("right_cnt")), F.lit(False))
    name, codes, common, coverage, jaccard = F.col("same_name"), F.col("different_codes"), F.col("common_count"), F.col("coverage"), F.col("jaccard")
    generic = F.col("left_generic") | F.col("right_generic")
    very = fits & (common >= 3) & (coverage >= 0.95) & (jaccard >= 0.85) & (F.size("soft") == 0)
    eight = F.when(fits, 8.0).otherwise(0.0)
    return _decide(
        "score",
        (F.size("hard") > 0, "REJECT", "hard_identity_conflict", 0),
        (codes & _ONE_VARIANT(), "REJECT", "different_barcode_and_variant", 0),
        (codes & name & fits & alike, "BARCODE_CONFLICT_REVIEW", "exact_identity_but_different_barcode", 92),
        (codes & name & unknown & alike, "BARCODE_CONFLICT_REVIEW", "exact_name_but_different_barcode_package_unknown", 82),
        (codes & fits & alike & (common >= 3) & (coverage >= 0.98) & (jaccard >= 0.90), "BARCODE_CONFLICT_REVIEW", "near_identical_but_different_barcode", _score(80, 5, 5, 90)),
        (codes, "REJECT", "different_barcode", 0),
        (F.col("same_code"), "AUTO_SAFE", "same_barcode", 100),
        (name & fits & generic, "REVIEW", "exact_name_package_generic_category", 90),
        (name & fits, "AUTO_SAFE", "exact_name_and_package", 97),
        (very & generic, "REVIEW", "very_strong_identity_generic_category", _score(88, 4, 4, 94)),
        (very, "AUTO_SAFE", "very_strong_identity", _score(88, 4, 4, 96)),
        (F.col("one_code") & (common >= 1) & (coverage >= LEAST_COVERAGE), "REVIEW", "one_barcode_plus_related_identity", _score(62, 15, 10, 90, eight)),
        ((common >= 2) & (coverage >= 0.80) & (jaccard >= 0.55), "REVIEW", "strong_similarity_needs_review", _score(58, 15, 10, 89, eight)),
        (name, "REVIEW", "exact_name_but_identity_incomplete", 78),
        (None, "REJECT", "insufficient_identity_evidence", 0),
    )


def scan(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """The scanner's record of every pair: class, reason and score, both sides, and all evidence.

    After the hard conflicts, pairs whose names are not related (neither equal, two common words, one with coverage 0.70 and
    one code, nor nearly equal with different codes) are rejected for too little evidence before the other rules."""
    found = evidence(pairs, feats)
    related = F.col("same_name") | (F.col("common_count") >= 2) | (F.col("one_code") & (F.col("common_count") >= 1) & (F.col("coverage") >= LEAST_COVERAGE))
    unrelated = F.struct(F.lit("REJECT").alias("class"), F.lit("insufficient_identity_evidence").alias("reason"), F.lit(0.0).alias("score"))
    told = found.withColumn("_c", F.when((F.size("hard") == 0) & ~related, unrelated).otherwise(classify()))
    sides = [F.col(f"{tag}_{c}").alias(f"{tag}_{out}") for tag in ("left", "right") for c, out in (("brand", "brand"), ("category", "category"), ("name", "name"), ("code", "barcode"), ("package", "package"), ("sources", "sources"))]
    lists = [F.array_sort(f"{tag}_{c}").alias(f"{tag}_{out}") for tag in ("left", "right") for c, out in (("pct", "percentages"), ("cnt", "counts"), ("pk", "name_packages"), ("v", "variant_tokens"), ("only", "only_variants"))]
    return told.select(
        F.col("_c.class").alias("classification"), "_c.reason", "_c.score", "left_id", "right_id", *sides, "package_compatible", "coverage", "jaccard", "common_count", *lists, F.col("hard").alias("hard_conflicts"),
        F.col("soft").alias("soft_differences"),
    )


def verification(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """The verifier's evidence of each pair: ``positive`` and ``negative`` tags beside what they rest on."""
    name, common, coverage, jaccard = F.col("same_name"), F.col("common_count"), F.col("coverage"), F.col("jaccard")
    likeness = (
        F.when(name, "exact_normalized_name").when((common >= 3) & (coverage >= 0.95) & (jaccard >= 0.8), "very_strong_name_similarity")
        .when((common >= 2) & (coverage >= 0.75) & (jaccard >= 0.5), "strong_name_similarity").when((common >= 1) & (coverage >= 0.5), "related_name")
    )
    links = lambda tag: F.transform(f"{tag}_links", lambda x: F.concat_ws("\u0001", x["p"], x["s"]))
    providers = lambda tag: F.array_sort(F.array_distinct(F.transform(f"{tag}_links", lambda x: x["p"])))
    sourced = (F.col("left_sources") > 0) & (F.col("right_sources") > 0)
    sub = F.col("left_sub") == F.col("right_sub")
    fam = F.col("left_fam") == F.col("right_fam")
    some = lambda c: (F.size(f"left_{c}") > 0) & (F.size(f"right_{c}") > 0)
    known = lambda test: F.coalesce(test, F.lit(False))
    met = _met(pairs, feats).withColumns({
        "same_brand": F.col("left_nb") == F.col("right_nb"), "likeness": likeness,
        "category_fits": ((F.col("left_bucket") != "") & (F.col("left_bucket") == F.col("right_bucket"))) | F.col("left_generic") | F.col("right_generic"),
        "shared_link": F.arrays_overlap(links("left"), links("right")), "independent": sourced & (F.size(F.array_union(providers("left"), providers("right"))) >= 2),
    })
    one_provider = sourced & (F.size(providers("left")) > 0) & (providers("left") == providers("right")) & ~known(F.col("shared_link"))
    positive = _tags(
        _tag(F.col("same_brand"), "same_brand"), F.col("likeness"), _tag(F.col("category_fits"), "compatible_category"), _tag(F.col("same_code"), "same_barcode"), _tag(F.col("one_code"), "barcode_known_on_one_side"),
        _tag(known(F.col("package_compatible")), "same_package"), _tag(_both_equal("pct"), "same_percentage"), _tag(_both_equal("cnt"), "same_count"), _tag(_both_equal("pk"), "same_name_package"),
        _tag((F.size("left_only") == 0) & (F.size("right_only") == 0) & some("v"), "same_variant_tokens"), _tag(known(sub), "same_subtype"), _tag(known(fam), "same_family"),
        _tag(known(F.col("shared_link")), "shared_provider_source_identity"), _tag(F.col("independent"), "independent_external_sources"),
    )
    negative = _tags(
        _tag(~F.col("same_brand"), "different_brand"), _tag(F.col("likeness").isNull(), "weak_name_similarity"), _tag(~F.col("category_fits"), "different_category"), _tag(F.col("different_codes"), "different_barcode"),
        _tag(known(~F.col("package_compatible")), "different_package"), _tag(F.col("pct_conflict"), "different_percentage"), _tag(F.col("cnt_conflict"), "different_count"), _tag(F.col("pk_conflict"), "different_name_package"),
        _tag(_TWO_VARIANTS(), "different_variant_tokens"), _tag(_ONE_VARIANT(), "one_sided_variant_tokens"), _tag(known(~sub), "different_subtype"), _tag(known(~fam), "different_family"),
        _tag(one_provider, "same_provider_different_source_ids"),
    )
    return met.withColumn("positive", positive).withColumn("negative", negative)


def verdict() -> Column:
    """The verifier's struct(class, reason, confidence) of the columns of ``verification``: the first rule that holds decides."""
    against = lambda *tags: F.arrays_overlap("negative", F.array(*[F.lit(t) for t in tags]))
    speaks = lambda *tags: F.arrays_overlap("positive", F.array(*[F.lit(t) for t in tags]))
    same, review, other = "CONFIRMED_SAME_SKU", "NEEDS_MANUAL_REVIEW", "CONFIRMED_DIFFERENT_SKU"
    fits, name = F.coalesce("package_compatible", F.lit(False)), F.col("same_name")
    core = F.col("same_brand") & F.col("category_fits") & speaks("exact_normalized_name", "very_strong_name_similarity") & fits
    apart = F.col("independent") & name & ~against("one_sided_variant_tokens", "different_variant_tokens", "different_subtype", "different_barcode")
    related = F.col("same_brand") & F.col("category_fits") & F.coalesce("package_compatible", F.lit(True)) & (name | (F.col("common_count") >= 1) | speaks("same_percentage", "same_name_package"))
    return _decide(
        "confidence",
        (against("different_brand", "different_package", "different_percentage", "different_count", "different_name_package", "different_variant_tokens"), other, "hard_identity_conflict", 99),
        (F.col("different_codes") & against("one_sided_variant_tokens", "different_subtype"), other, "different_barcode_plus_variant_difference", 99),
        (F.col("different_codes"), review, "barcode_conflict_requires_external_confirmation", 75),
        (against("one_sided_variant_tokens"), review, "one_sided_sku_variant_requires_confirmation", 70),
        (against("different_subtype"), review, "subtype_difference_requires_confirmation", 70),
        (core & F.col("same_code"), same, "same_barcode_plus_core_identity", 100),
        (core & speaks("shared_provider_source_identity"), same, "same_external_identity_plus_core_identity", 99),
        (core & apart, same, "independent_sources_plus_exact_core_identity", 98),
        (core, review, "core_identity_matches_but_no_independent_confirmation", 85),
        (related, review, "related_core_identity_needs_more_evidence", 75),
        (against("different_category") & against("weak_name_similarity"), other, "weak_name_and_incompatible_category", 95),
        (None, review, "insufficient_evidence_for_safe_decision", 60),
    )


def verify(pairs: DataFrame, feats: DataFrame, scored: DataFrame) -> DataFrame:
    """(classification, reason, confidence, left_id, right_id, canonical_product_id, positive_evidence, negative_evidence) of each pair.

    Pairs confirmed as one item have the surviving listing by ``choose_canonical`` over ``scored``; the others have none."""
    told = verification(pairs, feats).withColumn("_c", verdict()).select(
        F.col("_c.class").alias("classification"), "_c.reason", "_c.confidence", "left_id", "right_id", F.col("positive").alias("positive_evidence"), F.col("negative").alias("negative_evidence")
    )
    chosen = choose_canonical(told.select("left_id", "right_id"), scored)
    met = told.join(chosen, ["left_id", "right_id"], "left")
    return met.withColumn("canonical_product_id", F.when(F.col("classification") == "CONFIRMED_SAME_SKU", F.col("canonical_id"))).drop("canonical_id")


def best_pairs(candidates: DataFrame, *order: Column) -> DataFrame:
    """One row per unordered pair of ``candidates`` (left_id, right_id, score, ...), the best by score and then ``order``."""
    keyed = candidates.filter("left_id is not null and right_id is not null and left_id <> right_id").withColumn("a", F.least("left_id", "right_id")).withColumn("b", F.greatest("left_id", "right_id"))
    rest = [c for c in keyed.columns if c not in ("a", "b", "left_id", "right_id")]
    best = F.min_by(F.struct(*rest), F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), *order))
    return keyed.groupBy("a", "b").agg(best.alias("_x")).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "_x.*")


def text_points(col: Column) -> Column:
    """0 to 80 by the length of a text, more from 80 and from 180 letters."""
    n = F.length(T.squeeze(T.unescape(col)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.least(n / 5.0, F.lit(60.0)) + F.when(n >= 80, 10.0).otherwise(0.0) + F.when(n >= 180, 10.0).otherwise(0.0))


def completeness(listings: DataFrame) -> DataFrame:
    """(id, score, coded, sources): how complete each listing is for the choice of the surviving one, 0 to 100."""
    have = lambda c, points: F.when(T.filled(_have(listings, c)).isNotNull(), points).otherwise(0.0)
    coded = T.digits_code(F.col("barcode")).isNotNull()
    package = F.when(F.col("package_value").isNotNull() & (F.coalesce("package_unit", F.lit("")) != ""), 15.0).otherwise(0.0)
    links = F.size(F.coalesce(_have(listings, "links", _LINKS), F.array().cast(_LINKS)))
    points = F.when(coded, 25.0).otherwise(0.0) + package + have("subtype", 8.0) + have("image_url", 15.0) + F.least(text_points(_have(listings, "description")), F.lit(20.0)) + have("keywords", 5.0)
    points = points + F.when(_have(listings, "family_id", "bigint").isNotNull(), 4.0).otherwise(0.0) + F.least(links * 4.0, F.lit(8.0))
    return listings.select("id", F.bround(F.least(points, F.lit(100.0)), 1).alias("score"), coded.alias("coded"), links.alias("sources"))


def choose_canonical(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """(left_id, right_id, canonical_id): the more complete listing, then the one with a code, more sources, the smaller id."""
    side = lambda tag: scored.select(F.col("id").alias(f"{tag}_id"), F.struct(F.col("score"), F.col("coded"), F.col("sources"), (-F.col("id")).alias("neg")).alias(f"_{tag}"))
    met = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return met.select("left_id", "right_id", F.when(F.col("_left") >= F.col("_right"), F.col("left_id")).otherwise(F.col("right_id")).alias("canonical_id"))


def safety(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """(canonical_id, duplicate_id, blocked, conflicts): why a duplicate (canonical_id, duplicate_id) must not be merged, and what is unsure."""
    met = _met(pairs.select(F.col("canonical_id").alias("left_id"), F.col("duplicate_id").alias("right_id")), feats)
    known = lambda tag: ~T.is_unknown_brand(F.col(f"{tag}_brand"))
    blocked = _tags(
        _tag(F.col("different_codes"), "barcode_conflict"), _tag(F.coalesce(~F.col("package_compatible"), F.lit(False)), "package_conflict"),
        _tag(known("left") & known("right") & (F.col("left_nb") != F.col("right_nb")), "brand_conflict"),
        _tag(~F.col("left_generic") & ~F.col("right_generic") & F.coalesce(F.col("left_category") != F.col("right_category"), F.lit(False)), "category_conflict"),
        _tag((F.col("common_count") < 2) | (F.col("coverage") < 0.75) | (F.col("jaccard") < 0.45), "name_similarity_too_weak"),
    )
    conflicts = _tags(_tag(F.col("package_compatible").isNull(), "package_not_confirmed"))
    return met.select(F.col("left_id").alias("canonical_id"), F.col("right_id").alias("duplicate_id"), blocked.alias("blocked"), conflicts.alias("conflicts"))


def repoint(rows: DataFrame, id_map: DataFrame, key: str, unique: list[str] | None = None, *order: Column) -> DataFrame:
    """``rows`` with ``key`` replaced by ``id_map`` (id, canonical_id); rows that then clash on ``unique`` keep one, the
    canonical product's own first. ``id_map`` has one row per id, so a hot product is split by adaptive execution."""
    met = rows.join(id_map.select(F.col("id").alias(key), F.col("canonical_id").alias("_to")), key, "left")
    moved = met.withColumn("_own", F.col("_to").isNull()).withColumn(key, F.coalesce("_to", key)).drop("_to")
    if not unique:
        return moved.drop("_own")
    rest = [c for c in rows.columns if c not in unique]
    first = F.min_by(F.struct(*rest), F.struct((~F.col("_own")).alias("o"), *order))  # combined before the shuffle: no key is too large
    return moved.groupBy(*unique).agg(first.alias("_x")).select(*unique, "_x.*")


def kept_aliases(aliases: DataFrame, listings: DataFrame, id_map: DataFrame) -> DataFrame:
    """(product_id, alias, normalized_alias): aliases after consolidation, and the name of every merged duplicate as an alias of the
    listing it went to, each normal form of a product once, the product's own first. Names without a normal form give none."""
    own = aliases.select("product_id", "alias")
    named = listings.select(F.col("id").alias("product_id"), T.squeeze(F.col("name")).alias("alias")).join(id_map.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    every = own.withColumn("_n", F.lit(0)).unionByName(named.withColumn("_n", F.lit(1))).withColumn("normalized_alias", T.normalize_text(F.col("alias"))).filter("normalized_alias <> ''")
    return repoint(every, id_map, "product_id", ["product_id", "normalized_alias"], F.col("_n"), F.col("alias")).select("product_id", "alias", "normalized_alias")
