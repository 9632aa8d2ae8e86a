"""SQL counterparts (DuckDB dialect) of the rules that tell items apart. Words, patterns and thresholds are stated here once more, not taken from the operators."""

from __future__ import annotations

from larder.plans import sqltext as S

_STOP = [
    "кофе", "молоко", "чай", "вода", "пицца", "сыр", "масло", "йогурт", "кефир", "сельдь", "сок", "сметана", "творог", "сливки", "колбаса", "майонез", "паштет", "печенье", "шоколад", "мороженое", "пельмени", "вареники",
    "продукт", "продукты", "товар", "товары", "традиции", "традиционный", "традиционные", "классический", "классическая", "классическое", "классические", "охлажденный", "охлажденная", "замороженный", "замороженная", "бзмж", "гост",
]
_PLAIN = _STOP[:22]
_SCAN_WORDS = [
    "колбаса", "сервелат", "сметана", "молоко", "кофе", "пельмени", "майонез", "сыр", "масло", "йогурт", "кефир", "творог", "сливки", "напиток", "напитки", "вода", "чай", "кетчуп", "капсулах", "капсулы", "кофемашин", "nespresso",
    "вареная", "вареный", "вареное", "варено", "копченая", "копченый", "копченое", "копченые", "варенокопченая", "варенокопченый", "ультрапастеризованное", "пастеризованное", "сливочная", "классическая", "классический", "традиции",
    "традиционный", "традиционная", "традиционное", "гост", "бзмж", "для", "из", "на", "с", "со", "без", "quot", "amp", "lt", "gt", "nbsp",
]
_MERGE_WORDS = [
    *_PLAIN, "продукт", "продукты", "товар", "товары", "капсулах", "капсулы", "кофемашин", "nespresso", "вареная", "вареный", "вареное", "варено", "копченая", "копченый", "копченое", "копченые", "варенокопченая", "варенокопченый",
    "ультрапастеризованное", "пастеризованное", "сливочная", "классическая", "классический", "классическое", "классические", "традиции", "традиционный", "традиционная", "традиционное", "традиционные", "охлажденный", "охлажденная",
    "замороженный", "замороженная", "гост", "бзмж", "для", "из", "на", "с", "со", "без", "quot", "amp", "lt", "gt", "nbsp",
]
_BRANDLESS = ["", "бренд не указан", "не указан", "unknown", "no brand", "без бренда"]
_ENTITIES = [("&quot;", '"'), ("&laquo;", "«"), ("&raquo;", "»"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def comparable(x: str) -> str:
    return f"replace(lower({S.squeeze(S.chain(S.squeeze(x), _ENTITIES))}), 'ё', 'е')"


def plain_name(x: str) -> str:
    return f"coalesce({S.norm(S.squeeze(S.chain(x, _ENTITIES)))}, '')"


def brandless(x: str) -> str:
    return f"(coalesce({S.norm(x)}, '') in {S.in_list(_BRANDLESS)})"


def plain(x: str) -> str:
    return f"(coalesce({S.norm(S.squeeze(x))}, '') in {S.in_list(_PLAIN)})"


def code(x: str) -> str:
    return f"case when length(regexp_replace({x}, '[^0-9]', '', 'g')) between 8 and 14 then regexp_replace({x}, '[^0-9]', '', 'g') end"


def number(v: str) -> str:
    bare = f"regexp_replace(replace({v}, ',', '.'), '^0+([0-9])', '\\1')"
    return f"case when contains({bare}, '.') then regexp_replace({bare}, '\\.?0+$', '') else {bare} end"


def unit(x: str) -> str:
    key = S.norm(S.squeeze(x))
    return f"""case when {key} = '' then null when {key} in ('гр', 'грамм', 'грамма', 'граммов', 'gram', 'grams', 'g') then 'г' when {key} in ('килограмм', 'килограмма', 'килограммов', 'kg') then 'кг'
      when {key} in ('миллилитр', 'миллилитра', 'миллилитров', 'ml') then 'мл' when {key} in ('литр', 'литра', 'литров', 'l') then 'л' else lower({S.squeeze(x)}) end"""


def family(u: str) -> str:
    return f"case when {u} in ('г', 'кг') then 'mass' when {u} in ('мл', 'л') then 'volume' end"


def base(v: str, u: str) -> str:
    return f"cast(case when {u} in ('кг', 'л') and {v} > 0 then {v} * 1000 when {u} in ('г', 'мл') and {v} > 0 then {v} end as decimal(18, 3))"


def compatible(a: str, b: str) -> str:
    """Of the columns base and family of two rows."""
    return f"case when {a}.base is not null and {b}.base is not null then case when {a}.family <> {b}.family then false else abs({a}.base - {b}.base) <= greatest({a}.base, {b}.base) * cast(0.03 as decimal(3, 2)) end end"


def _spread(x: str) -> str:
    """Every sign doubled, so that a pattern may take one on either side."""
    return f"regexp_replace({comparable(x)}, '([^\\p{{L}}\\p{{N}}.,])', '\\1\\1', 'g')"


_N, _END = "(?:^|[^0-9.,])([0-9]+(?:[.,][0-9]+)?)", "(?:$|[^\\p{L}\\p{N}_])"
_COUNT = f"(?:^|[^0-9.,])([0-9]+)\\s*(шт|штук|капсул|пакетик(?:а|ов)?|саше|порц(?:ия|ии|ий)){_END}"
_AMOUNT = {"scan": f"{_N}\\s*(кг|г|гр|мл|л){_END}", "merge": f"{_N}\\s*(кг|г|гр|мл|л|kg|g|ml|l){_END}"}


def percentages(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({_spread(x)}, '{_N}\\s*%', 1), lambda v: {number('v')})))"


def counts(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all({_spread(x)}, '{_COUNT}', 1), regexp_extract_all({_spread(x)}, '{_COUNT}', 2)), lambda z: z[1] || ':' || z[2])))"


def packages(x: str, rules: str = "scan") -> str:
    p = _AMOUNT[rules]
    return f"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all({_spread(x)}, '{p}', 1), regexp_extract_all({_spread(x)}, '{p}', 2)), lambda z: {number('z[1]')} || ':' || {unit('z[2]')})))"


def markers(x: str) -> str:
    rest = f"regexp_replace(regexp_replace({_spread(x)}, '(^|[^0-9.,])[0-9]+(?:[.,][0-9]+)?\\s*(?:кг|г|гр|мл|л|kg|g|ml|l)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g'), '(^|[^0-9.,])[0-9]+\\s*(?:шт|штук|капсул|пакетик(?:а|ов)?|саше|порц(?:ия|ии|ий))($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')"
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({rest}, '{_N}(?:$|[^0-9.,])', 1), lambda v: {number('v')})))"


def _words(x: str) -> str:
    return f"regexp_extract_all({comparable(x)}, '[\\p{{L}}\\p{{N}}]+')"


def text_tokens(x: str) -> str:
    return f"list_distinct(list_filter({_words(x)}, lambda w: length(w) >= 2))"


def name_tokens(x: str) -> str:
    return f"""list_distinct(list_filter(regexp_extract_all({comparable(f"coalesce({x}, '')")}, '[\\p{{L}}\\p{{No}}\\p{{Nl}}]+'), lambda w: length(w) >= 3 and w not in {S.in_list(_STOP)}))"""


def brand_tokens(x: str) -> str:
    return f"""list_filter({_words(f"coalesce({x}, '')")}, lambda w: length(w) >= 3)"""


def variants(x: str, rules: str = "scan") -> str:
    """Before the brand's own words are taken out."""
    letters, words = ("г|гр|кг|мл|л", _SCAN_WORDS) if rules == "scan" else ("г|гр|кг|мл|л|g|kg|ml|l", _MERGE_WORDS)
    return f"""list_distinct(list_filter({_words(f"coalesce({x}, '')")}, lambda w: length(w) >= 3 and not regexp_matches(w, '^\\p{{Nd}}+$') and not regexp_matches(w, '^[0-9]+(?:{letters})$') and w not in {S.in_list(words)}))"""


def without(a: str, b: str) -> str:
    return f"list_sort(list_filter({a}, lambda w: not list_contains({b}, w)))"


def overlap(a: str, b: str) -> str:
    c = f"len(list_intersect({a}, {b}))"
    return f"""{c} as common, case when least(len({a}), len({b})) > 0 then {c} / least(len({a}), len({b})) else 0.0 end as coverage,
      case when len({a}) + len({b}) - {c} > 0 then {c} / (len({a}) + len({b}) - {c}) else 0.0 end as jaccard"""


def clash(a: str, b: str) -> str:
    return f"(len({a}) > 0 and len({b}) > 0 and {a} <> {b})"


def name_quality(x: str) -> str:
    t = S.squeeze(x)
    return f"""case when coalesce(length({t}), 0) = 0 then 0 else least(greatest(20 + case when not {plain(x)} then 30 else 0 end + least(len({text_tokens(x)}) * 5, 25)
      + case when regexp_matches({t}, '[0-9]') then 5 else 0 end + case when length({t}) >= 12 then 10 else 0 end - case when length({t}) > 180 then 20 else 0 end, 0), 100) end"""


def image_quality(x: str) -> str:
    t = S.squeeze(x)
    return f"""case when coalesce({t}, '') = '' then 0 when contains(lower({t}), 'placeholder') then 10 when regexp_matches({t}, '^https?://') and regexp_matches({t}, '(?i)\\.(jpg|jpeg|png|webp)($|\\?)') then 80
      when regexp_matches({t}, '^https?://') then 70 else 95 end"""


def filled(x: str) -> str:
    return f"nullif({S.squeeze(x)}, '')"


#: Rows l (listing with brand, category and links) and f (its features) of the catalogue tables.
LISTINGS = f"""l as (select p.id, p.name, b.name as brand, 'категория ' || p.category_id as category, p.barcode, p.package_value, p.package_unit, p.subtype, p.image_url, p.keywords, coalesce(k.links, []) as links
    from products p left join brands b on b.id = p.brand_id
    left join (select product_id, list(struct_pack(p := {S.norm('provider')}, s := {S.squeeze('source_id')})) as links from product_sources group by product_id) k on k.product_id = p.id),
  u as (select *, {unit('package_unit')} as unit, {variants('name')} as vr, {brand_tokens('brand')} as bt from l),
  f as (select id, name, brand, category, {plain_name('name')} as n, coalesce({S.norm('brand')}, '') as nb, {brandless('brand')} as nobrand, {S.norm('category')} as bucket, {code('barcode')} as code, {family('unit')} as family, {base('package_value', 'unit')} as base,
    package_value is not null and coalesce(package_unit, '') <> '' as packed, {percentages('name')} as pct, {counts('name')} as cnt, {packages('name')} as pk, {name_tokens('name')} as w, {without('vr', 'bt')} as v,
    nullif({plain_name('subtype')}, '') as sub, len(links) as sources, list_sort(list_distinct(list_transform(links, lambda x: x.p))) as providers, list_distinct(list_transform(links, lambda x: x.p || chr(1) || x.s)) as ids from u)"""

#: Rows m of pairs (CTE ``pairs`` of left_id and right_id): what both decisions compare.
COMPARED = f"""m as (select a.id as left_id, b.id as right_id, {compatible('a', 'b')} as fits, {overlap('a.w', 'b.w')}, a.n = b.n as same_name, coalesce(a.code = b.code, false) as same_code, coalesce(a.code <> b.code, false) as other_code,
    (a.code is null) <> (b.code is null) as one_code, len({without('a.v', 'b.v')}) > 0 as lo, len({without('b.v', 'a.v')}) > 0 as ro, {clash('a.pct', 'b.pct')} as pct, {clash('a.cnt', 'b.cnt')} as cnt, {clash('a.pk', 'b.pk')} as pk,
    a.pct = b.pct and a.cnt = b.cnt as alike, len(a.pct) > 0 and a.pct = b.pct as same_pct, len(a.cnt) > 0 and a.cnt = b.cnt as same_cnt, len(a.pk) > 0 and a.pk = b.pk as same_pk, len(a.v) > 0 and len(b.v) > 0 as told,
    a.packed <> b.packed as one_package, a.bucket is not null and a.bucket = b.bucket as bucket, a.category is null or b.category is null as generic, coalesce(a.category <> b.category, false) as other_category, a.sub = b.sub as sub, a.nb = b.nb as brands,
    not a.nobrand and not b.nobrand and a.nb <> b.nb as other_brand, len(list_intersect(a.ids, b.ids)) > 0 as shared, a.sources > 0 and b.sources > 0 as sourced, len(list_distinct(list_concat(a.providers, b.providers))) as providers,
    len(a.providers) > 0 and a.providers = b.providers as same_providers from pairs d join f a on a.id = d.left_id join f b on b.id = d.right_id)"""


def _score(low: str, by_coverage: str, by_jaccard: str, most: str, more: str = "0") -> str:
    return f"round_even(least({low} + coverage * {by_coverage} + jaccard * {by_jaccard} + {more}, {most}), 1)"


_EIGHT = "case when fits then 8 else 0 end"
_HARD = "concat_ws(',', case when not fits then 'different_package' end, case when pct then 'different_percentage' end, case when cnt then 'different_count' end, case when pk then 'different_name_package' end, case when lo and ro then 'different_variant_tokens' end)"
_SOFT = "concat_ws(',', case when lo <> ro then 'one_sided_variant_tokens' end, case when one_code then 'barcode_present_only_on_one_side' end, case when fits is null and one_package then 'package_present_only_on_one_side' end)"
_VERY = "fits and common >= 3 and coverage >= 0.95 and jaccard >= 0.85 and soft = ''"
SCANNED = f"""t as (select *, {_HARD} as hard, {_SOFT} as soft from m),
  r as (select *, case when hard <> '' then struct_pack(c := 'REJECT', w := 'hard_identity_conflict', s := 0.0)
    when not (same_name or common >= 2 or (one_code and common >= 1 and coverage >= 0.70)) then struct_pack(c := 'REJECT', w := 'insufficient_identity_evidence', s := 0.0)
    when other_code and lo <> ro then struct_pack(c := 'REJECT', w := 'different_barcode_and_variant', s := 0.0)
    when other_code and same_name and fits and alike then struct_pack(c := 'BARCODE_CONFLICT_REVIEW', w := 'exact_identity_but_different_barcode', s := 92.0)
    when other_code and same_name and fits is null and alike then struct_pack(c := 'BARCODE_CONFLICT_REVIEW', w := 'exact_name_but_different_barcode_package_unknown', s := 82.0)
    when other_code and fits and alike and common >= 3 and coverage >= 0.98 and jaccard >= 0.90 then struct_pack(c := 'BARCODE_CONFLICT_REVIEW', w := 'near_identical_but_different_barcode', s := {_score('80', '5', '5', '90')})
    when other_code then struct_pack(c := 'REJECT', w := 'different_barcode', s := 0.0)
    when same_code then struct_pack(c := 'AUTO_SAFE', w := 'same_barcode', s := 100.0)
    when same_name and fits and generic then struct_pack(c := 'REVIEW', w := 'exact_name_package_generic_category', s := 90.0)
    when same_name and fits then struct_pack(c := 'AUTO_SAFE', w := 'exact_name_and_package', s := 97.0)
    when {_VERY} and generic then struct_pack(c := 'REVIEW', w := 'very_strong_identity_generic_category', s := {_score('88', '4', '4', '94')})
    when {_VERY} then struct_pack(c := 'AUTO_SAFE', w := 'very_strong_identity', s := {_score('88', '4', '4', '96')})
    when one_code and common >= 1 and coverage >= 0.70 then struct_pack(c := 'REVIEW', w := 'one_barcode_plus_related_identity', s := {_score('62', '15', '10', '90', _EIGHT)})
    when common >= 2 and coverage >= 0.80 and jaccard >= 0.55 then struct_pack(c := 'REVIEW', w := 'strong_similarity_needs_review', s := {_score('58', '15', '10', '89', _EIGHT)})
    when same_name then struct_pack(c := 'REVIEW', w := 'exact_name_but_identity_incomplete', s := 78.0) else struct_pack(c := 'REJECT', w := 'insufficient_identity_evidence', s := 0.0) end as x from t)"""

_STRONG = "(same_name or (common >= 3 and coverage >= 0.95 and jaccard >= 0.8))"
_CORE = f"brands and cat and {_STRONG} and fits"
_PACKED = "coalesce(case when p.package_value is not null and coalesce(p.package_unit, '') <> '' then 15 end, 0)"
#: Completeness, code and number of sources of each listing p of the CTE l.
SCORED = f"""s as (select p.id, round_even(least(case when {code('p.barcode')} is not null then 25 else 0 end + {_PACKED} + case when {filled('p.subtype')} is not null then 8 else 0 end + case when {filled('p.image_url')} is not null then 15 else 0 end
    + case when {filled('p.keywords')} is not null then 5 else 0 end + least(len(p.links) * 4, 8), 100), 1) as score, {code('p.barcode')} is not null as coded, len(p.links) as sources from l p)"""
CHOSEN = "case when (a.score, a.coded, a.sources, -a.id) >= (b.score, b.coded, b.sources, -b.id) then a.id else b.id end"
VERIFIED = f"""c as (select *, bucket or generic as cat from m),
  g as (select *, case when same_name then 'exact_normalized_name' when common >= 3 and coverage >= 0.95 and jaccard >= 0.8 then 'very_strong_name_similarity' when common >= 2 and coverage >= 0.75 and jaccard >= 0.5 then 'strong_name_similarity'
    when common >= 1 and coverage >= 0.5 then 'related_name' end as likeness from c),
  e as (select *, concat_ws(',', case when brands then 'same_brand' end, likeness, case when cat then 'compatible_category' end, case when same_code then 'same_barcode' end, case when one_code then 'barcode_known_on_one_side' end,
      case when fits then 'same_package' end, case when same_pct then 'same_percentage' end, case when same_cnt then 'same_count' end, case when same_pk then 'same_name_package' end, case when not lo and not ro and told then 'same_variant_tokens' end,
      case when sub then 'same_subtype' end, case when shared then 'shared_provider_source_identity' end, case when sourced and providers >= 2 then 'independent_external_sources' end) as positive,
    concat_ws(',', case when not brands then 'different_brand' end, case when likeness is null then 'weak_name_similarity' end, case when not cat then 'different_category' end, case when other_code then 'different_barcode' end,
      case when not fits then 'different_package' end, case when pct then 'different_percentage' end, case when cnt then 'different_count' end, case when pk then 'different_name_package' end, case when lo and ro then 'different_variant_tokens' end,
      case when lo <> ro then 'one_sided_variant_tokens' end, case when not sub then 'different_subtype' end, case when sourced and same_providers and not shared then 'same_provider_different_source_ids' end) as negative from g),
  v as (select *, case when not brands or not coalesce(fits, true) or pct or cnt or pk or (lo and ro) then struct_pack(c := 'CONFIRMED_DIFFERENT_SKU', w := 'hard_identity_conflict', s := 99.0)
    when other_code and (lo <> ro or not coalesce(sub, true)) then struct_pack(c := 'CONFIRMED_DIFFERENT_SKU', w := 'different_barcode_plus_variant_difference', s := 99.0)
    when other_code then struct_pack(c := 'NEEDS_MANUAL_REVIEW', w := 'barcode_conflict_requires_external_confirmation', s := 75.0)
    when lo <> ro then struct_pack(c := 'NEEDS_MANUAL_REVIEW', w := 'one_sided_sku_variant_requires_confirmation', s := 70.0)
    when not coalesce(sub, true) then struct_pack(c := 'NEEDS_MANUAL_REVIEW', w := 'subtype_difference_requires_confirmation', s := 70.0)
    when {_CORE} and same_code then struct_pack(c := 'CONFIRMED_SAME_SKU', w := 'same_barcode_plus_core_identity', s := 100.0)
    when {_CORE} and shared then struct_pack(c := 'CONFIRMED_SAME_SKU', w := 'same_external_identity_plus_core_identity', s := 99.0)
    when {_CORE} and same_name and sourced and providers >= 2 then struct_pack(c := 'CONFIRMED_SAME_SKU', w := 'independent_sources_plus_exact_core_identity', s := 98.0)
    when {_CORE} then struct_pack(c := 'NEEDS_MANUAL_REVIEW', w := 'core_identity_matches_but_no_independent_confirmation', s := 85.0)
    when brands and cat and coalesce(fits, true) and (same_name or common >= 1 or same_pct or same_pk) then struct_pack(c := 'NEEDS_MANUAL_REVIEW', w := 'related_core_identity_needs_more_evidence', s := 75.0)
    when not cat and likeness is null then struct_pack(c := 'CONFIRMED_DIFFERENT_SKU', w := 'weak_name_and_incompatible_category', s := 95.0)
    else struct_pack(c := 'NEEDS_MANUAL_REVIEW', w := 'insufficient_evidence_for_safe_decision', s := 60.0) end as x from e)"""
