"""Several values packed in one field: infer the delimiters of each source, split, explode with position.

Candidate signs are scored per source on two figures taken over all rows: how often a piece cut by the sign also stands
alone as a whole value of that source (piece type regularity), and how steady the number of non-blank pieces is
(piece-count consistency). Signs that pass become delimiters; quoted spans, remarks in round brackets, numbers and
one-letter abbreviations with a stroke are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.runtime import blank_trim, salted_join

#: Signs that may delimit values, by name; ``spaced_plus`` is a plus with blanks on both sides.
CANDIDATES = {
    "comma": ",", "semicolon": ";", "stroke": "/", "bar": "|", "line": "\n", "tab": "\t", "bullet": "•",
    "spaced_plus": "\x02", "plus": "+", "hyphen": "-", "colon": ":", "ampersand": "&", "full_stop": ".",
}
#: Sources up to which each has its own pattern as a constant; more are joined to theirs, with the same result.
MANY_SOURCES = 200
#: A sign is a delimiter of a source if its score reaches this.
MIN_SCORE = 0.25
_MARK = "\x01"

_QUOTED = r'"[^"]*"(?:"[^"]*")*|«[^»]*»|“[^”]*”|„[^“”]*[“”]'
_REMARK = r"\([^()]*\)"
_NUMBER = r"(?<=\p{N})[,/.]\p{N}+"
_ABBREVIATION = r"(?<=(?<![\p{L}\p{N}]|\p{N}\s)\p{L})/\p{L}{1,3}(?!\p{L})"
_LIST = r"(?s)^\s*\[.*\]\s*$"


def _class(signs: str) -> str:
    return "".join("\\" + s if s in "|+-.&/[]^" else s for s in signs)


def _prepared(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, "[\x01\x02]", " "), r"(?<=\s)\+(?=\s)", "\x02")


def _as_list(raw: Column) -> Column:
    """The elements of a JSON list of strings, null if the value is none."""
    return F.when(raw.rlike(_LIST), F.from_json(raw, "array<string>"))


def unquoted(piece: Column) -> Column:
    """Trimmed, without one pair of quotation marks around the whole; doubled marks inside a CSV-style pair count as one."""
    trimmed = blank_trim(piece)
    inner = trimmed.substr(F.lit(2), F.length(trimmed) - 2)
    straight = trimmed.rlike(r'(?s)^"[^"]*(?:""[^"]*)*"$') & (F.length(trimmed) >= 2)
    angled = trimmed.rlike("(?s)^(?:«[^«»]*»|“[^“”]*”|„[^„“”]*[“”])$")
    whole = F.when(straight, F.replace(inner, F.lit('""'), F.lit('"'))).when(angled, inner).otherwise(trimmed)
    return blank_trim(whole)


def split_by(raw: Column, signs: str | Column) -> Column:
    """Array of the values of ``raw`` cut at ``signs`` (a string, or a column holding the body of a character class)."""
    spans = f"{_QUOTED}|{_REMARK}|{_NUMBER}|{_ABBREVIATION}"
    opening = '"«“„('
    if isinstance(signs, str):
        body = _class(signs)
        tokens = F.regexp_extract_all(_prepared(raw), F.lit(f"{spans}|[^{opening}{body}]+|[{opening}]" + (f"|[{body}]" if body else "")), F.lit(0))
        cut = lambda t: t.rlike(f"^[{body or _MARK}]$")
    else:
        body = F.when(F.length(signs) == 0, F.lit(_MARK)).otherwise(signs)
        tokens = F.regexp_extract_all(_prepared(raw), F.concat(F.lit(f"{spans}|[^{opening}"), body, F.lit(f"]+|[{opening}]|["), body, F.lit("]")), F.lit(0))
        cut = lambda t: F.regexp_like(t, F.concat(F.lit("^["), body, F.lit("]$")))
    marked = F.array_join(F.transform(tokens, lambda t: F.when(cut(t), F.lit(_MARK)).otherwise(t)), "")
    pieces = F.split(F.replace(marked, F.lit("\x02"), F.lit("+")), _MARK)
    values = F.transform(F.coalesce(_as_list(raw), pieces), unquoted)
    return F.filter(values, lambda v: v.isNotNull() & (F.length(v) > 0))


def _folded(piece: Column) -> Column:
    return F.lower(unquoted(piece))


def score_signs(values: DataFrame, source: str, raw: str) -> DataFrame:
    """(source, sign, rows, known, steady, score) for every candidate sign and source of ``values``.

    ``known``: share of the pieces, in rows where the sign is the only candidate outside protected spans, that also occur as
    whole values of the source. ``steady``: share of the sign's rows with at least two non-blank pieces, damped by the
    spread of their number on a log scale (a few very long lists decide nothing). One shuffle, on distinct pieces, after map-side counting."""
    names, signs = list(CANDIDATES), list(CANDIDATES.values())
    masked = F.regexp_replace(_prepared(F.col(raw)), f"{_QUOTED}|{_REMARK}|{_NUMBER}|{_ABBREVIATION}", "q")
    all_signs = _class("".join(signs))
    base = values.filter(F.col(raw).isNotNull() & ~F.col(raw).rlike(_LIST)).select(F.col(source).alias("_s"), F.col(raw).alias("_v"), masked.alias("_m"))
    # the class of all candidate signs present outside protected spans, as one sorted string
    base = base.withColumn("_signs", F.array_distinct(F.regexp_extract_all("_m", F.lit(f"[{all_signs}]"), F.lit(0))))
    only = F.when(F.size("_signs") == 0, F.lit("")).when(F.size("_signs") == 1, F.element_at("_signs", 1))
    pieces = F.when(F.size("_signs") == 0, F.array("_v")).otherwise(split_by(F.col("_v"), F.when(only.isin(*[s for s in signs if s in "|+-.&/"]), F.concat(F.lit("\\"), only)).otherwise(only)))
    cut = base.filter(F.size("_signs") <= 1).select("_s", only.alias("_sign"), F.explode(pieces).alias("_p"))
    cut = cut.select("_s", "_sign", _folded(F.col("_p")).alias("_p")).filter(F.length("_p") > 0)
    counted = cut.groupBy("_s", "_p").agg(
        F.sum((F.col("_sign") == "").cast("long")).alias("_whole"), *[F.sum((F.col("_sign") == s).cast("long")).alias(f"n_{n}") for n, s in CANDIDATES.items()]
    )
    known = counted.groupBy("_s").agg(
        *[(F.sum(F.when(F.col("_whole") > 0, F.col(f"n_{n}")).otherwise(0)) / F.nullif(F.sum(f"n_{n}"), F.lit(0))).alias(f"k_{n}") for n in names]
    )
    amount = {n: F.when(F.array_contains("_signs", s), F.size(F.filter(F.split("_m", _class(s)), lambda p: F.length(blank_trim(p)) > 0))) for n, s in CANDIDATES.items()}
    steady = base.groupBy("_s").agg(
        *[F.count(amount[n]).alias(f"r_{n}") for n in names],
        *[(F.avg((amount[n] >= 2).cast("double")) / (1 + F.coalesce(F.stddev_pop(F.log(F.least(F.greatest(amount[n], F.lit(1)), F.lit(64)))), F.lit(0.0)) / 2)).alias(f"c_{n}") for n in names],
    )
    joined = known.join(steady, "_s", "full")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("sign"), F.coalesce(f"r_{n}", F.lit(0)).alias("rows"), F.coalesce(f"k_{n}", F.lit(0.0)).alias("known"), F.coalesce(f"c_{n}", F.lit(0.0)).alias("steady")) for n in names]))
    return joined.select(F.col("_s").alias(source), rows.alias("_r")).select(source, "_r.*").withColumn("score", F.col("known") * F.col("steady"))


def split_packed(values: DataFrame, source: str, raw: str, min_score: float = MIN_SCORE) -> DataFrame:
    """``values`` with ``pos`` (from 1), ``val`` and ``n_values`` for each value packed in ``raw``; one row per value, other columns kept.

    ``source`` names the column that says where a row comes from; delimiters are inferred for each source apart. Defined
    cases: null, empty or blank ``raw`` gives no row; empty places between delimiters are neither values nor counted;
    repeated values and repeated rows are kept; a null source is a source of its own; an empty table gives an empty one; a
    value of any length is split whole. Columns named ``pos``, ``val`` or ``n_values`` in the input are replaced."""
    kept = values.drop("pos", "val", "n_values")
    keyed = kept.withColumn("_src", F.coalesce(F.col(source).cast("string"), F.lit("\x00")))
    scores = score_signs(keyed, "_src", raw)
    by_name = F.create_map(*[x for n, s in CANDIDATES.items() for x in (F.lit(n), F.lit(_class(s)))])
    body = scores.groupBy("_src").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("score") >= min_score, by_name[F.col("sign")]))), "").alias("_body"))
    few = body.limit(MANY_SOURCES + 1).collect()
    if len(few) <= MANY_SOURCES:  # as a rule: the pattern becomes a literal of each source
        known = {r["_src"]: r["_body"] for r in few}
        if not known:
            cut = keyed.withColumn("_values", split_by(F.col(raw), ""))
        else:
            branches = None
            for name, signs in sorted(known.items()):
                plain = "".join(s for s in CANDIDATES.values() if _class(s) in _bodies(signs))
                cond = F.col("_src") == name
                branches = F.when(cond, split_by(F.col(raw), plain)) if branches is None else branches.when(cond, split_by(F.col(raw), plain))
            cut = keyed.withColumn("_values", branches)
    else:
        cut = salted_join(keyed, body, ["_src"], how="left").withColumn("_values", split_by(F.col(raw), F.coalesce("_body", F.lit(""))))
    return cut.select(*kept.columns, F.size("_values").alias("n_values"), F.posexplode("_values").alias("_pos", "val")).withColumn("pos", (F.col("_pos") + 1).cast("int")).drop("_pos")


def _bodies(body: str) -> set[str]:
    out, i = set(), 0
    while i < len(body):
        step = 2 if body[i] == "\\" else 1
        out.add(body[i : i + step])
        i += step
    return out


def packed_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, raw): the named fields below each other, from one scan of only these columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields]))
    return df.select(key, pairs.alias("_f")).select(key, "_f.*").filter(F.col("raw").isNotNull())


def found_packed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, pos, val) of each value of a field that holds two or more values."""
    long = packed_fields(df, key, fields)
    return split_packed(long, "field_name", "raw").filter("n_values >= 2").select(key, "field_name", "pos", "val")
