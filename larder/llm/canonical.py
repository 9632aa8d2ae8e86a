"""Mapping freely entered values to the entries of a reference list.

Every name and alias of the reference gives keys (compact spelling, Latin skeleton, abbreviated first word), and every key
its symmetric deletes; that dictionary, bounded in size, is broadcast. A value is stripped of company forms and marks,
repaired for mixed alphabets, tried in the other keyboard layout and in Latin skeleton, and looked up by its own deletes,
so an edit distance up to the bound needs no scan of the list. Candidates are ranked by a weighted Damerau-Levenshtein
distance, then by how often the entry occurs exactly in the corpus, then by id; what has no candidate is reported as 0.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.language import LATIN
from larder.operators.packed import split_by
from larder.runtime import Scratch

#: Entries of one broadcast dictionary; a longer reference is taken in blocks, each mapped and the best answer kept.
BLOCK_ENTRIES = 20_000
#: Edit distance allowed: one up to this compact length, two beyond it; shorter keys than the least must match exactly.
LONG_KEY, LEAST_KEY = 11, 5
#: Signs between aliases.
ALIAS_SIGNS = ",;/|\n\t•\x02"
#: Entries that say "no brand".
NOTHING = {"", "-", "нет", "н/д", "n/a", "na", "none", "no", "no brand", "no name", "без бренда", "без марки", "не указан", "не указана", "не указано", "unknown", "неизвестно", "нет бренда"}
#: Company forms and other words that are no part of a name.
FORMS = ["ооо", "ао", "зао", "пао", "оао", "ип", "тм", "тд", "бренд", "россия", "рф", "premium", "оригинал", "original", "brand"]
#: Latin letters that look like Cyrillic ones.
_ALIKE = dict(zip("aceopxyktmhbABCEHKMOPTXY", "асеорхуктмнвАВСЕНКМОРТХУ", strict=True))
#: The two keyboard layouts.
_LATIN_KEYS, _RUSSIAN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюё"
_LAYOUT = dict(zip(_LATIN_KEYS, _RUSSIAN_KEYS, strict=True))
_ROWS = ["йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
_NEAR = {frozenset(p) for row in _ROWS for p in zip(row, row[1:], strict=False)}
_VOWELS = frozenset("аеиоуыэюяёaeiouy")
_CYRILLIC = re.compile("[а-яё]", re.I)
_DECORATION = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(FORMS)}|\d+[.,]?\d*\s?(?:л|г|кг|мл))(?!\w)|[®™©]")


def compact(text: str) -> str:
    """Letters and digits only, lower case, ё as е."""
    return re.sub(r"[\W_]+", "", text.lower().replace("ё", "е"))


def skeleton(key: str) -> str:
    """A compact spelling in Latin letters, with letters of one sound made one."""
    out = "".join(LATIN.get(c, c) for c in key)
    for a, b in (("x", "ks"), ("j", "dzh"), ("w", "v"), ("y", "i")):
        out = out.replace(a, b)
    return out


def bare_name(text: str) -> str:
    """Without company forms, marks and volumes, unless nothing else is left."""
    out = re.sub(r"\(\s*\)", " ", _DECORATION.sub(" ", text))
    return out if compact(out) else text


def spellings(text: str) -> list[str]:
    """Keys under which a value may stand in the dictionary, the likeliest first; a skeleton is marked by ``~``."""
    name = bare_name(text)
    if _CYRILLIC.search(name):
        key = compact("".join(_ALIKE.get(c, c) for c in name))
        out = [key, "~" + skeleton(key)]
    else:
        key = compact(name)
        out = [key, compact("".join(_LAYOUT.get(c, c) for c in name.lower())), "~" + skeleton(key)]
    return list(dict.fromkeys(k for k in out if k.strip("~")))


def reference_keys(name: str) -> list[str]:
    """Dictionary keys of a reference name: compact, skeleton, and for two words the first cut to three letters."""
    key = compact(name)
    out = [key, "~" + skeleton(key)]
    words = name.split()
    if len(words) == 2 and len(words[0]) > 4:
        out.append("." + compact(words[0])[:3] + compact(words[1]))
    return [k for k in out if k.strip("~.")]


def allowed(key: str) -> int:
    """Edits allowed for a key of this length."""
    n = len(key.lstrip("~"))
    return 0 if n < LEAST_KEY or key.startswith(".") else 1 if n < LONG_KEY else 2


def deletes(key: str, edits: int) -> set[str]:
    """The key with up to ``edits`` characters left out."""
    mark, body = (key[0], key[1:]) if key[:1] in "~." else ("", key)
    return {mark + "".join(c for i, c in enumerate(body) if i not in gone) for k in range(edits + 1) for gone in combinations(range(len(body)), k)}


def weighted_distance(a: str, b: str) -> tuple[float, int]:
    """(cost, edits) of the cheapest restricted Damerau-Levenshtein alignment: neighbouring keys, vowels, swaps and doubled letters cost less than one."""
    inf = (1e9, 99)
    prev2: list = []
    prev = [(float(j), j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [(float(i), i)]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            if x == y:
                best = prev[j - 1]
            else:
                cost = 0.7 if frozenset((x, y)) in _NEAR else 0.8 if x in _VOWELS and y in _VOWELS else 1.0
                best = (prev[j - 1][0] + cost, prev[j - 1][1] + 1)
            gone = prev[j][0] + (0.5 if i > 1 and a[i - 2] == x else 1.0), prev[j][1] + 1
            come = row[j - 1][0] + (0.5 if j > 1 and b[j - 2] == y else 1.0), row[j - 1][1] + 1
            swap = (prev2[j - 2][0] + 0.8, prev2[j - 2][1] + 1) if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y else inf
            row.append(min(best, gone, come, swap))
        prev2, prev = prev, row
    return prev[-1]


class Dictionary:
    """Symmetric-delete dictionary of one block of the reference; ``doubtful`` has abbreviations that other blocks make ambiguous."""

    def __init__(self, names: list[tuple[int, str]], frequency: dict[int, int], doubtful: frozenset[str] = frozenset()):
        self.exact: dict[str, set[int]] = defaultdict(set)
        for entry, name in names:
            for key in reference_keys(name):
                self.exact[key].add(entry)
        self.exact = {k: v for k, v in self.exact.items() if not (k.startswith(".") and (len(v) > 1 or k in doubtful))}
        self.frequency = frequency
        self.longest = max((len(k) for k in self.exact), default=0)
        self.near: dict[str, list[str]] = defaultdict(list)
        for key in self.exact:
            edits = max(allowed(key), 0)
            if edits:
                # a value longer or shorter by an edit may have another bound: index with the greater one
                for d in deletes(key, 2 if len(key.lstrip("~")) >= LONG_KEY - 1 else 1):
                    self.near[d].append(key)

    def _first(self, entries: set[int]) -> int:
        return min(entries, key=lambda e: (-self.frequency.get(e, 0), e))

    def look_up(self, value: str | None) -> tuple[int, float]:
        """(entry, cost); entry 0 with cost infinite if nothing is near enough."""
        return self.ranked(value)[:2]

    def ranked(self, value: str | None) -> tuple[int, float, int]:
        """(entry, cost, step): ``step`` is the place of the spelling that is met exactly, which ranks equal costs of several blocks."""
        if value is None or value.strip().lower() in NOTHING:
            return 0, float("inf"), 0
        keys = spellings(value)
        for step, key in enumerate(keys):
            if key in self.exact:
                return self._first(self.exact[key]), 0.0, step
        words = bare_name(value).replace(".", ". ").split(None, 2)  # no more than whether there are two
        if len(words) == 2 and words[0].endswith(".") and len(compact(words[0])) >= 2:
            short = "." + compact("".join(_ALIKE.get(c, c) for c in words[0]))[:3] + compact("".join(_ALIKE.get(c, c) for c in words[1]))
            if short in self.exact:
                return self._first(self.exact[short]), 0.1, 0
        best = (float("inf"), 0, 0)
        for step, key in enumerate(keys):
            edits = allowed(key)
            if not edits or len(key) > self.longest + edits:  # longer than any name within reach
                continue
            seen: set[str] = set()
            for d in deletes(key, edits):
                for other in self.near.get(d, ()):
                    if other in seen or other[:1] == "." or (other[0] == "~") != (key[0] == "~"):
                        continue
                    seen.add(other)
                    cost, n = weighted_distance(key.lstrip("~"), other.lstrip("~"))
                    if n <= min(edits, allowed(other)):
                        entry = self._first(self.exact[other])
                        best = min(best, (cost + 0.01 * step, -self.frequency.get(entry, 0), entry))
        return best[2], best[0], 0


def _mapper(blob, cache_size: int = 200_000):
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.extend([Dictionary(*blob.value), {}])
        book, cache = held
        often = book.frequency
        for batch in batches:
            found, costs = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.inf)
            steps, rare = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            column = batch.column(batch.schema.get_field_index("_val")).dictionary_encode()
            answers = []
            for value in column.dictionary.to_pylist():
                answer = cache.get(value)
                if answer is None:
                    if len(cache) >= cache_size:
                        cache.clear()
                    answer = cache[value] = book.ranked(value)
                answers.append(answer)
            index = column.indices.to_numpy(zero_copy_only=False)
            good = ~np.isnan(index.astype(float))
            if answers:
                at = index[good].astype(int)
                found[good], costs[good] = np.array([a[0] for a in answers])[at], np.array([a[1] for a in answers])[at]
                steps[good], rare[good] = np.array([a[2] for a in answers])[at], np.array([-often.get(a[0], 0) for a in answers])[at]
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found), pa.array(costs), pa.array(steps), pa.array(rare)], names=[*batch.schema.names, "_entry", "_cost", "_step", "_rare"])

    return run


def map_values(values: DataFrame, value: str, reference: DataFrame, entry: str, name: str, aliases: str, out: str) -> DataFrame:
    """``values`` with ``out``: the id of the reference entry each value means, 0 for none, and ``out``_cost.

    Two passes over the values, no shuffle: exact matches are counted by entry first, as that frequency ranks equal
    candidates. Defined cases: null, blank and placeholder values map to 0; repeated values map alike; of equal candidates
    the more frequent, then the smaller id wins; an empty reference maps everything to 0; an empty table gives an empty one.
    Columns of ``values`` are kept; an old ``out`` is replaced."""
    spark = values.sparkSession
    kept = values.drop(out, f"{out}_cost")
    listed = reference.select(F.col(entry).cast("bigint").alias("e"), F.explode(F.concat(F.array(F.col(name)), F.coalesce(split_by(F.col(aliases), ALIAS_SIGNS), F.array().cast("array<string>")))).alias("n")).filter("n is not null").distinct().orderBy("e", "n")
    work = kept.withColumn("_val", F.col(value)).withColumn("_row", F.monotonically_increasing_id())
    work = Scratch(spark, "canonical").save(work, "values")
    schema = ", ".join(f"`{c}` {t}" for c, t in [*work.dtypes, ("_entry", "bigint"), ("_cost", "double"), ("_step", "bigint"), ("_rare", "bigint")])
    total = listed.count()
    blocks = [[(r["e"], r["n"]) for r in listed.offset(at).limit(BLOCK_ENTRIES).collect()] for at in range(0, total, BLOCK_ENTRIES)] if total else [[]]
    exact: dict[int, int] = defaultdict(int)
    counted_names: set[str] = set()
    short: dict[str, int] = {}
    doubtful: set[str] = set()
    for block in blocks:
        # a name counts for the first entry that has it, in whichever block
        fresh = [(e, n) for e, n in block if compact(n) not in counted_names]
        counted_names.update(compact(n) for _, n in block)
        for e, n in block if len(blocks) > 1 else ():
            doubtful.update(k for k in reference_keys(n) if k.startswith(".") and short.setdefault(k, e) != e)
        blob = spark.sparkContext.broadcast((fresh, {}))
        counted = work.select("_val").mapInArrow(_exact_counter(blob), "e bigint, n bigint").groupBy("e").agg(F.sum("n").alias("n"))
        for r in counted.collect():  # at most one row per entry of the block
            exact[r["e"]] += r["n"]
    parts = [work.mapInArrow(_mapper(spark.sparkContext.broadcast((block, {e: exact[e] for e, _ in block if e in exact}, frozenset(doubtful)))), schema) for block in blocks]
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        rest = [c for c in found.columns if c != "_row"]
        best = found.groupBy("_row").agg(F.min_by(F.struct(*rest), F.struct("_cost", "_step", "_rare", "_entry")).alias("_b"))
        found = best.select("_row", "_b.*")
    return found.select(*kept.columns, F.col("_entry").alias(out), F.when(F.col("_cost") < 1e9, F.col("_cost")).alias(f"{out}_cost"))


def _exact_counter(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, int] = {}
        for e, n in blob.value[0]:
            keys.setdefault(compact(n), e)
        counts: dict[int, int] = defaultdict(int)
        cache: dict[str, int | None] = {}
        for batch in batches:
            for item in batch.column(0).value_counts().to_pylist():
                value = item["values"]
                if value is None:
                    continue
                if value not in cache:
                    if len(cache) > 200_000:
                        cache.clear()
                    cache[value] = keys.get(compact(value))
                if (e := cache[value]) is not None:
                    counts[e] += item["counts"]
        yield pa.RecordBatch.from_pydict({"e": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    return run
