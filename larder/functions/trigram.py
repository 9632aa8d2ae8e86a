"""Trigram similarity of texts: ``similarity`` as a native expression, ``word_similarity`` as a vectorised function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larder.functions.text import unicode_words


def trigrams(col: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded by two blanks before and one after."""
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(unicode_words(col), of_word)))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a share of all of two trigram sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def _ordered(text: str) -> list[str]:
    out, word = [], ""
    for c in [*text.lower(), " "]:
        if c.isalnum():
            word += c
        elif word:
            padded = f"  {word} "
            out.extend(padded[i : i + 3] for i in range(len(padded) - 2))
            word = ""
    return out


def best_extent(query: str | None, text: str | None) -> float:
    """Greatest share of the query's trigrams met by a run of the text's ordered trigrams that begins and ends with one of them."""
    wanted, seen = set(_ordered(query or "")), _ordered(text or "")
    if not wanted:
        return 0.0
    at = [i for i, t in enumerate(seen) if t in wanted]
    best = 0.0
    for n, start in enumerate(at):
        run, shared = set(), set()
        last = start
        for end in at[n:]:
            run.update(seen[last : end + 1])
            last = end + 1
            shared.add(seen[end])
            best = max(best, len(shared) / (len(wanted) + len(run) - len(shared)))
            if best == 1.0:
                return best
    return best


def _extents(query: pd.Series, text: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(query, text, strict=True):  # pairs repeat: each distinct one is computed once
        if pair not in known:
            known[pair] = best_extent(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def word_similarity(query: Column, text: Column) -> Column:
    """``best_extent`` of two columns, in Arrow batches."""
    return F.pandas_udf(_extents, DoubleType())(query, text)
