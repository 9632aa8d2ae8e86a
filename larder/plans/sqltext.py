"""Independent SQL counterparts (DuckDB dialect) of the text expressions, for the queries' SQL."""

from __future__ import annotations

from larder.functions import text as T


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'))"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
    return x


def to_latin(x: str) -> str:
    return norm(f"translate({chain(f'lower({x})', T.LATIN_MANY.items())}, {_quoted(T.LATIN_ONE[0])}, {_quoted(T.LATIN_ONE[1])})")


def to_cyrillic(x: str) -> str:
    return norm(f"translate({chain(chain(f'lower({x})', T.CYRILLIC_GROUPS), T.CYRILLIC_MANY.items())}, {_quoted(T.CYRILLIC_ONE[0])}, {_quoted(T.CYRILLIC_ONE[1])})")


def to_russian(x: str) -> str:
    return norm(f"translate(lower({x}), {_quoted(T.LATIN_KEYS)}, {_quoted(T.RUSSIAN_KEYS)})")


def to_english(x: str) -> str:
    return norm(f"translate(lower({x}), {_quoted(T.RUSSIAN_KEYS)}, {_quoted(T.LATIN_KEYS)})")


def is_latin(x: str) -> str:
    return f"regexp_matches(lower({x}), '[a-z]')"


def is_cyrillic(x: str) -> str:
    return f"regexp_matches(lower({x}), '[а-яё]')"


def in_list(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


def trigrams(x: str) -> str:
    found = f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
    return f"list_distinct(flatten(list_transform({found}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def tokens3(x: str) -> str:
    """Distinct words of three or more letters without digits, in order."""
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: length(w) >= 3 and not regexp_matches(w, '[0-9]'))"
