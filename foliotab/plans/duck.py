"""SQL text helpers for the comparison engine (DuckDB)."""

from __future__ import annotations

SP = r"[\s\x{0b}\x{a0}]"


def fold(x: str) -> str:
    return f"strip_accents({x})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"trim(lower(regexp_replace({fold(x)}, '[^a-zA-Z0-9]+', ' ', 'g')))"


def key(x: str) -> str:
    return f"lower(regexp_replace({fold(x)}, '[^a-zA-Z0-9]+', '', 'g'))"


def search(x: str) -> str:
    return f"lower({collapse(fold(x))})"


def punct(x: str) -> str:
    cleaned = f"regexp_replace({fold(x)}, '[°º#.,:;()\\[\\]{{}}_\\-]', ' ', 'g')"
    return f"lower({collapse(cleaned)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def line(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\f\\v]+', ' ', 'g'))"


def lines(x: str) -> str:
    """List of non-blank normalised lines."""
    parts = f"string_split_regex({x}, '\\r?\\n')"
    mapped = f"list_transform({parts}, lambda s: {line('s')})"
    return f"list_filter({mapped}, lambda s: s <> '')"


def contains_count(x: str, needles) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{n}') AS INT)" for n in needles) + ")"


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def fill(text: str) -> str:
    """Template of a shared input with plain table names."""
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages "
             "benchmark labels conversations").split()
    return text.format(**{n: n for n in names})
