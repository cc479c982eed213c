"""Text normalisation as Column expressions.

Each function takes and returns a Column (or column name).  Accents are folded with
``translate`` over a table derived from Unicode decompositions, so no UDF is needed.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the ECMAScript sense: Java's \s, the separator category and U+FEFF.  The
# category test is one table lookup; a class listing the characters is several times slower.
_OTHER_SPACES = "".join(
    chr(c)
    for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)
SPACE = rf"[\s\p{{Z}}{chr(0xFEFF)}]"
TRIM_CHARS = " \t\n\x0b\f\r" + _OTHER_SPACES
_ACCENTS = f"[{chr(0x300)}-{chr(0x36F)}]+"
# ASCII word edges; Java's own \b also treats accented letters as word characters.
EDGE_L = r"(?<![A-Za-z0-9_])"
EDGE_R = r"(?![A-Za-z0-9_])"
_LETTERS_AND_DIGITS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" "ÁÉÍÓÚÜÑáéíóúüñ"
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def _fold_table() -> tuple[str, str]:
    """Precomposed letters whose canonical decomposition is one base plus accents."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) < 2:
            continue
        base = [p for p in parts if not 0x300 <= ord(p) <= 0x36F]
        if len(base) == 1:
            source.append(ch)
            target.append(base[0])
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold_accents(c) -> Column:
    """Drop accents; pure ASCII values skip the translation."""

    def fold(x: Column) -> Column:
        folded = F.regexp_replace(F.translate(x, _FOLD_FROM, _FOLD_TO), _ACCENTS, "")
        return F.when(x.rlike(r"[^\x00-\x7F]"), folded).otherwise(x)

    return bind(c, fold)


def fold_same_length(c) -> Column:
    """Fold to lower-case ASCII words without moving any offset.

    Accented letters map 1:1 and every other non-alphanumeric character becomes one
    space, so a match position in the result is a position in the input.
    """
    c = col(c)
    return F.lower(F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), "[^A-Za-z0-9]", " "))


def alnum_count(c) -> Column:
    """Letters (with Spanish accents) and digits in the value."""
    c = col(c)
    return F.length(c) - F.length(F.translate(c, _LETTERS_AND_DIGITS, ""))


def trim_ws(c) -> Column:
    return F.btrim(col(c), F.lit(TRIM_CHARS))


def collapse(c) -> Column:
    """White-space runs become one space; ends trimmed."""
    return trim_ws(F.regexp_replace(col(c), SPACE + "+", " "))


def norm_search(c) -> Column:
    return F.lower(collapse(fold_accents(c)))


def norm_words(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def norm_key(c) -> Column:
    return F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "")


def norm_punct(c) -> Column:
    """Fold, turn a fixed punctuation set into spaces, collapse, lower."""
    return F.lower(collapse(F.regexp_replace(fold_accents(c), r"[°º#.,:;()\[\]{}_\-]", " ")))


def clean_cell(c) -> Column:
    return collapse(F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))


def clean_value(c) -> Column:
    """Null-safe cell text: line breaks and white-space runs collapse to one space."""
    return F.coalesce(collapse(c), F.lit(""))


def drop_controls(c) -> Column:
    """Remove (not replace) control characters, then collapse."""
    return collapse(F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def json_value(c) -> Column:
    """One raw JSON value (as text) to a cell.

    Arrays join their non-empty items with ``"; "``, objects keep their JSON text,
    scalars lose their quotes.
    """

    def cell(x: Column) -> Column:
        items = F.from_json(x, "array<string>")
        joined = F.array_join(F.filter(F.transform(items, clean_value), lambda i: i != ""), "; ")
        return (
            F.when(x.isNull(), F.lit(""))
            .when(x.startswith("["), F.coalesce(joined, clean_value(x)))
            .otherwise(clean_value(x))
        )

    return bind(c, cell)


def normalize_line(c) -> Column:
    return trim_ws(F.regexp_replace(col(c), r"[ \t\f\x0B]+", " "))


def split_lines(c) -> Column:
    return F.split(col(c), r"\r?\n", -1)


def page_lines(c) -> Column:
    """Non-blank normalised lines of a page text, in order."""
    return F.filter(F.transform(split_lines(c), normalize_line), lambda x: x != "")


def sanitize_raw_text(c) -> Column:
    """Recognised text for download: LF only, no control characters but tab, right-trimmed."""
    c = F.regexp_replace(col(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f]", "")
    return trim_ws(F.regexp_replace(c, rf"[ \t\p{{Zs}}{chr(0xFEFF)}]+(?=\n|\z)", ""))


def strip_fences(c) -> Column:
    """Remove one Markdown code fence around a JSON or CSV answer."""

    def unfence(x: Column) -> Column:
        fenced = F.regexp_extract(x, r"(?is)^```(?:json|csv)?\s*(.*?)\s*```$", 1)
        loose = F.regexp_replace(F.regexp_replace(x, r"(?i)^```(?:json)?\s*", ""), r"```\z", "")
        inner = F.when(x.startswith("```"), bind(fenced, lambda f: F.when(f != "", f).otherwise(loose)))
        return trim_ws(inner.otherwise(F.regexp_replace(x, r"```\z", "")))

    return bind(trim_ws(c), unfence)


def sanitize_file_name(c) -> Column:
    c = F.regexp_replace(col(c), r"[\x00-\x1f\x7f]", "")
    c = F.substring(trim_ws(F.regexp_replace(c, r"[\\/]+", "-")), 1, 180)
    return F.when(c == "", F.lit("documento")).otherwise(c)


def raw_text_file_name(c) -> Column:
    base = trim_ws(F.regexp_replace(sanitize_file_name(c), r"\.[^.]+\z", ""))
    return F.concat(F.when(base == "", F.lit("documento")).otherwise(base), F.lit("_ocr_bruto.txt"))


def sanitize_error(c) -> Column:
    compact = collapse(c)
    low = F.lower(compact)
    html = low.contains("<!doctype") | low.contains("<html") | low.contains("unexpected token '<'")
    safe = F.substring(F.translate(compact, "<>", "‹›"), 1, 220)
    return F.when(html, F.lit("AI response could not be converted to structured output")).otherwise(safe)


def mask_email(c) -> Column:
    c = col(c)
    local = F.substring_index(c, "@", 1)
    domain = F.coalesce(F.get(F.split(c, "@"), F.lit(1)), F.lit(""))
    shown = F.when(F.length(local) <= 2, F.substring(local, 1, 1)).otherwise(F.substring(local, 1, 2))
    masked = F.concat(shown, F.lit("***"))
    return F.when(domain != "", F.concat(masked, F.lit("@"), domain)).otherwise(masked)


def truncate_example(c, limit: int) -> Column:
    compact = trim_ws(F.replace(col(c), F.lit(chr(0)), F.lit("")))
    cut = F.concat(F.substring(compact, 1, limit), F.lit("..."))
    return F.when(F.length(compact) > limit, cut).otherwise(compact)


def client_slug(c) -> Column:
    slug = F.substring(F.upper(F.regexp_replace(fold_accents(c), "[^a-zA-Z0-9]+", "")), 1, 14)
    return F.when(slug == "", F.lit("CLIENTE")).otherwise(slug)


def title_case(c) -> Column:
    return trim_ws(F.initcap(F.lower(col(c))))


def contains_count(text: Column, needles: list[str]) -> Column:
    """How many of the (already normalised) needles occur in the text."""
    total = F.lit(0)
    for needle in needles:
        total = total + F.when(text.contains(needle), 1).otherwise(0)
    return total


def found_items(text: Column, items: list[str], needles: list[str]) -> Column:
    """The items whose needle occurs in the text, in list order."""
    if not items:
        return F.array().cast("array<string>")
    hits = [F.when(text.contains(n), F.lit(i)) for i, n in zip(items, needles)]
    return F.array_compact(F.array(*hits))


# --- the same normalisations on Python strings, for constant folding at plan time


def py_fold(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s) if not 0x300 <= ord(ch) <= 0x36F)


def py_key(s: str) -> str:
    return "".join(ch for ch in py_fold(s) if ch.isascii() and ch.isalnum()).lower()


def py_words(s: str) -> str:
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in py_fold(s)).lower().split())


def py_search(s: str) -> str:
    return " ".join(py_fold(s).split()).lower()


def py_punct(s: str) -> str:
    return " ".join("".join(" " if ch in "°º#.,:;()[]{}_-" else ch for ch in py_fold(s)).split()).lower()


# --- the same on whole texts inside a Python worker, at a third of the cost or less


_WIDE_TABLE = dict(zip(_FOLD_FROM, _FOLD_TO)) | {chr(c): "" for c in range(0x300, 0x370)} | dict.fromkeys("°º" + _OTHER_SPACES, " ")


def text_punct(s: str) -> str:
    """What ``norm_punct`` makes of a text; only the newest letters of Unicode may keep their case."""
    for c in () if s.isascii() else set(s) & _WIDE_TABLE.keys():
        s = s.replace(c, _WIDE_TABLE[c])
    for c in "#.,:;()[]{}_-\t\n\x0b\f\r":
        s = s.replace(c, " ")
    while "  " in s:
        s = s.replace("  ", " ")
    return s.strip(" ").lower()


def text_lines(s: str) -> list[str]:
    """What ``page_lines`` makes of a text."""
    for c in "\t\f\x0b":
        s = s.replace(c, " ")
    while "  " in s:
        s = s.replace("  ", " ")
    return [x for x in (line.strip(TRIM_CHARS) for line in s.replace("\r\n", "\n").split("\n")) if x]
