"""Identifier, name and place predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import (
    EDGE_L, EDGE_R, bind, col, collapse, fold_same_length, norm_key, norm_words, py_key, py_words,
    title_case, trim_ws,
)

_LETTER = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]"
_URL = r"(?i)https?://\S+"
_SCANNER = r"(?i)Escaneado\s+con\s+CamScanner"
_SCANNER_WORD = "(?i)" + EDGE_L + "CamScanner" + EDGE_R


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    """Value for an exact key, else null.  Both lists fold to constants at plan time."""
    keys = F.split(F.lit("|".join(k for k, _ in pairs)), r"\|")
    values = F.split(F.lit("|".join(v for _, v in pairs)), r"\|")
    return F.get(values, F.array_position(keys, key).cast("int") - 1)


def words_of(c) -> Column:
    """Lower-case ASCII words separated by one space."""
    return F.trim(F.regexp_replace(fold_same_length(c), " +", " "))


def digits(c) -> Column:
    return F.regexp_replace(col(c), r"\D", "")


def valid_cuil(c) -> Column:
    return F.length(digits(c)).isin(10, 11)


def valid_dni(c) -> Column:
    return F.length(digits(c)).isin(7, 8)


def valid_cuit(c) -> Column:
    return col(c).rlike(r"^\d{2}-\d{8}-\d\z")


def province(c) -> Column:
    """Canonical province for an exact (normalised) name, else null."""
    return province_of(words_of(c))


def province_of(words: Column) -> Column:
    return _lookup([(py_words(p), p) for p, _ in V.PROVINCES], words)


def supplier_province(c) -> Column:
    """The same lookup with the supplier extractor's shorter list and key form."""
    return _lookup([(py_key(p), p) for p, listed in V.PROVINCES if listed], norm_key(c))


_PROVINCE_ANYWHERE = (
    "(" + "|".join(py_words(p).replace(" ", " +") for p, _ in V.PROVINCES) + ")"
)
_PROVINCE_LAST = "(?s)^(.*)" + _PROVINCE_ANYWHERE


def has_province(c) -> Column:
    return fold_same_length(c).rlike(_PROVINCE_ANYWHERE)


def last_province(c) -> Column:
    """``struct(name, pos)`` of the last province named in the text; pos is 0-based or -1."""

    def last(folded: Column) -> Column:
        found = folded.rlike(_PROVINCE_ANYWHERE)
        return F.struct(
            F.when(found, province(F.regexp_extract(folded, _PROVINCE_LAST, 2))).alias("name"),
            F.when(found, F.length(F.regexp_extract(folded, _PROVINCE_LAST, 1)))
            .otherwise(-1).alias("pos"),
        )

    return bind(fold_same_length(c), last)


def known_locality(c) -> Column:
    return locality_of(words_of(c))


def locality_of(words: Column) -> Column:
    return _lookup([(py_words(p), p) for p in V.LOCALITIES], words)


def apply_corrections(c) -> Column:
    c = col(c)
    for wrong, right in V.MISREADS:
        c = F.regexp_replace(c, "(?i)" + EDGE_L + wrong + EDGE_R, right)
    return c


def has_workplace(c) -> Column:
    return col(c).rlike(V.WORKPLACE)


def roster_noise(c) -> Column:
    """Repeated header or watermark line of a roster."""


    def noise(w: Column) -> Column:
        combined = w.contains("nombre y apellido") & w.contains("cuil") & w.contains("localidad")
        return w.isin(V.ROSTER_NOISE) | combined

    return bind(words_of(c), noise)


def likely_person_name(c) -> Column:
    """Roster variant: two or more words, none of header, workplace, place or identifier."""

    def likely(t: Column) -> Column:
        named = lambda w: province_of(w).isNull() & locality_of(w).isNull()
        return (
            (F.length(t) >= 5)
            & t.rlike(_LETTER)
            & t.rlike(r"\S\s+\S")
            & ~has_workplace(t)
            & ~t.rlike(V.CUIL)
            & ~roster_noise(t)
            & bind(words_of(t), named)
        )

    return bind(trim_ws(c), likely)


def likely_person_name_company(c) -> Column:
    """Company-list variant: two to eight words, no digit, no legal suffix."""

    def likely(t: Column) -> Column:
        return (
            (F.length(t) >= 5)
            & t.rlike(r"\S\s+\S")
            & ~t.rlike(r"^\S+(?:\s+\S+){8}")
            & t.rlike(_LETTER)
            & ~t.rlike(r"\d")
            & ~t.rlike(V.COMPANY_SUFFIX)
            & province(t).isNull()
            & ~norm_words(t).isin(V.COMPANY_NOISE)
        )

    return bind(trim_ws(c), likely)


def likely_company(c) -> Column:
    return bind(trim_ws(c), lambda t: (F.length(t) >= 5) & t.rlike(V.COMPANY_SUFFIX) & ~t.rlike(V.CUIT))


def likely_locality(c) -> Column:
    return bind(trim_ws(c), lambda t: (
        F.length(t).between(3, 60)
        & ~t.contains(",")
        & ~t.rlike(r"\d{7,}")
        & ~t.rlike(V.CUIT)
        & ~t.rlike(V.COMPANY_SUFFIX)
        & province(t).isNull()
    ))


def clean_roster_line(c) -> Column:
    """One recognised roster line without URLs and watermarks; '' when it is only noise."""
    c = apply_corrections(c)
    c = F.regexp_replace(F.regexp_replace(c, _URL, " "), _SCANNER, " ")
    c = collapse(F.regexp_replace(c, _SCANNER_WORD, " "))
    noise = lambda x: x.rlike("(?i)^(?:SECRETARIA|FOLIO|SEC)" + EDGE_R) | roster_noise(x)
    return bind(c, lambda x: F.when(noise(x), F.lit("")).otherwise(x))


def clean_company_line(c) -> Column:
    c = F.regexp_replace(F.regexp_replace(col(c), _URL, " "), _SCANNER, " ")
    c = F.regexp_replace(c, _SCANNER_WORD, " ")
    c = collapse(F.regexp_replace(c, r"\|+", " "))
    return bind(c, lambda x: F.when(norm_words(x).isin(V.COMPANY_NOISE), F.lit("")).otherwise(x))


_STRAY_PREFIX = "(?i)^(?:(?:OD|D|0|00|10)" + EDGE_R + r"[\s:;,.-]*)+"
_STRAY_PREFIX_BAR = "(?i)^(?:(?:OD|D|0|00|10)" + EDGE_R + r"[\s|:;,.-]*)+"
_STAMPS = "(?i)" + EDGE_L + "(?:SECRETARIA|FOLIO|SEC)" + EDGE_R
_FIRST_WORKPLACE = "(?s)^(.*?)" + V.WORKPLACE


def clean_locality(c) -> Column:
    c = F.regexp_replace(col(c), r"\|", " ")
    c = F.regexp_replace(c, _FIRST_WORKPLACE, "$1 ")
    c = F.regexp_replace(F.regexp_replace(c, _STRAY_PREFIX, ""), _STAMPS, " ")
    c = collapse(F.regexp_replace(c, EDGE_L + r"\d{1,4}" + EDGE_R, " "))
    return bind(c, lambda x: F.coalesce(known_locality(x), x))


def normalize_roster_value(column: str, c) -> Column:
    value = apply_corrections(collapse(F.coalesce(col(c), F.lit(""))))
    if column == "CUIL":
        return digits(value)
    if column == "Localidad":
        value = F.regexp_replace(value, _STRAY_PREFIX_BAR, "")
        return collapse(F.regexp_replace(value, _STAMPS, " "))
    if column == "Provincia":
        return F.coalesce(province(value), trim_ws(value))
    return value


def normalize_person_name(c) -> Column:
    return collapse(F.regexp_replace(col(c), r"^\d{1,4}\s*[-.)]?\s*", ""))


def locality_title(c) -> Column:
    return title_case(c)
