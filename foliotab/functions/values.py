"""Numbers, dates, confidence values and small row helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import bind, col, norm_key, norm_search, py_search, trim_ws


def half_up(c, scale: int) -> Column:
    """Round half up on doubles (``round`` would go away from zero on negatives)."""
    factor = float(10**scale)
    return F.floor(col(c).cast("double") * factor + 0.5).cast("double") / factor


def round_confidence(c) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), half_up(c, 2)))
    return F.when(col(c).isNotNull(), clamped)  # greatest and least skip nulls


def _number(c) -> Column:
    return F.regexp_replace(trim_ws(col(c).cast("string")), ",", ".").try_cast("double")


def normalize_confidence(c) -> Column:
    n = bind(F.coalesce(_number(c), F.lit(0.0)), lambda x: F.when(x > 1, x / 100).otherwise(x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))


def row_confidence(cells: Column) -> Column:
    """Positive explicit confidence of a row (percent allowed), else null."""
    names = ["confidence", "Confidence", "confianza", "Confianza", "score", "Score"]
    n = _number(F.coalesce(*[cells[k] for k in names]))
    return bind(n, lambda x: F.when(x > 0, F.when(x > 1, x / 100).otherwise(x)))


def micros(c) -> Column:
    """Microseconds since the epoch, for timestamps with or without time zone."""
    return F.unix_micros(col(c).cast("timestamp"))


def day_start(c) -> Column:
    return F.date_trunc("day", col(c))


def month_start(c) -> Column:
    return F.date_trunc("month", col(c))


def expires_end_of_day(c) -> Column:
    """``YYYY-MM-DD`` to the last millisecond of that day; anything else is null."""
    return F.try_to_timestamp(F.concat(col(c), F.lit(" 23:59:59.999")), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def file_stamp(kind, at, prefix: str = "OCR") -> Column:
    stamp = F.date_format(col(at), "yyyyMMdd_HHmm")
    return F.concat(F.lit(prefix + "_"), col(kind), F.lit("_"), stamp, F.lit(".csv"))


def extract_date(c) -> Column:
    return F.regexp_extract(col(c), V.SECTION_DATE, 0)


def extract_contract_date(c) -> Column:
    return F.regexp_extract(col(c), V.CONTRACT_DATE, 0)


def extract_reference(c) -> Column:
    return trim_ws(F.regexp_extract(col(c), V.FILE_REFERENCE, 0))


def client_key(user_key, forwarded_for, *fallbacks) -> Column:
    """User key, else first forwarded address, else the other address headers."""
    forwarded = col(forwarded_for)
    first = trim_ws(F.substring_index(forwarded, ",", 1))
    first = F.when(first == "", F.lit("unknown")).otherwise(first)
    rest = [F.nullif(col(f), F.lit("")) for f in fallbacks]
    from_headers = F.when(forwarded != "", first).otherwise(F.coalesce(*rest, F.lit("unknown")))
    return F.coalesce(F.nullif(col(user_key), F.lit("")), from_headers)


def first_non_empty(*cells) -> Column:
    return F.coalesce(*[F.nullif(trim_ws(c), F.lit("")) for c in cells], F.lit(""))


def format_page_range(first, last) -> Column:
    first, last = col(first).cast("string"), col(last).cast("string")
    return (
        F.when(first.isNull(), F.lit(""))
        .when(first == last, first)
        .otherwise(F.concat(first, F.lit("-"), last))
    )


def supported_mime(declared, file_name) -> Column:
    """Accepted MIME type from the declared type, else from the extension, else ''."""
    mime = F.lower(trim_ws(F.coalesce(col(declared), F.lit(""))))
    name = F.lower(col(file_name))
    return (
        F.when(mime == "image/jpg", F.lit("image/jpeg"))
        .when(mime.isin("application/pdf", "image/jpeg", "image/png"), mime)
        .when(name.endswith(".pdf"), F.lit("application/pdf"))
        .when(name.endswith(".jpg") | name.endswith(".jpeg"), F.lit("image/jpeg"))
        .when(name.endswith(".png"), F.lit("image/png"))
        .otherwise(F.lit(""))
    )


def ignored_texts(text) -> Column:
    """Watermark texts found in a value, in list order."""
    return bind(norm_search(text), lambda t: F.array_compact(
        F.array(*[F.when(t.contains(py_search(i)), F.lit(i)) for i in V.IGNORED_TEXTS])
    ))


def _suspicious(text: Column, extra: str) -> Column:
    pattern = "[" + r"\x00-\x1f\x7f" + chr(0xFFFD) + extra + "]"
    return F.regexp_count(text, F.lit(pattern)) + F.when(text.rlike("(?i)https?://"), 20).otherwise(0)


def corrupt_text(c, strict: bool = False) -> Column:
    """Too many replacement or control characters; ``strict`` also counts mojibake letters."""
    return bind(c, lambda text: (trim_ws(text) != "") & (
        _suspicious(text, "ÂÃ" if strict else "") / F.greatest(F.length(text), F.lit(1)) > 0.03
    ))


def commercial_key(compact: Column) -> Column:
    """Canonical commercial quality keys of one header key, as an array."""
    direct = compact.isin(V.COMMERCIAL_QUALITY_KEYS)
    rules = [
        F.when(compact.contains("documento") & compact.contains("numero"), F.lit("numerodocumento")),
        F.when(compact.contains("cuit") & compact.contains("emisor"), F.lit("cuitemisor")),
        F.when(compact.contains("cuit") & compact.contains("receptor"), F.lit("cuitreceptor")),
        F.when(compact.contains("patente"), F.lit("patente")),
        F.when(compact.contains("peso"), F.lit("peso")),
    ]
    return F.when(direct, F.array(compact)).otherwise(F.array_compact(F.array(*rules)))


def movement_key(compact: Column) -> Column:
    direct = compact.isin(V.MOVEMENT_QUALITY_KEYS)
    rules = [
        F.when(compact.contains("fecha") & compact.contains("salida"), F.lit("fechasalida")),
        F.when(compact.contains("fecha") & compact.contains("arribo"), F.lit("fechaarribo")),
        F.when(compact.contains("camion"), F.lit("cantidadcamion")),
        F.when(compact.contains("escolta"), F.lit("cantidadescoltas")),
        F.when(compact.contains("ruta") & compact.contains("puna"), F.lit("rutacaminospuna")),
    ]
    return F.when(direct, F.array(compact)).otherwise(F.array_compact(F.array(*rules)))


def count_column_keys(columns: Column, key_rule) -> Column:
    """Distinct canonical keys matched by an ordered header array."""
    keys = F.flatten(F.transform(columns, lambda c: bind(norm_key(c), key_rule)))
    return F.size(F.array_distinct(keys))


def commercial_column_count(columns) -> Column:
    return count_column_keys(col(columns), commercial_key)


def movement_column_count(columns) -> Column:
    return count_column_keys(col(columns), movement_key)
