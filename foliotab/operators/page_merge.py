"""Movement tables from recorded page readings: rotations, repeats, checks and warnings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import bind, norm_key, py_key
from ..functions.values import ignored_texts
from .ordered import number_rows
from .storage import stored
from .tables import generic_line_keys, header_sources, movement_values, source_values

ROTATIONS = (0, 90, 270, 180)  # fixed values: the order in which a page is tried
_EXPECTED = lambda: F.array(*[F.lit(c) for c in V.MOVEMENT_COLUMNS])


class MergedPages(NamedTuple):
    rows: DataFrame
    documents: DataFrame
    warnings: DataFrame


def page_readings(attempts: DataFrame) -> DataFrame:
    """The reading that counts for each page: the first rotation with a valid row.

    ``attempts``: ``doc_id, page_number, columns, rows`` and, where pages were turned,
    ``rotation`` (null is 0) and ``error``.  Adds the rows on the movement columns as
    ``projected`` (``values`` in the order of those columns, ``valid``), whether one is valid, the
    facts of the header (``generic, bits``), and the page's warning (null if there is none).
    A page whose last rotation was read without a row keeps that rotation; one that was
    given up before is without valid rows, with its last error.  Headers are matched once a page, not once a row.
    """
    rotation = F.coalesce("rotation", F.lit(0)) if "rotation" in attempts.columns else F.lit(0)
    error = F.col("error") if "error" in attempts.columns else F.lit(None).cast("string")
    none = F.array().cast("array<map<string,string>>")
    given = F.when(error.isNull(), F.coalesce("rows", none)).otherwise(none)
    wanted = F.array(*[F.lit(py_key(c)) for c in V.MOVEMENT_COLUMNS])
    blank = F.array_repeat(F.lit(""), len(V.MOVEMENT_COLUMNS))
    values = bind(header_sources(_EXPECTED(), F.col("columns"), F.col("keys"), wanted), lambda sources: F.transform(
        given, lambda r: F.coalesce(source_values(sources, r), blank)))
    projected = F.transform(values, lambda v: F.struct(v.alias("values"), movement_values(v).alias("valid")))
    rank = F.array_position(F.array(*[F.lit(r) for r in ROTATIONS]), rotation.cast("int"))
    keyed = attempts.withColumn("keys", F.transform("columns", norm_key))
    read = keyed.select("doc_id", "page_number", rotation.alias("rotation"), error.alias("error"), generic_line_keys(F.col("keys")).alias("generic"),
                        _given("keys").alias("bits"), projected.alias("projected"), rank.alias("rank"))
    read = read.withColumn("valid", F.exists("projected", lambda r: r["valid"]))
    best = F.struct(~F.col("valid"), F.col("error").isNotNull(), F.col("rank"))
    found = read.groupBy("doc_id", "page_number").agg(
        F.min_by(F.struct("rotation", "generic", "bits", "projected", "valid"), best).alias("r"),
        F.max((F.col("rank") == len(ROTATIONS)) & F.col("error").isNull()).alias("tried_all"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("rank"))).alias("last_error"))
    turned = F.when(F.col("r.valid"), F.col("r.rotation")).when(F.col("tried_all"), F.lit(ROTATIONS[-1]))
    page = F.col("page_number").cast("string")
    warning = F.when(turned.isNull(), F.rtrim(F.concat(
        F.lit("Pagina "), page, F.lit(" sin filas validas. "), F.coalesce("last_error", F.lit(""))))).when(
        turned != 0, F.concat(F.lit("Pagina "), page, F.lit(" procesada con rotacion alternativa "), turned.cast("string"), F.lit(".")))
    return found.select("doc_id", "page_number", "r.generic", "r.bits", "r.projected", "r.valid", warning.alias("warning"))


def _given(keys) -> Column:
    """Bits of the movement columns that a header (its normalised names) gives, by name or as part of a name."""
    bits = F.lit(0)
    for i, c in enumerate(V.MOVEMENT_COLUMNS):
        wanted = py_key(c)
        bits = bits + F.when(F.exists(keys, lambda k: k.contains(wanted)), 1 << i).otherwise(0)  # noqa: B023
    return bits


def merge_pages(attempts: DataFrame, page_counts: DataFrame, max_pages: int | None = None, strict: bool = False) -> MergedPages:
    """Rows of the accepted documents, one verdict per document, and the warnings in long form.

    ``page_counts``: ``doc_id, page_count``; each of its documents gets a verdict.  Repeated rows
    are dropped in order of page and place.  The checks are sums over the rows that are left of
    them, taken where repeats are removed: ``PROFILE_REJECTED_GENERIC_LINE_CSV``,
    ``PROFILE_MISSING_COLUMNS: …``, ``PROFILE_NO_VALID_ROWS``, ``PROFILE_INCLUDED_IGNORED_TEXT``,
    ``PROFILE_CORRUPTED_TEXT_DOMINANT`` or ``ok``, the first that applies.  Noise rows never enter
    a table, which has the movement columns by construction; ``strict`` judges the pages as they were
    given, headers and noise rows included.  Marks are looked for row by row.  Warnings are one row
    each (``page_number`` 0: the page limit), so no document's warnings meet in one row.
    """
    expected = _EXPECTED()
    used = attempts if max_pages is None else attempts.where(F.col("page_number") <= max_pages)
    pages = page_readings(used)
    rows = pages.select("doc_id", "page_number", "generic", "bits", F.col("warning").isNotNull().alias("warned"), F.posexplode_outer("projected").alias("p", "row"))
    # What a page adds to its document stands on its first row, or on the one row of a page without any.
    once = F.coalesce("p", F.lit(0)) == 0
    given = F.col("row").isNotNull()
    rows = rows.select("doc_id", F.when(given, F.array_join("row.values", "|")).alias("sig"),
                       F.struct(F.when(given, F.struct("page_number", "p")).alias("row_idx"), F.col("row.values").alias("values"), F.col("row.valid").alias("valid")).alias("row"),
                       once.cast("bigint").alias("page"), (once & F.col("warned")).cast("bigint").alias("warned"), "generic", "bits")
    # Verdicts, row numbers and rows read these again.
    firsts = stored(rows.groupBy("doc_id", "sig").agg(
        F.min("row").alias("row"), *[F.sum(c).alias(c) for c in ("page", "warned")], F.max("generic").alias("generic"), F.bit_or("bits").alias("bits")
    ).select("doc_id", "row.*", F.array_join("row.values", " ").alias("t"), "page", "warned", "generic", "bits"))
    judged = F.col("row_idx").isNotNull() if strict else F.coalesce("valid", F.lit(False))
    only = lambda c: F.when(judged, c)
    odd = F.lit("[" + r"\x00-\x1f\x7f" + chr(0xFFFD) + "ÂÃ]")
    facts = firsts.groupBy("doc_id").agg(
        F.sum("page").alias("pages_processed"), F.sum("warned").alias("warned"), F.max("generic").alias("generic"), F.bit_or("bits").alias("bits"),
        F.count_if("valid").alias("records"), F.count_if(only(F.exists("values", lambda v: v != ""))).alias("filled"),
        F.max(only(F.size(ignored_texts("t")) > 0)).alias("marks"), F.sum(only(F.length("t") + 1)).alias("length"),
        F.sum(only(F.regexp_count("t", odd))).alias("odd"), F.max(only(F.col("t").rlike("(?i)https?://"))).alias("url"))
    share = (F.col("odd") + F.when(F.col("url"), 20).otherwise(0)) / F.greatest(F.col("length") - 1, F.lit(1))
    missing = F.array_join(F.array_compact(F.array(*[
        F.when(F.col("bits").bitwiseAND(1 << i) == 0, F.lit(c)) for i, c in enumerate(V.MOVEMENT_COLUMNS)])), ", ")
    status = F.when(F.lit(strict) & F.col("generic"), "PROFILE_REJECTED_GENERIC_LINE_CSV").when(
        F.lit(strict) & (missing != ""), F.concat(F.lit("PROFILE_MISSING_COLUMNS: "), missing))
    status = (status.when(F.coalesce("filled", F.lit(0)) == 0, "PROFILE_NO_VALID_ROWS").when(F.col("marks"), "PROFILE_INCLUDED_IGNORED_TEXT")
              .when(share > 0.03, "PROFILE_CORRUPTED_TEXT_DOMINANT").when(F.col("records") == 0, "PROFILE_NO_VALID_ROWS").otherwise("ok"))
    documents = page_counts.select("doc_id", "page_count").join(facts, "doc_id", "left").select(
        "doc_id", "page_count", status.alias("status"),
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("pages_processed", "records", "warned")])
    accepted = documents.where("status = 'ok'").select("doc_id")
    kept = firsts.where("valid").join(accepted, "doc_id", "left_semi").select(
        "doc_id", F.col("row_idx.page_number").alias("page_number"), "row_idx", F.map_from_arrays(expected, "values").alias("cells"))
    kept = number_rows(kept, ["doc_id"], "page_number", ["row_idx"], "row_number").drop("row_idx")
    notes = pages.where("warning is not null").select("doc_id", "page_number", "warning")
    if max_pages is not None:
        cut = F.concat(F.lit(f"Se procesaron {max_pages} de "), F.col("page_count").cast("string"), F.lit(" paginas por limite configurado."))
        over = page_counts.where(F.col("page_count") > max_pages)
        notes = over.select("doc_id", F.lit(0).cast(pages.schema["page_number"].dataType).alias("page_number"), cut.alias("warning")).unionByName(notes)
    return MergedPages(kept, documents, notes)
