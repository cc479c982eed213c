"""JSON export in ordered fragments, with the metadata of a result.

A document of any length leaves as one head, runs of rows and one foot; no row of the
export holds a whole document.  Put together in the order ``part, run`` the fragments of a
document are ``{metadata, columns, rows}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import file_stamp

# The fields of the metadata in their order, and their types.
METADATA_FIELDS = {
    "access_mode": "string", "automatic_review_applied": "boolean", "client_profile_id": "string",
    "confidence": "double", "corrections_applied": "array<string>", "detected_headers": "array<string>",
    "document_ai_used": "boolean", "document_type": "string", "duration_ms": "bigint", "extraction_kind": "string",
    "extraction_mode": "string", "fallback_provider": "string", "fields": "bigint", "is_internal_test": "boolean",
    "original_file_name": "string", "output_file_name": "string", "output_json_file_name": "string",
    "orientation_selected": "bigint", "pages_processed": "bigint", "processed_at": "string",
    "primary_provider": "string", "profile_code": "string", "profile_name": "string", "provider_used": "string",
    "gpt_extractor_used": "boolean", "gpt_extractor_mode": "string", "gpt_reviewer_used": "boolean",
    "gpt_reviewer_mode": "string", "legacy_profiles_bypassed": "boolean", "pdf_visual_rendering_attempted": "boolean",
    "pdf_visual_rendering_succeeded": "boolean", "quality_status": "string", "rejected_legacy_columns": "array<string>",
    "used_document_ai_text_only_fallback": "boolean", "visual_pages_rendered": "boolean", "visual_render_error": "string",
    "records": "bigint", "rows_extracted": "bigint", "visual_structuring_provider": "string", "warnings": "array<string>",
}
UNIVERSAL_MODE = "document_ai_gpt_optimized"
HEAD, ROWS, FOOT = 0, 1, 2


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def export_metadata(results: DataFrame, prefix: str = "OCR") -> DataFrame:
    """Add ``metadata``, one struct whose null fields the JSON leaves out.

    ``results``: ``doc_id, file_kind, columns, records, processed_at`` and any field of
    ``METADATA_FIELDS`` in snake case; further ``source_file_name, extracted_rows,
    profile_validation_warnings`` and the profile's ``profile_id, profile_label,
    profile_document_type, profile_extraction_mode``.  Columns that are absent count as null.
    A universal extraction names no profile but the one its result states.
    """
    have = set(results.columns)

    def given(name: str, kind: str | None = None):
        return (F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind or METADATA_FIELDS.get(name, "string"))

    universal = F.coalesce(given("extraction_mode") == UNIVERSAL_MODE, F.lit(False))
    at = F.col("processed_at")
    code = F.coalesce(given("profile_code"), given("profile_id"))
    name = file_stamp("file_kind", at, prefix)
    none = F.array().cast("array<string>")
    found = {
        "access_mode": F.when(given("access_mode") == "master", "master").otherwise("client"),
        "is_internal_test": F.coalesce(given("is_internal_test"), F.lit(False)),
        "client_profile_id": F.when(~universal, code),
        "profile_code": F.when(~universal, code),
        "profile_name": F.coalesce(given("profile_name"), F.when(~universal, given("profile_label"))),
        "document_type": F.coalesce(given("document_type"), given("profile_document_type")),
        "extraction_mode": F.coalesce(given("extraction_mode"), given("profile_extraction_mode")),
        "extraction_kind": F.col("file_kind"),
        "fields": F.coalesce(F.when(F.col("columns").isNotNull(), F.size("columns")), F.lit(0)).cast("bigint"),
        "original_file_name": F.coalesce(given("source_file_name"), F.lit("")),
        "output_file_name": name,
        "output_json_file_name": F.regexp_replace(name, r"(?i)\.csv$", ".json"),
        "processed_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "records": F.coalesce(given("records"), F.lit(0)),
        "rows_extracted": F.coalesce(given("rows_extracted"), given("extracted_rows", "bigint")),
        "warnings": F.concat(F.coalesce(given("profile_validation_warnings", "array<string>"), none),
                             F.coalesce(given("warnings"), none)),
    }
    fields = [found.get(n, given(n)).alias(_camel(n)) for n in METADATA_FIELDS]
    return results.withColumn("metadata", F.struct(*fields))


def json_fragments(results: DataFrame, rows: DataFrame, plans: DataFrame, run_length: int = 1024, salts: int = 16) -> DataFrame:
    """``doc_id, part, run, value``: the JSON of every document whose plan allows it.

    ``results`` as for :func:`export_metadata`, with ``plan_name``; ``records`` are counted here; ``rows``: ``doc_id, row_idx, cells`` with a whole number per row.  A run holds
    the rows of ``run_length`` consecutive numbers; gaps leave no trace.  A document without rows
    has a head and a foot; null cells are an empty object; rows without a result are not exported.
    Only the first run of a document, not its text, is looked up, under salts.
    """
    numbered = rows.select("doc_id", F.floor(F.col("row_idx") / run_length).alias("run"), "row_idx", "cells")
    counts = numbered.groupBy("doc_id").agg(F.count("*").alias("records"), F.min("run").alias("first_run"))
    allowed = plans.where("allow_json_export").select("plan_name")
    titled = export_metadata(results.drop("records", "first_run").join(allowed, "plan_name", "left_semi").join(counts, "doc_id", "left"))
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    head = F.concat(F.lit('{"metadata":'), F.to_json("metadata"), F.lit(',"columns":'), F.to_json(columns), F.lit(',"rows":['))
    zero = F.lit(0).cast("bigint")
    ends = titled.select("doc_id", F.inline(F.array(
        F.struct(F.lit(HEAD).alias("part"), zero.alias("run"), head.alias("value")),
        F.struct(F.lit(FOOT).alias("part"), zero.alias("run"), F.lit("]}").alias("value")))))
    text = F.coalesce(F.to_json("cells"), F.lit("{}"))
    runs = numbered.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("row_idx", text.alias("t")))).alias("found"))
    salt = F.pmod(F.col("run"), F.lit(salts)).cast("int")
    firsts = titled.where("first_run is not null").select(
        "doc_id", "first_run", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    body = runs.withColumn("salt", salt).join(firsts, ["doc_id", "salt"])
    value = F.concat(F.when(F.col("run") > F.col("first_run"), ",").otherwise(""),
                     F.array_join(F.transform("found", lambda x: x["t"]), ","))
    return ends.unionByName(body.select("doc_id", F.lit(ROWS).alias("part"), "run", value.alias("value")))


def write_json_fragments(fragments: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines in document order: the files, read one after another, give whole documents."""
    order = ["doc_id", "part", "run"]
    fragments.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).json(path)
