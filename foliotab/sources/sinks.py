"""Writers: quoted CSV, JSON documents, raw text, usage and correction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

_BOM = chr(0xFEFF)


def csv_cell(c) -> Column:
    """Quoted cell; line breaks become spaces, quotes are doubled, null is empty."""
    flat = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\r?\n", " ")
    return F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(cells) -> Column:
    """One CSV line from an array of cells."""
    return F.array_join(F.transform(col(cells), csv_cell), ",")


def write_csv(df: DataFrame, path: str, mode: str = "error", bom: bool = True) -> None:
    """All columns as quoted text with a header line; the first header carries the BOM."""
    flat = [
        F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\r?\n", " "), F.lit("")).alias(
            _BOM + c if bom and i == 0 else c
        )
        for i, c in enumerate(df.columns)
    ]
    (
        df.select(*flat).write.mode(mode)
        .options(header=True, quoteAll=True, escape='"', quote='"', nullValue="", emptyValue="")
        .csv(path)
    )


def json_document(metadata, columns, rows) -> Column:
    """``{metadata, columns, rows}`` as JSON text."""
    return F.to_json(F.struct(col(metadata).alias("metadata"), col(columns).alias("columns"), col(rows).alias("rows")))


def json_documents(documents: DataFrame, plans: DataFrame) -> DataFrame:
    """JSON export of the documents whose plan allows it (``plan_name`` on both sides)."""
    allowed = plans.where("allow_json_export").select("plan_name")
    permitted = documents.join(allowed, "plan_name", "left_semi")
    return permitted.select("doc_id", json_document("metadata", "columns", "rows").alias("value"))


def write_json(documents: DataFrame, plans: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with the document id, spread over files by size, not one file per document."""
    json_documents(documents, plans).write.mode(mode).json(path)


def write_raw_text(rejected: DataFrame, path: str, mode: str = "error") -> None:
    """``doc_id, file_name, raw_text`` of rejected documents, as Parquet keyed by document."""
    rejected.select("doc_id", "file_name", "raw_text").write.mode(mode).parquet(path)


def append_usage_events(events: DataFrame, path: str) -> None:
    """Append usage rows, laid out by day so that quota scans prune."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


#: JSON columns of a correction example.
CORRECTION_JSON = ("original_json", "corrected_json")


def save_correction_examples(examples: DataFrame, path: str) -> None:
    """Append correction examples with their JSON as variants, so that single paths can be read.

    Text that is no JSON is kept apart: its column becomes null and ``malformed`` maps the column to the text.
    """
    parsed = {c: F.try_parse_json(c) for c in CORRECTION_JSON}
    bad = [F.when(F.col(c).isNotNull() & v.isNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c, v in parsed.items()]
    malformed = F.map_from_entries(F.array_compact(F.array(*bad)))
    examples.withColumns({"malformed": malformed, **parsed}).write.mode("append").parquet(path)


def correction_values(examples: DataFrame, column: str, json_path: str, kind: str = "string") -> Column:
    """Value at a path of a saved JSON column; null where it is missing or of another kind."""
    return F.try_variant_get(examples[column], json_path, kind)
