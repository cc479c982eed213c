"""Page text: normalisation, lines and positioned text items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_line, page_lines
from ..operators.ordered import running_sums

ITEMS_PER_BLOCK = 4096


def normalize_pages(doc_pages: DataFrame) -> DataFrame:
    """Collapse blanks and drop blank lines inside every page; row-local."""
    return doc_pages.withColumn("text", F.array_join(page_lines("text"), "\n"))


def document_text_lengths(doc_pages: DataFrame) -> DataFrame:
    """Pages and total normalised text length per document; ``has_text`` false means failure."""
    return (
        normalize_pages(doc_pages)
        .groupBy("doc_id")
        .agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("total_text_length"))
        .withColumn("has_text", F.col("total_text_length") > 0)
    )


def explode_lines(doc_pages: DataFrame) -> DataFrame:
    """One row per non-blank line; numbering restarts per page.  No shuffle."""
    numbered = doc_pages.select("doc_id", "page_number", F.posexplode(page_lines("text")).alias("p", "line"))
    return numbered.select("doc_id", "page_number", (F.col("p") + 1).alias("line_no"), "line")


def items_to_lines(items: DataFrame) -> DataFrame:
    """Positioned text items (``doc_id, page_number, item_no, text, eol``) to lines.

    A line ends after an item flagged ``eol``; blank items carry no text and no flag.
    """
    kept = items.where(F.coalesce(F.col("text"), F.lit("")) != "")
    cut = kept.withColumn("_block", F.floor(F.col("item_no") / ITEMS_PER_BLOCK))
    cut = running_sums(
        cut, ["doc_id", "page_number"], "_block", ["item_no"],
        {"_line": F.when(F.col("eol"), 1).otherwise(0)},
    )
    lines = cut.groupBy("doc_id", "page_number", "_line").agg(
        F.sort_array(F.collect_list(F.struct("item_no", "text"))).alias("_i")
    )
    text = normalize_line(F.array_join(F.transform("_i", lambda x: x["text"]), " "))
    return (
        lines.select("doc_id", "page_number", F.col("_line").alias("line_order"), text.alias("line"))
        .where(F.col("line") != "")
    )
