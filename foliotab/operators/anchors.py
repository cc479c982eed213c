"""Identifier anchors in page lines: the points that rows are rebuilt around."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import ids
from .ordered import carry_last

KINDS = ("cuil", "dni", "cuit")


def find_anchors(lines: DataFrame, kind: str) -> DataFrame:
    """One row per anchor: ``doc_id, page_number, line_no, position, anchor``.

    ``lines``: ``doc_id, page_number, line_no, line``.  CUILs: every match, as digits.  DNIs: every
    match in a line without a CUIT.  CUITs: the first of a line.
    """
    if kind == "cuil":
        found = F.transform(F.regexp_extract_all("line", F.lit(V.CUIL), F.lit(0)), ids.digits)
    elif kind == "dni":
        matches = F.regexp_extract_all("line", F.lit(V.DNI), F.lit(0))
        found = F.when(~F.col("line").rlike(V.CUIT), matches)
    elif kind == "cuit":
        found = F.slice(F.regexp_extract_all("line", F.lit(V.CUIT), F.lit(0)), 1, 1)
    else:
        raise ValueError(f"kind must be one of {KINDS}")
    return lines.select("doc_id", "page_number", "line_no", F.posexplode(found).alias("position", "anchor"))


def docs_with_anchor(pages: DataFrame) -> DataFrame:
    """Documents of which some page holds a CUIL."""
    anchored = pages.where(F.col("text").rlike(V.CUIL)).select("doc_id")
    return pages.select("doc_id").distinct().join(anchored, "doc_id", "left_semi")


def neighbours(rows: DataFrame, keys: list[str], block: str, at: str, anchor) -> DataFrame:
    """Add ``previous_anchor`` and ``next_anchor``: the nearest non-null anchor on either side, blockwise."""
    rows = carry_last(rows, keys, block, [at], {"previous_anchor": anchor}, include_current=False)
    back = rows.withColumns({"_back_block": -F.col(block), "_back_at": -F.col(at)})
    back = carry_last(back, keys, "_back_block", ["_back_at"], {"next_anchor": anchor}, include_current=False)
    return back.drop("_back_block", "_back_at")
