"""Binary files and the dependency-free PDF text scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alnum_count, bind, clean_cell
from ..functions.values import supported_mime


def scan_files(spark: SparkSession, path: str, keep_unsupported: bool = False) -> DataFrame:
    """PDF, JPEG and PNG files below a path; content is read only if it is used."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .withColumn("file_name", F.element_at(F.split("path", "/"), -1))
        .withColumn("mime_type", supported_mime(F.lit(""), "file_name"))
    )
    return files if keep_unsupported else files.where(F.col("mime_type") != "")


def _decode_literal(c: Column) -> Column:
    for escape, plain in (("\\n", "\n"), ("\\r", "\n"), ("\\t", " "), ("\\b", " "), ("\\f", " "),
                          ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(escape), F.lit(plain))
    # Octal escapes: decode each distinct code found, as text between the escapes.
    gaps = F.split(c, r"\\[0-7]{1,3}", -1)
    codes = F.regexp_extract_all(c, F.lit(r"\\([0-7]{1,3})"), F.lit(1))
    decoded = F.transform(codes, lambda o: F.chr(F.conv(o, 8, 10).cast("int")))
    joined = F.array_join(
        F.transform(gaps, lambda g, i: F.concat(F.when(i > 0, F.get(decoded, i - 1)).otherwise(F.lit("")), g)), ""
    )
    return F.when(F.size(codes) > 0, joined).otherwise(c)


def _decode_hex(c: Column) -> Column:
    even = F.when(F.length(c) % 2 == 0, c).otherwise(F.concat(c, F.lit("0")))
    utf16 = F.upper(F.substring(even, 1, 4)) == "FEFF"
    body = F.substring(even, 5, 1_000_000_000)
    whole = F.substring(body, F.lit(1), (F.floor(F.length(body) / 4) * 4).cast("int"))
    return F.when(utf16, F.decode(F.unhex(whole), "UTF-16BE")).otherwise(
        F.decode(F.unhex(even), "ISO-8859-1")
    )


def scan_pdf_text(raw_files: DataFrame, longest: int | None = None) -> DataFrame:
    """Text found in uncompressed PDF streams, as page 1 of each document.

    Literal strings first, then hexadecimal ones; useful segments have 3 characters or
    more (up to ``longest`` if given), at least 45 % letters or digits; repeats are kept once, in order.
    """

    def segments(raw: Column) -> Column:
        literals = F.regexp_extract_all(raw, F.lit(r"\(((?:\\.|[^\\()]){2,}+)\)"), F.lit(1))
        hexes = F.regexp_extract_all(raw, F.lit(r"<([0-9A-Fa-f]{8,}+)>"), F.lit(1))
        return F.concat(
            F.transform(literals, lambda x: clean_cell(F.when(x.contains("\\"), bind(x, _decode_literal)).otherwise(x))),
            F.transform(hexes, lambda x: clean_cell(bind(x, _decode_hex))),
        )

    def useful(s: Column) -> Column:
        fits = F.length(s) >= 3 if longest is None else F.length(s).between(3, longest)
        return fits & (alnum_count(s) / F.length(s) >= 0.45)

    found = F.filter(bind(F.decode("content", "ISO-8859-1"), segments), useful)
    page = bind(F.array_distinct(found), lambda kept: F.when(F.size(kept) > 0, F.struct(
        F.array_join(kept, "\n").alias("text"), F.size(kept).alias("segments"))))
    # ``inline`` drops documents without text and computes the page once.
    return raw_files.select("doc_id", F.lit(1).alias("page_number"), F.inline(F.array_compact(F.array(page))))
