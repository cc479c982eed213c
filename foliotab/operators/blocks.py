"""Cut documents into blocks of lines with a margin of neighbouring lines.

Extractors look a few lines around an identifier.  A block holds the lines of up to ``PAGES_PER_BLOCK``
pages, or one piece of about ``PIECE_CHARS`` characters of a longer page, cut at a line end, plus ``margin``
lines of the blocks before and after it and the last value carried in from earlier blocks.  The size of a
document or of a page does not limit anything: a document of a million pages, or one page of a gigabyte,
is a few thousand independent blocks.

Pages are cut where they are read and shuffled once. A long page leaves a mark among its neighbours, at which
the pages of one shuffled row are parted, so that its pieces come between them in document order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind

PAGES_PER_BLOCK, PIECE_CHARS = 64, 1 << 18
#: Room for the pieces of a page in a block number.
_PIECES = 1 << 20


def page_block(page) -> Column:
    return F.floor((F.col(page) - 1) / PAGES_PER_BLOCK)


def page_pieces(text: Column, most: int | None = None) -> Column:
    """A text cut after line ends into pieces of at least ``most`` characters; the line end at a cut is left out."""
    most = most or PIECE_CHARS
    found = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}[^\r\n]*(?:\r\n?|\n|\z)"), F.lit(0))
    cut = lambda all_: F.transform(all_, lambda x, i: F.when(i < F.size(all_) - 1, F.regexp_replace(x, r"(?:\r\n?|\n)\z", "")).otherwise(x))
    return F.when(F.length(text) > most, bind(found, cut)).otherwise(F.array(text))


def text_pieces(text: str, most: int) -> list[str]:
    """``page_pieces`` of one text inside a Python worker."""
    if len(text) <= most:
        return [text]
    found = re.findall(rf"(?s).{{1,{most}}}[^\r\n]*(?:\r\n?|\n|\Z)", text)
    return [re.sub(r"(?:\r\n?|\n)\Z", "", x) for x in found[:-1]] + found[-1:]


def _own_blocks(pages: DataFrame, lines_of: Callable[[Column], Column] | None) -> DataFrame:
    """``_doc, _seat, _subs``: the blocks (number, page of a piece, lines) of each shuffled row; the one text shuffle.

    ``_seat`` is even for the shorter pages of a stretch and odd for each piece of a long page. ``_doc`` wraps the
    document's id: a struct is never null, so joining blocks with facts of their own adds no null filter to one side,
    which would keep the two sides from sharing the shuffle and have every page read and cleaned twice.
    """
    texts = page_pieces(F.col("text")) if lines_of else F.col("pieces")
    lines_of = lines_of or (lambda piece: piece)
    cut = pages.select("doc_id", "page_number", texts.alias("_texts"))
    number = F.coalesce(F.col("page_number").cast("bigint"), F.lit(0))
    many = F.size("_texts") > 1

    def part(text: Column, i: Column) -> Column:
        seat = F.when(many, (number * _PIECES + i) * 2 + 1).otherwise(F.coalesce(page_block("page_number"), F.lit(-1)) * 2)
        return F.struct(seat.alias("_seat"), (number * _PIECES + i).alias("block"), lines_of(text).alias("lines"))

    # A mark of the long page in the row of its neighbours: no lines, which parts them.
    parts = F.transform("_texts", part)
    mark = F.transform(F.slice(parts, 1, 1), lambda x: F.struct(
        (F.coalesce(page_block("page_number"), F.lit(-1)) * 2).alias("_seat"), x["block"].alias("block"), F.nullif(x["lines"], x["lines"]).alias("lines")))
    parts = F.filter(parts, lambda x: F.size(x["lines"]) > 0)
    per_page = cut.select(F.struct("doc_id").alias("_doc"), F.when(many, F.col("page_number")).alias("page"), F.inline(F.when(many, F.concat(mark, parts)).otherwise(parts)))
    # Placed by finished columns, which later joins by seat can use as they are.
    rows = per_page.repartition("_doc", "_seat").groupBy("_doc", "_seat").agg(
        F.sort_array(F.collect_list(F.struct("block", "page", "lines"))).alias("_p"))

    def stretches(p: Column) -> Column:
        marks = F.filter(F.transform(p, lambda x, i: F.when(x["lines"].isNull(), i + 1)), lambda i: i.isNotNull())
        bounds = lambda m: F.concat(F.array(F.lit(0)), m, F.array(F.size(p) + 1))
        between = lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda k: F.slice(
            p, F.get(b, k - 1) + 1, F.get(b, k) - F.get(b, k - 1) - 1))
        return bind(bounds(marks), between)

    # Most rows hold no mark and are one stretch.
    all_stretches = F.when(F.exists("_p", lambda x: x["lines"].isNull()), bind(F.col("_p"), stretches)).otherwise(F.array("_p"))
    subs = F.transform(F.filter(all_stretches, lambda x: F.size(x) > 0), lambda x: F.struct(
        F.get(x, F.lit(0))["block"].alias("block"), F.when(F.col("_seat") % 2 == 1, F.get(x, F.lit(0))["page"]).alias("page"),
        F.flatten(F.transform(x, lambda y: y["lines"])).alias("lines")))
    return rows.select("_doc", "_seat", subs.alias("_subs"))


def _with_context(own: DataFrame, context: DataFrame, *values: str) -> DataFrame:
    """Blocks with the values that ``context`` (_doc, _seat, block, values) has for them; shuffles the context only.

    Pages without a document have no context.
    """
    per_row = context.groupBy("_doc", "_seat").agg(F.collect_list(F.struct("block", *values)).alias("_ctx"))
    doc_id = F.col("_doc.doc_id")
    rows = own.join(per_row, ["_doc", "_seat"], "left").select(
        doc_id.alias("doc_id"), F.when(doc_id.isNotNull(), F.col("_ctx")).alias("_ctx"), F.inline("_subs"))
    mine = F.get(F.filter("_ctx", lambda x: x["block"] == F.col("block")), F.lit(0))
    return rows.withColumn("_mine", mine).select("doc_id", "block", "page", F.col("lines").alias("_own"), *[F.col("_mine")[v].alias(v) for v in values])


def numbered_lines(pages: DataFrame, lines_of: Callable[[Column], Column] | None) -> DataFrame:
    """``doc_id, block, pos, before_piece, line``: every line with its 0-based place in the document.

    ``lines_of`` and ``pages`` are those of ``line_blocks``; ``before_piece`` counts the lines of a long page before the piece that holds the line; 0 elsewhere.
    """
    own = _own_blocks(pages, lines_of)
    first = Window.unboundedPreceding
    sizes = own.select("_doc", "_seat", F.inline("_subs")).select("_doc", "_seat", "block", "page", F.size("lines").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.orderBy("block").rowsBetween(first, -1)), F.lit(0))
    offsets = sizes.select("_doc", "_seat", "block", before(Window.partitionBy("_doc")).alias("_offset"),
                           F.when(F.col("page").isNotNull(), before(Window.partitionBy("_doc", "page"))).otherwise(0).alias("before_piece"))
    placed = _with_context(own, offsets, "_offset", "before_piece").select("doc_id", "block", "_offset", "before_piece", F.posexplode("_own").alias("_p", "line"))
    return placed.select("doc_id", "block", (F.col("_offset") + F.col("_p")).alias("pos"), "before_piece", "line")


def line_blocks(
    pages: DataFrame,
    lines_of: Callable[[Column], Column] | None,
    margin: int = 8,
    carry: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """``doc_id, block, lines, first, last`` (+ one column per carried value).

    ``lines`` are the block's lines with the margins; positions ``first..last`` (1-based)
    are the block's own.  ``lines_of`` maps a text to an array of line structs or strings, line by line,
    and runs where the page is read, before any shuffle; without it, ``pages`` hold the lines of each of their
    ``page_pieces`` as ``pieces`` instead of ``text``.
    """
    carry = carry or {}
    own = _own_blocks(pages, lines_of)

    # Both uses of ``own`` share one exchange: pages are read and cleaned once.
    lines = F.col("lines")
    edges = own.select("_doc", "_seat", F.inline("_subs")).select(
        "_doc", "_seat", "block", F.slice(lines, 1, margin).alias("head"), _last(lines, margin).alias("tail"),
        *[f(lines).alias(n) for n, f in carry.items()],
    )
    doc = Window.partitionBy("_doc").orderBy("block")
    before = F.flatten(F.collect_list("tail").over(doc.rowsBetween(-margin, -1)))
    after = F.flatten(F.collect_list("head").over(doc.rowsBetween(1, margin)))
    earlier = doc.rowsBetween(Window.unboundedPreceding, -1)
    context = edges.select(
        "_doc", "_seat", "block", _last(before, margin).alias("_prev"), F.slice(after, 1, margin).alias("_next"),
        *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in carry],
    ).where((F.size("_prev") > 0) | (F.size("_next") > 0))

    joined = _with_context(own, context, "_prev", "_next", *carry)
    empty = F.slice("_own", F.lit(1), F.lit(0))
    prev, nxt = F.coalesce("_prev", empty), F.coalesce("_next", empty)
    return joined.select(
        "doc_id", "block",
        F.concat(prev, F.col("_own"), nxt).alias("lines"),
        (F.size(prev) + 1).alias("first"),
        (F.size(prev) + F.size("_own")).alias("last"),
        *carry,
    )


def _last(array: Column, n: int) -> Column:
    k = F.least(F.size(array), F.lit(n))
    return F.slice(array, F.size(array) - k + 1, k)


def part_before(line: Column, pattern: str, nth: Column) -> Column:
    """Text of a line before its n-th (0-based) match of the pattern."""
    gaps = F.split(line, pattern, -1)
    hits = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    return F.aggregate(
        F.filter(F.sequence(F.lit(0), F.size(hits)), lambda j: j <= nth),
        F.lit(""),
        lambda acc, j: F.concat(
            acc,
            F.when(j > 0, F.get(hits, j - 1)).otherwise(F.lit("")),
            F.get(gaps, j),
        ),
    )
