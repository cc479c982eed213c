"""Packing page texts into model-sized chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import TRIM_CHARS, trim_ws
from .tables import chunk_error_cells


def over_page_limit(pages: DataFrame, max_pages: int = V.MAX_PAGES) -> DataFrame:
    """Documents with more pages than allowed; they are rejected, never cut."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return counts.where(F.col("pages") > max_pages)


#: Pages of a block of the chunker.
BLOCK_PAGES = 64
_PIECES = "array<struct<upto: bigint, shift: boolean, value: bigint, closed: bigint>>"


def _lead_lengths(sizes: list[int], ends: list[str], before: str, overlap: int) -> list[str]:
    """What each page would take over from the text before it, if it opened a chunk: its last ``overlap`` characters."""
    leads, tail = [], before
    for end in ends:
        leads.append(tail[-overlap:].lstrip(TRIM_CHARS) if overlap > 0 else "")
        tail = f"{tail}\n\n{end}"[-overlap:] if overlap > 0 else ""
    return leads


def _step(length: int, size: int, lead: str, most: int, overlap: int) -> tuple[int, bool]:
    """Length of the open chunk after a page, and whether the page closed the chunk before it."""
    if length + 2 + size <= most:
        return length + 2 + size, False
    return (len(lead) + 2 + size if lead and length > overlap else size), True


def _effect(sizes: list[int], leads: list[str], most: int, overlap: int) -> list[tuple[int, bool, int, int]]:
    """What a block makes of any open chunk before it, as (greatest length, shift?, value, chunks closed).

    The open text is always the end of the pages before it, so its length is all that counts. A range of lengths
    either fits as a whole (the length grows by ``value``) or closes at the same page and leaves one length.
    """
    pieces = [(1 << 62, True, 0, 0)]
    for size, lead in zip(sizes, leads):
        made, low = [], -1
        for upto, shift, value, closed in pieces:
            if not shift:
                after, full = _step(value, size, lead, most, overlap)
                made.append((upto, False, after, closed + full))
            else:
                fits, short = most - 2 - size - value, overlap - value
                if fits > low:
                    made.append((min(upto, fits), True, value + 2 + size, closed))
                    low = min(upto, fits)
                if low < min(upto, short):
                    made.append((min(upto, short), False, size, closed + 1))
                    low = min(upto, short)
                if low < upto:
                    made.append((upto, False, len(lead) + 2 + size if lead else size, closed + 1))
            low = upto
        pieces = [x for x, y in zip(made, [*made[1:], None]) if y is None or x[1:] != y[1:]]
    return pieces


def _opened(sizes: list[int], leads: list[str], most: int, overlap: int) -> tuple[int, int]:
    """Length of the open chunk and chunks closed when the block starts its document."""
    length, closed = sizes[0], 0
    for size, lead in zip(sizes[1:], leads[1:]):
        length, full = _step(length, size, lead, most, overlap)
        closed += full
    return length, closed


def chunk_pages(
    pages: DataFrame,
    max_chars: int = V.CHUNK_CHARS,
    max_pages: int | None = None,
    overlap: int = V.CHUNK_OVERLAP,
) -> DataFrame:
    """Greedy chunks: ``doc_id, chunk_index, page_range, pages, text, status``.

    A chunk that is full hands the end of its text to the next one; a text no longer than the
    overlap hands over nothing.  Documents are cut into blocks of pages. Each block says what it makes
    of every possible open chunk before it, one row a block is chained, and the blocks are then packed on
    their own, so a document of any length is spread over as many tasks as it has blocks.  Texts are
    shuffled to their block and to their chunk and do not enter Python.  With ``max_pages``, a longer document is not
    chunked and comes back as one row of status ``too_many_pages``.
    """
    kept = pages.select("doc_id", F.col("page_number").cast("int").alias("n"), trim_ws("text").alias("t"))
    rejected = None
    if max_pages is not None:
        long = over_page_limit(pages, max_pages)
        kept = kept.join(long, "doc_id", "left_anti")
        rejected = long.select("doc_id", F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("page_range"),
                               F.lit(None).cast("array<int>").alias("pages"), F.lit(None).cast("string").alias("text"),
                               F.lit("too_many_pages").alias("status"))
    own = F.concat(F.lit("Página "), F.col("n").cast("string"), F.lit("\n"), F.col("t"))
    blocks = kept.where(F.col("t") != "").select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.floor(F.col("n") / BLOCK_PAGES), F.lit(-1)).alias("block"), "n", own.alias("own"))
    blocks = blocks.groupBy("key", "block").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("n", "own"))).alias("own"))
    end = lambda x: F.right(x["own"], F.lit(max(overlap, 0)))
    blocks = blocks.withColumns({"sizes": F.transform("own", lambda x: F.length(x["own"])), "ends": F.transform("own", end)})
    # A page has at least ten characters, so this many blocks before a block hold all it can take over.
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(-(max(overlap, 0) // 10 + 1), -1)
    last = lambda texts: F.right(F.array_join(texts, "\n\n"), F.lit(max(overlap, 0)))
    before = blocks.select("key", "block", last("ends").alias("end")).select("key", "block", last(F.collect_list("end").over(earlier)).alias("before"))
    facts = blocks.select("key", "block", "sizes", "ends").join(before, ["key", "block"])

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, block, sizes, ends, lead in batch.itertuples(index=False):
                sizes = [int(x) for x in sizes]
                leads = _lead_lengths(sizes, list(ends), lead, overlap)
                made = [dict(zip(("upto", "shift", "value", "closed"), x)) for x in _effect(sizes, leads, max_chars, overlap)]
                out.append((key, block, *_opened(sizes, leads, max_chars, overlap), made))
            yield pd.DataFrame(out, columns=["key", "block", "length", "closed", "pieces"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, length, index = None, None, 1
        for batch in batches:
            out = []
            for key, block, fresh, closed, pieces in batch.itertuples(index=False):
                if owner != key:
                    owner, length, index = key, None, 1
                out.append((key, block, length, index))
                if length is None:
                    length, index = fresh, 1 + closed
                else:
                    piece = next(x for x in pieces if length <= x["upto"])
                    length = length + piece["value"] if piece["shift"] else piece["value"]
                    index += piece["closed"]
            yield pd.DataFrame(out, columns=["key", "block", "length", "chunk"]).astype({"length": "Int64"})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, block, sizes, ends, lead, length, chunk in batch.itertuples(index=False):
                leads = _lead_lengths(sizes, list(ends), lead, overlap)
                length = None if pd.isna(length) else int(length)
                seats = []
                for size, text in zip(sizes, leads):
                    held, size = length, int(size)
                    length, full = (size, False) if held is None else _step(held, size, text, max_chars, overlap)
                    chunk += full
                    seats.append({"chunk": chunk, "lead": text if full and text and held > overlap else None})
                out.append((key, block, seats))
            yield pd.DataFrame(out, columns=["key", "block", "seats"])

    made = facts.select("key", "block", "sizes", "ends", "before").mapInPandas(
        effects, f"key string, block bigint, length bigint, closed bigint, pieces {_PIECES}")
    state = made.repartition("key").sortWithinPartitions("key", "block").mapInPandas(chain, "key string, block bigint, length bigint, chunk bigint")
    seats = facts.join(state, ["key", "block"]).select("key", "block", "sizes", "ends", "before", "length", "chunk").mapInPandas(
        pack, "key string, block bigint, seats array<struct<chunk: int, lead: string>>")
    placed = blocks.select("key", "block", "doc_id", "own").join(seats, ["key", "block"]).select("key", "block", "doc_id", F.inline(
        F.transform("own", lambda x, i: F.struct(F.get("seats", i)["chunk"].alias("chunk_index"), x["n"].alias("n"), i.alias("at"),
                                                 F.get("seats", i)["lead"].alias("lead"), x["own"].alias("own")))))
    found = placed.groupBy("key", "chunk_index").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("block", "n", "at", "lead", "own"))).alias("p"))
    first, last = F.get("p", F.lit(0))["n"], F.element_at("p", -1)["n"]
    text = F.concat_ws("\n\n", F.get("p", F.lit(0))["lead"], F.array_join(F.transform("p", lambda x: x["own"]), "\n\n"))
    span = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
    found = found.select("doc_id", "chunk_index", span.alias("page_range"), F.transform("p", lambda x: x["n"]).alias("pages"),
                         text.alias("text"), F.lit("ok").alias("status"))
    return found if rejected is None else found.unionByName(rejected)


def cap_chunks(chunks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Chunks to process and, for those beyond the caller's limit, their error rows."""
    message = F.lit("No se procesó esta parte por el límite del modo balanceado.")
    skipped = chunks.where(F.col("chunk_index") > limit)
    return chunks.where(F.col("chunk_index") <= limit), skipped.select(
        "doc_id", "chunk_index", "page_range", message.alias("message"),
        chunk_error_cells("page_range", message).alias("cells"),
    )


def attach_outputs(doc_pages: DataFrame, outputs: DataFrame) -> DataFrame:
    """Recorded provider outputs of the documents at hand; a provider is a table of outputs."""
    docs = doc_pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    return outputs.join(docs, "doc_id")


def model_usage(attempts: DataFrame, primary: str, fallback: str) -> DataFrame:
    """Model label and processed, failed and skipped chunks per document.

    ``attempts``: ``doc_id, chunk_index, model_used, status`` (processed, failed or skipped).
    The first chunk that used an experimental or fallback model decides the label.
    """
    special = F.col("model_used").rlike(r"\((experimental|fallback)\)") & (F.col("status") == "processed")
    agg = attempts.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.min_by("model_used", F.when(special, F.col("chunk_index"))).alias("_first"),
        F.count_distinct("model_used").alias("models"),
    )
    return agg.select(
        "doc_id", "processed", "failed", "skipped", "models",
        F.when(F.col("_first").contains("(experimental)"), F.col("_first"))
        .when(F.col("_first").isNotNull(), F.lit(f"{fallback} (fallback)"))
        .otherwise(F.lit(primary)).alias("model_label"),
    )
