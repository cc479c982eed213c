"""Annex tables, structured sections and the local text fallback."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import bind, norm_punct, py_punct, text_lines, text_punct, trim_ws
from ..functions.values import extract_date, extract_reference
from . import blocks
from .blocks import line_blocks, numbered_lines, text_pieces
from .ordered import carry_last, first_rows
from .storage import stored


def _positions(pages: DataFrame) -> DataFrame:
    """``doc_id, block, page_number, pos, line_no, line`` with a dense position per document."""
    most = blocks.PIECE_CHARS

    def cut(texts: pa.Array) -> pa.Array:
        pieces = [[text_lines(x) for x in text_pieces(page.as_py() or "", most)] for page in texts]
        return pa.array(pieces, pa.list_(pa.list_(pa.string())))

    pieces = F.transform(F.arrow_udf(cut, "array<array<string>>")("text"), lambda piece: F.transform(piece, lambda x, i: F.struct(
        F.col("page_number").alias("page_number"), (i + 1).alias("line_no"), x.alias("line"))))
    found = numbered_lines(pages.select("doc_id", "page_number", pieces.alias("pieces")), None).select("doc_id", "block", "pos", "before_piece", "line.*")
    return found.withColumn("line_no", (F.col("line_no") + F.col("before_piece")).cast("int")).drop("before_piece")


def _page_facts(sets: list[list[str]], width: int):
    """Column function: each piece of a page's text to its hits and both ends of its normalised text, a blank one to nothing.

    Whole texts are searched here, for all sets at once, so that each page is normalised once. Hits are places
    among the markers of all sets, one after the other.
    """
    needles = [m for markers in sets for m in markers]
    most = blocks.PIECE_CHARS

    def facts(texts: pa.Array) -> pa.Array:
        hits, starts, heads, ends, kept, pages = [], [0], [], [], [0], [0]
        for page in texts:
            for piece in text_pieces(page.as_py() or "", most):
                text = text_punct(piece)
                if text:
                    hits += [i for i, m in enumerate(needles) if m in text]
                    starts.append(len(hits))
                    heads.append(text[:width])
                    ends.append(text[-width:])
                kept.append(len(heads))
            pages.append(len(kept) - 1)
        columns = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(hits, pa.int32())), pa.array(heads, pa.string()), pa.array(ends, pa.string())]
        lines = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.StructArray.from_arrays(columns, ["hits", "h", "e"]))
        return pa.ListArray.from_arrays(pa.array(pages, pa.int32()), lines)

    return F.arrow_udf(facts, "array<array<struct<hits:array<int>,h:string,e:string>>>")


def marker_counts(pages: DataFrame, **sets: list[str]) -> DataFrame:
    """``doc_id`` and a column per set: distinct markers of the set in the normalised text, also across page ends.

    A page is reduced to its hits and its two ends where it is read; a marker cut by page
    ends is found in the ends of as many consecutive non-blank pages as it has words.
    Documents without any marker are left out.
    """
    lists = [list(dict.fromkeys(markers)) for markers in sets.values()]
    widths = [max(map(len, markers)) for markers in lists]
    margins = [max(1, *(m.count(" ") for m in markers)) for markers in lists]  # pages before the last word of the longest marker
    firsts = [sum(map(len, lists[:i])) for i in range(len(lists))]
    facts = _page_facts(lists, max(widths))("text")
    marked = line_blocks(pages.select("doc_id", "page_number", facts.alias("pieces")), None, margin=max(margins))
    lines, first, last = F.col("lines"), F.col("first"), F.col("last")

    def seams(markers: list[str], width: int, margin: int, at: int) -> Column:
        def found(t: Column) -> Column:
            return F.array_compact(F.array(*[F.when(t.contains(m), F.lit(at + k)) for k, m in enumerate(markers)]))

        def seam(i: Column) -> Column:
            lo = F.greatest(i - margin, F.lit(1))
            before = F.transform(F.slice(lines, lo, i - lo), lambda x: F.right(x["e"], F.lit(width)))
            return bind(F.concat_ws(" ", before, F.left(F.get(lines, i - 1)["h"], F.lit(width))), found)

        # A line with none before it has no seam.
        return F.flatten(F.transform(F.filter(F.sequence(first, last), lambda i: i > 1), seam))

    hits = F.flatten(F.transform(F.slice(lines, first, last - first + 1), lambda x: x["hits"]))
    found = F.array_distinct(F.concat(hits, *map(seams, lists, widths, margins, firsts)))
    each = marked.select("doc_id", F.explode(found).alias("marker")).groupBy("doc_id").agg(F.collect_set("marker").alias("_found"))
    of = lambda at, n: F.size(F.filter("_found", lambda i: (i >= at) & (i < at + n)))
    return each.select("doc_id", *[of(at, len(markers)).alias(name) for name, markers, at in zip(sets, lists, firsts)])


def document_markers(pages: DataFrame, markers: list[str]) -> DataFrame:
    """Distinct markers per document in the normalised text, also across page ends."""
    return marker_counts(pages, markers=markers)


# --- annex -----------------------------------------------------------------


def join_wrapped_lines(pages: DataFrame) -> DataFrame:
    """Join each row line that lacks its tail with the next line.

    A consumed line cannot start a pair, so within a run of open lines every second one
    starts: the parity of the distance to the last closed line decides, without a fold.
    """
    lines = _positions(pages)
    opens = F.col("line").rlike(r"^\d+\s+") & ~F.col("line").rlike(r"\s+[IVXLCDM]+\s+\d+\s+")
    lines = lines.withColumn("_open", opens)
    lines = carry_last(lines, ["doc_id"], "block", ["pos"], {"_closed": F.when(~F.col("_open"), F.col("pos"))},
                       include_current=False)
    run = F.col("pos") - 1 - F.coalesce("_closed", F.lit(-1))
    consumed = run % 2 == 1
    head = F.when(consumed, F.col("pos") - 1).otherwise(F.col("pos"))
    grouped = lines.withColumn("pos_head", head).groupBy("doc_id", "pos_head").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("line")
    )
    return grouped.select("doc_id", F.col("pos_head").alias("pos"), "line")


def extract_annex_rows(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rows of a known annex table: at least five markers and three parsed rows.

    ``counts`` (doc_id, annex) are the markers of the documents where they are known already.
    """
    counts = counts or stored(marker_counts(pages, annex=V.ANNEX_MARKERS).where(F.col("annex") >= 5))
    docs = counts.where(F.col("annex") >= 5).select("doc_id")
    lines = join_wrapped_lines(pages.join(docs, "doc_id", "left_semi"))
    hit = lines.where(F.col("line").rlike(V.ANNEX_ROW))
    group = lambda i: trim_ws(F.regexp_extract("line", V.ANNEX_ROW, i))
    rows = stored(hit.select(
        "doc_id", "pos", *[group(i + 1).alias(c) for i, c in enumerate(V.ANNEX_COLUMNS)]
    ))
    enough = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= 3)
    return rows.join(enough.select("doc_id"), "doc_id", "left_semi")


# --- sections --------------------------------------------------------------


def _category(section: Column, line: Column) -> Column:
    return bind(norm_punct(F.concat_ws(" ", section, line)), _category_of)


def _category_of(t: Column) -> Column:
    has = lambda *words: t.rlike("|".join(words))
    return (
        F.when(has("resolucion"), "Resolución")
        .when(has("expediente"), "Expediente")
        .when(has("componente"), "Componente del proyecto")
        .when(has("inspeccion"), "Inspección")
        .when(has("consumo", "agua", "electrico"), "Consumo")
        .when(has("produccion", "inversion", "pozo"), "Indicador")
        .when(has("ubicacion", "zona geografica", "domicilio"), "Ubicación")
        .when(has("proyecto", "empresa", "concesionario"), "Proyecto")
        .otherwise("")
    )


_FIELD = r"^([^:]{2,80}):\s*(.+)$"
_BULLET = r"^[•\-–*]\s*(.+)$"


def _label(line: Column) -> Column:
    field = trim_ws(F.regexp_extract(line, _FIELD, 1))
    words = F.array_join(F.slice(F.filter(F.split(line, r"\s+"), lambda w: w != ""), 1, 6), " ")
    words = F.regexp_replace(words, r"[.,;:]\z", "")
    return F.when(line.rlike(_FIELD), field).when(words != "", words).otherwise("Dato")


def _section_title(line: Column) -> Column:
    """Marker that the line is or starts with (first in order), else null."""

    def title(t: Column) -> Column:
        out = F
        for marker in V.SECTION_MARKERS:
            m = py_punct(marker)
            out = out.when((t == m) | t.startswith(m + " "), F.lit(marker))
        return out.otherwise(F.lit(None).cast("string"))

    return bind(norm_punct(line), title)


def section_rows(pages: DataFrame) -> DataFrame:
    """Typed rows of titles, bullets, ``field: value`` and categorised lines, before any gate."""
    lines = _positions(pages).withColumn("_title", _section_title(F.col("line")))
    lines = carry_last(lines, ["doc_id"], "block", ["pos"], {"_section": F.col("_title")})
    line, title = F.col("line"), F.col("_title")
    section = F.coalesce("_section", F.lit("Datos generales"))
    at = F.instr(F.lower(line), F.lower(title))
    after_title = trim_ws(F.when(
        at > 0, F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.length(title), F.length(line)))
    ).otherwise(line))
    only_title = norm_punct(line) == norm_punct(title)
    bullet = trim_ws(F.regexp_extract(line, _BULLET, 1))
    field, value = (trim_ws(F.regexp_extract(line, _FIELD, i)) for i in (1, 2))
    category = _category(section, line)
    lines = lines.withColumns({
        "_section": section,
        "_kind": F.when(title.isNotNull() & ~only_title & (after_title != ""), "title")
        .when(title.isNotNull(), None)
        .when(bullet != "", "bullet").when(line.rlike(_FIELD), "field").when(category != "", "text"),
    }).where(F.col("_kind").isNotNull())
    kind = F.col("_kind")
    lines = lines.withColumn("_value", F.when(kind == "title", after_title).when(kind == "bullet", bullet)
                             .when(kind == "field", value).otherwise(line))
    v, sec = F.col("_value"), F.col("_section")
    lines = lines.withColumns({
        "_dato": F.when(kind == "title", title).when(kind == "field", field)
        .when(kind == "bullet", _label(v)).otherwise(_label(line)),
        "_cat": _category(sec, v),
    })
    cat, scope = F.col("_cat"), norm_punct(F.concat_ws(" ", "_dato", sec))
    in_value = cat.isin("Dato", "Indicador", "Consumo") | (F.length(v) <= 80)
    blank = F.lit("")
    values = [
        sec, cat, F.col("_dato"), F.when(in_value, v).otherwise(blank), F.when(in_value, blank).otherwise(v),
        extract_date(v), F.when(cat.isin("Resolución", "Expediente"), v).otherwise(extract_reference(v)),
        F.when(scope.rlike("empresa|proyecto|concesionario"), v).otherwise(blank),
        F.when(scope.rlike("ubicacion|zona geografica|domicilio"), v).otherwise(blank), blank,
    ]
    return lines.select("doc_id", "pos", *[x.alias(c) for x, c in zip(values, V.SECTION_COLUMNS)])


_SECTION_NEEDLES = [py_punct(m) for m in V.SECTION_MARKERS]


def extract_sections(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Section rows of documents with four or more markers and ten or more distinct rows.

    The current section carries across lines and pages. ``counts`` (doc_id, sections) are the markers of the
    documents where they are known already.
    """
    counts = counts or stored(marker_counts(pages, sections=_SECTION_NEEDLES).where(F.col("sections") >= 4))
    docs = counts.where(F.col("sections") >= 4).select("doc_id")
    rows = section_rows(pages.join(docs, "doc_id", "left_semi"))
    rows = first_rows(rows, ["doc_id", *V.SECTION_COLUMNS], ["pos"])
    rows = stored(rows.where((F.col("Detalle") != "") | (F.col("Valor") != "")))
    enough = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= 10)
    return rows.join(enough.select("doc_id"), "doc_id", "left_semi")


# --- local fallback --------------------------------------------------------


def _as_cells(columns: list[str]) -> Column:
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))])


def local_fallback(pages: DataFrame) -> DataFrame:
    """Rows from the first method that yields any: annex, then sections, then plain lines.

    ``doc_id, source, result_quality, pos, cells``.  The markers of both methods are counted in one pass; each later
    method only sees the documents the earlier ones left, and parsed rows are stored, so no text is parsed twice.
    Ids of documents are stored as well: a join with few of them leaves the texts where they are.
    """
    ids = lambda df: stored(df.select("doc_id").distinct())
    counts = stored(marker_counts(pages, annex=V.ANNEX_MARKERS, sections=_SECTION_NEEDLES).where(
        (F.col("annex") >= 5) | (F.col("sections") >= 4)))
    annex = extract_annex_rows(pages, counts)
    left = pages.join(ids(annex), "doc_id", "left_anti")
    sections = extract_sections(left, counts)
    plain = left.join(ids(sections), "doc_id", "left_anti")
    numbered = _positions(plain)
    lines = numbered.select("doc_id", "pos", F.create_map(
        F.lit("Página"), F.col("page_number").cast("string"), F.lit("Línea"), F.col("line_no").cast("string"),
        F.lit("Texto"), F.col("line"),
    ).alias("cells"))
    tag = lambda df, source, quality: df.select(
        "doc_id", F.lit(source).alias("source"), F.lit(quality).alias("result_quality"), "pos", "cells")
    return (
        tag(annex.select("doc_id", "pos", _as_cells(V.ANNEX_COLUMNS).alias("cells")), "annex_table", "partial")
        .unionByName(tag(sections.select("doc_id", "pos", _as_cells(V.SECTION_COLUMNS).alias("cells")), "sections", "partial"))
        .unionByName(tag(lines, "text_lines", "local-fallback"))
    )
