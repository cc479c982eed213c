"""Shape of extracted tables: headers, rows, duplicates, merging, projection.

Long form: ``table_columns(doc_id, candidate, col_idx, name)`` and ``table_rows(doc_id,
candidate, row_idx, cells map<string,string>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import bind, clean_cell, clean_value, col, norm_key, py_key, trim_ws
from ..functions.values import commercial_column_count, corrupt_text, ignored_texts
from .ordered import first_rows, number_rows

EMPTY = lambda: F.array().cast("array<string>")


# --- headers ---------------------------------------------------------------


def dedupe_headers(columns: DataFrame) -> DataFrame:
    """Blank names become ``Columna_N``; repeats get ``_2``, ``_3``; the source name is kept."""
    cleaned = clean_value(F.regexp_replace("name", r"[\x00-\x1f\x7f]", " "))
    named = columns.withColumn(
        "_n", F.when(cleaned == "", F.concat(F.lit("Columna_"), F.col("col_idx").cast("string"))).otherwise(cleaned)
    )
    w = Window.partitionBy("doc_id", "candidate", "_n").orderBy("col_idx")
    named = named.withColumn("_k", F.row_number().over(w))
    out = F.when(F.col("_k") == 1, F.col("_n")).otherwise(F.concat("_n", F.lit("_"), F.col("_k").cast("string")))
    return named.select("doc_id", "candidate", "col_idx", F.col("name").alias("source"), out.alias("name"))


def distinct_headers(columns: DataFrame) -> DataFrame:
    """Drop blank headers and later headers with the same normalised key."""
    keyed = columns.withColumn("_key", norm_key("name")).where((F.col("_key") != "") & (trim_ws("name") != ""))
    return first_rows(keyed, ["doc_id", "candidate", "_key"], ["col_idx"]).drop("_key")


def generic_line_schema(columns) -> Column:
    """The header holds page, line and text: a plain transcription, not a table."""
    return generic_line_keys(F.transform(col(columns), norm_key))


def generic_line_keys(keys: Column) -> Column:
    """The same, of a header's normalised names."""
    return F.size(F.array_intersect(keys, F.array(*[F.lit(x) for x in ("pagina", "linea", "texto")]))) == 3


def field_value_output(columns) -> Column:
    keys = F.transform(col(columns), norm_key)
    return F.array_contains(keys, "campo") & F.array_contains(keys, "valor") & (F.size(keys) <= 3)


def header_except(left: Column, right: Column) -> Column:
    """Names of the left list whose key is not in the right list, in order."""
    return bind(F.transform(right, norm_key), lambda keys: F.filter(
        left, lambda c: ~F.array_contains(keys, norm_key(c))
    ))


def header_intersect(left: Column, right: Column) -> Column:
    return bind(F.transform(right, norm_key), lambda keys: F.filter(
        left, lambda c: F.array_contains(keys, norm_key(c))
    ))


def missing_columns(expected: Column, actual: Column) -> Column:
    return header_except(expected, actual)


def extra_columns(expected: Column, actual: Column) -> Column:
    return header_except(actual, expected)


def unsupported_columns(columns, text) -> Column:
    """Movement columns of a result that the document text never mentions."""
    movement = [py_key(c) for c in V.MOVEMENT_COLUMNS]
    return bind(norm_key(text), lambda seen: F.filter(
        col(columns), lambda c: bind(norm_key(c), lambda k: k.isin(movement) & ~seen.contains(k))
    ))


# --- rows ------------------------------------------------------------------


def non_empty(cells, expected: Column | None = None) -> Column:
    """Any cell (of the expected columns, if given) is non-blank."""
    if expected is None:
        return F.exists(F.map_values(col(cells)), lambda v: clean_value(v) != "")
    return bind(cells, lambda row: F.exists(expected, lambda c: clean_value(row[c]) != ""))


def drop_empty_rows(rows: DataFrame) -> DataFrame:
    return rows.where(non_empty("cells"))


def coerce_cells(columns, cells) -> Column:
    """Exactly the given columns; missing cells are ''."""
    return bind(columns, lambda names: F.map_from_arrays(
        names, bind(cells, lambda row: F.transform(names, lambda c: clean_value(row[c])))))


def coerce_list(columns, values) -> Column:
    return bind(columns, lambda names: F.map_from_arrays(
        names, bind(values, lambda row: F.transform(names, lambda c, i: clean_value(F.get(row, i))))))


def row_signature(columns: Column, cells: Column) -> Column:
    return bind(cells, lambda row: F.array_join(F.transform(columns, lambda c: clean_value(row[c])), "|"))


def dedupe_first(rows: DataFrame, signature: Column, keys: tuple[str, ...] = ("doc_id", "candidate")) -> DataFrame:
    """First row per document and signature, by row order; combined before the shuffle."""
    return first_rows(rows.withColumn("_sig", signature), [*keys, "_sig"], ["row_idx"]).drop("_sig")


def renumber_rows(rows: DataFrame, rows_per_block: int = 65536) -> DataFrame:
    """1-based ``row_number`` per document over whatever rows remain, blockwise."""
    cut = rows.withColumn("_b", F.floor(F.col("row_idx") / rows_per_block))
    return number_rows(cut, ["doc_id"], "_b", ["row_idx"], "row_number").drop("_b")


def header_sources(expected: Column, columns: Column, keys: Column | None = None, wanted: Column | None = None) -> Column:
    """For each expected column the name of the header that it is read from: exact normalised name, else a name containing it.

    ``keys`` and ``wanted``: the normalised names of the header and of the expected columns, where they are known.
    """

    def of(names: Column, keys: Column, wanted: Column) -> Column:
        def one(k: Column, i: Column) -> Column:
            loose = F.coalesce(F.array_min(F.transform(keys, lambda x, j: F.when(x.contains(k), j + 1))), F.lit(0))
            exact = F.array_position(keys, k).cast("int")
            return F.coalesce(F.get(names, F.when(exact > 0, exact).otherwise(loose) - 1), F.get(expected, i))

        return F.transform(wanted, one)

    # Bound inputs: the optimizer may copy their definitions into the lambdas otherwise.
    return bind(columns, lambda names: bind(F.transform(names, norm_key) if keys is None else keys, lambda keys: bind(
        F.transform(expected, norm_key) if wanted is None else wanted, lambda wanted: of(names, keys, wanted))))


def source_values(sources: Column, cells: Column) -> Column:
    """The clean cells of a row under these names, as a list."""
    return bind(cells, lambda row: F.transform(sources, lambda s: clean_value(row[s])))


def project_cells(expected: Column, columns: Column, cells: Column) -> Column:
    """Re-key a row to the expected columns."""
    return F.map_from_arrays(expected, bind(header_sources(expected, columns), lambda sources: source_values(sources, cells)))


def project_to_profile(rows: DataFrame, expected: list[str]) -> DataFrame:
    """Rows (``columns, cells, row_idx``) re-keyed to a profile, with the auxiliary JSON fields."""
    wanted = F.array(*[F.lit(e) for e in expected])
    meta = F.array(*[F.lit(m) for m in ("pageNumber", "rowNumber", "confidence", "warnings")])
    extra = project_cells(meta, F.col("columns"), F.col("cells"))
    return rows.withColumns({"_extra": extra, "projected": project_cells(wanted, F.col("columns"), F.col("cells"))}).select(
        *[c for c in rows.columns if c != "cells"],
        F.col("projected").alias("cells"),
        F.col("_extra")["pageNumber"].alias("page_number"),
        F.coalesce(F.nullif(F.col("_extra")["rowNumber"], F.lit("")), F.col("row_idx").cast("string")).alias("row_number"),
        F.col("_extra")["confidence"].alias("confidence"),
        F.col("_extra")["warnings"].alias("warnings"),
    )


def header_repeat(cells, expected: list[str]) -> Column:
    """The row repeats the header: enough cells equal their own column name."""
    names = F.array(*[F.lit(e) for e in expected])
    keys = F.array(*[F.lit(py_key(e)) for e in expected])
    values = bind(cells, lambda m: F.transform(names, lambda c: clean_value(m[c])))
    return bind(values, lambda v: _own_names(v, keys)) >= max(3, len(expected) // 2)


def _own_names(values: Column, keys: Column) -> Column:
    """How many cells equal the key of their own column."""
    return F.size(F.filter(F.transform(values, lambda v, i: F.when(v != "", norm_key(v) == F.get(keys, i))), lambda same: same))


def movement_values(values) -> Column:
    """The clean values of the movement columns, in their order, hold movement data and are neither watermark, garbage nor header."""
    keys = F.array(*[F.lit(py_key(c)) for c in V.MOVEMENT_COLUMNS])

    def keep(values: Column) -> Column:
        sound = lambda joined: (F.size(ignored_texts(joined)) == 0) & ~corrupt_text(joined, strict=True)
        return (
            F.exists(values, lambda v: v != "")
            & (_own_names(values, keys) < max(3, len(V.MOVEMENT_COLUMNS) // 2))
            & bind(F.array_join(values, " "), sound)
        )

    return bind(values, keep)


def movement_row(cells) -> Column:
    """The row holds movement data and is neither watermark, garbage nor header."""
    expected = F.array(*[F.lit(c) for c in V.MOVEMENT_COLUMNS])
    # One reference to ``cells``: a pushed-down filter would otherwise copy its definition.
    return movement_values(bind(cells, lambda row: F.transform(expected, lambda c: clean_value(row[c]))))


def filter_movement_rows(rows: DataFrame) -> DataFrame:
    """A costly test, so it stays where the rows are instead of being pushed to the scan."""
    return rows.select(F.inline(F.when(movement_row("cells"), F.array(F.struct(*rows.columns)))))


# --- supplier headers ------------------------------------------------------


def supplier_header(c) -> Column:
    """Supplier column a header cell stands for (first column in order wins), else null."""

    def target_of(key: Column) -> Column:
        out = F
        for target, aliases in V.SUPPLIER_HEADER_ALIASES.items():
            out = out.when(key.rlike("|".join(py_key(a) for a in aliases)), F.lit(target))
        return out.otherwise(F.lit(None).cast("string"))

    return bind(norm_key(clean_cell(c)), target_of)


def detected_supplier_headers(text) -> Column:
    """Supplier columns whose alias occurs anywhere in the text."""
    return bind(norm_key(text), lambda key: F.array_compact(F.array(*[
        F.when(key.rlike("|".join(py_key(a) for a in aliases)), F.lit(target))
        for target, aliases in V.SUPPLIER_HEADER_ALIASES.items()
    ])))


def supplier_cells(names: Column, values: Column) -> Column:
    """Parallel header and value arrays to the eight supplier columns; the last match wins."""
    targets = F.split(F.lit("|".join(V.SUPPLIER_COLUMNS)), r"\|")

    def place(heads: Column, row: Column) -> Column:
        def cell(target: Column) -> Column:
            at = F.array_max(F.transform(heads, lambda h, i: F.when(h == target, i)))
            return F.coalesce(clean_cell(F.get(row, at)), F.lit(""))

        return F.transform(targets, cell)

    return F.map_from_arrays(targets, bind(names, lambda heads: bind(values, lambda row: place(heads, row))))


def normalize_candidate_rows(rows: DataFrame) -> DataFrame:
    """Free-form rows re-keyed to the eight supplier columns."""
    names = F.transform(F.map_keys("cells"), supplier_header)
    return rows.withColumn("cells", supplier_cells(names, F.map_values("cells")))


# --- commercial projection -------------------------------------------------


def commercial_cells(columns, cells) -> Column:
    """The 34 commercial columns, each the first non-empty source among its aliases."""
    filled = bind(cells, lambda row: F.filter(
        F.transform(col(columns), lambda c: F.struct(norm_key(c).alias("k"), clean_value(row[c]).alias("v"))),
        lambda s: s["v"] != "",
    ))
    aliases = [V.COMMERCIAL_ALIASES.get(py_key(t), [py_key(t)]) for t in V.COMMERCIAL_COLUMNS]
    # One "|a|b|" text per target, so that the 34 targets are one expression over an array.
    wanted = F.split(F.lit(";".join("|" + "|".join(a) + "|" for a in aliases)), ";")
    first = lambda s, want: F.coalesce(F.get(F.filter(
        s, lambda x: F.contains(want, F.concat(F.lit("|"), x["k"], F.lit("|")))), F.lit(0))["v"], F.lit(""))
    names = F.split(F.lit(";".join(V.COMMERCIAL_COLUMNS)), ";")
    return F.map_from_arrays(names, bind(filled, lambda s: F.transform(wanted, lambda want: first(s, want))))


def commercial_projection(rows: DataFrame) -> DataFrame:
    """Rows of tables with at least six commercial columns, on the fixed 34-column schema."""
    return rows.where(commercial_column_count("columns") >= 6).withColumn(
        "cells", commercial_cells("columns", "cells")
    )


# --- merging ---------------------------------------------------------------


def merge_chunks(outputs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Merge chunk outputs of a document.

    ``outputs``: ``doc_id, chunk_index, columns, rows array<map>``.  Equal headers are kept,
    otherwise rows are coerced to the standard chunk schema; repeated rows are dropped in order.
    ``errors`` (``doc_id, chunk_index, page_range, message``) are appended on the standard schema.
    """
    standard = F.array(*[F.lit(c) for c in V.CHUNK_COLUMNS])
    heads = outputs.groupBy("doc_id").agg(
        F.min_by("columns", "chunk_index").alias("_first"),
        F.min("columns").alias("_lo"), F.max("columns").alias("_hi"),
    ).select(
        "doc_id",
        F.when((F.col("_lo") == F.col("_hi")) & (F.col("_first") != standard), F.col("_first"))
        .otherwise(standard).alias("columns"),
    )
    rows = outputs.select("doc_id", "chunk_index", F.posexplode("rows").alias("p", "cells"))
    rows = rows.join(heads, "doc_id").select(
        "doc_id", F.struct("chunk_index", "p").alias("row_idx"), "columns",
        coerce_cells("columns", "cells").alias("cells"),
    )
    merged = dedupe_first(rows, row_signature(F.col("columns"), F.col("cells")), ("doc_id",))
    merged = merged.select("doc_id", F.lit(0).alias("part"), F.col("row_idx")["chunk_index"].alias("chunk_index"),
                           F.col("row_idx")["p"].alias("p"), "columns", "cells")
    if errors is None:
        return merged
    on_standard = heads.where(F.col("columns") == standard)
    cells = chunk_error_cells("page_range", "message")
    extra = errors.join(on_standard, "doc_id").select(
        "doc_id", F.lit(1).alias("part"), "chunk_index", F.lit(0).alias("p"), "columns", cells.alias("cells")
    )
    return merged.unionByName(extra)


def chunk_error_cells(page_range, message) -> Column:
    values = {
        "Sección": F.lit("Sistema"), "Tipo de dato": F.lit("Error de procesamiento"),
        "Título": F.lit("Chunk no procesado"), "Descripción": col(message), "Página": col(page_range),
    }
    pairs = []
    for c in V.CHUNK_COLUMNS:
        pairs += [F.lit(c), clean_value(values.get(c, F.lit("")))]
    return F.create_map(*pairs)


def merge_warnings(*lists) -> Column:
    """Ordered distinct union of warning lists."""
    return F.array_distinct(F.concat(*[F.coalesce(col(x), EMPTY()) for x in lists]))


def cap_warnings(c, limit: int) -> Column:
    return F.slice(col(c), 1, limit)


# --- views for display -----------------------------------------------------


def preview(rows: DataFrame, max_rows: int = 5, max_columns: int = 8) -> DataFrame:
    """First rows and columns of each table plus how many are hidden."""
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    w = Window.partitionBy("doc_id").orderBy("row_idx")
    top = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_rows)
    names = F.slice("columns", 1, max_columns)
    return top.join(sizes, "doc_id").select(
        "doc_id", "row_idx", names.alias("columns"),
        F.transform(names, lambda c: F.coalesce(F.col("cells")[c], F.lit(""))).alias("values"),
        F.greatest(F.size("columns") - max_columns, F.lit(0)).alias("hidden_columns"),
        F.greatest(F.col("n_rows") - max_rows, F.lit(0)).alias("hidden_rows"),
    )


def export_column_widths(rows: DataFrame) -> DataFrame:
    """Spreadsheet width per table column: longest value plus 2, within 12..42."""
    cells = rows.select("doc_id", F.explode("cells").alias("name", "value"))
    longest = cells.groupBy("doc_id", "name").agg(F.max(F.length("value")).alias("_m"))
    return longest.select(
        "doc_id", "name",
        F.least(F.greatest(F.greatest(F.col("_m"), F.length("name")) + 2, F.lit(12)), F.lit(42)).alias("width"),
    )


def result_stats(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows, fields, pages and text length per document."""
    r = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("fields"))
    p = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("text_length"))
    return p.join(r, "doc_id", "left").select(
        "doc_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("fields", F.lit(0)).alias("fields"),
        "pages", "text_length",
    )
