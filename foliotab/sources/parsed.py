"""Parsers for CSV and JSON text held in a column.

Each parser is a Column expression giving ``struct<columns array<string>, rows
array<map<string,string>>>`` (or a status), so a whole corpus is parsed in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import (
    bind, clean_value, col, drop_controls, json_value, norm_key, split_lines, strip_fences, trim_ws,
)
from ..functions.values import normalize_confidence

_BOM = chr(0xFEFF)
# One cell: plain runs and quoted runs; an open quote runs to the end of the line.
_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)'
_CELL = r',((?:[^,"]++|"[^"]*+(?:""[^"]*+)*+(?:"|$))*+)'


def csv_cells(line) -> Column:
    """Cells of one CSV line; quotes may open anywhere, ``""`` inside quotes is a quote."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), col(line)), F.lit(_CELL), F.lit(1))
    unquote = lambda x: F.replace(F.regexp_replace(x, _QUOTED, "$1"), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(x.contains('"'), unquote(x)).otherwise(x))


def _nonblank_lines(text) -> Column:
    return F.filter(F.transform(split_lines(text), trim_ws), lambda x: x != "")


def _name_slots(columns: Column) -> Column:
    """``struct<names, slots>``: distinct columns and the 0-based last place of each."""
    n = F.size(columns)
    return bind(F.reverse(columns), lambda back: bind(F.array_distinct(columns), lambda names: F.struct(
        names.alias("names"),
        F.transform(names, lambda c: (n - F.array_position(back, c)).cast("int")).alias("slots"),
    )))


def record(slots: Column, cells: Column) -> Column:
    """Map of column to cell; a repeated column keeps the last cell, missing cells are ''."""
    return F.map_from_arrays(
        slots["names"], F.transform(slots["slots"], lambda i: F.coalesce(F.get(cells, i), F.lit("")))
    )


def parse_csv_text(text) -> Column:
    """Header and rows of a CSV text; blank lines dropped, no multi-line cells."""
    lines = _nonblank_lines(F.regexp_replace(col(text), "^" + _BOM, ""))
    none = F.array().cast("array<string>")
    return bind(
        F.transform(lines, lambda x: F.transform(csv_cells(x), trim_ws)),
        lambda t: F.struct(
            F.coalesce(F.get(t, F.lit(0)), none).alias("columns"),
            F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("rows"),
        ),
    )


def explode_table(df: DataFrame, parsed: str, *keep: str) -> DataFrame:
    """``keep.., row_idx, columns, cells`` from a parsed struct column, one row per table row."""
    return df.select(
        *keep, F.col(parsed)["columns"].alias("columns"), F.posexplode(F.col(parsed)["rows"]).alias("p", "cells")
    ).select(*keep, (F.col("p") + 1).alias("row_idx"), "columns", "cells")


def _csv_line(x: Column) -> Column:
    return (x != "") & ~x.startswith("```") & x.contains(",")


def extract_csv_block(text) -> Column:
    """The CSV part of an answer: first to last line that has a comma, '' if none."""

    def body(t: Column) -> Column:
        bare = trim_ws(F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:csv)?", ""), r"```\z", ""))
        fenced = trim_ws(F.regexp_extract(t, r"(?is)```(?:csv)?\s*(.*?)```", 1))
        return bind(fenced, lambda f: F.when(f != "", f).otherwise(bare))

    def block(lines: Column) -> Column:
        marks = F.transform(lines, _csv_line)
        return bind(marks, lambda m: bind(
            F.struct(F.array_position(m, True).cast("int").alias("first"),
                     (F.size(m) + 1 - F.array_position(F.reverse(m), True)).cast("int").alias("last")),
            lambda at: F.when(at["first"] == 0, F.lit("")).otherwise(
                F.array_join(F.slice(lines, F.greatest(at["first"], F.lit(1)),
                                     F.greatest(at["last"] - at["first"] + 1, F.lit(0))), "\n")),
        ))

    trimmed = trim_ws(F.regexp_replace(col(text), "^" + _BOM, ""))
    return bind(_nonblank_lines(bind(trimmed, body)), block)


def looks_like_html(text) -> Column:
    return F.ltrim(F.substring(trim_ws(text), 1, 80)).startswith("<")


def parse_csv_like(text, max_header: int | None = None, max_columns: int | None = None) -> Column:
    """A CSV-looking answer as columns and rows, else null.

    Needs two lines, a header of two columns or more, and at least half of the first seven data
    lines with two cells.  Surplus cells join the last column.  A caller may bound the length of
    the header and the number of columns.
    """

    def table(lines: Column, header: Column, head_cells: Column) -> Column:
        data = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        columns = F.filter(F.transform(head_cells, clean_value), lambda x: x != "")
        rows = F.transform(data, csv_cells)
        looks = (F.size(lines) >= 2) & header.contains(",") & (F.size(head_cells) >= 2)
        if max_header is not None:
            looks = looks & (F.length(header) <= max_header)
        return F.when(looks, bind(rows, lambda r: bind(columns, lambda c: finish(r, c))))

    def finish(rows: Column, columns: Column) -> Column:
        n = F.size(columns)
        sample = F.slice(rows, 1, 7)
        wide = F.size(F.filter(sample, lambda r: F.size(r) >= 2))
        compatible = wide >= F.greatest(F.lit(1), F.ceil(F.size(sample) / 2))
        usable = F.filter(rows, lambda r: F.exists(r, lambda x: clean_value(x) != ""))

        def fit(r: Column) -> Column:
            last = F.array(F.array_join(F.slice(r, n, F.size(r) - n + 1), ", "))
            return F.when(F.size(r) > n, F.concat(F.slice(r, F.lit(1), n - 1), last)).otherwise(r)

        records = lambda slots: F.transform(
            usable, lambda r: record(slots, F.transform(fit(r), clean_value)))
        out = bind(_name_slots(columns), lambda s: F.struct(columns.alias("columns"), records(s).alias("rows")))
        ok = compatible & (n >= 2 if max_columns is None else n.between(2, max_columns)) & F.exists(rows, lambda r: F.exists(r, lambda x: clean_value(x) != ""))
        return F.when(ok, out)

    def parse(body: Column) -> Column:
        lines = lambda x: bind(F.get(x, F.lit(0)), lambda h: bind(csv_cells(h), lambda hc: table(x, h, hc)))
        return F.when(~looks_like_html(body), bind(_nonblank_lines(body), lines))

    return bind(strip_fences(F.regexp_replace(col(text), "^" + _BOM, "")), parse)


def _first_object(text) -> Column:
    body = strip_fences(F.regexp_replace(col(text), "^" + _BOM, ""))
    return bind(body, lambda b: F.when(b.contains("{"), F.substring(b, F.instr(b, "{"), F.length(b))))


def _closes(obj: Column) -> Column:
    """Whether the first object is closed: brace depth returns to zero outside strings."""
    bare = F.regexp_replace(obj, r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)', "")
    braces = F.split(F.regexp_replace(bare, "[^{}]+", ""), "")
    depth = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("done")),
        lambda a, b: F.struct(
            (a["d"] + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)).alias("d"),
            (a["done"] | ((b == "}") & (a["d"] == 1))).alias("done"),
        ),
    )
    return depth["done"]


_MODEL_SCHEMA = "columns array<string>, rows array<string>"


def _row_record(row: Column, slots: Column) -> Column:
    """A JSON row (object or array text) as a map with exactly the given columns."""
    by_name = lambda obj: F.transform(slots["names"], lambda c: json_value(obj[c]))
    by_place = lambda arr: F.transform(slots["slots"], lambda i: json_value(F.get(arr, i)))
    values = F.when(F.ltrim(row).startswith("["), bind(F.from_json(row, "array<string>"), by_place)).otherwise(
        bind(F.from_json(row, "map<string,string>"), by_name)
    )
    return F.map_from_arrays(slots["names"], values)



def parse_model_json(df: DataFrame, text: str) -> DataFrame:
    """Add ``parse_status``, ``columns`` and ``rows`` for a recorded model answer.

    Status is OK, CSV_LIKE or one of the five AI_RESPONSE_* codes.
    """
    trimmed = trim_ws(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^" + _BOM, ""))
    df = df.withColumn("_t", trimmed)
    html = looks_like_html("_t")
    df = df.withColumn("_o", F.when((F.col("_t") != "") & ~html, _first_object("_t")))
    df = df.withColumn("_closed", F.when(F.col("_o").isNotNull(), _closes(F.col("_o"))).otherwise(False))
    parsed = F.when(F.col("_closed"), F.from_json("_o", _MODEL_SCHEMA))
    df = df.withColumns({"_p": parsed, "_keys": F.when(F.col("_closed"), F.json_object_keys("_o"))})
    columns = F.filter(F.transform(F.col("_p")["columns"], clean_value), lambda x: x != "")
    df = df.withColumns({
        "_c": columns,
        "_csv": F.when(~F.col("_closed") & (F.col("_t") != "") & ~html, parse_csv_like("_t")),
    })
    status = (
        F.when(F.col("_t") == "", "AI_RESPONSE_EMPTY")
        .when(html, "AI_RESPONSE_HTML_INSTEAD_OF_JSON")
        .when(~F.col("_closed") & F.col("_csv").isNotNull(), "CSV_LIKE")
        .when(~F.col("_closed"), "AI_RESPONSE_NOT_JSON")
        .when(F.col("_keys").isNull(), "AI_RESPONSE_INVALID_JSON")
        .when(
            F.col("_p")["columns"].isNull() | F.col("_p")["rows"].isNull() | (F.size("_c") == 0),
            "AI_RESPONSE_SCHEMA_INVALID",
        )
        .otherwise("OK")
    )
    df = df.withColumn("parse_status", status)
    rows = bind(_name_slots(F.col("_c")), lambda slots: F.transform(F.col("_p")["rows"], lambda r: _row_record(r, slots)))
    return df.withColumns({
        "columns": F.when(F.col("parse_status") == "OK", F.col("_c")).otherwise(F.col("_csv")["columns"]),
        "rows": F.when(F.col("parse_status") == "OK", rows).otherwise(F.col("_csv")["rows"]),
    }).drop("_t", "_o", "_closed", "_p", "_keys", "_c", "_csv")


def _distinct_by_key(values: Column) -> Column:
    """Values whose normalised key is non-empty and not seen before, in order."""
    keyed = F.filter(F.transform(values, lambda v: F.struct(v.alias("v"), norm_key(v).alias("k"))), lambda s: s["k"] != "")
    return bind(keyed, lambda ks: bind(F.transform(ks, lambda s: s["k"]), lambda keys: F.transform(
        F.filter(ks, lambda s, i: F.array_position(keys, s["k"]) == i + 1), lambda s: s["v"])))


def distinct_headers(values) -> Column:
    return _distinct_by_key(F.transform(col(values), lambda v: F.coalesce(drop_controls(v), F.lit(""))))


def _values_by_key(row: Column, keys: Column) -> Column:
    """Values of a JSON row for normalised column keys; unknown and nested ones are ''."""

    def cell(value: Column) -> Column:
        nested = value.startswith("{") | value.startswith("[")
        return F.when(nested, F.lit("")).otherwise(F.coalesce(drop_controls(value), F.lit("")))

    def pick(obj: Column) -> Column:
        return bind(F.transform(F.map_keys(obj), norm_key), lambda have: bind(F.map_values(obj), lambda vals: F.transform(
            keys, lambda k: bind(F.get(vals, F.array_position(have, k).cast("int") - 1), cell))))

    blank = F.transform(keys, lambda k: F.lit(""))
    return F.coalesce(bind(F.from_json(row, "map<string,string>"), pick), blank)


def _texts(values: Column) -> Column:
    cleaned = F.filter(F.transform(values, lambda v: F.coalesce(drop_controls(v), F.lit(""))), lambda v: v != "")
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def parse_visual_json(df: DataFrame, text: str, expected: list[str] | None = None) -> DataFrame:
    """Recorded visual extraction: columns are the expected ones, else declared plus row keys."""
    schema = (
        "success boolean, columns array<string>, rows array<string>, confidence string, "
        "warnings array<string>, documentType string"
    )
    df = df.withColumn("_v", F.from_json(text, schema))
    raw_rows = F.coalesce(F.col("_v")["rows"], F.array().cast("array<string>"))
    row_keys = F.flatten(F.transform(raw_rows, lambda r: F.coalesce(F.json_object_keys(r), F.array().cast("array<string>"))))
    declared = F.coalesce(F.col("_v")["columns"], F.array().cast("array<string>"))
    source = F.array(*[F.lit(e) for e in expected]) if expected else F.concat(declared, row_keys)
    columns = F.filter(distinct_headers(source), lambda c: ~norm_key(c).isin(V.VISUAL_METADATA_KEYS))
    df = df.withColumns({"columns": columns, "_rows": raw_rows})

    def with_meta(r: Column, keys: Column) -> Column:
        return bind(F.from_json(r, "struct<confidence string, warnings array<string>>"), lambda obj: F.struct(
            _values_by_key(r, keys).alias("values"), normalize_confidence(obj["confidence"]).alias("confidence"),
            F.array_join(_texts(obj["warnings"]), "; ").alias("warnings"),
        ))

    df = df.withColumn("_keys", F.transform("columns", norm_key))
    found = bind("_keys", lambda keys: F.filter(
        F.transform("_rows", lambda r: with_meta(r, keys)), lambda s: F.exists(s["values"], lambda v: v != "")))
    rows = bind("columns", lambda names: F.transform(found, lambda s: F.struct(
        F.map_from_arrays(names, s["values"]).alias("cells"), s["confidence"].alias("confidence"), s["warnings"].alias("warnings"))))
    return df.withColumns({
        "rows": rows,
        "success": F.coalesce(F.col("_v")["success"], F.lit(False)),
        "confidence": normalize_confidence(F.col("_v")["confidence"]),
        "warnings": _texts(F.col("_v")["warnings"]),
    }).drop("_v", "_rows", "_keys")


def parse_reviewed_table(df: DataFrame, text: str) -> DataFrame:
    """Recorded reviewer answer: distinct headers, rows re-keyed, empty rows dropped."""
    schema = (
        "finalHeaders array<string>, finalRows array<string>, confidence string, "
        "warnings array<string>, correctionsApplied array<string>, finalDocumentType string"
    )
    df = df.withColumn("_v", F.from_json(text, schema))
    none = F.array().cast("array<string>")
    df = df.withColumn("columns", distinct_headers(F.coalesce(F.col("_v")["finalHeaders"], none)))
    df = df.withColumn("_keys", F.transform("columns", norm_key))
    kind = drop_controls(F.col("_v")["finalDocumentType"])
    values = bind("_keys", lambda keys: F.filter(
        F.transform(F.coalesce(F.col("_v")["finalRows"], none), lambda r: _values_by_key(r, keys)),
        lambda vs: F.exists(vs, lambda v: v != ""),
    ))
    return df.withColumns({
        "rows": bind("columns", lambda names: F.transform(values, lambda vs: F.map_from_arrays(names, vs))),
        "confidence": normalize_confidence(F.col("_v")["confidence"]),
        "warnings": _texts(F.col("_v")["warnings"]),
        "corrections": _texts(F.col("_v")["correctionsApplied"]),
        "document_type": F.coalesce(F.nullif(kind, F.lit("")), F.lit("Tabla documental")),
    }).drop("_v", "_keys")


def flatten_layout_tables(df: DataFrame) -> DataFrame:
    """Layout tables (cells as text offsets) to ``Pagina p Tabla n`` and `` | `` lines.

    Input: ``doc_id, text, pages array<struct<page_number, tables array<struct<header_rows,
    body_rows>>>>`` where a row is an array of cells and a cell an array of offset pairs.
    """

    def cell_text(text: Column, cell: Column) -> Column:
        parts = F.transform(
            cell, lambda s: F.substring(text, s["start_index"] + 1, s["end_index"] - s["start_index"])
        )
        return clean_value(F.array_join(parts, ""))

    def row_text(text: Column, row: Column) -> Column:
        return bind(F.transform(row, lambda c: cell_text(text, c)), lambda cells: F.when(
            F.exists(cells, lambda c: c != ""), F.array_join(cells, " | ")))

    def page_lines(text: Column, page: Column) -> Column:
        title = lambda i: F.concat(
            F.lit("Pagina "), page["page_number"].cast("string"), F.lit(" Tabla "), (i + 1).cast("string"))
        return F.flatten(F.transform(page["tables"], lambda t, i: F.concat(
            F.array(title(i)),
            F.array_compact(F.transform(F.concat(t["header_rows"], t["body_rows"]), lambda r: row_text(text, r))),
        )))

    lines = bind("text", lambda text: F.flatten(F.transform("pages", lambda p: page_lines(text, p))))
    return df.select("doc_id", trim_ws(F.array_join(lines, "\n")).alias("tables_text"))
