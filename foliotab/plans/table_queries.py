"""Parsing of recorded answers, table shape, merging and export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import values as X
from ..operators import tables
from ..operators.ordered import first_rows
from ..operators.storage import shared_folder
from ..sources import pages, parsed, sinks
from . import corpora as C
from . import duck as D
from .registry import registry

QUERIES, ORACLES, query = registry()
TURNS = f"({D.fill(C.MULTI_PAGES)})"


def lits(*values):
    return F.array(*[F.lit(v) for v in values])


def joined_rows(rows, per, sep):
    """Text of each run of ``per`` rows, in key order."""
    return rows.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), sep).alias("body"))


def parts(spark, sf, per):
    p = C.table(spark, sf, "part")
    return p.select(F.floor(F.col("p_partkey") / per).alias("doc_id"), (F.col("p_partkey") % per).alias("k"), "*")


# --- CSV -------------------------------------------------------------------

_NAME = """CASE WHEN p_partkey % 5 = 0 THEN '"' || p_name || '", x' ELSE p_name END"""
CSV_ROWS = f"""SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS doc_id, p_partkey % 50 + 1 AS row_idx, CAST(p_partkey AS VARCHAR) AS code, {_NAME} AS name,
 p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS type FROM part"""


def csv_texts(spark, sf):
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('", x'))).otherwise(F.col("p_name"))
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    t = F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")),
                    F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.col("p_type")))
    rows = parts(spark, sf, 50).withColumn("t", t)
    return joined_rows(rows, 50, "\r\n \n").select("doc_id", F.concat(F.lit(chr(0xFEFF) + 'code,"name",brand,type\n'), "body").alias("csv"))


@query("parse_csv_text", CSV_ROWS)
def parse_csv_text(spark, sf):
    t = csv_texts(spark, sf).withColumn("p", parsed.parse_csv_text("csv"))
    rows = parsed.explode_table(t, "p", "doc_id")
    return rows.select("doc_id", "row_idx", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("code", "name", "brand", "type"))])


@query("extract_csv_block", f"SELECT doc_id, count(*) AS lines, CAST(sum(length(code)) AS BIGINT) AS code_chars FROM ({CSV_ROWS}) r GROUP BY 1 UNION ALL SELECT -1 - doc_id, 0, 0 FROM labels")
def extract_csv_block(spark, sf):
    t = csv_texts(spark, sf)
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Claro\n```csv\n"), F.col("csv"), F.lit("\n```\nListo"))).otherwise(
        F.concat(F.lit("Tabla lista\n\n"), F.col("csv"), F.lit("\nFin")))
    t = t.select("doc_id", body.alias("t")).unionByName(C.table(spark, sf, "labels").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("sin tabla\n").alias("t")))
    lines = F.filter(F.split(parsed.extract_csv_block("t"), "\n"), lambda x: x != "")
    codes = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.length(F.split(x, ",")[0]))
    return t.select("doc_id", F.greatest(F.size(lines) - 1, F.lit(0)).alias("lines"),
                    F.aggregate(codes, F.lit(0), lambda a, b: a + b).alias("code_chars"))


@query("parse_csv_like", f"""SELECT doc_id, row_idx, code, name, brand, CASE WHEN row_idx % 9 = 0 THEN concat(type, ', sobra, 2') ELSE type END AS type FROM ({CSV_ROWS}) r WHERE doc_id % 3 <> 1""")
def parse_csv_like(spark, sf):
    rows = parts(spark, sf, 50)
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('", x'))).otherwise(F.col("p_name"))
    t = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')), "p_brand",
                    F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.col("p_type")))
    t = F.when((F.col("k") + 1) % 9 == 0, F.concat(t, F.lit(",sobra,2"))).otherwise(t)
    docs = joined_rows(rows.withColumn("t", t), 50, "\n")
    head = F.when(F.col("doc_id") % 3 == 1, F.lit("Solo texto\n")).otherwise(F.lit("```csv\ncode,name,brand,type\n"))
    docs = docs.select("doc_id", parsed.parse_csv_like(F.concat(head, "body", F.lit("\n```"))).alias("p"))
    rows = parsed.explode_table(docs, "p", "doc_id")
    return rows.select("doc_id", "row_idx", *[F.col("cells")[c].alias(c) for c in ("code", "name", "brand", "type")])


# --- JSON answers ----------------------------------------------------------

VARIANT = """CASE WHEN doc_id % 11 = 10 THEN 'cut' WHEN doc_id % 13 = 12 THEN 'schema' WHEN doc_id % 17 = 16 THEN 'csv' WHEN doc_id % 19 = 18 THEN 'bad'
 WHEN doc_id % 7 = 6 THEN 'arrays' WHEN doc_id % 5 = 4 THEN 'fenced' WHEN doc_id % 23 = 22 THEN 'empty' ELSE 'plain' END"""


def model_outputs(spark, sf):
    cells = [F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.concat(F.col("p_name"), F.lit('  "q"\n{x}')), lits("a", "", "b")]
    obj = F.to_json(F.struct(cells[0].alias("Código"), cells[1].alias("Nombre"), cells[2].alias("Tags"), F.lit(1).alias("Otro")))
    arr = F.concat(F.lit("["), F.to_json(F.array(*cells[:2])).substr(F.lit(2), F.length(F.to_json(F.array(*cells[:2]))) - 2), F.lit(","), F.to_json(cells[2]), F.lit("]"))
    rows = parts(spark, sf, 25).withColumn("v", F.expr(VARIANT))
    rows = rows.withColumn("t", F.when(F.col("v") == "arrays", arr).when(F.col("v") == "csv", F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name")).otherwise(obj))
    docs = rows.groupBy("doc_id", "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("r"))
    whole = F.concat(F.lit('{"mode": "table", "columns": ["Código", " Nombre", "", "Tags"], "rows": ['), F.array_join("r", ", "), F.lit("]}"))
    text = (
        F.when(F.col("v") == "cut", whole.substr(F.lit(1), F.length(whole) - 2)).when(F.col("v") == "schema", '{"columns": "x", "rows": []}')
        .when(F.col("v") == "csv", F.concat(F.lit("Código,Nombre\n"), F.array_join("r", "\n"))).when(F.col("v") == "bad", '{"columns": ["a"], "rows": [}]}')
        .when(F.col("v") == "fenced", F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("v") == "empty", " \n ")
        .otherwise(F.concat(whole, F.lit(" Listo {fin}")))
    )
    return docs.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("doc_id"), text.alias("raw_output"))


MODEL = f"SELECT *, {VARIANT} AS v FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc_id, * FROM part) p"


@query("model_json_status", f"""SELECT 'p' || page_id AS doc_id, 'AI_RESPONSE_HTML_INSTEAD_OF_JSON' AS parse_status, CAST(0 AS BIGINT) AS n_rows FROM pages UNION ALL
 SELECT 'm' || doc_id, CASE v WHEN 'cut' THEN 'AI_RESPONSE_NOT_JSON' WHEN 'schema' THEN 'AI_RESPONSE_SCHEMA_INVALID' WHEN 'csv' THEN 'CSV_LIKE' WHEN 'bad' THEN 'AI_RESPONSE_INVALID_JSON'
  WHEN 'empty' THEN 'AI_RESPONSE_EMPTY' ELSE 'OK' END, CASE WHEN v IN ('cut', 'schema', 'bad', 'empty') THEN 0 ELSE count(*) END FROM ({MODEL}) m GROUP BY doc_id, v""")
def model_json_status(spark, sf):
    html = C.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), F.col("html").alias("raw_output"))
    out = parsed.parse_model_json(html.unionByName(model_outputs(spark, sf)), "raw_output")
    return out.select("doc_id", "parse_status", F.coalesce(F.when(F.col("rows").isNotNull(), F.size("rows")), F.lit(0)).alias("n_rows"))


@query("parse_model_json", f"""SELECT 'm' || doc_id AS doc_id, p_partkey % 25 + 1 AS row_idx, CASE WHEN v = 'csv' THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS code,
 CASE v WHEN 'csv' THEN p_name WHEN 'arrays' THEN p_name || ' "q" {{x}}' ELSE p_name || ' "q" {{x}}' END AS name, CASE v WHEN 'csv' THEN NULL WHEN 'arrays' THEN 'a; b' ELSE 'a; b' END AS tags FROM ({MODEL}) m
 WHERE v NOT IN ('cut', 'schema', 'bad', 'empty')""")
def parse_model_json(spark, sf):
    out = parsed.parse_model_json(model_outputs(spark, sf), "raw_output")
    rows = out.select("doc_id", F.posexplode("rows").alias("p", "c"))
    return rows.select("doc_id", (F.col("p") + 1).alias("row_idx"), *[F.col("c")[k].alias(n) for k, n in (("Código", "code"), ("Nombre", "name"), ("Tags", "tags"))])


def visual_outputs(spark, sf):
    rows = parts(spark, sf, 20).withColumn("t", F.to_json(F.struct(
        F.concat(F.col("p_name"), F.lit("\x01\n ")).alias("nombre "), F.col("p_retailprice").cast("string").alias("Precio"), (F.col("p_size") + 20).alias("confidence"),
        lits("w1", " ", "w2").alias("warnings"), F.when(F.col("k") == 3, F.lit("z")).alias("Núevo"))))
    docs = joined_rows(rows, 20, ",")
    return docs.select("doc_id", F.concat(F.lit('{"success": true, "columns": ["Nombre", "Confidence", "PRECIO", "nombre"], "confidence": "0,8", "warnings": ["a", ""], "rows": ['),
                                          "body", F.lit(', {"x": ""}, [1]]}')).alias("raw_output"))


@query("parse_visual_json", """SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, p_partkey % 20 + 1 AS row_idx, p_name AS name, CAST(p_retailprice AS VARCHAR) AS price,
 CASE WHEN p_partkey % 20 = 3 THEN 'z' WHEN max(p_partkey % 20) OVER (PARTITION BY floor(p_partkey / 20)) >= 3 THEN '' END AS fresh, (p_size + 20) / 100 AS confidence, 'w1; w2' AS warnings, 0.8::DOUBLE AS doc_confidence,
 CASE WHEN max(p_partkey % 20) OVER (PARTITION BY floor(p_partkey / 20)) >= 3 THEN 'Nombre|PRECIO|Núevo|x' ELSE 'Nombre|PRECIO|x' END AS columns FROM part""")
def parse_visual_json(spark, sf):
    out = parsed.parse_visual_json(visual_outputs(spark, sf), "raw_output")
    rows = out.select("doc_id", F.col("confidence").alias("doc_confidence"), F.array_join("columns", "|").alias("columns"), F.posexplode("rows").alias("p", "r"))
    return rows.select(
        "doc_id", (F.col("p") + 1).alias("row_idx"), F.col("r.cells")["Nombre"].alias("name"), F.col("r.cells")["PRECIO"].alias("price"),
        F.col("r.cells")["Núevo"].alias("fresh"), "r.confidence", "r.warnings", "doc_confidence", "columns")


def reviewed_outputs(spark, sf):
    rows = parts(spark, sf, 20).withColumn("t", F.to_json(F.struct(F.col("p_name").alias("NOMBRE"), F.col("p_brand").alias("marca"))))
    return joined_rows(rows, 20, ",").select("doc_id", F.concat(
        F.lit('{"finalHeaders": ["Nombre", "Marca", "márca", ""], "finalRows": [{"otra": 1},'), "body", F.lit('], "confidence": '),
        (F.col("doc_id") % 100).cast("string"), F.lit(', "warnings": ["w"], "correctionsApplied": []}')).alias("raw_output"))


@query("parse_reviewed_table", """SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, p_partkey % 20 + 1 AS row_idx, p_name AS name, p_brand AS brand, 'Nombre|Marca' AS columns,
 CASE WHEN floor(p_partkey / 20) % 100 > 1 THEN floor(p_partkey / 20) % 100 / 100 ELSE floor(p_partkey / 20) % 100 END AS confidence, 'Tabla documental' AS document_type FROM part""")
def parse_reviewed_table(spark, sf):
    out = parsed.parse_reviewed_table(reviewed_outputs(spark, sf), "raw_output")
    rows = out.select("doc_id", "confidence", "document_type", F.array_join("columns", "|").alias("columns"), F.posexplode("rows").alias("p", "c"))
    return rows.select("doc_id", (F.col("p") + 1).alias("row_idx"), F.col("c")["Nombre"].alias("name"), F.col("c")["Marca"].alias("brand"), "columns", "confidence", "document_type")


@query("flatten_layout_tables", """SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc_id, 'Pagina 3 Tabla 1' || chr(10) || 'Nombre | Marca' || chr(10) || string_agg(p_name || ' | ' || p_brand, chr(10) ORDER BY p_partkey) AS tables_text FROM part GROUP BY 1""")
def flatten_layout_tables(spark, sf):
    rows = parts(spark, sf, 25).withColumn("t", F.concat(F.rpad("p_name", 24, " "), F.rpad("p_brand", 12, "\n")))
    docs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("body"), F.count("*").alias("n"))
    seg = lambda a, b: F.struct(a.cast("int").alias("start_index"), b.cast("int").alias("end_index"))
    row = lambda i: F.array(F.array(seg(i * 36, i * 36 + 24)), F.array(seg(i * 36 + 24, i * 36 + 28), seg(i * 36 + 28, i * 36 + 36)))
    blank = F.array(F.array(seg(F.lit(20), F.lit(22))))
    table = F.struct(F.array(row(F.lit(0))).alias("header_rows"), F.concat(F.array(blank), F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), row)).alias("body_rows"))
    page = F.struct(F.lit(3).alias("page_number"), F.array(table).alias("tables"))
    text = F.concat(F.rpad(F.lit("Nombre"), 24, " "), F.rpad(F.lit("Marca"), 12, " "), "body")
    return parsed.flatten_layout_tables(docs.select("doc_id", text.alias("text"), F.array(page).alias("pages")))


# --- headers ---------------------------------------------------------------

HEADERS = """SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS doc_id, 0 AS candidate, CAST(c_custkey % 8 AS INT) + 1 AS col_idx,
 CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Código' WHEN 2 THEN 'codigo' WHEN 3 THEN c_mktsegment ELSE concat(' Código', chr(10)) END AS name FROM {customer}"""
_H = f"({D.fill(HEADERS)})"


@query("dedupe_headers", f"""SELECT doc_id, col_idx::BIGINT AS col_idx, CASE WHEN r = 1 THEN n ELSE concat(n, '_', r) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY col_idx) AS r FROM
 (SELECT *, CASE WHEN trim(name) = '' THEN concat('Columna_', col_idx) ELSE trim(name, ' ' || chr(10)) END AS n FROM {_H} h) x) y""")
def dedupe_headers(spark, sf):
    return tables.dedupe_headers(C.sql(spark, sf, HEADERS)).select("doc_id", "col_idx", "name")


@query("distinct_headers", f"""SELECT doc_id, min(col_idx)::BIGINT AS col_idx, arg_min(trim(name, ' ' || chr(10)), col_idx) AS name FROM {_H} h WHERE trim(name) <> '' GROUP BY doc_id, {D.key("name")}""")
def distinct_headers(spark, sf):
    from ..functions.text import clean_value

    return tables.distinct_headers(C.sql(spark, sf, HEADERS)).select("doc_id", "col_idx", clean_value("name").alias("name"))


HEADS = ["Página|Línea|Texto", "Campo|Valor", "FechaSalida|Tons|Extra|pagina", "N° Documento|Número Documento|CUIT Emisor|Peso neto|Patente X|Importe|Fecha"]


def heads(spark, sf):
    pick = F.element_at(lits(*HEADS), (F.col("c_custkey") % 4 + 1).cast("int"))
    return C.table(spark, sf, "customer").select("c_custkey", F.split(pick, r"\|").alias("columns"), "c_name")


def by4(*values):
    return "CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("header_checks", f"""SELECT c_custkey, {by4("true", "false", "false", "false")} AS generic_lines, {by4("false", "true", "false", "false")} AS field_value,
 {by4("9", "9", "9", "9")}::BIGINT + {by4("2", "2", "0", "2")} AS n_missing, {by4("3", "2", "2", "7")}::BIGINT AS n_extra, {by4("''", "''", "'FechaSalida;Tons'", "''")} AS matched,
 {by4("0", "0", "0", "6")}::BIGINT AS commercial_columns, {by4("0", "0", "2", "0")}::BIGINT AS movement_columns, {by4("''", "''", "'FechaSalida'", "''")} AS unsupported FROM customer""")
def header_checks(spark, sf):
    h, want = heads(spark, sf), lits(*V.MOVEMENT_COLUMNS)
    columns = F.col("columns")
    return h.select(
        "c_custkey", tables.generic_line_schema("columns").alias("generic_lines"), tables.field_value_output("columns").alias("field_value"),
        F.size(tables.missing_columns(want, columns)).alias("n_missing"), F.size(tables.extra_columns(want, columns)).alias("n_extra"),
        F.array_join(tables.header_intersect(columns, want), ";").alias("matched"), X.commercial_column_count("columns").alias("commercial_columns"),
        X.movement_column_count("columns").alias("movement_columns"),
        F.array_join(tables.unsupported_columns("columns", F.concat(F.lit("fecha: tons "), F.col("c_name"))), ";").alias("unsupported"))


@query("merge_warnings", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a;b;c' ELSE 'a;b;a2;c' END AS merged, 'a;b' AS capped FROM customer""")
def merge_warnings(spark, sf):
    left = F.when(F.col("c_custkey") % 2 == 0, lits("a", "b")).otherwise(lits("a", "b", "a2", "b"))
    merged = tables.merge_warnings(left, F.lit(None).cast("array<string>"), lits("b", "c"))
    return C.table(spark, sf, "customer").select("c_custkey", F.array_join(merged, ";").alias("merged"), F.array_join(tables.cap_warnings(merged, 2), ";").alias("capped"))


# --- rows ------------------------------------------------------------------


def line_rows(spark, sf):
    lines = pages.explode_lines(C.sql(spark, sf, C.SINGLE_PAGES))
    return lines.select("doc_id", F.lit(0).alias("candidate"), F.col("line_no").alias("row_idx"), F.create_map(F.lit("Texto"), "line").alias("cells"))


LINES = f"(SELECT doc_id, CAST(i AS BIGINT) AS row_idx, l[i] AS line FROM (SELECT doc_id, {D.lines('text')} AS l FROM documents) d, unnest(generate_series(1, len(l))) g(i))"


@query("dedupe_first", f"SELECT doc_id, min(row_idx) AS row_idx, line FROM {LINES} l GROUP BY doc_id, line")
def dedupe_first(spark, sf):
    rows = tables.dedupe_first(line_rows(spark, sf), F.col("cells")["Texto"])
    return rows.select("doc_id", "row_idx", F.col("cells")["Texto"].alias("line"))


@query("row_numbers", f"SELECT doc_id, row_idx, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS row_number FROM {LINES} l WHERE line LIKE '%a%'")
def row_numbers(spark, sf):
    kept = line_rows(spark, sf).where(F.col("cells")["Texto"].contains("a"))
    return tables.renumber_rows(kept, rows_per_block=16).select("doc_id", "row_idx", "row_number")


@query("preview", f"""SELECT l.doc_id, row_idx, line AS first_value, CAST(greatest(n - 5, 0) AS BIGINT) AS hidden_rows, CAST(0 AS BIGINT) AS hidden_columns FROM {LINES} l JOIN (SELECT doc_id, count(*) AS n FROM {LINES} z GROUP BY 1) c USING (doc_id) WHERE row_idx <= 5""")
def preview(spark, sf):
    out = tables.preview(line_rows(spark, sf).withColumn("columns", lits("Texto")))
    return out.select("doc_id", "row_idx", F.col("values")[0].alias("first_value"), "hidden_rows", "hidden_columns")


@query("export_column_widths", f"SELECT doc_id, 'Texto' AS name, CAST(least(greatest(max(length(line)) + 2, 12), 42) AS BIGINT) AS width FROM {LINES} l GROUP BY 1")
def export_column_widths(spark, sf):
    return tables.export_column_widths(line_rows(spark, sf))


@query("result_stats", f"""SELECT d.doc_id, coalesce(n, 0) AS rows, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS BIGINT) AS fields, CAST(1 AS BIGINT) AS pages, length(text) AS text_length
 FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {LINES} l GROUP BY 1) c USING (doc_id)""")
def result_stats(spark, sf):
    return tables.result_stats(line_rows(spark, sf), C.sql(spark, sf, C.SINGLE_PAGES))


@query("drop_empty_rows", "SELECT event_id FROM events WHERE event_id % 4 <> 1")
def drop_empty_rows(spark, sf):
    value = F.when(F.col("event_id") % 4 == 1, F.lit(" \n\t")).otherwise(F.col("event_type"))
    e = C.table(spark, sf, "events").select("event_id", F.create_map(F.lit("a"), F.lit(""), F.lit("b"), value).alias("cells"))
    return tables.drop_empty_rows(e).select("event_id")


@query("coerce_rows", "SELECT event_id, event_type AS a, '' AS b, CAST(user_id AS VARCHAR) AS c FROM events")
def coerce_rows(spark, sf):
    e = C.table(spark, sf, "events")
    columns = lits("a", "b", "c")
    by_name = tables.coerce_cells(columns, F.create_map(F.lit("c"), F.concat(F.col("user_id").cast("string"), F.lit("\r\n")), F.lit("a"), "event_type", F.lit("z"), F.lit("x")))
    by_place = tables.coerce_list(columns, F.array(F.col("event_type"), F.lit(None), F.col("user_id").cast("string"), F.lit("extra")))
    cells = F.when(F.col("event_id") % 2 == 0, by_name).otherwise(by_place)
    return e.select("event_id", *[cells[c].alias(c) for c in ("a", "b", "c")])


def movement_rows(spark, sf):
    o, k = C.table(spark, sf, "orders"), F.col("o_orderkey")
    date = F.when(k % 10 == 9, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    values = {
        "Fecha de Salida FechaSalida": F.when(k % 6 == 1, F.lit("Fecha Salida")).when(k % 6 == 2, F.lit("")).otherwise(date),
        "tons": F.when(k % 6 == 1, F.lit("TONS")).when(k % 6 == 2, F.lit(" ")).otherwise(F.col("o_totalprice").cast("string")),
        "Proveedor": F.when(k % 6 == 1, F.lit("proveedor")).when(k % 6 == 2, F.lit("")).when(k % 6 == 3, F.lit("Folio 7")).when(k % 6 == 4, F.lit("ÃÂÃÂÃÂÃÂ")).otherwise(F.col("o_orderpriority")),
        "Origen": F.when(k % 6 == 1, F.lit("ORIGEN")).when(k % 6 == 2, F.lit("")).otherwise(F.lit("Salta")),
        "Destino": F.when(k % 6 == 1, F.lit("Destino")).when(k % 6 == 2, F.lit("")).otherwise(F.lit("Puna")),
        "confidence": F.lit("0.9"),
    }
    cells = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])
    return o.select(F.floor(k / 40).alias("doc_id"), F.lit(0).alias("candidate"), k.alias("row_idx"), lits(*values).alias("columns"), cells.alias("cells"))


_ODATE = "CASE WHEN o_orderkey % 10 = 9 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END"


@query("project_to_profile", f"""SELECT o_orderkey AS row_idx, CASE o_orderkey % 6 WHEN 1 THEN 'Fecha Salida' WHEN 2 THEN '' ELSE {_ODATE} END AS FechaSalida,
 CASE o_orderkey % 6 WHEN 1 THEN 'ORIGEN' WHEN 2 THEN '' ELSE 'Salta' END AS Origen, '' AS Producto, '0.9' AS confidence, CAST(o_orderkey AS VARCHAR) AS row_number, '' AS page_number FROM orders""")
def project_to_profile(spark, sf):
    p = tables.project_to_profile(movement_rows(spark, sf), V.MOVEMENT_COLUMNS)
    return p.select("row_idx", *[F.col("cells")[c].alias(c) for c in ("FechaSalida", "Origen", "Producto")], "confidence", "row_number", "page_number")


@query("filter_movement_rows", "SELECT o_orderkey AS row_idx FROM orders WHERE o_orderkey % 6 IN (0, 5)")
def filter_movement_rows(spark, sf):
    p = tables.project_to_profile(movement_rows(spark, sf), V.MOVEMENT_COLUMNS)
    return tables.filter_movement_rows(p).select("row_idx")


@query("commercial_projection", """SELECT o_orderkey AS row_idx, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS NumeroDocumento, strftime(o_orderdate, '%Y-%m-%d') AS FechaEmision, o_orderpriority AS Producto,
 CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE '8' END AS Peso, 'AB' AS PatenteChasis, '' AS Receptor, CAST(34 AS BIGINT) AS n_columns FROM orders WHERE o_orderkey % 3 <> 0""")
def commercial_projection(spark, sf):
    o, k = C.table(spark, sf, "orders"), F.col("o_orderkey")
    values = {"N° Documento": F.lpad(k.cast("string"), 9, "0"), "FECHA": F.date_format("o_orderdate", "yyyy-MM-dd"), "CUIT Emisor": F.lit("20-1"), "Importe": F.lit("1"),
              "Producto/Uso": F.col("o_orderpriority"), "Peso": F.when(k % 2 == 0, F.lit(" 7")).otherwise(""), "Peso total": F.lit("8"), "Patente": F.lit("AB")}
    names = F.when(k % 3 == 0, lits("N° Documento", "FECHA", "Importe")).otherwise(lits(*values))
    rows = o.select(k.alias("row_idx"), names.alias("columns"), F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]).alias("cells"))
    out = tables.commercial_projection(rows)
    return out.select("row_idx", *[F.col("cells")[c].alias(c) for c in ("NumeroDocumento", "FechaEmision", "Producto", "Peso", "PatenteChasis", "Receptor")], F.size("cells").alias("n_columns"))


# --- merging ---------------------------------------------------------------


def chunk_outputs(spark, sf):
    c = C.table(spark, sf, "conversations")
    mixed = F.when(F.col("turn") % 2 == 0, lits("Título", "Descripción")).otherwise(lits("Título", "Otro"))
    columns = F.when(F.col("conv_id") % 3 == 0, lits("A", "B")).when(F.col("conv_id") % 3 == 1, mixed).otherwise(lits(*V.CHUNK_COLUMNS))
    n = F.length("text").cast("string")
    odd = (F.col("conv_id") % 3 == 1) & (F.col("turn") % 2 == 1)
    row = F.when(odd, F.create_map(F.lit("Título"), "role", F.lit("Otro"), F.lit("x"))).otherwise(
        F.create_map(F.lit("A"), "role", F.lit("B"), n, F.lit("Título"), "role", F.lit("Descripción"), n))
    twin = F.create_map(F.lit("A"), "role", F.lit("B"), F.lit(""), F.lit("Título"), "role")
    data = c.where("turn < 4").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), columns.alias("columns"), F.array(row, twin, twin).alias("rows"))
    errors = c.where("turn >= 4").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), (F.col("turn") + 1).cast("string").alias("page_range"), F.lit("sin respuesta").alias("message"))
    return data, errors


_MERGED = """SELECT doc_id, part, title, description, page, min(ord) AS o FROM (SELECT c.conv_id AS doc_id, 0 AS part, turn * 10 + j AS ord, role AS title, '' AS page,
  CASE WHEN j > 0 THEN '' WHEN kept OR c.conv_id % 3 = 2 OR turn % 2 = 0 THEN CASE WHEN kept AND c.conv_id % 3 = 1 AND turn % 2 = 1 THEN 'x' ELSE CAST(length(text) AS VARCHAR) END ELSE '' END AS description
  FROM conversations c JOIN (SELECT conv_id, conv_id % 3 = 0 OR (conv_id % 3 = 1 AND count(DISTINCT turn % 2) = 1) AS kept FROM conversations WHERE turn < 4 GROUP BY 1) k USING (conv_id), (VALUES (0), (1), (2)) v(j) WHERE turn < 4
 UNION ALL SELECT c.conv_id, 1, 1000 + turn, 'Chunk no procesado', CAST(turn + 1 AS VARCHAR), 'sin respuesta' FROM conversations c JOIN (SELECT conv_id, conv_id % 3 = 0 OR (conv_id % 3 = 1 AND count(DISTINCT turn % 2) = 1) AS kept FROM conversations WHERE turn < 4 GROUP BY 1) k USING (conv_id) WHERE turn >= 4 AND NOT kept) q GROUP BY 1, 2, 3, 4, 5"""


@query("merge_chunks", f"SELECT doc_id, part::BIGINT AS part, title, description, page FROM ({_MERGED}) m")
def merge_chunks(spark, sf):
    data, errors = chunk_outputs(spark, sf)
    m = tables.merge_chunks(data, errors)
    c = F.col("cells")
    return m.select("doc_id", "part", F.coalesce(c["A"], c["Título"]).alias("title"), F.coalesce(c["B"], c["Descripción"], c["Otro"]).alias("description"), F.coalesce(c["Página"], F.lit("")).alias("page"))


@query("union_outputs", "SELECT doc_id, role, min(turn)::BIGINT AS first_turn FROM (SELECT conv_id AS doc_id, role, turn FROM conversations) c GROUP BY 1, 2")
def union_outputs(spark, sf):
    c = C.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "role", F.col("turn").alias("row_idx"))
    both = c.where("turn % 2 = 0").unionByName(c.where("turn % 2 = 1"))
    return first_rows(both, ["doc_id", "role"], ["row_idx"]).select("doc_id", "role", F.col("row_idx").alias("first_turn"))


@query("merge_page_outputs", """WITH o AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS doc_id, o_orderkey % 6 AS k, CAST(o_totalprice AS VARCHAR) AS price FROM orders)
 SELECT doc_id, price, 'ok' AS status FROM o WHERE k IN (0, 5) AND doc_id % 7 <> 3
 UNION ALL SELECT DISTINCT doc_id, NULL, 'PROFILE_NO_VALID_ROWS' FROM o WHERE doc_id % 7 = 3 OR doc_id NOT IN (SELECT doc_id FROM o WHERE k IN (0, 5))""")
def merge_page_outputs(spark, sf):
    from ..operators.quality import merge_page_outputs as op

    m = movement_rows(spark, sf)
    outputs = m.select("doc_id", (F.col("row_idx") % 40 + 1).alias("page_number"), "columns", F.array("cells", "cells").alias("rows"))
    counts = m.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    return op(outputs.where("doc_id % 7 <> 3"), counts).select("doc_id", F.col("cells")["Tons"].alias("price"), "status")


# --- export ----------------------------------------------------------------


@query("write_csv", """SELECT p_partkey, concat('"', p_partkey, '","', replace(p_name, 'e', '""'), '","', p_brand, ' x",""') AS line FROM part""")
def write_csv(spark, sf):
    cells = F.array(F.col("p_partkey").cast("string"), F.replace("p_name", F.lit("e"), F.lit('"')), F.concat("p_brand", F.lit("\r\nx")), F.lit(None))
    return C.table(spark, sf, "part").select("p_partkey", sinks.csv_line(cells).alias("line"))


@query("write_json", """SELECT doc_id, '{"metadata":{"kind":"LISTADO","records":' || count(*) || '},"columns":["code","name"],"rows":[' ||
 string_agg('{"code":"' || p_partkey || '","name":"' || p_name || '"}', ',' ORDER BY p_partkey) || ']}' AS value FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc_id, * FROM part) p WHERE doc_id % 6 <> 5 GROUP BY 1""")
def write_json(spark, sf):
    rows = parts(spark, sf, 25).groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name")))),
                    lambda x: F.create_map(F.lit("code"), x["code"], F.lit("name"), x["name"])).alias("rows"), F.count("*").alias("n"))
    names = lits("Demo", "Piloto", "Basico", "Profesional", "Empresa", "Sin plan")
    docs = rows.select("doc_id", "rows", lits("code", "name").alias("columns"), F.struct(F.lit("LISTADO").alias("kind"), F.col("n").alias("records")).alias("metadata"),
                       F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("plan_name"))
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    sinks.write_json(docs, C.plan_dimension(spark), path)
    return spark.read.schema("doc_id bigint, value string").json(path)
