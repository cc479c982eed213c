"""Quality, acceptance, choice of results and output kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import values as X
from ..operators import chunks, people, quality
from . import corpora as C
from . import duck as D
from .registry import registry
from .table_queries import lits, parts

QUERIES, ORACLES, query = registry()

SCHEMAS = [
    V.LINE_COLUMNS, ["Uno"], V.COMMERCIAL_COLUMNS[:12], V.COMMERCIAL_COLUMNS[:8], V.MOVEMENT_COLUMNS,
    ["Nombre", "Marca", "Tipo"], V.SECTION_COLUMNS, ["A", "B", "C", "D"],
]
PROFILE_OF = ["internal-general", "internal-general", "internal-dtve-senasa-arca", "internal-comprobante-generico", "internal-movimiento-camiones",
              "internal-tabla-administrativa", "internal-documento-tecnico-administrativo", "internal-general"]


def pick(values, by, n=None):
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (by % (n or len(values)) + 1).cast("int"))


def plain_tables(spark, sf):
    """Tables of twelve rows on eight schemas; only the first ``doc_id % 13`` rows hold data."""
    p = parts(spark, sf, 12)
    columns = pick([lits(*s) for s in SCHEMAS], F.col("doc_id"))
    value = F.when(F.col("k") < F.col("doc_id") % 13, F.col("p_name")).otherwise(F.lit(" "))
    cells = F.map_from_arrays(columns, F.transform(columns, lambda c, i: F.when(i == 0, value).otherwise(F.lit(""))))
    rows = p.select("doc_id", F.lit("t").alias("candidate"), F.col("k").alias("row_idx"), cells.alias("cells"))
    heads = p.select("doc_id").distinct().select(
        "doc_id", F.lit("t").alias("candidate"), columns.alias("columns"), pick(PROFILE_OF, F.col("doc_id")).alias("profile_id"),
        F.when(F.col("doc_id") % 8 == 5, F.lit("table")).otherwise(F.lit("auto")).alias("document_type"))
    return rows, heads


TABLES = """SELECT doc_id, doc_id % 8 AS s, count(*) FILTER (k < doc_id % 13) AS n, count(*) AS n_rows FROM (SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS doc_id, p_partkey % 12 AS k FROM part) p GROUP BY 1"""
_RULES = """CASE WHEN s = 0 THEN 'low|Generic PDF text fallback columns detected' WHEN s = 1 OR n = 0 THEN 'low|Too few columns or rows'
 WHEN s = 2 THEN 'high|Single-row commercial operations document with useful schema' WHEN s = 3 THEN 'medium|Commercial operations document has usable fields'
 WHEN s = 4 THEN 'high|Logistics movement table profile with expected schema' WHEN s = 5 AND n < 3 THEN 'low|Table/list extraction requires multiple rows'
 WHEN s = 6 AND n > 10 THEN 'high|Technical-administrative document columns detected with enough rows' WHEN s IN (6, 7) AND n > 3 THEN 'high|Structured result has enough useful columns and rows'
 WHEN n >= 2 THEN 'medium|Structured result has usable columns and rows' ELSE 'low|Result is too generic to be useful' END"""
SCORED = f"SELECT *, split_part(q, '|', 1) AS level, split_part(q, '|', 2) AS why FROM (SELECT *, {_RULES} AS q FROM ({TABLES}) t) x"


@query("extraction_quality", f"SELECT doc_id, n AS n_filled, level AS quality, why AS quality_reason FROM ({SCORED}) q")
def extraction_quality(spark, sf):
    rows, heads = plain_tables(spark, sf)
    return quality.extraction_quality(rows, heads).select("doc_id", "n_filled", "quality", "quality_reason")


def gate_columns(df):
    return df.select("doc_id", "candidate", "acceptable", "confidence", "quality_status", "reason", "requires_manual_review", "should_fallback", F.size("warnings").alias("n_warnings"))


_CONF = """CASE doc_id % 3 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE CASE WHEN doc_id % 4 = 3 THEN 0.68 WHEN level = 'high' THEN 0.9 WHEN level = 'medium' OR (s = 5 AND n = 2) THEN 0.78 ELSE 0.5 END END"""
_GATE = f"""SELECT *, CASE WHEN s = 4 AND n > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 6 = 5 THEN 1 ELSE 0 END AS w, CAST({_CONF} AS DOUBLE) AS c FROM ({SCORED}) z"""
_OUT = """CASE WHEN s = 4 AND n = 0 THEN 'F|0|No valid movement rows were extracted' WHEN s = 4 AND c < 0.75 THEN 'F|c|' || printf('Confidence %.2f below minimum 0.75', c)
 WHEN s = 4 THEN 'D|c|Profile quality gate passed' WHEN doc_id % 5 = 4 AND level <> 'low' THEN 'A|m|Structured table recovered from document text/layout'
 WHEN c < 0.75 THEN 'F|c|' || printf('Confidence %.2f below minimum 0.75', c) WHEN level = 'low' THEN 'F|c|' || why ELSE 'P|c|' || why END"""


@query("quality_gate", f"""SELECT doc_id, 't' AS candidate, o[1] <> 'F' AS acceptable, CASE o[3] WHEN '0' THEN 0.0 WHEN 'm' THEN greatest(c, 0.65) ELSE c END AS confidence,
 CASE o[1] WHEN 'F' THEN 'fallback_required' WHEN 'A' THEN 'accepted_with_warnings' WHEN 'D' THEN CASE WHEN w > 0 THEN 'completed_with_warnings' ELSE 'completed' END
  ELSE CASE WHEN w > 0 OR doc_id % 4 = 3 THEN 'completed_with_warnings' ELSE 'completed' END END AS quality_status, o[5:] AS reason, false AS requires_manual_review, o[1] = 'F' AS should_fallback, CAST(w AS BIGINT) AS n_warnings
 FROM (SELECT *, {_OUT} AS o FROM ({_GATE}) g) h""")
def quality_gate(spark, sf):
    rows, heads = plain_tables(spark, sf)
    d = F.col("doc_id")
    heads = heads.drop("document_type").withColumns({
        "provider_confidence": F.when(d % 3 == 1, F.lit(0.9)).when(d % 3 == 2, F.lit(0.6)),
        "result_quality": F.when(d % 4 == 3, "partial").otherwise("ai"),
        "quality_status_in": F.when(d % 5 == 4, "accepted_with_warnings"),
        "warnings_in": F.when(d % 6 == 5, lits("w")).otherwise(F.array().cast("array<string>")),
        "scanned_text_warning": F.lit(False),
    })
    return gate_columns(quality.quality_gate(rows, heads))


def person_tables(spark, sf):
    """Roster and company candidates of the same people, some incomplete."""
    p = C.sql(spark, sf, C.PEOPLE)
    k, d = F.col("p_partkey"), F.col("doc_id")
    prov = F.when(k % 4 == 0, "").otherwise(F.col("province"))
    name = F.when((k % 3 == 0) & (d % 5 == 4), "Ana").otherwise(F.col("p_name"))
    m = lambda pairs: F.create_map(*[x for n, v in pairs for x in (F.lit(n), v if not isinstance(v, str) else F.lit(v))])
    roster = m([("Numero", k.cast("string")), ("NombreApellido", name), ("CUIL", F.when(d % 5 == 3, "1").otherwise(F.col("cuil"))),
                ("LugarTrabajo", "x"), ("Localidad", F.col("locality")), ("Provincia", prov)])
    company = m([("Empresa", "Sur S.A."), ("CUIT", "30-12345678-1"), ("NombreApellido", name), ("DNI", (k + 20000000).cast("string")), ("Provincia", prov), ("Localidad", F.col("locality"))])
    rows = p.select("doc_id", F.lit("roster").alias("candidate"), F.col("k").alias("row_idx"), roster.alias("cells")).unionByName(
        p.select("doc_id", F.lit("company").alias("candidate"), F.col("k").alias("row_idx"), company.alias("cells")))
    docs = p.select("doc_id").distinct()
    less = lambda names: F.when(d % 5 == 1, lits(*names[:-1])).when(d % 5 == 2, lits(*names, *V.LINE_COLUMNS)).otherwise(lits(*names))
    heads = docs.select("doc_id", F.lit("roster").alias("candidate"), less(V.ROSTER_COLUMNS).alias("columns"), F.lit("internal-nomina-personal").alias("profile_id")).unionByName(
        docs.select("doc_id", F.lit("company").alias("candidate"), less(V.COMPANY_COLUMNS).alias("columns"), F.lit("internal-personal-empresa-localidad").alias("profile_id")))
    none = F.array().cast("array<string>")
    return rows, heads.withColumns({
        "provider_confidence": F.lit(None).cast("double"), "result_quality": F.lit("ai"), "quality_status_in": F.lit(None).cast("string"),
        "warnings_in": none, "scanned_text_warning": F.lit(False)})


_PEOPLE = f"({D.fill(C.PEOPLE)})"
_FACTS = f"""SELECT doc_id, doc_id % 5 AS v, count(*) AS n, count(*) FILTER (p_partkey % 4 <> 0) AS prov, count(*) FILTER (NOT (p_partkey % 3 = 0 AND doc_id % 5 = 4)) AS named,
 count(*) FILTER (p_partkey % 4 <> 0 AND NOT (p_partkey % 3 = 0 AND doc_id % 5 = 4) AND doc_id % 5 <> 3) AS rv FROM {_PEOPLE} p GROUP BY 1"""
_PG = f"""SELECT *, floor(CAST(rv AS DOUBLE) / n * 100 + 0.5) / 100 AS rs, floor((named / n * 0.7::DOUBLE + prov / n * 0.15::DOUBLE + n / n * 0.15::DOUBLE) * 100 + 0.5) / 100 AS cs FROM ({_FACTS}) f"""
_PO = """CASE WHEN v = 2 AND r THEN 'FGeneric Pagina/Linea/Texto output is not valid for personnel rosters' WHEN v = 2 THEN 'FGeneric Pagina/Linea/Texto output is not valid for company personnel lists'
 WHEN v = 1 AND r THEN 'FPersonnel roster columns missing: Provincia' WHEN v = 1 THEN 'FCompany personnel columns missing: Localidad' WHEN r AND v = 3 THEN 'FNo personnel rows with a valid CUIL anchor were extracted'
 WHEN r AND rs < 0.65 THEN 'F' || printf('Personnel roster row quality %.2f below minimum 0.65', rs) WHEN NOT r AND named / n < 0.6 THEN 'F' || printf('Company personnel pattern quality %.2f did not meet its profile gate', cs)
 WHEN r THEN 'PPersonnel roster quality gate passed' ELSE 'PCompany personnel pattern quality gate passed' END"""


@query("quality_gate_personnel", f"""SELECT doc_id, CASE WHEN r THEN 'roster' ELSE 'company' END AS candidate, o[1] = 'P' AS acceptable, CASE WHEN r AND o LIKE 'FNo pers%' THEN 0.0 WHEN r THEN rs ELSE cs END AS confidence,
 CASE WHEN o[1] = 'F' THEN 'fallback_required' WHEN prov < n THEN 'completed_with_warnings' ELSE 'completed' END AS quality_status, o[2:] AS reason, false AS requires_manual_review, o[1] = 'F' AS should_fallback,
 CAST(CASE WHEN o[1] = 'P' AND prov < n THEN 1 ELSE 0 END AS BIGINT) AS n_warnings FROM (SELECT *, {_PO} AS o FROM ({_PG}) g, (VALUES (true), (false)) c(r)) h""")
def quality_gate_personnel(spark, sf):
    return gate_columns(quality.quality_gate(*person_tables(spark, sf)))


@query("movement_validation", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'PROFILE_REJECTED_GENERIC_LINE_CSV' WHEN 1 THEN 'PROFILE_MISSING_COLUMNS: CantidadEscoltas' WHEN 2 THEN 'PROFILE_NO_VALID_ROWS'
 WHEN 3 THEN 'PROFILE_INCLUDED_IGNORED_TEXT' WHEN 4 THEN 'PROFILE_CORRUPTED_TEXT_DOMINANT' ELSE 'ok' END AS validation FROM (SELECT DISTINCT CAST(floor(o_orderkey / 40) AS BIGINT) AS doc_id FROM orders) o""")
def movement_validation(spark, sf):
    o = C.table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 40).alias("doc_id"), F.col("o_orderkey").alias("row_idx"), "o_orderpriority")
    d = F.col("doc_id")
    value = pick([F.col("o_orderpriority"), F.col("o_orderpriority"), F.lit(" "), F.concat("o_orderpriority", F.lit(" FOLIO")), F.lit("Ã Ã Ã"), F.col("o_orderpriority")], d)
    rows = o.select("doc_id", F.lit("m").alias("candidate"), "row_idx", F.create_map(F.lit("Proveedor"), value, F.lit("Unidad"), F.lit("")).alias("cells"))
    columns = F.when(d % 6 == 0, lits(*V.MOVEMENT_COLUMNS, *V.LINE_COLUMNS)).when(d % 6 == 1, lits(*V.MOVEMENT_COLUMNS[:-1])).otherwise(lits(*V.MOVEMENT_COLUMNS))
    heads = o.select("doc_id").distinct().select("doc_id", F.lit("m").alias("candidate"), columns.alias("columns"))
    return quality.movement_validation(rows, heads).select("doc_id", "validation")


@query("reviewed_table_gate", """SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN n >= 5 WHEN 5 THEN true ELSE false END AS acceptable, CASE doc_id % 6 WHEN 0 THEN 'Fewer than two real headers' WHEN 1 THEN 'Generic page-line-text output'
 WHEN 2 THEN 'No populated rows' WHEN 3 THEN 'Reviewer confidence below 0.65' WHEN 4 THEN CASE WHEN n >= 5 THEN 'Supplier table reconstructed from document text/layout' ELSE 'Reviewer confidence below 0.65' END ELSE 'Reviewed document headers and rows' END AS reason
 FROM (SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS doc_id, count(*) AS n FROM part GROUP BY 1) p""")
def reviewed_table_gate(spark, sf):
    p, d = parts(spark, sf, 6), F.col("doc_id")
    rows = p.select("doc_id", F.lit("r").alias("candidate"), F.col("k").alias("row_idx"), F.create_map(F.lit("Proveedor"), F.when(d % 6 == 2, "").otherwise(F.col("p_name"))).alias("cells"))
    columns = pick([lits("Proveedor"), lits("Proveedor", *V.LINE_COLUMNS), lits("Proveedor", "B"), lits(*V.SUPPLIER_COLUMNS), lits(*V.SUPPLIER_COLUMNS), lits("Proveedor", "B")], d)
    heads = p.select("doc_id").distinct().select("doc_id", F.lit("r").alias("candidate"), columns.alias("columns"), (d % 6 == 3).alias("visual_pages"),
                                                 F.when(d % 6 == 5, 0.65).otherwise(0.41).alias("confidence"))
    return quality.reviewed_table_gate(rows, heads).select("doc_id", "acceptable", "reason")


def attempts(spark, sf):
    e = C.table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("doc_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("candidate"), F.col("event_id").alias("priority"),
        ((F.col("value") > 40) & (F.col("user_id") % 3 != 0)).alias("acceptable"), (F.col("value") / 100).alias("confidence"), F.lit("completed").alias("quality_status"),
        F.col("event_type").alias("reason"), (F.col("user_id") % 2 == 0).alias("requires_manual_review"), lits("w").alias("warnings"), F.lit(3).alias("n_rows"),
        F.lit("internal-nomina-personal").alias("profile_id"), F.col("props").alias("text"))


CHOSEN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 40 AND user_id % 3 <> 0 THEN 0 ELSE 1 END, event_id) AS r FROM events) e WHERE r = 1"


@query("select_result", f"SELECT user_id AS doc_id, 'c' || event_id AS candidate, value > 40 AND user_id % 3 <> 0 AS acceptable, event_type AS reason FROM ({CHOSEN}) c")
def select_result(spark, sf):
    return quality.select_result(attempts(spark, sf)).select("doc_id", "candidate", "acceptable", "reason")


@query("attempt_order", """SELECT user_id AS doc_id, 'c' || event_id AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
  CASE WHEN value > 40 THEN 0 ELSE 1 END, CASE event_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 6 END, 'c' || event_id) AS r FROM events) e WHERE r = 1""")
def attempt_order(spark, sf):
    kinds = lits("local", "primary", "visual", "fallback", "experimental", "other")
    tries = attempts(spark, sf).withColumns({
        "attempt_kind": F.element_at(kinds, (F.col("priority") % 6 + 1).cast("int")), "acceptable": F.col("confidence") > 0.4}).drop("priority")
    return quality.select_result(tries).select("doc_id", "candidate")


@query("text_only_diagnostic", f"""SELECT user_id AS doc_id, 'ocr_text_only' AS extraction_mode, CASE WHEN user_id % 2 = 0 THEN 'manual_review_required' ELSE 'failed_quality_gate' END AS quality_status, value / 100 AS quality_score,
 event_type AS reason, length(props) AS text_length FROM ({CHOSEN}) c WHERE NOT (value > 40 AND user_id % 3 <> 0)""")
def text_only_diagnostic(spark, sf):
    return quality.text_only_diagnostic(quality.select_result(attempts(spark, sf))).drop("warnings")


@query("enrich_result", f"""SELECT user_id AS doc_id, 'c' || event_id AS candidate, value / 100 AS confidence, 'm1' AS primary_provider, 'm2' AS fallback_provider, 'internal-nomina-personal' AS profile_code, 'personnel-roster' AS extraction_profile
 FROM ({CHOSEN}) c WHERE value > 40 AND user_id % 3 <> 0""")
def enrich_result(spark, sf):
    out = quality.enrich_result(quality.select_result(attempts(spark, sf)), "m1", "m2")
    return out.select("doc_id", "candidate", "confidence", "primary_provider", "fallback_provider", "profile_code", "extraction_profile")


@query("confidence_estimate", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN floor(least(value / 100, 1) * 100 + 0.5) / 100 WHEN event_id % 5 = 1 THEN floor(least(value / 100, 1) * 50 + 0.5) / 100 WHEN event_id % 5 = 2 THEN 0.7
 WHEN event_id % 5 = 3 THEN CASE event_id % 3 WHEN 0 THEN 0.45 WHEN 1 THEN 0.68 ELSE 0.9 END ELSE CASE event_id % 3 WHEN 0 THEN 0.45 WHEN 1 THEN 0.68 ELSE 0.78 END END::DOUBLE AS confidence FROM events""")
def confidence_estimate(spark, sf):
    e, k = C.table(spark, sf, "events"), F.col("event_id")
    capped = F.least(F.col("value") / 100, F.lit(1.0))
    e = e.withColumns({"p": F.when(k % 5 == 0, capped), "r": F.when(k % 5 == 1, capped / 2), "s": F.when(k % 5 == 2, F.lit(0.7)),
                       "q": pick(["local-fallback", "partial", "ai"], k), "l": F.when(k % 5 == 3, "high").otherwise("medium")})
    return e.select("event_id", quality.confidence_estimate("p", "r", "s", "q", "l").alias("confidence"))


@query("row_confidence", "SELECT event_id, CASE WHEN value <= 0 OR event_id % 3 = 2 THEN NULL WHEN value > 1 THEN value / 100 ELSE value END AS confidence FROM events")
def row_confidence(spark, sf):
    e, k = C.table(spark, sf, "events"), F.col("event_id")
    v = F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))
    cells = F.when(k % 3 == 0, F.create_map(F.lit("confianza"), v)).when(k % 3 == 1, F.create_map(F.lit("Score"), F.col("value").cast("string"))).otherwise(F.create_map(F.lit("score"), F.lit("alta")))
    return e.select("event_id", X.row_confidence(cells).alias("confidence"))


@query("invalid_dates", """SELECT doc_id, concat_ws(';', CASE WHEN bad > 0 THEN 'FechaSalida contiene ' || bad || ' valor(es) fuera de DD/MM/YYYY.' END,
  CASE WHEN late > 0 THEN 'FechaArribo contiene ' || late || ' valor(es) fuera de DD/MM/YYYY.' END) AS warnings FROM
 (SELECT CAST(floor(o_orderkey / 7) AS BIGINT) AS doc_id, count(*) FILTER (o_orderkey % 10 = 9) AS bad, count(*) FILTER (o_orderkey % 4 = 1) AS late FROM orders GROUP BY 1) o""")
def invalid_dates(spark, sf):
    o, k = C.table(spark, sf, "orders"), F.col("o_orderkey")
    date = F.when(k % 10 == 9, F.date_format("o_orderdate", "d/M/yy")).when(k % 10 == 8, F.lit(" ")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    arrival = F.when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    bad = lambda c: F.count_if((F.trim(c) != "") & ~F.col(c).rlike(r"^\d{2}/\d{2}/\d{4}\z"))
    agg = o.select(F.floor(k / 7).alias("doc_id"), date.alias("d"), arrival.alias("a")).groupBy("doc_id").agg(bad("d").alias("bad"), bad("a").alias("late"))
    return agg.select("doc_id", F.array_join(quality.invalid_dates(F.col("bad"), F.col("late")), ";").alias("warnings"))


@query("pattern_result", f"""SELECT doc_id, count(*) AS n_rows, 'pattern_structured' AS extraction_mode, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'La nomina se reconstruyo por patron de CUIL sin tabla explicita.' END AS warnings FROM {_PEOPLE} p GROUP BY 1""")
def pattern_result(spark, sf):
    pages = C.roster_pages(spark, sf)
    rows = people.extract_roster(pages)
    seen = pages.select("doc_id").distinct().where("doc_id % 2 = 0").withColumn("has_tables", F.lit(True))
    out = quality.pattern_result(rows, people.roster_metrics(rows), seen, "roster")
    return out.select("doc_id", "n_rows", "extraction_mode", F.array_join("warnings", ";").alias("warnings"))


@query("attach_outputs", """SELECT d.conv_id AS doc_id, e.event_id, d.n AS page_count FROM events e JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) d ON d.conv_id = e.user_id""")
def attach_outputs(spark, sf):
    outputs = C.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id")
    return chunks.attach_outputs(C.sql(spark, sf, C.MULTI_PAGES), outputs).select("doc_id", "event_id", "page_count")


KINDS = ["PROVEEDORES", "PROVEEDORES", "NOMINA", "MOVIMIENTO", "TABLA_DOCUMENTAL", "NOMINA", "PERSONAL_EMPRESA", "MOVIMIENTO", "LISTADO", "TABLA_DOCUMENTAL",
         "EXTRACCION_BASICA", "PDF_TABULAR", "LISTADO", "LISTADO", "COMPROBANTE", "DOCUMENTO_TECNICO", "EXTRACCION_BASICA", "GENERAL"]


@query("resolve_file_kind", f"SELECT c_custkey, CASE c_custkey % 18 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(KINDS))} END AS file_kind FROM customer")
def resolve_file_kind(spark, sf):
    i = F.col("c_custkey") % 18
    when = lambda pairs, default: F.coalesce(*[F.when(i == n, v if not isinstance(v, str) else F.lit(v)) for n, v in pairs], default if not isinstance(default, str) else F.lit(default))
    none = F.array().cast("array<string>")
    df = C.table(spark, sf, "customer").select("c_custkey").withColumns({
        "detected_document_type": when([(0, "Tabla de Proveedores"), (2, "Nómina"), (3, "movimiento"), (4, "otro")], ""),
        "detected_headers": when([(1, lits("Nombre empresa", "CUIT", "Servicio/Área")), (3, lits("Fecha Salida", "Cantidad Camión"))], none),
        "extraction_mode": when([(2, "universal_table"), (3, "universal_table"), (4, "universal_table"), (9, "reviewed_table")], ""),
        "profile_id": when([(5, "internal-nomina-personal"), (6, "internal-personal-empresa-localidad"), (7, "internal-movimiento-camiones"), (8, "internal-tabla-administrativa")], "internal-general"),
        "result_quality": when([(10, "local-fallback")], "ai"), "model_used": when([(11, "PDF table fallback")], "m1"),
        "document_type": when([(12, "table"), (15, "report")], "auto"),
        "columns": when([(13, lits("Razón social", "CUIT", "Localidad")), (14, lits("CUVE", "CADTV", "Organismo", "Producto", "Transportista"))], lits("A", "B")),
        "strategy": when([(16, "local-fallback")], "direct"),
    })
    return quality.resolve_file_kind(df).select("c_custkey", "file_kind")
