"""Tables rebuilt from document text: the expected rows are the source relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import ids
from ..operators import anchors, people, sections, suppliers
from ..operators.ordered import running_sums
from ..sources.pages import explode_lines
from . import corpora as C
from . import duck as D
from .registry import registry

QUERIES, ORACLES, query = registry()
PEOPLE = f"({D.fill(C.PEOPLE)})"
SUPPLIERS = f"({D.fill(C.SUPPLIERS)})"
SECTIONS = f"({D.fill(C.SECTION_SOURCE)})"

# --- roster ----------------------------------------------------------------

ROSTER = f"""SELECT doc_id, CASE WHEN k % 3 = 2 THEN '' ELSE CAST(k + 1 AS VARCHAR) END AS Numero, p_name AS NombreApellido, cuil AS CUIL,
 CASE k % 3 WHEN 0 THEN 'CAMPAMENTO MARIANA' WHEN 1 THEN 'OFICINA / PROYECTOS' ELSE 'Proyecto' END AS LugarTrabajo, locality AS Localidad, province AS Provincia, k FROM {PEOPLE} p"""


@query("extract_roster", f"SELECT * EXCLUDE (k) FROM ({ROSTER}) r")
def extract_roster(spark, sf):
    return people.extract_roster(C.roster_pages(spark, sf)).select("doc_id", *V.ROSTER_COLUMNS)


@query("roster_metrics", f"""SELECT doc_id, count(*) AS totalRegistros, count(*) AS filasConNombre, count(*) AS filasConCUIL, count(*) AS filasConLugarTrabajo,
 count(*) AS filasConLocalidad, count(*) AS filasConProvincia, floor((5 * count(*) + count(*) FILTER (Numero <> '')) / (6.0 * count(*)) * 1000 + 0.5) / 10 AS porcentajeCompletitud FROM ({ROSTER}) r GROUP BY 1""")
def roster_metrics(spark, sf):
    return people.roster_metrics(people.extract_roster(C.roster_pages(spark, sf)))


def noisy_roster(spark, sf):
    rows = people.extract_roster(C.roster_pages(spark, sf))
    k = F.col("CUIL").substr(3, 8).cast("bigint")
    return rows.withColumns({
        "CUIL": F.when(k % 9 == 0, F.lit("1234")).otherwise(F.col("CUIL")),
        "Provincia": F.when(k % 4 == 0, F.lit("Atlantis")).otherwise(F.col("Provincia")),
        "NombreApellido": F.when(k % 10 == 3, F.lit("Ana")).otherwise(F.col("NombreApellido")),
    })


@query("roster_assessment", f"""SELECT doc_id, n AS n_rows, n AS detected_cuils, pr AS province_rows, vr AS valid_rows, s AS quality_score, (vr > 0 OR (n > 100 AND pr > 80)) AND s >= 0.65 AS acceptable
 FROM (SELECT *, floor(vr / n * 100 + 0.5) / 100 AS s FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (p_partkey % 4 <> 0) AS pr,
  count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 10 <> 3) AS vr FROM {PEOPLE} p GROUP BY 1) a) b""")
def roster_assessment(spark, sf):
    return people.roster_assessment(noisy_roster(spark, sf))


@query("find_anchors", f"""SELECT 'cuil' AS kind, doc_id, count(*) AS anchors, count(DISTINCT cuil) AS distinct_anchors FROM {PEOPLE} p GROUP BY 2
 UNION ALL SELECT 'dni', doc_id, count(*), count(DISTINCT p_partkey) FROM {PEOPLE} p GROUP BY 2
 UNION ALL SELECT 'cuit', doc_id, count(*), count(DISTINCT cuit) FROM {SUPPLIERS} s GROUP BY 2""")
def find_anchors(spark, sf):
    pages = {"cuil": C.roster_pages(spark, sf), "dni": C.company_pages(spark, sf), "cuit": C.supplier_layout_pages(spark, sf)}
    out = None
    for kind, p in pages.items():
        found = anchors.find_anchors(explode_lines(p), kind).groupBy("doc_id").agg(
            F.count("*").alias("anchors"), F.count_distinct("anchor").alias("distinct_anchors"))
        found = found.select(F.lit(kind).alias("kind"), "doc_id", "anchors", "distinct_anchors")
        out = found if out is None else out.unionByName(found)
    return out


# --- company lists ---------------------------------------------------------

COMPANY = f"""SELECT doc_id, k, first_value(p_brand) OVER w || ' grupo ' || CAST(floor(k / 12) AS BIGINT) || ' S.R.L.' AS Empresa,
 '30-' || lpad(CAST(first_value(p_partkey) OVER w AS VARCHAR), 8, '0') || '-' || (first_value(p_partkey) OVER w) % 10 AS CUIT, p_name AS NombreApellido,
 CAST(20000000 + p_partkey AS VARCHAR) AS DNI, province AS Provincia,
 array_to_string(list_transform(string_split(locality, ' '), lambda s: upper(s[1]) || lower(s[2:])), ' ') AS Localidad FROM {PEOPLE} p
 WINDOW w AS (PARTITION BY doc_id, floor(k / 12) ORDER BY k)"""
COMPANY = COMPANY.replace("CAST(floor(k / 12) AS BIGINT)", "CAST(CAST(floor(k / 12) AS BIGINT) AS VARCHAR)")


@query("extract_company_personnel", f"SELECT * EXCLUDE (k) FROM ({COMPANY}) c")
def extract_company_personnel(spark, sf):
    return people.extract_company_personnel(C.company_pages(spark, sf)).select("doc_id", *V.COMPANY_COLUMNS)


@query("company_asof", f"SELECT doc_id, Empresa, CUIT, count(*) AS people FROM ({COMPANY}) c GROUP BY 1, 2, 3")
def company_asof(spark, sf):
    return people.extract_company_personnel(C.company_pages(spark, sf)).groupBy("doc_id", "Empresa", "CUIT").agg(F.count("*").alias("people"))


@query("company_metrics", f"""SELECT doc_id, count(*) AS registrosEstructurados, count(DISTINCT CUIT) AS cuitsDetectados, count(DISTINCT DNI) AS dnisDetectados,
 count(DISTINCT Empresa) AS empresasDetectadas, count(*) AS filasConEmpresa, count(*) AS filasConCUIT, count(*) AS filasConDNI, count(*) AS filasConNombre,
 count(*) AS filasConProvincia, count(*) AS filasConLocalidad, 100.0::DOUBLE AS porcentajeCompletitud FROM ({COMPANY}) c GROUP BY 1""")
def company_metrics(spark, sf):
    p = C.company_pages(spark, sf)
    return people.company_metrics(people.extract_company_personnel(p), p)


@query("company_assessment", f"""SELECT doc_id, core / n AS core_ratio, n >= 10 AND core / n >= 0.6 AS acceptable,
 floor((core / n * 0.7::DOUBLE + prov / n * 0.15::DOUBLE + 0.15::DOUBLE) * 100 + 0.5) / 100 AS quality_score FROM (SELECT doc_id, count(*) AS n,
 count(*) FILTER (p_partkey % 3 <> 0) AS core, count(*) FILTER (p_partkey % 4 <> 0) AS prov FROM {PEOPLE} p GROUP BY 1) q""")
def company_assessment(spark, sf):
    rows = people.extract_company_personnel(C.company_pages(spark, sf))
    k = F.col("DNI").cast("bigint") - 20000000
    rows = rows.withColumns({"NombreApellido": F.when(k % 3 == 0, F.lit("Ana")).otherwise(F.col("NombreApellido")),
                             "Provincia": F.when(k % 4 == 0, F.lit("")).otherwise(F.col("Provincia"))})
    return people.company_assessment(rows).select("doc_id", "core_ratio", "acceptable", "quality_score")


@query("company_signals", f"""SELECT doc_id, count(DISTINCT CUIT) AS text_cuits, count(DISTINCT DNI) AS text_dnis, count(DISTINCT Empresa) AS text_companies,
 count(*) >= 2 AS has_signals, true AS has_potential FROM ({COMPANY}) c GROUP BY 1""")
def company_signals(spark, sf):
    return people.company_signals(C.company_pages(spark, sf))


# Length of the joined text: per person the lines, every twelfth with a company, and 60 characters of header a page.
_COMPANY_LENGTH = f"""SELECT doc_id, sum(length(p_name) + length(province) + length(locality) + 11 +
  CASE WHEN k % 12 = 0 THEN length(p_brand) + 35 + length(CAST(CAST(floor(k / 12) AS BIGINT) AS VARCHAR)) ELSE 0 END) + count(*) - 1 + 60 * count(DISTINCT floor(k / 30)) AS n
 FROM {PEOPLE} p GROUP BY 1"""


@query("company_text_score", f"""SELECT doc_id, count(DISTINCT CUIT) * 8 + count(*) * 5 + count(DISTINCT Empresa) * 8 + count(*) * 8 + least(10.0::DOUBLE, max(l.n) / 500) AS text_score
 FROM ({COMPANY}) c JOIN ({_COMPANY_LENGTH}) l USING (doc_id) GROUP BY 1""")
def company_text_score(spark, sf):
    return people.company_text_score(C.company_pages(spark, sf))


@query("best_orientation", "SELECT DISTINCT CAST(floor(p_partkey / 120) AS BIGINT) * 10 + CAST(floor((p_partkey % 120) / 30) + 1 AS BIGINT) AS doc_id, "
       "CAST(CASE WHEN CAST(floor(p_partkey / 120) AS BIGINT) % 3 = 0 THEN 0 ELSE 180 END AS BIGINT) AS orientation FROM part")
def best_orientation(spark, sf):
    p = C.company_pages(spark, sf).select(
        (F.col("doc_id") * 10 + F.col("page_number")).alias("doc_id"), F.col("doc_id").alias("d"), "text",
        F.explode(F.array(*[F.lit(o) for o in (0, 90, 180, 270)])).alias("orientation"))
    lines = F.split("text", "\n")
    text = F.when(F.col("orientation") == 180, F.col("text")).otherwise(F.array_join(F.slice(lines, 6, 12), "\n"))
    mime = F.when(F.col("d") % 3 == 0, "application/pdf").otherwise("image/png")
    r = p.select("doc_id", "orientation", text.alias("text"), mime.alias("mime_type"))
    return people.best_orientation(r).select("doc_id", "orientation")


@query("first_nonempty_rotation", """SELECT doc_id, CAST(1 AS BIGINT) AS page_number, rotation, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE rotation WHEN 0 THEN 0 WHEN 90 THEN 1 WHEN 270 THEN 2 ELSE 3 END) AS r
 FROM (SELECT user_id AS doc_id, rotation, count(*) FILTER (event_type = 'error') AS n_rows FROM (SELECT *, (event_id % 4) * 90 AS rotation FROM events) e GROUP BY 1, 2) q WHERE n_rows > 0) z WHERE r = 1""")
def first_nonempty_rotation(spark, sf):
    e = C.table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id"), ((F.col("event_id") % 4) * 90).alias("rotation")).agg(
        F.count_if(F.col("event_type") == "error").alias("n"))
    return people.first_nonempty_rotation(e.select("doc_id", F.lit(1).alias("page_number"), "rotation", F.col("n").alias("n_rows")))


# --- suppliers -------------------------------------------------------------

_S = ", ".join(f'{c} AS "{n}"' for c, n in zip(
    ("s_name", "provider", "cuit", "service", "province", "zone", "period", "mode"), V.SUPPLIER_COLUMNS))


def _wide(df, *extra):
    return df.select("doc_id", *extra, *[F.col("cells")[c].alias(c) for c in V.SUPPLIER_COLUMNS])


@query("extract_pipe_rows", f"SELECT doc_id, {_S} FROM {SUPPLIERS} s")
def extract_pipe_rows(spark, sf):
    return _wide(suppliers.extract_pipe_rows(C.supplier_pipe_pages(spark, sf)))


@query("extract_around_cuit", f"SELECT doc_id, {_S} FROM {SUPPLIERS} s")
def extract_around_cuit(spark, sf):
    return _wide(suppliers.extract_around_cuit(C.supplier_layout_pages(spark, sf)))


def supplier_inputs(spark, sf, recorded="doc_id % 3 = 0"):
    """Even documents delimited, odd ones laid out; every third also has recorded rows."""
    pipe = C.supplier_pipe_pages(spark, sf).where("doc_id % 2 = 0")
    p = pipe.unionByName(C.supplier_layout_pages(spark, sf).where("doc_id % 2 = 1"))
    src = C.sql(spark, sf, C.SUPPLIERS)
    cells = F.create_map(*[x for a, c in (("Razón social", "s_name"), ("PROVEEDOR", "provider"), ("Nº CUIT", "cuit"), ("Otro", "zone"))
                           for x in (F.lit(a), F.col(c))])
    rec = src.where(recorded).select("doc_id", F.col("k").alias("row_idx"), cells.alias("cells"))
    conf = src.groupBy("doc_id").agg((F.min("doc_id") % 10 / 10).alias("reviewer_confidence"))
    return p, rec, conf


@query("recover_supplier_table", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'reviewer_rows' WHEN doc_id % 2 = 0 THEN 'document_table' ELSE 'text_layout' END AS source,
 greatest(0.65::DOUBLE, (doc_id % 10) / 10) AS confidence, 2 AS n_warnings, s_name AS "Nombre empresa", provider AS "Proveedor", cuit AS "CUIT",
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE service END AS "Servicio/Área", CASE WHEN doc_id % 3 = 0 THEN '' ELSE province END AS "Provincia", CASE WHEN doc_id % 3 = 0 THEN '' ELSE zone END AS "Zona de radicación",
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE period END AS "Fecha/Periodo de contratación", CASE WHEN doc_id % 3 = 0 THEN '' ELSE mode END AS "Modalidad de contratación"
 FROM {SUPPLIERS} s WHERE doc_id IN (SELECT doc_id FROM {SUPPLIERS} z GROUP BY 1 HAVING count(*) >= 5)""")
def recover_supplier_table(spark, sf):
    p, rec, conf = supplier_inputs(spark, sf)
    return _wide(suppliers.recover_supplier_table(p, conf, reviewed_rows=rec), "source", "confidence", F.size("warnings").alias("n_warnings"))


@query("normalize_candidate_rows", f"""SELECT doc_id, k, s_name AS "Nombre empresa", provider AS "Proveedor", cuit AS "CUIT" FROM {SUPPLIERS} s""")
def normalize_candidate_rows(spark, sf):
    from ..operators.tables import normalize_candidate_rows as op

    _, rec, _ = supplier_inputs(spark, sf, "true")
    return op(rec).select("doc_id", F.col("row_idx").alias("k"), *[F.col("cells")[c].alias(c) for c in V.SUPPLIER_COLUMNS[:3]])


@query("count_valid_cuits", f"SELECT doc_id, count(DISTINCT CASE WHEN k % 4 <> 0 THEN cuit END) AS cuits FROM {SUPPLIERS} s GROUP BY 1")
def count_valid_cuits(spark, sf):
    src = C.sql(spark, sf, C.SUPPLIERS)
    value = F.when(F.col("k") % 4 == 0, F.replace("cuit", F.lit("-"), F.lit(""))).otherwise(F.concat(F.lit("CUIT "), F.col("cuit")))
    rows = src.select("doc_id", F.create_map(F.lit("CUIT"), value).alias("cells"))
    return suppliers.count_valid_cuits(rows.unionByName(rows))


@query("resolve_headers", """SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'Nombre empresa' WHEN 1 THEN 'Proveedor' WHEN 2 THEN 'CUIT' WHEN 3 THEN 'Servicio/Área' WHEN 4 THEN 'Provincia'
 WHEN 5 THEN 'Zona de radicación' WHEN 6 THEN 'Fecha/Periodo de contratación' WHEN 7 THEN 'Modalidad de contratación' END AS header FROM supplier""")
def resolve_headers(spark, sf):
    from ..operators.tables import supplier_header

    raw = F.element_at(F.array(*[F.lit(x) for x in (
        "RAZÓN SOCIAL", "Nombre Proveedor 2", "N° CUIT", "Área/Servicio", "Provin.", "Radicación", "Período de contratación", "MODALIDAL contratación", "Monto")]),
        (F.col("s_suppkey") % 9 + 1).cast("int"))
    return C.table(spark, sf, "supplier").select("s_suppkey", supplier_header(raw).alias("header"))


@query("metadata_line", """SELECT s_suppkey, s_suppkey % 4 < 3 AS is_metadata, s_suppkey % 5 IN (0, 1) AS usable FROM supplier""")
def metadata_line(spark, sf):
    k = F.col("s_suppkey")
    raw = F.element_at(F.array(F.lit("Folio 12"), F.lit("SEC. 3"), F.lit("Provincia"), F.col("s_name")), (k % 4 + 1).cast("int"))
    m = F.create_map(
        F.lit("CUIT"), F.when(k % 5 == 2, F.lit("20-1-3")).otherwise(F.lit("20-12345678-3")), F.lit("Proveedor"), F.when(k % 5 == 3, "").otherwise(F.col("s_name")),
        F.lit("Nombre empresa"), F.when(k % 5 == 0, F.lit("x")).otherwise(""), F.lit("Servicio/Área"), F.when(k % 5 == 1, F.lit("y")).otherwise(""))
    return C.table(spark, sf, "supplier").select("s_suppkey", suppliers.metadata_line(raw).alias("is_metadata"), suppliers.usable_supplier_row(m).alias("usable"))


# --- annex and sections ----------------------------------------------------

ANNEX = f"""SELECT doc_id, CAST(k + 1 AS VARCHAR) AS "N° Anexo", p_name AS "Nombre Anexo", CASE k % 3 WHEN 0 THEN 'IV' WHEN 1 THEN 'XII' ELSE 'VII' END AS Romano,
 CAST(1 + k % 9 AS VARCHAR) AS "N° Punto", 'Mensual' AS Frecuencia, 'Días hábiles' AS "Tipo de Plazo", CAST(p_size AS VARCHAR) AS "Cant. Días" FROM {PEOPLE} p WHERE k % 8 <> 7"""


@query("extract_annex_rows", ANNEX)
def extract_annex_rows(spark, sf):
    return sections.extract_annex_rows(C.annex_pages(spark, sf)).drop("pos")


@query("join_wrapped_lines", f"""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, k FROM {PEOPLE} p UNION ALL SELECT doc_id, -1 FROM {PEOPLE} p GROUP BY doc_id, floor(k / 31)
 UNION ALL SELECT doc_id, -2 FROM {PEOPLE} p WHERE k % 8 = 7) q GROUP BY 1""")
def join_wrapped_lines(spark, sf):
    return sections.join_wrapped_lines(C.annex_pages(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"))


_CATEGORY = "CASE WHEN kind = 'text' THEN 'Resolución' WHEN section = 'Inspecciones Realizadas' THEN 'Inspección' WHEN section = 'Teléfono' THEN '' ELSE 'Proyecto' END"
SECTION_LINES = f"""SELECT doc_id, CASE WHEN k % 10 < 5 THEN 'Proyecto' ELSE 'Inspecciones Realizadas' END AS section, CASE k % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'bullet' ELSE 'text' END AS kind,
  CASE k % 3 WHEN 0 THEN 'Segmento' WHEN 1 THEN concat('saldo ', balance, ' al 12/05/2023') ELSE concat('Resolución ', c_custkey, '/21 aprobada') END AS dato,
  CASE k % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN concat('saldo ', balance, ' al 12/05/2023') ELSE concat('Resolución ', c_custkey, '/21 aprobada') END AS value,
  CASE k % 3 WHEN 1 THEN CASE WHEN regexp_matches(balance, '^-?\\d{{4}}$') THEN regexp_extract(balance, '\\d{{4}}') ELSE '12/05/2023' END WHEN 2 THEN CASE WHEN c_custkey BETWEEN 1000 AND 9999 THEN CAST(c_custkey AS VARCHAR) ELSE '' END ELSE '' END AS fecha FROM {SECTIONS} s
 UNION ALL SELECT doc_id, 'Proyecto', 'title', 'Proyecto', concat('Lote ', c_custkey), CASE WHEN c_custkey BETWEEN 1000 AND 9999 THEN CAST(c_custkey AS VARCHAR) ELSE '' END FROM {SECTIONS} s WHERE k % 10 = 0
 UNION ALL SELECT DISTINCT doc_id, 'Empresa', 'title', 'Empresa', 'Minera Sur', '' FROM {SECTIONS} s
 UNION ALL SELECT DISTINCT doc_id, 'Teléfono', 'title', 'Teléfono', '4311000', '' FROM {SECTIONS} s"""
SECTION_ROWS = f"""SELECT DISTINCT doc_id, section AS "Sección", {_CATEGORY} AS "Categoría", dato AS "Dato", value AS "Valor", '' AS "Detalle", fecha AS "Fecha",
 CASE WHEN kind = 'text' THEN value ELSE '' END AS "Expediente/Resolución", CASE WHEN section IN ('Proyecto', 'Empresa') THEN value ELSE '' END AS "Empresa/Proyecto", '' AS "Ubicación", '' AS "Observación" FROM ({SECTION_LINES}) l"""
SECTION_FINAL = f"SELECT * FROM ({SECTION_ROWS}) r WHERE doc_id IN (SELECT doc_id FROM ({SECTION_ROWS}) z GROUP BY 1 HAVING count(*) >= 10)"


@query("extract_sections", SECTION_FINAL)
def extract_sections(spark, sf):
    return sections.extract_sections(C.section_pages(spark, sf)).drop("pos")


@query("document_markers", f"SELECT DISTINCT doc_id, CAST(3 + CAST(max(k) >= 5 AS INT) AS BIGINT) AS markers FROM {SECTIONS} s GROUP BY doc_id")
def document_markers(spark, sf):
    return sections.document_markers(C.section_pages(spark, sf), [sections.py_punct(m) for m in V.SECTION_MARKERS])


@query("local_fallback", f"""SELECT 'a' || doc_id AS doc_id, 'annex_table' AS source, 'partial' AS result_quality, count(*) AS n_rows FROM ({ANNEX}) a GROUP BY 1
 UNION ALL SELECT 's' || doc_id, 'sections', 'partial', count(*) FROM ({SECTION_FINAL}) s GROUP BY 1
 UNION ALL SELECT 'd' || doc_id, 'text_lines', 'local-fallback', sum(len({D.lines('text')}))::BIGINT FROM documents GROUP BY 1""")
def local_fallback(spark, sf):
    tag = lambda df, t: df.select(F.concat(F.lit(t), F.col("doc_id").cast("string")).alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), "text")
    every = tag(C.annex_pages(spark, sf), "a").unionByName(tag(C.section_pages(spark, sf), "s")).unionByName(tag(C.sql(spark, sf, C.SINGLE_PAGES), "d"))
    return sections.local_fallback(every).groupBy("doc_id", "source", "result_quality").agg(F.count("*").alias("n_rows"))


# --- ordered helpers -------------------------------------------------------


@query("prev_next_anchor", """SELECT event_id, lag(a IGNORE NULLS) OVER w AS previous_anchor, lead(a IGNORE NULLS) OVER w AS next_anchor,
 count(a) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchors_before
 FROM (SELECT *, CASE WHEN event_type = 'error' THEN event_id END AS a FROM events) e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def prev_next_anchor(spark, sf):
    e = C.table(spark, sf, "events").withColumn("b", F.floor(F.col("event_id") / 512))
    hit = F.when(F.col("event_type") == "error", F.col("event_id"))
    e = anchors.neighbours(e, ["user_id"], "b", "event_id", hit)
    e = running_sums(e, ["user_id"], "b", ["event_id"], {"anchors_before": F.when(F.col("event_type") == "error", 1).otherwise(0)})
    return e.select("event_id", "previous_anchor", "next_anchor", "anchors_before")


@query("docs_with_anchor", f"SELECT DISTINCT doc_id FROM {PEOPLE} p UNION ALL SELECT conv_id + 1000000 FROM conversations WHERE regexp_matches(text, '\\b(\\d{{10,11}}|\\d{{2}}[- ]?\\d{{7,8}}[- ]?\\d)\\b') GROUP BY 1")
def docs_with_anchor(spark, sf):
    docs = C.roster_pages(spark, sf).select("doc_id", "text").unionByName(
        C.table(spark, sf, "conversations").select((F.col("conv_id") + 1000000).alias("doc_id"), "text"))
    return anchors.docs_with_anchor(docs)
