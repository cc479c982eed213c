"""Merged page readings with their checks, JSON fragments, and readers over a given table."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import page_merge
from ..operators.providers import Provider, provider_outputs
from ..operators.storage import shared_folder, stored
from ..sources import export
from . import corpora as C
from .registry import registry
from .table_queries import lits, parts

QUERIES, ORACLES, query = registry()

# --- merged pages ----------------------------------------------------------

_READ = """(SELECT *, doc_id % 7 AS d, CASE doc_id % 7 WHEN 3 THEN false WHEN 4 THEN k % 4 <> 0 WHEN 5 THEN k % 2 <> 0 WHEN 6 THEN k % 3 <> 1 ELSE true END AS good,
 CASE WHEN doc_id % 7 = 6 AND k % 3 = 0 THEN 'Pagina ' || page_number || ' procesada con rotacion alternativa 90.' WHEN doc_id % 7 = 6 AND k % 3 = 1 THEN 'Pagina ' || page_number || ' sin filas validas. ilegible'
  WHEN doc_id % 7 = 3 OR (doc_id % 7 = 4 AND k % 4 = 0) OR (doc_id % 7 = 5 AND k % 2 = 0) THEN 'Pagina ' || page_number || ' sin filas validas.' END AS warning
 FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 40) AS BIGINT) AS doc_id, o_orderkey % 40 + 1 AS page_number, o_orderpriority || ' ' || o_orderkey AS v FROM orders) o)"""
_STATUS = f"""CASE any_value(d) WHEN 1 THEN 'PROFILE_REJECTED_GENERIC_LINE_CSV' WHEN 2 THEN 'PROFILE_MISSING_COLUMNS: {V.MOVEMENT_COLUMNS[-1]}' WHEN 4 THEN CASE WHEN bool_and(good) THEN 'ok' ELSE 'PROFILE_INCLUDED_IGNORED_TEXT' END
 WHEN 5 THEN CASE WHEN bool_and(good) THEN 'ok' ELSE 'PROFILE_CORRUPTED_TEXT_DOMINANT' END ELSE CASE WHEN bool_or(good) THEN 'ok' ELSE 'PROFILE_NO_VALID_ROWS' END END"""


def page_attempts(spark, sf):
    """Each order is a page; every seventh document was turned or could not be read in places."""
    k, doc = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 40)
    d = doc % 7
    value = F.concat("o_orderpriority", F.lit(" "), k.cast("string"))
    value = (F.when(d == 3, " ").when((d == 4) & (k % 4 == 0), "FOLIO 7").when((d == 5) & (k % 2 == 0), F.concat(F.repeat(F.lit("Ã"), 10), k.cast("string")))
             .otherwise(value))
    columns = F.when(d == 1, lits(*V.MOVEMENT_COLUMNS, *V.LINE_COLUMNS)).when(d == 2, lits(*V.MOVEMENT_COLUMNS[:-1])).otherwise(lits(*V.MOVEMENT_COLUMNS))
    row = lambda v: F.array(F.create_map(F.lit("Proveedor"), v), F.create_map(F.lit("Proveedor"), v))
    o = C.table(spark, sf, "orders").select(doc.alias("doc_id"), (k % 40 + 1).alias("page_number"), columns.alias("columns"), value.alias("v"), k.alias("k"), d.alias("d"))
    first = (F.col("d") == 6) & (F.col("k") % 3 < 2)
    attempt = F.struct(F.lit(0).alias("rotation"), row(F.when(first, "").otherwise(F.col("v"))).alias("rows"), F.when(first & (F.col("k") % 3 == 1), "ilegible").alias("error"))
    turned = F.struct(F.lit(90).alias("rotation"), row(F.col("v")).alias("rows"), F.lit(None).cast("string").alias("error"))
    both = F.when(first & (F.col("k") % 3 == 0), F.array(attempt, turned)).otherwise(F.array(attempt))
    return o.select("doc_id", "page_number", "columns", F.inline(both))


def merged(spark, sf, max_pages=None):
    attempts = page_attempts(spark, sf)
    counts = attempts.groupBy("doc_id").agg(F.count_distinct("page_number").alias("page_count"))
    return page_merge.merge_pages(attempts, counts, max_pages, strict=True)


@query("merge_pages_status", f"""SELECT doc_id, {_STATUS} AS status, count(*) AS pages_processed, count_if(good)::BIGINT AS records, count(warning) AS warned FROM {_READ} r GROUP BY doc_id""")
def merge_pages_status(spark, sf):
    return merged(spark, sf).documents.drop("page_count")


@query("merge_pages_rows", f"""SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS row_number, v AS supplier FROM {_READ} r
 WHERE good AND doc_id IN (SELECT doc_id FROM (SELECT doc_id, {_STATUS} AS s FROM {_READ} q GROUP BY doc_id) t WHERE s = 'ok')""")
def merge_pages_rows(spark, sf):
    return merged(spark, sf).rows.select("doc_id", "page_number", "row_number", F.col("cells")["Proveedor"].alias("supplier"))


@query("merge_pages_warnings", f"""SELECT doc_id, page_number, warning FROM {_READ} r WHERE warning IS NOT NULL AND page_number <= 5
 UNION ALL SELECT doc_id, 0, 'Se procesaron 5 de ' || count(*) || ' paginas por limite configurado.' FROM {_READ} r GROUP BY doc_id HAVING count(*) > 5""")
def merge_pages_warnings(spark, sf):
    """The page limit is the caller's; it is reported with the other warnings."""
    return merged(spark, sf, max_pages=5).warnings


# --- JSON ------------------------------------------------------------------

_EXPORT = f"""(SELECT doc_id, count(p_partkey) AS n FROM (SELECT CAST(floor(p_partkey / 250) AS BIGINT) AS doc_id, p_partkey FROM part
 UNION ALL SELECT -1 - r_regionkey, NULL FROM region) a WHERE doc_id % 6 <> 5 GROUP BY doc_id)"""
_NAMES = "OCR_LISTADO_20240120_1200"
_HEAD = f"""'{{"metadata":{{"accessMode":"client",' || CASE WHEN doc_id % 2 = 0 THEN '"clientProfileId":"internal-general",' ELSE '' END || '"confidence":' || CAST(0.5 + 0.25 * abs(doc_id % 2) AS DOUBLE) ||
 ',"extractionKind":"LISTADO","extractionMode":"' || CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE '{export.UNIVERSAL_MODE}' END || '","fields":2,"isInternalTest":false,"originalFileName":"lista ' || doc_id ||
 '.pdf","outputFileName":"{_NAMES}.csv","outputJsonFileName":"{_NAMES}.json","processedAt":"2024-01-20T12:00:00.000Z",' || CASE WHEN doc_id % 2 = 0 THEN '"profileCode":"internal-general","profileName":"General",' ELSE '' END ||
 '"records":' || n || ',"warnings":["perfil"' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',"hoja"' END || ']}},"columns":["code","name"],"rows":['"""


def export_results(spark, sf):
    docs = parts(spark, sf, 250).select("doc_id").distinct().unionByName(C.table(spark, sf, "region").select((-1 - F.col("r_regionkey")).cast("bigint").alias("doc_id")))
    d = F.col("doc_id")
    names = lits("Demo", "Piloto", "Basico", "Profesional", "Empresa", "Sin plan")
    return docs.select(
        "doc_id", F.when(d < 0, "Demo").otherwise(F.element_at(names, (F.pmod(d, F.lit(6)) + 1).cast("int"))).alias("plan_name"), F.lit("LISTADO").alias("file_kind"),
        lits("code", "name").alias("columns"), F.lit(C.NOW).cast("timestamp").alias("processed_at"), F.concat(F.lit("lista "), d.cast("string"), F.lit(".pdf")).alias("source_file_name"),
        (0.5 + 0.25 * F.abs(d % 2)).cast("double").alias("confidence"), F.when(d % 2 == 0, "table").otherwise(export.UNIVERSAL_MODE).alias("extraction_mode"),
        F.lit("internal-general").alias("profile_id"), F.lit("General").alias("profile_label"), lits("perfil").alias("profile_validation_warnings"),
        F.when(d % 3 != 0, lits("hoja")).alias("warnings"))


@query("write_json_fragments", f"""SELECT doc_id, 0 AS part, 0::BIGINT AS run, {_HEAD} AS value FROM {_EXPORT} x
 UNION ALL SELECT doc_id, 2, 0, ']}}' FROM {_EXPORT} x
 UNION ALL SELECT doc_id, 1, run, CASE WHEN run > min(run) OVER (PARTITION BY doc_id) THEN ',' ELSE '' END || value FROM (SELECT CAST(floor(p_partkey / 250) AS BIGINT) AS doc_id,
  CAST(floor((p_partkey % 250) / 64) AS BIGINT) AS run, string_agg('{{"code":"' || p_partkey || '","name":"' || p_name || '"}}', ',' ORDER BY p_partkey) AS value FROM part GROUP BY 1, 2) r WHERE doc_id % 6 <> 5""")
def write_json_fragments(spark, sf):
    rows = parts(spark, sf, 250).select("doc_id", F.col("k").alias("row_idx"), F.create_map(F.lit("code"), F.col("p_partkey").cast("string"), F.lit("name"), F.col("p_name")).alias("cells"))
    path = f"{shared_folder(spark)}/fragments-{uuid.uuid4().hex}"
    fragments = export.json_fragments(export_results(spark, sf), rows, C.plan_dimension(spark), run_length=64)
    export.write_json_fragments(fragments, path)
    return spark.read.schema("doc_id bigint, part int, run bigint, value string").json(path)


# --- readers ---------------------------------------------------------------


def one_line(batch: pa.RecordBatch) -> pa.Array:
    """A reader that answers texts in one line and fails on a batch with an unreadable file."""
    if pc.any(pc.equal(batch.column("file_kind"), "damaged")).as_py():
        raise ValueError("damaged file")
    return pc.replace_substring(batch.column("text"), "\n", " ")


def raw_text(batch: pa.RecordBatch) -> pa.Array:
    """The second reader: texts as they are, nothing for locked files."""
    return pc.if_else(pc.equal(batch.column("lock"), "locked"), None, batch.column("text"))


@query("provider_outputs", """SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN CASE WHEN doc_id % 10 = 3 THEN 'failed' ELSE 'empty' END WHEN doc_id % 30 = 3 THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN doc_id % 10 = 3 OR coalesce(text, '') = '' THEN 'raw text' ELSE 'one line' END AS provider_used, CASE WHEN doc_id % 30 = 3 THEN NULL WHEN doc_id % 10 = 3 THEN md5(text) ELSE md5(replace(text, chr(10), ' ')) END AS output,
 CASE WHEN doc_id % 10 = 3 THEN 'ValueError: damaged file' END AS error FROM documents""")
def provider_answers(spark, sf):
    d = F.col("doc_id")
    requests = C.table(spark, sf, "documents").select("doc_id", "text", F.when(d % 10 == 3, "damaged").otherwise("sound").alias("file_kind"), F.when(d % 30 == 3, "locked").otherwise("open").alias("lock"))
    found = stored(provider_outputs(requests, Provider("one line", one_line), Provider("raw text", raw_text)))
    return found.withColumn("output", F.md5("output"))
