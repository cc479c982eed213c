"""Inputs of the registered queries, derived by Spark from the supplied tables.

Documents are built from runs of consecutive keys, so their size is fixed and their number
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-20 12:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Spark SQL with ``{table}`` for a supplied table."""
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages "
             "benchmark labels conversations").split()
    return spark.sql(text.format(**{n: f"parquet.`{sf}/{n}.parquet`" for n in names}))


def finish(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, so that both engines report one type."""
    return df.select(*[
        F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])


# --- SQL shared by Spark and the comparison engine -------------------------

USAGE = """SELECT event_id, user_id AS code_id, user_id AS client_id, ts AS created_at,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value AS duration_ms FROM {events}"""

CLIENTS = """SELECT c_custkey AS client_id, c_name AS client_name,
 CASE WHEN c_custkey % 17 = 0 THEN 'inactive' ELSE 'active' END AS client_status,
 CASE c_custkey % 6 WHEN 0 THEN 'Demo' WHEN 1 THEN 'Piloto' WHEN 2 THEN 'Basico' WHEN 3 THEN 'Profesional'
 WHEN 4 THEN 'Empresa' END AS plan_name FROM {customer}"""

CODES = """SELECT user_id AS code_id, user_id AS client_id,
 CASE user_id % 5 WHEN 0 THEN 'Demo' WHEN 1 THEN 'Piloto' WHEN 2 THEN 'Basico' WHEN 3 THEN 'Profesional'
 ELSE 'Empresa' END AS plan_name,
 CASE WHEN user_id % 19 = 0 THEN 'revoked' ELSE 'active' END AS code_status,
 CASE WHEN user_id % 13 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS expires_at,
 first_seen FROM (SELECT user_id, min(ts) AS first_seen FROM {events} GROUP BY user_id) u"""

PLAN_VALUES = """SELECT * FROM (VALUES ('Demo', 5, 10, 20, 10, true), ('Piloto', 20, 100, 50, 20, true),
 ('Basico', 50, 500, 50, 20, true), ('Profesional', 150, 2000, 50, 20, true),
 ('Empresa', 9999, 99999, 50, 20, true)) AS p(plan_name, daily_limit, monthly_limit, max_pdf_mb, max_image_mb, is_active)"""

TYPED_DOCS = """SELECT doc_id,
 CASE doc_id % 7 WHEN 0 THEN concat('Listado_', doc_id, '.pdf') WHEN 1 THEN concat('Factura-', doc_id, '.PDF')
  WHEN 2 THEN concat('informe ', doc_id, '.png') WHEN 3 THEN concat('scan', doc_id, '.jpeg')
  WHEN 4 THEN concat('Nómina/', doc_id, '.jpg') WHEN 5 THEN concat('nota', doc_id, '.docx')
  ELSE concat('Guía ', doc_id, '.pdf') END AS file_name,
 CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpg' WHEN 2 THEN '' WHEN 3 THEN 'IMAGE/PNG '
  ELSE 'application/octet-stream' END AS declared,
 (doc_id * 7919) % 60000000 AS size_bytes,
 concat(text, CASE doc_id % 11 WHEN 0 THEN concat(chr(10), 'Factura total importe ticket')
  WHEN 1 THEN concat(chr(10), 'Informe resumen expediente resolución')
  WHEN 2 THEN concat(chr(10), 'FechaSalida CantidadCamion Proveedor Producto Origen Destino')
  WHEN 3 THEN concat(chr(10), 'DTVe SENASA ARCA CUVE patente')
  WHEN 4 THEN concat(chr(10), 'Nómina del personal', chr(10), 'Nombre y Apellido - CUIL - Lugar de trabajo')
  WHEN 5 THEN concat(chr(10), 'Minera Sur S.R.L. 30-12345678-9 legajos 12345678 y 23456789 de Salta')
  WHEN 6 THEN concat(chr(10), 'Nro nombre fecha cantidad') WHEN 7 THEN concat(chr(10), 'Escaneado con CamScanner. Folio 3')
  ELSE '' END) AS text FROM {documents}"""

SINGLE_PAGES = "SELECT doc_id, 1 AS page_number, text FROM {documents}"
MULTI_PAGES = "SELECT conv_id AS doc_id, turn + 1 AS page_number, text FROM {conversations}"

PROVINCE_CASE = ("CASE p_size % 4 WHEN 0 THEN 'Salta' WHEN 1 THEN 'Jujuy' WHEN 2 THEN 'Tucumán' ELSE 'Río Negro' END")
LOCALITY_CASE = ("CASE p_size % 3 WHEN 0 THEN 'Campo Quijano' WHEN 1 THEN 'General Mosconi' ELSE 'Rosario Lerma' END")

PEOPLE = f"""SELECT CAST(floor(p_partkey / 120) AS BIGINT) AS doc_id, CAST(p_partkey % 120 AS BIGINT) AS k, p_partkey,
 p_name, p_brand, p_size, p_type, p_retailprice,
 concat('20', lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0'), CAST(p_partkey % 10 AS VARCHAR(2))) AS cuil,
 {PROVINCE_CASE} AS province, {LOCALITY_CASE} AS locality FROM {{part}}"""

SUPPLIERS = """SELECT CAST(floor(s_suppkey / 20) AS BIGINT) AS doc_id, CAST(s_suppkey % 20 AS BIGINT) AS k, s_suppkey, s_name,
 concat('Firma ', CAST(s_suppkey AS VARCHAR(20))) AS provider,
 concat('20-', lpad(CAST(s_suppkey AS VARCHAR(20)), 8, '0'), '-', CAST(s_suppkey % 10 AS VARCHAR(2))) AS cuit,
 concat('Servicio ', CASE s_nationkey % 3 WHEN 0 THEN 'catering' WHEN 1 THEN 'transporte' ELSE 'limpieza' END) AS service,
 CASE s_nationkey % 4 WHEN 0 THEN 'Salta' WHEN 1 THEN 'Jujuy' WHEN 2 THEN 'Córdoba' ELSE 'Neuquén' END AS province,
 concat('Zona ', CAST(s_nationkey AS VARCHAR(20))) AS zone,
 concat('0', CAST(1 + s_suppkey % 9 AS VARCHAR(2)), '/03/2023') AS period,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Orden de compra' ELSE 'Contrato marco' END AS mode FROM {supplier}"""

SECTION_SOURCE = """SELECT CAST(floor(c_custkey / 40) AS BIGINT) AS doc_id, CAST(c_custkey % 40 AS BIGINT) AS k, c_custkey,
 c_mktsegment, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)) AS balance FROM {customer}"""


# --- Spark-side document texts ---------------------------------------------


def _pages(rows: DataFrame, per_page: int, header: str, text: str) -> DataFrame:
    """Join row texts into pages of ``per_page`` rows under a header."""
    return rows.withColumn("_t", F.expr(text)).groupBy(
        "doc_id", (F.floor(F.col("k") / per_page) + 1).cast("int").alias("page_number")
    ).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "_t"))), lambda x: x["_t"]), "\n").alias("body")) \
        .select("doc_id", "page_number", F.concat(F.lit(header), F.col("body")).alias("text"))


def roster_pages(spark, sf) -> DataFrame:
    rows = sql(spark, sf, PEOPLE)
    text = """CASE k % 3
      WHEN 0 THEN concat(k + 1, ' ', p_name, ' ', cuil, ' CAMPAMENTO MARIANA 00 ', replace(locality, 'Quijano', 'Quljano'), ' ', replace(province, 'Salta', 'Satta'))
      WHEN 1 THEN concat(k + 1, '\n', p_name, '\n', cuil, '\nOFICINA / PROYECTOS\nOD ', locality, '\n', upper(province))
      ELSE concat(k + 1, ' - ', p_name, '\n', substr(cuil, 1, 2), '-', substr(cuil, 3, 8), '-', substr(cuil, 11, 1), ' Proyecto\n', locality, '\nEscaneado con CamScanner\n', translate(province, 'áí', 'ai')) END"""
    header = "Nómina del personal\r\nNombre y Apellido | CUIL | Lugar de trabajo | Localidad | Provincia\nhttps://v3.camscanner.com/x\n"
    return _pages(rows, 30, header, text)


def company_pages(spark, sf) -> DataFrame:
    rows = sql(spark, sf, PEOPLE)
    text = """concat(
      CASE WHEN k % 12 = 0 THEN concat(p_brand, ' grupo ', CAST(floor(k / 12) AS INT), ' S.R.L.\nCUIT: 30-', lpad(p_partkey, 8, '0'), '-', p_partkey % 10, '\n') ELSE '' END,
      CASE WHEN k % 2 = 0 THEN concat(p_name, '\n', 20000000 + p_partkey, '\n', province) ELSE concat(p_name, ' ', 20000000 + p_partkey, ' ', upper(province)) END,
      '\n', lower(locality))"""
    return _pages(rows, 30, "Empresa\nCUIT\nNombre y Apellido\nDNI\nEscaneado con CamScanner\n", text)


SUPPLIER_HEADER = ("Nombre empresa | Proveedor | CUIT | Servicio/Área | Provin. | Zona de radicación | "
                   "Fecha/Periodo de contratación | Modalidal contratación")


def supplier_pipe_pages(spark, sf) -> DataFrame:
    rows = sql(spark, sf, SUPPLIERS)
    text = "concat_ws(' | ', s_name, provider, cuit, service, province, zone, period, mode)"
    pages = _pages(rows, 7, "", text)
    lead = F.when(F.col("page_number") == 1, F.lit(f"Escaneado con CamScanner\n{SUPPLIER_HEADER}\n")).otherwise(F.lit("Folio 2\n"))
    return pages.withColumn("text", F.concat(lead, "text"))


def supplier_layout_pages(spark, sf) -> DataFrame:
    rows = sql(spark, sf, SUPPLIERS)
    text = "concat_ws('\n', s_name, provider, cuit, service, province, zone, period, mode)"
    pages = _pages(rows, 7, "", text)
    header = SUPPLIER_HEADER.replace(" | ", "\n")
    lead = F.when(F.col("page_number") == 1, F.lit(header + "\n")).otherwise(F.lit("Folio 2\n"))
    return pages.withColumn("text", F.concat(lead, "text"))


def section_pages(spark, sf) -> DataFrame:
    rows = sql(spark, sf, SECTION_SOURCE)
    text = """concat(
      CASE WHEN k % 10 = 0 THEN concat('Proyecto Lote ', c_custkey, '\n') WHEN k % 10 = 5 THEN 'INSPECCIONES REALIZADAS\n' ELSE '' END,
      CASE k % 3 WHEN 0 THEN concat('Segmento:  ', c_mktsegment) WHEN 1 THEN concat('• saldo ', balance, ' al 12/05/2023') ELSE concat('Resolución ', c_custkey, '/21 aprobada') END)"""
    pages = _pages(rows, 15, "", text)
    lead = F.when(F.col("page_number") == 1, F.lit("Empresa Minera Sur\nTeléfono 4311000\n")).otherwise(F.lit(""))
    return pages.withColumn("text", F.concat(lead, "text"))


def annex_pages(spark, sf) -> DataFrame:
    rows = sql(spark, sf, PEOPLE)
    tail = "concat(CASE k % 3 WHEN 0 THEN 'IV' WHEN 1 THEN 'XII' ELSE 'VII' END, ' ', 1 + k % 9, ' Mensual Días hábiles ', p_size)"
    text = f"""concat(CASE WHEN k % 8 = 7 THEN '2024 continuado\n' ELSE '' END,
      k + 1, ' ', p_name, CASE WHEN k % 4 = 3 THEN '\n' ELSE ' ' END, {tail})"""
    header = "N° Anexo | Nombre Anexo | Romano | N° Punto | Frecuencia | Tipo de Plazo | Cant. Días\n"
    return _pages(rows, 31, header, text)


def plan_dimension(spark) -> DataFrame:
    from ..operators.routing import plans_table

    return plans_table(spark)
