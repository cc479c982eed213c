"""Single functions and checks under their own names, and the streaming forms.

Most take one column of a broader query; its SQL counterpart is narrowed the same way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..functions import values as X
from ..operators import people, quality
from ..operators.blocks import line_blocks
from ..operators.storage import shared_folder
from ..streaming import rate_limit, usage
from . import corpora as C
from . import duck as D
from . import extract_queries, quality_queries, table_queries, text_queries, usage_queries
from .registry import registry

QUERIES, ORACLES, query = registry()
_SOURCES = [extract_queries, quality_queries, table_queries, text_queries, usage_queries]

# name: (broader query, its columns)
NARROWED = {
    "generic_line_schema": ("header_checks", ["c_custkey", "generic_lines"]),
    "field_value_output": ("header_checks", ["c_custkey", "field_value"]),
    "missing_columns": ("header_checks", ["c_custkey", "n_missing"]),
    "extra_columns": ("header_checks", ["c_custkey", "n_extra"]),
    "header_except": ("header_checks", ["c_custkey", "n_extra", "n_missing"]),
    "header_intersect": ("header_checks", ["c_custkey", "matched"]),
    "commercial_column_count": ("header_checks", ["c_custkey", "commercial_columns"]),
    "movement_column_count": ("header_checks", ["c_custkey", "movement_columns"]),
    "unsupported_columns": ("header_checks", ["c_custkey", "unsupported"]),
    "valid_cuil": ("identifier_checks", ["p_partkey", "cuil"]),
    "valid_dni": ("identifier_checks", ["p_partkey", "dni"]),
    "valid_cuit": ("identifier_checks", ["p_partkey", "cuit"]),
    "likely_person_name": ("identifier_checks", ["p_partkey", "person", "person_company"]),
    "likely_company": ("identifier_checks", ["p_partkey", "company"]),
    "likely_locality": ("identifier_checks", ["p_partkey", "locality"]),
    "usable_supplier_row": ("metadata_line", ["s_suppkey", "usable"]),
    "province_exact": ("province_lookup", ["p_partkey", "exact", "supplier"]),
    "province_last": ("province_lookup", ["p_partkey", "last_name", "last_pos"]),
    "cap_warnings": ("merge_warnings", ["c_custkey", "capped"]),
    "fold_accents": ("text_normal_forms", ["doc_id", "folded"]),
    "norm_search": ("text_normal_forms", ["doc_id", "search"]),
    "norm_words": ("text_normal_forms", ["doc_id", "words"]),
    "norm_key": ("text_normal_forms", ["doc_id", "key"]),
    "norm_punct": ("text_normal_forms", ["doc_id", "punct"]),
    "sanitize_raw_text": ("write_raw_text", ["doc_id", "raw_text"]),
    "apply_corrections": ("roster_value_cleanup", ["p_partkey", "name"]),
    "normalize_roster_value": ("roster_value_cleanup", ["p_partkey", "name", "locality", "province"]),
    "clean_locality": ("roster_value_cleanup", ["p_partkey", "place"]),
    "title_case": ("roster_value_cleanup", ["p_partkey", "title"]),
    "extract_date": ("roster_value_cleanup", ["p_partkey", "date"]),
    "extract_expediente": ("roster_value_cleanup", ["p_partkey", "reference"]),
    "strip_fences": ("text_cleanups", ["doc_id", "unfenced"]),
    "sanitize_file_name": ("text_cleanups", ["doc_id", "file_name"]),
    "sanitize_error": ("text_cleanups", ["doc_id", "error"]),
    "truncate_example": ("text_cleanups", ["doc_id", "example"]),
    "client_slug": ("text_cleanups", ["doc_id", "slug"]),
    "mask_email": ("small_text_functions", ["event_id", "masked"]),
    "file_stamp": ("small_text_functions", ["event_id", "stamp"]),
    "day_start": ("small_text_functions", ["event_id", "day"]),
    "month_start": ("small_text_functions", ["event_id", "month"]),
    "expires_end_of_day": ("small_text_functions", ["event_id", "expires"]),
    "client_key": ("small_text_functions", ["event_id", "client_key"]),
    "round_confidence": ("small_text_functions", ["event_id", "conf"]),
    "normalize_confidence": ("small_text_functions", ["event_id", "norm_conf"]),
    "format_page_range": ("chunk_pages", ["doc_id", "chunk_index", "page_range"]),
}


def _narrow() -> None:
    for name, (base, columns) in NARROWED.items():
        module = next(m for m in _SOURCES if base in m.QUERIES)
        QUERIES[name] = lambda spark, sf, q=module.QUERIES[base], c=columns: q(spark, sf).select(*c)
        listed = ", ".join(f'"{c}"' for c in columns)
        ORACLES[name] = f"SELECT {listed} FROM ({module.ORACLES[base]}) narrowed"


_narrow()


@query("union_error_rows", f"SELECT doc_id, part, title, page FROM ({table_queries.ORACLES['merge_chunks']}) m")
def union_error_rows(spark, sf):
    return table_queries.merge_chunks(spark, sf).select("doc_id", "part", "title", "page")


@query("first_non_empty", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '' END AS value FROM part")
def first_non_empty(spark, sf):
    k = F.col("p_partkey") % 3
    return C.table(spark, sf, "part").select("p_partkey", X.first_non_empty(
        F.when(k == 0, F.concat(F.lit(" "), "p_name", F.lit("\n"))), F.when(k == 1, F.col("p_brand")).otherwise(" "), F.lit(None).cast("string")).alias("value"))


@query("norm_mapped", "SELECT doc_id, md5(lower(regexp_replace(strip_accents(text), '[^A-Za-z0-9]', ' ', 'g'))) AS mapped, length(text) AS n FROM documents")
def norm_mapped(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.md5(T.fold_same_length("text")).alias("mapped"), F.length(T.fold_same_length("text")).alias("n"))


@query("clean_cell", f"SELECT doc_id, md5({D.collapse('text')}) AS cell FROM documents")
def clean_cell(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.md5(T.clean_cell(F.replace("text", F.lit("\n"), F.lit("\x07\t")))).alias("cell"))


@query("clean_ocr_line", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' Salta' WHEN 1 THEN '' WHEN 2 THEN '' ELSE p_name || ' | x' END AS roster,
 CASE p_partkey % 4 WHEN 0 THEN p_name || ' SATTA' WHEN 1 THEN 'Folio 3' WHEN 2 THEN '' ELSE p_name || ' x' END AS company FROM part""")
def clean_ocr_line(spark, sf):
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, F.concat("p_name", F.lit("\t https://a.b/c  SATTA"))).when(k == 1, "Folio 3 CamScanner")
           .when(k == 2, F.lit("Nombre y Apellido")).otherwise(F.concat("p_name", F.lit("  |  x Escaneado con  CamScanner"))))
    return C.table(spark, sf, "part").select("p_partkey", ids.clean_roster_line(raw).alias("roster"), ids.clean_company_line(raw).alias("company"))


_TL = f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, i) AS pos, l[i] AS line FROM (SELECT doc_id, page_number, {D.lines('text')} AS l
 FROM ({D.fill(C.MULTI_PAGES)}) t) d, unnest(generate_series(1, len(l))) g(i))"""


@query("anchor_context", f"""SELECT doc_id, line, CAST(least(4, pos - 1 - coalesce(p, 0)) AS BIGINT) AS n_behind, CAST(least(3, coalesce(n, last + 1) - pos - 1) AS BIGINT) AS n_ahead FROM
 (SELECT *, lag(pos) OVER w AS p, lead(pos) OVER w AS n FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM {_TL} x) y WHERE contains(line, 'qu') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) z""")
def anchor_context(spark, sf):
    lines = lambda t: F.transform(T.page_lines(t), lambda x: F.struct(x.alias("t"), x.contains("qu").alias("hit")))
    blocks = line_blocks(C.sql(spark, sf, C.MULTI_PAGES), lines, margin=4)
    rows = people.anchor_rows(blocks, lambda x: x["hit"], 4, 3)
    return rows.select("doc_id", F.col("line")["t"].alias("line"), F.size("behind").alias("n_behind"), F.size("ahead").alias("n_ahead"))


@query("normalize_layout_output", f"""SELECT 'm' || doc_id AS doc_id, CASE v WHEN 'cut' THEN 'AI_RESPONSE_NOT_JSON' WHEN 'schema' THEN 'AI_RESPONSE_SCHEMA_INVALID' WHEN 'bad' THEN 'AI_RESPONSE_INVALID_JSON'
 WHEN 'empty' THEN 'AI_RESPONSE_EMPTY' ELSE CASE WHEN doc_id % 2 = 0 THEN 'PROFILE_NO_VALID_ROWS' ELSE 'ok' END END AS layout_status,
 CAST(CASE WHEN v IN ('cut', 'schema', 'bad', 'empty') OR doc_id % 2 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS n_rows FROM ({table_queries.MODEL}) m GROUP BY doc_id, v""")
def normalize_layout_output(spark, sf):
    even = F.expr("CAST(substr(doc_id, 2) AS BIGINT) % 2 = 0")
    outputs = table_queries.model_outputs(spark, sf).withColumn("profile_id", F.when(even, "internal-movimiento-camiones").otherwise("internal-general"))
    out = quality.normalize_layout_output(outputs)
    return out.select("doc_id", "layout_status", F.coalesce(F.when(F.col("rows").isNotNull(), F.size("rows")), F.lit(0)).alias("n_rows"))


# --- streaming forms -------------------------------------------------------


def stream_of(spark, sf, name):
    schema = C.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")  # a pattern, as the source wants no single file


def drain(df):
    """Run a stream over what is there now into the shared folder and read the result."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = f"{shared_folder(spark)}/foliotab-stream-{uuid.uuid4().hex}"
    (df.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out")
       .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(f"{base}/out")


_LIMITED = "SELECT CAST(key AS VARCHAR) AS key, event_id, window_count, allowed, remaining, reset_at FROM (" + usage_queries.ORACLES["rate_limit_batch"] + ") b"


def limited(spark, sf, watermark):
    e = stream_of(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    out = drain(rate_limit.rate_limit_stream(e, 5, 172800, watermark))
    return out.drop("ts").withColumn("reset_at", X.micros("reset_at"))


@query("rate_limit_stream", _LIMITED)
def rate_limit_stream(spark, sf):
    return limited(spark, sf, None)


@query("rate_limit_expiry", _LIMITED)
def rate_limit_expiry(spark, sf):
    return limited(spark, sf, "1 day")


def fed(spark, parts):
    """A stream that brings each table of ``parts`` in a micro-batch of its own, in this order."""
    base = f"{shared_folder(spark)}/foliotab-feed-{uuid.uuid4().hex}"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i, part in enumerate(parts):
        part.repartition(files, F.monotonically_increasing_id()).write.parquet(f"{base}/part-{i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{base}/part-*")


def marker(rows, at, time_col):
    """One row of an own key at the time ``at``, which moves the watermark."""
    last = rows.agg(F.max(time_col).alias(time_col), F.lit(-1).alias("event_id")).withColumn(time_col, at(F.col(time_col)))
    return last.select(*[F.col(c).cast(rows.schema[c].dataType) if c in (time_col, "event_id") else F.lit(None).cast(rows.schema[c].dataType).alias(c)
                         for c in rows.columns])


@query("rate_limit_in_order", _LIMITED)
def rate_limit_in_order(spark, sf):
    """Later events first, then earlier ones; two markers let the watermark pass them all."""
    e = C.table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    late = F.col("event_id") % 3
    after = marker(e, lambda t: t + F.expr("INTERVAL 2000 DAYS"), "ts")
    stream = fed(spark, [*[e.where(late == k) for k in (2, 0, 1)], after, after])
    out = drain(rate_limit.rate_limit_stream(stream, 5, 172800, "1000 days", in_order=True)).where("event_id >= 0")
    return out.drop("ts").withColumn("reset_at", X.micros("reset_at"))


@query("rate_limit_state", f"""SELECT key, max(reset_at) AS reset_at, CAST(arg_max(window_count, (reset_at, window_count)) AS BIGINT) AS window_count FROM ({_LIMITED}) b
 GROUP BY key HAVING max(reset_at) > (SELECT max(epoch_us(ts)) - 86400000000 FROM events)""")
def rate_limit_state(spark, sf):
    """The windows that the state still holds when the watermark has passed all others."""
    e = C.table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    now = marker(e, lambda t: t, "ts")
    base = f"{shared_folder(spark)}/foliotab-stream-{uuid.uuid4().hex}"
    limits = rate_limit.rate_limit_stream(fed(spark, [e, now, now]), 5, 172800, "1 day")
    (limits.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out")
        .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    left = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "window").load()
    return left.select(F.col("key.key").alias("key"), (F.col("value.start") + 172800000000).alias("reset_at"), F.col("value.n").alias("window_count")).where(
        F.col("key").isNotNull())


def usage_stream(spark, sf):
    return stream_of(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("code_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))


@query("usage_daily_stream", usage_queries.ORACLES["usage_daily"])
def usage_daily_stream(spark, sf):
    """Update mode: open days are there too, each with its latest counts."""
    base = f"{shared_folder(spark)}/foliotab-stream-{uuid.uuid4().hex}"
    counts = usage.usage_daily_stream(usage_stream(spark, sf))
    (counts.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(usage.upsert_batches(f"{base}/out"))
        .trigger(availableNow=True).start().awaitTermination())
    out = usage.latest_rows(spark.read.parquet(f"{base}/out"), ["code_id", "day"])
    return out.withColumns({"day": X.micros("day"), "month": X.micros("month")})


@query("usage_dedupe_stream", "SELECT event_id, user_id AS code_id FROM events")
def usage_dedupe_stream(spark, sf):
    twice = usage_stream(spark, sf).unionByName(usage_stream(spark, sf))
    return drain(usage.usage_dedupe_stream(twice)).select("event_id", "code_id")


@query("usage_monthly_stream", """SELECT CAST(user_id AS VARCHAR) AS code_id, epoch_us(date_trunc('month', ts)) AS month,
 count(*) FILTER (event_type <> 'error' OR event_type IS NULL) AS successes, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2""")
def usage_monthly_stream(spark, sf):
    """Markers after the last month close it."""
    e = C.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("code_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
    after = [marker(e, lambda t, d=d: t + F.expr(f"INTERVAL {d} DAYS"), "created_at") for d in (100, 200, 300)]
    out = drain(usage.usage_monthly_stream(fed(spark, [e, *after])))
    return out.where("code_id is not null").withColumn("month", X.micros("month"))


@query("append_usage_stream", "SELECT event_id, user_id AS code_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def append_usage_stream(spark, sf):
    """The events come twice, from two streams; each is stored once."""
    base = f"{shared_folder(spark)}/foliotab-stream-{uuid.uuid4().hex}"
    for run in range(2):
        (usage_stream(spark, sf).writeStream.option("checkpointLocation", f"{base}/state-{run}").foreachBatch(usage.append_batches(f"{base}/out"))
            .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{base}/out").select("event_id", "code_id", F.col("day").cast("string").alias("day"))
