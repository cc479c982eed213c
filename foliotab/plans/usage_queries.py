"""Usage, quota, access and dashboard queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X
from ..operators import routing, usage
from ..operators.storage import shared_folder
from ..sources import sinks
from . import duck as D
from .corpora import CLIENTS, CODES, NOW, PLAN_VALUES, USAGE, plan_dimension, sql, table
from .registry import registry

E, C, K, P = (f"({D.fill(t)})" for t in (USAGE, CLIENTS, CODES, PLAN_VALUES))
SUCCESS = "status = 'success'"
DAY0, MONTH0 = "TIMESTAMP '2024-01-20 00:00:00'", "TIMESTAMP '2024-01-01 00:00:00'"

QUERIES, ORACLES, query = registry()


def at():
    return F.lit(NOW).cast("timestamp")


def micros(df, *columns):
    return df.withColumns({c: X.micros(c) for c in columns})


def limits(spark, sf):
    return sql(spark, sf, CODES).join(plan_dimension(spark), "plan_name").select("code_id", "daily_limit", "monthly_limit")


@query("quota_usage", f"""
 SELECT k.code_id, daily_limit, monthly_limit, coalesce(d, 0) AS daily_usage, coalesce(m, 0) AS monthly_usage,
  coalesce(d, 0) < daily_limit AND coalesce(m, 0) < monthly_limit AS allowed
 FROM {K} k JOIN {P} p USING (plan_name) LEFT JOIN (SELECT code_id, count(*) FILTER (created_at >= {DAY0}) AS d, count(*) AS m
  FROM {E} e WHERE {SUCCESS} AND created_at >= {MONTH0} GROUP BY 1) u ON u.code_id = k.code_id""")
def quota_usage(spark, sf):
    return usage.quota_usage(sql(spark, sf, USAGE), limits(spark, sf), at())


@query("quota_decisions", f"""
 SELECT event_id, e.code_id, status, prior_day, prior_month, prior_day < daily_limit AND prior_month < monthly_limit AS allowed
 FROM (SELECT *, count(*) FILTER ({SUCCESS}) OVER (PARTITION BY code_id, date_trunc('day', created_at) ORDER BY created_at, event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_day,
  count(*) FILTER ({SUCCESS}) OVER (PARTITION BY code_id, date_trunc('month', created_at) ORDER BY created_at, event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_month FROM {E} x) e
 JOIN {K} k ON k.code_id = e.code_id JOIN {P} p USING (plan_name)""")
def quota_decisions(spark, sf):
    return usage.quota_decisions(sql(spark, sf, USAGE), limits(spark, sf)).select(
        "event_id", "code_id", "status", "prior_day", "prior_month", "allowed")


@query("rate_limit_batch", """
 WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT user_id, event_id, us, rn, us AS start, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.rn, CASE WHEN r.start + 172800000000 <= e.us THEN e.us ELSE r.start END,
   CASE WHEN r.start + 172800000000 <= e.us THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
 SELECT user_id AS key, event_id, CAST(n AS BIGINT) AS window_count, n <= 5 AS allowed, CAST(greatest(5 - n, 0) AS BIGINT) AS remaining,
  start + 172800000000 AS reset_at FROM r""")
def rate_limit_batch(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return micros(usage.rate_limit_batch(events, 5, 172800).drop("ts"), "reset_at")


@query("admin_summary", f"""
 SELECT (SELECT count(*) FROM {C} c WHERE client_status = 'active') AS active_clients,
  (SELECT count(*) FROM {K} k WHERE code_status = 'active') AS active_codes,
  count(*) FILTER ({SUCCESS} AND created_at >= {DAY0}) AS usage_today, count(*) FILTER ({SUCCESS}) AS usage_month,
  count(*) FILTER (status = 'error') AS errors_month FROM {E} e WHERE created_at >= {MONTH0}""")
def admin_summary(spark, sf):
    return usage.admin_summary(sql(spark, sf, USAGE), sql(spark, sf, CLIENTS), sql(spark, sf, CODES), at())


@query("client_month_usage", f"""
 SELECT c.client_id, client_name, client_status, c.plan_name, daily_limit, coalesce(n, 0) AS month_usage FROM {C} c
 LEFT JOIN {P} p ON p.plan_name = c.plan_name LEFT JOIN (SELECT client_id, count(*) AS n FROM {E} e
  WHERE {SUCCESS} AND created_at >= {MONTH0} GROUP BY 1) u ON u.client_id = c.client_id""")
def client_month_usage(spark, sf):
    return usage.client_month_usage(sql(spark, sf, CLIENTS), plan_dimension(spark), sql(spark, sf, USAGE), at()).select(
        "client_id", "client_name", "client_status", "plan_name", "daily_limit", "month_usage")


@query("last_used", f"SELECT code_id, epoch_us(max(created_at)) AS last_used_at FROM {E} e GROUP BY 1")
def last_used(spark, sf):
    return micros(usage.last_used(sql(spark, sf, USAGE)), "last_used_at")


@query("recent_events", f"SELECT event_id, code_id, status FROM {E} e ORDER BY created_at DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf):
    return usage.recent(sql(spark, sf, USAGE)).select("event_id", "code_id", "status")


@query("recent_codes", f"SELECT code_id, plan_name, code_status FROM {K} k ORDER BY first_seen DESC, code_id DESC LIMIT 50")
def recent_codes(spark, sf):
    return usage.recent(sql(spark, sf, CODES), "first_seen", "code_id").select("code_id", "plan_name", "code_status")


@query("clients_by_date", f"SELECT client_id, client_name FROM {C} c ORDER BY client_id DESC")
def clients_by_date(spark, sf):
    return usage.clients_by_date(sql(spark, sf, CLIENTS)).select("client_id", "client_name")


@query("plans_by_limit", f"""SELECT p.plan_name, daily_limit, count(c.client_id) AS clients FROM {P} p
 LEFT JOIN {C} c ON c.plan_name = p.plan_name WHERE is_active GROUP BY ALL ORDER BY daily_limit""")
def plans_by_limit(spark, sf):
    used = sql(spark, sf, CLIENTS).groupBy("plan_name").agg(F.count("*").alias("clients"))
    plans = plan_dimension(spark).join(used, "plan_name", "left").fillna(0, ["clients"])
    return usage.plans_by_limit(plans).select("plan_name", "daily_limit", "clients")


@query("usage_context", f"""SELECT k.code_id, c.client_name, k.plan_name, daily_limit, max_pdf_mb FROM {K} k
 JOIN {C} c ON c.client_id = k.client_id JOIN {P} p ON p.plan_name = k.plan_name""")
def usage_context(spark, sf):
    clients = sql(spark, sf, CLIENTS).drop("plan_name")
    return usage.usage_context(sql(spark, sf, CODES), clients, plan_dimension(spark)).select(
        "code_id", "client_name", "plan_name", "daily_limit", "max_pdf_mb")


@query("code_eligibility", f"""SELECT code_id, CASE WHEN code_status <> 'active' THEN 'code_inactive'
 WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'code_expired' WHEN client_status <> 'active' OR NOT is_active THEN 'client_or_plan_inactive'
 ELSE 'ok' END AS eligibility FROM {K} k JOIN {C} c ON c.client_id = k.client_id JOIN {P} p ON p.plan_name = k.plan_name""")
def code_eligibility(spark, sf):
    ctx = usage.usage_context(sql(spark, sf, CODES), sql(spark, sf, CLIENTS).drop("plan_name"), plan_dimension(spark))
    return routing.code_eligibility(ctx.withColumnRenamed("is_active", "plan_active"), at()).select("code_id", "eligibility")


@query("code_hash_lookup", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS code_id FROM events""")
def code_hash_lookup(spark, sf):
    codes = sql(spark, sf, CODES).select("code_id", F.sha2(F.concat(F.lit("CODE-"), F.col("code_id").cast("string")), 256).alias("code_hash"))
    tries = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.lit("nope")).otherwise(
            F.concat(F.lit("  CODE-"), F.col("user_id").cast("string"), F.lit("\t"))).alias("entered"))
    return usage.code_hash_lookup(tries, codes).select("event_id", "code_id")


@query("usage_with_client", f"""SELECT e.event_id, e.status, c.client_name FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE client_id END AS cid
 FROM {E} x) e LEFT JOIN {C} c ON c.client_id = e.cid""")
def usage_with_client(spark, sf):
    events = sql(spark, sf, USAGE).withColumn("client_id", F.when(F.col("event_id") % 4 != 0, F.col("client_id")))
    return usage.usage_with_client(events, sql(spark, sf, CLIENTS)).select("event_id", "status", "client_name")


@query("usage_daily", f"""SELECT code_id, epoch_us(date_trunc('day', created_at)) AS day, epoch_us(CAST(date_trunc('month', created_at) AS TIMESTAMP)) AS month,
 count(*) FILTER ({SUCCESS}) AS successes, count(*) FILTER (status = 'error') AS errors FROM {E} e GROUP BY 1, 2, 3""")
def usage_daily(spark, sf):
    from ..streaming.usage import usage_daily_stream

    return micros(usage_daily_stream(sql(spark, sf, USAGE)), "day", "month")


@query("append_usage_events", """SELECT event_id, CASE WHEN test THEN NULL ELSE user_id END AS access_code_id,
 CASE WHEN test AND event_id % 2 = 0 THEN 'internal-test' WHEN test THEN 'internal-test:NOMINA' WHEN event_id % 2 = 0 THEN NULL ELSE 'NOMINA' END AS extraction_kind
 FROM (SELECT *, event_id % 5 = 0 AS test FROM events) e WHERE event_id % 7 <> 1 OR test""")
def append_usage_events(spark, sf):
    e = table(spark, sf, "events")
    test, k = F.col("event_id") % 5 == 0, F.col("event_id")
    results = e.select(
        "event_id", F.when(~test & (k % 7 != 1), F.col("user_id")).alias("access_code_id"), test.alias("is_internal_test"),
        F.when(k % 2 == 1, F.lit("NOMINA")).alias("extraction_kind"))
    return usage.usage_event_rows(results).drop("is_internal_test")


@query("size_limit_check", f"""SELECT doc_id, mime, limit_mb, CASE WHEN size_bytes <= 0 THEN 'empty' WHEN size_bytes > limit_mb * 1048576 THEN 'too_large' ELSE 'ok' END AS size_status
 FROM (SELECT *, CASE mime WHEN 'application/pdf' THEN least(50, max_pdf_mb) WHEN 'image/png' THEN least(50, max_image_mb) ELSE 50 END AS limit_mb
 FROM (SELECT doc_id, (doc_id * 7919) % 60000000 AS size_bytes, CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE '' END AS mime,
  CASE doc_id % 2 WHEN 0 THEN 'Demo' ELSE 'Basico' END AS plan_name FROM documents) d JOIN {P} p USING (plan_name)) q""")
def size_limit_check(spark, sf):
    docs = sql(spark, sf, """SELECT doc_id, (doc_id * 7919) % 60000000 AS size_bytes, CASE doc_id % 3 WHEN 0 THEN 'application/pdf'
      WHEN 1 THEN 'image/png' ELSE '' END AS mime_type, CASE doc_id % 2 WHEN 0 THEN 'Demo' ELSE 'Basico' END AS plan_name FROM {documents}""")
    return routing.size_limit_check(docs.join(plan_dimension(spark), "plan_name")).select(
        "doc_id", F.col("mime_type").alias("mime"), "limit_mb", "size_status")


@query("load_plans", """SELECT plan_name, daily_limit, clients FROM (VALUES ('Demo', 5), ('Piloto', 20), ('Basico', 50), ('Profesional', 150), ('Empresa', 9999)) v(plan_name, daily_limit)
 LEFT JOIN (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'Demo' ELSE c_mktsegment END AS plan_name, count(*) AS clients FROM customer GROUP BY 1) USING (plan_name)
 WHERE plan_name <> 'Demo' UNION ALL SELECT c_mktsegment, 1, count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1
 UNION ALL SELECT 'Demo', 5, NULL""")
def load_plans(spark, sf):
    existing = table(spark, sf, "customer").groupBy(
        F.when(F.col("c_mktsegment") == "BUILDING", "Demo").otherwise(F.col("c_mktsegment")).alias("plan_name")
    ).agg(F.lit(1).alias("daily_limit"), F.count("*").alias("clients"))
    return routing.upsert_plans(existing, plan_dimension(spark).select("plan_name", "daily_limit")).select("plan_name", "daily_limit", "clients")


ERRORS = """SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'ProfileExtractionValidationError bad table' WHEN 1 THEN '429 Too Many Requests'
 WHEN 2 THEN 'Unexpected token ''<'', "<!DOCTYPE" is not JSON' WHEN 3 THEN 'AiOutputQualityError: low' WHEN 4 THEN 'OCR_QUALITY_GATE_FAILED: x'
 WHEN 5 THEN 'OCR processing timed out' WHEN 6 THEN 'GoogleAiTemporaryError overloaded 503' WHEN 7 THEN 'StructuredOutputError: parse'
 WHEN 8 THEN 'Google Document AI processing failed' WHEN 9 THEN 'read ECONNRESET' WHEN 10 THEN 'status code 15031' WHEN 11 THEN 'socket timeout' ELSE NULL END AS error_text FROM {events}"""
_LOW = "lower(coalesce(error_text, ''))"
_any = lambda words: "(" + " OR ".join(f"contains({_LOW}, '" + w.replace("'", "''") + "')" for w in words) + ")"


@query("classify_error", """SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'profile_validation' WHEN 1 THEN 'quota' WHEN 2 THEN 'html_leak' WHEN 3 THEN 'low_quality'
 WHEN 4 THEN 'quality_gate' WHEN 5 THEN 'timeout' WHEN 6 THEN 'temporary' WHEN 7 THEN 'structured_output' WHEN 8 THEN 'advanced_reader' ELSE 'other' END AS error_class,
 event_id % 13 IN (1, 5, 6, 9, 11) AS retryable FROM events""")
def classify_error(spark, sf):
    return routing.classify_error(sql(spark, sf, ERRORS)).select("event_id", "error_class", "retryable")


EXAMPLES = """SELECT o_orderkey AS example_id, concat('profile-', o_custkey % 50) AS profile_code, o_orderdate AS created_at,
 concat('a,b', chr(10), o_orderkey, ',', o_orderpriority) AS corrected_csv, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS notes,
 CAST(NULL AS VARCHAR(10)) AS original_csv FROM {orders}"""
_X = f"({D.fill(EXAMPLES)})"
_TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_code ORDER BY created_at DESC, example_id DESC) AS rank FROM {_X} x) q WHERE rank <= 3)"


@query("top_examples", f"SELECT profile_code, example_id, rank FROM {_TOP} t")
def top_examples(spark, sf):
    return usage.top_examples(sql(spark, sf, EXAMPLES)).select("profile_code", "example_id", "rank")


_BLOCK = f"""SELECT profile_code, string_agg(concat('Ejemplo corregido ', rank, ':', chr(10), CASE WHEN notes <> '' THEN concat('Notas: ', notes, chr(10)) ELSE '' END,
 'Salida corregida esperada:', chr(10), corrected_csv), chr(10) || chr(10) ORDER BY rank) AS examples FROM {_TOP} t GROUP BY 1"""


@query("format_examples", _BLOCK)
def format_examples(spark, sf):
    return usage.format_examples(sql(spark, sf, EXAMPLES))


@query("correction_examples_for", f"""SELECT c_custkey AS doc_id, examples FROM customer LEFT JOIN ({_BLOCK}) b ON b.profile_code = concat('profile-', c_custkey % 70)""")
def correction_examples_for(spark, sf):
    docs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.concat(F.lit("profile-"), (F.col("c_custkey") % 70).cast("string")).alias("profile_id"))
    return usage.correction_examples_for(docs, sql(spark, sf, EXAMPLES)).select("doc_id", "examples")


@query("save_correction_examples", """SELECT profile_code, count(*) AS examples, count(*) FILTER (bad = 0) AS with_json FROM
 (SELECT concat('profile-', event_id % 8) AS profile_code, CAST(event_id % 6 = 0 AS INT) AS bad FROM events) e GROUP BY 1""")
def save_correction_examples(spark, sf):
    raw = table(spark, sf, "events").select(
        F.concat(F.lit("profile-"), (F.col("event_id") % 8).cast("string")).alias("profile_code"),
        F.when(F.col("event_id") % 6 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("corrected_json"))
    path = f"{shared_folder(spark)}/corrections-{uuid.uuid4().hex}"
    sinks.save_correction_examples(raw.withColumn("original_json", F.lit(None).cast("string")), path)
    return spark.read.parquet(path).groupBy("profile_code").agg(F.count("*").alias("examples"), F.count("corrected_json").alias("with_json"))


@query("correction_paths", """SELECT profile_code, k, count(*) AS examples, count(*) FILTER (bad) AS malformed FROM (SELECT concat('profile-', event_id % 8) AS profile_code,
 event_id % 6 = 0 AS bad, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) % 10 END AS k FROM events) e GROUP BY 1, 2""")
def correction_paths(spark, sf):
    """Examples are written with variants, read back, and grouped by one path."""
    raw = table(spark, sf, "events").select(
        F.concat(F.lit("profile-"), (F.col("event_id") % 8).cast("string")).alias("profile_code"), F.col("props").alias("original_json"),
        F.when(F.col("event_id") % 6 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("corrected_json"))
    path = f"{shared_folder(spark)}/corrections-{uuid.uuid4().hex}"
    sinks.save_correction_examples(raw, path)
    saved = spark.read.parquet(path)
    k = sinks.correction_values(saved, "corrected_json", "$.k", "bigint") % 10
    bad = F.col("malformed")["corrected_json"] == '{"k": '
    return saved.groupBy("profile_code", k.alias("k")).agg(F.count("*").alias("examples"), F.count_if(bad).alias("malformed"))


@query("small_text_functions", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a***@x.com' ELSE concat(left(concat('user', user_id), 2), '***@x.com') END AS masked,
 concat('OCR_NOMINA_', strftime(ts, '%Y%m%d_%H%M'), '.csv') AS stamp, epoch_us(date_trunc('day', ts)) AS day, epoch_us(CAST(date_trunc('month', ts) AS TIMESTAMP)) AS month,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE epoch_us(date_trunc('day', ts)) + 86399999000 END AS expires,
 CASE event_id % 3 WHEN 0 THEN concat('u', user_id) WHEN 1 THEN '10.0.0.1' ELSE 'unknown' END AS client_key,
 floor(greatest(0, least(1, value / 100)) * 100 + 0.5) / 100 AS conf, CASE WHEN value > 1 THEN least(1, value / 100) ELSE value END AS norm_conf FROM events""")
def small_text_functions(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    e = e.withColumns({
        "mail": F.when(k % 3 == 0, F.lit("a@x.com")).otherwise(F.concat(name, F.lit("@x.com"))),
        "ukey": F.when(k % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        "fwd": F.when(k % 3 == 1, F.lit(" 10.0.0.1 , 10.0.0.2")).otherwise(F.lit("")), "real": F.lit(""),
        "exp": F.when(k % 4 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd")),
    })
    return e.select(
        "event_id", T.mask_email("mail").alias("masked"), X.file_stamp(F.lit("NOMINA"), "ts").alias("stamp"),
        X.micros(X.day_start("ts")).alias("day"), X.micros(X.month_start("ts")).alias("month"),
        X.micros(X.expires_end_of_day("exp")).alias("expires"), X.client_key("ukey", "fwd", "real").alias("client_key"),
        X.round_confidence(F.col("value") / 100).alias("conf"), X.normalize_confidence(F.col("value").cast("string")).alias("norm_conf"))


