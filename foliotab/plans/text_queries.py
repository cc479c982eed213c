"""Lines, page texts, document types, profiles and routes over document tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import ids
from ..functions import text as T
from ..functions import values as X
from ..operators import chunks, quality, routing, signals
from ..operators.storage import shared_folder
from ..sources import files, pages, sinks
from . import duck as D
from .corpora import MULTI_PAGES, SINGLE_PAGES, TYPED_DOCS, sql, table
from .registry import registry

QUERIES, ORACLES, query = registry()
DOCS = f"({D.fill(TYPED_DOCS)})"
TURNS = f"({D.fill(MULTI_PAGES)})"
SINGLE = f"({D.fill(SINGLE_PAGES)})"


def docs(spark, sf):
    return sql(spark, sf, TYPED_DOCS)


# --- sources ---------------------------------------------------------------


@query("explode_lines", f"""SELECT doc_id, CAST(1 AS BIGINT) AS page_number, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM
 (SELECT doc_id, {D.lines("text")} AS l FROM documents) d, unnest(generate_series(1, len(l))) g(i)""")
def explode_lines(spark, sf):
    return pages.explode_lines(sql(spark, sf, SINGLE_PAGES))


@query("normalize_pages", f"SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, array_to_string({D.lines('text')}, chr(10)) AS text FROM {TURNS} t")
def normalize_pages(spark, sf):
    return pages.normalize_pages(sql(spark, sf, MULTI_PAGES))


@query("document_text_lengths", f"""SELECT doc_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS total_text_length, sum(n) > 0 AS has_text FROM
 (SELECT doc_id, length(array_to_string({D.lines('text')}, chr(10))) AS n FROM {TURNS} t) q GROUP BY 1""")
def document_text_lengths(spark, sf):
    return pages.document_text_lengths(sql(spark, sf, MULTI_PAGES))


def word_items(spark, sf):
    lines = pages.explode_lines(sql(spark, sf, MULTI_PAGES))
    words = lines.select("doc_id", "page_number", "line_no", F.size(F.split("line", " ")).alias("n"), F.posexplode(F.split("line", " ")).alias("p", "text"))
    return words.select(
        "doc_id", "page_number", (F.col("line_no") * 100000 + F.col("p")).alias("item_no"), "text",
        (F.col("p") == F.col("n") - 1).alias("eol"))


@query("items_to_lines", f"""SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, l[i] AS line FROM
 (SELECT doc_id, page_number, {D.lines("text")} AS l FROM {TURNS} t) d, unnest(generate_series(1, len(l))) g(i)""")
def items_to_lines(spark, sf):
    return pages.items_to_lines(word_items(spark, sf)).select("doc_id", "page_number", "line")


SEGMENTS = f"""SELECT doc_id, i, s FROM (SELECT doc_id, i, {D.collapse("l[i]")} AS s FROM
 (SELECT doc_id, list_prepend(concat('Doc (', doc_id, ') A'), string_split_regex(text, '\\n')) AS l FROM documents) d, unnest(generate_series(1, len(l))) g(i)) x
 WHERE length(s) >= 3 AND {D.count("s", "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]")} / length(s) >= 0.45"""


@query("scan_pdf_text", f"""SELECT doc_id, count(*) AS segments, string_agg(s, chr(10) ORDER BY i) AS text FROM
 (SELECT doc_id, s, min(i) AS i FROM ({SEGMENTS}) y GROUP BY 1, 2) z GROUP BY 1""")
def scan_pdf_text(spark, sf):
    hexes = F.transform(F.split("text", "\n", -1), lambda s: F.concat(F.lit("<FEFF"), F.hex(F.encode(s, "UTF-16BE")), F.lit("> Tj")))
    label = F.concat(F.lit("%PDF-1.4 BT (Doc \\("), F.col("doc_id").cast("string"), F.lit("\\)\\n\\101) Tj "))
    raw = F.encode(F.concat(label, F.array_join(hexes, " "), F.lit(" ET")), "ISO-8859-1")
    out = files.scan_pdf_text(table(spark, sf, "documents").select("doc_id", raw.alias("content")))
    return out.select("doc_id", "segments", "text")


MIME = """CASE WHEN m = 'image/jpg' THEN 'image/jpeg' WHEN m IN ('application/pdf', 'image/jpeg', 'image/png') THEN m
 WHEN n LIKE '%.pdf' THEN 'application/pdf' WHEN n LIKE '%.jpg' OR n LIKE '%.jpeg' THEN 'image/jpeg' WHEN n LIKE '%.png' THEN 'image/png' ELSE '' END"""
MIMED = f"(SELECT *, {MIME} AS mime_type FROM (SELECT *, lower(trim(declared)) AS m, lower(file_name) AS n FROM {DOCS} d) x)"


@query("scan_files")
def scan_files(spark, sf):
    return files.scan_files(spark, sf, keep_unsupported=True).select("file_name", "mime_type", "length")


@query("supported_mime", f"SELECT doc_id, mime_type FROM {MIMED} q")
def supported_mime(spark, sf):
    return docs(spark, sf).select("doc_id", X.supported_mime("declared", "file_name").alias("mime_type"))


# --- document type, kind, profile ------------------------------------------

_NAME = f"lower({D.fold('file_name')})"
_kw = lambda t: f"regexp_matches({_NAME}, '{'|'.join(V.FILE_NAME_KEYWORDS[t])}')"
TYPE = f"CASE WHEN {_kw('table')} THEN 'table' WHEN {_kw('invoice')} THEN 'invoice' WHEN {_kw('report')} THEN 'report' ELSE 'auto' END"


@query("detect_document_type", f"""SELECT doc_id, t AS detected_type, CASE t WHEN 'table' THEN 'high' WHEN 'invoice' THEN 'high' WHEN 'report' THEN 'medium' ELSE 'low' END AS type_confidence
 FROM (SELECT doc_id, {TYPE} AS t FROM {DOCS} d) q""")
def detect_document_type(spark, sf):
    return routing.detect_document_type(docs(spark, sf)).select("doc_id", "detected_type", "type_confidence")


def _signals(name):
    return D.contains_count("w", [T.py_words(s) for s in V.CLASSIFIER_SIGNALS[name]])


COUNTS = f"""SELECT doc_id, file_name, text, {D.count("w", chr(92) + "b(s r l|s a|sociedad anonima|sociedad de responsabilidad limitada)" + chr(92) + "b")} AS company,
 {D.count("raw", chr(92) + "b" + chr(92) + "d{2}-" + chr(92) + "d{8}-" + chr(92) + "d" + chr(92) + "b")} AS cuit,
 {D.count("regexp_replace(raw, '" + chr(92) + "b" + chr(92) + "d{2}-" + chr(92) + "d{8}-" + chr(92) + "d" + chr(92) + "b', ' ', 'g')", chr(92) + "b" + chr(92) + "d{7,8}" + chr(92) + "b")} AS dni,
 {D.count("w", chr(92) + "b" + chr(92) + "d{2}[- ]?" + chr(92) + "d{7,8}[- ]?" + chr(92) + "d" + chr(92) + "b")} AS cuil,
 {", ".join(f"{_signals(n)} AS {n}" for n in V.CLASSIFIER_SIGNALS)}
 FROM (SELECT *, {D.words("raw")} AS w FROM (SELECT doc_id, file_name, text, concat(file_name, chr(10), text) AS raw FROM {DOCS} d) r) s"""
PROFILE = f"""SELECT *, CASE WHEN company >= 1 AND cuit >= 1 AND dni >= 2 AND location >= 1 THEN 'internal-personal-empresa-localidad'
 WHEN roster >= 4 OR (roster >= 2 AND cuil >= 5) OR cuil > 100 THEN 'internal-nomina-personal' WHEN movement >= 5 THEN 'internal-movimiento-camiones'
 WHEN operating >= 3 THEN 'internal-dtve-senasa-arca' WHEN commercial >= 2 THEN 'internal-comprobante-generico'
 WHEN technical >= 2 THEN 'internal-documento-tecnico-administrativo' WHEN "table" >= 4 THEN 'internal-tabla-administrativa' ELSE 'internal-general' END AS profile_id FROM ({COUNTS.replace(" AS table", ' AS "table"')}) c"""


@query("match_signals", f"""SELECT doc_id, company AS company_matches, cuit AS cuit_matches, dni AS dni_matches, cuil AS cuil_matches,
 {", ".join(f'CAST("{n}" AS BIGINT) AS {n}_signals' for n in V.CLASSIFIER_SIGNALS)} FROM ({COUNTS.replace(" AS table", ' AS "table"')}) c""")
def match_signals(spark, sf):
    return routing.signal_counts(docs(spark, sf)).drop("file_name", "declared", "size_bytes", "text")


#: A dictionary of one-, two- and three-word signals: the first words of every part name, benchmark passage and turn.
SIGNALS = """SELECT DISTINCT k AS signal_group, array_to_string(list_slice(w, 1, k), ' ') AS signal FROM (SELECT string_split(x, ' ') AS w FROM (
 SELECT p_name AS x FROM part UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations) t) s, (VALUES (1), (2), (3)) n(k)"""


@query("match_signal_table", f"""SELECT doc_id, signal_group, count(*) AS matched FROM (SELECT doc_id, {D.words("text")} AS body FROM documents) d
 JOIN (SELECT signal_group, signal, {D.words("signal")} AS needle FROM ({SIGNALS}) s) k ON needle <> '' AND contains(body, needle) GROUP BY 1, 2""")
def match_signal_table(spark, sf):
    first = "SELECT DISTINCT k AS signal_group, array_join(slice(w, 1, k), ' ') AS signal FROM (SELECT split(x, ' ') AS w FROM (SELECT p_name AS x FROM {part} " \
            "UNION ALL SELECT text FROM {benchmark} UNION ALL SELECT text FROM {conversations})) LATERAL VIEW explode(array(1, 2, 3)) n AS k"
    return signals.signal_groups(table(spark, sf, "documents"), sql(spark, sf, first))


@query("classify_profile", f"""SELECT doc_id, profile_id, CASE profile_id WHEN 'internal-personal-empresa-localidad' THEN CASE WHEN dni >= 10 THEN 'high' ELSE 'medium' END
 WHEN 'internal-nomina-personal' THEN CASE WHEN roster >= 5 OR cuil > 100 THEN 'high' ELSE 'medium' END
 WHEN 'internal-movimiento-camiones' THEN CASE WHEN movement >= 6 THEN 'high' ELSE 'medium' END
 WHEN 'internal-dtve-senasa-arca' THEN CASE WHEN operating >= 5 THEN 'high' ELSE 'medium' END
 WHEN 'internal-comprobante-generico' THEN CASE WHEN commercial >= 4 THEN 'high' ELSE 'medium' END
 WHEN 'internal-documento-tecnico-administrativo' THEN CASE WHEN technical >= 4 THEN 'high' ELSE 'medium' END
 WHEN 'internal-tabla-administrativa' THEN 'medium' ELSE 'low' END AS profile_confidence FROM ({PROFILE}) p""")
def classify_profile(spark, sf):
    return routing.classify_profile(docs(spark, sf)).select("doc_id", "profile_id", "profile_confidence")


_KIND = """CASE profile_id WHEN 'internal-documento-tecnico-administrativo' THEN 'report' WHEN 'internal-dtve-senasa-arca' THEN 'invoice'
 WHEN 'internal-comprobante-generico' THEN 'invoice' WHEN 'internal-general' THEN 'auto' ELSE 'table' END"""


@query("resolve_document_type", f"SELECT doc_id, CASE WHEN {TYPE} <> 'auto' THEN {TYPE} ELSE {_KIND} END AS document_type FROM ({PROFILE}) p")
def resolve_document_type(spark, sf):
    d = routing.detect_document_type(routing.classify_profile(docs(spark, sf)))
    return d.select("doc_id", routing.resolve_document_type("detected_type", "profile_id").alias("document_type"))


_T = D.collapse("text")
_IGN = "(" + " OR ".join(f"contains({D.search('text')}, '{T.py_search(i)}')" for i in V.IGNORED_TEXTS) + ")"
_DENS = f"{D.count(_T, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]')} / greatest(length({_T}), 1) >= 0.45"
RELIABLE = f"length({_T}) >= 500 AND {_DENS} AND {D.count(_T, '[' + chr(0xFFFD) + 'ÂÃ]')} / greatest(length({_T}), 1) < 0.02"


@query("reliable_text", f"SELECT doc_id, {RELIABLE} AS reliable FROM {DOCS} d")
def reliable_text(spark, sf):
    return docs(spark, sf).select("doc_id", routing.reliable_text("text", F.array()).alias("reliable"))


@query("table_signals", f"SELECT doc_id, {D.contains_count(D.search('text'), V.GENERIC_TABLE_WORDS)} >= 4 AS has_table_signals FROM {DOCS} d")
def table_signals(spark, sf):
    return docs(spark, sf).select("doc_id", routing.table_signals("text").alias("has_table_signals"))


@query("ignored_text", f"""SELECT doc_id, array_to_string(list_filter([{D.strings(V.IGNORED_TEXTS)}], lambda i: contains(t, lower(strip_accents(i)))), ';') AS found
 FROM (SELECT doc_id, {D.search('text')} AS t FROM {DOCS} d) q""")
def ignored_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.ignored_texts("text"), ";").alias("found"))


def kinds(spark, sf):
    d = routing.classify_profile(docs(spark, sf)).withColumn("mime_type", X.supported_mime("declared", "file_name"))
    return routing.document_kind(d)


_MV = "profile_id = 'internal-movimiento-camiones'"
_EXPECT = " OR ".join(
    f"(profile_id = '{p[0]}' AND {D.contains_count(D.search('text'), [T.py_search(c) for c in p[3]])} >= 4)" for p in V.PROFILES if p[3])
KINDED = f"""SELECT *, CASE WHEN pdf THEN {RELIABLE} AND NOT ignored ELSE false END AS reliable,
 pdf AND ({_EXPECT} OR {D.contains_count(D.search('text'), V.GENERIC_TABLE_WORDS)} >= 4) AS has_table_signals FROM
 (SELECT p.*, m.mime_type, m.size_bytes, m.mime_type = 'application/pdf' AS pdf, {_MV} AND m.mime_type = 'application/pdf' AND {_IGN.replace("text", "p.text")} AS ignored
  FROM ({PROFILE}) p JOIN (SELECT doc_id, mime_type, size_bytes FROM {MIMED} z) m USING (doc_id)) k"""
KIND_CASE = """CASE WHEN mime_type IN ('image/jpeg', 'image/png') THEN 'image' WHEN pdf AND reliable THEN 'digital_pdf' WHEN pdf THEN 'scanned_pdf' ELSE 'unknown' END"""


@query("document_kind", f"""SELECT doc_id, {KIND_CASE} AS document_kind, has_table_signals, pdf AND (NOT reliable OR ignored) AS scanned_text_warning,
 CAST(CASE WHEN NOT pdf THEN 1 ELSE CAST(NOT reliable AS INT) + CAST(ignored AS INT) +
  CAST(NOT has_table_signals AND profile_id IN ('internal-movimiento-camiones', 'internal-personal-empresa-localidad', 'internal-nomina-personal') AS INT) END AS BIGINT) AS n_warnings
 FROM ({KINDED}) q""")
def document_kind(spark, sf):
    return kinds(spark, sf).select("doc_id", "document_kind", "has_table_signals", "scanned_text_warning", F.size("warnings").alias("n_warnings"))


ROUTE_SQL = f"""SELECT *, {KIND_CASE} AS kind, CAST(1 + length(text) // 3000 AS BIGINT) AS page_count, length(text) AS text_length FROM ({KINDED}) q"""


def routed(spark, sf):
    d = kinds(spark, sf).withColumns({
        "page_count": F.floor(F.length("text") / 3000) + 1, "text_length": F.length("text"), "known_annex": routing.known_annex("text")})
    return routing.route_strategy(d)


@query("route_strategy", f"""SELECT doc_id, CASE WHEN pdf AND kind = 'scanned_pdf' THEN 'advanced' WHEN NOT pdf THEN 'direct' WHEN {_MV} THEN 'direct_then_pages'
 WHEN size_bytes <= 2097152 THEN 'direct_then_chunks' WHEN text_length > 500 AND page_count > 5 THEN 'chunks' ELSE 'direct' END AS strategy,
 pdf AND NOT {_MV} AND text_length > 0 AS local_allowed FROM ({ROUTE_SQL}) r""")
def route_strategy(spark, sf):
    return routed(spark, sf).select("doc_id", "strategy", "local_allowed")


@query("visual_retry_eligible", f"""SELECT doc_id, trim(text) <> '' AND mime_type <> '' AND (doc_id % 4 = 0 OR mime_type <> 'application/pdf' OR kind = 'scanned_pdf'
 OR has_table_signals OR (pdf AND (NOT reliable OR ignored))) AS eligible FROM ({ROUTE_SQL}) r""")
def visual_retry_eligible(spark, sf):
    d = kinds(spark, sf).withColumns({
        "gate_failed": F.col("doc_id") % 4 == 0, "tables_detected": F.lit(None).cast("boolean"), "rotation_detected": F.lit(False)})
    return d.select("doc_id", routing.visual_retry_eligible(d).alias("eligible"))


_RESTRICTED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'automatic' WHEN 1 THEN 'allowed_profiles' WHEN 2 THEN ' Forced_Profile' ELSE 'allowed_profiles' END AS restriction_mode,
 CASE WHEN doc_id % 8 = 2 THEN 'movimiento' WHEN doc_id % 8 = 6 THEN '' END AS forced_profile, doc_id % 4 AS m FROM {documents}"""


@query("apply_restriction", f"""SELECT doc_id, restriction, CASE WHEN restriction = 'allowed_profiles' AND NOT ok THEN 'profile_not_allowed' ELSE 'ok' END AS restriction_status,
 CASE WHEN restriction = 'forced_profile' THEN 'internal-movimiento-camiones' WHEN restriction = 'allowed_profiles' AND NOT ok THEN NULL ELSE profile_id END AS final_profile
 FROM (SELECT doc_id, profile_id, CASE WHEN doc_id % 8 = 2 THEN 'forced_profile' WHEN doc_id % 4 = 1 THEN 'allowed_profiles' ELSE 'automatic' END AS restriction,
  profile_id IN ('internal-dtve-senasa-arca', 'internal-comprobante-generico') AS ok FROM ({PROFILE}) p) q""")
def apply_restriction(spark, sf):
    modes = sql(spark, sf, _RESTRICTED).withColumn(
        "allowed_profiles", F.when(F.col("m") == 1, F.array(F.lit("mateo"), F.lit("internal-comprobante-generico"), F.lit("general")))
        .when(F.col("m") == 3, F.array(F.lit("general"))))
    d = routing.classify_profile(docs(spark, sf)).select("doc_id", "profile_id").join(modes, "doc_id")
    return routing.apply_restriction(d).select("doc_id", "restriction", "restriction_status", "final_profile")


@query("profile_lookup", """SELECT event_id, p AS profile_code, CASE p WHEN 'internal-movimiento-camiones' THEN 11 WHEN 'internal-nomina-personal' THEN 6
 WHEN 'internal-dtve-senasa-arca' THEN 34 WHEN 'internal-documento-tecnico-administrativo' THEN 10 ELSE 0 END::BIGINT AS n_expected FROM
 (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'internal-dtve-senasa-arca' WHEN 1 THEN 'internal-movimiento-camiones' WHEN 2 THEN 'internal-general'
 WHEN 3 THEN 'internal-documento-tecnico-administrativo' WHEN 4 THEN 'internal-nomina-personal' WHEN 5 THEN 'internal-general' ELSE 'internal-general' END AS p FROM events) e""")
def profile_lookup(spark, sf):
    raw = table(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in (
        "Mateo ", "movimiento", "custom", "technical-admin", "internal-nomina-personal", "unknown-x", "")]), (F.col("event_id") % 7 + 1).cast("int")).alias("raw"))
    coded = raw.withColumn("profile_code", routing.profile_code("raw"))
    return coded.select("event_id", "profile_code", F.size(routing.expected_columns("profile_code")).alias("n_expected"))


# --- text predicates and functions -----------------------------------------

_BAD = r"[\x00-\x1f\x7f" + chr(0xFFFD)


@query("corrupt_text", f"""SELECT doc_id, line_no, trim(s) <> '' AND ({D.count("s", _BAD + "]")} + u) / greatest(length(s), 1) > 0.03 AS corrupt,
 trim(s) <> '' AND ({D.count("s", _BAD + "ÂÃ]")} + u) / greatest(length(s), 1) > 0.03 AS corrupt_strict FROM
 (SELECT *, CASE WHEN contains(lower(s), 'http://') OR contains(lower(s), 'https://') THEN 20 ELSE 0 END AS u FROM
 (SELECT doc_id, CAST(i AS BIGINT) AS line_no, concat(l[i], CASE i % 4 WHEN 0 THEN ' Ã Ã' WHEN 1 THEN ' https://x.io' WHEN 2 THEN chr(7) ELSE '' END) AS s FROM
 (SELECT doc_id, {D.lines("text")} AS l FROM documents) d, unnest(generate_series(1, len(l))) g(i)) x) q""")
def corrupt_text(spark, sf):
    lines = pages.explode_lines(sql(spark, sf, SINGLE_PAGES)).withColumn("s", F.concat("line", F.element_at(
        F.array(F.lit(""), F.lit(" https://x.io"), F.lit("\x07"), F.lit(" Ã Ã")),
        F.when(F.col("line_no") % 4 == 0, 4).when(F.col("line_no") % 4 == 1, 2).when(F.col("line_no") % 4 == 2, 3).otherwise(1))))
    return lines.select("doc_id", "line_no", X.corrupt_text("s").alias("corrupt"), X.corrupt_text("s", strict=True).alias("corrupt_strict"))


@query("text_normal_forms", f"""SELECT doc_id, md5({D.fold("text")}) AS folded, md5({D.search("text")}) AS search, md5({D.words("text")}) AS words,
 md5({D.key("text")}) AS "key", md5({D.punct("text")}) AS punct FROM documents""")
def text_normal_forms(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.fold_accents("text")).alias("folded"), F.md5(T.norm_search("text")).alias("search"),
        F.md5(T.norm_words("text")).alias("words"), F.md5(T.norm_key("text")).alias("key"), F.md5(T.norm_punct("text")).alias("punct"))


_RAWTXT = r"trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), chr(10)), lambda s: rtrim(s, ' ' || chr(9))), chr(10)), ' ' || chr(10) || chr(9))"


@query("write_raw_text", f"""SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'documento' ELSE concat('acta-', doc_id) END, '_ocr_bruto.txt') AS file_name, {_RAWTXT} AS raw_text
 FROM (SELECT doc_id, replace(concat('  ', text, '  '), chr(10), concat(' ', chr(9), chr(13), chr(10), chr(7))) AS t FROM documents) d""")
def write_raw_text(spark, sf):
    dirty = F.replace(F.concat(F.lit("  "), F.col("text"), F.lit("  ")), F.lit("\n"), F.lit(" \t\r\n\x07"))
    rejected = table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.lit(" .pdf")).otherwise(F.concat(F.lit("acta\\"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    path = f"{shared_folder(spark)}/raw-text-{uuid.uuid4().hex}"
    sinks.write_raw_text(rejected.select(
        "doc_id", T.raw_text_file_name(name).alias("file_name"), T.sanitize_raw_text(dirty).alias("raw_text")), path)
    return spark.read.parquet(path)


@query("text_cleanups", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AI response could not be converted to structured output' ELSE
  left(replace(replace({D.collapse("concat('<b> ', text)")}, '<', '‹'), '>', '›'), 220) END AS error, upper(left({D.key("text")}, 14)) AS slug,
 CASE WHEN length(trim(text, ' ' || chr(10))) > 700 THEN concat(left(trim(text, ' ' || chr(10)), 700), '...') ELSE trim(text, ' ' || chr(10)) END AS example,
 trim(text, ' ' || chr(10)) AS unfenced, left(replace(replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), '/', '-'), chr(92), '-'), 180) AS file_name
 FROM documents""")
def text_cleanups(spark, sf):
    d = table(spark, sf, "documents")
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x <!DOCTYPE "), F.col("text"))).otherwise(F.concat(F.lit("<b> "), F.col("text")))
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    return d.select("doc_id", T.sanitize_error(bad).alias("error"), T.client_slug("text").alias("slug"),
                    T.truncate_example("text", 700).alias("example"), T.strip_fences(fenced).alias("unfenced"), T.sanitize_file_name("text").alias("file_name"))


@query("identifier_checks", """SELECT p_partkey, p_partkey % 3 <> 2 AS cuil, p_partkey % 2 = 0 AS dni, p_partkey % 4 < 2 AS cuit, p_partkey % 3 = 0 AS company,
 p_partkey % 5 = 0 AS person, p_partkey % 3 <> 0 AS person_company, p_partkey % 4 = 3 AS locality FROM part""")
def identifier_checks(spark, sf):
    k = F.col("p_partkey")
    n8 = F.lpad(k.cast("string"), 8, "1")
    pick = lambda n, *vs: F.element_at(F.array(*vs), (k % n + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey",
        ids.valid_cuil(pick(3, F.concat(F.lit("20-"), n8, F.lit("-3")), F.concat(F.lit("20"), n8), n8)).alias("cuil"),
        ids.valid_dni(pick(2, F.concat(F.lit("D "), n8), F.concat(n8, F.lit("1")))).alias("dni"),
        ids.valid_cuit(pick(4, F.concat(F.lit("20-"), n8, F.lit("-3")), F.concat(F.lit("30-"), n8, F.lit("-1")), n8, F.concat(F.lit(" 20-"), n8, F.lit("-3")))).alias("cuit"),
        ids.likely_company(pick(3, F.concat("p_name", F.lit(" S. R. L.")), F.col("p_name"), F.lit("S.A."))).alias("company"),
        ids.likely_person_name(pick(5, F.col("p_name"), F.lit("Campo Quijano"), F.lit("Oficina Proyectos"), F.lit("SAN JUAN"), F.lit("Ana"))).alias("person"),
        ids.likely_person_name_company(pick(3, F.concat("p_name", F.lit(" SA")), F.col("p_name"), F.lit("Campo Quijano"))).alias("person_company"),
        ids.likely_locality(pick(4, F.lit("Salta, Capital"), F.lit("entre rios"), F.lit("x"), F.col("p_name"))).alias("locality"))


@query("province_lookup", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Neuquén' WHEN 1 THEN 'Ciudad Autónoma de Buenos Aires' WHEN 2 THEN NULL ELSE 'San Juan' END AS exact,
 CASE p_partkey % 4 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 0 THEN 'Neuquén' ELSE 'San Juan' END AS supplier, CASE p_partkey % 3 WHEN 0 THEN 'Río Negro' WHEN 1 THEN 'Buenos Aires' ELSE NULL END AS last_name,
 CAST(CASE p_partkey % 3 WHEN 0 THEN length(p_name) + 9 WHEN 1 THEN strpos(concat(p_name, ' Ciudad Autónoma de Buenos Aires'), 'Buenos Aires') - 1 ELSE -1 END AS BIGINT) AS last_pos FROM part""")
def province_lookup(spark, sf):
    k = F.col("p_partkey")
    exact = F.element_at(F.array(F.lit(" NEUQUEN"), F.lit("ciudad autonoma de buenos aires"), F.lit("Saltaa"), F.lit("San  Juan")), (k % 4 + 1).cast("int"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Córdoba "), F.col("p_name"), F.lit(" Río--Negro"))).when(
        k % 3 == 1, F.concat(F.col("p_name"), F.lit(" Ciudad Autónoma de Buenos Aires"))).otherwise(F.col("p_name"))
    last = ids.last_province(text)
    return table(spark, sf, "part").select("p_partkey", ids.province(exact).alias("exact"), ids.supplier_province(exact).alias("supplier"),
                                           last["name"].alias("last_name"), last["pos"].alias("last_pos"))


@query("roster_value_cleanup", """SELECT p_partkey, p_name || ' Salta' AS name, 'Campo Quijano ' || p_size AS locality, CASE p_size % 2 WHEN 0 THEN 'Jujuy' ELSE 'Córdoba' END AS province,
 'Rosario ' || CASE p_size % 2 WHEN 0 THEN 'Alto' ELSE 'Bajo' END AS place, 'Rosario De Lerma' AS title, '12/05/2023' AS date, 'Expte. 12-' || p_partkey AS reference FROM part""")
def roster_value_cleanup(spark, sf):
    even = F.col("p_size") % 2 == 0
    return table(spark, sf, "part").select(
        "p_partkey", ids.normalize_roster_value("NombreApellido", F.concat(F.col("p_name"), F.lit("\n  SATTA"))).alias("name"),
        ids.normalize_roster_value("Localidad", F.concat(F.lit("OD 00 Campo Quljano FOLIO "), F.col("p_size").cast("string"))).alias("locality"),
        ids.normalize_roster_value("Provincia", F.when(even, "jwuy").otherwise("CORDOBA ")).alias("province"),
        ids.clean_locality(F.concat(F.lit("D | 10 Rosario 455 "), F.when(even, "Alto").otherwise("Bajo"))).alias("place"),
        T.title_case(F.lit("rosario DE lerma")).alias("title"),
        X.extract_date(F.concat(F.lit("saldo 123456 al 12/05/2023 y "), F.col("p_partkey").cast("string"))).alias("date"),
        X.extract_reference(F.concat(F.lit("ver Expte. 12-"), F.col("p_partkey").cast("string"), F.lit("; otro"))).alias("reference"))


# --- chunks ----------------------------------------------------------------


@query("chunk_pages", f"""WITH RECURSIVE p AS (SELECT doc_id, page_number AS n, concat('Página ', page_number, chr(10), t) AS own, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS rn
  FROM (SELECT doc_id, page_number, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS t, count(*) OVER (PARTITION BY doc_id) AS pages FROM {TURNS} t) x WHERE t <> ''),
 r AS (SELECT doc_id, rn, CAST(1 AS BIGINT) AS chunk, n AS first, n AS last, own AS text FROM p WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.rn, CASE WHEN f THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN f THEN p.n ELSE r.first END, p.n,
   CASE WHEN NOT f THEN concat(r.text, chr(10), chr(10), p.own) WHEN length(r.text) > 100 THEN concat(trim(right(r.text, 100), ' ' || chr(10)), chr(10), chr(10), p.own) ELSE p.own END
  FROM (SELECT r.*, p.n AS pn FROM r JOIN p ON p.doc_id = r.doc_id AND p.rn = r.rn + 1) r JOIN (SELECT p.* FROM p) p ON p.doc_id = r.doc_id AND p.rn = r.rn + 1,
   LATERAL (SELECT length(r.text) + 2 + length(p.own) > 1500 AS f) z)
 SELECT doc_id, chunk AS chunk_index, CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE concat(first, '-', last) END AS page_range, trim(text, ' ' || chr(10)) AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY rn DESC) AS k FROM r) q WHERE k = 1""")
def chunk_pages(spark, sf):
    return chunks.chunk_pages(sql(spark, sf, MULTI_PAGES), max_chars=1500, overlap=100).drop("pages", "status")


@query("cap_pages", """SELECT doc_id, count(*) AS pages FROM (SELECT CAST(floor(doc_id / 40) AS BIGINT) AS doc_id FROM documents UNION ALL
 SELECT conv_id FROM conversations) d GROUP BY 1 HAVING count(*) > 30""")
def cap_pages(spark, sf):
    p = sql(spark, sf, "SELECT CAST(floor(doc_id / 40) AS BIGINT) AS doc_id, 1 AS page_number FROM {documents} UNION ALL SELECT conv_id, 1 FROM {conversations}")
    return chunks.over_page_limit(p)


@query("cap_chunks", f"""SELECT doc_id, CAST(page_number AS BIGINT) AS chunk_index, page_number > 4 AS skipped, CASE WHEN page_number > 4 THEN 'Error de procesamiento' ELSE '' END AS kind FROM {TURNS} t""")
def cap_chunks(spark, sf):
    c = sql(spark, sf, MULTI_PAGES).select("doc_id", F.col("page_number").alias("chunk_index"), F.col("page_number").cast("string").alias("page_range"))
    kept, errors = chunks.cap_chunks(c, 4)
    return kept.select("doc_id", "chunk_index", F.lit(False).alias("skipped"), F.lit("").alias("kind")).unionByName(
        errors.select("doc_id", "chunk_index", F.lit(True).alias("skipped"), F.col("cells")["Tipo de dato"].alias("kind")))


@query("model_usage", """SELECT doc_id, count(*) FILTER (s = 0) AS processed, count(*) FILTER (s = 1) AS failed, count(*) FILTER (s = 2) AS skipped, count(DISTINCT m) AS models,
 CASE WHEN x IS NULL THEN 'm1' WHEN x = 'm3 (experimental)' THEN x ELSE 'm2 (fallback)' END AS model_label FROM
 (SELECT *, first(CASE WHEN s = 0 AND m LIKE '%(%' THEN m END ORDER BY CASE WHEN s = 0 AND m LIKE '%(%' THEN 0 ELSE 1 END, event_id) OVER (PARTITION BY doc_id ORDER BY CASE WHEN s = 0 AND m LIKE '%(%' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x FROM
 (SELECT user_id AS doc_id, event_id, (event_id // 3) % 3 AS s, CASE WHEN event_id % 97 = 0 THEN 'm3 (experimental)' WHEN event_id % 41 = 0 THEN 'm2 (fallback)' ELSE 'm1' END AS m FROM events) e) q GROUP BY doc_id, x""".replace(
    "first(CASE WHEN s = 0 AND m LIKE '%(%' THEN m END ORDER BY CASE WHEN s = 0 AND m LIKE '%(%' THEN 0 ELSE 1 END, event_id) OVER", "first_value(CASE WHEN s = 0 AND m LIKE '%(%' THEN m END) OVER"))
def model_usage(spark, sf):
    k = F.col("event_id")
    tries = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), k.alias("chunk_index"),
        F.when(k % 97 == 0, "m3 (experimental)").when(k % 41 == 0, "m2 (fallback)").otherwise("m1").alias("model_used"),
        F.element_at(F.array(F.lit("processed"), F.lit("failed"), F.lit("skipped")), (F.floor(k / 3) % 3 + 1).cast("int")).alias("status"))
    return chunks.model_usage(tries, "m1", "m2")


@query("output_kind", """SELECT 'p' || page_id AS id, 'html' AS kind, false AS repairable FROM pages UNION ALL
 SELECT 'd' || doc_id, CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'csv' WHEN 3 THEN 'empty' ELSE 'prose' END, doc_id % 5 <> 3 FROM labels""")
def output_kind(spark, sf):
    k = F.col("doc_id") % 5
    texts = F.when(k == 0, '{"columns": []}').when(k == 1, "```json\n{}\n```").when(k == 2, "a,b\n1,2").when(k == 3, " \n").otherwise("No hay tabla")
    both = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("t")).unionByName(
        table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), texts.alias("t")))
    kind = both.withColumn("kind", quality.output_kind("t"))
    return kind.select("id", "kind", quality.repairable("kind").alias("repairable"))
