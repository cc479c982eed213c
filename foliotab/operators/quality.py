"""Extraction quality, confidence, the acceptance gate and the choice of a result.

Tables come in long form: ``rows(doc_id, candidate, row_idx, cells)`` and one header row per
table ``heads(doc_id, candidate, columns array<string>, ...)``.  Row facts are partial
aggregates, so one very long table does not load one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import ids
from ..functions.text import bind, clean_value, col, norm_key, norm_punct, py_key, trim_ws
from ..functions.values import (
    commercial_column_count, ignored_texts, movement_column_count, round_confidence,
    row_confidence,
)
from .routing import extraction_mode, extraction_profile
from .tables import (
    EMPTY, cap_warnings, extra_columns, field_value_output, generic_line_schema, merge_warnings,
    missing_columns, non_empty,
)

KEYS = ["doc_id", "candidate"]


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- structural quality ----------------------------------------------------


def extraction_quality_of(columns, n_rows, document_type, kind, profile) -> Column:
    """``struct<level, reason>`` from the header, the non-empty row count and the context."""
    doc_type, kind, profile = (F.coalesce(col(c), F.lit("")) for c in (document_type, kind, profile))
    names = F.filter(F.transform(col(columns), norm_punct), lambda c: c != "")
    facts = bind(names, lambda norm: F.struct(
        F.size(norm).alias("named"),
        F.size(F.array_intersect(norm, _lits(["pagina", "linea", "texto"]))).alias("generic"),
        F.size(F.filter(norm, lambda c: ~c.isin(V.GENERIC_QUALITY_COLUMNS))).alias("useful"),
        F.size(F.array_intersect(norm, _lits(V.SECTION_QUALITY_COLUMNS))).alias("sections"),
        commercial_column_count(columns).alias("commercial"), movement_column_count(columns).alias("movement"),
        F.size(col(columns)).alias("width"), col(n_rows).alias("n"),
        ((doc_type == "invoice") | (kind == "commercial-operations")
         | profile.isin("mateo", "internal-dtve-senasa-arca", "internal-comprobante-generico")).alias("invoice"),
        ((kind == "vision-table") | profile.isin("movimiento", "internal-movimiento-camiones")).alias("vision"),
        (doc_type == "table").alias("table"),
    ))
    return bind(facts, _quality_rules)


def _quality_rules(f: Column) -> Column:
    n, width, useful = f["n"], f["width"], f["useful"]
    invoice = f["invoice"] & (n >= 1) & (f["commercial"] >= 6)
    rules = [
        ((f["named"] == 3) & (f["generic"] == 3), "low", "Generic PDF text fallback columns detected"),
        ((width <= 1) | (n == 0), "low", "Too few columns or rows"),
        (invoice & (width >= 12) & (f["commercial"] >= 8), "high",
         "Single-row commercial operations document with useful schema"),
        (invoice & (width >= 8), "medium", "Commercial operations document has usable fields"),
        (f["vision"] & (n >= 1) & (f["movement"] >= 8), "high",
         "Logistics movement table profile with expected schema"),
        (f["table"] & ~f["vision"] & (n < 3), "low", "Table/list extraction requires multiple rows"),
        ((f["sections"] >= 6) & (width > 5) & (n > 10), "high",
         "Technical-administrative document columns detected with enough rows"),
        ((width > 3) & (n > 3) & (useful >= 3), "high", "Structured result has enough useful columns and rows"),
        ((width >= 3) & (n >= 2) & (useful >= 2), "medium", "Structured result has usable columns and rows"),
    ]
    out = F
    for cond, level, why in rules:
        out = out.when(cond, F.struct(F.lit(level).alias("level"), F.lit(why).alias("reason")))
    return out.otherwise(F.struct(F.lit("low").alias("level"), F.lit("Result is too generic to be useful").alias("reason")))


def _row_sums() -> list[Column]:
    conf = row_confidence(F.col("cells"))
    return [F.count("*").alias("n_rows"), F.count_if(non_empty("cells")).alias("n_filled"), F.avg(conf).alias("row_confidence")]


def row_facts(rows: DataFrame) -> DataFrame:
    """Per table: rows, non-empty rows and the mean explicit row confidence."""
    return rows.groupBy(*KEYS).agg(*_row_sums())


def extraction_quality(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``quality, quality_reason`` per table; ``heads`` may carry document_type and profile_id."""
    h = heads.join(row_facts(rows), KEYS, "left").fillna(0, ["n_rows", "n_filled"])
    quality = extraction_quality_of(
        "columns", "n_filled", "document_type", extraction_profile("profile_id"), "profile_id"
    )
    h = h.withColumn("_q", quality)
    return h.withColumns({"quality": F.col("_q")["level"], "quality_reason": F.col("_q")["reason"]}).drop("_q")


def table_mode_issue(columns, document_type) -> Column:
    """Table mode that returned only field/value columns."""
    return (col(document_type) == "table") & field_value_output(columns)


# --- confidence ------------------------------------------------------------


def confidence_estimate(provider, row_conf, pattern_score, result_quality, level) -> Column:
    """Provider value, else mean row confidence, else pattern score, else by result quality."""
    default = (
        F.when(col(result_quality) == "local-fallback", 0.45).when(col(result_quality) == "partial", 0.68)
        .when(col(level) == "high", 0.9).when(col(level) == "medium", 0.78).otherwise(0.5)
    )
    provider = F.when(~F.isnan(col(provider)), col(provider))
    return F.coalesce(round_confidence(provider), round_confidence(col(row_conf)), col(pattern_score), default)


# --- gate ------------------------------------------------------------------


def _pattern_sums() -> list[Column]:
    c = lambda k: F.coalesce(F.col("cells")[k], F.lit(""))
    prov = ids.province(c("Provincia")).isNotNull()
    roster_valid = ids.valid_cuil(c("CUIL")) & ids.likely_person_name(c("NombreApellido")) & prov
    person = ids.likely_person_name_company(c("NombreApellido"))
    core = (trim_ws(c("Empresa")) != "") & person & ids.valid_dni(c("DNI"))
    return [
        F.count("*").alias("n"), F.count_if(prov).alias("province_rows"), F.count_if(roster_valid).alias("rv"),
        F.count_if(ids.valid_cuil(c("CUIL"))).alias("cuil_rows"), F.count_if(core).alias("core"),
        F.count_if(trim_ws(c("Localidad")) != "").alias("locality_rows"),
        F.count_distinct(F.when(ids.valid_dni(c("DNI")), c("DNI"))).alias("dnis"),
        # The gate only asks whether any is there, so one distinct count suffices.
        F.count_if(c("CUIT") != "").alias("cuits"), F.count_if(c("Empresa") != "").alias("companies"),
    ]


def _pattern_scores(agg: DataFrame) -> DataFrame:
    """Roster and company scores from a table's sums."""
    two = lambda x: F.floor(x * 100 + 0.5).cast("double") / 100
    n = F.greatest("n", F.lit(1))
    agg = agg.withColumns({
        "roster_score": two(F.col("rv") / n),
        "company_score": F.least(F.lit(1.0), two(
            F.col("core") / n * 0.7 + F.col("province_rows") / n * 0.15 + F.col("locality_rows") / n * 0.15)),
    })
    large = (F.col("n") > 100) & (F.col("province_rows") > 80)
    return agg.withColumns({
        "roster_ok": (large | (F.col("rv") > 0)) & (F.col("roster_score") >= 0.65),
        "company_ok": (F.col("dnis") >= 10) & (F.col("cuits") >= 1) & (F.col("companies") >= 1)
        & (F.col("core") / n >= 0.6),
    })


def _movement_sums() -> list[Column]:
    """Watermarks, corruption, filled rows and bad dates; ``_j`` holds a row's values, ``_h`` its watermarks."""
    bad = lambda c: F.count_if(
        (trim_ws(F.coalesce(F.col("cells")[c], F.lit(""))) != "")
        & ~trim_ws(F.col("cells")[c]).rlike(r"^\d{2}/\d{2}/\d{4}\z"))
    return [
        F.count_if(non_empty("cells", _lits(V.MOVEMENT_COLUMNS))).alias("movement_rows"),
        *[F.max(F.array_contains("_h", w)).alias(f"_w{i}") for i, w in enumerate(V.IGNORED_TEXTS)],
        F.sum(F.length("_j") + 1).alias("_len"),
        F.sum(F.regexp_count("_j", F.lit("[" + r"\x00-\x1f\x7f" + chr(0xFFFD) + "]"))).alias("_bad"),
        F.max(F.col("_j").rlike("(?i)https?://")).alias("_url"),
        bad("FechaSalida").alias("bad_departures"), bad("FechaArribo").alias("bad_arrivals"),
    ]


def gate_facts(rows: DataFrame) -> DataFrame:
    """All facts of every table in one pass over its rows.

    Everything adds up but the distinct DNIs, so Spark groups once by table and DNI and once by table.
    """
    joined = F.array_join(F.map_values("cells"), " ")
    read = rows.select(*KEYS, "cells", ignored_texts(joined).alias("_h"), joined.alias("_j"))
    agg = _pattern_scores(read.groupBy(*KEYS).agg(*_row_sums(), *_pattern_sums(), *_movement_sums()))
    marks = F.array_compact(F.array(*[F.when(F.col(f"_w{i}"), F.lit(w)) for i, w in enumerate(V.IGNORED_TEXTS)]))
    length = F.col("_len") - 1
    penalty = F.col("_bad") + F.when(F.col("_url"), 20).otherwise(0)
    return agg.select(
        *KEYS, "n_rows", "n_filled", "row_confidence", "province_rows", "cuil_rows", "roster_score", "company_score",
        "roster_ok", "company_ok", "movement_rows", "bad_departures", "bad_arrivals", marks.alias("ignored"),
        ((length > 0) & (penalty / F.greatest(length, F.lit(1)) > 0.03)).alias("corrupt"),
    )


def _fixed2(c: Column) -> Column:
    return F.format_string("%.2f", c)


def invalid_dates(departures: Column, arrivals: Column) -> Column:
    """Warnings for dates outside DD/MM/YYYY."""
    one = lambda name, n: F.when(n > 0, F.concat(
        F.lit(f"{name} contiene "), n.cast("string"), F.lit(" valor(es) fuera de DD/MM/YYYY.")))
    return F.array_compact(F.array(one("FechaSalida", departures), one("FechaArribo", arrivals)))


def quality_gate(rows: DataFrame, heads: DataFrame, min_confidence: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Acceptance of every candidate table, with profile-specific branches.

    ``heads``: ``doc_id, candidate, columns, profile_id, provider_confidence, result_quality,
    quality_status_in, warnings_in, scanned_text_warning``.  Adds ``acceptable, confidence,
    quality_status, reason, requires_manual_review, should_fallback, warnings``.
    """
    kind = extraction_profile("profile_id")
    doc_type = (
        F.when(kind == "commercial-operations", "invoice").when(kind == "table-list", "table")
        .when(kind == "technical-admin", "report").otherwise("auto")
    )
    t = heads.join(gate_facts(rows), KEYS, "left").fillna(
        0, ["n_rows", "n_filled", "province_rows", "cuil_rows", "movement_rows", "bad_departures", "bad_arrivals"]
    ).fillna(0.0, ["roster_score", "company_score"]).fillna(False, ["roster_ok", "company_ok", "corrupt"])
    t = t.withColumns({"_kind": kind, "_dt": doc_type, "ignored": F.coalesce("ignored", EMPTY())})
    t = t.withColumns({
        "_q": extraction_quality_of("columns", "n_filled", "_dt", "_kind", "profile_id"),
        "_bare": extraction_quality_of("columns", "n_filled", F.lit(""), "_kind", "profile_id")["level"],
    })
    t = t.withColumns({"_level": F.col("_q")["level"], "_why": F.col("_q")["reason"]})
    vision = (F.col("_kind") == "vision-table") | F.coalesce(extraction_mode("profile_id") == "vision_table", F.lit(False))
    roster, company = F.col("_kind") == "personnel-roster", F.col("_kind") == "personnel-company-location"
    pattern = F.when(F.size("columns") >= 6, F.when(roster, F.col("roster_score")).when(company, F.col("company_score")))
    est = confidence_estimate("provider_confidence", "row_confidence", pattern, "result_quality", "_bare")
    t = t.withColumns({"_conf": est, "_generic": generic_line_schema("columns")})
    conf, generic, n = F.col("_conf"), F.col("_generic"), F.col("n_rows")
    low_conf = conf < min_confidence
    conf_reason = F.concat(F.lit("Confidence "), _fixed2(conf), F.lit(f" below minimum {min_confidence:.2f}"))
    base = F.coalesce("warnings_in", EMPTY())

    expected = _lits(V.MOVEMENT_COLUMNS)
    missing, extra = missing_columns(expected, F.col("columns")), extra_columns(expected, F.col("columns"))
    roster_missing = missing_columns(_lits(V.ROSTER_COLUMNS), F.col("columns"))
    company_missing = missing_columns(_lits(V.COMPANY_COLUMNS), F.col("columns"))
    names = lambda a: F.coalesce(F.nullif(F.array_join(a, ", "), F.lit("")), F.lit("none"))
    short = n - F.col("province_rows")
    province_note = F.when(short > 0, F.array(F.concat(
        short.cast("string"), F.lit(" fila(s) requieren revision de provincia.")))).otherwise(EMPTY())
    movement_warnings = F.concat(
        base, invalid_dates(F.col("bad_departures"), F.col("bad_arrivals")),
        F.when(F.coalesce("scanned_text_warning", F.lit(False)), F.array(F.lit(
            "Documento tratado como escaneado o de baja calidad visual."))).otherwise(EMPTY()))

    fail = "fallback_required"
    done = lambda w: F.when(F.size(w) > 0, F.lit("completed_with_warnings")).otherwise(F.lit("completed"))
    weak = F.col("result_quality").isin("partial", "local-fallback")
    general_done = F.when((F.size(base) > 0) | F.coalesce(weak, F.lit(False)), F.lit("completed_with_warnings")).otherwise(F.lit("completed"))
    rscore, cscore = F.col("roster_score"), F.col("company_score")
    L = F.lit
    # condition, accepted, confidence, status, reason, warnings
    rules = [
        (vision & generic, False, conf, L(fail), L("Generic Pagina/Linea/Texto output is not valid for this profile"), movement_warnings),
        (vision & ((F.size(missing) > 0) | (F.size(extra) > 0)), False, conf, L(fail),
         F.concat(L("Profile columns mismatch. Missing: "), names(missing), L(". Extra: "), names(extra), L(".")), movement_warnings),
        (vision & (F.col("movement_rows") == 0), False, L(0.0), L(fail), L("No valid movement rows were extracted"), movement_warnings),
        (vision & (F.size("ignored") > 0), False, conf, L(fail),
         F.concat(L("Ignored scanner text was included as data: "), F.array_join("ignored", ", ")), movement_warnings),
        (vision & F.col("corrupt"), False, conf, L("manual_review_required"), L("Extracted text looks corrupted"), movement_warnings),
        (vision & low_conf, False, conf, L(fail), conf_reason, movement_warnings),
        (vision, True, conf, done(movement_warnings), L("Profile quality gate passed"), movement_warnings),
        (roster & generic, False, rscore, L(fail), L("Generic Pagina/Linea/Texto output is not valid for personnel rosters"), base),
        (roster & (F.size(roster_missing) > 0), False, rscore, L(fail),
         F.concat(L("Personnel roster columns missing: "), F.array_join(roster_missing, ", ")), base),
        (roster & (F.col("cuil_rows") == 0), False, L(0.0), L(fail), L("No personnel rows with a valid CUIL anchor were extracted"), base),
        (roster & ~F.col("roster_ok"), False, rscore, L(fail),
         F.concat(L("Personnel roster row quality "), _fixed2(rscore), L(" below minimum 0.65")), base),
        (roster, True, rscore, done(F.concat(base, province_note)), L("Personnel roster quality gate passed"), F.concat(base, province_note)),
        (company & generic, False, cscore, L(fail), L("Generic Pagina/Linea/Texto output is not valid for company personnel lists"), base),
        (company & (F.size(company_missing) > 0), False, cscore, L(fail),
         F.concat(L("Company personnel columns missing: "), F.array_join(company_missing, ", ")), base),
        (company & ~F.col("company_ok"), False, cscore, L(fail),
         F.concat(L("Company personnel pattern quality "), _fixed2(cscore), L(" did not meet its profile gate")), base),
        (company, True, cscore, done(F.concat(base, province_note)), L("Company personnel pattern quality gate passed"), F.concat(base, province_note)),
        ((n == 0) | (F.size("columns") == 0), False, L(0.0), L(fail), L("No rows or columns were extracted"), base),
        ((F.col("quality_status_in") == "accepted_with_warnings") & (F.col("_level") != "low"), True,
         F.greatest(conf, L(0.65)), L("accepted_with_warnings"), L("Structured table recovered from document text/layout"), base),
        (low_conf, False, conf, L(fail), conf_reason, base),
        (F.col("_level") == "low", False, conf, L(fail), F.col("_why"), base),
    ]
    ok, cf, st, rs, wn = F, F, F, F, F
    for cond, accepted, c, s, r, w in rules:
        ok, cf, st = ok.when(cond, L(accepted)), cf.when(cond, c), st.when(cond, s)
        rs, wn = rs.when(cond, r), wn.when(cond, w)
    t = t.withColumns({
        "acceptable": ok.otherwise(L(True)), "confidence": cf.otherwise(conf), "quality_status": st.otherwise(general_done),
        "reason": rs.otherwise(F.col("_why")), "warnings": wn.otherwise(base),
    })
    status = F.col("quality_status")
    return t.select(
        *heads.columns, "n_rows", "acceptable", "confidence", "quality_status", "reason",
        status.isin("manual_review_required", "failed_quality_gate").alias("requires_manual_review"),
        (status == fail).alias("should_fallback"), "warnings",
    )


def movement_validation(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """First failing check of a movement table, or ok."""
    cells = F.col("cells")
    joined = F.array_join(F.transform(F.map_values(cells), clean_value), " ")
    agg = rows.select(*KEYS, "cells", joined.alias("_j")).groupBy(*KEYS).agg(
        F.count_if(non_empty("cells", _lits(V.MOVEMENT_COLUMNS))).alias("filled"),
        F.max(F.size(ignored_texts("_j")) > 0).alias("marks"),
        F.sum(F.length("_j") + 1).alias("_len"),
        F.sum(F.regexp_count("_j", F.lit("[" + r"\x00-\x1f\x7f" + chr(0xFFFD) + "ÂÃ]"))).alias("_bad"),
        F.max(F.col("_j").rlike("(?i)https?://")).alias("_url"),
    )
    t = heads.join(agg, KEYS, "left")
    missing = missing_columns(_lits(V.MOVEMENT_COLUMNS), F.col("columns"))
    share = (F.col("_bad") + F.when(F.col("_url"), 20).otherwise(0)) / F.greatest(F.col("_len") - 1, F.lit(1))
    return t.select(
        *KEYS,
        F.when(generic_line_schema("columns"), "PROFILE_REJECTED_GENERIC_LINE_CSV")
        .when(F.size(missing) > 0, F.concat(F.lit("PROFILE_MISSING_COLUMNS: "), F.array_join(missing, ", ")))
        .when(F.coalesce("filled", F.lit(0)) == 0, "PROFILE_NO_VALID_ROWS")
        .when(F.col("marks"), "PROFILE_INCLUDED_IGNORED_TEXT")
        .when(share > 0.03, "PROFILE_CORRUPTED_TEXT_DOMINANT")
        .otherwise("ok").alias("validation"),
    )


def reviewed_table_gate(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Gate of reviewed tables; ``heads`` adds ``confidence, visual_pages``."""
    filled = rows.groupBy(*KEYS).agg(F.count_if(non_empty("cells")).alias("n_filled"))
    t = heads.join(filled, KEYS, "left").fillna(0, ["n_filled"])
    keys = F.transform("columns", norm_key)
    supplier = F.size(F.array_intersect(keys, _lits([py_key(c) for c in V.SUPPLIER_COLUMNS]))) == 8
    rules = [
        (F.size("columns") < 2, False, "Fewer than two real headers"),
        (generic_line_schema("columns"), False, "Generic page-line-text output"),
        (F.col("n_filled") == 0, False, "No populated rows"),
        (~F.coalesce("visual_pages", F.lit(False)) & supplier & (F.col("n_filled") >= 5), True,
         "Supplier table reconstructed from document text/layout"),
        (F.col("confidence") < 0.65, False, "Reviewer confidence below 0.65"),
    ]
    ok, why = F, F
    for cond, accepted, reason in rules:
        ok, why = ok.when(cond, F.lit(accepted)), why.when(cond, F.lit(reason))
    return t.withColumns({
        "acceptable": ok.otherwise(F.lit(True)), "reason": why.otherwise(F.lit("Reviewed document headers and rows")),
    })


# --- choice ----------------------------------------------------------------


def attempt_priority(kind) -> Column:
    """Order in which attempts count: the listed kinds first, as listed, any other after them."""
    at = F.array_position(_lits(V.ATTEMPT_KINDS), col(kind))
    return F.when(at > 0, at).otherwise(len(V.ATTEMPT_KINDS) + 1).cast("int")


def select_result(candidates: DataFrame) -> DataFrame:
    """First acceptable candidate per document in priority order, else the first one.

    ``priority`` may be left out where ``attempt_kind`` is there: see ``attempt_priority``.

    Combined map-side: one row per document and task reaches the shuffle.
    """
    order = F.col("priority") if "priority" in candidates.columns else F.struct(attempt_priority("attempt_kind"), "candidate")
    rank = F.struct((~F.col("acceptable")).cast("int"), order)
    best = candidates.groupBy("doc_id").agg(F.min_by(F.struct(*candidates.columns), rank).alias("_r"))
    return best.select("_r.*")


def text_only_diagnostic(selected: DataFrame) -> DataFrame:
    """One diagnostic row per document that no candidate table could represent."""
    status = F.when(F.col("requires_manual_review"), F.lit("manual_review_required")).otherwise(F.lit("failed_quality_gate"))
    return selected.where(~F.col("acceptable")).select(
        "doc_id", F.lit("ocr_text_only").alias("extraction_mode"), status.alias("quality_status"),
        F.col("confidence").alias("quality_score"), "reason", F.length("text").alias("text_length"),
        "warnings",
    )


def enrich_result(selected: DataFrame, primary: str, fallback: str) -> DataFrame:
    """Chosen results with provider, profile and restriction fields."""
    return selected.where("acceptable").select(
        "doc_id", "candidate", "confidence", "quality_status", "reason", "warnings", "n_rows",
        F.lit(primary).alias("primary_provider"), F.lit(fallback).alias("fallback_provider"),
        F.col("profile_id").alias("profile_code"), extraction_profile("profile_id").alias("extraction_profile"),
        *[c for c in ("restriction", "final_profile", "restriction_reason") if c in selected.columns],
    )


def pattern_result(rows: DataFrame, metrics: DataFrame, tables_detected: DataFrame, kind: str) -> DataFrame:
    """Wrap extracted pattern rows as a result per document, with its warnings."""
    note = {
        "roster": "La nomina se reconstruyo por patron de CUIL sin tabla explicita.",
        "company": "El listado se reconstruyo por patrones de Empresa, CUIT y DNI sin tabla explicita.",
    }[kind]
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    t = n.join(metrics, "doc_id").join(tables_detected, "doc_id", "left")
    implicit = ~F.coalesce("has_tables", F.lit(False))
    return t.withColumns({
        "extraction_mode": F.lit("pattern_structured"),
        "warnings": F.when(implicit, F.array(F.lit(note))).otherwise(EMPTY()),
    })


def resolve_file_kind(df: DataFrame) -> DataFrame:
    """Output kind by ordered rules.

    Needs ``detected_document_type, detected_headers, extraction_mode, profile_id,
    result_quality, model_used, document_type, columns, strategy``.
    """
    kind_key = norm_key(F.coalesce("detected_document_type", F.lit("")))
    heads = F.transform(F.coalesce("detected_headers", EMPTY()), norm_key)
    columns = F.transform("columns", norm_key)
    n_of = lambda have, want: F.size(F.array_intersect(have, _lits(want)))
    model = F.lower(F.coalesce("model_used", F.lit("")))
    profile, kind = F.col("profile_id"), extraction_profile("profile_id")
    universal = F.col("extraction_mode") == "universal_table"
    rules = [
        (kind_key.contains("proveedor") | (n_of(heads, V.SUPPLIER_KIND_COLUMNS) >= 3), "PROVEEDORES"),
        (universal & (kind_key.contains("nomina") | kind_key.contains("personal")), "NOMINA"),
        (universal & kind_key.contains("movimiento") & (n_of(heads, V.MOVEMENT_KIND_COLUMNS) >= 2), "MOVIMIENTO"),
        (universal, "TABLA_DOCUMENTAL"),
        (profile == "internal-nomina-personal", "NOMINA"),
        (profile == "internal-personal-empresa-localidad", "PERSONAL_EMPRESA"),
        (profile == "internal-movimiento-camiones", "MOVIMIENTO"),
        (profile == "internal-tabla-administrativa", "LISTADO"),
        (F.col("extraction_mode") == "reviewed_table", "TABLA_DOCUMENTAL"),
        ((F.col("result_quality") == "local-fallback") | model.contains("local pdf text fallback"), "EXTRACCION_BASICA"),
        (model.contains("pdf table fallback"), "PDF_TABULAR"),
        (F.col("document_type") == "table", "LISTADO"),
        (n_of(columns, V.LIST_KIND_COLUMNS) >= 3, "LISTADO"),
        ((F.col("document_type") == "invoice") | (kind == "commercial-operations")
         | (n_of(columns, V.COMMERCIAL_KIND_COLUMNS) >= 5), "COMPROBANTE"),
        ((F.col("document_type") == "report") | (kind == "technical-admin")
         | (n_of(columns, V.TECHNICAL_KIND_COLUMNS) >= 5), "DOCUMENTO_TECNICO"),
        (F.col("strategy") == "local-fallback", "EXTRACCION_BASICA"),
    ]
    out = F
    for cond, name in rules:
        out = out.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    return df.withColumn("file_kind", out.otherwise(F.lit("GENERAL")))


def merge_page_outputs(outputs: DataFrame, page_counts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Movement rows of a document from its per-page outputs, and a status for every document.

    ``outputs``: ``doc_id, page_number, columns, rows``; ``page_counts``: ``doc_id, page_count``.
    Repeated rows are dropped in order.  A document without a valid row comes back as one row of
    status ``PROFILE_NO_VALID_ROWS``.  Only a caller that sets ``max_pages`` leaves later pages
    out, and is told so in the document's warnings.
    """
    from .tables import dedupe_first, filter_movement_rows, project_cells, row_signature

    used = outputs if max_pages is None else outputs.where(F.col("page_number") <= max_pages)
    rows = used.select("doc_id", "page_number", "columns", F.posexplode("rows").alias("p", "cells"))
    rows = rows.select("doc_id", F.struct("page_number", "p").alias("row_idx"),
                       project_cells(_lits(V.MOVEMENT_COLUMNS), F.col("columns"), F.col("cells")).alias("cells"))
    kept = dedupe_first(filter_movement_rows(rows), row_signature(_lits(V.MOVEMENT_COLUMNS), F.col("cells")), ("doc_id",))
    cap = EMPTY() if max_pages is None else F.when(F.col("page_count") > max_pages, F.array(F.concat(
        F.lit(f"Se procesaron {max_pages} de "), F.col("page_count").cast("string"),
        F.lit(" paginas por limite configurado.")))).otherwise(EMPTY())
    status = F.when(F.col("row_idx").isNull(), "PROFILE_NO_VALID_ROWS").otherwise("ok")
    return page_counts.join(kept, "doc_id", "left").select(
        "doc_id", "row_idx", "cells", status.alias("status"), merge_warnings(cap).alias("warnings"))


def output_kind(c) -> Column:
    """What a recorded answer looks like: empty, html, json, csv or prose."""
    from ..sources.parsed import looks_like_html, parse_csv_like

    t = trim_ws(F.regexp_replace(col(c), "^" + chr(0xFEFF), ""))
    low = F.lower(t)
    return (
        F.when(t == "", "empty").when(low.startswith("{") | low.startswith("```json"), "json")
        .when(looks_like_html(t), "html").when(parse_csv_like(t).isNotNull(), "csv").otherwise("prose")
    )


def repairable(kind) -> Column:
    return ~col(kind).isin("empty", "html")


def normalize_layout_output(outputs: DataFrame) -> DataFrame:
    """Recorded answers for layout text: ``layout_status, columns, rows`` per document.

    ``outputs``: ``doc_id, profile_id, raw_output``.  No rows is a failure; the movement
    profile is projected, filtered and validated; other profiles pass through.
    """
    from ..sources.parsed import parse_model_json
    from .tables import movement_row, project_cells

    expected = _lits(V.MOVEMENT_COLUMNS)
    parsed = parse_model_json(outputs, "raw_output")
    projected = F.filter(
        F.transform("rows", lambda r: project_cells(expected, F.col("columns"), r)), movement_row
    )
    movement = extraction_profile("profile_id") == "vision-table"
    readable = F.col("parse_status").isin("OK", "CSV_LIKE")
    empty = readable & (F.size("rows") == 0)
    parsed = parsed.withColumn("_kept", F.when(readable & movement, projected).otherwise(F.col("rows")))
    return parsed.withColumns({
        "layout_status": F.when(~readable, F.col("parse_status"))
        .when(empty, "ADVANCED_OCR_NORMALIZATION_EMPTY_ROWS")
        .when(movement & (F.size("_kept") == 0), "PROFILE_NO_VALID_ROWS").otherwise("ok"),
        "columns": F.when(movement, expected).otherwise(F.col("columns")),
    }).withColumn("rows", F.col("_kept")).drop("_kept")
