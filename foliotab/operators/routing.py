"""Document type, kind, profile, access and processing route as projections."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import (
    alnum_count, bind, col, collapse, contains_count, fold_accents, norm_punct, norm_search,
    norm_words, py_search, py_words, trim_ws,
)
from ..functions.values import ignored_texts

DEFAULT_PROFILE = "internal-general"


# --- dimensions ------------------------------------------------------------


def plans_table(spark: SparkSession) -> DataFrame:
    """The five plans as a local relation: its size is known, so joins broadcast it and leave the facts in place."""
    names = ("plan_name", "daily_limit", "monthly_limit", "max_pdf_mb", "max_image_mb",
             "allow_json_export", "allow_custom_profile")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
    columns = [pa.array(list(c), t) for c, t in zip(zip(*V.PLANS), kinds)]
    return spark.createDataFrame(pa.table(columns, names=list(names))).withColumn("is_active", F.lit(True))


def upsert_plans(existing: DataFrame, plans: DataFrame) -> DataFrame:
    """Merge plans by name: listed plans replace or add, all other plans stay."""
    kept = existing.join(plans.select("plan_name"), "plan_name", "left_anti")
    return kept.unionByName(plans, allowMissingColumns=True)


# --- profile lookup --------------------------------------------------------


def _resolved(alias: str) -> str:
    """Where an alias leads when the aliases are applied one after another."""
    found = alias
    for name, target in V.PROFILE_ALIASES.items():
        found = target if found == name else found
    return found if found in {p[0] for p in V.PROFILES} else DEFAULT_PROFILE


def profile_code(c) -> Column:
    """Alias-resolved profile id; unknown ids become the general profile."""
    names = [*V.PROFILE_ALIASES, *(p[0] for p in V.PROFILES if p[0] not in V.PROFILE_ALIASES)]
    found = {n: _resolved(n) for n in names}

    def resolved(key: Column) -> Column:
        out = F
        for name, target in found.items():
            if target != DEFAULT_PROFILE:
                out = out.when(key == name, F.lit(target))
        return out.otherwise(F.lit(DEFAULT_PROFILE))

    return bind(F.lower(trim_ws(F.coalesce(col(c), F.lit("")))), resolved)


def _by_profile(code: Column, field: int) -> Column:
    out = F
    for p in V.PROFILES:
        out = out.when(code == p[0], F.lit(p[field]))
    return out


def extraction_profile(code) -> Column:
    return _by_profile(col(code), 1)


def extraction_mode(code) -> Column:
    return _by_profile(col(code), 2)


def expected_columns(code) -> Column:
    """Columns a profile expects, from the profile or from its extraction profile."""
    code = col(code)
    kind = extraction_profile(code)
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    out = F
    for p in V.PROFILES:
        if p[3]:
            out = out.when(code == p[0], lit(p[3]))
    return (
        out.when(kind == "commercial-operations", lit(V.COMMERCIAL_COLUMNS))
        .when(kind == "technical-admin", lit(V.SECTION_COLUMNS))
        .otherwise(F.array().cast("array<string>"))
    )


# --- type and kind ---------------------------------------------------------


def detect_document_type(df: DataFrame) -> DataFrame:
    """Type and confidence from keywords in the file name: table, then invoice, then report."""
    name = F.lower(fold_accents("file_name"))
    kind, conf = F, F
    for doc_type, level in (("table", "high"), ("invoice", "high"), ("report", "medium")):
        hit = name.rlike("|".join(V.FILE_NAME_KEYWORDS[doc_type]))
        kind = kind.when(hit, F.lit(doc_type))
        conf = conf.when(hit, F.lit(level))
    return df.withColumns({
        "detected_type": kind.otherwise(F.lit("auto")),
        "type_confidence": conf.otherwise(F.lit("low")),
    })


def resolve_document_type(detected, code) -> Column:
    """The detected type unless it is auto; then the profile decides."""
    detected, kind = col(detected), extraction_profile(code)
    return (
        F.when(detected != "auto", detected)
        .when(kind == "commercial-operations", F.lit("invoice"))
        .when(kind.isin("table-list", "personnel-roster", "personnel-company-location", "vision-table"),
              F.lit("table"))
        .when(kind == "technical-admin", F.lit("report"))
        .otherwise(F.lit("auto"))
    )


def reliable_text(text, ignored: Column) -> Column:
    """Enough plain text to trust: length, no watermark, alphanumeric density, no mojibake."""

    def trusted(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))
        density = alnum_count(t) / n
        broken = F.regexp_count(t, F.lit("[" + chr(0xFFFD) + "ÂÃ]")) / n
        return (F.length(t) >= 500) & (density >= 0.45) & (broken < 0.02)

    return (F.size(ignored) == 0) & bind(collapse(text), trusted)


def table_signals(text, code=None) -> Column:
    """At least four expected columns, or four generic table words, occur in the text."""

    def signals(t: Column) -> Column:
        generic = contains_count(t, V.GENERIC_TABLE_WORDS) >= 4
        if code is None:
            return generic
        out = F
        for p in V.PROFILES:
            if p[3]:
                out = out.when(col(code) == p[0], contains_count(t, [py_search(c) for c in p[3]]) >= 4)
        return out.otherwise(F.lit(False)) | generic

    return bind(norm_search(text), signals)


def document_kind(df: DataFrame) -> DataFrame:
    """Image, digital or scanned PDF, or unknown, with the preprocessing warnings.

    Needs ``mime_type, text, profile_id``.  Only the movement profile lists texts to ignore.
    """
    none = F.array().cast("array<string>")
    is_pdf = F.col("mime_type") == "application/pdf"
    is_image = F.col("mime_type").isin("image/jpeg", "image/png")
    movement = F.col("profile_id") == "internal-movimiento-camiones"
    df = df.withColumn("ignored_text", F.when(is_pdf & movement, ignored_texts("text")).otherwise(none))
    df = df.withColumns({
        "reliable": is_pdf & reliable_text("text", F.col("ignored_text")),
        "has_table_signals": is_pdf & table_signals("text", "profile_id"),
    })
    has_columns = F.col("profile_id").isin([p[0] for p in V.PROFILES if p[3]])
    pdf_warnings = F.array_compact(F.array(
        F.when(~F.col("reliable"), F.lit(
            "El PDF no tiene texto digital confiable; se prioriza OCR visual cuando el perfil lo requiere.")),
        F.when(F.size("ignored_text") > 0, F.concat(
            F.lit("Se detectaron marcas a ignorar: "), F.array_join("ignored_text", ", "), F.lit("."))),
        F.when(~F.col("has_table_signals") & has_columns, F.lit(
            "No se detectaron encabezados de tabla confiables en el texto local.")),
    ))
    return df.withColumns({
        "document_kind": F.when(is_image, F.lit("image"))
        .when(is_pdf & F.col("reliable"), F.lit("digital_pdf"))
        .when(is_pdf, F.lit("scanned_pdf")).otherwise(F.lit("unknown")),
        "scanned_text_warning": is_pdf & (~F.col("reliable") | (F.size("ignored_text") > 0)),
        "warnings": F.when(is_image, F.array(F.lit(
            "Imagen preparada para OCR visual; la orientación EXIF se corrige durante la optimización.")))
        .when(is_pdf, pdf_warnings)
        .otherwise(F.array(F.lit("Tipo de archivo no reconocido para preprocesamiento documental."))),
    })


# --- classification --------------------------------------------------------


def signal_counts(df: DataFrame) -> DataFrame:
    """Counted signals of file name and text: the inputs of the profile cascade."""
    raw = F.concat(F.coalesce("file_name", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    df = df.withColumn("_raw", raw).withColumn("_words", norm_words("_raw"))
    words = F.col("_words")
    no_cuit = F.regexp_replace("_raw", V.CUIT, " ")
    # All identifiers need seven digits in a row; most prose has none and skips the counts.
    has_ids = F.col("_raw").rlike(r"\d{7}")
    has_suffix = words.contains("s r l") | words.contains("s a") | words.contains("sociedad")
    counted = lambda gate, c, pattern: F.when(gate, F.regexp_count(c, F.lit(pattern))).otherwise(0)
    return df.withColumns({
        "company_matches": counted(has_suffix, words, V.CLASSIFIER_COMPANY),
        "cuit_matches": counted(has_ids, F.col("_raw"), V.CUIT),
        "dni_matches": counted(has_ids, no_cuit, V.DNI),
        "cuil_matches": counted(has_ids, words, V.CLASSIFIER_CUIL),
        **{
            f"{name}_signals": contains_count(words, [py_words(s) for s in signals])
            for name, signals in V.CLASSIFIER_SIGNALS.items()
        },
    }).drop("_raw", "_words")


def classify_profile(df: DataFrame, configured: str | None = None) -> DataFrame:
    """Profile by the ordered signal cascade: ``profile_id, profile_reason, profile_confidence``."""
    s = signal_counts(df)
    n = lambda name: F.col(f"{name}_signals")
    dni, cuil = F.col("dni_matches"), F.col("cuil_matches")
    company_list = (
        (F.col("company_matches") >= 1) & (F.col("cuit_matches") >= 1) & (dni >= 2) & (n("location") >= 1)
    )
    roster = (n("roster") >= 4) | ((n("roster") >= 2) & (cuil >= 5)) | (cuil > 100)
    high = lambda cond: F.when(cond, F.lit("high")).otherwise(F.lit("medium"))
    preferred = profile_code(configured or F.lit(""))
    fallback = F.lit(False) if configured is None else extraction_profile(preferred) != "general"
    table = n("table") >= 4
    if "has_table_signals" in df.columns:
        table = table | F.coalesce("has_table_signals", F.lit(False))
    steps = [
        (company_list, F.lit("internal-personal-empresa-localidad"),
         F.lit("Coinciden empresas, CUIT, DNI y ubicaciones de un listado de personal."), high(dni >= 10)),
        (roster, F.lit("internal-nomina-personal"),
         F.when(cuil > 100, F.lit("Se detectaron mas de 100 CUIL."))
         .otherwise(F.lit("Coinciden encabezados de nomina de personal.")),
         high((n("roster") >= 5) | (cuil > 100))),
        (n("movement") >= 5, F.lit("internal-movimiento-camiones"),
         F.lit("Coinciden campos de movimiento logistico."), high(n("movement") >= 6)),
        (n("operating") >= 3, F.lit("internal-dtve-senasa-arca"),
         F.lit("Coinciden campos de documentacion DTVe, SENASA o ARCA."), high(n("operating") >= 5)),
        (n("commercial") >= 2, F.lit("internal-comprobante-generico"),
         F.lit("Coinciden campos de un comprobante comercial."), high(n("commercial") >= 4)),
        (n("technical") >= 2, F.lit("internal-documento-tecnico-administrativo"),
         F.lit("Coinciden secciones de documentacion tecnico-administrativa."), high(n("technical") >= 4)),
        (fallback, preferred,
         F.lit("Se uso el perfil preferido heredado porque no hubo senales documentales concluyentes."),
         F.lit("medium")),
        (table, F.lit("internal-tabla-administrativa"),
         F.lit("Se detectaron encabezados o patrones tabulares."), F.lit("medium")),
    ]
    ids, reasons, levels = F, F, F
    for cond, profile, reason, level in steps:
        ids, reasons, levels = ids.when(cond, profile), reasons.when(cond, reason), levels.when(cond, level)
    return s.withColumns({
        "profile_id": ids.otherwise(F.lit(DEFAULT_PROFILE)),
        "profile_reason": reasons.otherwise(F.lit("No se detecto un perfil documental especifico.")),
        "profile_confidence": levels.otherwise(F.lit("low")),
    })


# --- access ----------------------------------------------------------------


def apply_restriction(df: DataFrame, detected: str = "profile_id") -> DataFrame:
    """Effective restriction and final profile of each document.

    Needs ``restriction_mode, allowed_profiles array<string>, forced_profile``.  A profile that
    is not allowed gives status ``profile_not_allowed`` instead of an exception.
    """
    allowed = F.filter(
        F.array_distinct(F.transform(
            F.coalesce("allowed_profiles", F.array().cast("array<string>")), profile_code)),
        lambda p: p != DEFAULT_PROFILE,
    )
    forced = F.when(F.col("forced_profile") != "", profile_code("forced_profile"))
    mode = F.lower(trim_ws("restriction_mode"))
    df = df.withColumns({"_allowed": allowed, "_forced": forced, "_mode": mode})
    effective = (
        F.when((F.col("_mode") == "forced_profile") & F.col("_forced").isNotNull(), F.lit("forced_profile"))
        .when((F.col("_mode") == "allowed_profiles") & (F.size("_allowed") > 0), F.lit("allowed_profiles"))
        .otherwise(F.lit("automatic"))
    )
    df = df.withColumn("restriction", effective)
    rejected = (F.col("restriction") == "allowed_profiles") & ~F.array_contains("_allowed", F.col(detected))
    return df.withColumns({
        "restriction_status": F.when(rejected, F.lit("profile_not_allowed")).otherwise(F.lit("ok")),
        "final_profile": F.when(F.col("restriction") == "forced_profile", F.col("_forced"))
        .when(~rejected, F.col(detected)),
        "restriction_reason": F.when(
            F.col("restriction") == "forced_profile",
            F.concat(F.lit("El administrador configuro el perfil obligatorio "), F.col("_forced"), F.lit(".")))
        .when(rejected, F.lit("El perfil detectado no esta incluido entre los perfiles permitidos."))
        .when(F.col("restriction") == "allowed_profiles",
              F.lit("El perfil detectado esta incluido entre los perfiles permitidos."))
        .otherwise(F.lit("Deteccion automatica sin restricciones documentales.")),
    }).drop("_allowed", "_forced", "_mode")


def code_eligibility(df: DataFrame, now) -> DataFrame:
    """Ordered access checks; ``eligibility`` is ok or the first failing reason."""
    now = col(now)
    return df.withColumn(
        "eligibility",
        F.when(F.coalesce(F.col("code_status") != "active", F.lit(True)), F.lit("code_inactive"))
        .when(F.col("expires_at") <= now, F.lit("code_expired"))
        .when((F.col("client_status") != "active") | ~F.col("plan_active"), F.lit("client_or_plan_inactive"))
        .otherwise(F.lit("ok")),
    )


def size_limit_check(df: DataFrame, global_mb: int = V.MAX_FILE_MB) -> DataFrame:
    """Plan-aware size limit by MIME type; empty files are rejected."""
    mime = F.col("mime_type")
    limit = (
        F.when(mime == "application/pdf", F.least(F.lit(global_mb), F.col("max_pdf_mb")))
        .when(mime.isin("image/jpeg", "image/png"), F.least(F.lit(global_mb), F.col("max_image_mb")))
        .otherwise(F.lit(global_mb))
    )
    return df.withColumn("limit_mb", F.coalesce(limit, F.lit(global_mb))).withColumn(
        "size_status",
        F.when(F.col("size_bytes") <= 0, F.lit("empty"))
        .when(F.col("size_bytes") > F.col("limit_mb").cast("bigint") * 1048576, F.lit("too_large"))
        .otherwise(F.lit("ok")),
    )


# --- routes ----------------------------------------------------------------


def known_annex(text) -> Column:
    return bind(norm_punct(text), lambda t: contains_count(t, V.ANNEX_MARKERS) >= 5)


def route_strategy(df: DataFrame) -> DataFrame:
    """Order of work for a document.

    Needs ``mime_type, size_bytes, document_kind, page_count, text_length, known_annex,
    profile_id``.  Scanned PDFs go to the advanced reader first; small PDFs are read directly;
    long text PDFs in chunks; ``local_allowed`` says whether plain text may be the last resort.
    """
    pdf = F.col("mime_type") == "application/pdf"
    vision = F.coalesce(extraction_profile("profile_id") == "vision-table", F.lit(False))
    long_text = (F.col("text_length") > 500) & (F.col("page_count") > 5) & ~F.col("known_annex")
    return df.withColumns({
        "strategy": F.when(pdf & (F.col("document_kind") == "scanned_pdf"), F.lit("advanced"))
        .when(~pdf, F.lit("direct"))
        .when(vision, F.lit("direct_then_pages"))
        .when(F.col("size_bytes") <= 2 * 1024 * 1024, F.lit("direct_then_chunks"))
        .when(long_text, F.lit("chunks"))
        .otherwise(F.lit("direct")),
        "local_allowed": pdf & ~vision & (F.col("text_length") > 0),
    })


def visual_retry_eligible(df: DataFrame, enabled: bool = True) -> Column:
    """Whether a weak result may be retried by the visual reader."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    supported = F.col("mime_type").isin("application/pdf", "image/jpeg", "image/png")
    weak = (
        flag("gate_failed") | (F.coalesce(F.col("tables_detected"), F.lit(True)) == False)  # noqa: E712
        | (F.col("mime_type") != "application/pdf") | (F.col("document_kind") == "scanned_pdf")
        | flag("has_table_signals") | flag("rotation_detected") | flag("scanned_text_warning")
    )
    return F.lit(enabled) & (trim_ws(F.coalesce("text", F.lit(""))) != "") & supported & weak


def classify_error(df: DataFrame, message: str = "error_text") -> DataFrame:
    """Ordered error taxonomy over error name and text, plus a retryable flag."""
    low = F.lower(F.coalesce(F.col(message), F.lit("")))
    any_of = lambda t, words: t.rlike("|".join(re.escape(w) for w in words))

    def kind(t: Column) -> Column:
        out = F
        for name, words in V.ERROR_CLASSES:
            out = out.when(any_of(t, words), F.lit(name))
        return out.otherwise(F.lit("other"))

    code = "(?<![a-z0-9_])(?:429|500|502|503|504)(?![a-z0-9_])"
    return df.withColumns({
        "error_class": bind(low, kind), "retryable": bind(low, lambda t: t.rlike(code) | any_of(t, V.RETRYABLE)),
    })
