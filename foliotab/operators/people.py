"""Personnel rosters and company personnel lists rebuilt from identifier anchors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import ids
from ..functions.text import collapse, norm_words, sanitize_raw_text, trim_ws
from .blocks import line_blocks, part_before


def raw_lines(text: Column) -> Column:
    return F.split(text, r"\r\n?|\n", -1)


def first_index(values: Column, test: Callable[[Column], Column]) -> Column:
    """1-based position of the first match, 0 if none."""
    return F.coalesce(F.array_min(F.transform(values, lambda x, i: F.when(test(x), i + 1))), F.lit(0))


def last_index(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_max(F.transform(values, lambda x, i: F.when(test(x), i + 1))), F.lit(0))


def rest(values: Column, start: Column) -> Column:
    """Elements from a 1-based position on."""
    return F.slice(values, start, F.greatest(F.size(values) - start + 1, F.lit(0)))


def anchor_rows(blocks: DataFrame, is_anchor, before: int, after: int, *keep: str) -> DataFrame:
    """One row per anchor line: own line and the lines around it up to the next anchors.

    At most ``before`` lines above and ``after`` lines below; ``blocks`` needs a margin of both.
    """
    lines = F.col("lines")

    def around(i: Column) -> Column:
        lo = F.greatest(i - before, F.lit(1))
        ahead = F.slice(lines, i + 1, F.least(F.lit(after), F.size(lines) - i))
        behind = F.slice(lines, lo, i - lo)
        return F.struct(i.alias("pos"), F.get(lines, i - 1).alias("line"),
                        behind.alias("behind"), ahead.alias("ahead"))

    own = F.filter(F.sequence(F.col("first"), F.col("last")), lambda i: is_anchor(F.get(lines, i - 1)))
    rows = blocks.select("doc_id", "block", *keep, F.inline(F.transform(own, around)))
    stop = first_index(F.col("ahead"), is_anchor)
    return rows.withColumns({
        "behind": rest(F.col("behind"), last_index(F.col("behind"), is_anchor) + 1),
        "ahead": F.when(stop > 0, F.slice("ahead", F.lit(1), stop - 1)).otherwise(F.col("ahead")),
    })


# --- roster ----------------------------------------------------------------


def roster_lines(text: Column) -> Column:
    cleaned = F.filter(F.transform(raw_lines(text), ids.clean_roster_line), lambda x: x != "")
    return F.transform(
        cleaned, lambda x: F.struct(x.alias("t"), F.regexp_count(x, F.lit(V.CUIL)).alias("n"))
    )


def extract_roster(pages: DataFrame) -> DataFrame:
    """One row per CUIL: order number, name, workplace, locality and province around it.

    Result: ``doc_id, block, pos, nth`` (document order) and the six roster columns.
    """
    blocks = line_blocks(pages, roster_lines, margin=8)
    rows = anchor_rows(blocks, lambda x: x["n"] > 0, 8, 8)
    rows = rows.select(
        "doc_id", "block", (F.col("pos")).alias("pos"), F.col("line")["t"].alias("line"),
        F.col("line")["n"].alias("n"),
        F.transform("behind", lambda x: x["t"]).alias("behind"),
        F.transform("ahead", lambda x: x["t"]).alias("ahead"),
        F.posexplode(F.regexp_extract_all(F.col("line")["t"], F.lit(V.CUIL), F.lit(0))).alias("nth", "cuil"),
    )
    none = F.array().cast("array<string>")
    rows = rows.withColumn("lead_text", part_before(F.col("line"), V.CUIL, F.col("nth")))
    tail = trim_ws(F.substring("line", F.length("lead_text") + F.length("cuil") + 1, F.length("line")))
    rows = rows.select(
        "doc_id", "block", "pos", "nth", "cuil",
        trim_ws("lead_text").alias("prefix"),
        F.when(F.col("nth") == 0, F.col("behind")).otherwise(none).alias("behind"),
        F.filter(
            F.concat(F.array(tail), F.when(F.col("nth") == F.col("n") - 1, F.col("ahead")).otherwise(none)),
            lambda x: x != "",
        ).alias("ahead"),
    )
    return _roster_cells(rows)


def _roster_cells(rows: DataFrame) -> DataFrame:
    number_line = r"^\s*(\d{1,4})\s*$"
    lead_number = F.regexp_extract("prefix", r"^\s*(\d{1,4})(?![A-Za-z0-9_])", 1)
    above = F.element_at(
        F.concat(F.array(F.lit("")), F.filter("behind", lambda x: x.rlike(number_line))), -1
    )
    bare = lambda x: trim_ws(F.regexp_replace(x, r"^\s*\d{1,4}\s*[-.)]?\s*", ""))

    behind = F.col("behind")
    province_at = last_index(behind, ids.has_province)
    place_at = last_index(behind, ids.has_workplace)
    start = F.when(province_at > 0, province_at + 1).when(
        place_at > 0, F.least(place_at + 3, F.size(behind) + 1)
    ).otherwise(F.lit(1))
    rows = rows.withColumns({
        "_number": F.when(lead_number != "", lead_number).otherwise(F.regexp_extract(above, number_line, 1)),
        "_own": bare(F.col("prefix")),
        "_prelude": rest(behind, start),
        "_context": F.array_join("ahead", " | "),
    })
    named = F.element_at(
        F.concat(F.array(F.lit("")), F.filter(F.transform("_prelude", bare), ids.likely_person_name)), -1
    )
    context = F.col("_context")
    rows = rows.withColumns({
        "_name": F.when(ids.likely_person_name("_own"), F.col("_own")).otherwise(named),
        "_place": F.regexp_extract(context, V.WORKPLACE, 0),
        "_place_at": F.regexp_instr(context, F.lit(V.WORKPLACE)),
        "_prov": ids.last_province(context),
    })
    after_place = F.when(F.col("_place_at") > 0, F.col("_place_at") + F.length("_place")).otherwise(F.lit(1))
    between = F.substring(context, after_place, F.greatest(F.col("_prov")["pos"] - after_place + 1, F.lit(0)))
    ahead = F.col("ahead")
    line_province, line_place = first_index(ahead, ids.has_province), first_index(ahead, ids.has_workplace)
    stop = F.when(line_province > 0, line_province - 1).otherwise(F.size(ahead))
    candidates = F.slice(ahead, line_place + 1, F.greatest(stop - line_place, F.lit(0)))
    other = F.get(F.filter(F.transform(candidates, ids.clean_locality), lambda x: x != ""), F.lit(0))
    near = F.when(F.col("_prov")["pos"] >= 0, F.nullif(ids.clean_locality(between), F.lit("")))
    value = ids.normalize_roster_value
    return rows.select(
        "doc_id", "block", "pos", "nth",
        F.col("_number").alias("Numero"),
        value("NombreApellido", "_name").alias("NombreApellido"),
        value("CUIL", "cuil").alias("CUIL"),
        value("LugarTrabajo", "_place").alias("LugarTrabajo"),
        value("Localidad", F.coalesce(near, other, F.lit(""))).alias("Localidad"),
        value("Provincia", F.coalesce(F.col("_prov")["name"], F.lit(""))).alias("Provincia"),
    )


def _with(column: str) -> Column:
    return F.count_if(trim_ws(F.coalesce(F.col(column), F.lit(""))) != "")


def _province_known(column: str = "Provincia") -> Column:
    return ids.province(F.coalesce(F.col(column), F.lit(""))).isNotNull()


def roster_metrics(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Filled-cell counts and completeness per document (one partial aggregate)."""
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("totalRegistros"),
        _with("Numero").alias("_numero"),
        _with("NombreApellido").alias("filasConNombre"),
        F.count_if(ids.valid_cuil("CUIL")).alias("filasConCUIL"),
        _with("LugarTrabajo").alias("filasConLugarTrabajo"),
        _with("Localidad").alias("filasConLocalidad"),
        F.count_if(_province_known()).alias("filasConProvincia"),
    )
    filled = sum((F.col(c) for c in ("filasConNombre", "filasConCUIL", "filasConLugarTrabajo",
                                     "filasConLocalidad", "filasConProvincia")), F.col("_numero"))
    possible = F.col("totalRegistros") * len(V.ROSTER_COLUMNS)
    return agg.withColumn(
        "porcentajeCompletitud", F.floor(filled / possible * 1000 + 0.5).cast("double") / 10
    ).drop("_numero")


def roster_assessment(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",), anchors: str | None = None) -> DataFrame:
    """Valid rows, score and gate per document; ``anchors`` names a detected-CUIL count column."""
    valid = ids.valid_cuil("CUIL") & ids.likely_person_name("NombreApellido") & _province_known()
    detected = F.max(anchors) if anchors else F.count("*")
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), detected.alias("detected_cuils"),
        F.count_if(_province_known()).alias("province_rows"), F.count_if(valid).alias("valid_rows"),
    )
    base = F.greatest("detected_cuils", "n_rows", F.lit(1))
    agg = agg.withColumn("quality_score", F.floor(F.col("valid_rows") / base * 100 + 0.5).cast("double") / 100)
    large = (F.col("detected_cuils") > 100) & (F.col("province_rows") > 80)
    regular = (F.col("detected_cuils") > 0) & (F.col("valid_rows") > 0)
    return agg.withColumn("acceptable", (large | regular) & (F.col("quality_score") >= 0.65))


# --- company personnel -----------------------------------------------------


def company_lines(text: Column) -> Column:
    """Lines split around identifiers, cleaned and marked."""
    split = F.flatten(F.transform(
        raw_lines(text),
        lambda x: F.split(F.regexp_replace(collapse(x), f"{V.CUIT}|{V.DNI}", "\n$0\n"), "\n", -1),
    ))
    cleaned = F.filter(F.transform(split, ids.clean_company_line), lambda x: x != "")
    return F.transform(
        cleaned,
        lambda x: F.struct(
            x.alias("t"),
            F.nullif(F.regexp_extract(x, V.CUIT, 0), F.lit("")).alias("cuit"),
            F.when(ids.likely_company(x), collapse(x)).alias("company"),
            F.when(~x.rlike(V.CUIT), F.nullif(F.regexp_extract(x, V.DNI, 0), F.lit(""))).alias("dni"),
        ),
    )


def _last_of(field: str):
    return lambda lines: F.element_at(
        F.concat(F.array(F.lit(None).cast("string")),
                 F.filter(F.transform(lines, lambda x: x[field]), lambda v: v.isNotNull())), -1
    )


def extract_company_personnel(pages: DataFrame) -> DataFrame:
    """One row per DNI: the nearest company and CUIT above it, name before, places after."""
    blocks = line_blocks(
        pages, company_lines, margin=8,
        carry={"carried_company": _last_of("company"), "carried_cuit": _last_of("cuit")},
    )
    blocks = _with_positions(blocks)
    rows = anchor_rows(
        blocks, lambda x: x["dni"].isNotNull(), 8, 7, "company_at", "cuit_at", "carried_company", "carried_cuit"
    )
    seen = lambda field: F.element_at(
        F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col(f"carried_{field}").alias("v"))),
                 F.filter(f"{field}_at", lambda p: p["at"] < F.col("pos"))), -1
    )
    rows = rows.withColumns({"_company": seen("company"), "_cuit": seen("cuit")})
    context_start = F.when(F.col("_cuit")["at"] > 0, F.col("_cuit")["at"]).otherwise(F.col("_company")["at"])
    skip = F.greatest(context_start - (F.col("pos") - F.size("behind")) + 1, F.lit(0))
    rows = rows.select(
        "doc_id", "block", "pos",
        F.coalesce(F.col("_company")["v"], F.lit("")).alias("Empresa"),
        F.coalesce(F.col("_cuit")["v"], F.lit("")).alias("CUIT"),
        F.col("line")["dni"].alias("DNI"),
        F.transform(rest(F.col("behind"), skip + 1), lambda x: x["t"]).alias("behind"),
        F.transform("ahead", lambda x: x["t"]).alias("ahead"),
    )
    names = F.filter("behind", ids.likely_person_name_company)
    name = F.element_at(F.concat(F.array(F.lit("")), names), -1)
    rows = rows.withColumn("_at", first_index(F.col("ahead"), lambda x: ids.province(x).isNotNull()))
    at = F.col("_at")
    nearby = F.concat(
        F.slice("ahead", at + 1, F.least(F.lit(2), F.size("ahead") - at)),
        F.slice("ahead", F.greatest(at - 2, F.lit(1)), F.least(F.lit(2), F.greatest(at - 1, F.lit(0)))),
    )
    locality = F.get(F.filter(nearby, ids.likely_locality), F.lit(0))
    return rows.select(
        "doc_id", "block", "pos", "Empresa", "CUIT",
        ids.normalize_person_name(name).alias("NombreApellido"), "DNI",
        F.when(at > 0, ids.province(F.get("ahead", at - 1))).otherwise(F.lit("")).alias("Provincia"),
        F.when(at > 0, F.coalesce(ids.locality_title(locality), F.lit(""))).otherwise(F.lit("")).alias("Localidad"),
    )


def _with_positions(blocks: DataFrame) -> DataFrame:
    """Positions and values of company and CUIT lines, computed once per block."""
    def places(field: str) -> Column:
        return F.array_compact(F.transform(
            "lines", lambda x, i: F.when(x[field].isNotNull(), F.struct((i + 1).alias("at"), x[field].alias("v")))
        ))

    return blocks.withColumns({"company_at": places("company"), "cuit_at": places("cuit")})


def company_metrics(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Eleven counts per document; distinct identifiers are the larger of text and row side."""
    blank_to_null = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    filled = sum((_with(c) for c in V.COMPANY_COLUMNS), F.lit(0))
    agg = rows.groupBy("doc_id").agg(
        F.count("*").alias("registrosEstructurados"),
        F.count_distinct(blank_to_null("Empresa")).alias("_empresas"),
        F.count_distinct(blank_to_null("CUIT")).alias("_cuits"),
        F.count_distinct(F.when(ids.valid_dni("DNI"), F.col("DNI"))).alias("_dnis"),
        _with("Empresa").alias("filasConEmpresa"), _with("CUIT").alias("filasConCUIT"),
        F.count_if(ids.valid_dni("DNI")).alias("filasConDNI"),
        F.count_if(ids.likely_person_name_company("NombreApellido")).alias("filasConNombre"),
        F.count_if(_province_known()).alias("filasConProvincia"), _with("Localidad").alias("filasConLocalidad"),
        filled.alias("_filled"),
    )
    if pages is not None:
        agg = company_text_counts(pages).join(agg, "doc_id", "left")
        agg = agg.fillna(0, [c for c in agg.columns if c != "doc_id"])
    else:
        agg = agg.withColumns({c: F.lit(0) for c in ("text_cuits", "text_dnis", "text_companies")})
    possible = F.col("registrosEstructurados") * len(V.COMPANY_COLUMNS)
    percent = F.when(possible > 0, F.floor(F.col("_filled") / possible * 1000 + 0.5).cast("double") / 10)
    return agg.select(
        "doc_id", "registrosEstructurados",
        F.greatest("text_cuits", "_cuits").alias("cuitsDetectados"),
        F.greatest("text_dnis", "_dnis").alias("dnisDetectados"),
        F.greatest("text_companies", "_empresas").alias("empresasDetectadas"),
        "filasConEmpresa", "filasConCUIT", "filasConDNI", "filasConNombre", "filasConProvincia",
        "filasConLocalidad", F.coalesce(percent, F.lit(0.0)).alias("porcentajeCompletitud"),
    )


def company_text_counts(pages: DataFrame) -> DataFrame:
    """Distinct CUIT, DNI (outside CUITs) and company lines in the text of each document."""
    no_cuit = F.regexp_replace("text", V.CUIT, " ")
    tag = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("k"), v.alias("v")))
    companies = F.transform(
        F.filter(F.transform(raw_lines(F.col("text")), ids.clean_company_line), ids.likely_company), norm_words
    )
    found = F.concat(
        tag("cuit", F.regexp_extract_all("text", F.lit(V.CUIT), F.lit(0))),
        tag("dni", F.regexp_extract_all(no_cuit, F.lit(V.DNI), F.lit(0))),
        tag("company", companies),
    )
    values = pages.select("doc_id", F.inline_outer(F.array_distinct(found))).distinct()
    return values.groupBy("doc_id").agg(
        F.count_if(F.col("k") == "cuit").alias("text_cuits"),
        F.count_if(F.col("k") == "dni").alias("text_dnis"),
        F.count_if(F.col("k") == "company").alias("text_companies"),
    )


def company_assessment(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Core ratio, gate and score of company personnel rows.

    With pages, identifiers also count from the text and a core row needs any name; without,
    the name must look like a person (the check applied to finished tables).
    """
    name_ok = (
        trim_ws("NombreApellido") != "" if pages is not None else ids.likely_person_name_company("NombreApellido")
    )
    core = (trim_ws("Empresa") != "") & name_ok & ids.valid_dni("DNI")
    cores = rows.groupBy("doc_id").agg(F.count_if(core).alias("_core"))
    m = company_metrics(rows, pages).join(cores, "doc_id", "left").fillna(0, ["_core"])
    n = F.col("registrosEstructurados")
    ratio = F.when(n > 0, F.col("_core") / n).otherwise(F.lit(0.0))
    m = m.withColumn("core_ratio", ratio)
    score = F.col("core_ratio") * 0.7 + F.col("filasConProvincia") / n * 0.15 + F.col("filasConLocalidad") / n * 0.15
    return m.withColumns({
        "acceptable": (F.col("dnisDetectados") >= 10) & (F.col("cuitsDetectados") >= 1)
        & (F.col("empresasDetectadas") >= 1) & (F.col("core_ratio") >= 0.6),
        "quality_score": F.when(n > 0, F.least(F.lit(1.0), F.floor(score * 100 + 0.5).cast("double") / 100))
        .otherwise(F.lit(0.0)),
    }).drop("_core")


def company_signals(pages: DataFrame) -> DataFrame:
    """Strict and loose presence of a company personnel list in the text."""
    c = company_text_counts(pages)
    cuit, dni, company = F.col("text_cuits") >= 1, F.col("text_dnis") >= 2, F.col("text_companies") >= 1
    return c.withColumns({"has_signals": cuit & dni & company, "has_potential": cuit | dni | company})


def company_text_score(pages: DataFrame) -> DataFrame:
    """Weighted score of a recognised text, used to compare page orientations."""
    # The pages joined by line ends.
    lengths = pages.groupBy("doc_id").agg((F.sum(F.length(trim_ws("text"))) + F.count("*") - 1).alias("_len"))
    m = company_metrics(extract_company_personnel(pages), pages).join(lengths, "doc_id")
    score = (
        F.col("cuitsDetectados") * 8 + F.col("dnisDetectados") * 5 + F.col("empresasDetectadas") * 8
        + F.col("filasConNombre") * 4 + F.col("filasConProvincia") * 2 + F.col("filasConLocalidad") * 2
        + F.least(F.col("_len") / 500, F.lit(10.0))
    )
    return m.select("doc_id", score.alias("text_score"))


def best_orientation(readings: DataFrame) -> DataFrame:
    """Best of the readings at 0, 90, 180 and 270 degrees; ties keep the earlier one.

    ``readings``: ``doc_id, orientation, text, mime_type``.  Only images whose upright reading
    shows any sign of a company list are compared; all others stay at 0.
    """
    clean = readings.withColumn("text", sanitize_raw_text("text"))
    keyed = clean.select(F.struct("doc_id", "orientation").alias("doc_id"), F.lit(1).alias("page_number"), "text")
    scored = company_text_score(keyed).select("doc_id.*", "text_score")
    upright = clean.where(F.col("orientation") == 0)
    signals = company_signals(upright.select("doc_id", F.lit(1).alias("page_number"), "text"))
    image = upright.select("doc_id", F.col("mime_type").isin("image/jpeg", "image/png").alias("is_image"))
    best = scored.groupBy("doc_id").agg(
        F.max_by(F.struct("orientation", "text_score"), F.struct("text_score", -F.col("orientation"))).alias("b"),
        F.max_by("text_score", -F.col("orientation")).alias("upright_score"),
    )
    choose = F.col("is_image") & F.col("has_potential")
    return best.join(signals.select("doc_id", "has_potential"), "doc_id").join(image, "doc_id").select(
        "doc_id",
        F.when(choose, F.col("b")["orientation"]).otherwise(F.lit(0)).alias("orientation"),
        F.when(choose, F.col("b")["text_score"]).otherwise(F.col("upright_score")).alias("text_score"),
    )


def first_nonempty_rotation(readings: DataFrame) -> DataFrame:
    """First rotation in the order 0, 90, 270, 180 that gave at least one row."""
    turn = F.array_position(F.array(*[F.lit(r) for r in (0, 90, 270, 180)]), F.col("rotation"))
    return readings.where(F.col("n_rows") > 0).groupBy("doc_id", "page_number").agg(
        F.min_by(F.struct("rotation", "n_rows"), turn).alias("b")
    ).select("doc_id", "page_number", "b.*")
