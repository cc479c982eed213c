"""Supplier tables recovered from recorded rows, delimited lines or line layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import ids
from ..functions.text import EDGE_R, bind, clean_cell, norm_key, trim_ws
from .blocks import line_blocks, page_block
from .ordered import carry_last
from .people import first_index, raw_lines, rest
from .storage import materialize
from .tables import (
    dedupe_first, detected_supplier_headers, normalize_candidate_rows, supplier_cells, supplier_header,
)

_NOISE = r"(?i)camscanner|https?://|^\s*(pagina|página)\s+\d+\s+tabla\s+\d+\s*$"
_METADATA = "(?i)^(folio|secretaria|sec|pagina|página)" + EDGE_R


def useful_lines(text: Column) -> Column:
    return F.filter(F.transform(raw_lines(text), clean_cell), lambda x: (x != "") & ~x.rlike(_NOISE))


def metadata_line(c: Column) -> Column:
    """Header names and stamps, which are not row content."""
    return supplier_header(c).isNotNull() | c.rlike(_METADATA)


def extract_pipe_rows(pages: DataFrame) -> DataFrame:
    """Delimited rows under the nearest header line above them.

    A line that resolves at least five headers becomes the header map; later lines that hold
    a CUIT are read by position.  The map carries across pages.
    """
    lines = pages.select(
        "doc_id", "page_number", F.posexplode(F.filter(useful_lines(F.col("text")), lambda x: x.contains("|"))).alias("pos", "line")
    )
    cells = F.transform(F.split("line", r"\|", -1), clean_cell)
    lines = lines.withColumn("_cells", cells).withColumn("_map", F.transform("_cells", supplier_header))
    is_header = F.size(F.filter("_map", lambda x: x.isNotNull())) >= 5
    lines = lines.withColumns({
        "_header": F.when(is_header, F.col("_map")),
        "_row": ~is_header & F.exists("_cells", lambda x: x.rlike(V.CUIT)),
        "_block": page_block("page_number"),
    }).where(F.col("_row") | F.col("_header").isNotNull())
    held = carry_last(lines, ["doc_id"], "_block", ["page_number", "pos"], {"header": F.col("_header")})
    return held.where(F.col("_row") & F.col("header").isNotNull()).select(
        "doc_id", F.struct("page_number", "pos").alias("row_idx"), supplier_cells(F.col("header"), F.col("_cells")).alias("cells")
    )


def _layout_lines(text: Column) -> Column:
    kept = F.filter(useful_lines(text), lambda x: ~x.contains("|") & supplier_header(x).isNull())
    return F.transform(kept, lambda x: F.struct(
        x.alias("t"), F.nullif(F.regexp_extract(x, V.CUIT, 0), F.lit("")).alias("cuit"),
        x.rlike(_METADATA).alias("meta"),
    ))


def extract_around_cuit(pages: DataFrame) -> DataFrame:
    """Rows laid out over several lines around a CUIT.

    Name and provider are the two lines above; service, province, zone, date and mode follow.
    The last two lines before the next CUIT belong to the next row.

    Lines after the last CUIT of a block go on in later blocks. Each stretch is summed up where it lies: its
    first province and first date with the text before, between and after them. A row is made of one summary
    for each block it reaches; how many closing lines go to the next row is known from counts, one row a block.
    """
    blocks = line_blocks(pages, _layout_lines, margin=4)
    at = F.filter(F.sequence(F.col("first"), F.col("last")), lambda i: F.get(F.col("lines"), i - 1)["cuit"].isNotNull())
    blocks = blocks.withColumn("_at", at)
    entered = blocks.join(_continued(blocks), ["doc_id", "block"])
    rows = entered.select("doc_id", F.inline(_stretches())).groupBy("doc_id", "block", "pos").agg(
        F.max("cuit").alias("cuit"), F.max("behind").alias("behind"), F.sort_array(F.collect_list(F.struct("at", _summary(F.col("c")).alias("s")))).alias("s"))
    return _supplier_rows(rows.select("doc_id", "block", "pos", "cuit", "behind", _parts(F.transform("s", lambda x: x["s"])).alias("parts")))


def _content(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: ~x["meta"]), lambda x: x["t"])


def _lead() -> Column:
    """Content lines of a block before its first CUIT."""
    end = F.when(F.size("_at") > 0, F.get("_at", F.lit(0)) - 1).otherwise(F.col("last"))
    return _content(F.slice("lines", F.col("first"), F.greatest(end - F.col("first") + 1, F.lit(0))))


def _tail() -> Column:
    """Content lines of a block after its last CUIT; null without one."""
    at = F.element_at("_at", -1)
    return F.when(F.size("_at") > 0, _content(F.slice("lines", at + 1, F.col("last") - at)))


def _continued(blocks: DataFrame) -> DataFrame:
    """Per block: the last CUIT before it, and how many closing lines of its lead and of its tail belong to the next row."""
    facts = blocks.select("doc_id", "block", F.size(_lead()).alias("lead_n"), F.size(F.coalesce(_tail(), F.array().cast("array<string>"))).alias("tail_n"),
                          F.when(F.size("_at") > 0, F.element_at("_at", -1)).alias("anchor"))
    doc = Window.partitionBy("doc_id").orderBy("block")
    earlier, later = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    owner = F.when(F.col("anchor").isNotNull(), F.struct("block", F.col("anchor").alias("pos")))
    facts = facts.withColumns({
        "owner": F.last(owner, ignorenulls=True).over(earlier), "follows": F.first("anchor", ignorenulls=True).over(later).isNotNull(),
        "group": F.coalesce(F.count("anchor").over(earlier), F.lit(0))})
    # Leads of one group belong to one CUIT: those up to and with the lead of the block that has the next one.
    same = Window.partitionBy("doc_id", "group").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    facts = facts.withColumn("after", F.coalesce(F.sum("lead_n").over(same), F.lit(0)))
    facts = facts.withColumn("all_after", F.coalesce(F.lead(F.col("after") + F.col("lead_n")).over(doc), F.lit(0)))
    ends = F.col("follows") | F.col("anchor").isNotNull()
    cut = lambda on, n, after: F.when(on, F.least(F.greatest(2 - after, F.lit(0)), n)).otherwise(0)
    return facts.select(
        "doc_id", "block", "owner",
        cut(ends, F.col("lead_n"), F.col("after")).alias("lead_cut"), cut(F.col("follows"), F.col("tail_n"), F.col("all_after")).alias("tail_cut"))


def _without_last(lines: Column, n: Column) -> Column:
    return F.slice(lines, F.lit(1), F.size(lines) - n)


def _summary(c: Column) -> Column:
    """First province and date of content lines, and the text before, between and after them."""
    join = lambda values: F.array_join(values, " ")

    def parts(facts: Column) -> Column:
        lines, p, d = facts["c"], facts["p"], facts["d"]
        n = F.size(lines)
        piece = lambda start, end: join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))))  # noqa: E731  0-based [start, end)
        return F.struct(
            n.alias("n"), F.when(p > 0, ids.supplier_province(F.get(lines, p - 1))).alias("province"), F.when(d > 0, F.get(lines, d - 1)).alias("date"),
            join(lines).alias("all"), piece(F.lit(0), p - 1).alias("before_p"), F.when(p > 0, piece(p, n)).alias("after_p"),
            piece(F.lit(0), d - 1).alias("before_d"), F.when(d > 0, piece(d, n)).alias("after_d"), piece(p, d - 1).alias("between"),
            F.get(lines, F.lit(0)).alias("head"), piece(F.lit(1), n).alias("after_head"), piece(F.lit(0), n - 1).alias("before_last"),
            piece(F.lit(1), n - 1).alias("middle"), piece(F.lit(1), d - 1).alias("head_to_d"), piece(p, n - 1).alias("p_to_last"),
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), lines), -1).alias("foot"))

    found = F.struct(c.alias("c"), first_index(c, lambda x: ids.supplier_province(x).isNotNull()).alias("p"),
                     first_index(c, lambda x: x.rlike(V.CONTRACT_DATE)).alias("d"))
    return bind(found, parts)


def _stretches() -> Column:
    """The stretches of lines of a block: one for each of its CUITs, with the lines above it, and its lead."""
    lines = F.col("lines")
    has = lambda x: x["cuit"].isNotNull()

    def stretch(i: Column, k: Column) -> Column:
        lo = F.greatest(i - 4, F.lit(1))
        is_last = k == F.size("_at") - 1
        after = _content(F.slice(lines, i + 1, F.coalesce(F.get("_at", k + 1), F.col("last") + 1) - i - 1))
        cut = F.when(is_last, F.col("tail_cut")).otherwise(F.least(F.lit(2), F.size(after)))
        return F.struct(F.col("block").alias("block"), i.alias("pos"), F.col("block").alias("at"), F.get(lines, i - 1)["cuit"].alias("cuit"),
                        _behind(F.slice(lines, lo, i - lo), has).alias("behind"), _without_last(after, cut).alias("c"))

    lead = F.struct(
        F.col("owner.block").alias("block"), F.col("owner.pos").alias("pos"), F.col("block").alias("at"), F.lit(None).cast("string").alias("cuit"),
        F.lit(None).cast("array<string>").alias("behind"), _without_last(_lead(), F.col("lead_cut")).alias("c"))
    return F.concat(F.transform("_at", stretch), F.filter(F.array(lead), lambda x: x["block"].isNotNull() & (F.size(x["c"]) > 0)))


def _parts(summaries: Column) -> Column:
    """Service, province, zone, date and mode from the summaries of a row's lines, in order."""

    def of(s: Column) -> Column:
        n = F.size(s)
        pi, di = first_index(s, lambda x: x["province"].isNotNull()), first_index(s, lambda x: x["date"].isNotNull())
        p, d, last = F.get(s, pi - 1), F.get(s, di - 1), F.get(s, n - 1)
        first = F.get(s, F.lit(0))
        text = lambda lo, hi: F.array_join(F.transform(  # noqa: E731  whole summaries strictly between two places
            F.slice(s, lo + 1, F.greatest(hi - lo - 1, F.lit(0))), lambda x: x["all"]), " ")
        words = lambda *v: F.concat_ws(" ", *v)
        # The zone begins after the province, or after the first line, and ends before the date, or before the last line.
        start, begin = F.greatest(pi, F.lit(1)), F.when(pi > 0, p["after_p"]).otherwise(first["after_head"])
        stop, finish = F.when(di > 0, di).otherwise(n), F.when(di > 0, d["before_d"]).otherwise(last["before_last"])
        within = F.when((pi > 0) & (di > 0), p["between"]).when(pi > 0, p["p_to_last"]).when(di > 0, first["head_to_d"]).otherwise(first["middle"])
        return F.struct(
            F.when(pi > 0, words(text(F.lit(0), pi), p["before_p"])).otherwise(first["head"]).alias("service"), p["province"].alias("province"),
            F.when(start < stop, words(begin, text(start, stop), finish)).when(start == stop, within).alias("zone"), d["date"].alias("date"),
            F.when(di > 0, words(d["after_d"], text(di, n + 1))).otherwise(last["foot"]).alias("mode"))

    return bind(F.filter(summaries, lambda x: x["n"] > 0), of)


def _supplier_rows(rows: DataFrame) -> DataFrame:
    nth_last = lambda k: F.get("behind", F.size("behind") - k)
    values = [nth_last(2), nth_last(1), F.col("cuit"), *[F.col(f"parts.{c}") for c in ("service", "province", "zone", "date", "mode")]]
    cells = [F.col("cuit") if i == 2 else F.coalesce(clean_cell(v), F.lit("")) for i, v in enumerate(values)]
    pairs = [x for name, v in zip(V.SUPPLIER_COLUMNS, cells) for x in (F.lit(name), v)]
    return rows.select("doc_id", F.struct("block", "pos").alias("row_idx"), F.create_map(*pairs).alias("cells"))


def _behind(lines: Column, has) -> Column:
    """Content lines above an anchor, after the previous anchor if it is that close."""
    cut = F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(has(x), i + 1))), F.lit(0))
    return F.transform(F.filter(rest(lines, cut + 1), lambda x: ~x["meta"]), lambda x: x["t"])


def usable_supplier_row(cells) -> Column:

    def usable(c: Column) -> Column:
        has = lambda k: F.coalesce(c[k], F.lit("")) != ""
        return ids.valid_cuit(c["CUIT"]) & has("Proveedor") & (has("Nombre empresa") | has("Servicio/Área"))

    return bind(cells, usable)


def supplier_signature(cells: str = "cells") -> Column:
    return bind(cells, lambda c: F.concat_ws("|", c["CUIT"], norm_key(c["Proveedor"]), norm_key(c["Servicio/Área"])))


def supplier_documents(pages: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Documents with at least five supplier headers and five distinct CUITs."""
    per_page = pages.select(
        "doc_id", F.array_distinct(F.concat(
            F.transform(detected_supplier_headers("text"), lambda h: F.concat(F.lit("h"), h)),
            F.transform(F.regexp_extract_all("text", F.lit(V.CUIT), F.lit(0)), lambda x: F.concat(F.lit("c"), x)),
        )).alias("f"))
    if headers is not None:
        # Recorded header names count together with the text.
        per_page = per_page.unionByName(headers.select(
            "doc_id", F.transform(detected_supplier_headers(F.array_join("columns", " ")), lambda h: F.concat(F.lit("h"), h)).alias("f")))
    found = per_page.select("doc_id", F.explode("f").alias("f")).distinct()
    return found.groupBy("doc_id").agg(
        F.count_if(F.col("f").startswith("h")).alias("headers"), F.count_if(F.col("f").startswith("c")).alias("cuits"),
    ).where((F.col("headers") >= 5) & (F.col("cuits") >= 5))


def recover_supplier_table(
    pages: DataFrame,
    reviewer_confidence: DataFrame,
    reviewed_rows: DataFrame | None = None,
    extracted_rows: DataFrame | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """Best of four candidate tables per document, if it has at least five usable rows.

    Recorded rows come as ``doc_id, row_idx bigint, cells``; the order of preference on a tie
    is reviewer, extractor, delimited lines, line layout.
    """
    docs = materialize(supplier_documents(pages, headers).select("doc_id"))
    gated = pages.join(docs, "doc_id", "left_semi")
    slot = lambda df, rank, a, b: df.select(
        "doc_id", F.lit(rank).alias("candidate"), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")).alias("row_idx"), "cells")
    parts = [
        slot(extract_pipe_rows(gated), 3, F.col("row_idx.page_number"), F.col("row_idx.pos")),
        slot(extract_around_cuit(gated), 4, F.col("row_idx.block"), F.col("row_idx.pos")),
    ]
    for rank, rows in ((1, reviewed_rows), (2, extracted_rows)):
        if rows is not None:
            kept = rows.join(docs, "doc_id", "left_semi")
            parts.append(slot(normalize_candidate_rows(kept), rank, F.col("row_idx"), F.lit(0)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # Read three times below: counts, choice, result.
    usable = materialize(dedupe_first(union, supplier_signature()).where(usable_supplier_row("cells")))
    counts = usable.groupBy("doc_id", "candidate").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id").agg(F.max_by(F.struct("candidate", "n"), F.struct("n", -F.col("candidate"))).alias("b"))
    best = best.select("doc_id", "b.*").where(F.col("n") >= 5)
    names = F.array(*[F.lit(x) for x in ("reviewer_rows", "extractor_rows", "document_table", "text_layout")])
    return usable.join(best, ["doc_id", "candidate"]).join(reviewer_confidence, "doc_id").select(
        "doc_id", "row_idx", F.get(names, F.col("candidate") - 1).alias("source"),
        F.greatest("reviewer_confidence", F.lit(0.65)).alias("confidence"), "cells",
        F.array(*[F.lit(w) for w in V.RECOVERY_WARNINGS]).alias("warnings"),
    )


def count_valid_cuits(rows: DataFrame) -> DataFrame:
    """Distinct well-formed CUITs in the rows of each document."""
    found = F.nullif(F.regexp_extract(trim_ws(F.col("cells")["CUIT"]), V.CUIT, 0), F.lit(""))
    return rows.groupBy("doc_id").agg(F.count_distinct(found).alias("cuits"))
