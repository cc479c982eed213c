"""Cutting a document into blocks must not change any result."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliotab.functions import fixed_values as V
from foliotab.operators import blocks, people, sections, suppliers
from foliotab.plans import corpora as C


def rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


CASES = {
    "roster": lambda s, sf: people.extract_roster(C.roster_pages(s, sf)).drop("block", "pos"),
    "company": lambda s, sf: people.extract_company_personnel(C.company_pages(s, sf)).drop("block", "pos"),
    "pipe": lambda s, sf: suppliers.extract_pipe_rows(C.supplier_pipe_pages(s, sf)),
    "layout": lambda s, sf: suppliers.extract_around_cuit(C.supplier_layout_pages(s, sf)).drop("row_idx"),
    "annex": lambda s, sf: sections.extract_annex_rows(C.annex_pages(s, sf)),
    "sections": lambda s, sf: sections.extract_sections(C.section_pages(s, sf)),
    "positions": lambda s, sf: sections._positions(C.section_pages(s, sf)).drop("block"),
    "markers": lambda s, sf: sections.document_markers(C.annex_pages(s, sf), V.ANNEX_MARKERS),
}


@pytest.mark.parametrize("name", CASES)
def test_block_size_is_invisible(spark, sf, monkeypatch, name):
    whole = rows(CASES[name](spark, sf))
    assert whole
    monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", 1)
    assert rows(CASES[name](spark, sf)) == whole


@pytest.mark.parametrize("name", [n for n in CASES if n != "pipe"])
def test_pieces_of_long_pages_are_invisible(spark, sf, monkeypatch, name):
    whole = rows(CASES[name](spark, sf))
    for pages_per_block, chars in ((64, 40), (3, 90)):
        monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", pages_per_block)
        monkeypatch.setattr(blocks, "PIECE_CHARS", chars)
        assert rows(CASES[name](spark, sf)) == whole


def test_pieces_of_a_long_page(spark):
    text = "".join(f"line {i}" + ("\r\n", "\n", "\r", "\n\n")[i % 4] for i in range(400)) + "the end"
    df = spark.createDataFrame([(text,), ("",), ("x" * 5000,), (None,)], "text string")
    got = [r[0] for r in df.select(blocks.page_pieces(F.col("text"), 100)).collect()]
    split = lambda t: [x for x in re.split(r"\r\n?|\n", t) if x]
    assert len(got[0]) > 25 and max(map(len, got[0])) < 130 and [x for p in got[0] for x in split(p)] == split(text)
    assert got[1] == [""] and got[2] == ["x" * 5000] and got[3] == [None]


def test_layout_rows_over_pages_without_anchor(spark, monkeypatch):
    head = "Nombre empresa\nProveedor\nCUIT\nServicio/Área\nProvincia\nRadicación\n"
    pages = [(1, 1, head + "Uno SA\nFirma uno\n20-00000001-1\nCatering"), (1, 2, "Salta"), (1, 3, "Zona A\nparque"),
             (1, 4, "01/02/2023\nContrato\nDos SA"), (1, 5, "Firma dos"), (1, 6, "20-00000002-2\nLimpieza\nJujuy\nZona B\n02/02/2023\nOrden")]
    df = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    whole = rows(suppliers.extract_around_cuit(df), "row_idx")
    assert "Zona A parque" in whole[0] + whole[1] and "Firma dos" in whole[0] + whole[1]
    monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", 1)
    assert rows(suppliers.extract_around_cuit(df), "row_idx") == whole


def layout_row(lines, at, stop, has_next):
    """Cells of the CUIT in line ``at`` of a document's layout lines, read in one pass."""
    cuit = re.compile(r"\d{2}-\d{8}-\d")
    behind = lines[max(0, at - 4):at]
    behind = behind[max([k + 1 for k, x in enumerate(behind) if cuit.search(x)], default=0):]
    c = lines[at + 1:stop]
    c = c[:max(0, len(c) - 2)] if has_next else c
    p = next((i + 1 for i, x in enumerate(c) if x in ("Salta", "Jujuy")), 0)
    d = next((i + 1 for i, x in enumerate(c) if re.search(r"\d\d/\d\d/\d{4}", x)), 0)
    service = c[:p - 1 if p else 1]
    zone = c[p or 1:d - 1 if d else max(len(c) - 1, 1)]
    mode = c[d:] if d else c[-1:]
    return (" ".join(behind[-2:-1]), " ".join(behind[-1:]), cuit.search(lines[at])[0], " ".join(service), c[p - 1] if p else "",
            " ".join(zone), c[d - 1] if d else "", " ".join(mode))


@pytest.mark.parametrize("seed", range(3))
def test_layout_rows_equal_one_pass(spark, monkeypatch, seed):
    rng, rows, want = random.Random(seed), [], []
    for doc in range(12):
        lines = []
        for page in range(1, 9):
            own = [rng.choice(["Salta", "Jujuy", "01/02/2023", "Zona A", "Obra", "Contrato", "Firma uno", f"20-0000000{rng.randrange(9)}-1"])
                   for _ in range(rng.choice([0, 1, 1, 2, 6]))]
            rows.append((doc, page, "\n".join(own)))
            lines += own
        anchors = [i for i, x in enumerate(lines) if x.startswith("20-")]
        want += [(doc, *layout_row(lines, at, stop, stop < len(lines))) for at, stop in zip(anchors, [*anchors[1:], len(lines)])]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, text string")
    for pages_per_block in (1, 3, 64):
        monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", pages_per_block)
        got = [(r.doc_id, *(r.cells[c] for c in V.SUPPLIER_COLUMNS)) for r in suppliers.extract_around_cuit(df).collect()]
        assert sorted(got) == sorted(want)


def test_layout_rows_need_few_exchanges(spark):
    df = spark.createDataFrame([(1, 1, "x")], "doc_id int, page_number int, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false")):
        spark.conf.set(k, v)
    plan = suppliers.extract_around_cuit(df)._jdf.queryExecution().executedPlan().toString()
    for k, v in held.items():
        spark.conf.set(k, v)
    assert 0 < len(re.findall(r"[-+:] \*?(?:\(\d+\) )?Exchange ", plan)) <= 10
