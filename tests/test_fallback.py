"""The local fallback reads and cleans each text once, with the rows of its methods."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliotab.functions import fixed_values as V
from foliotab.functions import text as T
from foliotab.operators import blocks, sections

SECTION = [T.py_punct(m) for m in V.SECTION_MARKERS]
PAGES = "doc_id long, page_number int, text string"


@pytest.mark.parametrize("made", [lambda df: sections.document_markers(df, SECTION), sections._positions], ids=["markers", "positions"])
def test_pages_are_cut_and_cleaned_once(spark, made):
    df = spark.range(20).select("id", F.lit(1).alias("page_number"), F.col("id").cast("string").alias("text")).select(
        F.nullif("id", F.lit(3)).alias("doc_id"), "page_number", "text")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false")):
        spark.conf.set(k, v)
    plan = made(df)._jdf.queryExecution().executedPlan().toString()
    for k, v in held.items():
        spark.conf.set(k, v)
    assert len(re.findall("REPARTITION_BY_COL", plan)) - len(re.findall(r"ReusedExchange.*REPARTITION_BY_COL", plan)) == 1


def test_texts_are_normalised_alike_in_python(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice(letters) for _ in range(rng.randrange(14))),) for _ in range(3000)
            for letters in ("aBé́Ñß .,:;()[]{}_-#°º\t\n\x0b\f\r\x1c\x85\xa0 　﻿​ İΣσ𝐀 ", "aB .,:;()[]{}_-#\t\n\x0b\f\r\x1c\x00\x7f ")]
    rows += [(f"a{chr(c)}b",) for c in range(0x20, 0x1C80)]
    got = spark.createDataFrame(rows, "t string").select("t", T.norm_punct("t").alias("n")).collect()
    assert [r for r in got if T.text_punct(r.t) != r.n] == []


def test_texts_are_cut_alike_in_python(spark):
    rows = ["".join(f"line {i}" + ("\r\n", "\n", "\r", "\n\n")[i % 4] for i in range(90)) + "the end", "", "x" * 500, "x" * 100 + "\n", "\r\n" * 90]
    df = spark.createDataFrame([(x,) for x in rows], "text string").coalesce(1)
    got = [r[0] for r in df.select(blocks.page_pieces(F.col("text"), 100)).collect()]
    assert got == [blocks.text_pieces(x, 100) for x in rows] and len(got[0]) > 5


def test_sets_of_markers_are_counted_apart(spark, monkeypatch):
    rng = random.Random(7)
    words = " ".join([*SECTION, *V.ANNEX_MARKERS]).split()
    rows = [(doc if doc else None, page, rng.choice(["", ". ", "Ñandú\n"]) + "\n".join(rng.choices(words, k=rng.choice([0, 1, 2, 30]))))
            for doc in range(40) for page in range(1, rng.choice([2, 5, 9]))] + [(50, 1, None), (50, 2, "Consumo\nde"), (50, 3, "AGUA, n°"), (50, 4, "Anexo")]
    df = spark.createDataFrame(rows, PAGES)
    for pages_per_block, chars in ((64, 1 << 18), (1, 1 << 18), (2, 25)):
        monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", pages_per_block)
        monkeypatch.setattr(blocks, "PIECE_CHARS", chars)
        apart = [{r[0]: r[1] for r in sections.document_markers(df, m).collect()} for m in (V.ANNEX_MARKERS, SECTION)]
        both = {r[0]: r[1:] for r in sections.marker_counts(df, annex=V.ANNEX_MARKERS, sections=SECTION).collect()}
        assert both == {d: tuple(x.get(d, 0) for x in apart) for d in apart[0].keys() | apart[1].keys()}
        assert both[50] == (1, 1) and max(both.values(), key=lambda x: x[1])[1] > 5


def test_each_document_takes_its_first_method(spark):
    annex = "N° Anexo | Nombre Anexo | Romano | N° Punto | Frecuencia | Tipo de Plazo | Cant. Días\n" + "\n".join(f"{i} Uno IV {i} Mensual Días hábiles {i}" for i in range(1, 5))
    section = "Empresa Sur\nTeléfono 43\nProyecto Lote\nCorreo a@b\n" + "\n".join(f"Campo {i}: valor {i}" for i in range(9))
    few = annex.rsplit("\n", 2)[0]  # two rows are too few, the lines stay
    df = spark.createDataFrame([(1, 1, annex), (2, 1, section), (3, 1, few), (4, 1, "hola\n\nque  tal"), (4, 2, None), (4, 3, "fin"), (None, 1, annex),
                                (5, 1, annex + "\n" + section)], PAGES)
    got = {(r[0], r[1]): r[2] for r in sections.local_fallback(df).groupBy("doc_id", "source").count().collect()}
    assert got == {(1, "annex_table"): 4, (2, "sections"): 13, (3, "text_lines"): 3, (4, "text_lines"): 3, (None, "text_lines"): 5, (5, "annex_table"): 4}
    assert {r["cells"]["Texto"] for r in sections.local_fallback(df).where("doc_id = 4").collect()} == {"hola", "que tal", "fin"}


def test_texts_are_split_alike_in_python(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice(" \t\f\x0b\r\r\n\nab.é\x1c\x85\xa0　﻿") for _ in range(rng.randrange(16))),) for _ in range(5000)]
    got = spark.createDataFrame(rows, "t string").select("t", T.page_lines("t").alias("n")).collect()
    assert [r for r in got if T.text_lines(r.t) != r.n] == []
