"""Hand-made documents with known tables."""

from pyspark.sql import functions as F

from foliotab.functions import text as T
from foliotab.operators import people, routing, sections, suppliers, tables
from foliotab.sources import parsed


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_number int, text string")


def test_roster_with_noise_and_misreads(spark):
    text = ("NOMINA DEL PERSONAL\n1 Perez Juan 20-12345678-9 CAMPAMENTO MARIANA OD Campo Quljano Satta\n"
            "Escaneado con CamScanner\n2\nGómez Ana María\n27234567891\nOFICINA Y PROYECTOS\n00 General Mosconl\nJWUY\n"
            "3 Lopez Raul 20345678912 Proyecto San Juan San Juan")
    got = {r["CUIL"]: r for r in people.extract_roster(pages(spark, text)).collect()}
    assert len(got) == 3
    a, b, c = got["20123456789"], got["27234567891"], got["20345678912"]
    assert (a["Numero"], a["NombreApellido"], a["Localidad"], a["Provincia"]) == ("1", "Perez Juan", "Campo Quijano", "Salta")
    assert (b["Numero"], b["NombreApellido"], b["LugarTrabajo"]) == ("2", "Gómez Ana María", "OFICINA Y PROYECTOS")
    assert (b["Localidad"], b["Provincia"]) == ("General Mosconi", "Jujuy")
    assert (c["Localidad"], c["Provincia"]) == ("San Juan", "San Juan")  # the last name is the province


def test_two_ids_on_one_line(spark):
    got = people.extract_roster(pages(spark, "Perez Juan 20123456789 Salta 20345678912 Jujuy")).orderBy("nth").collect()
    assert [(r["CUIL"], r["Provincia"]) for r in got] == [("20123456789", "Jujuy"), ("20345678912", "Jujuy")]
    assert got[0]["NombreApellido"] == "Perez Juan"


def test_company_switches_at_second_block(spark):
    text = ("Minera Uno S.R.L.\n30-11111111-1\nPerez Juan\n20111222\nSalta\nchicoana\n"
            "Minera Dos S.A.\n30-22222222-2\nDiaz Luis\n30111222\nJujuy\nperico")
    got = {r["DNI"]: r for r in people.extract_company_personnel(pages(spark, text)).collect()}
    assert (got["20111222"]["Empresa"], got["20111222"]["CUIT"]) == ("Minera Uno S.R.L.", "30-11111111-1")
    assert (got["30111222"]["Empresa"], got["30111222"]["CUIT"]) == ("Minera Dos S.A.", "30-22222222-2")
    assert (got["20111222"]["Provincia"], got["20111222"]["Localidad"]) == ("Salta", "Chicoana")
    assert got["30111222"]["NombreApellido"] == "Diaz Luis"


def test_supplier_recovery_lifts_confidence(spark):
    head = "Escaneado con CamScanner\nNombre empresa | Proveedor | CUIT | Servicio/Área | Provin. | Radicación | Fecha periodo de contratación | Modalidal contratación\n"
    body = "\n".join(f"E{i} | Firma {i} | 20-{i:08d}-1 | Catering | Salta | Zona | 01/02/2023 | Orden" for i in range(24))
    conf = spark.createDataFrame([(1, 0.41)], "doc_id long, reviewer_confidence double")
    got = suppliers.recover_supplier_table(pages(spark, head + body), conf).collect()
    assert len(got) == 24 and got[0]["confidence"] == 0.65 and got[0]["source"] == "document_table"


def test_fewer_than_five_rows_give_nothing(spark):
    head = "Nombre empresa | Proveedor | CUIT | Servicio/Área | Provincia | Radicación\n"
    body = "\n".join(f"E{i} | Firma {i} | 20-{i:08d}-1 | Catering | Salta | Zona" for i in range(4))
    conf = spark.createDataFrame([(1, 0.9)], "doc_id long, reviewer_confidence double")
    assert suppliers.recover_supplier_table(pages(spark, head + body), conf).count() == 0


def test_wrapped_lines_consume_in_pairs(spark):
    text = "1 uno\n2 dos\n3 tres\nIV 1 Mensual Permanente\nfin"
    got = [r["line"] for r in sections.join_wrapped_lines(pages(spark, text)).orderBy("pos").collect()]
    assert got == ["1 uno 2 dos", "3 tres IV 1 Mensual Permanente", "fin"]


def test_marker_across_pages(spark):
    got = sections.document_markers(pages(spark, "… Consumo de", "Agua y más"), ["consumo de agua", "otro"]).collect()
    assert [r["markers"] for r in got] == [1]


def test_local_fallback_order(spark):
    plain = pages(spark, "hola\n\n  dos   palabras ", "tres")
    got = sections.local_fallback(plain).orderBy("pos").collect()
    assert [(r["cells"]["Página"], r["cells"]["Línea"], r["cells"]["Texto"]) for r in got] == [
        ("1", "1", "hola"), ("1", "2", "dos palabras"), ("2", "1", "tres")]
    assert {r["source"] for r in got} == {"text_lines"}


def test_classifier_and_restriction(spark):
    df = spark.createDataFrame([
        (1, "a.pdf", "Factura 1 importe total", "automatic", [], None),
        (2, "a.pdf", "Factura 1 importe total", "allowed_profiles", ["movimiento"], None),
        (3, "a.pdf", "nada", "forced_profile", [], "technical-admin"),
        (4, "marca.pdf", "DTVe SENASA", "automatic", [], None),
    ], "doc_id long, file_name string, text string, restriction_mode string, allowed_profiles array<string>, forced_profile string")
    got = {r["doc_id"]: r for r in routing.apply_restriction(routing.classify_profile(df)).collect()}
    assert got[1]["final_profile"] == "internal-comprobante-generico"
    assert got[2]["restriction_status"] == "profile_not_allowed" and got[2]["final_profile"] is None
    assert got[3]["final_profile"] == "internal-documento-tecnico-administrativo"
    assert got[4]["profile_id"] == "internal-dtve-senasa-arca"  # signals are substrings: arca in marca


def test_dedupe_headers(spark):
    df = spark.createDataFrame([(1, 0, i + 1, n) for i, n in enumerate(["A", "", "A", "A"])], "doc_id long, candidate int, col_idx int, name string")
    assert [r["name"] for r in tables.dedupe_headers(df).orderBy("col_idx").collect()] == ["A", "Columna_2", "A_2", "A_3"]


def test_csv_cells(spark):
    lines = ['a,b', '"a,b",c', '"x ""q"" y",', ',', '""', 'ab"c,d"e,f', '"open, end', '"""q"""']
    want = [["a", "b"], ["a,b", "c"], ['x "q" y', ""], ["", ""], [""], ["abc,de", "f"], ["open, end"], ['"q"']]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(parsed.csv_cells("x")).collect()] == want


def test_text_functions(spark):
    row = spark.range(1).select(
        T.fold_accents(F.lit("Ñandú ß ø é")).alias("a"), T.norm_words(F.lit("  Año—Nº 5 ")).alias("b"),
        T.json_value(F.lit('["a", null, "b"]')).alias("c"), T.collapse(F.lit("a" + chr(0xA0) + chr(0x3000) + "\n b")).alias("d"),
        T.sanitize_raw_text(F.lit("a \t\r\nb" + chr(7) + " ")).alias("e"), T.raw_text_file_name(F.lit("x/y.pdf")).alias("f"),
    ).first()
    assert row["a"] == "Nandu ß ø e" and row["b"] == "ano n 5" and row["c"] == "a; b" and row["d"] == "a b"
    assert row["e"] == "a\nb" and row["f"] == "x-y_ocr_bruto.txt"
