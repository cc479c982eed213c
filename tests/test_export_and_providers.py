"""JSON fragments, merged page readings and readers on small tables with known results."""

import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from foliotab.functions import fixed_values as V
from foliotab.operators import page_merge
from foliotab.operators.providers import Provider, provider_outputs
from foliotab.sources import export

ATTEMPT = "doc_id long, page_number int, rotation int, columns array<string>, rows array<map<string,string>>, error string"
HEADS = list(V.MOVEMENT_COLUMNS)


def supplier(*names):
    return [{"Proveedor": n} for n in names]


def merge(spark, attempts, counts, **more):
    return page_merge.merge_pages(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(counts, "doc_id long, page_count int"), **more)


def test_the_first_rotation_with_rows_counts(spark):
    got = merge(spark, [
        (1, 1, 0, HEADS, supplier(""), None), (1, 1, 90, HEADS, supplier("b", "a"), None), (1, 1, 270, HEADS, supplier("late"), None),
        (1, 2, 0, HEADS, None, "ilegible"), (1, 3, 0, HEADS, [], None), (1, 3, 90, HEADS, [], None), (1, 3, 270, HEADS, [], "corte"), (1, 3, 180, HEADS, [], None),
        (1, 4, None, HEADS, supplier("a", "c", "b"), None)], [(1, 4), (2, 0)])
    assert [(r.page_number, r.row_number, r.cells["Proveedor"]) for r in got.rows.orderBy("row_number").collect()] == [(1, 1, "b"), (1, 2, "a"), (4, 3, "c")]
    assert {(r.page_number, r.warning) for r in got.warnings.collect()} == {
        (1, "Pagina 1 procesada con rotacion alternativa 90."), (2, "Pagina 2 sin filas validas. ilegible"), (3, "Pagina 3 procesada con rotacion alternativa 180.")}
    assert {(r.doc_id, r.status, r.pages_processed, r.records, r.warned) for r in got.documents.collect()} == {
        (1, "ok", 4, 3, 3), (2, "PROFILE_NO_VALID_ROWS", 0, 0, 0)}


def test_strict_judges_pages_as_given(spark):
    bad = supplier("x", "Folio 7")
    attempts = [(1, 1, 0, HEADS, bad, None), (2, 1, 0, ["Proveedor"], bad, None), (3, 1, 0, HEADS + list(V.LINE_COLUMNS), bad, None),
                (4, 1, 0, HEADS, supplier("x", "Ã" * 9), None), (5, 1, 0, HEADS, [dict(zip(HEADS, HEADS))], None)]
    counts = [(i, 1) for i in range(1, 6)]
    loose, strict = ({r.doc_id: r.status for r in merge(spark, attempts, counts, strict=s).documents.collect()} for s in (False, True))
    assert loose == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "PROFILE_NO_VALID_ROWS"}
    assert strict[1] == "PROFILE_INCLUDED_IGNORED_TEXT" and strict[2].startswith("PROFILE_MISSING_COLUMNS: FechaSalida, ")
    assert strict[3] == "PROFILE_REJECTED_GENERIC_LINE_CSV"
    assert strict[4] == "PROFILE_CORRUPTED_TEXT_DOMINANT" and strict[5] == "PROFILE_NO_VALID_ROWS"


def test_no_pages_at_all(spark):
    got = merge(spark, [], [(1, 3)], max_pages=2)
    assert got.rows.count() == 0 and [r.status for r in got.documents.collect()] == ["PROFILE_NO_VALID_ROWS"]
    assert [r.warning for r in got.warnings.collect()] == ["Se procesaron 2 de 3 paginas por limite configurado."]


def test_fragments_make_whole_documents(spark):
    results = spark.range(3).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == 2, "no").otherwise("yes").alias("plan_name"), F.lit("LISTADO").alias("file_kind"),
        F.array(F.lit("a")).alias("columns"), F.timestamp_seconds(F.lit(0)).alias("processed_at"))
    plans = spark.createDataFrame([("yes", True), ("no", False)], "plan_name string, allow_json_export boolean")
    rows = spark.createDataFrame([(0, i * 3, {"a": f'"{i}"'} if i else None) for i in range(100)] + [(2, 0, {"a": "x"}), (9, 0, {"a": "x"})],
                                 "doc_id long, row_idx long, cells map<string,string>")
    found = export.json_fragments(results, rows, plans, run_length=8).orderBy("doc_id", "part", "run").collect()
    whole = {d: json.loads("".join(r.value for r in found if r.doc_id == d)) for d in {r.doc_id for r in found}}
    assert set(whole) == {0, 1} and len(found) > 30
    assert whole[0]["rows"] == [{}] + [{"a": f'"{i}"'} for i in range(1, 100)] and whole[1]["rows"] == []
    assert whole[0]["metadata"]["records"] == 100 and whole[1]["metadata"]["records"] == 0 and whole[0]["metadata"]["warnings"] == []
    assert whole[0]["metadata"]["processedAt"].startswith("1970-01-01T") and "profileCode" not in whole[0]["metadata"]


def test_a_failing_request_fails_alone(spark):
    def upper(batch):
        if pc.any(pc.equal(batch.column("text"), "bad")).as_py():
            raise OSError("no answer")
        return pc.utf8_upper(batch.column("text"))

    texts = ["a", "bad", None, "", "c", "bad", "d"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.status, r.provider_used, r.output, r.error) for r in provider_outputs(asked, Provider("up", upper), batch_rows=4).collect()}
    assert got == {0: ("ok", "up", "A", None), 1: ("failed", "up", None, "OSError: no answer"), 2: ("empty", "up", None, None), 3: ("empty", "up", "", None),
                   4: ("ok", "up", "C", None), 5: ("failed", "up", None, "OSError: no answer"), 6: ("ok", "up", "D", None)}
    second = provider_outputs(asked, Provider("up", upper), Provider("same", lambda b: b.column("text"))).where("doc_id = 1").first()
    assert (second.status, second.provider_used, second.output, second.error) == ("ok", "same", "bad", "OSError: no answer")
    assert provider_outputs(asked.limit(0), Provider("up", upper)).count() == 0


@pytest.mark.parametrize("read", [lambda b: [], lambda b: pa.array(["x"]), lambda b: pa.array([1] * b.num_rows)])
def test_a_reader_that_breaks_its_agreement_stops_the_job(spark, read):
    asked = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1)
    with pytest.raises(Exception, match="ProviderError"):
        provider_outputs(asked, Provider("wrong", read)).collect()
