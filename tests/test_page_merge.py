"""Merged pages: headers are matched once a page, rows are judged once, also where headers or rows are null."""

from pyspark.sql import functions as F

from foliotab.functions import fixed_values as V
from foliotab.operators import page_merge


def attempts(spark):
    header, supplier = list(V.MOVEMENT_COLUMNS), V.MOVEMENT_COLUMNS[4]
    rows = [
        (1, 1, header, [{supplier: "uno"}, {supplier: " uno "}, None]), (1, 2, header, [{supplier: "uno"}, {supplier: "dos"}]),
        (2, 1, None, [{supplier: "tres"}]), (3, 1, header, None), (4, 1, ["El " + c for c in header], [{"El " + supplier: "cuatro"}]),
    ]
    return spark.createDataFrame(rows, "doc_id long, page_number int, columns array<string>, rows array<map<string,string>>")


def merged(spark):
    df = attempts(spark)
    return page_merge.merge_pages(df, df.groupBy("doc_id").agg(F.count_distinct("page_number").alias("page_count")))


def test_rows_and_verdicts(spark):
    got = merged(spark)
    rows = got.rows.select("doc_id", "page_number", "row_number", F.col("cells")[V.MOVEMENT_COLUMNS[4]].alias("v"))
    assert {tuple(r) for r in rows.collect()} == {(1, 1, 1, "uno"), (1, 2, 2, "dos"), (2, 1, 1, "tres"), (4, 1, 1, "cuatro")}
    assert {(r.doc_id, r.status, r.pages_processed, r.records, r.warned) for r in got.documents.collect()} == {
        (1, "ok", 2, 2, 0), (2, "ok", 1, 1, 0), (3, "PROFILE_NO_VALID_ROWS", 1, 0, 1), (4, "ok", 1, 1, 0)}


def test_headers_and_rows_are_read_once(spark):
    readings = page_merge.page_readings(attempts(spark))._jdf.queryExecution().optimizedPlan().toString()
    # Of each name of a header, and of each cell for the names of its column.
    assert readings.count("[^a-z0-9]+") <= 2
    got = merged(spark)
    for df in (got.rows, got.documents):
        assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()
