"""Limits that are off by default, status rows of those that are set, and plans of dimension joins."""

import random

import pytest
from pyspark.sql import functions as F

from foliotab.operators import chunks, quality, storage, usage
from foliotab.plans import all_queries

QUERIES = all_queries()


def pages(spark, counts):
    rows = [(d, n, f"text of page {n} " + "x" * 50) for d, c in counts.items() for n in range(1, c + 1)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, text string").repartition(4)


def greedy(texts, most, overlap):
    out, numbers, text = [], [], ""
    for n, t in texts:
        own = f"Página {n}\n{t}"
        if numbers and len(text) + 2 + len(own) > most:
            out.append((numbers, text.strip()))
            tail = text[-overlap:].strip() if 0 < overlap < len(text) else ""
            numbers, text = [n], f"{tail}\n\n{own}" if tail else own
        else:
            numbers, text = [*numbers, n], f"{text}\n\n{own}" if text else own
    return [*out, (numbers, text.strip())] if numbers else out


def test_long_documents_are_chunked_whole(spark):
    p = pages(spark, {1: 500, 2: 3})
    got = sorted((r.doc_id, r.chunk_index, r.pages, r.text, r.status) for r in chunks.chunk_pages(p, 400, overlap=30).collect())
    want = []
    for d in (1, 2):
        rows = sorted((r.page_number, r.text) for r in p.where(F.col("doc_id") == d).collect())
        want += [(d, i + 1, n, t, "ok") for i, (n, t) in enumerate(greedy(rows, 400, 30))]
    assert got == want


def random_pages(seed):
    """Short, long and blank pages with blanks inside, so that chunks take over whole pages, parts of several and nothing."""
    rng = random.Random(seed)
    for doc in (1, 2, None):
        for n in range(1, rng.choice([4, 90])):
            size = rng.choice([0, 1, 3, 20, 20, 60, 150])
            yield doc, n, "".join(rng.choice("ab \n") for _ in range(size))


@pytest.mark.parametrize("most,overlap,block", [(100, 30, 1), (100, 30, 7), (60, 90, 3), (200, 0, 5), (40, 10, 64), (300, 120, 2)])
def test_blocks_of_pages_pack_like_one_pass(spark, monkeypatch, most, overlap, block):
    monkeypatch.setattr(chunks, "BLOCK_PAGES", block)
    rows = list(random_pages(most + block))
    got = chunks.chunk_pages(spark.createDataFrame(rows, "doc_id long, page_number int, text string").repartition(5), most, overlap=overlap)
    want = []
    for d in (1, 2, None):
        own = [(n, t.strip()) for doc, n, t in rows if doc == d and t.strip()]
        want += [(d, i + 1, n, t) for i, (n, t) in enumerate(greedy(own, most, overlap))]
    assert sorted([(r.doc_id, r.chunk_index, r.pages, r.text) for r in got.collect()], key=str) == sorted(want, key=str)


def test_one_document_is_packed_in_many_tasks(spark):
    p = spark.range(1, 6401).select(F.lit(7).alias("doc_id"), F.col("id").alias("page_number"), F.repeat(F.lit("palabra "), 20).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small test shuffles would end in one task
    got = chunks.chunk_pages(p, 2000)
    tasks = got.select(F.spark_partition_id().alias("task"), F.size("pages").alias("n")).groupBy("task").agg(F.sum("n").alias("n")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in tasks) == 6400 and len(tasks) > 1


def test_a_page_limit_reports_what_it_rejects(spark):
    got = {(r.doc_id, r.status) for r in chunks.chunk_pages(pages(spark, {1: 40, 2: 3}), 400, max_pages=30).collect()}
    assert got == {(1, "too_many_pages"), (2, "ok")}


def test_every_document_of_merged_pages_has_a_status(spark):
    outputs = spark.createDataFrame([(1, 35, ["A"], [{"A": "x"}])], "doc_id long, page_number int, columns array<string>, rows array<map<string,string>>")
    counts = spark.createDataFrame([(1, 40), (2, 1)], "doc_id long, page_count int")
    assert {(r.doc_id, r.status) for r in quality.merge_page_outputs(outputs, counts).collect()} == {
        (1, "PROFILE_NO_VALID_ROWS"), (2, "PROFILE_NO_VALID_ROWS")}
    noted = quality.merge_page_outputs(outputs, counts, max_pages=30).collect()
    assert {r.doc_id: len(r.warnings) for r in noted} == {1: 1, 2: 0}


def test_top_examples_takes_the_number_asked_for(spark):
    rows = spark.range(20).select(F.lit("p").alias("profile_code"), F.col("id").alias("example_id"), F.timestamp_seconds("id").alias("created_at"))
    assert usage.top_examples(rows, 9).count() == 9
    with pytest.raises(ValueError):
        usage.top_examples(rows, 0)


@pytest.mark.parametrize("name", ["size_limit_check", "usage_context", "client_month_usage"])
def test_plan_dimension_is_the_broadcast_side(spark, sf, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = [line for line in plan.split("\n") if "Join" in line and "plan_name" in line]
    assert joins and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)


def test_quality_gate_reads_rows_once(spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.createDataFrame([(1, "a", 1, {"A": "x"})], "doc_id long, candidate string, row_idx long, cells map<string,string>")
        plan = quality.gate_facts(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") <= 2 and "Join" not in plan


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Found:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Found()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(ValueError):
        storage.shared_folder(Session())
