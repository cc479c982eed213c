"""Exact copies by radix rounds against grouping by the whole normalised text."""

import hashlib
import re

import pytest
from frames import edge_docs, no_docs

from foliotab.llm import exact_dup


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    out = []
    for text, ids in groups.items():
        real = sorted(i for i in ids if i is not None)
        first = real[0] if real else None
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, first, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def check(docs):
    got = exact_dup.groups(docs)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_force(docs.collect())


def test_odd_rows(spark):
    docs = edge_docs(spark)
    check(docs)
    check(docs.selectExpr("*", "doc_id as id", "1 as piece_0", "2 as n_bytes", "'x' as first", "'y' as lead", "3 as salt"))
    assert exact_dup.groups(no_docs(spark)).collect() == []


@pytest.mark.parametrize("edges", [exact_dup.EDGES, (0, 1, 2, 3, 5, 9, 1 << 20)])
def test_texts_that_differ_at_every_depth(spark, monkeypatch, edges):
    monkeypatch.setattr(exact_dup, "EDGES", edges)
    base = "é漢 word " * 3000
    texts = [base[:n] for n in (0, 1, 2, 3, 5, 64, 65, 1024, 20_000)] + [base[:n] + "x" + base[n + 1:] for n in (0, 1, 63, 1000, 16_400, 20_998)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts * 2 + [base] * 30 + [base.replace(" ", "\n\t"), " " + base, None])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
