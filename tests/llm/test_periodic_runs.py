"""Runs of words against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from frames import edge_docs, no_docs
from pyspark.sql import functions as F

from foliotab.llm import periodic


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_force(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in best.items()], key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters, n = rng.choice([1, 2, 2, 3, 30]), rng.choice([0, 1, 5, 6, 7, 20, 60, 120])
        w = [chr(97 + rng.randrange(letters)) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(3, 11)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield rng.choice([" ", "\n\t"]).join(w)


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    texts = list(random_texts(seed))
    found, first = periodic.words_of(pa.array(texts))
    got = periodic._found(pa.array(range(len(texts))), found, first)
    for text, runs, rest in zip(texts, got["runs"].to_pylist(), got["collapsed"].to_pylist()):
        want = brute_force(words(text))
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert rest == collapsed(words(text), want)


def expected(doc_id, text, plant):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_force(w) if len(set(w)) > 1 or len(w) < 6 else [(0, len(w), 1)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    shown = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(shown.encode()).hexdigest(),
            hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def result(docs, plant):
    text = periodic.repeating_tail(F.col("doc_id"), F.col("text")) if plant else F.col("text")
    return [tuple(r) for r in periodic.digests(periodic.find_runs(docs.withColumn("text", text))).collect()]


@pytest.mark.parametrize("plant", [False, True])
def test_digests_of_odd_and_random_rows(spark, plant):
    rows = edge_docs(spark).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "best": F.lit(2)})
    for docs in (rows, spark.createDataFrame(list(enumerate(random_texts(99))), "doc_id long, text string")):
        want = [expected(r.doc_id, r.text, plant) for r in docs.collect()]
        assert sorted(result(docs, plant), key=str) == sorted(want, key=str)
    assert result(no_docs(spark), plant) == []


def test_supplied_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000")
    want = [expected(r.doc_id, r.text, True) for r in docs.collect()]
    assert sorted(result(docs, True), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 5
