"""Signals of a table against the search for every one of them in every text."""

import random
import re

import pyarrow as pa

from foliotab.operators import signals


def norm(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


def test_signals_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "ab", "abc", "ba", "bac", "cuit", "fecha", "x1", "de"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "b", ".", "-a"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 4, 12]))) for i in range(120)] + [(500, None), (501, "")]
    found = [(f"g{i % 3}", text(rng.choice([1, 1, 2, 2, 3, 4]))) for i in range(150)] + [("g0", None), ("g1", "..."), ("g2", ""), ("g0", "ab"), ("g1", "ab")]
    want = {(d, g): len({s for h, s in found if h == g and norm(s) and norm(s) in norm(t)}) for d, t in docs for g in ("g0", "g1", "g2")}
    got = signals.signal_groups(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(found, "signal_group string, signal string"))
    assert {(r.doc_id, r.signal_group): r.matched for r in got.collect()} == {k: v for k, v in want.items() if v}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_row_for_each_signal_of_each_word(spark):
    """Documents meet their signals in blocks: texts and words are shuffled, not documents by word and signal."""
    docs = spark.createDataFrame([(i, "abcab bcabc cabca") for i in range(40)], "doc_id long, text string")
    found = signals.find_signals(docs, spark.createDataFrame([(x,) for x in ("a", "b", "ab", "bc", "abc", "ab bc")], "signal string"))
    assert {(r.doc_id, r.signal) for r in found.collect()} == {(i, x) for i in range(40) for x in ("a", "b", "ab", "bc", "abc", "ab bc")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Aggregate [doc_id" in x]


def shuffled_bytes(df):
    """Bytes that the exchanges of a plan were given when it ran."""
    assert df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            found += node.metrics().apply("dataSize").value() if node.nodeName() == "Exchange" else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_what_words_hold_is_not_shuffled(spark):
    """Texts and packed signals are shuffled, not the lists of signals that each word holds or may be a part of."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(500)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(150)]
    found = [(len(x.split()), x) for x in {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) + rng.choice(["", " " + rng.choice(words)[:3]]) for _ in range(2500)}]
    want = {}
    for d, text in docs:
        for g, x in found:
            want[d, g] = want.get((d, g), 0) + (x in text)
    got = signals.signal_groups(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(found, "signal_group long, signal string"))
    assert {(r.doc_id, r.signal_group): r.matched for r in got.collect()} == {k: v for k, v in want.items() if v}
    assert shuffled_bytes(got) < 2 * sum(len(x) for _, x in docs)


def by_hand(docs, found):
    """Documents of one id are one; those without an id hold single words only."""
    held = {}
    for d, text in docs:
        for g, s in found:
            if norm(s) and norm(s) in norm(text) and (d is not None or " " not in norm(s)):
                held.setdefault((d, g), set()).add(s)
    return {k: len(v) for k, v in held.items()}


def odd_rows():
    rng = random.Random(11)
    words = ["a", "ab", "abc", "b", "ba", "c1", "abcabcabcab", "abcabcabcabc", "abcabcabcabca", "bcabcabcabcabcabcab", "cabcabcabcabcabcabcabcabcabc"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "b", ".", "-a"]) for _ in range(n))
    docs = [(rng.choice([None, *range(30)]), text(rng.choice([0, 1, 5, 20]))) for _ in range(90)] + [(99, None), (100, " .")]
    found = [(rng.choice([None, "g", "h"]), text(rng.choice([1, 1, 2, 2, 3, 4, 5]))) for _ in range(300)]
    return docs, [*found, *found[:20], *((g, s.upper()) for g, s in found[:20]), ("g", "-"), ("h", None)]


def test_odd_ids_groups_and_long_words(spark, monkeypatch):
    """Ids that repeat or are null, null groups, words that exceed a number, and several blocks and parts."""
    docs, found = odd_rows()
    for parts, chars in ((signals.PART_SIGNALS, signals.BLOCK_CHARS), (20, 200)):
        monkeypatch.setattr(signals, "PART_SIGNALS", parts)
        monkeypatch.setattr(signals, "PART_SAMPLE", parts)
        monkeypatch.setattr(signals, "BLOCK_CHARS", chars)
        monkeypatch.setattr(signals, "CHARS_A_BYTE", 0)
        rows = spark.createDataFrame(found, "signal_group string, signal string")
        assert (signals._parts(rows).count() > 5) == (parts == 20)
        given = spark.createDataFrame(docs, "doc_id long, text string"), rows
        assert {(r.doc_id, r.signal_group): r.matched for r in signals.signal_groups(*given).collect()} == by_hand(docs, found)
        pairs = signals.find_signals(given[0], given[1].select("signal")).collect()
        assert len(pairs) == len({(r.doc_id, r.signal) for r in pairs})
        assert {(r.doc_id, r.signal) for r in pairs} == {(d, s) for d, s in by_hand(docs, [(s, s) for _, s in found])}


def test_no_signals_and_no_texts(spark):
    docs, found = spark.createDataFrame([(1, "ab")], "doc_id long, text string"), spark.createDataFrame([("g", "b")], "signal_group string, signal string")
    assert signals.signal_groups(docs, found).collect() == [(1, "g", 1)]
    assert not signals.signal_groups(docs.where("doc_id > 1"), found).collect()
    assert not signals.signal_groups(docs, found.where("signal > 'b'")).collect()
    assert not signals.signal_groups(docs.selectExpr("doc_id", "'-' AS text"), found).collect()


def test_windows_do_not_change_a_block(monkeypatch):
    docs, found = odd_rows()
    docs = [(d, norm(text)) for d, text in docs]
    rows = {}
    for g, s in set(found):
        if norm(s):
            rows[norm(s), g] = rows.get((norm(s), g), 0) + 1
    packed = signals._packed(pa.table({
        "needle": [n for n, _ in rows], "signal_group": pa.array([g for _, g in rows], pa.string()), "signals": list(rows.values())}))
    texts = pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "body": [text for _, text in docs]})
    names = ("WINDOW_CHARS", "STEPS", "HITS", "MARKS")
    for sizes in ([getattr(signals, x) for x in names], (50, 3, 9, 0), (1, 1, 1, 1)):
        for name, size in zip(names, sizes):
            monkeypatch.setattr(signals, name, size)
        signals._part.cache_clear()
        got = signals._counts_of_block(texts, packed).to_pylist()
        assert len(got) == len({(r["doc_id"], r["signal_group"]) for r in got})
        assert {(r["doc_id"], r["signal_group"]): r["matched"] for r in got} == by_hand(docs, found)
