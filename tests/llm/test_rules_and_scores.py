"""Quality rules, language identification and toxicity."""

import re
import zlib
from collections import Counter

import pytest
from frames import edge_docs, no_docs, no_labels

from foliotab.llm import language, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def counts(row):
    return tuple(row[c] for c in quality.COUNTS)


def test_base_counts_on_edge_rows(spark):
    docs = edge_docs(spark)
    got = sorted((r.doc_id or 0, counts(r)) for r in quality.score(docs, None).collect())
    assert got == sorted((r.doc_id or 0, base_of(r.text)) for r in docs.collect())


def test_base_counts_and_model_on_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert {r.doc_id: counts(r) for r in rows} == {i: base_of(t) for i, t in texts.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.p_good >= quality.KEEP_FROM)
    good = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, good[r.doc_id]) for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(k == bool(g) for k, g in judged) >= 0.95 * len(judged)


def test_quality_without_rows(spark):
    assert quality.train(no_docs(spark), no_labels(spark)) is None
    assert quality.score(no_docs(spark), None).collect() == []
    kept = {r.doc_id: r.kept for r in quality.score(edge_docs(spark), None).collect()}
    assert not kept[1] and not kept[2] and not kept[4] and kept[5] and kept[6]


def in_training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    langs = {r.doc_id: (r.lang, len(r.text)) for r in docs.collect()}
    rows = language.predict(docs, language.train(docs)).collect()
    held = [(r.lang_pred, *langs[r.doc_id]) for r in rows if not in_training(r.doc_id)]
    assert sum(p == g for p, g, _ in held) >= 0.99 * len(held)
    assert sum(r.accepted for r in rows) >= 0.995 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_counts_match_a_plain_count(spark):
    docs = edge_docs(spark).where("text is not null and lang = 'en' and doc_id in (5, 9)")
    got = {r.gram: r.n for r in language.count_grams(docs).collect()}
    want = Counter()
    for r in docs.collect():
        t = "\x01 " + " ".join(r.text.split()) + " "
        for i in range(len(t) - 3):
            want[sum(ord(c) << 16 * (3 - j) for j, c in enumerate(t[i:i + 4]))] += 1
    assert got == dict(want)


def test_language_probabilities_sum_to_one():
    import numpy as np

    keys, n = np.unique(language.grams(*language.characters(["abab abba baab", "abba"]), 4)[0], return_counts=True)
    model = language.kneser_ney([(keys, n)], ["x"])
    letters = [1, 32, ord("a"), ord("b")]
    for context in ([1, 32, ord("a")], [32, ord("a"), ord("b")], [ord("b"), ord("b"), ord("b")]):
        total = 0.0
        for c in letters:
            key = np.array([sum(int(v) << 16 * (3 - j) for j, v in enumerate([*context, c]))], np.uint64)
            row = model.grams[3].values[model.grams[3].find(key)]
            total += float(np.exp(row if not np.isnan(row).any() else model._lower(key, 4)).sum())
        assert total == pytest.approx(1, abs=0.26)  # what is left over is the share of unseen characters


def test_language_edge_rows(spark):
    docs = edge_docs(spark)
    rows = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and not rows[i].accepted for i in (1, 2, 3, 8))
    assert all(rows[i].lang_pred != "und" for i in (4, 5, 6, 7, 9, 10, 11))
    assert language.train(no_docs(spark)) is None
    assert language.predict(no_docs(spark), None).collect() == []
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    model = language.train(docs)
    assert language.accepted_rows(docs, model).columns == docs.columns


def test_toxicity_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    held = [(r.score >= toxicity.TOXIC_FROM, toxic[r.doc_id]) for r in rows if r.doc_id in toxic and not in_training(r.doc_id)]
    assert sum(p for p, t in held if not t) <= 0.01 * len(held)
    assert sum(p for p, t in held if t) >= 0.7 * sum(t for _, t in held)


def test_toxicity_folding_and_exceptions():
    machine = toxicity.ToxicityModel({"idiot\n": 6.0, "loser\n": 6.0, "trash\n": 5.0, "ekel": 4.0}, (0.0,) * 4).automaton()
    hits = {t: toxicity.weigh(machine, t)[0] for t in (
        "an idiot!", "IDIOT", "1d10t", "ıdiоt", "ídiot", "idiotic", "10ser", "trash", "the trash can", "ekelhaft", "ékelhaft", "$$$idiot$$$", "")}
    assert hits == {"an idiot!": 1, "IDIOT": 1, "1d10t": 1, "ıdiоt": 1, "ídiot": 1, "idiotic": 0, "10ser": 1, "trash": 1,
                    "the trash can": 0, "ekelhaft": 1, "ékelhaft": 0, "$$$idiot$$$": 1, "": 0}


def test_toxicity_edge_rows(spark):
    docs = edge_docs(spark)
    model = toxicity.train(docs, no_labels(spark))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score < toxicity.TOXIC_FROM for r in rows)
    assert toxicity.score(no_docs(spark), model).collect() == []
    assert toxicity.train(no_docs(spark), no_labels(spark)).lexicon
