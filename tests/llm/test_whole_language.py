"""Language models keep all that was counted."""

import numpy as np
import pytest
from test_rules_and_scores import in_training

from foliotab.llm import language


def wide_docs(spark, languages=("aa", "bb", "cc"), letters=3000, texts=12):
    """Texts of many different characters, so that a language has far more than 60,000 different 4-grams."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(texts * len(languages)):
        k = i % len(languages)
        chars = rng.integers(0x4E00 + 1000 * k, 0x4E00 + 1000 * k + letters, 16_000)
        rows.append((i, "".join(map(chr, chars)) + " common words", languages[k]))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_model(docs):
    """The same model from all 4-grams at once."""
    names, counts = [], []
    rows = [r for r in docs.collect() if in_training(r.doc_id)]
    for name in sorted({r.lang for r in rows}):
        keys, n = np.unique(language.grams(*language.characters([r.text for r in rows if r.lang == name]), 4)[0], return_counts=True)
        names.append(name)
        counts.append((keys, n))
    return names, counts, language.kneser_ney(counts, names)


@pytest.mark.parametrize("cells", [language.PART_CELLS, 150_000])
def test_every_counted_gram_is_in_the_model(spark, cells):
    docs = wide_docs(spark)
    names, counts, plain = plain_model(docs)
    assert all(len(keys) > 60_000 for keys, _ in counts)
    model = language.train(docs, cells=cells)
    assert model.names == names and model.single() == (cells == language.PART_CELLS)
    texts = [r.text[:3000] for r in docs.collect()] + ["other words entirely", "common", "漢字 words"]
    got, _, size = language.entropies(model, texts)
    want, _, same = language.entropies(language.LanguageParts(names, [(language.seated({}, 1)[0], [plain])]), texts)
    assert (size == same).all()
    np.testing.assert_allclose(got, want, rtol=1e-5)


def test_a_common_character_has_several_parts():
    seats, parts = language.seated({32: 1000, 97: 60, 98: 50, 99: 40}, 100)
    assert parts == 12 and seats.parts[32] == 10 and seats.parts[97] == 1
    assert seats.first[[97, 98, 99]].tolist() == [10, 11, 11]
    keys = np.array([(a << 32) | (32 << 16) for a in range(65, 91)], np.uint64)
    assert set(seats.of(keys)) <= set(range(10)) and len(set(seats.of(keys))) > 3


def test_limits_come_from_all_training_rows(spark):
    from pyspark.sql import functions as F

    ids = spark.range(30_000).where(language.in_training("id")).orderBy(F.xxhash64("id")).select("id")
    ids = [r.id for r in ids.collect()]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["river", "mill", "weir", "valley", "wheel", "water"], 6)), "en") for i in ids[:2500]]
    # The rare language has only rows that come last in the order of id hashes.
    rows += [(i, "".join(map(chr, rng.integers(0x4E00, 0x6E00, size=size))), "zh") for i, size in zip(ids[-4:], (40, 400, 900, 2000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    own = {x: [] for x in model.names}
    mean, _, _ = language.entropies(model, [t for _, t, _ in rows])
    for (_, _, lang), m in zip(rows, mean):
        own[lang].append(m[model.names.index(lang)])
    assert model.limits[:, 0].tolist() == pytest.approx([np.mean(own[x]) for x in model.names])
    assert all(r.accepted for r in language.predict(docs, model).collect())


def test_every_language_has_a_model(spark):
    rng = np.random.default_rng(6)
    ids = [i for i in range(400) if in_training(i)][:210]
    rows = [(i, "".join(map(chr, rng.integers(0x4E00 + 60 * (k % 70), 0x4E00 + 60 * (k % 70) + 50, 120))), f"x{k % 70:02}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.names == [f"x{k:02}" for k in range(70)] and len(model.groups) == 5
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in language.predict(docs, model).collect()}
    assert got == {i: (lang, True) for i, _, lang in rows}
