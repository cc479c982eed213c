"""Merkle manifest against a tree that is built level by level."""

import hashlib
import random
import zlib

import pytest
from frames import edge_docs, no_docs

from foliotab.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, n_chars):
    return H(*[field(v) for v in (row.doc_id, row.source, row.lang, n_chars, row.text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        at = i ^ 1
        yield (i & 1, level[at] if at < len(level) else None)
        i //= 2


def brute_force(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.n_chars), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf for *_, leaf, _ in sorted(by_lang[x], key=lambda t: t[:3])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, (*_, leaf, r) in enumerate(sorted(by_lang[lang], key=lambda t: t[:3])):
            steps = [*path(trees[lang], i), *path(top, g)]
            hit = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf_of(r, r.n_chars + 1) if hit else leaf
            for right, sibling in steps:
                node = H(node) if sibling is None else H(sibling, node) if right else H(node, sibling)
            out.append((r.doc_id, leaf, trees[lang][-1][0], top[-1][0], H(*[s for _, s in steps if s]), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_equals_levels(spark, bits):
    rng = random.Random(bits)
    rows = [(i * 3, f"text {rng.random()}", rng.choice(["en"] * 6 + [None, "de", "é", "zz", ""]), None, rng.choice([i, None])) for i in range(75)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = manifest.verified(manifest.manifest(manifest.document_leaves(docs), block_bits=bits)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_force(docs.collect())
    assert {r.verified for r in got} == {True, False}


def test_odd_rows(spark):
    docs = edge_docs(spark)
    got = manifest.verified(manifest.manifest(manifest.document_leaves(docs)))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_force(docs.collect())
    clashing = docs.selectExpr("*", "doc_id as id", "1 as place", "'x' as node", "2 as tie", "text as carried", "lang as `group`")
    again = manifest.verified(manifest.manifest(manifest.document_leaves(clashing)))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert manifest.verified(manifest.manifest(manifest.document_leaves(no_docs(spark)))).collect() == []


def test_witness_of_an_open_tree_grows_with_later_siblings():
    trees = manifest.Subtrees()
    for i in range(5):
        trees.append(H(str(i)))
    assert [len(w) for w in trees.witness] == [2, 2, 2, 2, 0]
    root = trees.close()
    assert root == levels([H(str(i)) for i in range(5)])[-1][0]
    assert all(manifest.fold(H(str(i)), b"".join(w)) == root for i, w in enumerate(trees.witness))
