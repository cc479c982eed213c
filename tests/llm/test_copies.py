"""Near copies of texts and vectors, and connected components."""

import random

import numpy as np
import pytest
from frames import edge_docs, no_docs

from foliotab.llm import near_dup, vector_dup
from foliotab.llm.components import components


def shingles(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def smallest_reachable(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute_force(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in smallest_reachable(ids, links).items()}


def family(size, seed):
    """Edited copies of one text, each close to the text but not all close to one another, and other texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(size):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(words)))
        rows.append((i * 3 + 1, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(base[:50])))
    rows += [(9000 + k, rows[0][1]) for k in range(20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    rows = family(60, seed)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def templates(size, seed):
    """Texts with much in common that are no links, and chains of links between some of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(size):
        rows.append((i, " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(36)])))
        if i % 10 == 0:
            words = rows[-1][1].split()
            rows += [(1000 + 2 * i + k, " ".join(words[:-6 - 6 * k] + [f"y{rng.randrange(10**6)}" for _ in range(6 + 6 * k)])) for k in range(2)]
    return rows


@pytest.mark.parametrize("tile", [16, 2048])
def test_buckets_of_templates(spark, monkeypatch, tile):
    rows = templates(120, tile)
    sizes = []

    def counted(*args):
        out = near_dup_rest(*args, tile=tile, tile_shingles=256 * tile)
        sizes.append(out.count())
        return out

    near_dup_rest = near_dup.rest_links
    monkeypatch.setattr(near_dup, "rest_links", counted)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_force(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(set(c for _, c in want.values())) > 100 and sizes[0] <= len(rows)


@pytest.mark.parametrize("kinds", [20, 100_000])
def test_overlaps_equal_brute_force(kinds):
    rng = np.random.default_rng(kinds)
    x, y = ([np.unique(rng.integers(0, kinds, rng.integers(1, 300))).astype(np.uint64) for _ in range(n)] for n in (70, 90))
    assert near_dup.overlaps(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    tables = []
    for side in (x, y):
        filled, sketch = zip(*map(near_dup.odd_sketch, side))
        tables.append({"sketch": np.array(sketch), "n": np.array([len(s) for s in side]), "filled": np.array(filled), "component": np.arange(len(side))})
    maybe = near_dup.tile_screen(*tables)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            shared = len(np.intersect1d(a, b))
            assert maybe[i, j] or i == j or 100 * shared < 75 * (len(a) + len(b) - shared)


def test_near_copies_edge_rows(spark):
    docs = edge_docs(spark)
    got = near_dup.near_duplicates(docs).collect()
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert near_dup.near_duplicates(no_docs(spark)).collect() == []
    kept = near_dup.representatives(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(5) == 1 and 6 not in ids and 9 not in ids


@pytest.mark.parametrize("size", [40, 600, 20_000])
def test_sketch_estimate(spark, size):
    rng = np.random.default_rng(5)
    for similarity in (0.7, 0.75, 0.9, 1.0):
        shared = round(2 * size * similarity / (1 + similarity))
        both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        row = {}
        for letter in "st":
            filled, sketch = near_dup.odd_sketch(np.concatenate([both, rng.integers(0, 1 << 63, size - shared, dtype=np.uint64)]))
            row |= {f"{letter}_n": size, f"{letter}_filled": filled} | {f"{letter}_s{i}": int(v) for i, v in enumerate(sketch)}
        exact = shared / (2 * size - shared)
        got = spark.createDataFrame([row]).select(near_dup.estimate()).first()[0]
        assert got > min(exact, 0.75) - 0.06 and (similarity > 0.75 or got < exact + 0.06)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 101 + i) for i in range(50)]
    loose = [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(100)]
    links = chain + star + loose + star[:5]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for a, b in links if a != b for i in (a, b)}
    want = smallest_reachable(ids | {i for a, b in links for i in (a, b)}, links)
    assert got == {i: want[i] for i in ids}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(8, 24))
        for i in range(90):
            v = centres[i % 8] + rng.normal(size=24) * (0.02 + 0.25 * (i % 5 == 0))
            rows.append((label * 1000 + i, v.astype(np.float32).tolist(), label))
        rows += [(label * 1000 + 200 + k, rows[-1 - k][1], label) for k in range(3)]
    return rows


def test_vectors_equal_brute_force_over_tiles(spark):
    rows = vectors()
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= vector_dup.SIMILAR) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))]
    want = smallest_reachable(ids, links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile in (16, 2048):
        got = vector_dup.near_vectors(df, tile=tile).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(n), want[i]) for i, n in zip(ids, close.sum(1))}


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 40)) * rng.lognormal(size=(1, 40), sigma=2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error, norm = vector_dup.quantised(x)
    about = vector_dup._products(codes, codes) * scale[:, None] * scale[None]
    assert (np.abs(x @ x.T - about) <= error[None] + error[:, None] * norm[None] + 1e-12).all()
    linked, full = vector_dup.tile_links(x, x, 0.9)
    assert (linked == (x @ x.T >= 0.9)).all() and full < x.shape[0] ** 2


def test_vector_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [1.0, inf], 0), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 0), (9, [3.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1), (12, [1.0, 0.0], 0), (12, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, tile int, links string")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in vector_dup.near_vectors(df).collect())
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)]
    assert got == sorted([*alone, (0, 0, None), (8, 3, 8), (9, 3, 8), (12, 3, 8), (12, 3, 8)])
    assert vector_dup.near_vectors(df.limit(0)).collect() == []
