"""Mixing, sharding and packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from frames import edge_docs, no_docs

from foliotab.llm import mixing, packing, sharding

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_mix_hits_targets_and_limits(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    assert sum(v[0].target for v in by_source.values()) == pytest.approx(total)
    for v in by_source.values():
        assert sum(r.taken for r in v) == int(v[0].target)
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size
    again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_raises_targets_of_the_rest(spark):
    rows = [(i, "w " * 10, "a") for i in range(30)] + [(100, "one two", "b"), (101, "x y z", "c")]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got["b"].target == 6 and got["c"].target == 9 and got["a"].target == pytest.approx(305 - 15)


def test_mix_edge_rows(spark):
    docs = edge_docs(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(no_docs(spark)).collect() == []
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mixed(no_docs(spark)).collect() == []


def test_schedule_spreads_sources(spark):
    sources = spark.createDataFrame([(0, 6400.0), (1, 3200.0), (2, 0.0), (3, 100.0)], "sid long, target double")
    slots = mixing.schedule(spark, sources, block=10).orderBy("slot").collect()
    for sid, least in ((0, 640), (1, 320), (3, 10)):
        ranks = [s.rank for s in slots if s.sid == sid]
        assert ranks == list(range(len(ranks))) and len(ranks) >= least
    share = sum(s.sid == 0 for s in slots) / len(slots)
    for at in range(0, len(slots) - 100, 100):
        assert abs(sum(s.sid == 0 for s in slots[at:at + 100]) / 100 - share) < 0.05


def test_differencing_beats_dealing_in_turn():
    rng = np.random.default_rng(4)
    sizes = rng.lognormal(8, 1, 2000).astype(np.int64)
    sums = np.zeros((len(sizes), 40), np.int64)
    sums[:, -1] = sizes
    total, place = sharding.difference(sums)
    filled = np.bincount(place[:, -1], weights=sizes, minlength=40)
    assert (filled == total).all()
    in_turn = np.bincount(np.arange(2000) % 40, weights=np.sort(sizes)[::-1], minlength=40)
    assert np.ptp(filled) < 0.01 * filled.mean() < np.ptp(in_turn)


@pytest.mark.parametrize("bundles", [300, 1 << 14])
def test_shards(spark, bundles):
    rng = np.random.default_rng(1)
    texts = ["t" * int(n) for n in rng.integers(1, 400, 1500)]
    rows = [(i, t + str(i)) for i, t in enumerate(texts)] + [(10_000 + i, "copy " * 30) for i in range(700)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, bundles=bundles).collect()
    by_id = dict(rows)
    sizes, slots = np.zeros(8), [[] for _ in range(8)]
    for r in got:
        assert r.size == len(by_id[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(by_id[r.doc_id].encode())
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert np.ptp(sizes) < 0.005 * sizes.mean()


def test_shards_keep_groups_and_edge_rows(spark):
    docs = edge_docs(spark)
    got = sharding.shard(docs, shards=2).collect()
    assert len(got) == docs.count() and [r.size for r in got if r.doc_id == 1] == [16]
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.shard(no_docs(spark)).collect() == []


def windows_of(rows, window=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(by_sequence)


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, TOKENIZER).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    tokens = 0
    for i, text in texts.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(found[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        tokens += len(ids)
    assert tokens >= 0.95 * 2048 * windows_of(rows)


def test_packing_edge_rows(spark):
    docs = edge_docs(spark)
    rows = packing.pack(docs, TOKENIZER).collect()
    windows_of(rows)
    assert sum(r.start == 0 for r in rows) == docs.count()
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id == 1] == [(1, 1)]
    assert packing.pack(no_docs(spark), TOKENIZER).collect() == []


def test_encoder_equals_its_own_library():
    ids = packing.Ids(TOKENIZER)
    for text in ("a  b", "", " a", "a\n b", "The cat\nsat on <|endoftext|> mat's 12,5", "é ü 漢字 ok\t\tz   y", "x" * 5000, "\r\n\x85  ."):
        assert ids(text).tolist() == ids.own.encode(text, add_special_tokens=False).ids


def test_non_negative_least_squares():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (20, 60)).astype(float)
    truth = np.maximum(rng.normal(size=60), 0)
    x = packing.non_negative(a, a @ truth)
    assert (x >= 0).all() and np.abs(a @ x - a @ truth).max() < 1e-5
    y = packing.non_negative(np.array([[1.0, -1.0]]), np.array([-3.0]))
    assert y.tolist() == [0.0, 3.0]


def test_plan_seats_every_piece():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 2048, 5000), return_counts=True)
    rows, windows = packing.plan(lengths, counts)
    seated = dict.fromkeys(lengths.tolist(), 0)
    used = np.zeros(windows, np.int64)
    for n, first, end, window, _ in rows.tolist():
        assert first == seated[n]
        seated[n] = end
        used[window:window + end - first] += n
    assert seated == dict(zip(lengths.tolist(), counts.tolist())) and used.max() <= 2048
    assert (lengths * counts).sum() >= 0.97 * 2048 * windows
