"""Quality rules: fixed word and line counts, then a calibrated n-gram logistic regression.

Features are relative frequencies of hashed word 1- and 2-grams and of hashed byte 3- and 5-grams
(bytes of UTF-8, so that any script is covered). The model is fitted on a bounded sample of labelled
rows; its margin is turned into a probability by Platt scaling on margins of held-out folds. Scoring
is one pass over Arrow batches with no shuffle: each n-gram looks up its weight and the weights are
summed for each text, whole texts always.

Defined cases: a null or empty text has counts of 0, fails the base rules and is not kept; null ids
pass through; repeated rows give repeated, equal rows; with no labelled rows of both classes every
text that passes the base rules is kept with probability 1. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .words import Words, mix, per_text, pieces, windows

WORD_BINS, BYTE_BINS = 1 << 12, 1 << 12
#: At most so many labelled rows are fitted; the lowest probability of good text that is kept.
TRAINING_ROWS, KEEP_FROM = 2000, 0.5
FOLDS, STEPS, RIDGE = 3, 120, 1e-3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, p_good double")


@dataclass(frozen=True)
class QualityModel:
    """Weight of each hashed n-gram bin, intercept, and slope and shift of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _equal_within(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort (text, hash) pairs: the order, and whether each equals the one before it."""
    keys = mix(hashes + texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    return order, same


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The five counts of each text of a piece."""
    data, offsets, n = words.data, words.offsets, len(words.count)
    out = {"n_words": words.count,
           "word_chars": per_text(words.inside & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": per_text(_SYMBOL[data], offsets)}
    breaks = np.flatnonzero(data == 10)
    lines = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    text = np.repeat(np.arange(n), lines)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    after = np.append(words.starts, len(data) + 1)[np.searchsorted(words.starts, starts)]
    worded = after < ends
    text, starts, ends = text[worded], starts[worded], ends[worded]
    order, same = _equal_within(text, words.spans(starts, ends))
    out["n_dup_lines"] = np.bincount(text[order[same]], minlength=n)
    owner, hashes = words.text_of_words(), words.hashes()
    runs = windows(hashes, 5)
    whole = owner[:len(runs)] == owner[4:] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    order, same = _equal_within(owner[at], runs[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    covered = np.zeros(len(hashes) + 1, np.int64)
    hit = at[order[twice]]
    covered[hit] += 1
    np.subtract.at(covered, np.minimum(hit + 5, len(hashes)), 1)
    inside = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(owner[inside], minlength=n)
    return out


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each family of n-grams: the text and the bin of each n-gram, and the first bin of the family."""
    owner, hashes = words.text_of_words(), words.hashes()
    yield owner, (hashes % np.uint64(WORD_BINS // 2)).astype(np.int64), 0
    pairs = windows(hashes, 2)
    whole = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) > 1 else np.zeros(0, np.int64)
    yield owner[whole], (pairs[whole] % np.uint64(WORD_BINS // 2)).astype(np.int64), WORD_BINS // 2
    data, half = words.data.astype(np.uint64), BYTE_BINS // 2
    text = np.repeat(np.arange(len(words.count), dtype=np.int32), np.diff(words.offsets))
    for k, width in enumerate((3, 5)):
        m = len(data) - width + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint64)
        for j in range(width):
            key = (key << np.uint64(8)) | data[j:j + m]
        key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)
        whole = text[:m] == text[width - 1:]
        yield text[:m][whole], key[whole].astype(np.int64), WORD_BINS + k * half


BINS = WORD_BINS + BYTE_BINS


def margins(words: Words, model: QualityModel) -> np.ndarray:
    """Intercept plus the mean weight of each family of n-grams."""
    n = len(words.count)
    out = np.full(n, model.intercept, np.float64)
    for owner, bins, base in _features(words):
        total = np.bincount(owner, weights=model.weights[base + bins], minlength=n)
        out += total / np.maximum(np.bincount(owner, minlength=n), 1)
    return out


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules, probability and verdict of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets)
                counts = base_counts(words)
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                p = model.probability(margins(words, model)) if model else np.ones(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                     pa.array(failed), pa.array(~failed & (p >= KEEP_FROM)), pa.array(p, pa.float64())],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "p_good"])

    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCORED)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; columns are scaled by their mean square."""
    scale = 1 / np.sqrt((x * x).mean(0) + 1e-8)
    scale /= np.sqrt(((x * scale) ** 2).sum(1).mean())
    weight, last, offset, offset_last = (np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    rate = 2.0 / balance.max()
    for t in range(STEPS):
        push = t / (t + 3)
        at, at_offset = weight + push * (weight - last), offset + push * (offset - offset_last)
        z = x @ (at * scale) + at_offset
        slope = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        last, offset_last = weight, offset
        weight = at - rate * ((x.T @ slope.astype(np.float32)) * scale + RIDGE * at)
        offset = at_offset - rate * float(slope.sum())
    return weight * scale, offset


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out margins, with smoothed targets."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> QualityModel | None:
    """Fit on at most ``rows`` labelled documents, those whose id hashes lowest; None without both classes."""
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # At most `rows` ids and labels: a broadcast of known size.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets)
                x = np.zeros((hi - lo, BINS), np.float32)
                for owner, bins, base in _features(words):
                    n = np.maximum(np.bincount(owner, minlength=hi - lo), 1)
                    np.add.at(x, (owner, base + bins), (1 / n[owner]).astype(np.float32))
                where = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([w.astype(np.uint16).tobytes() for w in where]),
                     pa.array([r[w].tobytes() for r, w in zip(x, where)])], names=["y", "bins", "values"])

    found = in_batches(sample, vectors, "y int, bins binary, values binary").toArrow()
    y = found.column("y").to_numpy().astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return None
    x = np.zeros((len(y), BINS), np.float32)
    for i, (bins, values) in enumerate(zip(found.column("bins").to_pylist(), found.column("values").to_pylist())):
        x[i, np.frombuffer(bins, np.uint16)] = np.frombuffer(values, np.float32)
    order = np.lexsort((x.sum(1), y))  # the same folds whatever the order of arrival
    fold = np.empty(len(y), np.int64)
    fold[order] = np.arange(len(y)) % FOLDS
    held = np.zeros(len(y))
    for k in range(FOLDS):
        if len(set(y[fold != k])) < 2:
            return None
        weight, offset = _fit(x[fold != k], y[fold != k])
        held[fold == k] = x[fold == k] @ weight + offset
    slope, shift = _platt(held, y)
    weight, offset = _fit(x, y)
    return QualityModel(weight.astype(np.float64), float(offset), slope, shift)
