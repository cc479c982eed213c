"""Periodic runs of words by maximal pairs in the LCP-interval tree.

A run is a stretch of words whose words ``period`` apart are equal, that is at least ``SHORTEST`` words
and ``TIMES`` periods long and that no neighbouring word extends. Two equal stretches of ``l`` words, ``q`` apart,
with different words before them and after them (a maximal pair) with ``l + q`` >= ``TIMES * q`` are exactly
a stretch of period ``q`` that cannot be extended: nothing is grown or verified afterwards. Several pairs of
one stretch differ in multiples of its smallest period, which counts.

Suffixes are sorted by doubling, for all texts of a batch piece at once, and only where words still tie.
The intervals of the LCP array are then walked bottom up. Each interval keeps the sorted positions of its
suffixes with the class of the word on their left, the smaller list is merged into the larger, and a position
looks only as far as a ``TIMES - 1``-th of the common length. Within that distance equal stretches are an
arithmetic progression (Fine and Wilf), in which all but the first have one left word: it takes the first
position to the left, and those to the right until the left words agree, to see every maximal pair.
Trees whose closest positions are too far apart, or whose left words are all equal, have no pair and are
not walked.

Defined cases: null and wordless texts have no run and collapse to the empty text; repeated rows give equal
rows; an empty table gives an empty result; only id and text are read; a text is worked on in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches

TIMES, SHORTEST = 4, 6
#: Common length of the shortest maximal pair that is a run.
LEAST = min(max(SHORTEST, TIMES * q) - q for q in range(1, SHORTEST + 1))
PIECE_WORDS = 1 << 16
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, and the first word of each text."""
    lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[\x20\x09-\x0D]+")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(real.to_numpy(zero_copy_only=False), out=before[1:])
    return flat.filter(real), before[offsets - offsets[0]]


def suffixes(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that share at least ``LEAST`` values with another one, in suffix order, and common lengths.

    Every text ends with a value of its own. Entry t of the lengths belongs to positions t - 1 and t.
    """
    n = len(sequence)
    _, rank, count = np.unique(sequence, return_inverse=True, return_counts=True)
    levels = [(np.cumsum(count) - count)[rank]]
    tied = np.flatnonzero(count[rank] > 1)
    tied = tied[np.argsort(levels[0][tied], kind="stable")]
    width, shared = 1, tied
    while len(tied):
        rank = levels[-1]
        key = rank[tied] * n + rank[tied + width]
        order = np.argsort(key, kind="stable")
        key, tied = key[order], tied[order]
        old = rank[tied]
        at = np.arange(len(tied))
        opens = np.ones(len(tied), bool)
        opens[1:] = old[1:] != old[:-1]
        at = old + at - np.maximum.accumulate(np.where(opens, at, 0))
        opens[1:] = key[1:] != key[:-1]
        fresh = rank.copy()
        fresh[tied] = np.maximum.accumulate(np.where(opens, at, 0))
        levels.append(fresh)
        alone = opens & np.append(opens[1:], True)
        tied, width = tied[~alone], 2 * width
        if width <= LEAST:
            shared = tied
    shared = shared[np.argsort(levels[-1][shared])]
    one, other = shared[:-1], shared[1:]
    common = np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][one + common] == levels[k][other + common]
        common[same] += 1 << k
    return shared, np.append([0], common) if len(shared) else common


def maximal_pairs(order: list[int], common: list[int], left: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(position, distance, common length) of the maximal pairs of one tree, not further apart than a run allows."""
    found = []

    def merged(one: list[int], other: list[int], length: int) -> list[int]:
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        far = length // (TIMES - 1)
        for i in small:
            at = bisect_left(large, i - far)
            if at < len(large) and large[at] < i and left[large[at]] != left[i]:
                found.append((large[at], i - large[at], length))
            at = bisect_left(large, i, at)
            while at < len(large) and large[at] <= i + far and left[large[at]] != left[i]:
                found.append((i, large[at] - i, length))
                at += 1
        for i in small:
            if i > large[-1]:
                large.append(i)
            else:
                insort(large, i)
        return large

    open_: list[tuple[int, list[int]]] = []
    current = [order[0]]
    for i, length in zip(order[1:] + [-1], common[1:] + [-1]):
        while open_ and open_[-1][0] > length:
            deep, items = open_.pop()
            current = merged(items, current, deep)
        if open_ and open_[-1][0] == length:
            open_[-1] = (length, merged(open_[-1][1], current, length))
        else:
            open_.append((length, current))
        current = [i]
    return iter(found)


def runs_of(codes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; starts count words over all texts."""
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kinds = int(codes.max()) + 1 if len(codes) else 1
    sequence = np.full(len(codes) + len(first) - 1, -1, np.int64)
    sequence[np.arange(len(codes)) + texts] = texts * kinds + codes
    ends = first[1:] + np.arange(len(first) - 1)
    sequence[ends] = len(first) * kinds + np.arange(len(first) - 1)
    order, common = suffixes(sequence)
    if not len(order):
        return []
    left = np.append([-1], sequence[:-1])
    tree = np.cumsum(common < LEAST)
    begins = np.flatnonzero(np.append([True], tree[1:] != tree[:-1]))
    by_place = np.lexsort((order, tree))
    gaps = np.diff(order[by_place], prepend=0)
    gaps[begins] = len(sequence)
    inner = common.copy()
    inner[begins] = 0
    sides = left[order]
    hopeful = (np.minimum.reduceat(gaps, begins) * (TIMES - 1) <= np.maximum.reduceat(inner, begins)) & (
        np.minimum.reduceat(sides, begins) != np.maximum.reduceat(sides, begins))
    best: dict[tuple[int, int], int] = {}
    for lo, hi in zip(begins[hopeful], np.append(begins[1:], len(order))[hopeful]):
        for at, period, length in maximal_pairs(order[lo:hi].tolist(), inner[lo:hi].tolist(), left):
            if length + period >= SHORTEST:
                stretch = at, length + period
                best[stretch] = min(period, best.get(stretch, period))
    starts = np.array([at for at, _ in best], np.int64)
    texts_before = np.searchsorted(ends, starts) if len(starts) else starts
    return sorted(((int(at - before), length, period) for ((at, length), period), before in zip(best.items(), texts_before)),
                  key=lambda r: (r[0], r[2]))


def _pieces(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last text of stretches of about ``PIECE_WORDS`` words; a longer text is one by itself."""
    lo, n = 0, len(first) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + PIECE_WORDS, "right")) - 1)
        yield lo, hi
        lo = hi


def _found(ids: pa.Array, words: pa.Array, first: np.ndarray) -> pa.RecordBatch:
    runs = runs_of(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), first)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    starts = np.array([r[0] for r in runs], np.int64)
    text = np.searchsorted(first, starts, "right") - 1
    listed = pa.StructArray.from_arrays(
        [pa.array(starts - first[text]), pa.array([r[1] for r in runs], pa.int64()), pa.array([r[2] for r in runs], pa.int64())],
        fields=list(_RUN))
    of_text = np.searchsorted(starts, first).astype(np.int32)
    left = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=left[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(left[first]), words.filter(pa.array(kept)).cast(pa.large_string()))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(of_text), listed), collapsed], names=["doc_id", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start in words, length and period, by start and period) and collapsed: the text with each
    run cut down to its first period, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = words_of(batch.column(1))
            for lo, hi in _pieces(first):
                yield _found(batch.column(0).slice(lo, hi - lo), words.slice(first[lo], first[hi] - first[lo]), first[lo:hi + 1] - first[lo])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def repeating_tail(id_: Column, text: Column) -> Column:
    """The text; where the checksum of the id is divisible by 10, its end repeats a stretch of its words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(id_.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)

    def planted(w: Column) -> Column:
        count = F.size(w).cast("long")
        at = g % count
        period = 1 + F.floor((count - at) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.get(
            w, F.when(i < at, i).otherwise(at + (i - at) % period).cast("int"))), " ")

    bound = F.get(F.transform(F.array(words), planted), F.lit(0))
    return F.when((h % 10 == 0) & (n > 0), bound).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of greatest exponent (ties: smallest start, then period) and digests of runs and collapsed text."""
    better = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"),
                       lambda kept, r: F.when(better(r, kept), r).otherwise(kept))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best")["length"] / F.col("best")["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
