"""Packing token pieces into windows with counts of shallow length combinations from least squares.

Every document is tokenised once; whole windows are cut off its front and stand alone, so only a
remainder shorter than a window needs company. The histogram of remainder lengths has at most one row
for each length and is all that the driver sees. From it the driver

1. enumerates combinations of two and three length classes that fill a window,
2. solves for non-negative repeat counts that reproduce the histogram best in least squares,
3. rounds them down, and
4. packs what is left greedily, largest first, whole runs of equal windows at a time.

The plan is a list of (length class, first rank, last rank, window, place), again bounded by the
lengths, not the documents. A remainder finds its window by its rank within its class.

Defined cases: a null or empty text is the end id alone; texts of any length are cut, never dropped;
repeated rows are separate documents; null ids are allowed; an empty table gives an empty result; only
the id and text columns are read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliotab.operators.ordered import number_rows

from .shared import in_batches, stored

WINDOW, END_ID = 2048, 1
#: Combinations use classes this wide, of remainders from this length; shorter ones fill what is left.
CLASS_WIDTH, SHORTEST = 16, 256
CELLS = 256
PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


class Ids:
    """Token ids of whole texts under a byte-level BPE file of the ``tokenizers`` library.

    The file's ids are its merge ranks, which a rank-based encoder turns into the same ids in a third of
    the time; special tokens of the file that a text spells out are their own ids. The two are compared on a
    probe text with every special token when the file is loaded; where they differ, the file's own library encodes.
    """

    PROBE = "It's 12,5 km -- naïve façade, 東京! \t\n  (she'll) <|x|>%s  end \u00a0 "

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.ranked = self._ranked(path)
        probe = self.PROBE % " ".join(t.content for t in self.own.get_added_tokens_decoder().values())
        if self.ranked and self.ranked.encode(probe, allowed_special="all") != self.own.encode(probe, add_special_tokens=False).ids:
            self.ranked = None

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        model = json.loads(Path(path).read_text())
        if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("normalizer"):
            return None
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in model["added_tokens"]):
            return None
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked:
            return self.ranked.encode_to_numpy(text, allowed_special="all")
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece: whole windows from the front of the document, then its remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        ids_of = Ids(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            texts = pc.fill_null(batch.column(2), "")
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                ids = ids_of(text.as_py())
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at:at + window]
                    for column, value in zip(out, (doc, row, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return in_batches(rows, run, PIECES)


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares |Ax - b| with x >= 0, by growing and shrinking a set of free variables."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        if free.all() or gain.max() <= 1e-7 * max(1.0, abs(b).max()):
            break
        free[int(gain.argmax())] = True
        while True:
            at = np.flatnonzero(free)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > 1e-9).all():
                x[:] = 0
                x[at] = best
                break
            low = best <= 1e-9
            step = min((x[at][low] / np.maximum(x[at][low] - best[low], 1e-12)).min(), 1.0)
            x[at] += step * (best - x[at])
            free[at[x[at] <= 1e-9]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(classes: np.ndarray, full: int) -> list[tuple[int, ...]]:
    """Pairs and triples of the given classes that add up to a window."""
    have = set(classes.tolist())
    pairs = [(a, full - a) for a in sorted(have) if a <= full - a and full - a in have]
    triples = [(a, b, full - a - b) for a in sorted(have) for b in sorted(have) if a <= b <= full - a - b and full - a - b in have]
    return pairs + triples


def plan(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW, width: int = CLASS_WIDTH, shortest: int = SHORTEST) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, end rank, first window, place) and the number of windows.

    ``lengths`` rise and are shorter than a window. The ``k``-th piece of a row goes to window
    ``first window + k`` as the ``place``-th piece there.
    """
    left = dict(zip(lengths.tolist(), counts.tolist()))
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    windows = 0
    of_class: dict[int, list[int]] = {}
    for n in lengths[lengths >= shortest].tolist():
        of_class.setdefault(-(-n // width), []).append(n)
    classes = np.array(sorted(of_class), np.int64)
    combos = combinations(classes, window // width)
    if combos:
        index = {c: i for i, c in enumerate(classes.tolist())}
        a = np.zeros((len(classes), len(combos)))
        for j, combo in enumerate(combos):
            for c in combo:
                a[index[c], j] += 1
        b = np.array([sum(left[n] for n in of_class[c]) for c in classes.tolist()], float)
        repeats = np.floor(non_negative(a, b) + 1e-6).astype(np.int64)
        over = np.maximum((a @ repeats) - b, 0)
        for j in np.flatnonzero(repeats):
            take = int(min(repeats[j], min(sum(left[n] for n in of_class[c]) // combos[j].count(c) for c in set(combos[j]))))
            if over.any() and take <= 0:
                continue
            for place, c in enumerate(combos[j]):
                at = windows
                for n in of_class[c]:
                    part = min(left[n], windows + take - at)
                    if part > 0:
                        rows.append((n, used[n], used[n] + part, at, place))
                        used[n] += part
                        left[n] -= part
                        at += part
            windows += take
    sizes = sorted((n for n in left if left[n]), reverse=True)
    while sizes:
        room, content = window, []
        for n in sizes:
            fit = min(room // n, left[n])
            if fit:
                content.append((n, fit))
                room -= fit * n
        repeat = min(left[n] // fit for n, fit in content)
        place = 0
        for n, fit in content:
            for _ in range(fit):
                rows.append((n, used[n], used[n] + repeat, windows, place))
                used[n] += repeat
                left[n] -= repeat
                place += 1
        windows += repeat
        sizes = [n for n in sizes if left[n]]
    return np.array(sorted(rows), np.int64).reshape(-1, 5), windows


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, **columns: str) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stored(tokenised(docs, tokenizer, window=window, **columns))
    histogram = pieces.where(F.col("length") < window).groupBy("length").count().orderBy("length").toPandas()
    rows, windows = plan(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), window)
    short = pieces.where(F.col("length") < window).withColumn("cell", F.pmod(F.xxhash64("doc_id", "row"), F.lit(CELLS)))
    ranked = number_rows(short, ["length"], "cell", ["doc_id", "row"], "rank")
    ranked = ranked.select("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "rank")

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = rows[:, 0] << 40 | rows[:, 1]
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy() - 1
            row = rows[np.searchsorted(key, n << 40 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                                             names=[*batch.schema.names[:6], "sequence_id", "place"])

    seated = in_batches(ranked, seats, PIECES + ", sequence_id long, place long")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    shared = seated.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                           F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    whole = pieces.where(F.col("length") == window).withColumn("cell", F.pmod(F.xxhash64("row", "start"), F.lit(CELLS)))
    whole = number_rows(whole.withColumn("all", F.lit(0)), ["all"], "cell", ["row", "start"], "rank")
    alone = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                         (F.col("rank") - 1 + windows).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)
