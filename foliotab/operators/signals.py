"""Signals of a dictionary table found in texts, by the words of both.

A signal is found where its normalised form is part of the normalised text, as in ``signal_counts``, but the
signals come as a table of any length: nothing in the plan grows with it. A word between two others must be a whole
word of the text; the first word of a signal may end a longer word, the last may begin one, and a single word may lie
inside one. What the distinct words of some texts hold is looked up once, by exact numbers of up to twelve letters;
signals of several words are then followed from word to word.

A document meets the signals in a block of documents of bounded text, the signals come in packed parts of bounded
length. Only texts and packed parts are shuffled, never a row for each signal of a word or of a document, and blocks
grow with the parts, so that parts stay a fraction of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_words
from .storage import stored

#: Letters and digits that fit a number: 37^12 < 2^63.
LETTERS = 12
#: Characters of normalised text in a block of documents, about: at least, and at most.
BLOCK_CHARS, MOST_CHARS = 1 << 23, 1 << 26
#: Characters of a block for each byte of the packed signals.
CHARS_A_BYTE = 8
#: Signals in a packed part, about.
PART_SIGNALS = 1 << 19
#: Needles of a part that are looked at to find its bounds, about. Parts go by the order of needles: few share a first word.
PART_SAMPLE = 1 << 8
#: Characters of text that are searched at a time, about, unless one document has more.
WINDOW_CHARS = 1 << 21
#: Pairs of neighbouring words that are followed at a time.
STEPS = 1 << 15
#: Signals of the words of documents that are marked at a time, about, unless one document has more.
HITS = 1 << 17
#: Places for marks of signals by document.
MARKS = 1 << 22

_DIGITS = np.zeros(256, np.int64)
_DIGITS[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = np.arange(1, 37)

#: Bounds of lists, and their values one after the other.
Lists = tuple[np.ndarray, np.ndarray]


def _stretches(sizes: np.ndarray, doc: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes make about ``most`` at most; the rows of a document stay together."""
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    upto, done = np.cumsum(sizes)[ends - 1], 0
    while done < len(ends):
        start, before = (int(ends[done - 1]), upto[done - 1]) if done else (0, 0)
        done = max(done + 1, int(np.searchsorted(upto, before + most, "right")))
        yield start, int(ends[done - 1])


class _Numbers:
    """Places of distinct numbers, none of them negative, by an open hash table."""

    def __init__(self, numbers: np.ndarray):
        bits = max(10, (4 * len(numbers)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.held, self.place = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slots, left = self._slots(numbers), np.arange(len(numbers))
        while len(left):
            free = self.held[slots[left]] == -1
            put = left[free]
            self.held[slots[put]] = numbers[put]
            won = self.held[slots[put]] == numbers[put]
            self.place[slots[put[won]]] = put[won]
            left = np.concatenate([left[~free], put[~won]])
            slots[left] = (slots[left] + 1) & self.mask

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for one that is not held."""
        slots = self._slots(numbers)
        held = self.held[slots]
        found = np.where(held == numbers, self.place[slots], np.int32(-1))
        left = np.flatnonzero((held != numbers) & (held != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.held[slots[left]]
            same = held == numbers[left]
            found[left[same]] = self.place[slots[left[same]]]
            left = left[~same & (held != -1)]
        return found


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> Lists:
    """The values of each of n rows."""
    order = np.sort(rows << 32 | values)
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), order & 0xFFFFFFFF


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spread(lists: Lists, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every value of the lists of the rows, with its place in the rows."""
    bounds, values = lists
    n = bounds[rows + 1] - bounds[rows]
    return np.repeat(np.arange(len(rows)), n), values[_counted(n) + np.repeat(bounds[rows], n)]


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words, and the digits of their letters one after the other."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return bounds - bounds[0], _DIGITS[np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]]


class _Known:
    """Words of a kind with their codes: by number, and longer ones by the number of their first or last letters."""

    def __init__(self, words: pa.Array, codes: np.ndarray, at_end: bool = False):
        bounds, digits = _letters(words)
        size = np.diff(bounds)
        some = np.minimum(size, LETTERS)
        at, self.number = bounds[1:] - some if at_end else bounds[:-1], np.zeros(len(words), np.int64)
        for k in range(LETTERS):
            more = np.flatnonzero(some > k)
            self.number[more] = self.number[more] * 37 + digits[at[more] + k]
        self.words, self.codes, self.short, self.at_end = words, codes, size <= LETTERS, at_end

    def placed(self, numbers: np.ndarray) -> _Known:
        """Codes by the place of a number, and the longer words there."""
        places, codes = np.searchsorted(numbers, self.number), np.full(len(numbers), -1)
        codes[places[self.short]] = self.codes[self.short]
        self.longer: dict[int, list[tuple[str, int]]] = {}
        for i in np.flatnonzero(~self.short).tolist():
            self.longer.setdefault(int(places[i]), []).append((self.words[i].as_py(), int(self.codes[i])))
        self.codes, self.is_longer = codes, np.zeros(len(numbers), bool)
        self.is_longer[list(self.longer)] = True
        return self


class _Part:
    """The signals of one packed part, for the search of windows of text.

    First words are nodes, a middle word leads from a node to the next, and a last word from a node to the signal.
    """

    def __init__(self, packed: bytes):
        table = pa.ipc.open_stream(packed).read_all()
        needles = table["needle"].cast(pa.string()).combine_chunks().dictionary_encode()
        self.n = len(needles.dictionary)
        lists = pc.split_pattern(needles.dictionary, " ")
        begins, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        begins, size = begins[:-1], np.diff(begins)
        one, more = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
        single, begins, size = words.take(pa.array(begins[one])), begins[more], size[more]
        first, last = (words.take(pa.array(x)).dictionary_encode() for x in (begins, begins + size - 1))
        places = np.repeat(begins + 1, size - 2) + _counted(size - 2)
        middle = words.take(pa.array(places)).dictionary_encode()
        middle_at = np.zeros(len(words), np.int64)
        middle_at[places] = middle.indices.to_numpy()
        node, nodes, level = first.indices.to_numpy().astype(np.int64), len(first.dictionary), 1
        steps, left = [np.empty(0, np.int64)], np.flatnonzero(size > 2)
        while len(left):
            keys, at = np.unique(node[left] << 32 | middle_at[begins[left] + level], return_inverse=True)
            node[left], nodes, level = nodes + at, nodes + len(keys), level + 1
            steps.append(keys)
            left = left[size[left] > level + 1]
        steps = np.concatenate(steps)
        self.step = _Numbers(steps), len(first.dictionary) + np.arange(len(steps))
        self.end = _Numbers(node << 32 | last.indices.to_numpy()), more
        self.middle = middle.dictionary
        kinds = (_Known(single, one), _Known(first.dictionary, np.arange(len(first.dictionary)), at_end=True),
                 _Known(last.dictionary, np.arange(len(last.dictionary))))
        numbers = np.unique(np.concatenate([x.number for x in kinds]))
        self.numbers, self.kinds = _Numbers(numbers), [x.placed(numbers) for x in kinds]
        groups = table["signal_group"].combine_chunks().dictionary_encode()
        self.group = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.groups = pa.concat_arrays([groups.dictionary, pa.nulls(1, groups.dictionary.type)])
        self.groups_of = _lists(needles.indices.to_numpy().astype(np.int64), np.arange(table.num_rows), self.n)
        self.signals = table["signals"].to_numpy()
        self.marks = np.empty(max(MARKS, self.n), np.int32)

    def held(self, words: pa.Array) -> tuple[Lists, Lists, Lists, np.ndarray]:
        """What each word holds: signals inside it, first words at its end, last words at its start; and which middle word it is."""
        n, (bounds, digits) = len(words), _letters(words)
        of = np.repeat(np.arange(n), np.diff(bounds))
        start, number, rows, values = np.arange(len(digits)), np.zeros(len(digits), np.int64), ([], [], []), ([], [], [])
        for k in range(1, LETTERS + 1):
            inside = start + k <= bounds[of + 1]
            start, of = start[inside], of[inside]
            number = number[inside] * 37 + digits[start + k - 1]
            found = self.numbers.find(number)
            hits = np.flatnonzero(found >= 0)
            found, starts, owner = found[hits], start[hits], of[hits]
            every = np.ones(len(hits), bool)
            for known, lies, r, v in zip(self.kinds, (every, starts + k == bounds[owner + 1], starts == bounds[owner]), rows, values):
                codes = known.codes[found]
                good = (codes >= 0) & lies
                r.append(owner[good])
                v.append(codes[good])
                for i in np.flatnonzero(known.is_longer[found] & lies).tolist() if k == LETTERS else ():
                    word, place = words[int(owner[i])].as_py(), int(starts[i] - bounds[owner[i]])
                    for x, code in known.longer[int(found[i])]:
                        if word.endswith(x) if known.at_end else word.startswith(x, place):
                            r.append(owner[i:i + 1])
                            v.append(np.array([code]))
        middle = pc.fill_null(pc.index_in(words, self.middle), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return *(_lists(np.concatenate(r), np.concatenate(v), n) for r, v in zip(rows, values)), middle

    def once(self, docs: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The places of one of each document and signal; documents come in order."""
        kept, start, width = [np.empty(0, np.int64)], 0, len(self.marks) // self.n
        while start < len(docs):
            stop = int(np.searchsorted(docs, docs[start] + width))
            keys, places = (docs[start:stop] - docs[start]) * self.n + codes[start:stop], np.arange(stop - start, dtype=np.int32)
            self.marks[keys] = places
            kept.append(start + np.flatnonzero(self.marks[keys] == places))
            start = stop
        return np.concatenate(kept)

    def search(self, words: pa.Array, code: np.ndarray, row: np.ndarray, doc: np.ndarray, told: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and signals of a window: its distinct words, and of each word which it is, its row and its document; told: the documents with an id."""
        inside, ends, starts, middle = self.held(words)
        seen = np.unique(doc * len(words) + code)
        docs, seen = seen // len(words), seen % len(words)
        for start, stop in _stretches(np.diff(inside[0])[seen], docs, HITS):
            of, found = _spread(inside, seen[start:stop])
            of = docs[start:stop][of]
            kept = self.once(of, found)
            yield of[kept], found[kept]
        follows = np.append((row[1:] == row[:-1]) & told[doc[1:]], False)
        size, after = np.diff(ends[0]), (np.diff(starts[0]) > 0) | (middle >= 0)
        begins = np.flatnonzero(follows[:-1] & (size[code[:-1]] > 0) & after[code[1:]])
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lo in range(0, len(begins), STEPS):
            at = begins[lo:lo + STEPS]
            of, node = _spread(ends, code[at])
            at, level = at[of], 0
            while len(at):
                of, last = _spread(starts, code[at + 1])
                found = self.end[0].find(node[of] << 32 | last)
                held = np.flatnonzero(found >= 0)
                if level == len(levels):
                    levels.append([])
                levels[level].append((doc[at[of[held]]], self.end[1][found[held]]))
                on = np.flatnonzero(follows[at + 1] & (middle[code[at + 1]] >= 0))
                found = self.step[0].find(node[on] << 32 | middle[code[at[on] + 1]])
                held = np.flatnonzero(found >= 0)
                at, node, level = at[on[held]] + 1, self.step[1][found[held]], level + 1
        for level in levels:
            docs, found = (np.concatenate(x) for x in zip(*level))
            kept = self.once(docs, found)
            yield docs[kept], found[kept]

    def counts(self, docs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, group and how many signals, of documents and needles that come once; documents count from 0."""
        of, row = _spread(self.groups_of, codes)
        keys = docs[of] * len(self.groups) + self.group[row]
        if len(keys) and keys.max() < 4 * len(keys):
            sums = np.bincount(keys, self.signals[row])
            keys = np.flatnonzero(sums)
            sums = sums[keys]
        else:
            keys, at = np.unique(keys, return_inverse=True)
            sums = np.bincount(at, self.signals[row], len(keys))
        return keys // len(self.groups), keys % len(self.groups), sums.astype(np.int64)


@lru_cache(maxsize=1)
def _part(packed: bytes) -> _Part:
    """Blocks that a worker searches one after the other mostly meet the same part."""
    return _Part(packed)


def _counts_of_block(texts: pa.Table, parts: pa.Table) -> pa.Table:
    """``doc_id, signal_group, matched`` of one block, each part on its own."""
    ids = texts["doc_id"].combine_chunks().dictionary_encode()
    known = len(ids.dictionary)
    doc = ids.indices.fill_null(known).to_numpy(zero_copy_only=False).astype(np.int64)
    names, told = pa.concat_arrays([ids.dictionary, pa.nulls(1, ids.dictionary.type)]), np.arange(known + 1) < known
    chars = pc.fill_null(pc.binary_length(texts["body"]), 0).to_numpy()
    order, counts = np.argsort(doc, kind="stable"), []
    order = order[chars[order] > 0]
    if not len(order) or not parts.num_rows:
        return pa.table({})
    doc, chars = doc[order], chars[order]
    for packed in parts["packed"]:
        part = _part(packed.as_py())
        for start, stop in _stretches(chars, doc, WINDOW_CHARS):
            lists = pc.split_pattern(texts["body"].take(pa.array(order[start:stop])).combine_chunks(), " ")
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(start, stop), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            first = doc[start]
            found = part.search(words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64), row, doc[row] - first, told[first:])
            docs, groups, matched = part.counts(*(np.concatenate(x) for x in zip(*found)))
            counts.append(pa.table({"doc_id": names.take(pa.array(docs + first)), "signal_group": part.groups.take(pa.array(groups)), "matched": matched}))
    return pa.concat_tables(counts)


def _packed(rows: pa.Table) -> pa.Table:
    """``packed``: needles in order, with their groups."""
    rows, sink = rows.select(["needle", "signal_group", "signals"]).sort_by("needle"), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return pa.table({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _parts(signals: DataFrame) -> DataFrame:
    """``packed``: the needles of the signals (signal_group, signal), and how many signals of a group each stands for."""
    rows = signals.select("signal_group", "signal", norm_words("signal").alias("needle")).distinct().where(F.col("needle") != "")
    rows = stored(rows.groupBy("needle", "signal_group").agg(F.count("*").alias("signals")))
    n, part = 1 + rows.count() // PART_SIGNALS, F.lit(0)
    if n > 1 and (few := sorted(x.needle for x in rows.select("needle").sample(min(1.0, PART_SAMPLE / PART_SIGNALS), seed=0).collect())):
        bounds = F.array(*(F.lit(few[i * len(few) // n]) for i in range(1, n)))
        part = F.size(F.filter(bounds, lambda x: x <= F.col("needle")))
    return stored(rows.groupBy(part.alias("part")).applyInArrow(_packed, "packed binary"))


def _found(docs: DataFrame, signals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, signal_group, matched``: how many signals of each group (signal_group, signal) a document holds, by part."""
    parts = _parts(signals)
    size = parts.agg(F.sum(F.length("packed"))).first()[0] or 0
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = 1 + chars // min(MOST_CHARS, max(BLOCK_CHARS, CHARS_A_BYTE * size))
    texts = docs.select(F.col(id_col).alias("doc_id"), norm_words(text_col).alias("body"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"))
    met = parts.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("of_block"), "packed")
    kinds = [df.schema[name].dataType.simpleString() for df, name in ((texts, "doc_id"), (signals, "signal_group"))]
    return texts.groupBy("block").cogroup(met.groupBy("of_block")).applyInArrow(
        _counts_of_block, "doc_id {}, signal_group {}, matched bigint".format(*kinds))


def find_signals(docs: DataFrame, signals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, signal``: every signal of ``signals`` (signal) that each text holds, once.

    Null and empty texts hold none; a signal without letters or digits is found nowhere; documents are
    told apart by their id, so rows of one id are one document.
    """
    found = _found(docs, signals.select(F.col("signal").alias("signal_group"), "signal"), id_col, text_col)
    return found.select("doc_id", F.col("signal_group").alias("signal"))


def signal_groups(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """``doc_id, signal_group, matched``: how many signals of each group (signal_group, signal) a document holds."""
    return _found(docs, signals).groupBy("doc_id", "signal_group").agg(F.sum("matched").alias("matched"))
