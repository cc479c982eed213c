"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and every run of characters that are not letters becomes one space. 4-grams of
characters are counted for each language over all training rows, combined in each task before the
shuffle. All lower orders of Kneser-Ney follow from the distinct 4-grams (continuation counts). No 4-gram
is left out: the model grows with the corpus. It is cut into parts of at most ``PART_CELLS`` values, by
groups of languages and by the third character of the 4-gram (very common ones also by the second), so that a
part holds all that the back-off of its 4-grams needs. The driver builds one part at a time and broadcasts
it; a task scores its texts part by part and adds up. In a part, the log-probabilities of each order are
resolved for every language of the group and stored as sorted arrays of hashes with a column a language.

A text goes to the language of lowest cross-entropy per character. It is rejected if its cross-entropy
is above what the training texts of that language, all of them, reach: the limit is the mean plus
``REJECT_AT`` standard deviations, of which the within-text part shrinks with the length.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and are rejected; with no
training rows everything is ``und``; ties go to the language first in code-point order; repeated rows
get equal results; only id, text and (in training) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, in_batches, stored

ORDER, DISCOUNT, START = 4, 0.75, 1
#: Standard deviations at which a text is rejected; floor of the spread.
REJECT_AT, LEAST_SPREAD = 8.0, 0.15
#: Sums over the texts of a language.
SUMS = ("texts", "means", "squares", "within", "noise")
#: Languages of a group, 4-grams times languages of a part, characters scored at once, and bytes of texts for which the parts are loaded once.
GROUP, PART_CELLS, PIECE_CHARS, HELD_BYTES = 16, 4_000_000, 1 << 19, 8 << 20
PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"


def _letters() -> np.ndarray:
    """For each 16-bit code unit its lower-case letter, or a space."""
    out = np.full(1 << 16, 32, np.uint16)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    out[0xD800:0xE000] = np.arange(0xD800, 0xE000)  # only letters reach here as halves, see _units
    return out


def _units(text: str) -> np.ndarray:
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    if ((units & 0xF800) == 0xD800).any():
        text = "".join(c if ord(c) < 1 << 16 and not 0xD800 <= ord(c) < 0xE000 or c.isalpha() else " " for c in text)
        units = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    return units


_LETTERS = _letters()


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, each after a start mark and between single spaces, and their bounds."""
    units = [_units(t) for t in texts]
    before, after = np.array([START, 32], np.uint16), np.array([32], np.uint16)
    sizes = np.array([len(u) + 3 for u in units])
    flat = _LETTERS[np.concatenate([x for u in units for x in (before, u, after)])]
    flat[np.cumsum(sizes) - sizes] = START
    text = np.repeat(np.arange(len(units)), sizes)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (text[1:] != text[:-1])
    bounds = np.zeros(len(units) + 1, np.int64)
    np.cumsum(np.bincount(text[keep], minlength=len(units)), out=bounds[1:])
    return flat[keep], bounds


def grams(chars: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram inside a text, packed into 64 bits, and the position of its last character."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = chars.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(order):
        key = (key << np.uint64(16)) | wide[j:j + n]
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    inside = np.flatnonzero(text[:n] == text[order - 1:])
    return key[inside], inside + order - 1


class HashedTable:
    """Sorted hashes with a row of values each; looked up through an index over their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = self.spread(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.vstack([values[order], np.full((1, values.shape[1]), np.nan, np.float32)])
        self.bits = max(1, int(len(keys) + 1).bit_length() + 1)
        lead = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    @staticmethod
    def spread(keys: np.ndarray) -> np.ndarray:
        keys = keys * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        return keys * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; the last row stands for absent keys."""
        hashes = self.spread(keys)
        lead = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        none = len(self.hashes)
        found = np.full(len(keys), none, np.int32)
        pending = np.flatnonzero(at < end)
        for _ in range(self.longest):
            if not len(pending):
                break
            here = at[pending]
            hit = self.hashes[here] == hashes[pending]
            found[pending[hit]] = here[hit]
            pending = pending[~hit]
            at[pending] += 1
            pending = pending[at[pending] < end[pending]]
        return found


@dataclass(frozen=True)
class LanguageModel:
    """Per order, resolved log-probabilities and back-off weights of contexts."""

    names: list[str]
    grams: list[HashedTable]
    backoffs: list[HashedTable]
    unseen: np.ndarray

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """The log-probability of the last character of each 4-gram in each language."""
        table = self.grams[ORDER - 1]
        out = table.values[table.find(keys)]
        missing = np.flatnonzero(np.isnan(out[:, 0]))
        if len(missing):
            out[missing] = self._lower(keys[missing], ORDER)
        return out

    def _lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log-probabilities of n-grams that the table of their order lacks: back-off weight and next lower order."""
        if order == 1:
            return np.tile(self.unseen, (len(keys), 1))
        weights = self.backoffs[order - 1]
        factor = np.nan_to_num(weights.values[weights.find(keys >> np.uint64(16))], nan=0.0)
        short = keys & np.uint64((1 << (16 * (order - 1))) - 1)
        table = self.grams[order - 2]
        low = table.values[table.find(short)]
        missing = np.flatnonzero(np.isnan(low[:, 0]))
        if len(missing):
            low[missing] = self._lower(short[missing], order - 1)
        return low + factor


@dataclass(frozen=True)
class Seats:
    """The part of each 4-gram: by its third character, and by its second where that has several parts."""

    first: np.ndarray
    parts: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        third = ((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
        second = ((keys >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
        return self.first[third] + (second * 40503 & 0xFFFF) % self.parts[third]


@dataclass(frozen=True)
class LanguageParts:
    """The whole model: for each group of languages where 4-grams sit and the parts; per language, rejection limits."""

    names: list[str]
    groups: list[tuple[Seats, list[LanguageModel | Broadcast]]]
    limits: np.ndarray | None = None

    def single(self) -> bool:
        return sum(len(parts) for _, parts in self.groups) == 1


def _loaded(part: LanguageModel | Broadcast) -> LanguageModel:
    """A part, which is not kept in memory if it lies in a file."""
    if isinstance(part, LanguageModel):
        return part
    path = getattr(part, "_path", None)
    return part.load_from_path(path) if path else part.value


Counts = list[tuple[np.ndarray, np.ndarray]]


def kneser_ney(counts: Counts, names: list[str], lower_counts: dict[int, Counts] | None = None, alphabet: int | None = None) -> LanguageModel:
    """Models from the 4-grams (packed keys, counts) of each language.

    A part of the 4-grams needs the lower orders that its own do not tell, and the number of different characters and one.
    """
    n = len(names)
    mask = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for keys, freq in counts:
        by_order[ORDER].append((keys, freq.astype(np.float64)))
        seen = keys
        for k in range(ORDER - 1, 0, -1):  # how many different characters precede each shorter n-gram
            seen, preceded = np.unique(seen & mask[k], return_counts=True)
            by_order[k].append((seen, preceded.astype(np.float64)))
    for k, known in (lower_counts or {}).items():
        by_order[k] = [(keys, freq.astype(np.float64)) for keys, freq in known]
    alphabet = alphabet or len(np.unique(np.concatenate([by_order[1][i][0] for i in range(n)]))) + 1
    unseen = np.full(n, -np.log(alphabet), np.float32)
    tables: list[HashedTable] = []
    backoffs: list[HashedTable] = []
    lower_keys, lower = np.zeros(0, np.uint64), np.zeros((0, n))
    for k in range(1, ORDER + 1):
        contexts = np.unique(np.concatenate([np.unique(keys >> np.uint64(16)) for keys, _ in by_order[k]]))
        factor = np.zeros((len(contexts), n))  # a context that a language never saw passes on everything
        union = np.unique(np.concatenate([keys for keys, _ in by_order[k]]))
        own = np.zeros((len(union), n))
        for i, (keys, freq) in enumerate(by_order[k]):
            context = keys >> np.uint64(16)
            seen, at, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=freq)
            own[np.searchsorted(union, keys), i] = np.maximum(freq - DISCOUNT, 0) / total[at]
            factor[np.searchsorted(contexts, seen), i] = np.log(DISCOUNT * kinds / total)
        share = np.exp(factor[np.searchsorted(contexts, union >> np.uint64(16))])
        if k == 1:
            below = np.full((len(union), n), 1 / alphabet)
        else:
            below = lower[np.searchsorted(lower_keys, union & mask[k - 1])]
        lower_keys, lower = union, own + share * below
        tables.append(HashedTable(union, np.log(lower).astype(np.float32)))
        backoffs.append(HashedTable(contexts, factor.astype(np.float32)))
    unseen = unseen + np.float32(0)
    first = backoffs[0].values[0] if len(backoffs[0].hashes) else np.zeros(n, np.float32)
    return LanguageModel(names, tables, backoffs, (unseen + first).astype(np.float32))


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= PIECE_CHARS:
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _gram_runs(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """4-grams and their texts, counted from the first one, of texts from lo to hi."""
    for lo, hi in _runs(texts):
        chars, bounds = characters(texts[lo:hi])
        keys, ends = grams(chars, bounds, ORDER)
        yield lo, hi, keys, (np.searchsorted(bounds, ends, "right") - 1).astype(np.int64)


def entropies(model: LanguageParts, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy in each language, its squares' mean, and the number of scored characters of each text."""
    n, k = len(texts), len(model.names)
    mean, square, count = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n, np.int64)
    runs = _gram_runs(texts) if model.single() else list(_gram_runs(texts))
    at = 0
    for seats, parts in model.groups:
        for p, part in enumerate(parts):
            part = _loaded(part)
            for lo, hi, keys, text in runs:
                if len(parts) > 1:
                    here = np.flatnonzero(seats.of(keys) == p)
                    keys, text = keys[here], text[here]
                logp = part.log_probabilities(keys)
                if at == 0:
                    count[lo:hi] += np.bincount(text, minlength=hi - lo)
                for i in range(len(part.names)):
                    v = logp[:, i].astype(np.float64)
                    mean[lo:hi, at + i] -= np.bincount(text, weights=v, minlength=hi - lo)
                    square[lo:hi, at + i] += np.bincount(text, weights=v * v, minlength=hi - lo)
        at += len(part.names)
    size = np.maximum(count, 1)[:, None]
    return mean / size, square / size, count


def gathered(batches: Iterator[pa.RecordBatch], model: LanguageParts | None) -> Iterator[pa.RecordBatch]:
    """The batches, several together if the model has several parts to load."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if not model or model.single() or sum(b.nbytes for b in held) >= HELD_BYTES:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held = []
    if held:
        yield pa.concat_batches(held)


def count_grams(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows: counted within each batch, then combined by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

        def out(lang: str, parts: list) -> pa.RecordBatch:
            keys, n = combined(parts)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                                              names=["lang", "gram", "n"])

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for lo, hi in _runs(texts):
                    keys, n = np.unique(grams(*characters(texts[lo:hi]), ORDER)[0], return_counts=True)
                    parts = found.setdefault(lang, [])
                    parts.append((keys, n))
                    if len(parts) >= 16:
                        found[lang] = [combined(parts)]
                        if len(found[lang][0][0]) > 1_000_000:
                            yield out(lang, found.pop(lang))
        for lang, parts in found.items():
            yield out(lang, parts)

    counted = in_batches(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def in_training(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text is not 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _by_language(found: DataFrame, n: int) -> Counts:
    """Sorted keys and counts of each language from rows (i, gram, n)."""
    table = found.select("i", "gram", "n").toArrow()
    lang, keys, freq = table["i"].to_numpy(), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.lexsort((keys, lang))
    bounds = np.searchsorted(lang[order], np.arange(n + 1))
    return [(keys[order[lo:hi]], freq[order[lo:hi]]) for lo, hi in zip(bounds, bounds[1:])]


def seated(sizes: dict[int, int], most: int) -> tuple[Seats, int]:
    """Seats and number of parts, of about ``most`` 4-grams each, from the number of 4-grams of each third character."""
    first, parts = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    made, room = 0, 0
    for third, size in sorted(sizes.items()):
        if size > most:
            first[third], parts[third] = made, -(-size // most)
            made, room = made + int(parts[third]), 0
            continue
        if size > room:
            made, room = made + 1, most
        first[third], room = made - 1, room - size
    return Seats(first, parts), made


def _group(counted: DataFrame, names: list[str], entries: int, alphabet: int | None, cells: int) -> tuple[Seats, list[LanguageModel | Broadcast]]:
    """The parts of a group of languages."""
    spark, n = counted.sparkSession, len(names)
    index = spark.createDataFrame(pa.table({"lang": pa.array(names, pa.string()), "i": pa.array(range(n), pa.int32())}))
    own = counted.join(F.broadcast(index), "lang").select("i", "gram", "n")
    if entries * n <= cells:
        part = kneser_ney(_by_language(own, n), names, alphabet=alphabet)
        return seated({}, 1)[0], [part if alphabet is None else spark.sparkContext.broadcast(part)]
    third, second = (F.shiftrightunsigned("gram", k).bitwiseAND(0xFFFF) for k in (16, 32))
    # One row for each of at most 65,536 characters reaches the driver.
    seats, parts = seated({r.third: r.n for r in own.groupBy(third.alias("third")).agg(F.count("*").alias("n")).collect()}, max(1, cells // n))
    known = spark.createDataFrame(pa.table({"third": np.arange(1 << 16), "first": seats.first, "parts": seats.parts}))
    placed = own.withColumn("third", third).join(F.broadcast(known), "third").withColumn(
        "part", F.col("first") + (second * 40503).bitwiseAND(0xFFFF) % F.col("parts"))
    placed = stored(placed.select("part", "i", "gram", "n").sort("part", "gram", "i"))
    # How many different characters precede each pair and each single character, over all 4-grams.
    tail = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")
    pairs = stored(own.select("i", tail(3)).distinct().groupBy("i", tail(2)).agg(F.count("*").alias("n")))
    singles = _by_language(pairs.groupBy("i", tail(1)).agg(F.count("*").alias("n")), n)
    leading = F.shiftrightunsigned("gram", 16).bitwiseAND(0xFFFF)
    reach = pairs.withColumn("third", leading).join(F.broadcast(known), "third")
    reach = stored(reach.withColumn("part", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))).select(
        "part", "i", "gram", "n").sort("part", "gram", "i"))
    out = []
    for p in range(parts):
        lower = {2: _by_language(reach.where(F.col("part") == p), n), 1: singles}
        part = kneser_ney(_by_language(placed.where(F.col("part") == p), n), names, lower, alphabet)
        out.append(spark.sparkContext.broadcast(part))
    return seats, out


def train(docs: DataFrame, cells: int = PART_CELLS) -> LanguageParts | None:
    """Models of all languages of the training rows, scored in groups of ``GROUP``."""
    rows = docs.where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counted = stored(count_grams(rows))
    # One row a language reaches the driver.
    entries = {r.lang: r.grams for r in counted.groupBy("lang").agg(F.count("*").alias("grams")).collect()}
    if not entries:
        return None
    names = sorted(entries)
    alphabet = None
    if len(names) > GROUP or sum(entries.values()) * len(names) > cells:
        alphabet = counted.select(F.col("gram").bitwiseAND(0xFFFF).alias("last")).distinct().count() + 1
    groups = [_group(counted, part, sum(entries[x] for x in part), alphabet, cells)
              for part in (names[i:i + GROUP] for i in range(0, len(names), GROUP))]
    return calibrated(LanguageParts(names, groups), rows)


def calibrated(model: LanguageParts, rows: DataFrame) -> LanguageParts:
    """Add, per language, the mean cross-entropy, its spread between texts and the spread within a text, over all ``rows``.

    Sums over the rows of a language give the limits: the spread between texts is what their variance has
    beyond the part that the spread within texts of their lengths explains. A language of one row has the
    spread between the texts of all languages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(model.names)}
        for batch in gathered(batches, model):
            mean, square, count = entropies(model, batch.column(1).to_pylist())
            own = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            ok = np.flatnonzero((own >= 0) & (count > 0))
            own, size = own[ok], count[ok]
            m, s = mean[ok, own], square[ok, own]
            within = np.maximum(s - m * m, 0)
            seen = np.unique(own)
            facts = [np.bincount(own, weights=v, minlength=len(number))[seen] for v in (np.ones(len(ok)), m, m * m, within, within / size)]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *map(pa.array, facts)], names=["lang", *SUMS])

    sums = in_batches(rows.select("lang", "text"), run, "lang long, " + ", ".join(f"{c} double" for c in SUMS))
    found = {r.lang: r for r in sums.groupBy("lang").agg(*[F.sum(c).alias(c) for c in SUMS]).collect()}
    limits, between = np.zeros((len(model.names), 3)), np.zeros(len(model.names))
    for i, r in found.items():
        between[i] = max(0.0, (r.squares - r.means ** 2 / r.texts) / r.texts - r.noise / r.texts) if r.texts > 1 else 0.0
        limits[i] = r.means / r.texts, 0, r.within / r.texts
    several = [i for i, r in found.items() if r.texts > 1]
    pooled = sum(between[i] * found[i].texts for i in several) / max(1, sum(found[i].texts for i in several))
    for i, r in found.items():
        limits[i, 1] = max(LEAST_SPREAD, (between[i] if r.texts > 1 else pooled) ** 0.5)
    return LanguageParts(model.names, model.groups, limits)


def decide(model: LanguageParts, mean: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, probability of the language and acceptance of each text."""
    best = mean.argmin(1)
    at = np.arange(len(mean))
    strength = np.sqrt(np.maximum(count, 1))[:, None] * 4
    odds = np.exp(-np.clip((mean - mean[at, best][:, None]) * strength, 0, 700))
    centre, between, within = model.limits[best].T
    accepted = mean[at, best] <= centre + REJECT_AT * np.sqrt(between ** 2 + within / np.maximum(count, 1))
    return best, 1 / odds.sum(1), accepted & (count > 0)


def _verdicts(model: LanguageParts | None, texts: pa.Array) -> list[pa.Array]:
    """lang_pred, score, cross_entropy and acceptance of a column of texts."""
    n = len(texts)
    names, score = ["und"] * n, np.zeros(n)
    bits, accepted = np.full(n, np.nan), np.zeros(n, bool)
    if model and n:
        mean, _, count = entropies(model, [t or "" for t in texts.to_pylist()])
        best, p, ok = decide(model, mean, count)
        names = [model.names[b] if c else "und" for b, c in zip(best, count)]
        score, accepted = np.where(count > 0, p, 0.0), ok
        bits = np.where(count > 0, mean[np.arange(n), best], np.nan)
    return [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(accepted)]


def predict(docs: DataFrame, model: LanguageParts | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and acceptance of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_verdicts(model, batch.column(1))],
                                             names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, run, PREDICTED)


def accepted_rows(docs: DataFrame, model: LanguageParts | None, text_col: str = "text") -> DataFrame:
    """The documents whose language is accepted, with all their columns; only texts go to Python, and only verdicts come back."""
    def keep(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        batches = (pa.RecordBatch.from_arrays([t], names=["text"]) for t in texts)
        for batch in gathered(batches, model):
            yield _verdicts(model, batch.column(0))[3]

    bounded_batches(docs.sparkSession)
    return docs.where(F.arrow_udf(keep, "boolean")(F.col(f"`{text_col}`")))
