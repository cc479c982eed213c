"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, look-alike letters of other scripts to Latin, anything that is no letter a space. A
second reading also takes off accents and reads digits and signs that stand for letters; from it only
matches count that use such a change, and with changed accents only whole words. Entries are whole words or
beginnings of words; matches inside an exception phrase do not count.

The lexicon is a short fixed list plus what labelled rows teach: beginnings of words that are far more
frequent in toxic than in other texts. Of equal texts with one label one is counted; the curve is fitted on all. Each entry weighs its log-odds. The score is a logistic curve over
the weight found, the weight found for each word and for the root of the number of words.

Defined cases: a null or empty text has no match and gets the score of an unmatched text; with no labelled
rows of both classes the fixed list and a fixed curve are used; repeated rows get equal scores; null ids
pass through; only the id and text columns are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import in_training
from .shared import in_batches, stored

# Common insults in English, Spanish, French and German, folded.
INSULTS = ("idiot", "idiots", "moron", "morons", "loser", "losers", "stupid", "scum", "worthless", "pathetic", "disgusting",
           "trash", "clown", "imbecile", "dumbass", "asshole", "bastard", "idiota", "idiotas", "estupido", "estupida",
           "imbecil", "basura", "asqueroso", "patetico", "inutil", "idiote", "idiotes", "stupide", "ordure", "minable",
           "pathetique", "connard", "abruti", "idioten", "dumm", "dummkopf", "abschaum", "wertlos", "erbarmlich", "widerlich", "trottel")
# Harmless phrases that contain an entry.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "circus clown", "class clown", "clown fish", "pond scum")
# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
              "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
              "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "đ": "d", "ł": "l", "œ": "o"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: At most so many labelled rows are fitted; fewest and least share of toxic texts for a learned entry; its least log-odds,
#: and least log-odds times the root of its toxic texts; what a longer entry must add; most entries.
TRAINING_ROWS, LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, LEAST_STRENGTH, LEAST_GAIN, MOST_ENTRIES = 12_000, 4, 0.005, 1.2, 8.0, 0.7, 4000
SHORTEST, LONGEST, FIXED_WEIGHT, TOXIC_FROM = 3, 14, 6.0, 0.7
END = "\n"
SCORED = "doc_id long, score double, n_hits long, weight double"


def _folded_letters() -> np.ndarray:
    out = np.full(1 << 16, 32, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < 256 and low.isalpha():
            out[c] = ord(low)
            continue
        base = unicodedata.normalize("NFKD", LOOK_ALIKE.get(low, low))[:1]
        base = LOOK_ALIKE.get(base, base).lower()
        if base.isascii() and base.isalpha():
            out[c] = ord(base)
    return out


def _plain_letters() -> np.ndarray:
    """For each folded letter the one without its accent."""
    out = np.arange(256, dtype=np.uint8)
    for c in range(128, 256):
        base = unicodedata.normalize("NFKD", chr(c))[:1]
        out[c] = ord(base) if base.isascii() and base.isalpha() else {"ß": 115, "ø": 111, "æ": 97}.get(chr(c), c)
    return out


_FOLD, _PLAIN = _folded_letters(), _plain_letters()
_SIGN = np.zeros(128, np.uint8)
for _c, _v in SIGNS.items():
    _SIGN[ord(_c)] = ord(_v)
_OTHER_ONE = _SIGN.copy()
_OTHER_ONE[ord("1")] = ord("l")


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code units and their folded letters, between two spaces."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    if (((units & 0xF800) == 0xD800) | ((units >= 0x300) & (units < 0x370))).any():
        units = np.frombuffer(unicodedata.normalize("NFKC", text).encode("utf-16-le", "surrogatepass"), np.uint16)
    units = np.concatenate([[np.uint16(32)], units, [np.uint16(32)]])
    return units, _FOLD[units]


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of each entry (``END`` closes a whole word) and intercept and slopes of the curve."""

    lexicon: dict[str, float]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            machine.add_word(" " + entry.replace(END, " "), (len(entry) + 1, weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        machine.make_automaton()
        return machine

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_facts(weight, words) @ np.array(self.curve), -40, 40)))


def _facts(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    words = np.maximum(words, 1)
    return np.column_stack([np.ones(len(words)), np.log1p(weight), weight / np.sqrt(words), 10 * weight / (words + 20)])


def _matches(machine: ahocorasick.Automaton, letters: np.ndarray) -> list[tuple[int, int, float]]:
    found = [(end - size + 1, end + 1, weight) for end, (size, weight) in machine.iter(letters.tobytes().decode("latin-1"))]
    spared = [(s, e) for s, e, w in found if w == 0]
    return [(s, e, w) for s, e, w in found if w > 0 and not any(a <= s and e <= b for a, b in spared)]


def weigh(machine: ahocorasick.Automaton, text: str) -> tuple[int, float, int]:
    """Matches, their weight and the number of words; at one place the heaviest entry counts."""
    units, letters = folded(text)
    best: dict[int, float] = {}
    for s, _, w in _matches(machine, letters):
        best[s] = max(w, best.get(s, 0.0))
    small = np.minimum(units, 127).astype(np.uint8)
    plain, signs = _PLAIN[letters], _SIGN[small] > 0
    accents = plain != letters
    used = np.zeros(len(signs), bool)
    used[1:-1] = signs[1:-1] & ((letters[:-2] != 32) | (letters[2:] != 32) | signs[:-2] | signs[2:])
    if used.any() or accents.any():
        second: dict[int, float] = {}
        for table in (_SIGN, _OTHER_ONE) if (units == ord("1")).any() else (_SIGN,):
            other = np.where(used, table[small], plain)
            for s, e, w in _matches(machine, other):
                if s not in best and (used[s:e].any() or accents[s:e].any()) and (other[e - 1] == 32 or not accents[s:e].any()):
                    second[s] = max(w, second.get(s, 0.0))
        best |= second
    inside = letters != 32
    return len(best), sum(best.values()), int((inside[1:] & ~inside[:-1]).sum())


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, number of matches and their weight for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in batches:
            found = [weigh(machine, t.as_py() or "") for t in batch.column(1)]
            hits, weight, words = (np.array([f[k] for f in found], t) for k, t in enumerate((np.int64, np.float64, np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(weight, words)), pa.array(hits), pa.array(weight)],
                                             names=["doc_id", "score", "n_hits", "weight"])

    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCORED)


def _beginnings(text: str) -> set[str]:
    words = set(folded(text)[1].tobytes().decode("latin-1").split(" "))
    return {b for w in words if len(w) >= SHORTEST for b in _starts(w + END)}


def _starts(word: str) -> Iterator[str]:
    for k in range(SHORTEST, min(len(word), LONGEST) + 1):
        yield word[:k]


def learn(found: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries and weights from (beginning, toxic texts, other texts).

    A beginning is taken as specific as its toxic texts allow, and longer ones besides if they weigh more.
    """
    counts = {b: (t, o) for b, t, o in found}
    least = max(LEAST_TEXTS, LEAST_SHARE * toxic)

    def odds(b: str) -> float:
        t, o = counts.get(b, (0, 0))
        return math.log((t + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (other + 1))

    strong = {b for b, (t, _) in counts.items() if t >= least and odds(b) >= LEAST_ODDS and odds(b) * math.sqrt(t) >= LEAST_STRENGTH}
    children: dict[str, list[str]] = {}
    for b in strong:
        children.setdefault(b[:-1], []).append(b)
    out: dict[str, float] = {}
    for b in sorted(strong, key=lambda b: (len(b), b)):
        if any(counts[c][0] >= 0.95 * counts[b][0] for c in children.get(b, [])):
            continue  # the longer one says the same
        if odds(b) >= max((out[b[:k]] for k in range(SHORTEST, len(b)) if b[:k] in out), default=-1.0) + LEAST_GAIN or not any(
                b[:k] in out for k in range(SHORTEST, len(b))):
            out[b] = odds(b)
    for word in INSULTS:
        entry = word + END
        if not any(word.startswith(b.rstrip(END)) and (not b.endswith(END) or b == entry) for b in out):
            t, o = counts.get(entry, (0, 0))
            weight = FIXED_WEIGHT if t + o == 0 else min(FIXED_WEIGHT, odds(entry) + 1)
            if weight > 0.5:
                out[entry] = weight
    return dict(sorted(out.items(), key=lambda x: -x[1])[:MOST_ENTRIES])


def _curve(weight: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x = _facts(weight, words)
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        ridge = np.diag([0.0] + [0.01] * (x.shape[1] - 1)) * len(y) / 100
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge + 1e-6 * np.eye(len(b)), x.T @ (p - y) + ridge @ b)
        b = b - step
        if abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Learn entries and curve from at most ``rows`` labelled rows, all of them rows that may be learned from."""
    chosen = (labels.where(F.col(label).isin(0, 1) & in_training()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # At most `rows` ids and labels: a broadcast of known size.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("y", "text")

    sample = stored(joined)
    one_each = sample.groupBy("y", F.sha2("text", 256).alias("key")).agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else other).update(_beginnings(text))
        keys = sorted(set(toxic) | set(other))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
                                          pa.array([other[k] for k in keys], pa.int64())], names=["entry", "toxic", "other"])

    n = {r.y: r.n for r in one_each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel(dict.fromkeys((w + END for w in INSULTS), FIXED_WEIGHT), (-3.0, 2.0, 0.5, 0.1))
    fixed = [w + END for w in INSULTS]
    totals = in_batches(one_each.select("y", "text"), counted, "entry string, toxic long, other long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("other") + 0.5) / (n[0] + 1))
    strong = totals.where((F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * n[1])) & (odds >= LEAST_ODDS) & (odds * F.sqrt("toxic") >= LEAST_STRENGTH) | F.col("entry").isin(fixed))
    lexicon = learn([tuple(r) for r in strong.orderBy(F.desc("toxic"), "entry").limit(50 * MOST_ENTRIES).collect()], n[1], n[0])
    trial = ToxicityModel(lexicon, (0.0,) * 4)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = trial.automaton()
        for batch in batches:
            found = [weigh(machine, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.float64()),
                                              pa.array([f[2] for f in found], pa.int64())], names=["y", "weight", "words"])

    facts = in_batches(sample.select("y", "text"), weighed, "y int, weight double, words long").toPandas()
    facts = facts.sort_values(["y", "weight", "words"])
    return ToxicityModel(lexicon, _curve(facts["weight"].to_numpy(), facts["words"].to_numpy(np.float64), facts["y"].to_numpy(np.float64)))
