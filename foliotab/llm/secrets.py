"""Secret scans with corpus-wide ownership of every candidate.

Three fixed patterns give the base spans; long mixed-character tokens of high entropy are further
candidates. Each candidate leaves the text only as a hash. Hashes are aggregated over the whole corpus by
owner and distinct repository: a value of several owners, or of more repositories than one credential is used
in, is a copied example; a value of one or two owners in few repositories looks live. Live high-entropy tokens join the spans; base spans stay whatever the verdict.

Texts are screened for each pattern by a linear-time matcher on the Arrow batch, and only texts that can
match are searched in detail. Aggregation combines before it shuffles; the join of verdicts to candidates
is salted, so that a value found in a third of all rows is spread.

Defined cases: a null or empty text has no spans; a null owner is an owner of its own; rows of one
repository (by default the id of the document) count once, a row without one is a repository of its own; an empty table gives an empty result; other columns are not read by ``judged`` and
pass through ``redacted`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, stored

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
SCREENS = (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", "AKIA[A-Z0-9]{12}",
           "[0-9a-f]{32}", "[A-Za-z0-9+/_=-]{24}")
SHORTEST_VALUE, SHORTEST_ACCESS, LEAST_ENTROPY, MOST_LIVE_OWNERS, MOST_LIVE_REPOSITORIES, SALTS = 8, 16, 3.5, 2, 50, 16
SPANS = "array<struct<start: int, kind: int, end: int, hash: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "little", signed=True)


def entropy(value: str) -> float:
    """Bits for each character of the value's own distribution."""
    return sum(-n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def find_spans(text: str, may: tuple[bool, bool, bool, bool] = (True,) * 4) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, hash of the value) of every candidate, in order of start and kind."""
    out = []
    if may[0]:
        out += [(m.start(), 0, m.end(), _hash(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_VALUE]
    if may[1]:
        out += [(m.start(), 1, m.end(), _hash(m[0])) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST_ACCESS]
    if may[2]:
        out += [(m.start(), 2, m.end(), _hash(m[0])) for m in HEX.finditer(text)]
    if may[3]:
        base = list(out)
        for m in TOKEN.finditer(text):
            v = m[0]
            mixed = any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)
            if mixed and entropy(v) >= LEAST_ENTROPY and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                out.append((m.start(), 3, m.end(), _hash(v)))
    return sorted(out)


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id",
         keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) as ``doc``, owner, repository, row number, counts, digest of the base spans and candidates."""

    def run(column: pa.Array) -> pa.Array:
        texts = pc.fill_null(column, "")
        may = [pc.match_substring_regex(texts, s).to_pylist() for s in SCREENS]
        spans = [find_spans(texts[i].as_py(), m) if any(m) else [] for i, m in enumerate(zip(*may))]
        base = [[x for x in row if x[1] < 3] for row in spans]
        return pa.StructArray.from_arrays(
            [*[pa.array([sum(x[1] == k for x in row) for row in base], pa.int64()) for k in range(3)],
             pa.array([hashlib.sha256(_joined(row).encode()).hexdigest() for row in base], pa.string()),
             pa.array([[dict(zip(("start", "kind", "end", "hash"), x)) for x in row] for row in spans], _SPANS)],
            names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    bounded_batches(docs.sparkSession)
    scanned = F.arrow_udf(run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans " + SPANS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col(f"`{owner_col}`").cast("string").alias("owner"),
                       F.col(f"`{repository_col}`").cast("string").alias("repository"), F.monotonically_increasing_id().alias("row"), scanned(F.col(f"`{text_col}`")).alias("scanned"))
    return rows.select("doc", "owner", "repository", "row", "scanned.*")


def ownership(scanned: DataFrame) -> DataFrame:
    """For each candidate hash, the distinct repositories and owners that hold it."""
    repository = F.coalesce(F.concat(F.lit("="), "repository"), F.col("row").cast("string"))
    each = scanned.select("owner", repository.alias("repository"), F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def judged(scanned: DataFrame) -> DataFrame:
    """Every scanned row with ``found``: its candidates and whether each looks live. ``scanned`` is read several times."""
    salt = F.pmod(F.col("row"), F.lit(SALTS)).cast("int")
    live = (F.col("owners") <= MOST_LIVE_OWNERS) & (F.col("repos") <= MOST_LIVE_REPOSITORIES)
    some = scanned.where(F.size("spans") > 0)
    each = some.select("row", salt.alias("salt"), F.explode("spans").alias("s")).select("row", "salt", "s", F.col("s.hash").alias("hash"))
    verdicts = ownership(scanned).select("hash", "repos", "owners", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = each.join(verdicts, ["hash", "salt"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "s.start", "s.kind", "s.end", live.alias("live"), "owners", "repos"))).alias("found"))
    with_spans = some.join(found, "row").select(*scanned.columns, "found")
    empty = F.array().cast(with_spans.schema["found"].dataType)
    return with_spans.unionByName(scanned.where(F.size("spans") == 0).withColumn("found", empty))


def report(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts, digest and spans of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    rows = judged(stored(scan(docs, keep=["doc_id"], **columns)))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.filter("found", lambda s: (s["kind"] < 3) | s["live"])
    text = F.transform(shown, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", text).alias("spans"),
                       F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
                       F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_copied"))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **columns: str) -> DataFrame:
    """The documents with live candidates and copied examples of the base kinds replaced by marks."""
    rows = judged(stored(scan(docs, text_col, **columns)))
    cut = F.filter("found", lambda s: (s["kind"] < 3) | s["live"])
    # Keep what lies before each span; a span inside an earlier one adds nothing.
    body = F.col(f"doc.`{text_col}`")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    done = F.aggregate(cut, start, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        F.concat(acc["text"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]),
                 F.when(s["live"], "<secret>").otherwise("<example>")).alias("text"), s["end"].alias("at"))).otherwise(
        F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"))))
    clean = F.when(F.size(cut) == 0, body).otherwise(F.concat(done["text"], F.substring(body, done["at"] + 1, F.length(body))))
    rows = rows.select("doc", clean.alias("clean"))
    changed = {text_col: F.col("clean")} | ({length_col: F.length("clean").cast("long")} if length_col else {})
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
