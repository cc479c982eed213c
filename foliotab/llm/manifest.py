"""Merkle manifest of a dataset: every row with a witness that leads from its leaf to one root.

Leaves of a group ascend by id. Levels join two consecutive nodes; a last node without partner is hashed
alone. The roots of the groups, ascending, are joined in the same way.

Leaves are appended in blocks of 2 to the power of ``BLOCK_BITS`` that are aligned to the group's first leaf. A task keeps the open
perfect subtrees of its block, and every leaf carries a partial witness: when a later sibling is complete, both
sides take each other's root as their next entry. The roots of the blocks are further appends, to the
next tier of blocks, up to one root a group, and the roots of the groups are appends once more. A leaf's
witness is then its own entries followed by those of its block, its block's block, and its group; these come
by a join with one row a block.

No task holds more than a block: places in a group are counted over range partitions of (group, id), so a
group of a third of all rows is spread like any other.

Defined cases: any column may be null; rows without an id come first in their group; rows of one id
are ordered by their leaves, so repeated rows are several leaves; a group may be null, which sorts first;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, stored

#: Power of two of the nodes that one task appends.
BLOCK_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: First byte of an entry of a witness: sibling on the left, sibling on the right, or none. A digest follows the first two.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def leaf(*fields: Column) -> Column:
    """Digest of fields, each as its number of UTF-8 bytes, a colon and its text, or a hyphen if it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Subtrees:
    """Open perfect subtrees of an append-only tree, and the witness so far of every node appended."""

    def __init__(self):
        self.open: list[tuple[int, str, list[int]]] = []
        self.witness: list[list[bytes]] = []

    def append(self, node: str) -> None:
        self.witness.append([])
        self._complete(0, node, [len(self.witness) - 1])

    def _extend(self, members: list[int], side: bytes, sibling: str) -> None:
        entry = side + bytes.fromhex(sibling)
        for i in members:
            self.witness[i].append(entry)

    def _complete(self, height: int, root: str, members: list[int]) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, earlier = self.open.pop()
            self._extend(earlier, RIGHT, root)
            self._extend(members, LEFT, left)
            height, root, members = height + 1, joined(left, root), earlier + members
        self.open.append((height, root, members))

    def close(self, height: int = 0) -> str:
        """The root, with nodes that have no partner hashed alone until one is left of at least this height."""
        while len(self.open) > 1 or self.open[0][0] < height:
            at, root, members = self.open.pop()
            self._extend(members, ALONE, "")
            self._complete(at + 1, joined(root), members)
        return self.open[0][1]


def entries(witness: bytes) -> Iterator[tuple[bytes, str]]:
    """(side, digest) from the leaf upwards."""
    at = 0
    while at < len(witness):
        side = witness[at:at + 1]
        end = at + (1 if side == ALONE else 33)
        yield side, witness[at + 1:end].hex()
        at = end


def fold(node: str, witness: bytes) -> str:
    """The root that a leaf and its witness lead to."""
    for side, sibling in entries(witness):
        node = joined(sibling, node) if side == LEFT else joined(node, sibling)
    return node


def _placed(nodes: DataFrame) -> DataFrame:
    """Stored nodes with ``place`` in the group (from 0) and ``total``; nodes hold group, id, node, and more."""
    ordered = nodes.repartitionByRange("group", "id", "node", "tie").sortWithinPartitions("group", "id", "node", "tie")
    held = stored(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = held.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    group = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("group", "part", (before - F.col("low")).alias("base"), F.sum("n").over(group).alias("total"))
    return held.join(bases, ["group", "part"]).withColumn("place", F.col("at") + F.col("base")).drop("part", "at", "base", "tie")


def _grown(nodes: DataFrame, bits: int) -> DataFrame:
    """group, place, carried, witness and (at the first node of each block) root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        trees = Subtrees()
        for node in table["node"].to_pylist():
            trees.append(node)
        root = trees.close(bits if table["total"][0].as_py() > 1 << bits else 0)
        roots = [root] + [None] * (len(table) - 1)
        return table.select(["group", "place", "carried", "node"]).append_column(
            "witness", pa.array([b"".join(w) for w in trees.witness], pa.binary())).append_column("root", pa.array(roots, pa.string()))

    blocks = nodes.select("group", "place", "total", "carried", "node", F.shiftright("place", bits).alias("block"))
    carried = nodes.schema["carried"].dataType.simpleString()
    return stored(blocks.groupBy("group", "block").applyInArrow(
        run, f"group string, place long, carried {carried}, node string, witness binary, root string"))


def _tiers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Grown blocks of every tier, from the leaves up; the last has one block a group."""
    tiers, most = [], nodes.agg(F.max("total")).first()[0] or 0
    while True:
        tiers.append(_grown(nodes, bits))
        if most <= 1 << bits:
            return tiers
        most = -(-most // (1 << bits))
        nodes = tiers[-1].where("root is not null").select(
            "group", F.shiftright("place", bits).alias("place"), F.lit(None).cast("int").alias("carried"), F.col("root").alias("node"))
        nodes = nodes.join(nodes.groupBy("group").agg(F.count("*").alias("total")), "group")


def _group_key(group: Column) -> Column:
    """A key that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(leaves: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """id, carried, leaf, subroot, root and witness of every leaf (group, id, leaf, carried)."""
    nodes = leaves.select(_group_key(F.col("group")).alias("group"), "id", F.col("leaf").alias("node"),
                          F.struct("id", "carried").alias("carried"), F.monotonically_increasing_id().alias("tie"))
    tiers = _tiers(_placed(stored(nodes)), block_bits)
    subroots = tiers[-1].where("root is not null").select("group", F.col("root").alias("subroot"))
    tops = subroots.select(F.lit("").alias("group"), F.col("group").alias("id"), F.col("subroot").alias("node"),
                           F.struct("group", "subroot").alias("carried"), F.lit(0).alias("tie"))
    above = _tiers(_placed(tops), block_bits)
    roots = above[-1].where("root is not null").select(F.lit("").alias("group"), F.col("root"))
    upper = _down(above, block_bits, roots.select("group", "root", F.lit(b"").alias("upper"), F.lit("").alias("subroot")))
    context = upper.select(F.col("carried")["group"].alias("group"), F.col("carried")["subroot"].alias("subroot"), "root", "upper")
    found = _down(tiers, block_bits, context)
    return found.select("carried.id", "carried.carried", F.col("node").alias("leaf"), "subroot", "root", F.col("upper").alias("witness"))


def _down(tiers: list[DataFrame], bits: int, context: DataFrame) -> DataFrame:
    """Rows of the lowest tier with the entries of all tiers above appended; context: group, subroot, root, upper."""
    rows = None
    for tier in reversed(tiers):
        found = tier.select("group", "place", "carried", "node", "witness")
        if rows is None:
            found = found.join(context, "group")
        else:
            held = rows.select("group", F.col("place").alias("block"), "subroot", "root", "upper")
            found = found.withColumn("block", F.shiftright("place", bits)).join(held, ["group", "block"])
        rows = found.select("group", "place", "carried", "node", "subroot", "root", F.concat("witness", "upper").alias("upper"))
    return rows


def document_leaves(docs: DataFrame) -> DataFrame:
    """group (lang), id, leaf and carried of documents: carried is the leaf after tampering, null where the row is left alone.

    Tampering adds 1 to n_chars where 7 divides the checksum of the id.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf(*[F.col(c) for c in FIELDS]).alias("leaf"),
                       F.when(hit, leaf(*other)).alias("carried"))


def verified(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, digest of the siblings, root that the (tampered) leaf folds to, and whether it is the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for node, other, witness in zip(*(batch.column(c).to_pylist() for c in ("leaf", "carried", "witness"))):
                proofs.append(joined(*[sibling for _, sibling in entries(witness)]))
                folded.append(fold(other or node, witness))
            roots = batch.column("root").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "leaf", "subroot", "root")), pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
                 pa.array([a == b for a, b in zip(folded, roots)], pa.bool_())], names=NAMES)

    rows = found.select("id", "carried", "leaf", "subroot", "root", "witness")
    return in_batches(rows, run, f"doc_id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} string" for c in NAMES[1:-1]) + ", verified boolean")


def _sql_leaf(n_chars: str) -> str:
    texts = [f"{n_chars if c == 'n_chars' else c}::VARCHAR" for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


#: The same result for DuckDB, level by level.
SQL = f"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS k),
c AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: xor(k.k[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 7 = 0 AS hit FROM documents d, k),
f AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_sql_leaf('n_chars')} AS leaf,
  CASE WHEN hit THEN {_sql_leaf('(n_chars + 1)')} END AS other FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM f),
t AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM l
  UNION ALL SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lvl, i // 2, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, h, n FROM s
  UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
r AS (SELECT h AS root FROM u WHERE n = 1),
p AS (SELECT l.g, l.i, v.lvl, (l.i >> v.lvl) & 1 = 1 AS is_right, o.h FROM l JOIN (SELECT DISTINCT g, lvl FROM t WHERE n > 1) v ON v.g = l.g
    LEFT JOIN t o ON o.g = l.g AND o.lvl = v.lvl AND o.i = xor(l.i >> v.lvl, 1)
  UNION ALL SELECT l.g, l.i, 1000 + v.lvl, (s.i >> v.lvl) & 1 = 1, o.h FROM l JOIN s ON s.g = l.g JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) v ON true
    LEFT JOIN u o ON o.lvl = v.lvl AND o.i = xor(s.i >> v.lvl, 1)),
w AS (SELECT g, i, string_agg(h, '' ORDER BY lvl) AS proof,
  list(CASE WHEN h IS NULL THEN '-' WHEN is_right THEN 'L' || h ELSE 'R' || h END ORDER BY lvl) AS steps FROM p GROUP BY g, i),
z AS (SELECT l.doc_id, l.leaf, s.h AS subroot, r.root, sha256(coalesce(w.proof, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(l.other, l.leaf), coalesce(w.steps, [])), lambda a, e: sha256(CASE e[1] WHEN 'L' THEN e[2:] || a WHEN 'R' THEN a || e[2:]
    ELSE a END)) AS folded_root
  FROM l JOIN s ON s.g = l.g JOIN r ON true LEFT JOIN w ON w.g = l.g AND w.i = l.i)
SELECT *, folded_root = root AS verified FROM z
"""
