"""Near copies among vectors of one label: int8 tile products with error bounds, exact where in doubt.

Equal vectors of a label are one class. The classes of a label are dealt by hash into tiles of bounded
size, and every pair of tiles is one task, so a large label is spread over many tasks. A task quantises the
unit vectors to int8 with a scale of their own and multiplies the codes. With x = x' + e for each vector,
|x.y - x'.y'| <= |e_y| + |e_x| |y'|, so a pair can only reach the threshold if the product plus this bound
does; only such pairs are computed again in double precision. A task returns sums of links and a spanning
forest of the links it found, never the pairs themselves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label or an id, have no links and are a component of their own; vectors of different length are not
compared; repeated rows are separate vectors of one class; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

SIMILAR, TILE, ROWS_AT_ONCE, DENSE = 0.98, 2048, 512, 0.02
#: More than double rounding can move a product of unit vectors.
_ROUNDING = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the error and norm of the coded vector, for each row of unit vectors."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows; exact in single precision for stretches of 1,000 components."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1000):
        out += a[:, at:at + 1000].astype(np.float32) @ b[:, at:at + 1000].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, int]:
    """Which rows of x and y are similar, and how many pairs were computed in full."""
    cx, sx, ex, _ = quantised(x)
    cy, sy, ey, ny = quantised(y)
    out, full = np.zeros((len(x), len(y)), bool), 0
    for lo in range(0, len(x), ROWS_AT_ONCE):
        at = slice(lo, lo + ROWS_AT_ONCE)
        about = _products(cx[at], cy) * sx[at, None] * sy[None]
        maybe = about + ey[None] + ex[at, None] * ny[None] >= similar - _ROUNDING
        r, c = np.nonzero(maybe)
        full += len(r)
        if len(r) > DENSE * maybe.size:
            out[at] = maybe & (x[at] @ y.T >= similar)
        else:
            for k in range(0, len(r), 50_000):
                rr, cc = r[k:k + 50_000], c[k:k + 50_000]
                out[lo + rr, cc] = np.einsum("ij,ij->i", x[lo + rr], y[cc]) >= similar
    return out, full


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same ids as the whole matrix: each component to its smallest id."""
    out = []
    open_rows = linked.any(1)
    while open_rows.any():
        in_rows, in_columns = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
        new = np.array([open_rows.argmax()])
        while len(new):
            in_rows[new] = True
            more = np.flatnonzero(linked[new].any(0) & ~in_columns)
            in_columns[more] = True
            new = np.flatnonzero(linked[:, more].any(1) & ~in_rows)
        open_rows &= ~in_rows
        ids = np.unique(np.concatenate([rows[in_rows], columns[in_columns]]))
        out += [(int(ids[0]), int(i)) for i in ids[1:]]
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    x = np.array(table.column("v").combine_chunks().values, np.float64).reshape(table.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tile_pair(similar: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        first, second = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        same = second.num_rows == 0 and table.num_rows and table.column("ti")[0] == table.column("tj")[0]
        if same:
            second = first
        if not first.num_rows or not second.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "links")})
        linked, _ = tile_links(_matrix(first), _matrix(second), similar)
        a, b = first.column("id").to_numpy(), second.column("id").to_numpy()
        if same:
            np.fill_diagonal(linked, False)
        na, nb = first.column("copies").to_numpy(), second.column("copies").to_numpy()
        sums = [(a, linked @ nb)] + ([] if same else [(b, linked.T @ na)])
        ids = np.concatenate([i[n > 0] for i, n in sums])
        links = np.concatenate([n[n > 0] for i, n in sums])
        edges = np.array(forest(linked, a, b), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(np.concatenate([ids, edges[:, 0]])),
                         "b": pa.array(np.concatenate([ids, edges[:, 1]])),
                         "links": pa.array(np.concatenate([links, np.zeros(len(edges), np.int64)]))})

    return run


def near_vectors(vectors: DataFrame, similar: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    wide = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), wide.alias("v"))
    finite = F.forall("v", lambda c: F.coalesce((F.abs(c) < math.inf) & ~F.isnan(c), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v"))).withColumn("usable", usable)
    classes = stored(rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    tiles = classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = classes.withColumn("dim", F.size("v")).join(tiles, ["label", "dim"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = dealt.select("label", "dim", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"),
                         (F.col("tile") > F.col("other")).cast("int").alias("side"), "id", "copies", F.col("v").cast("array<float>").alias("v")
                         if dict(vectors.dtypes)["embedding"] == "array<float>" else "v")
    found = stored(pairs.groupBy("label", "dim", "ti", "tj").applyInArrow(_tile_pair(similar), "a long, b long, links long"))
    linked = found.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    together = components(found.where("links = 0").select("a", "b"))
    facts = classes.join(linked, "id", "left").join(together, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(facts, ["label", "v"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: The same result for DuckDB, by all pairs.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
