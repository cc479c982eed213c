"""Shards of nearly equal bytes by Karmarkar-Karp differencing of indivisible groups of equal texts.

A partial partition holds one byte sum for each shard. The two with the largest spread are combined again
and again, one in rising and the other in falling order. What is differenced are nodes: each group above
a hundredth of a fair share is a node of its own, smaller groups are bundled by hash into a fixed number
of nodes, so that groups stay whole and the number of nodes is bounded whatever the table. Only node sums
reach the driver, and only the shard of each node goes back, as a broadcast of the same bound.

A group larger than a fair share cannot go into one shard: it is cut by the hash of the id into pieces
of less than a share.

Defined cases: a null text has 16 bytes, the CRC of an empty text and a group of its own; null ids are
allowed; repeated rows are separate rows of one group; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliotab.operators.ordered import number_rows

from .shared import stored

SHARDS, ROW_BYTES, BUNDLES, LARGE, CELLS = 40, 16, 1 << 14, 100, 512


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of rising sums) into one.

    Returns the combined sums, rising, and for each input row and place the place it ends in.
    """
    n, k = sums.shape
    if n == 1:
        return sums[0], np.arange(k, dtype=np.int16)[None]
    made = np.zeros((2 * n - 1, k), np.int64)
    made[:n] = sums
    parent = np.full(2 * n - 1, -1)
    place = np.zeros((2 * n - 1, k), np.int16)
    spread = made[:n, -1] - made[:n, 0]
    heap = list(zip((-spread).tolist(), range(n)))
    heapq.heapify(heap)
    rank = np.empty(k, np.int16)
    for new in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = made[a] + made[b][::-1]
        order = np.argsort(both, kind="stable")
        rank[order] = np.arange(k)
        made[new] = both[order]
        place[a], place[b] = rank, rank[::-1]
        parent[a] = parent[b] = new
        heapq.heappush(heap, (int(made[new, 0] - made[new, -1]), new))
    final = np.empty((2 * n - 1, k), np.int16)
    final[-1] = np.arange(k)
    for i in range(2 * n - 3, -1, -1):
        final[i] = final[parent[i]][place[i]]
    return made[-1], final[:n]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 within the shard) of every document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"), F.xxhash64(text_col, F.col(text_col).isNull()).alias("h")))
    key = ["h", "crc", "size"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"))
    share = max((rows.agg(F.sum("size").alias("bytes")).first().bytes or 0) / shards, 1.0)
    pieces = F.when(F.col("bytes") > share, F.ceil(F.col("bytes") * 1.25 / share)).otherwise(1)
    # At most LARGE * shards groups can be larger than a share / LARGE: that bounds the broadcast.
    large = groups.where(F.col("bytes") > share / LARGE).select(*key, pieces.alias("pieces"))
    rows = rows.join(F.broadcast(large), key, "left")
    piece = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.col("pieces"))
    rows = rows.withColumn("large", F.when(F.col("pieces").isNotNull(), F.struct(*key, piece.alias("piece"))))
    rows = rows.withColumn("bundle", F.when(F.col("large").isNull(), F.pmod(F.xxhash64(*key), F.lit(bundles)))).drop("pieces")
    nodes = rows.groupBy("bundle", "large").agg(F.sum("size").alias("bytes")).select("bundle", "large.*", "bytes")
    found = nodes.orderBy("bytes", "bundle", *key, "piece").toArrow()  # at most bundles + 3 * LARGE * shards rows
    sums = np.zeros((found.num_rows, shards), np.int64)
    sums[:, -1] = found.column("bytes")
    place = difference(sums)[1][:, -1] if found.num_rows else np.zeros(0, np.int64)
    seats = list(zip(*(found.column(c).to_pylist() for c in ("bundle", *key, "piece")), place.tolist()))
    table = spark.createDataFrame(seats, "bundle long, h long, crc long, size long, piece long, shard int")
    bundled = table.where("bundle is not null").select("bundle", "shard")
    single = table.where("bundle is null").select(F.struct(*key, "piece").alias("large"), F.col("shard").alias("own"))
    out = rows.join(F.broadcast(bundled), "bundle", "left").join(F.broadcast(single), "large", "left")
    out = out.select("doc_id", "size", "crc", "h", F.coalesce("own", "shard").alias("shard"))
    out = out.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
    out = number_rows(out, ["shard"], "cell", ["doc_id", "h"], "slot")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") - 1).cast("long").alias("slot"))
