"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Golden-ratio points are mapped through the cumulative weights of the sources: every point is a slot
of the schedule, slots are ranked within their source, and slot ``r`` of a source takes block ``r`` of
its shuffled word stream. Blocks hold equally many words; a stream starts again when it ends. Because
any stretch of golden-ratio points holds its share to within a few points, each source is given that
many spare slots; slots past its target take nothing and the last one is cut to fit.

Running sums and ranks are taken in two levels (cells, then one total for each cell), so that a source
with a third of all rows is spread over its cells.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; documents of
size 0 take nothing; an empty table gives an empty result; repeated rows are separate documents of
equal standing; columns other than the three named are not read and cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliotab.operators.ordered import number_rows, running_sums

from .shared import stored

#: Words of a block; most times that a word is taken; cells of the unit interval.
BLOCK_WORDS, MOST_REPEATS, CELLS = 128, 3, 4096
_GOLDEN = 0.6180339887498949
_LOW_BITS = 1 << 20
_GOLDEN_HIGH = math.fmod(_LOW_BITS * _GOLDEN, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source and number of words of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(rows: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row for each source: number, size, weight and target words.

    A source is at its limit if all targets, raised in proportion to the weights until this source
    reaches its limit, still stay below the total.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "sid")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.select("*", (F.row_number().over(by_name) - 1).cast("long").alias("sid"))
    sources = sources.withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    sources = sources.withColumn("most", (repeats * F.col("source_size")).cast("double"))
    sources = sources.withColumn("level", F.col("most") / F.col("weight"))
    everything, so_far = Window.partitionBy(), by_level.rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.select(
        "*", F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.sum("most").over(so_far).alias("most_below"), F.sum("weight").over(so_far).alias("weight_below"))
    full = F.col("most_below") + F.col("level") * (F.col("weights") - F.col("weight_below")) < F.col("total")
    sources = sources.withColumn("full", full)
    spare = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0))
    left = F.col("weights") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0.0))
    target = F.when(F.col("full"), F.col("most")).otherwise(spare / left * F.col("weight"))
    return sources.select("source", "sid", "source_size", "weight", target.alias("target"))


def golden_point(i: Column) -> Column:
    """Fractional part of i times the golden ratio, exact enough up to 2**40 points."""
    low = (i % _LOW_BITS) * F.lit(_GOLDEN)
    both = F.floor(i / _LOW_BITS) * F.lit(_GOLDEN_HIGH) + (low - F.floor(low))
    return both - F.floor(both)


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Slots (slot, sid, rank): rank counts the slots of a source from 0 in schedule order."""
    blocks = F.ceil(F.floor("target") / block)
    n = sources.agg(F.sum(blocks).alias("n")).first().n or 0
    deviation = 4 + math.ceil(math.log2(n + 1))
    wanted = sources.select("sid", F.when(blocks > 0, blocks + deviation).otherwise(0).alias("slots"))
    up_to = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    bounds = wanted.select("sid", "slots", F.sum("slots").over(up_to).alias("hi"),
                           F.sum("slots").over(Window.partitionBy()).alias("all")).where("slots > 0")
    lo, hi = (F.col("hi") - F.col("slots")) / F.col("all"), F.col("hi") / F.col("all")
    spans = bounds.select("sid", lo.alias("lo"), hi.alias("hi"),
                          F.explode(F.sequence(F.floor(lo * CELLS), F.least(F.floor(hi * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    total = sources.count() * deviation + n
    points = spark.range(total).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    slots = points.join(spans, "cell").where("point >= lo and point < hi")
    slots = slots.select("slot", "sid", F.floor(F.col("slot") / 8192).alias("stretch"))
    return number_rows(slots, ["sid"], "stretch", ["slot"], "rank").select("slot", "sid", (F.col("rank") - 1).alias("rank"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, repeats: int = MOST_REPEATS, **columns: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    spark = docs.sparkSession
    rows = stored(sized(docs, **columns))
    sources = stored(source_targets(rows, repeats))
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    numbered = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "doc_id", rows["source"], "size", "sid", "source_size", "target", shuffled.alias("place"))
    numbered = numbered.withColumn("cell", F.substring("place", 1, 3))
    laid = running_sums(numbered, ["sid"], "cell", ["place", "size"], {"start": F.col("size")})
    last = F.floor("target").cast("long")
    passes = F.when((F.col("size") > 0) & (last > 0), F.sequence(F.lit(0).cast("long"), F.floor((last - 1) / F.col("source_size"))))
    laid = laid.withColumn("pass", F.explode_outer(passes))
    laid = laid.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size"))
    laid = laid.withColumn("end", F.least(F.col("begin") + F.col("size"), last))
    laid = laid.withColumn("block", F.explode_outer(F.when(
        F.col("end") > F.col("begin"), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))))
    slots = schedule(spark, sources, block).select(F.col("sid").alias("s_sid"), F.col("rank").alias("s_rank"))
    taken = F.least("end", (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)
    joined = laid.join(slots, (laid["sid"] == slots["s_sid"]) & (laid["block"] == slots["s_rank"]), "left")
    return joined.groupBy("doc_id", "source", "size", "source_size", "target", "sid", "start").agg(
        F.sum(F.when(F.col("s_rank").isNotNull(), taken).otherwise(0)).alias("taken_by_segment"),
        F.count_if((F.col("size") == 0)).alias("empty_rows"),
    ).select("doc_id", "source", "size", "source_size", "target", F.col("taken_by_segment").cast("long").alias("taken"),
             F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("empty_rows").cast("int")))).alias("_copy")).drop("_copy")


#: The same result for DuckDB: each document's stretch of its source's stream, cut at the target.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most, (3 * source_size)::DOUBLE / (sid % 3 + 1)::DOUBLE AS level FROM s),
c AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights,
  sum(most) OVER (ORDER BY level, sid ROWS UNBOUNDED PRECEDING) AS most_below,
  sum(weight) OVER (ORDER BY level, sid ROWS UNBOUNDED PRECEDING) AS weight_below FROM w),
f AS (SELECT *, most_below + level * (weights - weight_below) < total AS is_full FROM c),
t AS (SELECT source, sid, source_size, CASE WHEN is_full THEN most ELSE
  (total - coalesce(sum(most) FILTER (is_full) OVER (), 0)) / (weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) * weight END AS target FROM f),
p AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, floor(target)::BIGINT) - start)
 + greatest(0, least(start + size + source_size, floor(target)::BIGINT) - start - source_size)
 + greatest(0, least(start + size + 2 * source_size, floor(target)::BIGINT) - start - 2 * source_size))::BIGINT AS taken FROM p
"""


def mixed(docs: DataFrame, block: int = BLOCK_WORDS, repeats: int = MOST_REPEATS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, to the nearest whole time.

    Only the one document of each source at which its target is cut can be taken in part.
    """
    plan = mix(docs, block, repeats).groupBy("doc_id", "source", "size").agg(
        F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("times")).where("times > 0")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), size.alias("words"))
    joined = rows.join(plan, F.col("doc.doc_id").eqNullSafe(plan["doc_id"]) & F.col("doc.source").eqNullSafe(plan["source"])
                       & (F.col("words") == plan["size"]))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc.*")
