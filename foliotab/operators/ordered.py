"""Ordered computations that never put a whole key into one task.

A running value over a key is computed in two levels: rows are cut into blocks, each block
is scanned on its own, and only one summary row per block is scanned per key.  A key that
holds a third of the table is therefore spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def _block_join(df: DataFrame, context: DataFrame, on: list[str]) -> DataFrame:
    return df.join(context, on, "left")


def running_sums(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    values: dict[str, Column],
    include_current: bool = False,
) -> DataFrame:
    """Add ``name`` = sum of the value over earlier rows of the key (0 at the start)."""
    on = [*keys, block]
    df = df.withColumns({f"_{n}": v for n, v in values.items()})
    totals = df.groupBy(*on).agg(*[F.sum(f"_{n}").alias(f"_{n}_t") for n in values])
    over_blocks = Window.partitionBy(*keys).orderBy(block).rowsBetween(FIRST, -1)
    context = totals.select(
        *on, *[F.coalesce(F.sum(f"_{n}_t").over(over_blocks), F.lit(0)).alias(f"_{n}_b") for n in values]
    )
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(FIRST, 0 if include_current else -1)
    out = _block_join(df, context, on)
    for n in values:
        out = out.withColumn(n, F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) + F.col(f"_{n}_b"))
    return out.drop(*[f"_{n}" for n in values], *[f"_{n}_b" for n in values])


def carry_last(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    values: dict[str, Column],
    include_current: bool = True,
) -> DataFrame:
    """Add ``name`` = the last non-null value seen so far within the key (as-of backward)."""
    on = [*keys, block]
    df = df.withColumns({f"_{n}": v for n, v in values.items()})
    at = F.struct(*order)
    lasts = df.groupBy(*on).agg(
        *[
            F.max_by(F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), at)).alias(f"_{n}_t")
            for n in values
        ]
    )
    over_blocks = Window.partitionBy(*keys).orderBy(block).rowsBetween(FIRST, -1)
    context = lasts.select(
        *on, *[F.last(f"_{n}_t", ignorenulls=True).over(over_blocks).alias(f"_{n}_b") for n in values]
    )
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(FIRST, 0 if include_current else -1)
    out = _block_join(df, context, on)
    for n in values:
        out = out.withColumn(
            n, F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside), F.col(f"_{n}_b"))
        )
    return out.drop(*[f"_{n}" for n in values], *[f"_{n}_b" for n in values])


def first_rows(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """First row per key in the given order, combined map-side (no per-key sort)."""
    columns = df.columns
    named = [k if isinstance(k, str) else None for k in keys]
    work, key_names = df, []
    for i, (k, name) in enumerate(zip(keys, named)):
        if name is None:
            work = work.withColumn(f"_k{i}", k)
        key_names.append(name or f"_k{i}")
    picked = work.groupBy(*key_names).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def number_rows(df: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """1-based position within the key, blockwise."""
    return running_sums(df, keys, block, order, {name: F.lit(1)}, include_current=True)
