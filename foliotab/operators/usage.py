"""Plan quotas, access and dashboard analytics over usage events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import trim_ws, truncate_example
from ..functions.values import micros
from .storage import stored

#: Copies of a profile's example block, to spread a profile that many documents share.
SALTS = 16


# --- access ----------------------------------------------------------------


def usage_context(codes: DataFrame, clients: DataFrame, plans: DataFrame) -> DataFrame:
    """Code with its client and plan.  Join strategy is left to size statistics."""
    return codes.join(clients, "client_id").join(plans, "plan_name")


def code_hash_lookup(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """Match entered codes by the SHA-256 of the trimmed text; unknown codes stay with nulls."""
    return attempts.withColumn("code_hash", F.sha2(trim_ws("entered"), 256)).join(codes, "code_hash", "left")


def usage_with_client(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Events with their client; those without one skip the join, so they load no single partition."""
    named = events.where(F.col("client_id").isNotNull()).join(clients, "client_id", "left")
    return named.unionByName(events.where(F.col("client_id").isNull()), allowMissingColumns=True)


def usage_event_rows(results: DataFrame) -> DataFrame:
    """One usage row per processed document; internal tests carry no client or code."""
    test = F.coalesce("is_internal_test", F.lit(False)) & F.col("access_code_id").isNull()
    kind = F.when(test & F.col("extraction_kind").isNull(), F.lit("internal-test")).when(
        test, F.concat(F.lit("internal-test:"), F.col("extraction_kind"))
    ).otherwise(F.col("extraction_kind"))
    return results.where(test | F.col("access_code_id").isNotNull()).withColumn("extraction_kind", kind)


# --- quotas ----------------------------------------------------------------


def quota_usage(events: DataFrame, limits: DataFrame, at: Column) -> DataFrame:
    """Successes of each code since day and month start, and whether one more is allowed.

    ``limits`` holds ``code_id, daily_limit, monthly_limit``; codes without events are kept.
    """
    day, month = F.date_trunc("day", at), F.date_trunc("month", at)
    used = (
        events.where((F.col("status") == "success") & (F.col("created_at") >= month))
        .groupBy("code_id")
        .agg(F.count_if(F.col("created_at") >= day).alias("daily_usage"), F.count("*").alias("monthly_usage"))
    )
    out = limits.join(used, "code_id", "left").fillna(0, ["daily_usage", "monthly_usage"])
    return out.withColumn(
        "allowed",
        (F.col("daily_usage") < F.col("daily_limit")) & (F.col("monthly_usage") < F.col("monthly_limit")),
    )


def quota_decisions(events: DataFrame, limits: DataFrame, blocks: int | None = None) -> DataFrame:
    """Replay: whether each event was allowed, given earlier successes of its day and month.

    Events are cut into range partitions by code and time, so that a block holds a bounded number of
    rows whatever the code or the burst.  Counts run in two levels: blocks, then inside a block.
    Events without a limit row are unlimited; events without a code are left out.
    """
    ok = F.when(F.col("status") == "success", 1).otherwise(0)
    order = ["code_id", "created_at", "event_id"]
    ranged = events.repartitionByRange(blocks, *order) if blocks else events.repartitionByRange(*order)
    e = stored(ranged.withColumns({
        "_day": F.date_trunc("day", "created_at"), "_month": F.date_trunc("month", "created_at"),
        "_block": F.spark_partition_id(), "_ok": ok,
    }))
    part = ["code_id", "_day", "_block"]
    sums = e.groupBy("_month", *part).agg(F.sum("_ok").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    by_month = Window.partitionBy("code_id", "_month").orderBy("_day", "_block").rowsBetween(*before)
    by_day = Window.partitionBy("code_id", "_day").orderBy("_block").rowsBetween(*before)
    sums = sums.select(
        *part, F.coalesce(F.sum("_n").over(by_day), F.lit(0)).alias("_day_before"),
        F.coalesce(F.sum("_n").over(by_month), F.lit(0)).alias("_month_before"),
    )
    inside = Window.partitionBy(*part).orderBy("created_at", "event_id").rowsBetween(*before)
    counted = e.join(sums, part).withColumn("_in", F.coalesce(F.sum("_ok").over(inside), F.lit(0))).select(
        *events.columns,
        (F.col("_day_before") + F.col("_in")).alias("prior_day"),
        (F.col("_month_before") + F.col("_in")).alias("prior_month"),
    )
    return counted.join(limits, "code_id", "left").withColumn(
        "allowed",
        F.coalesce(
            (F.col("prior_day") < F.col("daily_limit")) & (F.col("prior_month") < F.col("monthly_limit")), F.lit(True)
        ),
    )


# --- rate limit ------------------------------------------------------------


def _runs(pdf: pd.DataFrame, by: list[str]) -> Iterator[tuple[int, int]]:
    """First row and end of each run of equal values."""
    change = np.zeros(len(pdf), bool)
    change[:1] = True
    for c in by:
        change |= pdf[c].ne(pdf[c].shift()).to_numpy()
    edges = np.flatnonzero(change)
    yield from zip(edges, [*edges[1:], len(pdf)])


def _block_steps(width: int):
    """What a block makes of the window that is open before it: per entry event, the window open after it.

    The open window began at or before the block's first event, so only the events up to one window
    after that can be the first of a new one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["us"].to_numpy())
        n = len(us)
        following = np.append(np.searchsorted(us, us + width), n)
        entry = np.arange(min(n, int(following[0]) + 1))
        at, back = entry, entry
        while (following[at] < n).any():
            at, again = np.unique(np.where(following[at] < n, following[at], at), return_inverse=True)
            back = again[back]
        out = at[back]
        kept = np.append(np.flatnonzero(np.diff(out)), len(out) - 1)  # the last entry of each run of equal outcomes
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1], "n": [n], "entry": [us[entry[kept]].tolist()],
                             "start": [us[out[kept]].tolist()], "count": [(n - out[kept]).tolist()]})

    return run


def _chain(width: int):
    """The open window (start, events in it) before each block of a key; one block is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, start, count = None, None, 0
        for pdf in batches:
            out = []
            for key, block, n, entry, starts, counts in pdf.itertuples(index=False):
                if owner != (key,):
                    owner, start, count = (key,), None, 0
                out.append((key, block, start, count))
                at = 0 if start is None else int(np.searchsorted(entry, start + width))
                if start is None or at < len(entry):
                    start, count = int(starts[at]), int(counts[at])
                else:
                    count += n
            yield pd.DataFrame(out, columns=["key", "block", "open_start", "open_count"]).astype({"open_start": "Int64"})

    return run


def rate_limit_batch(
    events: DataFrame,
    limit: int = V.RATE_LIMIT,
    window_seconds: int = V.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Replay of the fixed window anchored at a key's first event.

    ``events``: ``key, event_id, ts``.  Adds ``window_count, allowed, remaining, reset_at``.  Events
    are cut into range partitions by key and time, so that a block holds a bounded number of rows
    whatever the key or the burst.  Where a key lies in several blocks, each says what it makes of
    the window open before it, one row a block is chained, and every block is then scanned alone.
    """
    width = window_seconds * 1_000_000
    kind = dict(events.dtypes)
    e = events.select("key", "event_id", micros("ts").alias("us"))
    e = stored(e.repartitionByRange("key", "us", "event_id").withColumn("block", F.spark_partition_id()))
    # A boundary between blocks cuts one key at most: the keys and rows below are bounded by the blocks.
    spread = e.groupBy("key").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select(F.col("key").alias("cut"))
    parts = e.join(F.broadcast(spread), F.col("key").eqNullSafe(F.col("cut"))).select("key", "block", "us")
    steps = parts.groupBy("key", "block").applyInPandas(
        _block_steps(width), f"key {kind['key']}, block int, n bigint, entry array<bigint>, start array<bigint>, count array<bigint>")
    carried = steps.repartition("key").sortWithinPartitions("key", "block").mapInPandas(
        _chain(width), f"key {kind['key']}, block int, open_start bigint, open_count bigint")
    carried = carried.select(F.col("key").alias("cut"), F.col("block").alias("cut_block"), "open_start", "open_count")
    placed = e.join(F.broadcast(carried), F.col("key").eqNullSafe(F.col("cut")) & (F.col("block") == F.col("cut_block")), "left")
    placed = placed.select("key", "event_id", "us", "block", "open_start", "open_count")
    ordered = placed.repartition("key", "block").sortWithinPartitions("key", "block", "us", "event_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, start, count = None, None, 0
        for pdf in batches:
            us = pdf["us"].to_numpy()
            starts, counts = np.empty_like(us), np.empty_like(us)
            for lo, hi in _runs(pdf, ["key", "block"]):
                run = (pdf["key"].iat[lo], pdf["block"].iat[lo])
                if run != owner:
                    held = pdf["open_start"].iat[lo]
                    owner, start, count = (run, None, 0) if pd.isna(held) else (run, int(held), int(pdf["open_count"].iat[lo]))
                at = lo
                while at < hi:
                    end = at if start is None else at + int(np.searchsorted(us[at:hi], start + width))
                    if end == at:
                        start, count = int(us[at]), 0
                        end = at + int(np.searchsorted(us[at:hi], start + width))
                    starts[at:end], counts[at:end] = start, count + np.arange(1, end - at + 1)
                    count, at = count + end - at, end
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "us": us,
                                "window_count": counts, "reset_us": starts + width})

    schema = f"key {kind['key']}, event_id {kind['event_id']}, us bigint, window_count bigint, reset_us bigint"
    out = ordered.mapInPandas(scan, schema)
    return out.select(
        "key", "event_id", F.timestamp_micros("us").alias("ts"), "window_count",
        (F.col("window_count") <= limit).alias("allowed"),
        F.greatest(F.lit(limit) - F.col("window_count"), F.lit(0)).alias("remaining"),
        F.timestamp_micros("reset_us").alias("reset_at"),
    )


# --- dashboard -------------------------------------------------------------


def admin_summary(events: DataFrame, clients: DataFrame, codes: DataFrame, at: Column) -> DataFrame:
    """Five dashboard numbers; each side is reduced to one row before they meet."""
    day, month = F.date_trunc("day", at), F.date_trunc("month", at)
    ok, recent = F.col("status") == "success", F.col("created_at") >= month
    e = events.where(recent).agg(
        F.count_if(ok & (F.col("created_at") >= day)).alias("usage_today"),
        F.count_if(ok).alias("usage_month"), F.count_if(F.col("status") == "error").alias("errors_month"),
    )
    c = clients.agg(F.count_if(F.col("client_status") == "active").alias("active_clients"))
    k = codes.agg(F.count_if(F.col("code_status") == "active").alias("active_codes"))
    one = lambda df: df.withColumn("_1", F.lit(1))
    return one(c).join(one(k), "_1").join(one(e), "_1").drop("_1")


def client_month_usage(clients: DataFrame, plans: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """Every client with its plan (if any) and its successes this month."""
    used = (
        events.where((F.col("status") == "success") & (F.col("created_at") >= F.date_trunc("month", at)))
        .groupBy("client_id").agg(F.count("*").alias("month_usage"))
    )
    return clients.join(plans, "plan_name", "left").join(used, "client_id", "left").fillna(0, ["month_usage"])


def last_used(events: DataFrame) -> DataFrame:
    return events.groupBy("code_id").agg(F.max("created_at").alias("last_used_at"))


def recent(df: DataFrame, at: str = "created_at", tie: str = "event_id", n: int = 50) -> DataFrame:
    """Newest rows; a top-k, not a full sort."""
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n)


def clients_by_date(clients: DataFrame, at: str = "client_id") -> DataFrame:
    """Clients, the newest first."""
    return clients.orderBy(F.desc(at))


def plans_by_limit(plans: DataFrame) -> DataFrame:
    return plans.where("is_active").orderBy("daily_limit", "plan_name")


# --- correction examples ---------------------------------------------------


def top_examples(examples: DataFrame, k: int = 3) -> DataFrame:
    """Newest k examples per profile; only k rows per profile and task are shuffled."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    w = Window.partitionBy("profile_code").orderBy(F.desc("created_at"), F.desc("example_id"))
    return examples.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def format_examples(examples: DataFrame, k: int = 3) -> DataFrame:
    """One numbered text block per profile from its newest examples."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    top = top_examples(examples, k).where((text("corrected_csv") != "") | (text("original_csv") != "") | (text("notes") != ""))
    part = lambda label, c, n: F.when(text(c) != "", F.concat(F.lit(label), truncate_example(c, n)))
    parts = F.struct("rank", F.concat_ws(
        "\n", part("Notas: ", "notes", 700), part("Salida original resumida:\n", "original_csv", 2000),
        part("Salida corregida esperada:\n", "corrected_csv", 3000)).alias("body"))
    blocks = F.transform(
        F.sort_array(F.collect_list(parts)),
        lambda x, i: F.concat(F.lit("Ejemplo corregido "), (i + 1).cast("string"), F.lit(":\n"), x["body"]),
    )
    return top.groupBy("profile_code").agg(F.array_join(blocks, "\n\n").alias("examples"))


def correction_examples_for(docs: DataFrame, examples: DataFrame, k: int = 3) -> DataFrame:
    """Documents with the example block of their profile (left join on a few profile rows)."""
    blocks = format_examples(examples, k).withColumnRenamed("profile_code", "profile_id")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    # One row a profile: repeated for each salt, so that a common profile is spread over as many tasks.
    blocks = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("_salt", salt).join(blocks, ["profile_id", "_salt"], "left").drop("_salt")
