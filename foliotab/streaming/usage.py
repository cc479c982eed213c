"""Continuous usage counts and idempotent ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return events.withColumn("created_at", F.col("created_at").cast("timestamp"))


def usage_dedupe_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated event ids seen within the watermark delay."""
    return _timed(events).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def usage_daily_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Successes and errors per code and day; the month comes with every day row."""
    counted = _timed(events)
    if events.isStreaming:
        counted = counted.withWatermark("created_at", delay)
    daily = counted.groupBy(F.window("created_at", "1 day").alias("w"), "code_id").agg(
        F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    return daily.select(
        "code_id", F.col("w.start").alias("day"), F.date_trunc("month", "w.start").alias("month"), "successes", "errors"
    )


_MONTHS = "code_id string, month timestamp, successes bigint, errors bigint"


class MonthSums(StatefulProcessor):
    """State per code and month: sums of its closed days, until the watermark passes the month."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "successes bigint, errors bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        successes, errors = self.sums.get() or (0, 0)
        for pdf in rows:
            successes, errors = successes + int(pdf["successes"].sum()), errors + int(pdf["errors"].sum())
        self.sums.update((successes, errors))
        self.handle.registerTimer(int(key[2]))
        yield pd.DataFrame(columns=[c.split()[0] for c in _MONTHS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            successes, errors = self.sums.get()
            self.sums.clear()
            yield pd.DataFrame({"code_id": [key[0]], "month": [pd.Timestamp(key[1], unit="ms")], "successes": [successes], "errors": [errors]})

    def close(self) -> None:
        pass


def usage_monthly_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Successes and errors per code and month, summed from the closed days of ``usage_daily_stream``.

    Two stateful steps in one stream: a day goes on once the watermark has passed it, a month comes out once
    the watermark has passed its end. Needs the RocksDB state store. The code is text.
    """
    ms = lambda c: F.unix_millis(c)
    days = usage_daily_stream(events, delay).select(
        F.col("code_id").cast("string").alias("code_id"), ms(F.col("month")).alias("month_ms"),
        ms(F.add_months("month", 1).cast("timestamp")).alias("end_ms"), "successes", "errors")
    return days.groupBy("code_id", "month_ms", "end_ms").transformWithStateInPandas(
        statefulProcessor=MonthSums(), outputStructType=_MONTHS, outputMode="Append", timeMode="EventTime")


def append_batches(path: str):
    """A ``foreachBatch`` writer that adds each usage event once, laid out by day.

    What is there already is looked up by event id in the days of the batch alone; a batch that is replayed, whole
    or after it was written in part, adds only what is missing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("day", F.to_date("created_at")).dropDuplicates(["day", "event_id"])
        days = [r.day for r in rows.select("day").distinct().collect()]
        try:
            known = batch.sparkSession.read.parquet(path).where(F.col("day").isin(days)).select("day", "event_id")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            rows = rows.join(known, ["day", "event_id"], "left_anti")
        rows.select(*batch.columns, "day").write.mode("append").partitionBy("day").parquet(path)

    return write


def upsert_batches(path: str):
    """A ``foreachBatch`` writer for update mode: each batch holds the changed rows under its number.

    A replayed batch overwrites itself, so ``latest_rows`` sees every change once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key."""
    columns = [c for c in changes.columns if c != "batch_id"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_id").alias("_r"))
    return last.select("_r.*")
