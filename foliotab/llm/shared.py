"""Results that are read more than once, written once to the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliotab.operators.storage import shared_folder

BATCH_BYTES = 4 << 20
#: Bits of a filter for each wanted id, bits of one row of the filter, and most bits (64 MB).
BITS_EACH, ROW_BITS, MOST_BITS = 8, 1 << 15, 1 << 29


_held: list[str] | None = None


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back.

    Unlike ``checkpoint()``, which runs its last stage twice, this computes each row once.
    The files outlive any executor and bear a name of their own for each call. Those stored after
    one call of ``release`` are deleted by the next one, unless they are ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not lasting and _held is not None:
        _held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what was stored since the last call, for a pipeline that has written the results made of it."""
    global _held
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in _held or []:
        path = hadoop(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _held = []


def probably(rows: DataFrame, id_col: str, wanted: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a column that is false only where the id is not among ``wanted`` (id, stored), and its name.

    The wanted ids go into a bitmap that is broadcast to the scan, so that an exact join need shuffle few
    other rows. It has ``BITS_EACH`` bits for each id; with more than 67 million ids it stays at 64 MB and lets more
    other rows pass.
    """
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (BITS_EACH * wanted.count()).bit_length()))
    part, bit, bitmap, mark = (f"_{name}_{uuid.uuid4().hex}" for name in ("part", "bit", "map", "mark"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = wanted.select(F.floor(place("id") / ROW_BITS).alias(part), (place("id") % ROW_BITS).alias(bit)).groupBy(part).agg(
        F.bitmap_construct_agg(bit).alias(bitmap))
    placed = rows.withColumns({part: F.floor(place(id_col) / ROW_BITS), bit: place(id_col) % ROW_BITS})
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(F.col(bit) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} % 8 as int))")) != 0
    joined = placed.join(F.broadcast(maps), part, "left")
    return joined.withColumn(mark, F.coalesce(hit, F.lit(False))).drop(part, bit, bitmap), mark


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_BYTES``: the setting of the session is lowered if it is higher."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(key))) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded size, so that texts of any length need little memory."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
