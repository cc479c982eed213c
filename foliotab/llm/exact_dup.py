"""Exact copies by distributed radix partitioning from the first byte on.

Texts are equal when they agree after every run of white space has become one space. Their UTF-8 bytes are
cut at ``EDGES``. The first digit of a text is its number of bytes with its first piece, each further digit
the next piece: a round splits every open group by one digit. A group is finished when it has one row or
when its texts have ended; only open groups go on, and a round reads one piece of their texts and nothing
else. Pieces grow sixteenfold, so that the longest text takes eight rounds. Bytes are compared as they are;
no digest decides.

Of each piece only rows that a bitmap of the open ones lets pass are joined with them.

A round groups in two steps: rows are first grouped within salts of their number, one for each shuffle
partition, then one row for each of these groups; so a group that holds a third of all rows is shared
by all tasks, and row numbers come back to rows by a join on the small groups.

Defined cases: a null text is an empty one; of rows with one id and equal texts one stays; a row
without an id stays only where no row of its group has one, and keep_id is then null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import probably, stored

#: Bytes at which texts are cut.
EDGES = (0, 1 << 6, 1 << 10, 1 << 14, 1 << 18, 1 << 22, 1 << 26, 1 << 30, (1 << 31) - 1)


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, n_bytes, sha256 and one piece of bytes for each round (null where the text has ended)."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                        one_space(F.col(text_col)).cast("binary").alias("data"))
    texts = texts.withColumn("n_bytes", F.octet_length("data"))
    pieces = [F.when(F.col("n_bytes") > lo, F.substring("data", lo + 1, hi - lo)).alias(f"piece_{k}")
              for k, (lo, hi) in enumerate(zip(EDGES, EDGES[1:]))]
    return stored(texts.select("row", "id", "n_bytes", F.unhex(F.sha2("data", 256)).alias("sha256"), *pieces))


def _split(rows: DataFrame) -> DataFrame:
    """row, n_bytes, group, first (isnull(id), id, row) and n of the groups of (group, n_bytes, piece)."""
    salts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(int(salts))))
    small = Window.partitionBy("group", "n_bytes", "piece", "salt")
    near = salted.withColumns({"first": F.min("who").over(small), "n": F.count("*").over(small)})
    leads = F.col("who") == F.col("first")
    near = stored(near.select("row", "n_bytes", "group", F.col("first")["row"].alias("lead"), F.when(leads, F.col("piece")).alias("piece"),
                              F.when(leads, F.col("first")).alias("first"), F.when(leads, F.col("n")).alias("n")))
    whole = near.where("first is not null").groupBy("group", "n_bytes", "piece").agg(
        F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("lead").alias("leads"))
    seats = whole.select(F.explode("leads").alias("lead"), F.col("first")["row"].alias("group"), "first", "n")
    return near.select("row", "n_bytes", "lead").join(seats, "lead").select("row", "n_bytes", "group", "first", "n")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id (id of the row that stays), group_size, kept and text_sha256 of every row."""
    digits = _digits(docs, id_col, text_col)
    who = F.struct(F.col("id").isNull().alias("no_id"), "id", "row").alias("who")
    finished, open_ = [], None
    for k, end in enumerate(EDGES[1:]):
        piece = digits.select("row", who, "n_bytes", F.col(f"piece_{k}").alias("piece"))
        if open_ is None:
            rows = piece.withColumn("group", F.lit(0).cast("long"))
        else:
            likely, mark = probably(piece.where("piece is not null"), "row", open_.select(F.col("row").alias("id")))
            rows = likely.where(F.col(mark)).drop(mark).join(open_, "row")
        found = stored(_split(rows))
        finished.append(found.where((F.col("n") == 1) | (F.col("n_bytes") <= end)))
        open_ = stored(found.where((F.col("n") > 1) & (F.col("n_bytes") > end)).select("row", "group"))
        if open_.isEmpty():
            break
    seats = reduce(DataFrame.unionByName, finished).select("row", "first", "n")
    return digits.select("row", "id", "sha256").join(seats, "row").select(
        F.col("id").alias("doc_id"), F.col("first")["id"].alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("first")["row"] == F.col("row")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


#: The same result for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
