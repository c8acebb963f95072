"""What several operators share: cutting lineage, skew-safe lookups and global ranks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder: a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def skew_lookup(fact: DataFrame, dim: DataFrame, key: str, rows: str, small: int = 10_000, share: int = 1000, how: str = "left") -> DataFrame:
    """fact joined with dim, by a left or an inner join, one row per key, where a few keys may hold most of fact.

    dim[rows] counts fact's rows of each key. A dim of at most `small` rows is broadcast. Of a
    larger one only the keys with at least 1/share of fact's rows are broadcast, at most `share`
    of them whatever the size; the other keys join by a shuffle, where none of them is hot.
    """
    n, total = dim.agg(F.count("*"), F.sum(rows)).first()
    if n <= small:
        return fact.join(F.broadcast(dim.drop(rows)), key, how)
    hot = F.broadcast(dim.where(F.col(rows) * share >= total).drop(rows))
    warm = fact.join(hot, key)
    rest = fact.join(hot.select(key), key, "left_anti").join(dim.where(F.col(rows) * share < total).drop(rows), key, how)
    return warm.unionByName(rest)


def globally_ranked(df: DataFrame, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """df with a gapless rank from 0 over all rows by `order`, without one task that sees them all; the column total counts them.

    Rows are range-partitioned and sorted, written once with their place, and each partition's
    start is the number of rows before it; the driver sees one number per partition. Rows that
    tie on all of `order` are told apart by where they were read, so many equal rows do not meet
    in one task.
    """
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(width(df), *order, F.col("_tie")).sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    if total:
        placed = placed.withColumn(total, F.lit(at).cast("long"))
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at")
    table = placed.sparkSession.createDataFrame(starts, "_p int, _start long")
    return placed.withColumn("_p", part.cast("int")).join(F.broadcast(table), "_p").withColumn(name, row + F.col("_start")).drop("_at", "_p", "_start")
