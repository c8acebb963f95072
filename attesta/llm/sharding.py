"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import cut, globally_ranked, skew_lookup, width

#: Columns that sharding makes or reads, and those whose ranges a shard keeps.
MADE, RANGED = ("doc_id", "lang", "source", "size", "text_crc32", "curve", "law", "shard", "slot", "grown_shard"), ("lang", "source", "size")


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of points (rows x dimensions, values below 2**bits).

    Bits are treated from the top: inverting or exchanging the lower bits of the first dimension
    turns the curve's cell, a Gray code orders the cells; the result interleaves the dimensions' bits.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def hilbert(dims: list[Column], bits: int) -> Column:
    """The curve index of integer columns below 2**bits; null counts as 0."""

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(dtype=np.int64) for c in cols], axis=1), bits))

    return index(*[F.coalesce(d.cast("long"), F.lit(0).cast("long")) for d in dims])


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def length_cell(octets: Column) -> Column:
    """A cell of a logarithmic scale, sixteen to each doubling of octets + 1, in whole numbers."""
    x = octets.cast("long") + 1
    e = F.length(F.bin(x)) - 1
    return (e * 16 + F.call_function("shiftright", x * 16, e.cast("int")) - 16).cast("long")


def name_cells(slim: DataFrame, name: str, bits: int) -> DataFrame:
    """slim with the cell of each value of `name`: its rank among the different values, null first, spread over 2**bits cells."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(name)), F.lit("n"))
    keyed = slim.withColumn("_key", key)
    kinds = globally_ranked(keyed.groupBy("_key").agg(F.count("*").alias("_rows")), [F.col("_key")], "_place", "_kinds")
    cells = kinds.select("_key", "_rows", F.expr(f"shiftleft(_place, {bits}) div greatest(_kinds, 1L)").alias(f"_{name}"))
    return skew_lookup(keyed, cells, "_key", "_rows").drop("_key")


def one_cell_a_text(placed: DataFrame, names: Sequence[str]) -> DataFrame:
    """placed, where rows of equal texts (_text) have the least of their cells of each name: their group is a run of the curve."""
    least = placed.groupBy("_text").agg(*[F.min(n).alias(f"_least{n}") for n in names], F.count("*").alias("_rows")).where("_rows > 1")
    found = skew_lookup(placed, cut(least), "_text", "_rows")
    return found.withColumns({n: F.coalesce(f"_least{n}", n) for n in names}).drop(*[f"_least{n}" for n in names])


def shard(docs: DataFrame, shards: int = 40, bits: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, curve, law, shard, slot and grown_shard of every row of docs, and the columns `keep`.

    Language, source and text length are quantised to 2**bits cells each: names by their rank among
    all different ones, lengths by logarithm between the least and the greatest. Rows are sorted by
    the cell's place on the Hilbert curve, then text_crc32, then the text's MD5, then doc_id, and cut into runs whose row
    counts differ by one at most (law 'rows'). Rows near each other in all dimensions thus share a
    shard, whose least and greatest value of each dimension prune files (see `write`). Equal texts,
    null and empty ones too, all count as of the first language and source of their group, so they are
    one run: in one shard, or where a shard ends within the run, or it is longer than a shard, in
    shards next to each other. Texts are told apart by their MD5. Unless `keep` names more, only
    these slim columns are sorted, over range partitions; the texts stay where they are.

    size: bytes of the UTF-8 text (null: 0) plus 16. text_crc32: of the same bytes, unsigned.
    slot: place in the shard, from 0 without gaps. grown_shard: null under this law. Rows that
    repeat get slots of their own. An empty table gives an empty result. Other columns are ignored.
    """
    octets = F.coalesce(F.octet_length("text"), F.lit(0))
    keep = [c for c in keep if c not in MADE]
    made = [byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), length_cell(octets).alias("_length"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text")]
    slim = cut(docs.select("doc_id", "lang", "source", *made, *keep))
    low, high = slim.agg(F.min("_length"), F.max("_length")).first()
    length = F.lit(0) if low is None else F.expr(f"shiftleft(_length - {low}, {bits}) div {high - low + 1}")
    celled = one_cell_a_text(name_cells(name_cells(slim, "lang", bits), "source", bits), ["_lang", "_source"])
    placed = celled.withColumn("curve", hilbert([F.col("_lang"), F.col("_source"), length], bits)).drop("_lang", "_source", "_length")
    ranked = globally_ranked(placed, [F.col("curve"), F.col("text_crc32"), F.col("_text"), F.col("doc_id")], "_rank", "_rows").drop("_text")
    first = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    out = ranked.withColumn("shard", F.expr(f"_rank * {shards} div greatest(_rows, 1L)").cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")).drop("_rank", "_rows")


def write(docs: DataFrame, path: str, shards: int = 40, bits: int = 10) -> None:
    """docs, with shard and slot, as Parquet files below path/data, a folder for each shard, in the order of slots; and path/ranges.

    ranges has a row for each shard: rows, and the least and greatest lang, source and size in it.
    Columns of docs that `shard` makes are replaced. A large shard is several files, each a run of slots.
    """
    placed = cut(shard(docs, shards, bits, [c for c in docs.columns if c not in ("doc_id", "lang", "source")]))
    files = placed.repartitionByRange(max(shards, width(docs)), "shard", "slot").sortWithinPartitions("shard", "slot")
    files.write.partitionBy("shard").parquet(f"{path}/data")
    ends = [f(c).alias(f"{n}_{c}") for c in RANGED for n, f in (("least", F.min), ("most", F.max))]
    placed.groupBy("shard").agg(F.count("*").alias("rows"), *ends).coalesce(1).write.parquet(f"{path}/ranges")


def read(spark: SparkSession, path: str, bounds: Mapping[str, tuple]) -> DataFrame:
    """The rows written below path whose lang, source or size lie within bounds, name: (least, most).

    Shards whose ranges do not meet the bounds are not read; the driver gets a number for each shard that is.
    """
    ranges = spark.read.parquet(f"{path}/ranges")
    data = spark.read.parquet(f"{path}/data")
    for name, (least, most) in bounds.items():
        ranges = ranges.where((F.col(f"least_{name}") <= most) & (F.col(f"most_{name}") >= least))
        data = data.where(F.col(name).between(least, most))
    return data.where(F.col("shard").isin([r["shard"] for r in ranges.select("shard").collect()]))
