"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.common import WORD, cut, globally_ranked, skew_lookup

#: Bits of the hash, and of each level of the histogram.
HASH_BITS, LEVEL_BITS = 60, 12
#: Columns that a mix makes.
MADE = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(by_source: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """by_source (source, source_size, ...) with the column target.

    Sources by code point, null last, get the weights in turn and share all sizes by them. What a
    source would get above cap times its size goes to the others by weight, until none is above.
    That fixed point is min(cap * size, level * weight) for one level, found from sums alone.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    table = cut(globally_ranked(by_source, [F.col("source").asc_nulls_last()], "_place").withColumn("_weight", weight).drop("_place"))
    most = F.col("source_size") * float(cap)
    level, before = 0.0, -1
    while True:
        full = most <= F.lit(level) * F.col("_weight")
        total, held, free, n = table.agg(F.sum("source_size"), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("_weight"))), F.count(F.when(full, 1))).first()
        if n == before or not free:
            break
        level, before = (total - (held or 0.0)) / free, n
    return table.withColumn("target", F.least(most, F.lit(level) * F.col("_weight"))).drop("_weight")


def hashed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size, _key (of the source) and _h, the first HASH_BITS bits of an MD5 of seed and doc_id, or of the text's MD5 where the id is null."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col("text"), F.lit("")))))))
    h = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.drop(*MADE, "_key", "_h", "_base", "_threshold").withColumns({"_key": key, "_h": h, "size": word_count(F.col("text"))})


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    copies = F.col("_base") + F.when(F.col("_h") < F.col("_threshold"), 1).otherwise(0)
    out = skew_lookup(rows, plan, "_key", "_rows").withColumn("copies", copies.cast("int"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("_key", "_h", "_base", "_threshold")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, source and others) with size, source_size, target, copies and taken.

    size is the text's number of words, source_size the sum over the document's source, target
    what the source should give (see `targets`), copies how often the mix takes the document and
    taken = copies * size. A source takes each document floor(target / source_size) times and once
    more if a hash of its doc_id lies below the source's threshold. The thresholds come from
    histograms of sizes over hash buckets: the bucket in which the budget runs out is split again,
    12 bits a level, until it holds one document. So nothing is sorted, each level reads what the
    last left open, and reruns agree. The last document is in if that brings the sum nearer.

    Null or empty text: size 0, taken 0. Null sources are one source. Rows with the same doc_id and
    source are in or out together, those without a doc_id if their texts are equal. A text of any
    length is counted whole. An empty table gives an empty result. Columns of docs other than
    those made here pass through; of a clash, the made column stays.
    """
    full = hashed(docs, seed)
    return taken(full, thresholds(cut(full.select("_key", "_h", "size")), weights, cap))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3, seed: int = 17) -> DataFrame:
    """The same with doc_id and source only of docs' columns; each text is read and counted once."""
    slim = cut(hashed(docs.select("doc_id", "text", "source"), seed).drop("text"))
    return taken(slim, thresholds(slim, weights, cap))


def thresholds(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row per _key: _rows, source_size, target, _base (copies of every document) and _threshold."""
    named = sized.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    named = named.withColumn("source", F.when(F.col("_key") != "n", F.expr("substring(_key, 2)")))
    base = F.least(F.lit(int(cap)), F.floor(F.try_divide("target", "source_size"))).cast("long")
    plan = targets(named, weights, cap).withColumn("_base", F.coalesce(base, F.lit(0).cast("long"))).drop("source")
    want = F.when(F.col("_base") >= int(cap), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("_base") * F.col("source_size")))
    plan = cut(plan.withColumn("_want", want))

    state, inside, found = plan.select("_key", "_want"), sized, None
    shift = HASH_BITS
    while shift:
        shift -= LEVEL_BITS
        bucket = F.shiftright("_h", shift)
        hist = inside.groupBy("_key", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
        order = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 4096 rows a source
        run = hist.withColumn("_upto", F.sum("_size").over(order)).join(state, "_key")
        edge = run.where(F.col("_upto") > F.col("_want")).groupBy("_key").agg(F.min(F.struct("_bucket", "_upto", "_size", "_n", "_want")).alias("e")).select("_key", "e.*")
        edge = cut(edge.withColumn("_want", F.col("_want") - (F.col("_upto") - F.col("_size"))))
        ends = F.when(F.col("_want") * 2 >= F.col("_size"), F.col("_bucket") + 1).otherwise(F.col("_bucket"))
        done = edge.where(F.col("_n") == 1) if shift else edge
        found = done.select("_key", F.shiftleft(ends, shift).alias("_threshold")) if found is None else found.unionByName(done.select("_key", F.shiftleft(ends, shift).alias("_threshold")))
        edge = edge.where(F.col("_n") > 1)
        if not shift or edge.isEmpty():
            break
        # a bucket is at most a small part of its source, so no key of this join is hot but by equal doc_ids
        inside = inside.withColumn("_bucket", bucket).join(edge.select("_key", "_bucket"), ["_key", "_bucket"], "left_semi").drop("_bucket")
        state = edge.select("_key", "_want")
    none = F.when(F.col("_want") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))  # only where no bucket exceeds the budget
    return plan.join(found, "_key", "left").select("_key", "_rows", "source_size", "target", "_base", F.when(F.col("_base") >= int(cap), F.lit(0)).otherwise(F.coalesce("_threshold", none)).alias("_threshold"))
