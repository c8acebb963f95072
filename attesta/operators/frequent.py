"""Work on texts that is done once for each of the most frequent ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different texts whose columns are broadcast; other texts are worked on row by row.
MOST = 10_000


def by_text(rows: DataFrame, text: str, widen: Callable[[DataFrame], DataFrame], asked: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """widen(rows), where widen adds columns that depend on the column `text` alone.

    The columns of texts that repeat, of the most frequent `most`, are found once and broadcast; those
    of all other rows are found row by row. asked has the texts to count, if not rows.
    """
    counts = (rows if asked is None else asked).where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("_n"))
    made = widen(counts.where("_n > 1").orderBy(F.desc("_n"), text).limit(most).select(text))
    new = [c for c in made.columns if c != text]
    often = F.broadcast(made.select(F.col(text).alias("_often"), F.struct(*new).alias("_made")))
    met = rows.join(often, F.col(text) == F.col("_often"), "left").withColumn("_text", F.col(text))
    own = widen(met.withColumn(text, F.when(F.col("_often").isNull(), F.col(text))))
    known = F.col("_often").isNotNull()
    return own.select(*[F.col("_text").alias(c) if c == text else F.col(c) for c in rows.columns], *[F.when(known, F.col(f"_made.{c}")).otherwise(F.col(c)).alias(c) for c in new])
