"""Verdicts of a stream of claims, against a table of answers or a stream of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.functions.doi import normalize_doi
from attesta.operators.batch import counters
from attesta.operators.resolve import answers_by_doi, chosen_source, evident, judge_resolved, least_answers, resolve


def stream_verdicts(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdicts of a stream of (row_number, id, doi, claim, source, note, ...): a stream-static join and row-by-row work, so no state."""
    resolved = resolve(claims.withColumn("source", F.coalesce("source", F.lit("auto"))), answers_by_doi(answers))
    return judge_resolved(evident(resolved))


def joined_verdicts(claims: DataFrame, answers: DataFrame, at: str = "at", late: str = "10 minutes", wait: str = "1 hour", keep: str = "1 day", salts: int = 8) -> DataFrame:
    """Verdicts of a stream of claims (schemas.CLAIM) over a stream of answers (schemas.SOURCE_ANSWER), both with the event time `at`.

    A claim counts the answers to its DOI from `keep` before it to `wait` after it, and is decided once
    both streams' watermarks, each `late` behind its newest row, are past that; then its state goes, and
    an answer's once no claim can ask for it. It has the verdict that `check_claims` gives on these
    answers, those of none included: a claim that nobody answered in time is an error row.

    An interval join, outer on the side of claims, brings the answers; an aggregation takes the least of
    each source, whatever the order in which they come. The claims of one DOI are dealt over `salts`
    keys by their columns, and answers copied to each, so a much cited paper is not one task's state.
    Rows without a time have that of the batch that reads them, later ones than `late` may be lost, as
    in any stream, and claims that are equal in all columns are one. Output mode: append.
    """
    timed = lambda df: df.withColumn(at, F.coalesce(at, F.current_timestamp())).withWatermark(at, late)
    named = claims.columns
    asked = timed(claims).withColumns({"source": F.coalesce("source", F.lit("auto")), "doi_norm": normalize_doi(F.col("doi"))})
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in named if c != at]), F.lit(salts)).cast("int")).alias("c")
    answers, least = least_answers(timed(answers))
    told = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("a")
    times = F.expr(f"a.`{at}` BETWEEN c.`{at}` - INTERVAL '{keep}' AND c.`{at}` + INTERVAL '{wait}'")
    met = asked.join(told, F.expr("c.doi_norm <=> a.doi_norm AND c._salt = a._salt") & times, "left")
    of_answers = [F.col(f"a.{c}") for c in answers.columns if c not in ("doi_norm", at)]
    met = met.select(*[F.col(f"c.{c}") for c in (*named, "doi_norm")], *of_answers)
    return judge_resolved(evident(chosen_source(met.groupBy(*named, "doi_norm").agg(*least))))


def windowed_summary(verdicts: DataFrame, event_time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The batch counters by event-time window; rows later than `late` are dropped by the watermark."""
    return verdicts.withWatermark(event_time, late).groupBy(F.window(event_time, window).alias("window")).agg(*counters())


def write_verdicts(verdicts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
