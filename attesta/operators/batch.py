"""Summaries and reports of checked claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import vocab
from attesta.sources.shared import new_folder


def counters() -> list[Column]:
    """OP-90, OP-91: overlapping counts by verdict, status and operational failure."""
    tests = {
        "accept": F.col("verdict") == "ACCEPT", "warn": F.col("verdict") == "WARN", "reject": F.col("verdict") == "REJECT",
        "partial": F.col("status") == "PARTIAL", "unverifiable": F.col("status") == "UNVERIFIABLE",
        "failed": (F.col("verdict") == "ERROR") | F.col("error_code").isin(*vocab.FAILED_CODES),
    }
    return [F.count("*").alias("total"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()]]


def summarize(results: DataFrame) -> DataFrame:
    return results.agg(*counters())


def report_rows(results: DataFrame) -> DataFrame:
    """row_number and the text block of each result (OP-23); sort by row_number at the sink."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    name = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("row-"), F.col("row_number").cast("string")))
    head = F.concat_ws("  ", F.coalesce("verdict", F.lit("WARN")), name, "doi")
    block = F.concat_ws("\n", F.lit(""), head, F.concat(F.lit("Claim: "), "claim"), F.concat(F.lit("Reason: "), F.coalesce("reason", F.lit(""))), line("Evidence: ", "evidence"), line("Error code: ", "error_code"))
    return results.select("row_number", block.alias("block"))


def summary_line(summary: DataFrame) -> DataFrame:
    names = ("total", "accept", "warn", "reject", "partial", "unverifiable", "failed")
    return summary.select(F.concat(F.lit("Summary: "), F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])).alias("line"))


def result_json(results: DataFrame, *others: str) -> DataFrame:
    """row_number, other columns and each result as JSON: nulls are kept, but a note only where there is one (OP-24)."""
    fields = ("abstract_source", "claim", "doi", "error_code", "evidence", "id", "paper", "reason", "row_number", "source_attempts", "status", "verdict")
    named = results.withColumnsRenamed({"record": "paper", "attempts": "source_attempts"})
    options = {"ignoreNullFields": "false"}
    with_note = sorted([*fields, "note"])
    return named.select("row_number", *others, F.when(F.col("note").isNotNull(), F.to_json(F.struct(*with_note), options)).otherwise(F.to_json(F.struct(*fields), options)).alias("json"))


def write_document(results: DataFrame, path: str) -> None:
    """The summary and all results as one JSON document: text files below path, whose lines in the order of the files' names make it (OP-24, OP-107).

    Rows are dealt and sorted by row_number, over range partitions; no task and no driver holds them
    all. row_number must be unique. Without results the document has an empty list. Results are computed
    once: their rows are kept in the shared folder, and bounds, ranges and summary are taken from there.
    """
    rendered = new_folder(results.sparkSession, "results")
    result_json(results, "verdict", "status", "error_code").write.parquet(rendered)
    results = rows = results.sparkSession.read.parquet(rendered)
    first, last = results.agg(F.min("row_number"), F.max("row_number")).first()
    first, last = first or 0, last or 0
    line = F.when(F.col("row_number") > first, F.concat(F.lit(", "), F.col("json"))).otherwise(F.col("json"))
    body = rows.select(F.col("row_number").alias("place"), line.alias("value"))
    counts = summarize(results).select(F.to_json(F.struct("*")).alias("s"))
    ends = F.explode(F.array(
        F.struct(F.lit(first - 1).alias("place"), F.lit('{"results": [').alias("value")),
        F.struct(F.lit(last + 1).alias("place"), F.concat(F.lit('], "summary": '), F.col("s"), F.lit("}")).alias("value")),
    ))
    whole = body.unionByName(counts.select(ends.alias("e")).select(F.col("e.place").cast("long").alias("place"), "e.value"))
    whole.repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)


def exit_code(summary: DataFrame) -> int:
    """OP-25: 0 if every claim is accepted, else 2."""
    row = summary.first()
    return 0 if row["total"] == row["accept"] else 2


def gate(results: DataFrame, labels: DataFrame) -> DataFrame:
    """safety_failures, pending and checked of a labelled run (OP-94).

    labels: id, must_accept, must_not_accept. An accepted claim that must not be is a safety failure;
    one that must be and is not yet is pending.
    """
    joined = labels.join(results.select("id", "verdict"), "id", "left")
    accepted = F.coalesce(F.col("verdict") == "ACCEPT", F.lit(False))
    return joined.agg(F.count("*").alias("checked"), F.count_if(F.col("must_not_accept") & accepted).alias("safety_failures"), F.count_if(F.col("must_accept") & ~accepted).alias("pending"))
