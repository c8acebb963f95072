"""Claim files: JSON lines and CSV."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.sources.csvrecords import headed_records

FIELDS = ("id", "doi", "claim", "source", "note")


class ClaimFileError(ValueError):
    """The input cannot be used; nothing of it is checked."""


def detect_format(path: str, explicit: str | None = None) -> str:
    """OP-01: an explicit format wins, then the suffix."""
    if explicit is not None:
        if explicit not in ("jsonl", "csv"):
            raise ClaimFileError(f"Unsupported input format: {explicit}")
        return explicit
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (".jsonl", ".csv"):
        raise ClaimFileError("Unsupported input format; use .jsonl, .csv, or --format")
    return suffix[1:]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1, as in the file) and value of each line of a text file, read in splits.

    Lines are numbered within their split and shifted by the lines of earlier splits; the driver sees
    a count for each split. Of several files, in the order of their paths, the numbers go on.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("at"))
    splits = sorted(lines.groupBy("file", "block").agg(F.min("at"), F.count("*")).collect())
    starts, before = [], 0
    for file, block, first, n in splits:
        starts.append((file, block, before + 1 - first))
        before += n
    if not starts:
        return spark.createDataFrame([], "line long, value string")
    shift = spark.createDataFrame(starts, "file string, block long, shift long")
    return lines.join(F.broadcast(shift), ["file", "block"]).select((F.col("at") + F.col("shift")).alias("line"), "value")


def trimmed(rows: DataFrame, values: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_number, `keep` and FIELDS: the trimmed texts of an array, in its order, blank ones as null.

    A lambda trims them: five copies of it in one method are too much code for the JVM to compile.
    """
    told = rows.select("row_number", *keep, F.transform(values, tx.strip_column).alias("_values"))
    return told.select("row_number", *keep, *[F.nullif(F.get("_values", F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(FIELDS)])


def parse_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """row_number, the fields and error of each line that is not blank (OP-02).

    doi and claim are strings; other fields become text (OP-04): true and false as True and False; blank
    as null. Columns build on columns: the fields are taken out of their line together, and each has its
    kind and text found once.
    """
    lines = numbered_lines(spark, path).select(F.col("line").alias("row_number"), tx.strip_column(F.col("value")).alias("value")).where("value != ''")
    parsed = lines.select("row_number", F.try_parse_json("value").alias("v"))
    parsed = parsed.select("row_number", "v", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("_object"))
    parts = F.try_variant_get("v", "$", f"struct<{', '.join(f'{f}: variant' for f in FIELDS)}>")
    taken = parsed.select("row_number", F.col("v").isNotNull().alias("_json"), "_object", F.when(F.col("_object"), parts).alias("_parts"))
    kinds = [F.schema_of_variant(f"_parts.{f}").alias(f"_{f}") for f in FIELDS]
    texts = [F.try_variant_get(f"_parts.{f}", "$", "string").alias(f) for f in FIELDS]
    said = taken.select("row_number", "_json", "_object", *kinds, *texts)
    value = lambda f: F.when(F.col(f"_{f}") == "STRING", F.col(f))
    other = lambda f: value(f).when(F.col(f"_{f}") == "BOOLEAN", F.initcap(f)).when(F.col(f"_{f}") != "VOID", F.col(f))
    rows = trimmed(said, F.array(*[value(f) if f in ("doi", "claim") else other(f) for f in FIELDS]), ("_json", "_object"))
    at = F.col("row_number").cast("string")
    broken = F.when(~F.col("_json"), F.concat(F.lit("Invalid JSON on line "), at)).when(~F.col("_object"), F.concat(F.lit("Invalid row on line "), at, F.lit(": expected object")))
    return validated(rows, broken).drop("_json", "_object")


def parse_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_number (from 2, records and not lines), the fields and error of each record (OP-03), read in splits."""
    records, first = headed_records(spark, path)
    heads = {file: [n.lstrip("\ufeff").strip() for n in values] for file, values in first.items()}
    if not any(heads.values()):
        raise ClaimFileError("CSV input is missing a header row")
    for names in heads.values():
        if missing := sorted({"doi", "claim"} - set(names)):
            raise ClaimFileError(f"CSV header must include doi and claim fields; missing: {', '.join(missing)}")
    # of columns with one name the last counts
    places = {file: [len(names) - 1 - names[::-1].index(f) if f in names else None for f in FIELDS] for file, names in heads.items()}
    rows, one = records.where("record > 0"), next(iter(places.values()))
    if all(p == one for p in places.values()):
        at = dict(zip(FIELDS, [F.lit(p).cast("int") for p in one], strict=True))
    else:
        table = spark.createDataFrame([(file, *p) for file, p in places.items()], "file string, " + ", ".join(f"_{f} int" for f in FIELDS))
        rows, at = rows.join(F.broadcast(table), "file"), {f: F.col(f"_{f}") for f in FIELDS}
    return validated(trimmed(rows, F.array(*[F.get("values", at[f]) for f in FIELDS])), F.lit(None).cast("string"))


def validated(rows: DataFrame, broken: Column) -> DataFrame:
    at = F.col("row_number").cast("string")
    out = rows.withColumn("source", F.coalesce("source", F.lit("auto")))
    missing = lambda f: F.when(F.col(f).isNull(), F.concat(F.lit("Missing required field on line "), at, F.lit(f": {f}")))
    source = F.when(~F.col("source").isin(*vocab.SOURCES), F.concat(F.lit("Invalid field on line "), at, F.lit(": source="), "source"))
    return out.withColumn("error", F.coalesce(broken, missing("doi"), missing("claim"), source))


def read_claims(spark: SparkSession, path: str, explicit: str | None = None, strict: bool = True) -> DataFrame:
    """The claims of a file. Strict reading raises the first error by line, or one for an empty file; otherwise error is a column."""
    rows = (parse_jsonl if detect_format(path, explicit) == "jsonl" else parse_csv)(spark, path)
    if not strict:
        return rows
    n, first = rows.agg(F.count("*"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row_number")))).first()
    if first:
        raise ClaimFileError(first)
    if not n:
        raise ClaimFileError("Input file does not contain any claim rows")
    return rows.drop("error")
