"""A corpus from raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import langid, mixing, neardup, packing, secretscan
from attesta.llm.common import cut, shared_dir
from attesta.llm.queries import tokenizer_path

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if language ID is at least so sure of its language.
LEAST_SCORE = 0.1
MARK = "[SECRET]"
#: Bytes of text that a worker gets at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of BATCH_BYTES, not of so many rows, whatever their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the labelled ones teach, go. A missing lang becomes the predicted one.

    A null or empty text has no letters. Repeated rows stay or go together; an empty table stays
    empty; without any lang to learn from all documents go. Columns other than COLUMNS are left out.
    """
    small_batches(spark)
    found = langid.detect(docs, langid.fit(docs), [c for c in COLUMNS if c != "doc_id"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least doc_id stays.

    Documents without a word are classes of their own and stay. Rows that share a doc_id, or have
    none, stay if one of them does.
    """
    small_batches(spark)
    classes = neardup.jaccard_join(docs)
    kept = cut(classes.where("doc_id <=> class_id").select("doc_id").distinct())
    named = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    # rows without an id do not meet in a join: all stay or none
    return named if kept.where("doc_id is null").isEmpty() else named.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; all documents stay, those with null or empty texts as they are."""
    small_batches(spark)
    found = secretscan.scan(docs, secretscan.fit(docs), redact=MARK, keep=("lang", "source", "n_chars"))
    changed = F.col("spans") != ""
    chars = F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", chars.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all to three times.

    Null sources are one source. A document without a word adds nothing to the mix, and is taken as
    its hash says.
    """
    mixed = mixing.mix(docs)
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null or empty text is its end mark alone, repeated rows are packed as often."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packed)]

#: Models, MinHash and a tokenizer are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written to the shared folder and read again.

    The folder stays until its owner clears the shared folder: the result is lazy and reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
