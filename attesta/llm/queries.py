"""The operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import collocation, langid, licenses, mixing, mtree, neardup, packing, quality, secretscan, sharding, urlfilter, warc, whitening
from attesta.llm.common import shared_dir
from attesta.llm.oracle import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.detect(docs, langid.fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_key"), F.col("html").alias("payload"), "url")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.deduplicated(pages), path)
    back = warc.read(spark, path)
    # a response is checked against its payload; a revisit has only what its header says
    whole = F.col("record_type") == "response"
    size = F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(whole, F.col("computed_digest")).otherwise(F.col("payload_digest"))
    keys = [F.col(c).cast("long").alias(n) for c, n in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    return back.select(keys[0], size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", keys[1], "target_uri")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "lang", "source", "curve")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).withColumn("ratio", F.round("ratio", 6))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secretscan.scan(docs, secretscan.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("*", F.posexplode("whitened").alias("_place", "_whitened"))
    share = F.get("explained", F.col("_place"))
    return each.select("vec_id", (F.col("_place") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), F.col("_whitened").alias("whitened"), share.alias("explained"), "identity_error")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    start, names = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
        listed(names).alias("base_labels"), listed(F.concat(names, F.transform("blocks", lambda b: b["label"]))).alias("labels"), "score",
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_quality": op3_line_quality,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_secrets": op8_secrets,
    "op9_top_k": op9_top_k,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_licenses": op12_licenses,
    "op13_collocations": op13_collocations,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
