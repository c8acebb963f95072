"""A citation corpus with known answers, rendered from relational tables.

Papers come from part, claims from lineitem, citations from orders and customer. Texts hold integers
only, so that arithmetic on the columns says what each verdict must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How each comparator is written before a number.
WORDS = {"exact": "", "gt": "above ", "gte": "at least ", "lt": "below ", "lte": "at most ", "up_to": "up to "}
COMPARATORS = tuple(WORDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_place(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def text(template: str, *values: Column) -> Column:
    return F.concat(*[x for part, v in zip(template.split("{}"), [*values, None], strict=True) for x in ([F.lit(part)] + ([v.cast("string")] if v is not None else []))])


def paper_doi(key: Column) -> Column:
    return text("10.5555/part.{}", key)


def dirty_doi(key: Column, spelling: Column) -> Column:
    k, kinds = key.cast("string"), ("10.5555/part.{}", "https://doi.org/10.5555/PART.{}", "doi: 10.5555/part.{}.", "http://dx.doi.org/10.5555/part.{};", " 10.5555%2Fpart.{} ", "10.5555/part.{}),")
    out = F
    for i, kind in enumerate(kinds):
        out = out.when(spelling % len(kinds) == i, text(kind, k))
    return out


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, doi_norm, and the abstract's three observed values with their comparators."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("life"), (F.col("p_partkey") * 7 % 50 + 1).alias("first"), (F.col("p_partkey") * 11 % 50 + 1).alias("second"))
    kinds = {"life_cmp": F.col("key"), "first_cmp": F.col("key") / 6, "second_cmp": F.col("key") / 36}
    part = part.withColumns({n: by_place(F.floor(i), COMPARATORS) for n, i in kinds.items()})
    said = lambda n: F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), F.col(n))
    abstract = text("We studied {}. Device lifetime was {}{} cycles. Actuated strain was {}{}%. Later the actuated strain was {}{}%.", F.col("name"), said("life_cmp"), F.col("life"), said("first_cmp"), F.col("first"), said("second_cmp"), F.col("second"))
    return part.withColumn("doi_norm", paper_doi(F.col("key"))).withColumn("abstract", abstract)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_number, doi, claim and source; odd lines claim a lifetime, even ones a strain."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("threshold"))
    said = F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), by_place(F.col("l_orderkey"), COMPARATORS))
    strain = F.col("l_linenumber") % 2 == 0
    claim = F.when(strain, text("actuation strain {}{}%", said, F.col("threshold"))).otherwise(text("device lifetime {}{} cycles", said, F.col("threshold")))
    return line.select(
        "l_orderkey", "l_linenumber", "key", "threshold", by_place(F.col("l_orderkey"), COMPARATORS).alias("cmp"), strain.alias("strain"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"), F.lit(None).cast("string").alias("id"), dirty_doi(F.col("key"), F.col("l_orderkey") + F.col("l_linenumber")).alias("doi"), claim.alias("claim"), F.lit("auto").alias("source"), F.lit(None).cast("string").alias("note"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four sources say of each paper, with gaps and failures by the paper's key."""
    p = papers(spark, sf_dir)
    key = F.col("key")
    found = lambda source, doi, abstract: F.struct(doi.alias("doi"), F.col("name").alias("title"), F.array(F.lit("Lee")).alias("authors"), F.lit(2020).alias("year"), abstract.alias("abstract"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("journal"), F.lit(None).cast("string").alias("url"))
    none = F.lit(None).cast("string")
    row = lambda source, record, status=none: p.select(F.lit(source).alias("source_name"), "doi_norm", record.alias("record"), status.alias("error_status"), none.alias("error_reason"))
    own, other = F.col("doi_norm"), F.lit("10.5555/other")
    return (
        row("crossref", found("CrossRef", F.when(key % 23 == 0, other).otherwise(own), F.when(key % 4 == 0, F.col("abstract")))).where(F.col("doi_norm") != paper_doi(F.lit(7)))
        .unionByName(row("openalex", F.when(key % 4 == 1, found("OpenAlex", F.when(key % 5 == 0, other).otherwise(own), F.col("abstract"))), F.when(key % 4 == 3, "TIMEOUT")))
        .unionByName(row("semantic_scholar", F.when(key % 3 == 0, found("Semantic Scholar", own, F.col("abstract"))), F.when(key % 3 == 1, "API_ERROR")))
        .unionByName(row("pubmed", F.when(key % 7 == 0, found("PubMed", own, F.col("abstract")))))
    )
