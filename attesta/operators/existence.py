"""Does a cited paper exist, whatever DOI was typed? Sources that know its title and first author are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators.metadata import same_name, tokens_of_name
from attesta.operators.resolve import spread


def named(df: DataFrame, title: Column, author: Column) -> DataFrame:
    """df with _key, which titles and authors that may match have in common, and _words of the author; _key is null where either is missing.

    Titles match by equal tokens and numbers (OP-111), so these are the key, with the author's last
    word, which matching names share whether of a person or a group (OP-77).
    """
    staged = df.withColumns({"_plain": tx.plain_title(title), "_name": tx.plain_fold(author), "_numbers": F.array_join(tx.numbers(title), " ")})
    staged = staged.withColumns({"_title": F.array_join(tx.title_tokens(F.col("_plain")), " "), "_words": tokens_of_name(F.col("_name"))})
    whole = (F.col("_title") != "") & (F.size("_words") > 0)
    key = F.when(whole, F.concat_ws("\n", "_title", "_numbers", F.try_element_at("_words", F.lit(-1))))
    return staged.withColumn("_key", key).drop("_plain", "_name", "_numbers", "_title")


def existence(citations: DataFrame, records: DataFrame, enough: int = 2) -> DataFrame:
    """citations (title, first_author and others) with sources, the names of those that know the paper, and existence.

    records: source_name and record (title, authors); DOIs are not looked at. CONFIRMED: `enough`
    sources agree on title and first author; SINGLE-SOURCE: fewer; NOT FOUND: none, also where a
    citation has no title or author. Each different title and author is looked up once; its records
    are first put together by what they are joined on, so a title that many have is one row a source.
    Citations that repeat stay as many; the most cited are dealt over several tasks.
    """
    kept = citations.columns
    known = named(records.where("record is not null").select("source_name", "record"), F.col("record.title"), F.get("record.authors", F.lit(0)))
    known = known.where("_key is not null").groupBy("_key", F.col("_words").alias("_theirs")).agg(F.collect_set("source_name").alias("_by"))
    cited = named(citations, F.col("title"), F.col("first_author"))
    cited = cited.withColumn("_id", F.coalesce(F.concat_ws("\n", "_key", F.array_join("_words", " ")), F.lit("")))
    asked = cited.groupBy("_id", "_key", "_words").agg(F.count("*").alias("_rows"))
    met = asked.join(known, "_key").where(same_name(F.col("_words"), F.col("_theirs")))
    found = met.groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_by")))).alias("sources"))
    looked_up = asked.select("_id").distinct().join(found, "_id", "left")
    counts = asked.groupBy("_id").agg(F.sum("_rows").alias("_rows"))
    out = spread(cited.select(*kept, "_id"), looked_up, counts, "_id", kept)
    out = out.withColumn("sources", F.coalesce("sources", F.expr("cast(array() as array<string>)")))
    n = F.size("sources")
    return out.drop("_id").withColumn("existence", F.when(n >= enough, "CONFIRMED").when(n > 0, "SINGLE-SOURCE").otherwise("NOT FOUND"))
