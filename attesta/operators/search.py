"""Passages sought in all documents at once, by equi-joins on the words that few documents have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import text as tx
from attesta.sources.shared import dealt, kept

#: Rows of one join key that a task takes; the most frequent MOST_HOT keys with more are dealt over as many tasks as they ask for.
PER_TASK, MOST_HOT = 50_000, 1000


def spread_join(rows: DataFrame, few: DataFrame, counts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows joined with few on key; counts (key, n) has how many of rows have each.

    Rows of a frequent key are dealt by their columns `by`, and its rows in few repeated for each of its tasks.
    """
    hot = counts.where(F.col("n") > PER_TASK).orderBy(F.desc("n"), key).limit(MOST_HOT)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("n") / PER_TASK).cast("int").alias("_tasks")))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_tasks")), F.lit(0)).cast("int").alias("_salt")
    left = rows.join(hot, key, "left").select(*rows.columns, salt)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)).alias("_salt")
    right = few.join(hot, key, "left").select(*few.columns, copies)
    return left.join(right, [key, "_salt"]).drop("_salt")


#: Different phrases that are broadcast to the documents; the places of more are dealt by their words.
FEW_PHRASES = 5000


def phrase_places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and start of each place, in words from 0, where one of docs (doc_id, text) says the whole of one of items (item_id, text), word by word (OP-40, OP-58).

    Of a phrase's words the one with the fewest occurrences in all documents is its anchor, of equal
    ones the first in it. A phrase can stand only where its anchor does; there the whole phrase is
    compared. Places overlap where phrases do. Few phrases are compared where the documents are, of
    which nothing is shuffled but their texts, once; of many, an index of the anchors' places is joined
    with them and with the documents. Documents are dealt and split into words once, and their words
    kept in the shared folder.
    Phrases without words, or with one that no document has, are nowhere; rows without a doc_id are
    not looked through. Equal rows of docs or items are found each for itself.
    """
    texts = dealt(docs.where("doc_id is not null").select("doc_id", "text"))
    said = kept(texts.select("doc_id", tx.phrase_tokens(F.col("text")).alias("_words")), "words")
    wanted = items.select("item_id", tx.phrase_tokens(F.col("text")).alias("_phrase")).where(F.size("_phrase") > 0)
    phrases = wanted.select("_phrase").distinct()
    few = phrases.limit(FEW_PHRASES + 1).count() <= FEW_PHRASES
    each = phrases.select("_phrase", F.posexplode("_phrase").alias("_offset", "word"))
    asked = each.select("word").distinct()
    words = said.select(F.explode("_words").alias("word")).join(F.broadcast(asked) if few else asked, "word", "left_semi")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    anchors = each.join(counts, "word").groupBy("_phrase").agg(F.min(F.struct("n", "_offset", "word")).alias("a"), F.count("*").alias("_met"))
    anchors = anchors.where(F.col("_met") == F.size("_phrase")).select("_phrase", "a._offset", "a.word")
    if few:
        return places_in_rows(said, kept(anchors, "anchors"), wanted)
    rare = anchors.select("word").distinct()
    index = said.select("doc_id", F.posexplode("_words").alias("at", "word")).join(rare, "word", "left_semi")
    met = spread_join(index, anchors, counts.join(rare, "word", "left_semi"), "word", ["doc_id", "at"])
    starts = met.select("doc_id", "_phrase", (F.col("at") - F.col("_offset")).alias("start")).where("start >= 0").distinct()
    stands = F.slice("_words", F.col("start") + 1, F.size("_phrase")) == F.col("_phrase")
    found = starts.join(said, "doc_id").where(stands).select("doc_id", "_phrase", "start")
    return found.join(wanted, "_phrase").select("doc_id", "item_id", "start")


def places_in_rows(said: DataFrame, anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """`phrase_places` of a few phrases: each anchor's place in a row takes along the words around it, as many as its phrases reach, and meets them there."""
    reach = F.greatest(F.col("_offset"), F.size("_phrase") - F.col("_offset"))
    # a power of two, so that the words fall into few classes
    classes: dict[int, list[str]] = {}
    for r in anchors.groupBy("word").agg(F.max(reach).alias("reach")).collect():
        classes.setdefault(1 << (r["reach"] - 1).bit_length(), []).append(r["word"])

    def place(word: Column, at: Column) -> Column:
        out = F
        for most, members in sorted(classes.items()):
            base = F.greatest(at - most, F.lit(0))
            around = F.slice("_words", base + 1, F.lit(2 * most))
            out = out.when(word.isin(members), F.struct(at.alias("at"), word.alias("word"), base.alias("base"), around.alias("around")))
        return out

    if not classes:
        return said.join(wanted, F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("start"))
    hits = said.select("doc_id", F.explode(F.array_compact(F.transform("_words", place))).alias("_hit")).select("doc_id", "_hit.*")
    asked = F.broadcast(anchors.join(wanted, "_phrase"))
    start = F.col("at") - F.col("_offset")
    stands = F.slice("around", start - F.col("base") + 1, F.size("_phrase")) == F.col("_phrase")
    # a start before the text's is caught first: slice counts negative ones from the end, and fails at 0
    return hits.join(asked, "word").where(F.when(start >= 0, stands)).select("doc_id", "item_id", start.alias("start"))


def phrase_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id for each of docs that says the whole of one of items (see `phrase_places`)."""
    return phrase_places(docs, items).select("doc_id", "item_id").distinct()


def first_rows(df: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each group, numbered; Spark keeps no more than that of a group in a task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def met_rows(said: DataFrame, wanted: DataFrame, counts: DataFrame, terms: str, few_terms: bool) -> DataFrame:
    """Each pair of an item and a sentence that has one of the item's column `terms`, once, with the number of terms they share, if that is `_least` or more.

    Few terms of items go to the sentences; if they are many, sentences are dealt by their terms.
    """
    few = wanted.select("item_id", "asked", "_least", F.col(terms).alias("_prefix"), F.explode(terms).alias("term"))
    postings = said.select("doc_id", "at", "evidence", "terms", F.explode("terms").alias("term"))
    if few_terms:
        pairs = postings.join(F.broadcast(few), "term")
    else:
        asked = few.select("term").distinct()
        pairs = spread_join(postings.join(asked, "term", "left_semi"), few, counts, "term", ["doc_id", "at"])
    # in the row of the first term that both have
    once = F.get(F.array_intersect("_prefix", "terms"), F.lit(0)) == F.col("term")
    shared = pairs.where((F.size("terms") >= F.col("_least")) & once).withColumn("shared", F.size(F.array_intersect("asked", "terms")))
    return shared.where(F.col("shared") >= F.col("_least")).select("item_id", "asked", "shared", "doc_id", "at", "evidence")


#: Pairs of an item and one of its terms that are broadcast; more are dealt.
FEW_TERMS = 100_000


def top_evidence(docs: DataFrame, items: DataFrame, most: int = 10, looked_at: int = 200) -> DataFrame:
    """item_id, rank, doc_id, at, shared and evidence: the `most` sentences of all docs (doc_id, text) that share most terms (OP-38, OP-45) with each of items (item_id, text), ties by doc_id, then in text order (OP-100, OP-101).

    A sentence that shares t of an item's m terms has one of any m - t + 1 of them. So of each item's
    terms, the rarest first, as many are looked up as make about `looked_at` sentences; the least of the
    best `most` numbers of shared terms found there is t, and the sentences that can reach it have one of
    the rarest m - t + 1 terms. Its frequent terms are never looked up unless it has no others; sentences
    that share fewer than t are dropped where they are read. Sentences without a term in common with an
    item are no evidence of it. Sentences are split once and kept in the shared folder; where items have
    few terms in all, only the best of each task are shuffled.

    Rows of items without an id, and texts without terms, find nothing; equal sentences of several
    documents rank each for itself. An empty table gives an empty result.
    """
    stems = lambda c: F.array_sort(F.array_distinct(tx.claim_stems(F.col(c))))
    split = dealt(docs.select("doc_id", "text")).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("at", "evidence"))
    said = kept(split.withColumn("terms", stems("evidence")).where(F.size("terms") > 0), "sentences")
    asked = items.where("item_id is not null").select("item_id", stems("text").alias("asked")).distinct()
    each = asked.select("item_id", "asked", F.explode("asked").alias("term"))
    counts = said.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = kept(counts.join(each.select("term").distinct(), "term", "left_semi"), "counts")

    known = each.join(counts, "term").groupBy("item_id", "asked").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("k"))
    upto = F.transform("k", lambda _, i: F.aggregate(F.slice("k", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    known = known.withColumn("_rare", 1 + F.size(F.filter(upto, lambda n: n < looked_at))).withColumn("k", F.transform("k", lambda x: x["term"]))
    known = kept(known, "terms")
    few_terms = (known.agg(F.sum(F.size("k"))).first()[0] or 0) <= FEW_TERMS
    order = [F.desc("shared"), F.col("doc_id"), F.col("at")]
    by = ["item_id", "asked"]
    some = known.withColumns({"_some": F.slice("k", F.lit(1), F.col("_rare")), "_least": F.lit(1)})
    tried = met_rows(said, some, counts, "_some", few_terms)
    reached = first_rows(tried, by, order, most).groupBy(*by).agg(F.when(F.count("*") >= most, F.min("shared")).otherwise(1).alias("_least"))
    needed = kept(known.join(reached, by).withColumn("_needed", F.slice("k", F.lit(1), F.size("k") - F.col("_least") + 1)), "needed")
    rows = met_rows(said, needed, counts, "_needed", few_terms)
    return first_rows(rows, by, order, most).select("item_id", "rank", "doc_id", "at", "shared", "evidence")
