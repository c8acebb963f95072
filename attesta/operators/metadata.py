"""Does the citation that was typed match the record behind its DOI?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.functions.doi import normalize_doi
from attesta.operators.claims import settled
from attesta.operators.resolve import answers_by_doi, spread
from attesta.sources.shared import kept

REASONS = vocab.METADATA_REASONS


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def tokens_of_name(plain: Column) -> Column:
    """OP-37, of a folded name: runs of letters and hyphens."""
    return F.regexp_extract_all(plain, F.lit("[a-z-]+"), 0)


def author_tokens(name: Column) -> Column:
    return tokens_of_name(tx.plain_fold(name))


def same_name(a: Column, b: Column) -> Column:
    """OP-77 on tokens: equal last words; equal words where either side is a group. Names without Latin letters match nothing."""
    groups = F.array(*[F.lit(w) for w in vocab.GROUP_AUTHOR_WORDS])
    group = F.arrays_overlap(a, groups) | F.arrays_overlap(b, groups)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & F.when(group, a == b).otherwise(F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1))), F.lit(False))


def authors_match(left: Column, right: Column) -> Column:
    return same_name(author_tokens(left), author_tokens(right))


#: What a record's side of the comparison needs, made by `found_columns`.
FOUND = ("_found_title", "_found_words", "_found_numbers", "_found_name", "_found_doi")


def found_columns(rows: DataFrame, fetched: str, title_wanted: Column, name_wanted: Column) -> DataFrame:
    """rows with FOUND of their record: its title folded, in words and numbers, its first author's words and its DOI."""
    f, empty = F.col(fetched), F.lit("")
    title = F.when(title_wanted, F.coalesce(f["title"], empty))
    name = F.when(name_wanted, F.coalesce(F.get(f["authors"], F.lit(0)), empty))
    rows = rows.withColumns({"_found_title": tx.plain_title(title), "_found_name": tx.plain_fold(name), "_found_numbers": tx.numbers(title), "_found_doi": normalize_doi(F.coalesce(f["doi"], empty))})
    return rows.withColumns({"_found_words": tx.title_tokens(F.col("_found_title")), "_found_name": tokens_of_name(F.col("_found_name"))})


#: What a citation's side needs, made by `cited_columns`.
CITED = ("_title", "_name", "_doi")


def cited_columns(rows: DataFrame, title_wanted: Column) -> DataFrame:
    """rows with CITED: the title folded, the first author's words and the normalised doi, each null if not given."""
    doi, name = (F.when(given(F.col(c)), F.col(c)) for c in ("doi", "first_author"))
    rows = rows.withColumns({"_title": tx.plain_title(F.when(title_wanted, F.col("title"))), "_name": tx.plain_fold(name), "_doi": normalize_doi(doi)})
    return rows.withColumn("_name", tokens_of_name(F.col("_name")))


def verify_metadata(pairs: DataFrame, fetched: str = "fetched") -> DataFrame:
    """pairs (doi, title, first_author, year and the record `fetched`) with mismatches, verdict and reason (OP-110).

    Mismatches come in the order doi, metadata, title, first_author, year. None is PASS; a doi,
    title or first_author mismatch REJECT; a citation without title or author, or another year, WARN.
    Titles match by equal numbers and equal tokens, in order (OP-111); equal ones are not looked into.

    Columns build on columns: folded texts first (one pass through the workers, for texts that are not
    ASCII), then their tokens, then the comparisons; each is in the plan once. Pairs may bring FOUND,
    made once for each record, and CITED.
    """
    f = F.col(fetched)
    empty = F.lit("")
    cited_title, found_title = F.coalesce("title", empty), F.coalesce(f["title"], empty)
    looked_into = given(F.col("title")) & (cited_title != found_title)
    named = given(F.col("first_author"))
    staged = pairs if FOUND[0] in pairs.columns else found_columns(pairs, fetched, looked_into, named)
    staged = staged if CITED[0] in pairs.columns else cited_columns(staged, looked_into)
    # ASCII titles that are equal but for case have the same words and numbers
    same_letters = F.col("_title") == F.col("_found_title")
    same_ascii = same_letters & tx.is_ascii(cited_title) & tx.is_ascii(found_title)
    same_title = same_letters | (tx.title_tokens(F.col("_title")) == F.col("_found_words"))
    same_numbers = tx.numbers(F.when(looked_into, cited_title)) == F.col("_found_numbers")
    tests = [
        ("doi", F.col("_doi") != F.col("_found_doi")),
        ("metadata", ~(given(F.col("title")) & named)),
        ("title", looked_into & ~(same_ascii | (same_numbers & same_title))),
        ("first_author", named & ~same_name(F.col("_name"), F.col("_found_name"))),
        ("year", F.col("year").isNotNull() & ~F.coalesce(F.col("year") == f["year"], F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    out = settled(staged.withColumn("mismatches", found).drop(*CITED, *FOUND), "mismatches")
    m = F.col("mismatches")
    severe = F.arrays_overlap(m, F.array(F.lit("doi"), F.lit("title"), F.lit("first_author")))
    verdict = F.when(F.size(m) == 0, "PASS").when(severe, "REJECT").otherwise("WARN")
    out = out.withColumn("verdict", verdict)
    reason = F.when(F.col("verdict") != "WARN", F.when(F.col("verdict") == "PASS", REASONS["PASS"]).otherwise(REASONS["REJECT"])).when(F.array_contains(m, "metadata"), REASONS["metadata"]).otherwise(REASONS["year"])
    return out.withColumn("reason", reason)


def verify_citations(citations: DataFrame, answers: DataFrame) -> DataFrame:
    """citations (doi, title, first_author, year) with CrossRef's record, fetched, and mismatches, verdict and reason (J-5); the last three are null without a record.

    answers: schemas.SOURCE_ANSWER, or doi_norm and record alone; those of other sources are left out.
    Each different DOI is looked up once, with the least of its answers by the order of
    `resolve.answers_by_doi`, so repeated answers repeat no citation; the most cited DOIs are dealt
    over several tasks. Citations that repeat stay as many. A record is folded and split into words
    once, before its citations meet it; citations are folded while their rows are slim, and kept in the
    shared folder, since they are read twice.
    """
    cited = cited_columns(citations, given(F.col("title")))
    keyed = kept(cited.withColumn("doi_norm", F.coalesce("_doi", F.lit(""))), "citations")
    asked = keyed.groupBy("doi_norm").agg(F.count("*").alias("_rows"))
    for name in ("source_name", "error_status", "error_reason"):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit("crossref" if name == "source_name" else None).cast("string"))
    own = answers_by_doi(answers.where("source_name = 'crossref' and record is not null"))
    found = asked.join(own.select("doi_norm", F.col("crossref.record").alias("fetched")), "doi_norm", "left")
    folded = lambda dim: found_columns(dim, "fetched", F.lit(True), F.lit(True))
    met = spread(keyed, found, asked, "doi_norm", citations.columns, widen=folded)
    out = verify_metadata(met)
    there = F.col("fetched").isNotNull()
    return out.withColumns({c: F.when(there, F.col(c)) for c in ("mismatches", "verdict", "reason")})
