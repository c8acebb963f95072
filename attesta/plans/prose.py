"""More queries over the driver's tables: prose claims with their evidence, offsets, payloads of three services, joined citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.operators import claims, metadata, resolve
from attesta.plans import corpus
from attesta.plans.corpus import table, text
from attesta.sources import parsers
from attesta.sources.shared import dealt

#: Abstract, claim, what is expected of it (status, reason) and the evidence; {} is the part's key, [] its size and <> five more.
CASES = (
    ("Films were cast. Graphene layers enhance transport in sample {}. More work is planned.", "graphene layers enhance transport in sample {}", "SUPPORTED", vocab.REASON_LITERAL, "Graphene layers enhance transport in sample {}."),
    ("Films were cast. It is unclear whether graphene layers enhance transport in sample {}.", "graphene layers enhance transport in sample {}", "PARTIAL", vocab.REASON_RELATED, "It is unclear whether graphene layers enhance transport in sample {}."),
    ("Films were cast. Graphene layers enhance transport in sample {} less than copper.", "graphene layers enhance transport in sample {}", "PARTIAL", vocab.REASON_RELATED, "Graphene layers enhance transport in sample {} less than copper."),
    ("Films were cast. Under vacuum graphene layers enhance transport in sample {}.", "graphene layers enhance transport in sample {}", "PARTIAL", vocab.REASON_RELATED, "Under vacuum graphene layers enhance transport in sample {}."),
    ("Films were cast. Graphene layers enhance transport in sample 9{}.", "graphene layers enhance transport in sample {}", "PARTIAL", vocab.REASON_RELATED, "Graphene layers enhance transport in sample 9{}."),
    ("The film {} was held at <>% pre-strain. It was then dried.", "actuation strain above []%", "PARTIAL", vocab.REASON_PRESTRAIN, "The film {} was held at <>% pre-strain."),
    ("Film {} was dried. The porosity was <>%.", "porosity above []%", "SUPPORTED", vocab.REASON_NUMERIC, "The porosity was <>%."),
    ("Film {} was dried. The porosity was <>%.", "porosity exceeding []%", "SUPPORTED", vocab.REASON_PERCENTAGE, "The porosity was <>%."),
    ("Film {} was dried. The yield was <>%.", "porosity above []%", "PARTIAL", vocab.REASON_UNRELATED, "Film {} was dried."),
    ("Film {} was dried. Under vacuum the actuation strain was <>%.", "actuation strain above []%", "PARTIAL", vocab.REASON_RELATED, "Under vacuum the actuation strain was <>%."),
    ("Film {} was dried. The actuation strain was about <>%.", "actuation strain above []%", "PARTIAL", vocab.REASON_RELATED, "The actuation strain was about <>%."),
    ("Device lifetime of film {} was recorded. Measurement reached <> cycles.", "device lifetime <> cycles", "SUPPORTED", vocab.REASON_NUMERIC, "Measurement reached <> cycles."),
    ("Lifetime of film {} was recorded. Storage reached <> cycles.", "device lifetime <> cycles", "PARTIAL", vocab.REASON_RELATED, "Lifetime of film {} was recorded."),
    ("", "device {} lifetime <> cycles", "UNVERIFIABLE", vocab.REASON_NO_ABSTRACT, ""),
)


def filled(template: str) -> Column:
    """The template with the part's numbers in their places."""
    marks = {"{}": F.col("p_partkey"), "[]": F.col("p_size").cast("long"), "<>": F.col("p_size").cast("long") + 5}
    out = F.lit(template)
    for mark, value in marks.items():
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def of_case(i: int) -> Column:
    out = F
    for n, case in enumerate(CASES):
        out = out.when(F.col("p_partkey") % len(CASES) == n, filled(case[i]))
    return out


def prose_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, verdict, reason and evidence of a prose claim about each part: literal, framed, compared, scoped, pre-strained, generic, approximate and anaphoric."""
    pairs = table(spark, sf_dir, "part").select("p_partkey", of_case(0).alias("abstract"), of_case(1).alias("claim"))
    return claims.check_pairs(pairs).select("p_partkey", "claim", "status", "verdict", "reason", "evidence")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_case(i: int) -> str:
    cases = " ".join(f"WHEN {n} THEN {sql_text(c[i])}" for n, c in enumerate(CASES))
    return f"replace(replace(replace(CASE p_partkey % {len(CASES)} {cases} END, '{{}}', p_partkey::VARCHAR), '[]', p_size::BIGINT::VARCHAR), '<>', (p_size + 5)::BIGINT::VARCHAR)"


PROSE_VERDICTS = f"""
SELECT p_partkey, {sql_case(1)} AS claim, {sql_case(2)} AS status, CASE WHEN status = 'SUPPORTED' THEN 'ACCEPT' ELSE 'WARN' END AS verdict, {sql_case(3)} AS reason, {sql_case(4)} AS evidence
FROM part
"""


def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every document with its place, in code points (OP-57)."""
    found = tx.spans(F.col("text"), vocab.NUMBER)
    said = F.transform(found, lambda s: F.concat_ws(":", s["match"], s["start"].cast("string"), s["end"].cast("string")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(said, " ").alias("spans"))


NUMBER_SPANS = rf"""
WITH parts AS (
    SELECT doc_id, string_split_regex(text, '{vocab.NUMBER}') AS gaps, regexp_extract_all(text, '{vocab.NUMBER}') AS found FROM documents WHERE text IS NOT NULL
), placed AS (
    SELECT doc_id, found, list_transform(range(1, len(found) + 1), lambda i: coalesce(list_sum(list_transform(gaps[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[:i - 1], lambda f: length(f))), 0)) AS starts FROM parts
)
SELECT doc_id, array_to_string(list_transform(range(1, len(found) + 1), lambda i: found[i] || ':' || starts[i]::BIGINT || ':' || (starts[i]::BIGINT + length(found[i]))), ' ') AS spans FROM placed
"""


def record_columns(r: str) -> list[Column]:
    return [F.col(f"{r}.doi").alias("doi"), F.col(f"{r}.title").alias("title"), F.array_join(f"{r}.authors", ";").alias("authors"), F.col(f"{r}.year").cast("long").alias("year"), F.col(f"{r}.abstract").alias("abstract"), F.col(f"{r}.journal").alias("journal"), F.col(f"{r}.url").alias("url"), F.col(f"{r}.source").alias("source")]


def openalex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OpenAlex works rendered from parts, and read back (OP-12 to OP-14); null without DOI or abstract."""
    key = F.col("p_partkey")
    words = F.create_map(F.lit("Size"), F.array(F.lit(0)), F.lit("("), F.array(F.lit(1)), F.col("p_size").cast("string"), F.array(F.lit(2)), F.lit("),"), F.array(F.lit(3)), F.lit("again"), F.array(F.lit(4), F.lit(6)), F.lit("and"), F.array(F.lit(5)))
    work = F.to_json(F.struct(
        F.when(key % 5 != 0, corpus.text("https://doi.org/10.5555/PART.{}", key)).alias("doi"), F.when(key % 3 != 0, F.concat(F.lit(" "), "p_name")).alias("title"), corpus.text("https://openalex.org/W{}", key).alias("id"),
        (F.lit(1990) + F.col("p_size")).cast("int").alias("publication_year"), F.array(F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("author")), F.struct(F.struct(F.lit(" ").alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.struct(F.col("p_type").alias("display_name")).alias("source")).alias("primary_location"), F.when(key % 7 != 0, words).alias("abstract_inverted_index"),
    ))
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", parsers.openalex(work).alias("r")).select("p_partkey", *record_columns("r"))


OPENALEX_PARSE = f"""
SELECT p_partkey, CASE WHEN ok THEN '10.5555/part.' || p_partkey END AS doi, CASE WHEN ok THEN CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '{vocab.TITLE_MISSING}' END END AS title, CASE WHEN ok THEN p_brand END AS authors,
    CASE WHEN ok THEN 1990 + p_size END::BIGINT AS year, CASE WHEN ok THEN 'Size (' || p_size::BIGINT || '), again and again' END AS abstract, CASE WHEN ok THEN p_type END AS journal,
    CASE WHEN ok THEN 'https://openalex.org/W' || p_partkey END AS url, CASE WHEN ok THEN 'OpenAlex' END AS source
FROM (SELECT *, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok FROM part)
"""


def semantic_scholar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic Scholar papers rendered from parts, and read back (OP-16); null without DOI or abstract."""
    key = F.col("p_partkey")
    paper = F.to_json(F.struct(
        F.when(key % 3 != 0, F.col("p_name")).alias("title"), F.when(key % 7 != 0, text(" Size {}. ", F.col("p_size"))).alias("abstract"), text("https://example.org/{}", key).alias("url"), F.when(key % 2 == 0, F.col("p_type")).otherwise(" ").alias("venue"),
        (F.lit(1990) + F.col("p_size")).cast("int").alias("year"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit(None).cast("string").alias("name")), F.struct(F.lit("Group").alias("name"))).alias("authors"),
        F.struct(F.when(key % 5 != 0, text("10.5555/Part.{}", key)).alias("DOI")).alias("externalIds"),
    ))
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", parsers.semantic_scholar(paper).alias("r")).select("p_partkey", *record_columns("r"))


SEMANTIC_SCHOLAR_PARSE = f"""
SELECT p_partkey, CASE WHEN ok THEN '10.5555/Part.' || p_partkey END AS doi, CASE WHEN ok THEN CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '{vocab.TITLE_MISSING}' END END AS title, CASE WHEN ok THEN p_brand || ';Group' END AS authors,
    CASE WHEN ok THEN 1990 + p_size END::BIGINT AS year, CASE WHEN ok THEN 'Size ' || p_size::BIGINT || '.' END AS abstract, CASE WHEN ok AND p_partkey % 2 = 0 THEN p_type END AS journal,
    CASE WHEN ok THEN 'https://example.org/' || p_partkey END AS url, CASE WHEN ok THEN 'Semantic Scholar' END AS source
FROM (SELECT *, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok FROM part)
"""


def pubmed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PubMed articles rendered from parts, and read back (OP-18 to OP-20); null for broken XML and without DOI or abstract."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    doi = F.when(key % 5 == 0, "").when(key % 2 == 0, text('<ELocationID EIdType="DOI">10.5555/part.{}</ELocationID>', key)).otherwise(text('<ArticleId IdType="doi">10.5555/part.{}</ArticleId>', key))
    date = F.when(key % 3 == 0, text("<MedlineDate>{} Spring</MedlineDate>", size + 1950)).otherwise(text("<Year>{}</Year>", size + 1950))
    body = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation>"), text("<PMID>{}</PMID>", key), F.lit("<Article><Journal><Title>Tales</Title><JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue></Journal>"),
        F.lit("<ArticleTitle>"), F.col("p_name"), F.lit("</ArticleTitle><Abstract>"), text('<AbstractText Label="AIM">Size <i>{}</i> is\n big.</AbstractText><AbstractText>It is.</AbstractText>', size), F.lit("</Abstract><AuthorList>"),
        F.lit("<Author><LastName>"), F.col("p_brand"), F.lit("</LastName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>"), doi, F.lit("</Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"),
    )
    xml = F.when(key % 11 == 0, F.substring(body, F.lit(1), F.length(body) - 4)).otherwise(body)
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", parsers.pubmed(xml).alias("r")).select("p_partkey", *record_columns("r"))


PUBMED_PARSE = """
SELECT p_partkey, CASE WHEN ok THEN '10.5555/part.' || p_partkey END AS doi, CASE WHEN ok THEN p_name END AS title, CASE WHEN ok THEN p_brand || ';The Group' END AS authors, CASE WHEN ok THEN 1950 + p_size END::BIGINT AS year,
    CASE WHEN ok THEN 'AIM: Size ' || p_size::BIGINT || ' is big. It is.' END AS abstract, CASE WHEN ok THEN 'Tales' END AS journal, CASE WHEN ok THEN 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey || '/' END AS url, CASE WHEN ok THEN 'PubMed' END AS source
FROM (SELECT *, p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 AS ok FROM part)
"""


def citation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every line joined with the record behind their DOI (J-5): the title is wrong in one of three, the year in one of four, one paper is unknown."""
    line = corpus.claims(spark, sf_dir).select("row_number", "key", "doi")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    cited = line.join(part, "key").select("row_number", "doi", F.when(F.col("row_number") % 3 == 0, F.concat("p_name", F.lit(" anew"))).otherwise(F.upper("p_name")).alias("title"), F.lit("Ann Lee").alias("first_author"), F.when(F.col("row_number") % 4 == 0, 2019).otherwise(2020).alias("year"))
    records = corpus.answers(spark, sf_dir).where("source_name = 'crossref'").select("doi_norm", "record")
    out = metadata.verify_citations(cited, records)
    return out.select("row_number", F.array_join("mismatches", ",").alias("mismatches"), "verdict")


CITATION_JOIN = """
SELECT row_number, CASE WHEN key <> 7 THEN concat_ws(',', CASE WHEN key % 23 = 0 THEN 'doi' END, CASE WHEN row_number % 3 = 0 THEN 'title' END, CASE WHEN row_number % 4 = 0 THEN 'year' END) END AS mismatches,
    CASE WHEN key = 7 THEN NULL WHEN key % 23 = 0 OR row_number % 3 = 0 THEN 'REJECT' WHEN row_number % 4 = 0 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM (SELECT l_orderkey * 10 + l_linenumber AS row_number, l_partkey AS key FROM lineitem)
"""


def selected_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record, the reason and the evidence of each claim's lookup at one selected source (J-4, OP-107): a placeholder where it has none."""
    asked = corpus.claims(spark, sf_dir).withColumn("source", corpus.by_place(F.col("row_number"), ("openalex", "semantic-scholar", "pubmed")))
    out = resolve.check_claims(asked, corpus.answers(spark, sf_dir))
    unverifiable = F.col("status") == "UNVERIFIABLE"
    code = F.when(unverifiable, F.col("error_code"))
    of_record = [F.col(f"record.{c}").alias(n) for c, n in (("doi", "doi"), ("title", "title"), ("source", "record_source"))]
    return out.select("row_number", "source", *of_record, "abstract_source", unverifiable.alias("unverifiable"), code.alias("lookup_code"))


SELECTED_LOOKUP = f"""
WITH lines AS (
    SELECT l_orderkey * 10 + l_linenumber AS row_number, l_partkey AS key, (l_orderkey * 10 + l_linenumber) % 3 AS way FROM lineitem
), looked AS (
    SELECT *, CASE way WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic-scholar' ELSE 'pubmed' END AS source,
        CASE way WHEN 0 THEN key % 4 = 1 AND key % 5 <> 0 WHEN 1 THEN key % 3 = 0 ELSE key % 7 = 0 END AS found,
        CASE WHEN way = 0 AND key % 4 = 1 AND key % 5 = 0 THEN 'DOI_MISMATCH' WHEN way = 0 AND key % 4 = 3 THEN 'SOURCE_TIMEOUT' WHEN way = 1 AND key % 3 = 1 THEN 'SOURCE_API_ERROR' ELSE 'NO_ABSTRACT' END AS code
    FROM lines
)
SELECT l.row_number, source, '10.5555/part.' || key AS doi, CASE WHEN found THEN p_name ELSE '{vocab.TITLE_MISSING}' END AS title,
    CASE WHEN NOT found THEN 'selected abstract source' WHEN way = 0 THEN 'OpenAlex' WHEN way = 1 THEN 'Semantic Scholar' ELSE 'PubMed' END AS record_source,
    CASE WHEN found THEN replace(source, '-', '_') END AS abstract_source, NOT found AS unverifiable, CASE WHEN NOT found THEN code END AS lookup_code
FROM looked l JOIN part ON key = p_partkey
"""

QUERIES = {f.__name__: f for f in (prose_verdicts, number_spans, openalex_parse, semantic_scholar_parse, pubmed_parse, citation_join, selected_lookup)}

ORACLE_SQL = {
    "prose_verdicts": PROSE_VERDICTS,
    "number_spans": NUMBER_SPANS,
    "openalex_parse": OPENALEX_PARSE,
    "semantic_scholar_parse": SEMANTIC_SCHOLAR_PARSE,
    "pubmed_parse": PUBMED_PARSE,
    "citation_join": CITATION_JOIN,
    "selected_lookup": SELECTED_LOOKUP,
}
