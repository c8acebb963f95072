"""Queries over the driver's tables, one or more for each operator, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import quantities as q
from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.functions.doi import normalize_doi
from attesta.operators import batch, claims, evidence, existence, frequent, metadata, resolve, search
from attesta.plans import corpus, numeric, prose
from attesta.plans import expected as x
from attesta.plans.corpus import table
from attesta.sources import parsers
from attesta.sources.claims import numbered_lines, read_claims
from attesta.sources.shared import dealt, new_folder, tasks


# --- keys and metadata ---------------------------------------------------------------------------


def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.claims(spark, sf_dir).select("l_orderkey", "l_linenumber", normalize_doi(F.col("doi")).alias("doi_norm"))


DOI_NORMALIZE = "SELECT l_orderkey, l_linenumber, '10.5555/part.' || l_partkey AS doi_norm FROM lineitem"

def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of orders: titles, authors and years that are right, wrong or missing by the order's key, and the fetched record.

    Orders are dealt before their texts are made: a few MB of them are one task, and their texts go to workers.
    """
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    o = dealt(o.select("o_orderkey", "o_orderdate", "c_name", "c_mktsegment"))
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    title = corpus.text("Résumé of {}: α-trials, part {}", F.col("c_mktsegment"), k)
    wrong = F.when(k % 5 == 1, corpus.text("Resume of {}: beta trial, part {}", F.col("c_mktsegment"), k)).when(k % 5 == 2, None).otherwise(corpus.text("resume of {}: alpha trial, part {}", F.lower("c_mktsegment"), k))
    author = F.when(k % 7 == 1, "Other Name").when(k % 7 == 2, "").otherwise(F.concat(F.lit("J. "), F.col("c_name"), F.lit("García")))
    fetched = F.struct(
        F.when(k % 11 == 0, F.lit("10.5555/other")).otherwise(corpus.text("10.5555/order.{}", k)).alias("doi"), title.alias("title"), F.array(F.concat(F.col("c_name"), F.lit("Garcia"))).alias("authors"), year.alias("year"),
        *[F.lit(None).cast("string").alias(n) for n in ("abstract", "source", "journal", "url")],
    )
    return o.select("o_orderkey", corpus.text("doi:10.5555/ORDER.{}.", k).alias("doi"), wrong.alias("title"), author.alias("first_author"), F.when(k % 3 == 0, None).otherwise(year + F.when(k % 3 == 1, 0).otherwise(1)).cast("int").alias("year"), fetched.alias("fetched"))


def metadata_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.verify_metadata(citations(spark, sf_dir)).select("o_orderkey", F.array_join("mismatches", ",").alias("mismatches"), "verdict", "reason")


MISMATCHES = """WITH m AS (SELECT o_orderkey, o_orderkey % 11 = 0 AS d, o_orderkey % 5 = 2 OR o_orderkey % 7 = 2 AS meta, o_orderkey % 5 = 1 AS t, o_orderkey % 7 = 1 AS a, o_orderkey % 3 = 2 AS y
 FROM orders JOIN customer ON o_custkey = c_custkey), v AS (SELECT *, concat_ws(',', CASE WHEN d THEN 'doi' END, CASE WHEN meta THEN 'metadata' END, CASE WHEN t THEN 'title' END, CASE WHEN a THEN 'first_author' END, CASE WHEN y THEN 'year' END) AS mismatches,
 CASE WHEN d OR t OR a THEN 'REJECT' WHEN meta OR y THEN 'WARN' ELSE 'PASS' END AS verdict FROM m)"""
METADATA_VERDICT = f"""{MISMATCHES} SELECT o_orderkey, mismatches, verdict, CASE WHEN verdict = 'PASS' THEN '{metadata.REASONS['PASS']}' WHEN verdict = 'REJECT' THEN '{metadata.REASONS['REJECT']}'
 WHEN meta THEN '{metadata.REASONS['metadata']}' ELSE '{metadata.REASONS['year']}' END AS reason FROM v"""


def metadata_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.verify_metadata(citations(spark, sf_dir))
    return rows.groupBy("verdict", F.array_join("mismatches", ",").alias("mismatches")).agg(F.count("*").alias("citations"))


METADATA_MISMATCHES = f"{MISMATCHES} SELECT verdict, mismatches, count(*) AS citations FROM v GROUP BY ALL"


def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(tx.tokens_with_greek(F.concat_ws(" ", "p_name", F.lit("Étoiles β"), "p_type", "p_brand")), " ").alias("tokens"))


TITLE_TOKENS = "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || ' etoiles  beta  ' || p_type || ' ' || p_brand), '[a-z0-9]+'), lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' THEN left(t, -1) ELSE t END), ' ') AS tokens FROM part"


def author_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat_ws(" ", F.lit("Zoë-Ann"), "s_name", F.lit("Society"))
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.array_join(metadata.author_tokens(names), " ").alias("tokens"), metadata.authors_match(names, F.concat_ws(" ", F.lit("zoe-ann"), "s_name", F.lit("society"))).alias("same"))


AUTHOR_TOKENS = "SELECT s_suppkey, 'zoe-ann ' || trim(regexp_replace(lower(s_name), '[^a-z -]+', ' ', 'g')) || ' society' AS tokens, TRUE AS same FROM supplier"


# --- text over documents -------------------------------------------------------------------------

BLANKS = r"E' \t\n\r\x0b\f'"
SENTENCES = r"list_filter(string_split(regexp_replace(trim(text, E' \t\n\r\x0b\f'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def sentence_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.length(F.array_join("s", "")).cast("long").alias("chars"))


SENTENCE_SPLIT_STATS = f"SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(length(array_to_string(s, '')) AS BIGINT) AS chars FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)"


def clause_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lambda s: F.filter(F.transform(F.split(s, vocab.CONJUNCTION_BREAK, -1), tx.strip), lambda p: p != "")
    counted = table(spark, sf_dir, "documents").select("doc_id", F.transform(tx.sentences(F.col("text")), lambda s: F.size(parts(s)).cast("long")).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)
    return counted.where(F.size("n") > 0).select("doc_id", total.alias("clauses"), F.array_max("n").alias("most"))


CLAUSE_SPLIT_STATS = rf"""SELECT doc_id, CAST(sum(n) AS BIGINT) AS clauses, CAST(max(n) AS BIGINT) AS most FROM (SELECT doc_id, len(list_filter(string_split(regexp_replace(s, ',?\s+(?:and|but|while|whereas)\s+', chr(1), 'g'), chr(1)), lambda p: trim(p) <> '')) AS n
 FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents)) GROUP BY doc_id"""


def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.numbers(F.col("text")), " ").alias("numbers"))


NUMBER_EXTRACT = r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?'), lambda n: replace(n, ',', '')), ' ') AS numbers FROM documents"


STEM = f"lambda w: CASE WHEN w LIKE 'actuat%' THEN 'actuat' WHEN w LIKE 'strain%' THEN 'strain' WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END"  # noqa: F541


def sql_stems(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda w: NOT list_contains({vocab.CLAIM_STOPWORDS}, w)), {STEM})"


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents say which passages, all with all."""
    return search.phrase_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all documents say parts of the passages: each passage's sentences, wherever they stand."""
    parts = table(spark, sf_dir, "benchmark").select(F.posexplode(tx.sentences(F.col("text"))).alias("part", "text"), "item_id")
    places = search.phrase_places(table(spark, sf_dir, "documents"), parts.select(F.struct("item_id", "part").alias("item_id"), "text"))
    return places.select("doc_id", F.col("item_id.item_id").alias("item_id"), F.col("item_id.part").alias("part"), "start")


def sql_phrases(table: str, text: str, keys: str) -> str:
    return f"SELECT {keys}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {table}"


#: Words with their places, and each phrase compared where its first word stands.
STANDS = """words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM said), firsts AS (SELECT doc_id, i, w[i] AS word, w FROM words),
 met AS (SELECT f.*, p.* EXCLUDE (w), f.i - 1 AS start FROM firsts f JOIN phrases p ON f.word = p.w[1] AND f.w[f.i:f.i + len(p.w) - 1] = p.w)"""
PHRASE_SEARCH = f"WITH said AS ({sql_phrases('documents', 'text', 'doc_id')}), phrases AS ({sql_phrases('benchmark', 'text', 'item_id')}), {STANDS} SELECT DISTINCT doc_id, item_id FROM met"
PHRASE_PLACES = f"""WITH said AS ({sql_phrases('documents', 'text', 'doc_id')}), parts AS (SELECT item_id, unnest({SENTENCES}) AS text, (generate_subscripts({SENTENCES}, 1) - 1)::INTEGER AS part FROM benchmark),
 phrases AS ({sql_phrases('parts', 'text', 'item_id, part')}), {STANDS} SELECT doc_id, item_id, part, start::INTEGER AS start FROM met"""


def term_overlap_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sentences of all documents that share most terms with each passage."""
    return search.top_evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM_OVERLAP_RANKED = f"""WITH said AS (SELECT doc_id, unnest({SENTENCES}) AS evidence, generate_subscripts({SENTENCES}, 1) - 1 AS at_ FROM documents),
 terms AS (SELECT *, list_distinct({sql_stems('evidence')}) AS t FROM said), items AS (SELECT item_id, list_distinct({sql_stems('text')}) AS t FROM benchmark),
 pairs AS (SELECT item_id, doc_id, at_, evidence, len(list_intersect(i.t, s.t)) AS shared FROM terms s, items i),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id, at_) AS place FROM pairs WHERE shared > 0)
 SELECT item_id, place::INTEGER AS rank, doc_id, at_::INTEGER AS "at", shared::INTEGER AS shared, evidence FROM ranked WHERE place <= 10"""


def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as inverted indexes, by grouping each text's words, and back."""
    words = F.filter(F.split(tx.strip(F.col("text")), r"\s+"), lambda w: w != "")
    # texts are shuffled, and not each of their words: both groupings find a document's rows in one task
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.repartition(tasks(docs), "doc_id").select("doc_id", words.alias("w"))
    each = rows.select("doc_id", F.posexplode("w").alias("i", "word")).groupBy("doc_id", "word").agg(F.collect_list("i").alias("at"))
    index = each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", F.size("index").cast("long").alias("words"), F.md5(parsers.inverted_text(F.col("index"))).alias("text_md5"))


INVERTED_INDEX_ROUNDTRIP = r"""SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS words, md5(trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(w, ' '), '\s+([,.;:!?%)\]])', '\1', 'g'), '([(])\s+', '\1', 'g'), '\s+', ' ', 'g'))) AS text_md5
 FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0"""


def html_abstract_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup; references that are cut off before their semicolon stay."""
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_markup(F.col("html"), closed=True).alias("abstract"))


HTML_ABSTRACT_CLEAN = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS abstract FROM pages"""


def json_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k_sum"), F.count("p.k").alias("with_k"), F.count("*").alias("events"))


JSON_EVENT_PROPS = "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(json_extract(props, '$.k')) AS with_k, count(*) AS events FROM events GROUP BY event_type"


def previous_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-104 over turns: how many numeric clauses follow which sentence."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", evidence.clause_texts(F.col("text")).alias("c"))
    first = F.size(F.filter("c", lambda c: c["before"] == "")).cast("long")
    return turns.where(F.size("c") > 0).select("conv_id", "turn", F.size("c").cast("long").alias("clauses"), first.alias("in_first_sentence"), F.element_at("c", -1)["before"].alias("before_last"))


PREVIOUS_SENTENCE = rf"""
WITH sentences AS (
    SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(trim(text, {BLANKS}), '([!?])\s+|[.;:]\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {BLANKS})), lambda s: s <> '') AS parts
    FROM conversations
), counted AS (
    SELECT *, list_transform(parts, lambda p: len(list_filter(string_split(regexp_replace(p, ',?\s+(?:and|but|while|whereas)\s+', chr(1), 'g'), chr(1)), lambda c: trim(c, {BLANKS}) <> ''))) AS n FROM sentences
)
SELECT conv_id, turn, list_sum(n)::BIGINT AS clauses, n[1]::BIGINT AS in_first_sentence, coalesce(parts[len(parts) - 1], '') AS before_last FROM counted WHERE list_sum(n) > 0
"""




# --- quantities ----------------------------------------------------------------------------------


def measurement_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and units read back from rendered sentences."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"))
    said = line.withColumn("t", corpus.text("It ran at {}.5 kV for {},000 cycles with {} patients.", F.col("l_linenumber"), F.col("qty"), F.col("qty")))
    m = frequent.by_text(dealt(said), "t", lambda d: d.withColumn("m", evidence.clause_evidence(evidence.clause_texts(F.col("t")))[0]["measures"]), said)
    return m.select("l_orderkey", "l_linenumber", F.array_join(F.transform("m", lambda v: F.concat_ws(":", (v["value"] * 10).cast("long").cast("string"), v["unit"])), " ").alias("found"))


MEASUREMENT_EXTRACT = "SELECT l_orderkey, l_linenumber, (l_linenumber * 10 + 5) || ':kv ' || CAST(l_quantity AS BIGINT) * 10000 || ':cycle ' || CAST(l_quantity AS BIGINT) * 10 || ':person' AS found FROM lineitem"

def grid(spark: SparkSession, sf_dir: str, test: Column, name: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_quantity").alias("v"), (F.col("l_linenumber") * 7).cast("double").alias("t"), corpus.by_place(F.col("l_orderkey"), corpus.COMPARATORS).alias("seen"), corpus.by_place(F.floor(F.col("l_orderkey") / 6), corpus.COMPARATORS).alias("said"))
    return rows.groupBy("seen", "said").agg(F.count("*").alias("rows"), F.count_if(test).alias(name))


def sql_grid(test: str, name: str) -> str:
    return f"WITH g AS (SELECT l_quantity AS v, l_linenumber * 7.0 AS t, {x.place('l_orderkey')} AS seen, {x.place('l_orderkey // 6')} AS said FROM lineitem) SELECT seen, said, count(*) AS rows, count(*) FILTER (WHERE {test}) AS {name} FROM g GROUP BY seen, said"


GRID = ("v", "seen", "t", "said")


def entail_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, q.entails_percentage(*map(F.col, GRID)), "entailed")


def entail_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, q.entails_measurement(*map(F.col, GRID)), "entailed")


def contradict_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, q.contradicts(*map(F.col, GRID)), "contradicted")


# --- verdicts ------------------------------------------------------------------------------------


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.check_claims(corpus.claims(spark, sf_dir), corpus.answers(spark, sf_dir))


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("l_orderkey", "l_linenumber", "status", "verdict", "error_code", "abstract_source")


def with_papers(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims with their terms and the evidence of their papers, which is found once for each paper."""
    counts = asked.groupBy("key").agg(F.count("*").alias("_rows"))
    rows = resolve.spread(asked, papers.select("key", "abstract"), counts, "key", ["l_orderkey", "l_linenumber"], evidence.with_evidence)
    return frequent.by_text(rows, "claim", claims.with_claim_terms, asked)


def numeric_claim_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_papers(corpus.claims(spark, sf_dir).where(~F.col("strain")), corpus.papers(spark, sf_dir))
    return claims.numeric_support(rows).select("l_orderkey", "l_linenumber", F.col("numeric_status").alias("status"))


def pct_claim_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_papers(corpus.claims(spark, sf_dir).where("strain"), corpus.papers(spark, sf_dir))
    return claims.percentage_support(rows).select("l_orderkey", "l_linenumber", F.col("percentage_evidence").isNotNull().alias("supported"))


def pct_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values in one sentence: by material both may stand, otherwise one can rule the other out (J-6, OP-76)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7 % 50 + 1).alias("a"), (F.col("p_partkey") * 11 % 50 + 1).alias("b"), F.col("p_size").cast("long").alias("t"))
    one = F.when(F.col("k") % 2 == 0, corpus.text("Actuated strain was {}% with silicone and {}% with acrylic.", F.col("a"), F.col("b"))).otherwise(corpus.text("Actuated strain was {}% and {}%.", F.col("a"), F.col("b")))
    d = part.withColumn("abstract", one).withColumn("claim", corpus.text("actuation strain above {}%", F.col("t")))
    return claims.check_pairs(d).select("k", F.col("verdict"))


PCT_CONTRADICTION = "SELECT k, CASE WHEN (k % 2 = 0 AND (a > t OR b > t)) OR (a > t AND b > t) THEN 'ACCEPT' ELSE 'WARN' END AS verdict FROM (SELECT p_partkey AS k, p_partkey * 7 % 50 + 1 AS a, p_partkey * 11 % 50 + 1 AS b, p_size AS t FROM part)"


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source stands behind each paper, with how many attempts, if asked automatically."""
    asked = corpus.papers(spark, sf_dir).select("key", F.col("doi_norm").alias("doi"), F.lit("auto").alias("source"))
    r = resolve.resolve(asked, resolve.answers_by_doi(corpus.answers(spark, sf_dir)))
    return r.select("key", "abstract_source", F.when(F.col("row_error").isNotNull(), "ROW_CHECK_ERROR").otherwise(F.col("lookup_error")).alias("lookup_code"), F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["source"], a["status"])), " ").alias("attempts"))


OPENALEX = "CASE WHEN key % 4 = 3 THEN 'TIMEOUT' WHEN key % 4 <> 1 THEN 'NO_ABSTRACT' WHEN key % 5 = 0 THEN 'DOI_MISMATCH' ELSE 'FOUND' END"
SEMANTIC = "CASE WHEN key % 3 = 1 THEN 'API_ERROR' WHEN key % 3 = 0 THEN 'FOUND' ELSE 'NO_ABSTRACT' END"
SOURCE_FALLBACK = f"""WITH {x.PAPERS}, {x.RESOLVED}, t AS (SELECT *, {OPENALEX} AS o, {SEMANTIC} AS s FROM resolved)
 SELECT key, abstract_source, CASE WHEN abstract_source IS NULL THEN lookup_code END AS lookup_code, CASE WHEN key = 7 THEN '' WHEN key % 23 = 0 THEN 'crossref:DOI_MISMATCH' WHEN key % 4 = 0 THEN 'crossref:FOUND'
 ELSE 'crossref:NO_ABSTRACT openalex:' || o || CASE WHEN o = 'FOUND' THEN '' ELSE ' semantic_scholar:' || s || CASE WHEN s = 'FOUND' THEN '' ELSE ' pubmed:' || CASE WHEN key % 7 = 0 THEN 'FOUND' ELSE 'NO_ABSTRACT' END END END END AS attempts FROM t"""


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of PubMed-only lookups, counted by status (J-4)."""
    asked = corpus.papers(spark, sf_dir).select("key", F.col("doi_norm").alias("doi"), F.lit("pubmed").alias("source"))
    r = resolve.resolve(asked, resolve.answers_by_doi(corpus.answers(spark, sf_dir)))
    return r.select(F.explode("attempts").alias("a"), "lookup_error").groupBy(F.col("a.source").alias("source"), F.col("a.status").alias("status"), "lookup_error").agg(F.count("*").alias("attempts"))


ATTEMPT_LOG = "SELECT 'pubmed' AS source, CASE WHEN p_partkey % 7 = 0 THEN 'FOUND' ELSE 'NO_ABSTRACT' END AS status, CASE WHEN p_partkey % 7 <> 0 THEN 'NO_ABSTRACT' END AS lookup_error, count(*) AS attempts FROM part GROUP BY ALL"

def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.summarize(results(spark, sf_dir))


SUMMARY = "count(*) AS total, count(*) FILTER (WHERE verdict = 'ACCEPT') AS accept, count(*) FILTER (WHERE verdict = 'WARN') AS warn, count(*) FILTER (WHERE verdict = 'REJECT') AS reject, count(*) FILTER (WHERE status = 'PARTIAL') AS partial, count(*) FILTER (WHERE status = 'UNVERIFIABLE') AS unverifiable"
FAILED = f"count(*) FILTER (WHERE error_code IN {vocab.FAILED_CODES}) AS failed"


def batch_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where(F.col("error_code").isin(*vocab.FAILED_CODES)).groupBy("error_code").agg(F.count("*").alias("failed"))


def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("abstract_source", F.coalesce("abstract_source", F.lit("none")))
    return r.rollup("abstract_source", "error_code").agg(F.count("*").alias("claims"))


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of verdicts that are given, as text blocks."""
    line = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("id"), F.lit("10.1/x").alias("doi"), F.lit("c").alias("claim"), F.lit("WARN").alias("verdict"), F.lit("r").alias("reason"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("e")).otherwise("").alias("evidence"), F.lit("NO_ABSTRACT").alias("error_code"))
    return batch.report_rows(line)


BATCH_REPORT = "SELECT o_orderkey AS row_number, chr(10) || 'WARN  ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'row-' || o_orderkey END || '  10.1/x' || chr(10) || 'Claim: c' || chr(10) || 'Reason: r' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'Evidence: e' ELSE '' END || chr(10) || 'Error code: NO_ABSTRACT' AS block FROM orders"


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels say which documents may be accepted; verdicts go by the parity of their key."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("must_accept"), (F.col("toxic") == 1).alias("must_not_accept"))
    verdicts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, "ACCEPT").otherwise("WARN").alias("verdict"))
    return batch.gate(verdicts, labels)


REGRESSION_GATE = "SELECT count(*) AS checked, count(*) FILTER (WHERE toxic = 1 AND doc_id % 3 = 0) AS safety_failures, count(*) FILTER (WHERE quality = 1 AND doc_id % 3 <> 0) AS pending FROM labels"


def cross_source_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that two independent sources agree on by title, one knows, or none has under its DOI."""
    a = corpus.answers(spark, sf_dir).where(normalize_doi(F.col("record.doi")) == F.col("doi_norm"))
    tokens = F.array_join(tx.tokens_with_greek(F.col("record.title")), " ")
    known = a.groupBy("doi_norm", tokens.alias("t")).agg(F.count_distinct("source_name").alias("sources"))
    out = corpus.papers(spark, sf_dir).select("key", "doi_norm").join(known, "doi_norm", "left")
    return out.select("key", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), F.when(F.col("sources") > 1, "CONFIRMED").when(F.col("sources") == 1, "SINGLE-SOURCE").otherwise("NOT FOUND").alias("existence"))


CROSS_SOURCE_EXISTENCE = """SELECT key, CAST(n AS BIGINT) AS sources, CASE WHEN n > 1 THEN 'CONFIRMED' WHEN n = 1 THEN 'SINGLE-SOURCE' ELSE 'NOT FOUND' END AS existence FROM (SELECT p_partkey AS key,
 CAST(p_partkey <> 7 AND p_partkey % 23 <> 0 AS INTEGER) + CAST(p_partkey % 4 = 1 AND p_partkey % 5 <> 0 AS INTEGER) + CAST(p_partkey % 3 = 0 AS INTEGER) + CAST(p_partkey % 7 = 0 AS INTEGER) AS n FROM part)"""


# --- claim files and documents -------------------------------------------------------------------


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a file, in order: some without a DOI or claim, some of unknown sources, with quotes, commas and line breaks in them.

    The keys alone are sorted; texts are made where they are written.
    """
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    line = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("long") for c in order])
    line = line.repartitionByRange(tasks(line), *order).sortWithinPartitions(*order)
    k, n = F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_linenumber")
    return line.select(
        F.when(k % 4 > 0, corpus.text(" {}-{} ", F.col("l_orderkey"), n)).alias("id"), F.when(k % 50 > 0, corpus.text("10.5555/part.{}", F.col("l_partkey"))).otherwise("").alias("doi"),
        F.when(k % 41 > 0, corpus.text('device "lifetime",\nabove {} cycles', F.col("l_quantity"))).alias("claim"), F.when(k % 31 == 0, "arxiv").when(k % 3 == 0, "pubmed").alias("source"), F.when(k % 7 == 0, "ü, note").alias("note"),
    )


def claim_file_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims written as CSV files and read back: rows, numbers and what is wrong with them (OP-01, 03, 04)."""
    path = new_folder(spark, "claims") + ".csv"
    claim_rows(spark, sf_dir).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_claims(spark, path, strict=False)


def claim_file_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON lines (OP-01, 02, 04)."""
    path = new_folder(spark, "claims") + ".jsonl"
    rows = claim_rows(spark, sf_dir)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return read_claims(spark, path, strict=False)


def sql_claim_file(first: int) -> str:
    at = f"(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) + {first - 1})"
    return f"""WITH c AS (SELECT {at} AS row_number, CASE WHEN k % 4 > 0 THEN l_orderkey || '-' || l_linenumber END AS id, CASE WHEN k % 50 > 0 THEN '10.5555/part.' || l_partkey END AS doi,
 CASE WHEN k % 41 > 0 THEN 'device "lifetime",' || chr(10) || 'above ' || CAST(l_quantity AS BIGINT) || ' cycles' END AS claim, CASE WHEN k % 31 = 0 THEN 'arxiv' WHEN k % 3 = 0 THEN 'pubmed' ELSE 'auto' END AS source, CASE WHEN k % 7 = 0 THEN 'ü, note' END AS note
 FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem))
 SELECT *, CASE WHEN doi IS NULL THEN 'Missing required field on line ' || row_number || ': doi' WHEN claim IS NULL THEN 'Missing required field on line ' || row_number || ': claim' WHEN source = 'arxiv' THEN 'Invalid field on line ' || row_number || ': source=arxiv' END AS error FROM c"""


def payload_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on papers written as one JSON document, and its lines in the order of the files (OP-24, 90, 107)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("row_number"), (F.col("p_partkey") * 7 % 50 + 1).alias("v"), F.col("p_size").cast("long").alias("t"))
    pairs = part.withColumn("abstract", corpus.text("Actuated strain was {}%.", F.col("v"))).withColumn("claim", corpus.text("actuation strain above {}%", F.col("t")))
    checked = claims.check_pairs(pairs)
    code = F.when(F.col("verdict") == "ACCEPT", "CLAIM_SUPPORTED").otherwise("CLAIM_NOT_EXPLICIT")
    none = F.lit(None).cast("string")
    results = checked.select("row_number", none.alias("id"), F.lit("10.1/x").alias("doi"), "claim", none.alias("note"), "status", "verdict", "reason", "evidence", none.alias("abstract_source"), code.alias("error_code"), none.alias("record"), none.alias("attempts"))
    path = new_folder(spark, "document")
    batch.write_document(results, path)
    lines = numbered_lines(spark, path)
    row = F.from_json(F.regexp_replace("value", "^, ", ""), "row_number long, verdict string, evidence string")
    total = F.regexp_extract("value", '"total":([0-9]+),"accept":([0-9]+)', 0)
    return lines.select("line", row["row_number"].alias("row_number"), row["verdict"].alias("verdict"), row["evidence"].alias("evidence"), F.when(F.contains("value", F.lit('"summary"')), total).alias("summary"), F.col("value").startswith(", ").alias("goes_on"))


PAYLOAD_DOCUMENT = """WITH r AS (SELECT p_partkey::BIGINT AS row_number, p_partkey * 7 % 50 + 1 AS v, p_partkey * 7 % 50 + 1 > p_size AS ok FROM part), n AS (SELECT *, row_number() OVER (ORDER BY row_number) AS i FROM r)
 SELECT 1::BIGINT AS line, NULL::BIGINT AS row_number, NULL AS verdict, NULL AS evidence, NULL AS summary, FALSE AS goes_on
 UNION ALL SELECT i + 1, row_number, CASE WHEN ok THEN 'ACCEPT' ELSE 'WARN' END, 'Actuated strain was ' || v || '%.', NULL, i > 1 FROM n
 UNION ALL SELECT count(*) + 2, NULL, NULL, NULL, '"total":' || count(*) || ',"accept":' || count(*) FILTER (WHERE ok), FALSE FROM r"""


def existence_without_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers cited with wrong DOIs and other spellings, by the sources that know title and first author."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    k = F.col("key")
    author = F.when(k % 6 == 0, "Trial Network").otherwise("Lee")
    cited = part.select("key", F.lit("10.1/none").alias("doi"), corpus.text("Étude of {}: α {}", F.upper("name"), k).alias("title"), F.when(k % 5 == 2, "J. Other").when(k % 6 == 0, "Trial Network").when(k % 10 == 5, None).otherwise("J. Lée").alias("first_author"))
    record = F.struct(corpus.text("etude of {} - Alpha {}", F.col("name"), k).alias("title"), F.array(author, F.lit("Kim")).alias("authors"))
    knows = F.array_compact(F.array(F.when(k != 7, "crossref"), F.when(k % 4 == 1, "openalex"), F.when(k % 3 == 0, "semantic_scholar"), F.when(k % 7 == 0, "pubmed")))
    records = part.select(F.explode(knows).alias("source_name"), record.alias("record"))
    return existence.existence(cited, records).select("key", F.array_join("sources", " ").alias("sources"), "existence")


EXISTENCE_WITHOUT_DOI = """WITH r AS (SELECT p_partkey AS key, list_filter([CASE WHEN key <> 7 THEN 'crossref' END, CASE WHEN key % 4 = 1 THEN 'openalex' END, CASE WHEN key % 7 = 0 THEN 'pubmed' END, CASE WHEN key % 3 = 0 THEN 'semantic_scholar' END], lambda s: s IS NOT NULL) AS s FROM part),
 m AS (SELECT key, CASE WHEN key % 5 = 2 OR (key % 6 <> 0 AND key % 10 = 5) THEN [] ELSE s END AS s FROM r)
 SELECT key, array_to_string(s, ' ') AS sources, CASE WHEN len(s) > 1 THEN 'CONFIRMED' WHEN len(s) = 1 THEN 'SINGLE-SOURCE' ELSE 'NOT FOUND' END AS existence FROM m"""


def payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CrossRef messages rendered from part and supplier, and read back."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    parts = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % F.lit(supplier.count()))  # keys are from 0 or 1 on
    p = parts.join(supplier, "k", "left")
    dates = lambda n: F.struct(F.array(F.array(n.cast("int"), F.lit(1))).alias("date-parts"))
    message = F.to_json(F.struct(
        corpus.paper_doi(F.col("p_partkey")).alias("DOI"), F.array(F.col("p_name")).alias("title"), F.array(F.struct(F.col("s_name").alias("family"), F.lit("x").alias("name")), F.struct(F.lit(None).cast("string").alias("family"), F.lit("Group").alias("name"))).alias("author"),
        dates(F.lit(1999)).alias("created"), dates(F.lit(2000) + F.col("p_size")).alias("issued"), F.when(F.col("p_partkey") % 2 == 0, dates(F.lit(1950) + F.col("p_size"))).alias("published-online"), corpus.text("<jats:p>Size &lt; {}</jats:p><b>more</b>", F.col("p_size")).alias("abstract"),
    ))
    r = p.select("p_partkey", parsers.crossref(message).alias("r"))
    return r.select("p_partkey", "r.doi", "r.title", F.array_join("r.authors", ";").alias("authors"), F.col("r.year").cast("long").alias("year"), "r.abstract")


PAYLOAD_PARSE = "SELECT p_partkey, '10.5555/part.' || p_partkey AS doi, p_name AS title, coalesce(s_name || ';', '') || 'Group' AS authors, CAST(p_size + CASE WHEN p_partkey % 2 = 0 THEN 1950 ELSE 2000 END AS BIGINT) AS year, 'Size < ' || p_size || ' more' AS abstract FROM part LEFT JOIN supplier ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey"

QUERIES = {
    f.__name__: f
    for f in (
        doi_normalize, metadata_verdict, metadata_mismatches, title_tokens, author_tokens, sentence_split_stats, clause_split_stats, number_extract,
        phrase_search, phrase_places, term_overlap_ranked, inverted_index_roundtrip, html_abstract_clean, json_event_props, previous_sentence, measurement_extract, entail_pct, entail_num, contradict_pct,
        claim_verdicts, numeric_claim_verdict, pct_claim_verdict, pct_contradiction, source_fallback, attempt_log, batch_summary, batch_failed, verdict_rollup,
        batch_report, regression_gate, cross_source_existence, existence_without_doi, payload_parse, claim_file_csv, claim_file_jsonl, payload_document,
    )
}

ORACLE_SQL = {
    "doi_normalize": DOI_NORMALIZE,  "metadata_verdict": METADATA_VERDICT, "metadata_mismatches": METADATA_MISMATCHES, "title_tokens": TITLE_TOKENS, "author_tokens": AUTHOR_TOKENS,
    "sentence_split_stats": SENTENCE_SPLIT_STATS, "clause_split_stats": CLAUSE_SPLIT_STATS, "number_extract": NUMBER_EXTRACT, "phrase_search": PHRASE_SEARCH, "phrase_places": PHRASE_PLACES, "term_overlap_ranked": TERM_OVERLAP_RANKED,
    "inverted_index_roundtrip": INVERTED_INDEX_ROUNDTRIP, "html_abstract_clean": HTML_ABSTRACT_CLEAN, "json_event_props": JSON_EVENT_PROPS, "previous_sentence": PREVIOUS_SENTENCE, "measurement_extract": MEASUREMENT_EXTRACT,  "entail_pct": sql_grid(x.entails_percentage(*GRID), "entailed"), "entail_num": sql_grid(x.entails_measurement(*GRID), "entailed"), "contradict_pct": sql_grid(x.contradicts(*GRID), "contradicted"), 
    "claim_verdicts": f"{x.VERDICTS} SELECT l_orderkey, l_linenumber, status, verdict, error_code, abstract_source FROM verdicts",
    "numeric_claim_verdict": f"WITH {x.PAPERS}, {x.CLAIMS} SELECT l_orderkey, l_linenumber, CASE WHEN {x.LIFE} THEN 'SUPPORTED' ELSE 'PARTIAL' END AS status FROM claims JOIN papers USING (key) WHERE NOT strain",
    "pct_claim_verdict": f"WITH {x.PAPERS}, {x.CLAIMS} SELECT l_orderkey, l_linenumber, {x.ACCEPTED} AS supported FROM claims JOIN papers USING (key) WHERE strain",
    "pct_contradiction": PCT_CONTRADICTION, "source_fallback": SOURCE_FALLBACK, "attempt_log": ATTEMPT_LOG, 
    "batch_summary": f"{x.VERDICTS} SELECT {SUMMARY}, {FAILED} FROM verdicts", "batch_failed": f"{x.VERDICTS} SELECT error_code, count(*) AS failed FROM verdicts WHERE error_code IN {vocab.FAILED_CODES} GROUP BY error_code",
    "verdict_rollup": f"{x.VERDICTS} SELECT abstract_source, error_code, count(*) AS claims FROM (SELECT coalesce(abstract_source, 'none') AS abstract_source, error_code FROM verdicts) GROUP BY ROLLUP (abstract_source, error_code)",
    "batch_report": BATCH_REPORT, "regression_gate": REGRESSION_GATE, "cross_source_existence": CROSS_SOURCE_EXISTENCE, "existence_without_doi": EXISTENCE_WITHOUT_DOI, "payload_parse": PAYLOAD_PARSE,
    "claim_file_csv": sql_claim_file(2), "claim_file_jsonl": sql_claim_file(1), "payload_document": PAYLOAD_DOCUMENT,
}

QUERIES |= prose.QUERIES | numeric.QUERIES
ORACLE_SQL |= prose.ORACLE_SQL | numeric.ORACLE_SQL
