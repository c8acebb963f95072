"""Which abstract stands behind a DOI: the first of several sources that returns one bound to it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import vocab
from attesta.functions.doi import normalize_doi
from attesta.operators.claims import CLAIM_COLUMNS, claim_support, settled, with_claim_terms
from attesta.operators.evidence import with_evidence
from attesta.operators.frequent import by_text
from attesta.schemas import ATTEMPT
from attesta.sources.shared import tasks

EVIDENCE = ("sentences", "clauses", "abstract_terms")
#: Claims of one DOI that a task takes; a DOI with more is dealt over several, the most cited MOST_HOT of them.
PER_TASK, MOST_HOT = 50_000, 1000


def attempt(source: str, status: Column | str, reason: Column | str, doi: Column | None = None, elapsed: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None)
    return F.struct(
        F.lit(source).alias("source"),
        as_column(status).alias("status"),
        as_column(reason).alias("reason"),
        none.cast("string").alias("record_id"),
        (doi if doi is not None else none).cast("string").alias("doi"),
        (elapsed if elapsed is not None else none).cast("int").alias("elapsed_ms"),
    )


def least_answers(answers: DataFrame) -> tuple[DataFrame, list[Column]]:
    """answers and aggregates of them: for each source a column with the least of its answers (record, error_status, error_reason, elapsed_ms, and bound: is the record of this DOI?).

    Answers are ordered by (error, no record, no abstract, the answer itself), so it does not matter
    in which order they come. elapsed_ms may be missing; groups without a source's answer get null.
    """
    if "elapsed_ms" not in answers.columns:
        answers = answers.withColumn("elapsed_ms", F.lit(None).cast("int"))
    bound = F.coalesce(normalize_doi(F.coalesce("record.doi", F.lit(""))) == F.col("doi_norm"), F.lit(False))
    answer = F.struct("record", "error_status", "error_reason", "elapsed_ms", bound.alias("bound"))
    order = [F.col("error_status").isNotNull(), F.col("record").isNull(), F.coalesce(F.col("record.abstract"), F.lit("")) == ""]
    placed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], answer.alias("answer"))
    return answers, [F.min(F.when(F.col("source_name") == s, placed))["answer"].alias(s) for s in ("crossref", *vocab.FALLBACK_ORDER)]


def answers_by_doi(answers: DataFrame) -> DataFrame:
    """One row per DOI with a column for each source's answer (see `least_answers`)."""
    answers, columns = least_answers(answers)
    return answers.groupBy("doi_norm").agg(*columns)


def fallback_attempt(source: str) -> Column:
    a = F.col(source)
    status, reason, record = a["error_status"], F.nullif(a["error_reason"], F.lit("")), a["record"]
    said = F.coalesce(reason, F.when(status == "TIMEOUT", "Source lookup timed out.").otherwise("Source lookup failed."))
    make = lambda status, reason, doi=None: attempt(source, status, reason, doi, a["elapsed_ms"])
    return (
        F.when(a.isNull(), make("NOT_FOUND", vocab.NOT_FOUND[source]))
        .when(status.isNotNull(), make(status, said))
        .when(record.isNull(), make("NO_ABSTRACT", "Source returned no DOI-bound abstract."))
        .when(~a["bound"], make("DOI_MISMATCH", "Source returned a DOI that does not match the requested DOI.", record["doi"]))
        .when(F.coalesce(record["abstract"], F.lit("")) == "", make("NO_ABSTRACT", "Source record had no abstract.", record["doi"]))
        .otherwise(make("FOUND", "Source returned a DOI-bound abstract.", record["doi"]))
    )


def final_error_code(attempts: Column, selected: Column) -> Column:
    """OP-92."""
    statuses = F.transform(attempts, lambda a: a["status"])
    has = lambda s: F.array_contains(statuses, s)
    return (
        F.when(selected & has("DOI_MISMATCH"), "DOI_MISMATCH").when(has("API_ERROR"), "SOURCE_API_ERROR").when(has("TIMEOUT"), "SOURCE_TIMEOUT").when(has("RATE_LIMITED"), "SOURCE_RATE_LIMITED")
        .when(has("UNSUPPORTED") & ~has("NO_ABSTRACT"), "SOURCE_UNSUPPORTED").when((F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "NOT_FOUND"), "DOI_NOT_FOUND").otherwise("NO_ABSTRACT")
    )


def resolve(claims: DataFrame, by_doi: DataFrame, use_crossref_abstract: bool = True) -> DataFrame:
    """claims (doi, source, ...) with doi_norm, record, abstract_source, attempts, lookup_error and row_error (J-1 to J-4).

    Automatic and crossref claims take CrossRef's record first: another DOI there ends the lookup, an
    abstract too. Then come the other sources in order, or the selected one alone; each adds one
    attempt, and the first with an abstract for the DOI ends it. A selected source that has none gives
    a placeholder as record. row_error holds a CrossRef failure, which no fallback mends. by_doi is
    from `answers_by_doi`; one join, and the rest is row by row, so claims may be a stream.
    """
    keyed = claims if "doi_norm" in claims.columns else claims.withColumn("doi_norm", normalize_doi(F.col("doi")))
    return chosen_source(keyed.join(by_doi, "doi_norm", "left"), use_crossref_abstract)


def chosen_source(df: DataFrame, use_crossref_abstract: bool = True) -> DataFrame:
    """`resolve` for claims that have their sources' answers (see `least_answers`) beside them."""
    selected = ~F.col("source").isin("auto", "crossref")
    doi, main = F.col("doi_norm"), F.col("crossref")
    record = main["record"]
    broken = F.when(~selected & record.isNull(), F.coalesce(main["error_reason"], F.lit(vocab.CROSSREF_MISSING)))
    other_doi = ~main["bound"]
    abstract = F.coalesce(record["abstract"], F.lit("")) != ""
    first = (
        F.when(other_doi, attempt("crossref", "DOI_MISMATCH", "CrossRef returned a DOI that does not match the requested DOI.", record["doi"]))
        .when(abstract & F.lit(use_crossref_abstract), attempt("crossref", "FOUND", "CrossRef record included an abstract.", record["doi"]))
        .when(abstract, attempt("crossref", "UNSUPPORTED", "CrossRef abstract was skipped by source selection.", record["doi"]))
        .otherwise(attempt("crossref", "NO_ABSTRACT", "CrossRef record had no abstract.", record["doi"]))
    )
    none = F.expr(f"cast(array() as array<{ATTEMPT}>)")
    own = F.array(*[fallback_attempt(s) for s in vocab.FALLBACK_ORDER])
    name = F.replace(F.col("source"), F.lit("-"), F.lit("_"))
    others = F.when(F.col("source") == "auto", own).when(selected, F.filter(own, lambda a: a["source"] == name)).otherwise(none)
    df = df.withColumns({"row_error": broken, "_first": F.when(~selected & broken.isNull(), first), "_others": others})
    ended = F.coalesce(F.col("_first.status").isin("DOI_MISMATCH", "FOUND"), F.lit(False)) | F.col("row_error").isNotNull()
    hit = F.array_position(F.transform("_others", lambda a: a["status"]), "FOUND")
    tried = F.when(ended, none).when(hit > 0, F.slice("_others", 1, hit.cast("int"))).otherwise(F.col("_others"))
    df = df.withColumn("attempts", F.concat(F.when(F.col("_first").isNotNull(), F.array("_first")).otherwise(none), tried))
    last = F.try_element_at("attempts", F.lit(-1))
    df = df.withColumn("abstract_source", F.when(last["status"] == "FOUND", last["source"]))
    kind = df.schema["crossref"].dataType["record"].dataType
    given = {"doi": doi, "title": F.lit("[title missing]"), "authors": F.array(), "source": F.lit("selected abstract source")}
    placeholder = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
    chosen = F.when(F.col("abstract_source").isNull(), F.when(selected, placeholder).otherwise(record))
    for s in ("crossref", *vocab.FALLBACK_ORDER):
        chosen = chosen.when(F.col("abstract_source") == s, F.col(s)["record"])
    mismatch = F.col("_first.status") == "DOI_MISMATCH"
    error = F.when(F.col("abstract_source").isNotNull(), F.lit(None)).when(mismatch, "DOI_MISMATCH").otherwise(final_error_code(F.col("attempts"), selected))
    placed = df.withColumns({"record": chosen, "lookup_error": F.when(F.col("row_error").isNull(), error)})
    return placed.drop("crossref", *vocab.FALLBACK_ORDER, "_first", "_others")


def usable_abstract() -> Column:
    """The chosen record's abstract, but for a record of another DOI."""
    return F.when(F.col("lookup_error").isNull() | (F.col("lookup_error") != "DOI_MISMATCH"), F.col("record.abstract"))


def evident(resolved: DataFrame) -> DataFrame:
    """`resolve`d rows with the evidence of the chosen abstract."""
    return with_evidence(resolved.withColumn("abstract", usable_abstract())).drop("abstract")


def spread(claims: DataFrame, dim: DataFrame, counts: DataFrame, key: str, salt_by: Sequence[str] = ("row_number", "claim"), widen: Callable[[DataFrame], DataFrame] = lambda dim: dim) -> DataFrame:
    """claims with the columns of widen(dim) by an equi-join on key, of which every claim has one row in dim; counts has _rows, the claims of each key.

    The most cited keys are dealt over as many tasks as their claims ask for, with a copy of their row
    for each; only their names and numbers, at most MOST_HOT, are broadcast. What follows costs far
    more a row than its bytes say, so claims and dim are dealt to as many tasks as the session names,
    which Spark does not put together by size. dim is widened where it meets the claims: its slim rows
    are shuffled, and the wide ones, which Spark takes for small ones, are never broadcast.
    """
    hot = counts.where(F.col("_rows") > PER_TASK).orderBy(F.desc("_rows"), key).limit(MOST_HOT)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_rows") / PER_TASK).cast("int").alias("_tasks")))
    salt = F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("_tasks")), F.lit(0)).cast("int")
    fact = claims.join(hot, key, "left").withColumn("_salt", salt).drop("_tasks").repartition(tasks(claims), key, "_salt")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)).alias("_salt")
    copied = dim.drop("_rows").join(hot, key, "left").select("*", copies).drop("_tasks").repartition(tasks(claims), key, "_salt")
    return fact.join(widen(copied).hint("merge"), [key, "_salt"]).drop("_salt")


def check_claims(claims: DataFrame, answers: DataFrame, use_crossref_abstract: bool = True) -> DataFrame:
    """status, verdict, reason, evidence, abstract_source, attempts and error_code of each claim (OP-115 to OP-117).

    claims: row_number, id, doi, claim, source, note. answers: what each source says of each DOI
    (schemas.SOURCE_ANSWER). The sources are resolved once for each different DOI and choice of
    source, on slim rows, and only the abstract that is chosen is read for evidence. The terms of
    frequent claims are found once for each.
    """
    keyed = claims.withColumns({"source": F.coalesce("source", F.lit("auto")), "doi_norm": normalize_doi(F.col("doi"))})
    keyed = keyed.withColumn("_key", F.concat_ws(" ", "source", "doi_norm"))
    asked = keyed.groupBy("_key", "source", "doi_norm").agg(F.count("*").alias("_rows"))
    resolved = resolve(asked, answers_by_doi(answers), use_crossref_abstract).drop("source", "doi_norm")
    rows = spread(keyed, resolved, asked, "_key", widen=evident).drop("_key")
    return judge_resolved(by_text(rows, "claim", with_claim_terms, claims))


def judge_resolved(resolved: DataFrame) -> DataFrame:
    """The verdicts of `resolve`d claims with evidence (see `evident`), row by row; claim terms are made if they are not there."""
    shown = resolved.withColumn("abstract", usable_abstract())
    judged = claim_support(shown if CLAIM_COLUMNS[0] in shown.columns else with_claim_terms(shown))
    broken, mismatch = F.col("row_error").isNotNull(), F.coalesce(F.col("lookup_error") == "DOI_MISMATCH", F.lit(False))
    code = F.when(F.col("verdict") == "ACCEPT", "CLAIM_SUPPORTED").when(F.col("status") == "UNVERIFIABLE", "NO_ABSTRACT").when(F.contains("reason", F.lit("does not explicitly support")), "CLAIM_NOT_EXPLICIT").otherwise("CLAIM_AMBIGUOUS")
    out = judged.withColumn("error_code", F.when(broken, "ROW_CHECK_ERROR").otherwise(F.coalesce("lookup_error", code)))
    reason = F.when(broken, F.concat(F.lit("Row could not be checked: "), "row_error")).when(mismatch, vocab.REASON_DOI_MISMATCH).otherwise(F.col("reason"))
    out = out.withColumn("reason", reason).withColumn("attempts", F.when(broken, F.expr(f"cast(array() as array<{ATTEMPT}>)")).otherwise(F.col("attempts"))).drop(*EVIDENCE, "abstract", "row_error", "lookup_error", "doi_norm", "numeric_status", "numeric_reason", "numeric_evidence", *CLAIM_COLUMNS)
    return settled(out, "reason", "error_code")
