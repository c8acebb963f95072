"""Claims against evidence: measurements, percentages, literal statements, and the verdict.

All functions take a DataFrame with claim columns (`with_claim_terms`) and evidence columns
(`evidence.with_evidence`), joined on the paper, and add columns; none shuffles but `check_pairs`, which deals its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.functions.quantities import claimed_comparator, contradicts, entails_measurement, entails_percentage, normalize_unit
from attesta.operators.evidence import array_of, scoped, with_evidence
from attesta.sources.shared import dealt

COMPARATIVE = tx.words_pattern(vocab.COMPARATIVE_SUFFIXES)
CLAIM_COLUMNS = ("c_terms", "c_phrase", "c_numbers", "c_threshold", "c_cmp", "c_strain", "c_actuation", "c_qualifiers", "c_generic", "c_measure")


def with_claim_terms(claims: DataFrame, claim: str = "claim") -> DataFrame:
    """claims with what the engines need of the claim's text (OP-46, 72, 73, 75, 80, 81)."""
    text = F.coalesce(F.col(claim), F.lit(""))
    percent = text.rlike(vocab.PERCENTAGE)
    # phrase and numbers are for literal statements only
    staged = claims.withColumns({
        "c_terms": F.array_distinct(tx.claim_stems(text)), "c_threshold": F.when(percent, tx.value_of(F.regexp_extract(text, vocab.PERCENTAGE, 1))),
        "c_cmp": claimed_comparator(text, exceeding=True), "_first": tx.first_span(text, vocab.MEASUREMENT),
    })
    terms, match, prefix = F.col("c_terms"), F.col("_first.match"), F.col("_first.prefix")
    subject = F.array_except(tx.numeric_stems(prefix), array_of([*vocab.NUMERIC_NON_SUBJECT, *vocab.UNIT_TERMS]))
    measure = F.struct(
        tx.value_of(F.regexp_extract(match, "(?U)^" + vocab.NUMBER, 0)).alias("value"), normalize_unit(F.regexp_extract(match, "(?U)^" + vocab.NUMBER + r"\s*(.*)$", 1)).alias("unit"),
        claimed_comparator(prefix, exceeding=False).alias("cmp"), subject.alias("terms"),
    )
    literal = F.col("c_threshold").isNull()
    strain, actuation = F.array_contains(terms, "strain"), F.array_contains(terms, "actuat")
    return staged.withColumns({
        "c_phrase": F.when(literal, tx.phrase(text)), "c_numbers": F.when(literal, F.array_distinct(tx.numbers(text))), "c_strain": strain, "c_actuation": actuation,
        "c_qualifiers": F.array_intersect(terms, array_of(vocab.STRAIN_QUALIFIERS)),
        "c_generic": F.when(strain | actuation, F.expr("cast(array() as array<string>)")).otherwise(F.array_except(terms, array_of(vocab.PERCENTAGE_NON_SUBJECT))),
        "c_measure": F.when(F.col("_first").isNotNull(), measure),
    }).drop("_first")


def numeric_support(df: DataFrame) -> DataFrame:
    """numeric_status, numeric_reason and numeric_evidence (OP-112): the first clause that entails the claimed measurement, else the first related one."""
    claim = F.col("c_measure")
    about = lambda c: (F.size(claim["terms"]) > 0) & tx.within(claim["terms"], c["terms"])
    entails = lambda c: F.exists(c["measures"], lambda m: (m["unit"] == claim["unit"]) & entails_measurement(m["value"], m["cmp"], claim["value"], claim["cmp"]))
    found = F.filter("clauses", lambda c: ~c["framed"] & about(c) & entails(c))
    related = F.filter("clauses", lambda c: c["framed"] | ((F.size(c["measures"]) > 0) & about(c)))
    measured = F.filter("clauses", lambda c: F.size(c["measures"]) > 0)
    first = lambda a: F.get(a, F.lit(0))["clause"]
    out = df.withColumn("_found", F.when(claim.isNotNull(), first(found)))
    partial = F.coalesce(first(related), first(measured), tx.strip(F.coalesce("abstract", F.lit(""))))
    status = F.when(claim.isNull(), "NOT_NUMERIC").when(F.col("_found").isNotNull(), "SUPPORTED").otherwise("PARTIAL")
    reason = F.when(claim.isNull(), vocab.REASON_NOT_NUMERIC).when(F.col("_found").isNotNull(), vocab.REASON_NUMERIC).otherwise(vocab.REASON_NUMERIC_PARTIAL)
    return out.withColumns({"numeric_status": status, "numeric_reason": reason, "numeric_evidence": F.when(claim.isNull(), "").otherwise(F.coalesce("_found", partial))}).drop("_found")


def place(s: Column) -> Column:
    """Where a sentence stands among those of its abstract: most terms in common with the claim first, ties in text order (OP-100)."""
    return F.struct((-tx.overlap(F.col("c_terms"), s["terms"])).alias("rank"), s["idx"].alias("idx"))


def first_text(places: Column) -> Column:
    """The text of the sentence of the first place (OP-101, OP-102). Sentences stay as they are: only their places are sorted."""
    return F.get(F.col("sentences"), F.array_min(places)["idx"])["text"]


def about_subject(p: Column, s: Column) -> Column:
    """Is the percentage about what the claim is about (OP-70, 71, 72, 78)?"""
    strain = F.array_contains(p["terms"], "strain") & F.when(F.col("c_actuation"), F.array_contains(p["terms"], "actuat") & ~p["compound"] & ~p["strain_qualified"]).otherwise(tx.within(F.col("c_qualifiers"), p["terms"]))
    inherited = F.col("c_actuation") & s["actuation"] & ~p["compound"] & ~p["strain_qualified"] & ~p["unrelated"]
    return strain | inherited | ((F.size("c_generic") > 0) & tx.within(F.col("c_generic"), p["terms"]))


def percentage_support(df: DataFrame) -> DataFrame:
    """percentage_evidence, the first sentence by rank that supports the claimed percentage with no contradiction, and prestrain_evidence (OP-113, OP-69).

    Contradictions by other percentages of the sentence (J-6) and by other sentences (J-7) are sought
    in the arrays: an anti-join without its two exchanges.
    """
    threshold, said = F.col("c_threshold"), F.col("c_cmp")

    def other_material(a: Column, b: Column) -> Column:  # OP-76
        return (F.size(a["qualifiers"]) > 0) & (F.size(b["qualifiers"]) > 0) & ~F.arrays_overlap(a["qualifiers"], b["qualifiers"])

    def flags(s: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            subject = ~p["prestrain"] & ~p["framed"] & about_subject(p, s)
            return F.struct(
                i.alias("i"),
                (subject & contradicts(p["value"], p["cmp"], threshold, said)).alias("against"),
                p["limited"].alias("limited"),
                p["qualifiers"].alias("qualifiers"),
                (subject & ~p["limited"] & entails_percentage(p["value"], p["cmp"], threshold, said)).alias("for"),
            )

        def judged(spans: Column) -> Column:
            clear = lambda p: ~F.exists(spans, lambda q: (q["i"] != p["i"]) & q["against"] & ~other_material(p, q))
            supports = ~s["framed"] & ~s["scope_start"] & F.exists(spans, lambda p: p["for"] & clear(p))
            against = ~s["framed"] & F.exists(spans, lambda p: p["against"] & ~p["limited"])
            return F.struct(place(s).alias("place"), supports.alias("supports"), against.alias("against"))

        return tx.let(F.transform(s["spans"], one), judged)

    flagged = df.withColumn("_flags", F.when(threshold.isNotNull(), F.transform(F.filter("sentences", lambda s: F.size(s["spans"]) > 0), flags)))
    counted = flagged.withColumn("_against", F.size(F.filter("_flags", lambda s: s["against"])))
    standing = F.filter("_flags", lambda s: s["supports"] & (F.col("_against") == F.when(s["against"], 1).otherwise(0)))
    prestrained = F.filter("sentences", lambda s: (F.size(s["spans"]) > 0) & F.forall(s["spans"], lambda p: p["prestrain"]))
    return counted.withColumns({
        "percentage_evidence": first_text(F.transform(standing, lambda s: s["place"])),
        "prestrain_evidence": F.when(threshold.isNotNull(), first_text(F.transform(prestrained, place))),
    }).drop("_flags", "_against")


def literal_support(df: DataFrame) -> DataFrame:
    """literal_evidence: the first sentence by rank that says the claim word for word, unframed and unqualified (OP-114, OP-58); null for percentages."""
    claim = F.col("c_phrase")

    def says(s: Column) -> Column:
        padded, wanted = F.concat(F.lit(" "), s["phrase"], F.lit(" ")), F.concat(F.lit(" "), claim, F.lit(" "))
        # words before and after each occurrence: later ones begin inside what follows an earlier one
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - F.length(wanted) + 1)), lambda i: padded.substr(i, F.length(wanted)) == wanted)

        def plain(i: Column) -> Column:
            rest = F.trim(padded.substr(i + F.length(wanted), F.length(padded)))
            return ~scoped(F.trim(padded.substr(F.lit(1), i - 1))) & ~rest.rlike(COMPARATIVE) & ~scoped(rest)

        return ~s["framed"] & F.contains(padded, wanted) & tx.within(F.col("c_numbers"), s["numbers"]) & F.exists(starts, plain)

    asked = F.col("c_threshold").isNull() & (claim != "")
    return df.withColumn("literal_evidence", F.when(asked, first_text(F.transform(F.filter("sentences", says), place))))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns made by a generator of one row, which no filter is pushed through.

    A filter on a verdict would else be rewritten into one on the texts that repeats the whole tree
    of rules at each mention, and take minutes to plan.
    """
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def claim_support(joined: DataFrame) -> DataFrame:
    """status, verdict, reason and evidence of each claim (OP-115), from claim and evidence columns and `abstract`.

    A measurement that a clause entails, a percentage that a sentence supports, or a literal statement
    is accepted, in this order; strain percentages skip the first. Percentages only in a pre-strain
    context, and everything else, are partial; no abstract, unverifiable.
    """
    df = literal_support(percentage_support(numeric_support(joined)))
    missing = F.coalesce(F.col("abstract"), F.lit("")) == ""
    percent = F.col("c_threshold").isNotNull()
    numeric = (F.col("numeric_status") == "SUPPORTED") & ~(percent & F.col("c_strain"))
    by_percentage, by_prestrain, literal = (F.col(f"{c}_evidence").isNotNull() for c in ("percentage", "prestrain", "literal"))
    top = F.coalesce(first_text(F.transform("sentences", place)), tx.strip(F.col("abstract")))
    pick = lambda *v: F.when(missing, v[0]).when(numeric, v[1]).when(by_percentage, v[2]).when(by_prestrain, v[3]).when(literal, v[4]).otherwise(v[5])
    related = F.when(tx.overlap(F.col("c_terms"), F.col("abstract_terms")) > 0, vocab.REASON_RELATED).otherwise(vocab.REASON_UNRELATED)
    lit = F.lit
    return settled(df.withColumns({
        "status": pick(lit("UNVERIFIABLE"), lit("SUPPORTED"), lit("SUPPORTED"), lit("PARTIAL"), lit("SUPPORTED"), lit("PARTIAL")),
        "verdict": pick(lit("WARN"), lit("ACCEPT"), lit("ACCEPT"), lit("WARN"), lit("ACCEPT"), lit("WARN")),
        "reason": pick(lit(vocab.REASON_NO_ABSTRACT), lit(vocab.REASON_NUMERIC), lit(vocab.REASON_PERCENTAGE), lit(vocab.REASON_PRESTRAIN), lit(vocab.REASON_LITERAL), related),
        "evidence": pick(lit(""), F.col("numeric_evidence"), F.col("percentage_evidence"), F.col("prestrain_evidence"), F.col("literal_evidence"), top),
    }).drop("percentage_evidence", "prestrain_evidence", "literal_evidence"), "status", "verdict", "reason", "evidence")


def check_pairs(pairs: DataFrame) -> DataFrame:
    """claim_support of rows that hold a claim and its abstract, dealt over the session's tasks."""
    return claim_support(with_claim_terms(with_evidence(dealt(pairs)))).drop("sentences", "clauses", "abstract_terms", *CLAIM_COLUMNS)
