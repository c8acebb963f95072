"""What an abstract offers as evidence, once for each abstract and whatever the claim.

Sentences, clauses, quantities and all guards that do not look at the claim are arrays of structs
beside the abstract. Claims then join papers once and only compare small arrays, with no further
shuffle; the same columns serve a stream of claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.functions.quantities import normalize_unit, observed_comparator, observed_percentage_comparator

CLAIM_FRAME = tx.any_of(vocab.SHARED_FRAMES + vocab.CLAIM_FRAMES)
NUMERIC_FRAME = tx.any_of(vocab.SHARED_FRAMES + vocab.NUMERIC_FRAMES)
#: Scope words; "at least" and "at most" are none (OP-63).
SCOPE = r"\b(?:at(?! (?:least|most)\b)|" + "|".join(w for w in vocab.SCOPE_WORDS if w != "at") + r")\b"
APPROXIMATION = "(?:" + "|".join(vocab.APPROXIMATION_WORDS) + ")"


def framed(phrase: Column) -> Column:
    """OP-60, on a phrase."""
    return phrase.rlike(CLAIM_FRAME)


def scoped(phrase: Column) -> Column:
    return phrase.rlike(SCOPE)


def prestrain(text: Column) -> Column:
    """OP-68."""
    return F.lower(text).rlike("pre-strain|prestrain")


def non_output_compound(stems: Column) -> Column:
    """Strain energy, rate or localisation, in the row of stems (OP-70)."""
    return F.array_join(stems, " ").rlike("(?:^| )strain (?:" + "|".join(vocab.NON_OUTPUT_FOLLOWERS) + ")(?: |$)")


def array_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def percentage_spans(sentence: Column) -> Column:
    """Each percentage of a sentence with its clause and the guards on it (OP-54, 56, 57, 64-68, 70, 76, 82)."""

    def place(span: Column) -> Column:
        left, right = tx.before(sentence, span), tx.after(sentence, span)
        context = F.concat(F.element_at(F.split(left, vocab.CONTEXT_BREAK, -1), -1), span["match"], F.element_at(F.split(right, vocab.CONTEXT_BREAK, -1), 1))
        return F.struct(span["match"].alias("match"), span["start"].alias("start"), span["end"].alias("end"), left.alias("left"), right.alias("right"), context.alias("context"))

    def split_context(p: Column) -> Column:
        # comparator and qualifiers go by the first percentage of the clause
        halves = F.split(p["context"], vocab.PERCENTAGE, 2)
        tail = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        return F.struct(
            tx.value_of(F.regexp_extract(p["match"], vocab.NUMBER, 0)).alias("value"), p["context"].alias("context"), p["start"].alias("start"), p["end"].alias("end"), p["left"].alias("left"),
            tx.phrase(p["left"]).alias("left_phrase"), tx.phrase(p["right"]).alias("right_phrase"), tx.claim_stems(p["context"]).alias("stems"),
            observed_percentage_comparator(F.element_at(halves, 1), F.concat_ws(" ", tail, p["right"])).alias("cmp"), F.array_distinct(tx.claim_stems(tail)).alias("tail_stems"),
        )

    def guard(p: Column) -> Column:
        approximate = p["left"].rlike(r"(?U)[" + vocab.APPROXIMATION_SYMBOLS + r"]\s*$") | p["left_phrase"].rlike(r"\b" + APPROXIMATION + r"(?: \S+){0,2}$") | p["right_phrase"].rlike("^(?:[^ ]+ ){0,2}" + APPROXIMATION + r"\b")
        stems = F.array_distinct(p["stems"])
        return F.struct(
            p["value"].alias("value"), p["cmp"].alias("cmp"), p["context"].alias("context"), p["start"].alias("start"), p["end"].alias("end"),
            prestrain(p["context"]).alias("prestrain"), framed(tx.phrase(p["context"])).alias("framed"), (scoped(p["left_phrase"]) | scoped(p["right_phrase"]) | approximate).alias("limited"),
            stems.alias("terms"), non_output_compound(p["stems"]).alias("compound"), F.arrays_overlap(stems, array_of(vocab.STRAIN_QUALIFIERS)).alias("strain_qualified"),
            F.arrays_overlap(stems, array_of(vocab.UNRELATED_SUBJECTS)).alias("unrelated"), F.array_except(p["tail_stems"], array_of(vocab.GENERIC_QUALIFIERS)).alias("qualifiers"),
        )

    return F.transform(F.transform(F.transform(tx.spans(sentence, vocab.PERCENTAGE), place), split_context), guard)


def sentence_evidence(abstract: Column) -> Column:
    def of(s: Column, i: Column) -> Column:
        terms = F.array_distinct(tx.claim_stems(s))
        words = tx.phrase(s)
        return F.struct(
            i.alias("idx"), s.alias("text"), terms.alias("terms"), words.alias("phrase"), tx.numbers(s).alias("numbers"), framed(words).alias("framed"),
            scoped(F.regexp_extract(words, r"^\S+(?: \S+)?", 0)).alias("scope_start"), (F.array_contains(terms, "actuat") & F.array_contains(terms, "strain")).alias("actuation"),
            F.when(s.rlike("(?U)[0-9].*(?:%|(?i:cent))|\\d"), percentage_spans(s)).otherwise(F.expr("cast(array() as " + SPANS + ")")).alias("spans"),
        )

    return F.transform(tx.sentences(abstract), of)


SPANS = "array<struct<value:double,cmp:string,context:string,start:int,end:int,prestrain:boolean,framed:boolean,limited:boolean,terms:array<string>,compound:boolean,strain_qualified:boolean,unrelated:boolean,qualifiers:array<string>>>"


def comma_clauses(part: Column) -> Column:
    """OP-53: commas separate clauses where a unit repeats, but not after a leading scope word."""

    def split(pieces: Column) -> Column:
        units = F.flatten(F.transform(pieces, lambda p: F.transform(F.regexp_extract_all(p, F.lit(vocab.MEASUREMENT), 2), normalize_unit)))
        leading = F.lower(F.element_at(pieces, 1)).rlike(r"(?U)^(?:" + "|".join(vocab.LEADING_SCOPES) + r")(?:\s|$)")
        repeats = tx.let(units, lambda u: F.size(u) != F.size(F.array_distinct(u)))
        return F.when((F.size(pieces) > 1) & ~leading & repeats, pieces).otherwise(F.array(tx.strip(part)))

    return tx.let(F.filter(F.transform(F.split(part, ",", -1), tx.strip), lambda p: p != ""), split)


def numeric_frame(clause: Column, measures: Column) -> Column:
    """OP-61, OP-62, for a clause and its measurement spans."""
    averaged = F.exists(measures, lambda m: tx.letters(tx.before(clause, m)).rlike(tx.words_pattern(vocab.AGGREGATES)))

    def disqualified(m: Column) -> Column:
        suffix = tx.letters(tx.after(clause, m))
        unit = normalize_unit(F.regexp_extract(m["match"], "(?iU)^" + vocab.NUMBER + r"\s*(.*)$", 1))
        condition = unit.isin(vocab.PHYSICAL_UNITS) & suffix.rlike(tx.words_pattern(vocab.CONDITION_TERMS))
        return suffix.rlike(tx.words_pattern(vocab.NUMERIC_SUFFIXES)) & ~condition

    words = tx.letters(clause)
    leading = words.rlike(r"^(?:\S+ )?(?:" + "|".join(vocab.LEADING_SCOPES) + r")(?: |$)") & ~words.rlike(vocab.STUDY_INTRO)
    return tx.phrase(clause).rlike(NUMERIC_FRAME) | averaged | F.exists(measures, disqualified) | leading


def clause_texts(abstract: Column) -> Column:
    """(clause, previous sentence) in document order (OP-51, OP-104)."""
    parts = F.filter(F.transform(F.split(tx.strip(abstract), vocab.CLAUSE_BREAK, -1), tx.strip), lambda s: s != "")
    each = lambda s: F.filter(F.transform(F.split(s, vocab.CONJUNCTION_BREAK, -1), tx.strip), lambda p: p != "")
    with_before = tx.let(parts, lambda all_parts: F.transform(all_parts, lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(all_parts, i - 1), F.lit("")).alias("before"))))
    return F.flatten(F.transform(with_before, lambda x: F.transform(F.flatten(F.transform(each(x["s"]), comma_clauses)), lambda c: F.struct(c.alias("clause"), x["before"].alias("before")))))


def clause_evidence(clauses: Column) -> Column:
    """Clauses with subject terms and measurements, from `clause_texts` (OP-52, 55, 57, 61, 83)."""

    def spanned(x: Column) -> Column:
        anaphoric = F.get(tx.numeric_tokens(x["clause"]), F.lit(0)).isin("measurement", "measurements") & (x["before"] != "")
        subject = F.when(anaphoric, F.concat_ws(" ", x["before"], x["clause"])).otherwise(x["clause"])
        return F.struct(x["clause"].alias("clause"), tx.numeric_stems(subject).alias("terms"), tx.spans(x["clause"], vocab.MEASUREMENT).alias("found"))

    def measure(clause: Column, m: Column) -> Column:
        value, unit = F.regexp_extract(m["match"], "(?U)^" + vocab.NUMBER, 0), F.regexp_extract(m["match"], "(?U)^" + vocab.NUMBER + r"\s*(.*)$", 1)
        return F.struct(tx.value_of(value).alias("value"), normalize_unit(unit).alias("unit"), observed_comparator(tx.before(clause, m), tx.after(clause, m)).alias("cmp"))

    return F.transform(F.transform(clauses, spanned), lambda x: F.struct(x["clause"].alias("clause"), x["terms"].alias("terms"), numeric_frame(x["clause"], x["found"]).alias("framed"), F.transform(x["found"], lambda m: measure(x["clause"], m)).alias("measures")))


def with_evidence(papers: DataFrame, abstract: str = "abstract") -> DataFrame:
    """papers with the columns sentences, clauses and abstract_terms; empty arrays where there is no abstract."""
    whole = F.coalesce(F.col(abstract), F.lit(""))
    staged = papers.withColumn("_clauses", clause_texts(whole))
    return staged.withColumn("sentences", sentence_evidence(whole)).withColumn("clauses", clause_evidence(F.col("_clauses"))).withColumn("abstract_terms", F.array_distinct(tx.claim_stems(whole))).drop("_clauses")
