"""DOIs as join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import is_ascii, let, strip, strip_column


def without_trailing_marks(text: Column) -> Column:
    """OP-31: trailing stops go, and closing brackets while they outnumber the opening ones.

    The tail of stops, brackets and blanks has no opening bracket, so as many of its closing ones go,
    from the right, as the whole text has in excess; it ends with the last that stays.
    """
    count = lambda s, mark: F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))

    def cut(x: Column) -> Column:
        whole, tail = x["whole"], x["tail"]
        stay = count(tail, ")") - F.greatest(F.lit(0), count(whole, ")") - count(whole, "("))
        kept = F.when(stay > 0, F.concat(F.call_function("substring_index", tail, F.lit(")"), stay), F.lit(")"))).otherwise("")
        return F.concat(F.substring(whole, F.lit(1), F.length(whole) - F.length(tail)), kept)

    with_tail = lambda w: F.struct(w.alias("whole"), F.regexp_extract(w, r"(?U)[.,;:)\s]*$", 0).alias("tail"))
    ends = r"(?U)[.,;:)\s]$"
    return let(strip(text), lambda w: F.when(w.rlike(ends), let(with_tail(w), cut)).otherwise(w))


def normalize_doi(raw: Column) -> Column:
    """OP-30: trimmed, case-folded, without resolver and label, percent-decoded, without trailing marks.

    Of letters whose case folding is not their lower case, \u00df, \u017f and \u03c2 are folded.
    """
    lower = lambda r: F.lower(strip_column(r))
    special = lambda r: F.replace(F.translate(lower(r), "\u017f\u03c2", "s\u03c3"), F.lit("\u00df"), F.lit("ss"))
    bare = lambda r: F.regexp_replace(F.when(is_ascii(r), lower(r)).otherwise(special(r)), r"^(?:https?://)?(?:dx\.)?doi\.org/", "")
    named = let(raw, lambda r: F.regexp_replace(bare(r), r"(?U)^doi:\s*", ""))
    return let(named, lambda b: without_trailing_marks(F.when(F.contains(b, F.lit("%")), decoded(b)).otherwise(b)))


def decoded(text: Column) -> Column:
    """Percent escapes as characters; what is no escape stays as it is."""
    escaped = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2b")), "%(?![0-9a-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(escaped), text)
