"""Units, comparators and what an observed quantity says about a claimed one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import let


def normalize_unit(unit: Column) -> Column:
    """OP-44. Units are compared in lower case, so mV and MV are one."""
    u = F.lower(F.translate(unit, "ΩΩω", "ΩΩΩ"))
    u = F.replace(F.regexp_replace(u, "ω", "ohm"), F.lit("·"), F.lit("-"))
    u = F.replace(F.regexp_replace(u, r"(?U)\s*/\s*", "/"), F.lit(" "), F.lit(""))
    return let(u, lambda u: (
        F.when(u.isin("%", "percent"), "%").when(u.isin("°c", "degc", "c"), "c").when(u.isin("cycle", "cycles"), "cycle")
        .when(u.isin("patient", "patients", "subject", "subjects"), "person").otherwise(F.regexp_replace(u, "s+$", ""))
    ))


def ladder(*steps: tuple[Column, str]) -> Column:
    """The value of the first step that holds, else 'exact'."""
    out = F
    for test, value in steps:
        out = out.when(test, value)
    return out.otherwise("exact")


def either(text: Column, cores: Sequence[str]) -> Column:
    """Does the text contain one of the cores? Many times cheaper than a pattern with word bounds, which only the few texts that do need."""
    out = F.contains(text, F.lit(cores[0]))
    for core in cores[1:]:
        out = out | F.contains(text, F.lit(core))
    return out


def claimed_comparator(text: Column, exceeding: bool) -> Column:
    """OP-80 (exceeding, the whole claim) and OP-81 (the claim before its number). The phrases are fixed values."""
    has = lambda t, p, *cores: either(t, cores) & t.rlike(r"(?U)\b(?:" + p + r")\b")
    return let(F.lower(text), lambda t: F.when(either(t, ("<", ">", "≥", "≤", "than", "least", "most", "up to", "below", "under", "above", "over", "exceed")), ladder(
        (either(t, (">=", "≥")), "gte"), (either(t, ("<=", "≤")), "lte"), (t.contains(">"), "gt"), (t.contains("<"), "lt"),
        (has(t, "(?:more|greater|higher) than or equal to", "than or equal to"), "gte"), (has(t, "(?:less|lower|fewer) than or equal to", "than or equal to"), "lte"),
        (has(t, "at least|not less than", "at least", "not less than"), "gte"), (has(t, "at most|no more than", "at most", "no more than"), "lte"),
        (has(t, "up to", "up to"), "up_to"), (has(t, "below|under|less than", "below", "under", "less than"), "lt"),
        (has(t, "above|over|greater than|more than|exceeded|exceeds" + "|exceeding" * exceeding, "above", "over", "greater than", "more than", "exceed"), "gt"),
    )).otherwise("exact"))


def ends(text: Column, words: str) -> Column:
    return text.rlike(r"(?U)\b(?:" + words + r")\s*$")


def symbol_steps(prefix: Column) -> list[tuple[Column, str]]:
    marks = ((">", "≥"), r"(?:>=|≥)", "gte"), (("<", "≤"), r"(?:<=|≤)", "lte"), ((">",), ">", "gt"), (("<",), "<", "lt")
    return [(either(prefix, cores) & prefix.rlike(rf"(?U){p}\s*$"), said) for cores, p, said in marks]


def observed_comparator(prefix: Column, suffix: Column) -> Column:
    """OP-83, of a measurement by the clause before and after it."""
    return let(sides(prefix, suffix), lambda x: measured_ladder(x["p"], x["s"]))


def sides(prefix: Column, suffix: Column) -> Column:
    return F.struct(F.lower(prefix).alias("p"), F.lower(suffix).alias("s"))


#: What a comparator before a number has in it, and one after it.
LEADING, TRAILING = ("<", ">", "≥", "≤", "than", "least", "most", "below", "under", "above", "over", "exceed", "reached", "survived", "maintained", "up to"), ("more", "greater", "higher", "min", "less", "fewer", "lower", "max", "+")


def stepped(p: Column, s: Column, before: list[tuple[Column, str]], after: list[tuple[Column, str]], late: list[tuple[Column, str]]) -> Column:
    """The first step that holds; those on either side are only tried where it has a comparator's word."""
    leads, trails = either(p, LEADING), either(s, TRAILING)
    return F.when(leads | trails, ladder(*[(leads & t, v) for t, v in before], *[(trails & t, v) for t, v in after], *[(leads & t, v) for t, v in late])).otherwise("exact")


def measured_ladder(p: Column, s: Column) -> Column:
    """The phrases are fixed values."""
    return stepped(p, s, [
        *symbol_steps(p), (ends(p, "at least|not less than"), "gte"), (ends(p, "at most|no more than"), "lte"), (ends(p, "below|under|less than"), "lt"),
        (ends(p, "above|over|greater than|more than|exceeded|exceeds|reached|survived|maintained"), "exact"), (ends(p, "up to"), "up_to"),
    ], [
        (s.rlike(r"(?U)^\s*(?:or\s+)?(?:more|greater|higher|min|minimum)\b"), "gte"), (s.rlike(r"(?U)^\s*(?:or\s+)?(?:less|fewer|lower|max|maximum)\b"), "lte"),
    ], [])


def observed_percentage_comparator(prefix: Column, suffix: Column) -> Column:
    """OP-82, of a percentage by its clause before it, and the clause and sentence after it."""
    return let(sides(prefix, suffix), lambda x: percentage_ladder(x["p"], x["s"]))


def percentage_ladder(p: Column, s: Column) -> Column:
    """The phrases are fixed values."""
    return stepped(p, s, [
        *symbol_steps(p), (ends(p, "no (?:more|greater|higher) than|(?:less|lower|fewer) than or equal to"), "lte"), (ends(p, "no (?:less|lower|fewer) than|(?:more|greater|higher) than or equal to"), "gte"),
        (ends(p, "at least|not less than"), "gte"), (ends(p, "at most|no more than"), "lte"),
    ], [
        (s.rlike(r"(?U)^\s*\+"), "gte"), (s.rlike(r"(?U)^\s*[,;:]?\s*(?:or\s+)?(?:more|greater|higher|min|minimum)\b"), "gte"), (s.rlike(r"(?U)^\s*[,;:]?\s*(?:or\s+)?(?:less|fewer|lower|max|maximum)\b"), "lte"),
    ], [
        (ends(p, "up to"), "up_to"), (ends(p, "below|under|less than"), "lt"), (ends(p, "above|over|greater than|more than|exceeded|exceeds|exceeding"), "gt"),
    ])


def compared(v: Column, cmp: Column, t: Column) -> Column:
    """v against the claimed t by the claim's comparator; exact and up_to ask for equality."""
    return F.when(cmp == "lt", v < t).when(cmp == "lte", v <= t).when(cmp == "gt", v > t).when(cmp == "gte", v >= t).otherwise(v == t)


def entails_percentage(v: Column, seen: Column, t: Column, said: Column) -> Column:
    """Matrix A (OP-84): does an observed percentage `seen v` entail the claimed `said t`?"""
    down, up = said.isin("lt", "lte"), said.isin("gt", "gte")
    return (
        F.when(seen == "exact", compared(v, said, t)).when(seen == "up_to", (said != "exact") & compared(v, said, t))
        .when(seen == "lt", down & (v <= t)).when(seen == "lte", down & compared(v, said, t))
        .when(seen == "gt", up & (v >= t)).when(seen == "gte", up & compared(v, said, t)).otherwise(F.lit(False))
    )


def entails_measurement(v: Column, seen: Column, t: Column, said: Column) -> Column:
    """Matrix B (OP-85): the same for measurements, whose bounds count as values in inequalities."""
    return F.when(seen == "up_to", F.when(said == "up_to", v == t).otherwise(said.isin("lt", "lte") & (v <= t))).when(said.isin("exact", "up_to"), (seen == "exact") & (v == t)).otherwise(compared(v, said, t))


def contradicts(v: Column, seen: Column, t: Column, said: Column) -> Column:
    """Matrix C (OP-86): does an observed percentage rule the claimed one out?"""
    most = seen.isin("lte", "up_to")
    return (
        F.when(said == "lt", seen.isin("exact", "gt", "gte", "up_to") & (v >= t))
        .when(said == "lte", (seen.isin("exact", "gte", "up_to") & (v > t)) | ((seen == "gt") & (v >= t)))
        .when(said == "gt", (seen.isin("exact", "lt") | most) & (v <= t))
        .when(said == "gte", ((seen == "exact") & (v < t)) | ((seen == "lt") & (v <= t)) | (most & (v < t)))
        .otherwise(((seen == "exact") & (v != t)) | ((seen == "lt") & (v <= t)) | (most & (v < t)) | ((seen == "gt") & (v >= t)) | ((seen == "gte") & (v > t)))
    )
