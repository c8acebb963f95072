"""Numeric claims about each part: clauses, frames, suffixes and related evidence, with answers that its numbers decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import claims, evidence
from attesta.plans.corpus import table
from attesta.sources.shared import dealt

LIFE = "pump life above [t] cycles"
#: Abstract, claim, its clauses with a mark on those that a frame holds, whether they can support the claim, and the number of the
#: clause that is the evidence. [v] is the part's size, [t] a number by its key; a claim is supported where v is above t.
CASES = (
    ("Valve life was 99 cycles, pump life was [v] cycles.", LIFE, ("Valve life was 99 cycles", "pump life was [v] cycles."), True, 2),
    ("Valve life was 99 cycles and pump life was [v] cycles.", LIFE, ("Valve life was 99 cycles", "pump life was [v] cycles."), True, 2),
    ("Valve mass was 99 kg, pump life was [v] cycles.", LIFE, ("Valve mass was 99 kg, pump life was [v] cycles.",), True, 1),
    ("Under load, valve life was 99 cycles, pump life was [v] cycles.", LIFE, ("!Under load, valve life was 99 cycles, pump life was [v] cycles.",), False, 1),
    ("Pump life may reach [v] cycles.", LIFE, ("!Pump life may reach [v] cycles.",), False, 1),
    ("According to them pump life was [v] cycles.", LIFE, ("!According to them pump life was [v] cycles.",), False, 1),
    ("Pump life was [v] cycles after repair.", LIFE, ("!Pump life was [v] cycles after repair.",), False, 1),
    ("Average pump life was [v] cycles.", LIFE, ("!Average pump life was [v] cycles.",), False, 1),
    ("Film modulus was [v] GPa at room temperature.", "film modulus above [t] GPa", ("Film modulus was [v] GPa at room temperature.",), True, 1),
    ("Film modulus was [v] GPa at rest.", "film modulus above [t] GPa", ("!Film modulus was [v] GPa at rest.",), False, 1),
    ("In this study pump life was [v] cycles.", LIFE, ("In this study pump life was [v] cycles.",), True, 1),
    ("In mice pump life was [v] cycles.", LIFE, ("!In mice pump life was [v] cycles.",), False, 1),
    ("Nothing moved. The valve ran [v] cycles.", LIFE, ("Nothing moved", "The valve ran [v] cycles."), False, 2),
    ("Pump life was tested. Measurement gave [v] cycles.", LIFE, ("Pump life was tested", "Measurement gave [v] cycles."), True, 2),
    ("Pump life was at least [v] cycles; later it fell.", LIFE, ("Pump life was at least [v] cycles", "later it fell."), True, 1),
    ("Pump life was [v] patients.", LIFE, ("Pump life was [v] patients.",), False, 1),
)


def by_case(values: list[str]) -> Column:
    out = F
    for n, v in enumerate(values):
        out = out.when(F.col("p_partkey") % len(values) == n, F.lit(v))
    for mark in "vt":
        out = F.replace(out, F.lit(f"[{mark}]"), F.col(mark).cast("string")) if isinstance(out, Column) else out
    return out


def numeric_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses (a frame's with a mark), status and evidence of a numeric claim about each part (OP-51b, 53, 61, 62, 103, 112)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("v"), (F.col("p_partkey") * 7 % 50 + 1).cast("long").alias("t"))
    pairs = part.select("p_partkey", by_case([c[0] for c in CASES]).alias("abstract"), by_case([c[1] for c in CASES]).alias("claim"))
    found = claims.numeric_support(claims.with_claim_terms(evidence.with_evidence(dealt(pairs))))
    said = F.transform("clauses", lambda c: F.concat(F.when(c["framed"], "!").otherwise(""), c["clause"]))
    return found.select("p_partkey", "claim", F.array_join(said, " | ").alias("clauses"), F.col("numeric_status").alias("status"), F.col("numeric_evidence").alias("evidence"))


def sql_case(values: list[str]) -> str:
    cases = " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values))
    return f"replace(replace(CASE p_partkey % {len(values)} {cases} END, '[v]', v::VARCHAR), '[t]', t::VARCHAR)"


NUMERIC_CLAUSES = f"""
SELECT p_partkey, {sql_case([c[1] for c in CASES])} AS claim, {sql_case([' | '.join(c[2]) for c in CASES])} AS clauses,
    CASE WHEN v > t AND {sql_case([str(c[3]) for c in CASES])} = 'True' THEN 'SUPPORTED' ELSE 'PARTIAL' END AS status, {sql_case([c[2][c[4] - 1].lstrip('!') for c in CASES])} AS evidence
FROM (SELECT p_partkey, p_size::BIGINT AS v, (p_partkey * 7 % 50 + 1)::BIGINT AS t FROM part)
"""

QUERIES = {"numeric_clauses": numeric_clauses}
ORACLE_SQL = {"numeric_clauses": NUMERIC_CLAUSES}
