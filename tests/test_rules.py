"""Rules on rows written here: DOIs, units, comparators, frames, scopes, approximations, numeric claims and error codes (fixed examples)."""

from pyspark.sql import functions as F

from attesta.functions import quantities as q
from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.functions.doi import normalize_doi
from attesta.operators import claims, evidence, resolve

DOIS = [
    ("10.1000/abc.", "10.1000/abc"), ("https://doi.org/10.1000/ABC", "10.1000/abc"), ("doi: 10.1000/x);", "10.1000/x"), ("10.1000/a(b)c)", "10.1000/a(b)c"), ("10.1000/s0(1)", "10.1000/s0(1)"),
    ("10.1000%2Fx%28y%29", "10.1000/x(y)"), ("dx.doi.org/10.1/q:", "10.1/q"), ("", ""), (None, None),
]
UNITS = [("%", "%"), ("Percent", "%"), ("per cent", "%"), ("°C", "c"), ("degC", "c"), ("MV / m", "mv/m"), ("kΩ·cm", "kohm-cm"), ("cycles", "cycle"), ("patients", "person"), ("subject", "person"), ("samples", "sample"), ("GPa", "gpa"), ("mS/m", "ms/m"), ("g / L", "g/l")]
LEXED = [  # text before a number, text after it, the four comparators
    ("strain was", "", "exact", "exact", "exact", "exact"), ("strain >=", "", "gte", "gte", "gte", "gte"), ("strain ≤ ", "", "lte", "lte", "lte", "lte"), ("strain > ", "", "gt", "gt", "gt", "gt"), ("strain <", "", "lt", "lt", "lt", "lt"),
    ("strain of more than or equal to ", "", "gte", "gte", "gte", "exact"), ("strain of no more than ", "", "lte", "lte", "lte", "lte"), ("strain of no greater than ", "", "gt", "gt", "lte", "exact"), ("strain at least ", "", "gte", "gte", "gte", "gte"),
    ("strain up to ", "", "up_to", "up_to", "up_to", "up_to"), ("strain below ", "", "lt", "lt", "lt", "lt"), ("strain over ", "", "gt", "gt", "gt", "exact"), ("strain exceeding ", "", "gt", "exact", "gt", "exact"), ("strain reached ", "", "exact", "exact", "exact", "exact"),
    ("strain was ", " or more", "exact", "exact", "gte", "gte"), ("strain was ", ", maximum", "exact", "exact", "lte", "exact"), ("strain was ", "+", "exact", "exact", "gte", "exact"),
]
FRAMES = [
    ("strain was 5%", False, False), ("it is not clear", True, True), ("the authors claim success", True, True), ("if it works", True, False), ("no samples had strain", True, True), ("no strain had grown", False, True), ("estimated to be high", False, False),
    ("estimated to grow", True, False), ("It cannot", True, False), ("results suggest growth", True, True), ("possible use", True, False), ("average strain was 5%", False, True), ("strain was 5% after use", False, True), ("In mice strain was 5%", False, True),
    ("In the present study strain was 5%", False, False), ("field was 5 MV/m in a range", False, False),
]
SCOPES = [("at least five", False), ("at five", True), ("five at", True), ("at most at least", False), ("only then", True), ("whatever attic", False), ("under load", True), ("the mean", True), ("", False)]
APPROXIMATE = [("Strain reached about 5%", True), ("About a b 5%", True), ("About a b c 5%", False), ("Strain was ~ 5%", True), ("Strain was 5% or nearly so", True), ("Strain was 5%, very much or nearly so", False), ("Strain was 5%", False)]
NUMERIC = [
    ("Device efficiency reached 95%.", "device efficiency above 90%", "SUPPORTED"), ("The actuator survived 5000 cycles.", "actuator survived at least 4000 cycles", "SUPPORTED"), ("The pump ran at 3.2 V.", "pump ran at least 3 V", "SUPPORTED"),
    ("Valve life was 500 cycles, pump life was 900 cycles.", "valve life above 800 cycles", "PARTIAL"), ("Pump life may reach 900 cycles.", "pump life above 800 cycles", "PARTIAL"), ("The pump held 9 kg.", "pump held 9 g", "PARTIAL"), ("The pump is old.", "the pump is old", "NOT_NUMERIC"),
]
CODES = [("TIMEOUT,API_ERROR", False, "SOURCE_API_ERROR"), ("DOI_MISMATCH,TIMEOUT", False, "SOURCE_TIMEOUT"), ("DOI_MISMATCH,TIMEOUT", True, "DOI_MISMATCH"), ("UNSUPPORTED,NO_ABSTRACT", False, "NO_ABSTRACT"), ("UNSUPPORTED", True, "SOURCE_UNSUPPORTED"), ("NOT_FOUND,NOT_FOUND", True, "DOI_NOT_FOUND"), ("NOT_FOUND,NO_ABSTRACT", True, "NO_ABSTRACT"), ("RATE_LIMITED,NOT_FOUND", False, "SOURCE_RATE_LIMITED"), ("", True, "NO_ABSTRACT")]


def check(spark, columns, rows, *made):
    """The columns made of each row's first ones are its last ones."""
    d = spark.createDataFrame(rows, columns)
    given = len(d.columns) - len(made)
    found = d.select(*d.columns[:given], *made).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr)


def test_dois(spark):
    check(spark, "raw string, n string", DOIS, normalize_doi(F.col("raw")))


def test_units(spark):
    check(spark, "raw string, u string", UNITS, q.normalize_unit(F.col("raw")))


def test_comparators(spark):
    p, s = F.col("p"), F.col("s")
    made = [q.claimed_comparator(p, exceeding=True), q.claimed_comparator(p, exceeding=False), q.observed_percentage_comparator(p, s), q.observed_comparator(p, s)]
    check(spark, "p string, s string, a string, b string, c string, d string", LEXED, *made)


def test_frames(spark):
    check(spark, "t string, a boolean, b boolean", FRAMES, evidence.framed(tx.phrase(F.col("t"))), evidence.numeric_frame(F.col("t"), tx.spans(F.col("t"), vocab.MEASUREMENT)))


def test_scopes(spark):
    check(spark, "t string, s boolean", SCOPES, evidence.scoped(tx.phrase(F.col("t"))))


def test_approximations(spark):
    check(spark, "t string, a boolean", APPROXIMATE, evidence.percentage_spans(F.col("t"))[0]["limited"])


def test_numeric_claims(spark):
    d = evidence.with_evidence(spark.createDataFrame(NUMERIC, "abstract string, claim string, s string"))
    found = claims.numeric_support(claims.with_claim_terms(d)).select("abstract", "claim", "numeric_status").collect()
    assert sorted(map(tuple, found)) == sorted(NUMERIC)


def test_error_codes(spark):
    attempts = F.transform(F.filter(F.split("statuses", ","), lambda s: s != ""), lambda s: F.struct(s.alias("status")))
    check(spark, "statuses string, selected boolean, c string", CODES, resolve.final_error_code(attempts, F.col("selected")))


def test_a_shared_word_bound_changes_no_frame(spark):
    """Frames asked one by one and as one pattern say the same."""
    words = "no strain had been observed in authors claim that it may not seem to if possible unclaimed claims whether".split()
    rows = [(" ".join(words[(i * 7 + j * k) % len(words)] for j in range(6)),) for i in range(20) for k in range(1, 12)]
    d = spark.createDataFrame(rows, "p string")
    for whole, parts in ((evidence.CLAIM_FRAME, vocab.SHARED_FRAMES + vocab.CLAIM_FRAMES), (evidence.NUMERIC_FRAME, vocab.SHARED_FRAMES + vocab.NUMERIC_FRAMES)):
        one_by_one = F.lit(False)
        for x in parts:
            one_by_one = one_by_one | F.col("p").rlike(x)
        assert d.where(F.col("p").rlike(whole) != one_by_one).count() == 0
