"""Claims against abstracts: worked examples, guards, comparators and batch handling."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import quantities as q
from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.operators import batch
from attesta.operators.claims import check_pairs, numeric_support, with_claim_terms
from attesta.operators.evidence import clause_texts, with_evidence
from attesta.operators.frequent import by_text
from attesta.operators.resolve import check_claims
from attesta.schemas import CLAIM, SOURCE_ANSWER
from attesta.sources.claims import ClaimFileError, detect_format, read_claims
from attesta.streaming.verdicts import joined_verdicts, stream_verdicts, windowed_summary, write_verdicts

STRAIN = "actuation strain above 100%"
# (abstract, claim, status, what the evidence or the reason holds)
EXAMPLES = [
    ("Actuated strains of up to 117% were shown with silicone, and up to 215% with acrylic.", STRAIN, "SUPPORTED", "117%"),
    ("Actuated strain reached 80% with silicone and 120% with acrylic.", STRAIN, "SUPPORTED", "120%"),
    ("Actuated strain reached 80% and actuated strain was 120%.", STRAIN, "PARTIAL", "does not explicitly"),
    ("Actuated strain remained below 50%. Actuated strains up to 60% were seen later.", "actuation strain below 50%", "PARTIAL", "does not explicitly"),
    ("Breakdown field rose at 500% pre-strain.", STRAIN, "PARTIAL", "pre-strain"),
    ("Device efficiency reached 80%, and response rate was 95%.", "device efficiency above 90%", "PARTIAL", "does not explicitly"),
    ("Device efficiency reached 95%.", "device efficiency above 90%", "SUPPORTED", "95%"),
    ("Device efficiency remained below 50%.", "device efficiency above 40%", "SUPPORTED", "50%"),
    ("The film had high thermal resistance (>220 °C).", "The film thermal resistance was 220 °C.", "PARTIAL", "explicitly"),
    ("The gel conductivity reached 5 S/m at 1 kHz.", "gel conductivity reached 5 S/m", "SUPPORTED", "5 S/m"),
    ("The device lifetime was 5000 cycles at 5 V.", "device lifetime was 5000 cycles", "PARTIAL", "explicitly"),
    ("We measured conductivity in wet polyimide. Measurements were taken to 30 °C.", "conductivity measurements reached 30 °C", "PARTIAL", "explicitly"),
    ("We measured conductivity in wet polyimide. Measurements reached 30 °C.", "conductivity measurements 30 °C", "SUPPORTED", "30 °C"),
    ("Healthy cells are stiffer than cancer cells.", "Cancer cells are stiffer than healthy cells.", "PARTIAL", "related"),
    ("Healthy cells are stiffer than cancer cells.", "healthy cells are stiffer than cancer cells", "SUPPORTED", "Healthy"),
    ("The authors reported that healthy cells are stiffer.", "healthy cells are stiffer", "PARTIAL", "related"),
    ("In mice, healthy cells are stiffer.", "healthy cells are stiffer", "PARTIAL", "related"),
    ("Healthy cells are stiffer in mice. Then healthy cells are stiffer healthy cells are stiffer.", "healthy cells are stiffer", "PARTIAL", "related"),
    ("Bread is good.", "quantum wells emit light", "PARTIAL", "The abstract does not explicitly"),
    ("  ", "anything at all", "PARTIAL", ""),
    ("", "anything at all", "UNVERIFIABLE", ""),
    (None, "anything at all", "UNVERIFIABLE", ""),
    ("Actuated strain reached about 117%.", STRAIN, "PARTIAL", "explicitly"), ("Actuated strain reached ~117%.", STRAIN, "PARTIAL", "explicitly"), ("Actuated strain may have reached 117%.", STRAIN, "PARTIAL", "explicitly"),
    ("Actuated strain of 117% was seen after annealing.", STRAIN, "PARTIAL", "explicitly"), ("Actuated strain was at least 117%.", STRAIN, "SUPPORTED", "117%"), ("Actuated strain rate rose by 117%.", STRAIN, "PARTIAL", "explicitly"),
    ("Actuated strain was 117% or more.", "actuation strain of 117%", "PARTIAL", "explicitly"), ("Actuated strain was 1,117.5 per cent.", "actuation strain above 1,000 percent", "SUPPORTED", "1,117.5"), ("Tensile strain hit 200%.", "tensile strain above 100%", "SUPPORTED", "200%"),
    ("x" * 20000 + " " + "word " * 5000 + "actuated strain reached 150%.", STRAIN, "SUPPORTED", "150%"),
]


def test_examples(spark):
    rows = [(i, a, c) for i, (a, c, _, _) in enumerate(EXAMPLES)]
    out = {r["i"]: r for r in check_pairs(spark.createDataFrame(rows, "i int, abstract string, claim string").repartition(3)).collect()}
    for i, (abstract, claim, status, holds) in enumerate(EXAMPLES):
        r = out[i]
        assert r["status"] == status and r["verdict"] == ("ACCEPT" if status == "SUPPORTED" else "WARN"), (abstract, claim, r)
        assert holds in r["evidence"] + r["reason"], (abstract, claim, r)


@pytest.mark.parametrize("word", ["reportedly", "not", "without doubt", "if", "average", "during tests", "under load", "approximately"])
def test_a_qualified_sentence_is_never_accepted(spark, word):
    good = "Actuated strain reached 117%."
    parts = {"not": "Actuated strain was not 117%.", "approximately": "Actuated strain reached approximately 117%."}
    bad = parts.get(word, good[:-1] + f" {word}.")
    out = {r["abstract"]: r["verdict"] for r in check_pairs(spark.createDataFrame([(good, STRAIN), (bad, STRAIN)], "abstract string, claim string")).collect()}
    assert out == {good: "ACCEPT", bad: "WARN"}


def test_numeric_result(spark):
    rows = [("The device ran. The device operated at 3 V.", "device operated at least 4 V"), ("No number here.", "device at 4 V"), ("Film was 3 V.", "no measurement")]
    df = numeric_support(with_claim_terms(with_evidence(spark.createDataFrame(rows, "abstract string, claim string"))))
    assert [(r["numeric_status"], r["numeric_evidence"]) for r in df.collect()] == [("PARTIAL", "The device operated at 3 V."), ("PARTIAL", "No number here."), ("NOT_NUMERIC", "")]


def test_clauses_and_spans(spark):
    text = "Strain was 5%, and stress was 3 MPa; load 2 N. Under load, 4 V, 5 V. The film, 5 V, the gel, 7 V"
    clauses = [r[0] for r in spark.createDataFrame([(text,)], "t string").select(F.explode(clause_texts(F.col("t"))["clause"])).collect()]
    assert clauses == ["Strain was 5%", "stress was 3 MPa", "load 2 N", "Under load, 4 V, 5 V", "The film", "5 V", "the gel", "7 V"]
    found = spark.createDataFrame([("é 5% and 1,200 per cent, 7percent, 12,5%",)], "t string").select(F.explode(tx.spans(F.col("t"), vocab.PERCENTAGE))).collect()
    assert [tuple(r[0]) for r in found] == [("5%", 2, 4), ("1,200 per cent", 9, 23)]


def test_matrices(spark):
    seen, said = ("exact", "up_to", "lt", "lte", "gt", "gte"), ("exact", "up_to", "lt", "lte", "gt", "gte")
    grid = [(v, a, 2.0, b) for v in (1.0, 2.0, 3.0) for a, b in itertools.product(seen, said)]
    c = [F.col(n) for n in "vatb"]
    out = spark.createDataFrame(grid, "v double, a string, t double, b string").select("*", q.entails_percentage(*c).alias("p"), q.entails_measurement(*c).alias("m"), q.contradicts(*c).alias("x")).collect()
    signs = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
    plain = lambda v, b, t: eval(f"{v} {signs.get(b, '==')} {t}")  # noqa: E731, S307
    for r in out:
        v, a, t, b = r["v"], r["a"], r["t"], r["b"]
        table = {
            "exact": plain(v, b, t), "up_to": b != "exact" and plain(v, b, t), "lt": b in ("lt", "lte") and v <= t, "lte": (b == "lt" and v < t) or (b == "lte" and v <= t),
            "gt": b in ("gt", "gte") and v >= t, "gte": (b == "gt" and v > t) or (b == "gte" and v >= t),
        }
        assert r["p"] == table[a]
        assert not (r["p"] and r["x"] and a == "exact")
        if b in ("exact", "up_to"):
            assert r["m"] == (v == t and (a == "exact" or a == b == "up_to"))
        else:
            assert r["m"] == (b in ("lt", "lte") and v <= t if a == "up_to" else plain(v, b, t))
    against = {(r["a"], r["b"]): {x["v"] for x in out if (x["a"], x["b"]) == (r["a"], r["b"]) and x["x"]} for r in out}
    assert against["exact", "lt"] == {2.0, 3.0} and against["gt", "lte"] == {2.0, 3.0} and against["gte", "lte"] == {3.0} and against["lt", "gte"] == {1.0, 2.0} and against["up_to", "gte"] == {1.0}
    assert against["exact", "exact"] == {1.0, 3.0} and against["gt", "exact"] == {2.0, 3.0} and against["gte", "up_to"] == {3.0} and against["lt", "gt"] == {1.0, 2.0} and against["gt", "gt"] == set()


def test_units(spark):
    pairs = {"Ω·cm": "ohm-cm", "Ω-cm": "ohm-cm", "kohm-cm": "kohm-cm", "MV / m": "mv/m", "°C": "c", "degC": "c", "C": "c", "%": "%", "per cent": "%", "Percent": "%", "cycles": "cycle", "patients": "person", "subject": "person", "samples": "sample", "devices": "device", "mS/m": "ms/m"}
    got = spark.createDataFrame([(k,) for k in pairs], "u string").select(q.normalize_unit(F.col("u")).alias("n")).collect()
    assert [r["n"] for r in got] == list(pairs.values())


ANSWERS = [("crossref", "10.1/a", ("10.1/a", "T", ["A"], 2020, "Device efficiency reached 95%.", "CrossRef", None, None), None, None)]


def test_batch(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    lines = ["", json.dumps({"id": 5, "doi": " 10.1/A ", "claim": "device efficiency above 90%", "note": "n", "x": 1}), "  ", json.dumps({"doi": "10.1/b", "claim": "c", "source": None, "id": True})]
    path.write_text("\n".join(lines))
    claims = read_claims(spark, str(path))
    assert [tuple(r) for r in claims.orderBy("row_number").select("row_number", "id", "doi", "claim", "source", "note").collect()] == [(2, "5", "10.1/A", "device efficiency above 90%", "auto", "n"), (4, "True", "10.1/b", "c", "auto", None)]
    results = check_claims(claims, spark.createDataFrame(ANSWERS, SOURCE_ANSWER)).cache()
    summary = batch.summarize(results)
    assert summary.first().asDict() == {"total": 2, "accept": 1, "warn": 1, "reject": 0, "partial": 0, "unverifiable": 1, "failed": 1}
    assert batch.summary_line(summary).first()[0] == "Summary: total=2 accept=1 warn=1 reject=0 partial=0 unverifiable=1 failed=1" and batch.exit_code(summary) == 2
    blocks = [r["block"] for r in batch.report_rows(results).orderBy("row_number").collect()]
    assert blocks[0].split("\n") == ["", "ACCEPT  5  10.1/A", "Claim: device efficiency above 90%", "Reason: The abstract explicitly reports a matching numeric claim.", "Evidence: Device efficiency reached 95%.", "Error code: CLAIM_SUPPORTED"]
    found = [json.loads(r["json"]) for r in batch.result_json(results).orderBy("row_number").collect()]
    assert found[0]["note"] == "n" and "note" not in found[1] and found[1]["abstract_source"] is None and found[0]["paper"]["doi"] == "10.1/a"
    labels = spark.createDataFrame([("5", False, True), ("True", True, False)], "id string, must_accept boolean, must_not_accept boolean")
    assert batch.gate(results, labels).first().asDict() == {"checked": 2, "safety_failures": 1, "pending": 1}


@pytest.mark.parametrize("text,error", [
    ('{"doi": "d", "claim": "c"}\n{bad', "Invalid JSON on line 2"), ("[1]", "Invalid row on line 1: expected object"), ('{"doi": 5, "claim": "c"}', "Missing required field on line 1: doi"),
    ('{"doi": "d", "claim": " "}', "Missing required field on line 1: claim"), ('{"doi": "d", "claim": "c", "source": "x"}', "Invalid field on line 1: source=x"), ("\n\n", "Input file does not contain any claim rows"),
])
def test_bad_lines(spark, tmp_path, text, error):
    path = tmp_path / "c.jsonl"
    path.write_text(text)
    with pytest.raises(ClaimFileError, match=error):
        read_claims(spark, str(path))


def test_csv(spark, tmp_path):
    path = tmp_path / "c.CSV"
    path.write_text('﻿doi, claim ,note\n 10.1/a,"a, ""b""\nc", x\n10.1/b,d,\n', encoding="utf-8")
    assert [tuple(r) for r in read_claims(spark, str(path)).orderBy("row_number").select("row_number", "doi", "claim", "source", "note").collect()] == [(2, "10.1/a", 'a, "b"\nc', "auto", "x"), (3, "10.1/b", "d", "auto", None)]
    path.write_text("doi,text\na,b\n")
    with pytest.raises(ClaimFileError, match="missing: claim"):
        read_claims(spark, str(path))


def test_formats():
    assert detect_format("x.JSONL") == "jsonl" and detect_format("x.txt", "csv") == "csv"
    for path, explicit in (("x.txt", None), ("x.csv", "xml")):
        with pytest.raises(ClaimFileError):
            detect_format(path, explicit)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from attesta.sources.claims import numbered_lines

    path = tmp_path / "many.jsonl"
    path.write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = numbered_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and all(r["value"] == f"line {r['line']}" for r in rows)


def test_stream(spark, tmp_path):
    claims = spark.createDataFrame([(i, None, "10.1/a", f"device efficiency above {n}%", "auto", None, f"2024-01-01 0{i}:00:00") for i, n in ((1, 90), (2, 99))], "row_number long, id string, doi string, claim string, source string, note string, at string").withColumn("at", F.to_timestamp("at"))
    claims.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in"))
    verdicts = stream_verdicts(stream, spark.createDataFrame(ANSWERS, SOURCE_ANSWER))
    write_verdicts(verdicts.select("row_number", "verdict", "error_code"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "ACCEPT", "CLAIM_SUPPORTED"), (2, "WARN", "CLAIM_NOT_EXPLICIT")]
    query = windowed_summary(verdicts, "at").writeStream.format("memory").queryName("sums").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("sums").agg(F.sum("accept"), F.sum("total")).first() == (1, 2)


def test_claims_and_answers_as_streams(spark, tmp_path):
    """Once drained, the verdicts of two streams are those of the tables; answers outside a claim's time do not count."""
    timed = lambda df, at: df.withColumn("at", F.to_timestamp(at))
    day = "2024-01-01 "
    said = [(1, "10.1/A", 90, "05:00"), (2, "https://doi.org/10.1/a", 99, "05:10"), (3, "10.1/none", 90, "05:20"), (4, "10.1/a", 90, "02:00"), (5, None, 90, "05:30"), *[(n, "10.1/a", n, "05:40") for n in range(80, 100)]]
    claims = timed(spark.createDataFrame([(i, None, doi, f"device efficiency above {n}%", "auto", None, day + t) for i, doi, n, t in said], CLAIM + ", t string"), "t").drop("t")
    answers = timed(spark.createDataFrame(ANSWERS, SOURCE_ANSWER), F.lit(day + "05:50"))
    # each stream's second file lets its watermark go on
    claims.write.parquet(str(tmp_path / "claims"))
    answers.write.parquet(str(tmp_path / "answers"))

    def drained(name: str) -> None:
        read = lambda df, folder: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
        out = joined_verdicts(read(claims, "claims"), read(answers, "answers"), keep="2 hours", salts=3)
        write_verdicts(out.select("row_number", "status", "verdict", "reason", "evidence", "error_code", "attempts"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    drained("first")
    timed(spark.createDataFrame([(1000, None, "10.1/z", "x", "auto", None)], CLAIM), F.lit("2024-02-01")).write.mode("append").parquet(str(tmp_path / "claims"))
    timed(spark.createDataFrame([(*ANSWERS[0][:1], "10.1/z", *ANSWERS[0][2:])], SOURCE_ANSWER), F.lit("2024-02-01")).write.mode("append").parquet(str(tmp_path / "answers"))
    drained("second")  # goes on from the checkpoint
    found = {r["row_number"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {r["row_number"]: r for r in check_claims(claims.drop("at"), answers.drop("at")).collect()}
    assert found.keys() == expected.keys()
    for n, r in found.items():
        if n == 4:  # answered three hours and more after it
            assert r["error_code"] == "ROW_CHECK_ERROR" and expected[n]["error_code"] != r["error_code"]
        else:
            assert all(r[c] == expected[n][c] for c in r.asDict())


def test_cli(spark, tmp_path, capsys):
    from attesta.cli import main

    answers = str(tmp_path / "answers")
    spark.createDataFrame(ANSWERS, SOURCE_ANSWER).write.parquet(answers)
    assert main(["check-claim", "10.1/A", "--claim", "device efficiency above 90%", "--json", "--answers", answers], spark) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["verdict"] == "ACCEPT" and shown["paper"]["title"] == "T" and shown["source_attempts"][0]["status"] == "FOUND"
    assert main(["verify-doi", "10.1/a", "--title", "T", "--first-author", "A", "--year", "2020", "--answers", answers], spark) == 0
    assert main(["verify-doi", "10.1/a", "--answers", answers], spark) == 2 and main(["verify-doi", "10.1/none", "--answers", answers], spark) == 1
    (tmp_path / "c.csv").write_text("doi,claim\n10.1/a,device efficiency above 90%\n")
    capsys.readouterr()
    assert main(["check-file", str(tmp_path / "c.csv"), "--answers", answers], spark) == 0
    assert capsys.readouterr().out.startswith("Summary: total=1 accept=1 ")
    assert main(["check-file", str(tmp_path / "c.csv"), "--json", "--answers", answers], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["accept"] == 1
    assert main(["check-file", str(tmp_path / "c.txt")], spark) == 1 and main([], spark) == 2


def test_several_claim_files(spark, tmp_path):
    """Line numbers go on through the files, in the order of their paths, and a later file's error names its own."""
    folder = tmp_path / "claims.jsonl"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"doi": "10.1/a", "claim": "x"}\n\n{"doi": "10.1/b", "claim": "y"}\n')
    (folder / "b.jsonl").write_text('{"doi": "10.1/c", "claim": "z"}\n{"doi": "10.1/d"}\n')
    rows = read_claims(spark, str(folder), strict=False).orderBy("row_number").collect()
    assert [(r["row_number"], r["doi"], r["error"]) for r in rows] == [(1, "10.1/a", None), (3, "10.1/b", None), (4, "10.1/c", None), (5, "10.1/d", "Missing required field on line 5: claim")]


def test_pairs_are_dealt_to_the_tasks_of_the_session(spark):
    one = spark.createDataFrame([("Actuated strain was 9%.", STRAIN)], "abstract string, claim string").coalesce(1)
    assert check_pairs(one).rdd.getNumPartitions() == 4


def test_a_document_computes_its_results_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    names = "id doi claim note status verdict reason evidence abstract_source error_code record attempts".split()
    results = spark.range(1, 9).select(F.col("id").alias("row_number"), *[F.lit("x").alias(n) for n in names]).withColumn("verdict", counted(F.lit("ACCEPT")))
    batch.write_document(results, str(tmp_path / "document"))
    found = json.loads("".join(f.read_text() for f in sorted((tmp_path / "document").glob("part-*"))))
    assert seen.value == 8
    assert [r["row_number"] for r in found["results"]] == list(range(1, 9)) and found["summary"]["accept"] == 8


@pytest.mark.parametrize("most", [0, 1, 10])
def test_frequent_texts_are_worked_on_once(spark, most):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(text):
        seen.add(text is not None)
        return f"<{text}>"

    texts = ["a"] * 50 + ["b"] * 40 + ["c", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    found = by_text(rows, "t", lambda d: d.withColumn("m", marked("t")), most=most)
    assert found.columns == ["i", "t", "m"]
    assert sorted(map(tuple, found.collect())) == [(i, t, f"<{t}>") for i, t in enumerate(texts)]
    assert seen.value <= {0: 91, 1: 42, 10: 3}[most]
