"""Claim files at any split size, ordered documents, and citations with repeated answers."""

import contextlib
import csv
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from attesta import cli
from attesta.functions import text as tx
from attesta.operators import batch, resolve
from attesta.operators.metadata import verify_citations
from attesta.schemas import PAPER
from attesta.sources import csvrecords
from attesta.sources.claims import ClaimFileError, parse_csv, read_claims

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def split_at(spark):
    def at(size):
        for name, value in zip(SIZES, (size, 1, 1), strict=True):
            spark.conf.set(name, value)

    yield at
    for name in SIZES:
        spark.conf.unset(name)


def odd_file(rng, end):
    values = ["10.1/a", 'q"uote', "a,b", "l1\nl2", "\n\n\n", '""', " lead", "é\r\nz", ""]
    rows = [["doi", "claim", "x"], *[[rng.choice(values) for _ in range(3)] for _ in range(120)]]
    rows.insert(5, ["big", "z\n" * 900, "end"])  # longer than a split
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue().replace("\n10.1/a,", "\n\n10.1/a,") + 'plain 5" pipe,x "y" z,  "quoted after blanks"\n'


def test_csv_records_at_any_split_size(spark, split_at, tmp_path):
    rng, want = random.Random(3), []
    for k, end in enumerate(("\n", "\r\n")):
        text = odd_file(rng, end)
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
        want += [(f"f{k}.csv", i, r) for i, r in enumerate(r for r in csv.reader(io.StringIO(text, newline=""), skipinitialspace=True) if r)]
    for size in (128, 1000, 1 << 20):
        split_at(size)
        got = csvrecords.csv_records(spark, str(tmp_path)).collect()
        assert sorted((r["file"].rsplit("/", 1)[1], r["record"], r["values"]) for r in got) == want
        assert sorted(r["row_number"] for r in got if r["record"]) == list(range(2, len(want)))  # goes on over both files


@pytest.mark.parametrize("line, quoted, want", [("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b"",c"', False, False), ('5" pipe,x', False, False), ('  "x', False, True), ("b", True, True), ('b",c', True, False), ('b"",c', True, True), ('b",""', True, False), ('b","', True, True), ("", True, True)])
def test_a_line_ends_in_quotes_or_outside(line, quoted, want):
    assert csvrecords.ends_quoted(line, quoted) is want


def test_csv_claims_with_odd_headers(spark, split_at, tmp_path):
    split_at(64)
    path = tmp_path / "c.csv"
    path.write_text('﻿id, doi ,claim,claim\n1,10.1/a,old,"new\nline"\n2,,x\n', encoding="utf-8")
    got = {r["row_number"]: r for r in parse_csv(spark, str(path)).collect()}
    assert (got[2]["id"], got[2]["doi"], got[2]["claim"], got[2]["error"]) == ("1", "10.1/a", "new\nline", None)
    assert got[3]["error"] == "Missing required field on line 3: doi"
    path.write_text("doi,note\n1,2\n")
    with pytest.raises(ClaimFileError, match="missing: claim"):
        parse_csv(spark, str(path))
    path.write_text("\n")
    with pytest.raises(ClaimFileError, match="header row"):
        read_claims(spark, str(path))


RESULT = "row_number long, id string, doi string, claim string, note string, status string, verdict string, reason string, evidence string, abstract_source string, error_code string, record string, attempts string"


def results(spark, n):
    rng = random.Random(n)
    rows = [(i, None, "10.1/x", f'say "{i}"\n', None if i % 2 else "n", "PARTIAL", rng.choice(["WARN", "ACCEPT"]), "r", "é", None, "NO_ABSTRACT", None, None) for i in range(2, n + 2)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, RESULT).repartition(5)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_document_in_parts(spark, tmp_path, n):
    found = results(spark, n)
    path = tmp_path / "doc"
    batch.write_document(found, str(path))
    whole = json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))
    assert [r["row_number"] for r in whole["results"]] == list(range(2, n + 2))
    assert whole["summary"]["total"] == n and whole["summary"] == batch.summarize(found).first().asDict()


@pytest.mark.parametrize("n", [0, 1, 3])
def test_printed_document_is_that_of_one_dump(n):
    rows = [{"b": [1, {"c": None}], "a": "x\ny"}] * n
    text = "\n".join(cli.document((json.dumps(r) for r in rows), {"total": n, "accept": 0}))
    assert text == json.dumps({"results": rows, "summary": {"accept": 0, "total": n}}, indent=2, sort_keys=True)


def test_repeated_answers_repeat_no_citation(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PER_TASK", 3)  # the cited DOI is dealt over several tasks
    cited = [("10.1/A.", "A Title", "J. Lee", 2020)] * 20 + [("10.1/b", "B", "Kim", 2021), (None, "C", "Kim", 2021)]
    record = lambda title: ("10.1/a", title, ["Lee"], 2020, None, None, None, None)
    answers = [("crossref", "10.1/a", record("A title"), None, None)] * 3 + [("crossref", "10.1/a", record("Z title"), None, None), ("openalex", "10.1/b", record("B"), None, None)]
    kind = f"source_name string, doi_norm string, record struct<{', '.join(f.replace(' ', ':', 1) for f in PAPER.split(', '))}>, error_status string, error_reason string"
    c = spark.createDataFrame(cited, "doi string, title string, first_author string, year int")
    for order in (answers, answers[::-1]):
        got = verify_citations(c, spark.createDataFrame(order, kind)).collect()
        assert sorted((r["doi"] or "", r["verdict"] or "") for r in got) == [("", ""), *[("10.1/A.", "PASS")] * 20, ("10.1/b", "")]


def test_csv_lines_are_read_twice_and_columns_from_a_file_are_trimmed_in_one_place(spark, tmp_path):
    """Once for the splits' ends, then for the records; what is torn is taken by its lines' places, not read by a worker again."""
    path = tmp_path / "c.csv"
    path.write_text('doi,claim\n10.1/a,"x\ny"\n')
    plan = read_claims(spark, str(path), strict=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and plan.count("regexp_replace") == 1


def test_the_end_of_a_split_from_either_beginning():
    """lines, lead, ends quoted, records and tail from a beginning outside and in quotes, and the first record."""
    end = lambda *lines: csvrecords.split_end(iter(lines), True)
    assert end("a,b", "c,d") == (2, 2, False, True, 2, 0, 2, 2, "a,b")
    assert end('a,"b', 'c",d', "", "e,f") == (4, 1, False, False, 2, 2, 4, 4, 'a,"b\nc",d')
    assert end('x"', "b", 'c,"d', "e") == (4, 1, True, True, 3, 2, 2, 2, 'x"')
    assert end('a,"b', "c") == (2, 1, True, False, 1, 1, 0, 2, None)
    assert end() == (0, 0, False, True, 0, 0, 0, 0, None)


def test_a_long_open_quote_is_one_record(spark, split_at, tmp_path):
    """Longer than Python's limit of a field, over many splits, up to the file's end."""
    split_at(10_000)
    path, long = tmp_path / "c.csv", "z, y\n" * 40_000
    path.write_text(f'doi,claim\n10.1/a,x\n10.1/b,"{long}')
    got = sorted(map(tuple, read_claims(spark, str(path), strict=False).select("row_number", "doi", "claim").collect()))
    assert got == [(2, "10.1/a", "x"), (3, "10.1/b", long.strip())]


def test_trimmed_as_before(spark):
    """A text between printable ASCII characters is not searched; all others are stripped as ever."""
    edges = [chr(c) for c in range(0x3100) if c] + ["", "a", "~", "\U0001f600"]
    texts = spark.createDataFrame([(t,) for e in edges for t in (e, f"{e}a", f"a{e}", f"{e}a b{e}")] + [(None,)], "t string")
    assert texts.where(~tx.strip_column(F.col("t")).eqNullSafe(tx.strip(F.col("t")))).count() == 0


def test_fields_of_json_lines_are_found_once(spark, tmp_path):
    """Each field's kind and text are in the plan once, and no method of it is too long for the JVM to compile."""
    path = tmp_path / "c.jsonl"
    path.write_text('{"doi": " 10.1/a ", "claim": "c", "id": true, "note": 1.5, "source": null}\n{"doi": 1, "claim": "c", "id": " "}\n')
    rows = read_claims(spark, str(path), strict=False)
    assert sorted(map(tuple, rows.select("id", "doi", "claim", "source", "note").collect()), key=repr) == [("True", "10.1/a", "c", "auto", "1.5"), (None, None, "c", "auto", None)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(out := io.StringIO()):
            read_claims(spark, str(path), strict=False).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000
