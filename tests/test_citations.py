"""DOIs, metadata, payload parsers and the choice of a source."""

import json
import os
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions.doi import normalize_doi
from attesta.operators.metadata import verify_citations, verify_metadata
from attesta.operators.resolve import check_claims
from attesta.plans import queries
from attesta.schemas import CLAIM, PAPER, SOURCE_ANSWER
from attesta.sources import live, parsers


def test_normalize_doi(spark):
    pairs = [
        (" HTTPS://DX.DOI.org/10.1000/ABC. ", "10.1000/abc"), ("doi: 10.1000/x;", "10.1000/x"), ("10.1000/a(b)c", "10.1000/a(b)c"), ("(10.1000/x)).", "(10.1000/x)"), ("10.1000/x).,;", "10.1000/x"),
        ("10.1000%2Fabc%28d%29", "10.1000/abc(d)"), ("10.1000/a+b", "10.1000/a+b"), ("10.1/%zz", "10.1/%zz"), ("doi.org/10.1/x", "10.1/x"), ("", ""), (" .; ", ""), ("10.1/x . ) ", "10.1/x"), (None, None),
    ]
    got = spark.createDataFrame([(a,) for a, _ in pairs], "a string").select(normalize_doi(F.col("a")).alias("n")).collect()
    assert [r["n"] for r in got] == [b for _, b in pairs]


RECORD = ("10.1000/x", "Growth of β-sheets in 1,200 cells", ["García", "Lee"], 2020, None, "CrossRef", None, None)


@pytest.mark.parametrize("given,mismatches,verdict", [
    (("10.1000/X.", "growth of beta sheet in 1,200 cell", "M. Garcia", 2020), [], "PASS"),
    (("10.1000/x", "Growth of alpha-sheets in 1200 cells", "Garcia", 2020), ["title"], "REJECT"),
    (("10.1000/x", "Growth of beta-sheets in 1201 cells", "Garcia", 2020), ["title"], "REJECT"),
    (("10.1000/y", None, None, 1999), ["doi", "metadata", "year"], "REJECT"),
    (("10.1000/x", "Growth of β-sheets in 1,200 cells", "Garcia", 2021), ["year"], "WARN"),
    (("10.1000/x", "Growth of β-sheets in 1,200 cells", "", None), ["metadata"], "WARN"),
    (("10.1000/x", "Growth of β-sheets in 1,200 cells", "Garcia-Lopez", None), ["first_author"], "REJECT"),
    (("10.1000/x", "Growth of β-sheets in 1,200 cells", "王", None), ["first_author"], "REJECT"),
])
def test_metadata(spark, given, mismatches, verdict):
    df = spark.createDataFrame([(*given, RECORD)], f"doi string, title string, first_author string, year int, fetched struct<{', '.join(f.replace(' ', ':', 1) for f in PAPER.split(', '))}>")
    row = verify_metadata(df).first()
    assert (row["mismatches"], row["verdict"]) == (mismatches, verdict)


def test_group_authors(spark):
    schema = f"doi string, title string, first_author string, year int, fetched struct<{', '.join(f.replace(' ', ':', 1) for f in PAPER.split(', '))}>"
    group = (*RECORD[:2], ["ATLAS Collaboration"], *RECORD[3:])
    rows = [("10.1000/x", RECORD[1], name, 2020, group) for name in ("Atlas collaboration", "CMS Collaboration", "Collaboration")]
    assert [r["verdict"] for r in verify_metadata(spark.createDataFrame(rows, schema)).collect()] == ["PASS", "REJECT", "REJECT"]


def parse(spark, source, payload):
    return spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),)], "p string").select(parsers.PARSERS[source](F.col("p")).alias("r")).first()["r"]


def test_crossref(spark):
    message = {
        "DOI": "10.1/X", "title": [" A title "], "author": [{"family": "Lee"}, {"name": "Some Group"}, {"given": "x"}], "container-title": ["J"], "URL": "https://doi.org/10.1/x",
        "created": {"date-parts": [[1999]]}, "issued": {"date-parts": [[2018]]}, "published-online": {"date-parts": [[2019, 2]]}, "abstract": "<jats:p>Rates &lt; 5 &amp; more</jats:p>\n<p>end</p>",
    }
    r = parse(spark, "crossref", message)
    assert (r["doi"], r["title"], r["authors"], r["year"], r["journal"], r["abstract"]) == ("10.1/X", "A title", ["Lee", "Some Group"], 2019, "J", "Rates < 5 & more end")
    bare = parse(spark, "crossref", {"title": [], "created": {"date-parts": [[1999]]}})
    assert (bare["doi"], bare["title"], bare["authors"], bare["year"], bare["abstract"]) == ("", "[title missing]", [], None, None)


def test_openalex(spark):
    work = {"doi": "https://doi.org/10.1/Y", "id": "https://o/1", "title": "T", "publication_year": 2021, "authorships": [{"author": {"display_name": "A B"}}, {"author": {}}], "primary_location": {"source": {"display_name": "J"}}, "abstract_inverted_index": {"of": [1], "(": [3], "Loss": [0], "5": [4], "%": [5], ")": [6], "mass": [2], ".": [7]}}
    r = parse(spark, "openalex", work)
    assert (r["doi"], r["abstract"], r["authors"], r["year"], r["journal"]) == ("10.1/y", "Loss of mass (5%).", ["A B"], 2021, "J")
    assert parse(spark, "openalex", work | {"abstract_inverted_index": {}}) is None and parse(spark, "openalex", work | {"doi": " "}) is None


def test_semantic_scholar(spark):
    paper = {"title": "T", "abstract": " words ", "year": 2020, "venue": "V", "url": "u", "authors": [{"name": "A"}, {}], "externalIds": {"DOI": "10.1/Z"}}
    r = parse(spark, "semantic_scholar", paper)
    assert (r["doi"], r["abstract"], r["authors"]) == ("10.1/Z", "words", ["A"])
    assert parse(spark, "semantic_scholar", paper | {"externalIds": {}}) is None and parse(spark, "semantic_scholar", paper | {"abstract": None}) is None


def test_pubmed(spark):
    xml = """<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2017 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal>
    <ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">To <i>see</i> more.</AbstractText><AbstractText> And
    less.</AbstractText></Abstract><AuthorList><Author><LastName>Kim</LastName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
    <ELocationID EIdType="doi">10.1/P</ELocationID></Article></MedlineCitation></PubmedArticle></Set>"""
    r = parse(spark, "pubmed", xml)
    assert (r["doi"], r["abstract"], r["authors"], r["year"], r["journal"], r["url"]) == ("10.1/P", "AIM: To see more. And less.", ["Kim", "Group"], 2017, "J", "https://pubmed.ncbi.nlm.nih.gov/7/")
    assert parse(spark, "pubmed", "<Set/>") is None and parse(spark, "pubmed", "not xml") is None


def record(doi, abstract, source="s"):
    return (doi, "T", ["A"], 2020, abstract, source, None, None)


SAYS = "Device efficiency reached 95%."


def test_fallback(spark):
    answers = [("crossref", f"10.1/{c}", record(f"10.1/{c}", SAYS if c == "a" else None), None, None) for c in "abcdefg"]
    answers += [("crossref", "10.1/m", record("10.1/other", SAYS), None, None)]
    answers += [("openalex", "10.1/b", record("10.1/b", SAYS), None, None), ("pubmed", "10.1/c", record("10.1/C", SAYS), None, None), ("openalex", "10.1/c", record("10.1/zzz", SAYS), None, None), ("semantic_scholar", "10.1/c", None, None, None)]
    answers += [("openalex", "10.1/d", None, "TIMEOUT", ""), ("semantic_scholar", "10.1/d", None, "RATE_LIMITED", "slow"), ("openalex", "10.1/e", None, "API_ERROR", "boom"), ("pubmed", "10.1/f", None, "UNSUPPORTED", "many"), ("pubmed", "10.1/g", record("10.1/q", SAYS), None, None)]
    claims = [
        (1, "10.1/A", "auto"), (2, "10.1/b", "auto"), (3, "10.1/c", "auto"), (4, "10.1/d", "auto"), (5, "10.1/e", "auto"), (6, "10.1/f", "auto"), (7, "10.1/m", "auto"), (8, "10.1/nowhere", "auto"),
        (9, "10.1/b", "crossref"), (10, "10.1/f", "pubmed"), (11, "10.1/nowhere", "openalex"), (12, "10.1/g", "pubmed"), (13, "10.1/c", "semantic-scholar"), (14, "10.1/c", "pubmed"),
    ]
    df = spark.createDataFrame([(n, None, d, "device efficiency above 90%", s, None) for n, d, s in claims], CLAIM)
    out = {r["row_number"]: r for r in check_claims(df, spark.createDataFrame(answers, SOURCE_ANSWER)).collect()}
    statuses = {n: [(a["source"], a["status"]) for a in r["attempts"]] for n, r in out.items()}
    codes = {n: r["error_code"] for n, r in out.items()}
    assert statuses[1] == [("crossref", "FOUND")] and statuses[2] == [("crossref", "NO_ABSTRACT"), ("openalex", "FOUND")]
    assert statuses[3] == [("crossref", "NO_ABSTRACT"), ("openalex", "DOI_MISMATCH"), ("semantic_scholar", "NO_ABSTRACT"), ("pubmed", "FOUND")]
    assert statuses[4] == [("crossref", "NO_ABSTRACT"), ("openalex", "TIMEOUT"), ("semantic_scholar", "RATE_LIMITED"), ("pubmed", "NOT_FOUND")]
    assert statuses[7] == [("crossref", "DOI_MISMATCH")] and statuses[8] == [] and statuses[9] == [("crossref", "NO_ABSTRACT")]
    assert statuses[14] == [("pubmed", "FOUND")] and out[14]["abstract_source"] == "pubmed"
    assert codes == {1: "CLAIM_SUPPORTED", 2: "CLAIM_SUPPORTED", 3: "CLAIM_SUPPORTED", 4: "SOURCE_TIMEOUT", 5: "SOURCE_API_ERROR", 6: "NO_ABSTRACT", 7: "DOI_MISMATCH", 8: "ROW_CHECK_ERROR", 9: "NO_ABSTRACT", 10: "SOURCE_UNSUPPORTED", 11: "DOI_NOT_FOUND", 12: "DOI_MISMATCH", 13: "NO_ABSTRACT", 14: "CLAIM_SUPPORTED"}
    assert out[7]["reason"] == "Fetched DOI does not match the requested DOI." and out[8]["reason"].startswith("Row could not be checked: ")
    assert out[4]["attempts"][1]["reason"] == "Source lookup timed out."
    skipped = check_claims(df.where("row_number = 1"), spark.createDataFrame(answers, SOURCE_ANSWER), use_crossref_abstract=False).first()
    assert skipped["attempts"][0]["status"] == "UNSUPPORTED"


def test_verify_citations(spark):
    answers = spark.createDataFrame([("crossref", "10.1000/x", RECORD, None, None)], SOURCE_ANSWER)
    given = spark.createDataFrame([("doi:10.1000/X", RECORD[1], "Garcia", 2020), ("10.9/none", "t", "a", 1)], "doi string, title string, first_author string, year int")
    assert [r["verdict"] for r in verify_citations(given, answers).orderBy("year", ascending=False).collect()] == ["PASS", None]


def test_live_answers_never_raise():
    import urllib.error

    calls = []

    def refused(url, headers, timeout):
        calls.append(url)
        raise urllib.error.HTTPError(url, 429, "slow", {}, None)

    def absent(url, headers, timeout):
        raise urllib.error.HTTPError(url, 404, "none", {}, None)

    def late(url, headers, timeout):
        raise TimeoutError

    live.fetch_semantic_scholar.__defaults__ = (0.0,)
    assert live.ask("semantic_scholar", "10.1/a b", refused)[3:] == ("RATE_LIMITED", "Semantic Scholar rate limit exceeded.") and len(calls) == 2 and "DOI:10.1%2Fa%20b" in calls[0]
    assert live.ask("openalex", "d", absent)[3] == "NOT_FOUND" and live.ask("crossref", "d", absent)[3] == "API_ERROR"
    assert live.ask("pubmed", "d", late)[3:] == ("TIMEOUT", "Source lookup timed out.")
    assert live.ask("pubmed", "d", lambda *a: '{"esearchresult": {"idlist": ["1", "2"]}}')[3] == "UNSUPPORTED"
    assert live.ask("pubmed", "d", lambda *a: '{"esearchresult": {"idlist": []}}')[3] == "NOT_FOUND"
    assert live.ask("crossref", "d", lambda *a: '{"message": {"DOI": "d"}}')[2:] == ('{"DOI": "d"}', None, None)


def test_live_paths(tmp_path):
    """Every line of every file is asked for once, wherever files are cut."""
    (tmp_path / "a.txt").write_text("10.1/a\n10.1/b\n\n10.1/long" + "x" * 50 + "\n10.1/c")
    (tmp_path / "b.txt").write_text("10.1/d\n")
    for step in (3, 7, 1000):
        reader = live.Reader({"path": str(tmp_path), "partitionbytes": str(step)})
        found = [d for p in reader.partitions() for d in reader.dois_of(p)]
        assert sorted(found) == sorted(["10.1/a", "10.1/b", "10.1/long" + "x" * 50, "10.1/c", "10.1/d"])
    assert [d for p in live.Reader({"dois": "x y z", "partitions": "2"}).partitions() for d in p.dois] == ["x", "z", "y"]


def test_dois_with_odd_escapes_and_cases(spark):
    given = {
        "10.1/A%2Fb%zz": "10.1/a/b%zz", "10.1/stra\u00dfe": "10.1/strasse", "10.1/a(b(c))).)": "10.1/a(b(c))", "10.1/a)": "10.1/a", "10.1/(a) ).,": "10.1/(a)", "10.1/a+b%2B": "10.1/a+b+", "": "", ").": "",
    }
    rows = spark.createDataFrame([(k, v) for k, v in given.items()], "raw string, doi string")
    assert {r["raw"]: r["n"] for r in rows.select("raw", normalize_doi(F.col("raw")).alias("n")).collect()} == given


def test_answers_do_not_depend_on_their_order(spark):
    record = ("10.1/a", "t", ["x"], 2020, "An abstract.", "PubMed", None, None)
    other = ("10.1/a", "t", ["x"], 2020, None, "PubMed", None, None)
    rows = [("pubmed", "10.1/a", None, "TIMEOUT", "late", 7), ("pubmed", "10.1/a", other, None, None, 8), ("pubmed", "10.1/a", record, None, None, 9), ("openalex", "10.1/b", None, "API_ERROR", "broken", 5)]
    schema = SOURCE_ANSWER + ", elapsed_ms int"
    claims = spark.createDataFrame([(1, None, "10.1/A", "c", "pubmed", None), (2, None, "10.1/b", "c", "openalex", None), (3, None, None, "c", "pubmed", None)], CLAIM)
    for own in (rows, rows[::-1]):
        out = {r["row_number"]: r for r in check_claims(claims, spark.createDataFrame(own, schema)).collect()}
        assert out[1]["abstract_source"] == "pubmed" and [a["elapsed_ms"] for a in out[1]["attempts"]] == [9]
        assert (out[2]["record"]["title"], out[2]["record"]["source"], out[2]["record"]["doi"], out[2]["error_code"]) == ("[title missing]", "selected abstract source", "10.1/b", "SOURCE_API_ERROR")
        assert len(out) == 3 and out[3]["status"] == "UNVERIFIABLE"


def test_texts_folded_at_once_are_folded_as_each_by_itself():
    fold_each = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
    texts = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000] + ["", "ẹ́́", "́", "ΑΣΣ"]
    series = pd.Series([None, *texts, None])
    assert list(tx.at_once(series, tx.fold))[1:-1] == [fold_each(t) for t in texts]
    assert [t if isinstance(t, str) else None for t in tx.at_once(pd.Series(["a\x00É", None, "ﬁ"]), tx.fold)] == ["a\x00e", None, "fi"]
    assert tx.at_once(pd.Series([None, None], dtype=object), tx.fold).isna().all()
    assert tx.spell(tx.fold("αΒ-ς1")) == " alpha  beta - sigma 1"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_citations_are_folded_before_they_meet_their_record_and_records_once(spark):
    """No worker above the join of citations with records; a record's texts are folded once, below it."""
    plan = queries.QUERIES["citation_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan[: plan.index("Join")] and plan.count("folded_and_spelt") == 1
    assert "translate" not in plan[: plan.index("Join")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["metadata_verdict", "metadata_mismatches"])
def test_orders_are_dealt_before_their_texts_go_to_workers(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("EvalPython") < plan.index("Repartition 4, true") < plan.index("Join")
