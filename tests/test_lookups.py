"""Streamed lookups against a fake service and a fake clock."""

import os
import time

import pytest

from attesta.sources import live
from attesta.streaming import lookups


class Clock:
    def __init__(self):
        self.now = 0.0

    def time(self):
        return self.now

    def sleep(self, s):
        self.now += s


@pytest.mark.parametrize("rate, tasks, each", [(2.0, 4, 10), (1.0, 3, 1), (10.0, 1, 50)])
def test_tasks_keep_one_rate(rate, tasks, each):
    """In any window of T seconds no more than rate * T requests, and one for each task; over several batches."""
    asked, begin = [], 0.0
    for _ in range(3):
        ends = []
        for number in range(tasks):
            clock = Clock()
            clock.now = begin
            share = lookups.Share(rate, tasks, number, clock.time, clock.sleep)
            list(lookups.paced(iter([("s", str(i)) for i in range(each)]), {"s": share}, lambda *_, c=clock: asked.append(c.now)))
            ends.append(clock.now)
        begin = max(ends)
    asked.sort()
    for i, start in enumerate(asked):
        for j in range(i, len(asked)):
            assert j - i + 1 <= rate * (asked[j] - start) + tasks + 1e-6
    assert begin >= (len(asked) - tasks) / rate - 1e-6


def fake(folder, refusals):
    """A service that notes each request in the folder, and refuses the first ones of each DOI."""

    def ask(source, doi):
        name = f"{folder}/{source}-{doi.replace('/', '_')}"
        with open(name, "a") as f:
            f.write("x")
        refused = os.path.getsize(name) <= refusals
        return source, doi, None if refused else "{}", "RATE_LIMITED" if refused else None, "later" if refused else None, 1

    return ask


def test_restart_asks_nothing_twice(spark, tmp_path):
    for d in ("in", "asked"):
        (tmp_path / d).mkdir()
    rates = {"crossref": 1000.0, "pubmed": 1000.0}

    def run(checkpoint):
        dois = spark.readStream.schema("doi_norm string").json(str(tmp_path / "in"))
        lookups.ask_stream(dois, str(tmp_path / "out"), str(tmp_path / checkpoint), rates, 2, fake(tmp_path / "asked", 0)).awaitTermination()

    (tmp_path / "in/a.json").write_text('{"doi_norm": "10.1/a"}\n{"doi_norm": "10.1/b"}\n{"doi_norm": "10.1/a"}\n{"doi_norm": null}\n')
    run("one")
    (tmp_path / "in/b.json").write_text('{"doi_norm": "10.1/b"}\n{"doi_norm": "10.1/c"}\n')
    run("one")
    run("other")  # offsets lost: all is read again
    got = spark.read.schema(live.SCHEMA).parquet(str(tmp_path / "out")).collect()
    want = sorted((s, f"10.1/{d}") for s in rates for d in "abc")
    assert sorted((r["source_name"], r["doi_norm"]) for r in got) == want and all(r["payload"] == "{}" for r in got)
    assert {p.read_text() for p in (tmp_path / "asked").iterdir()} == {"x"} and len(list((tmp_path / "asked").iterdir())) == 6


def test_refused_dois_are_answered_later(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    rows = [("pubmed", "10.1/a", None, "RATE_LIMITED", "later", 1), ("pubmed", "10.1/a", None, "RATE_LIMITED", "later", 1), ("pubmed", "10.1/b", "{}", None, None, 1), ("openalex", "10.1/c", None, "TIMEOUT", "", 1)]
    spark.createDataFrame(rows, live.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    answers = spark.readStream.schema(live.SCHEMA).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    again = lookups.retry_refused(answers, 200, 5, fake(tmp_path / "asked", 1))  # refused once more, then answered
    query = again.writeStream.format("memory").queryName("later").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        while spark.table("later").count() < 2 and time.time() < until:
            time.sleep(0.5)
            assert query.exception() is None
        time.sleep(2)
    finally:
        query.stop()
    got = sorted((r["source_name"], r["doi_norm"], r["payload"], r["error_status"]) for r in spark.table("later").collect())
    assert got == [("openalex", "10.1/c", "{}", None), ("pubmed", "10.1/a", "{}", None)]
    assert {p.name: p.read_text() for p in (tmp_path / "asked").iterdir()} == {"openalex-10.1_c": "xx", "pubmed-10.1_a": "xx"}
    state = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "tries").load()
    assert state.count() == 0
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
