"""Searches over all documents and passages against brute force."""

import random
import re

import pytest

from attesta.functions import vocab
from attesta.operators import search
from attesta.plans import queries


def tables(spark):
    rng = random.Random(5)
    words = ["strain", "strains", "the", "pump", "Valve", "actuated", "x", "of", "life", "7", "kv", "cycles"]
    said = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "!"]) for _ in range(n))
    docs = [(i, said(rng.randint(1, 60))) for i in range(80)] + [(200, None), (201, ""), (202, " .. ")]
    items = [(i, said(rng.randint(1, 9))) for i in range(60)] + [(300, None), (301, "?!")]
    # a whole passage past number 40, and one of which only the first five words are said
    docs += [(203, "Say: ALPHA beta - gamma delta epsilon zeta eta."), (204, "alpha beta gamma delta epsilon, not zeta"), (205, "alphabeta gamma delta epsilon zeta")]
    items += [(302, "alpha beta gamma delta epsilon zeta")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def plain(text):
    return " ".join(re.findall("[a-z0-9]+", (text or "").lower()))


def stems(text):
    stem = lambda w: "actuat" if w.startswith("actuat") else "strain" if w.startswith("strain") else re.sub("^(.{3,})s$", r"\1", w)
    return {stem(w) for w in re.findall("[a-z]+", (text or "").lower()) if w not in vocab.CLAIM_STOPWORDS}


def test_phrase_search(spark):
    docs, items, d, i = tables(spark)
    want = sorted((k, m) for k, t in docs for m, p in items if plain(p) and f" {plain(p)} " in f" {plain(t)} ")
    assert (203, 302) in want and (204, 302) not in want and len(want) > 60
    assert sorted(map(tuple, search.phrase_search(d, i).collect())) == want


def test_phrase_places(spark):
    docs, items, _, _ = tables(spark)
    docs += [(400, "strain strain strain"), (401, "of the strain"), (400, "strain strain strain"), (None, "strain")]
    items += [(401, "strain strain"), (402, "strain"), (402, "strain"), (403, "nowhere of the strain")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: plain(t).split()
    want = [(k, m, at) for k, t in docs for m, p in items for at in range(len(words(t))) if words(p) and words(t)[at : at + len(words(p))] == words(p) and k is not None]
    assert sorted(map(tuple, search.phrase_places(d, i).collect())) == sorted(want)
    assert search.phrase_places(d.limit(0), i).count() == 0 and search.phrase_places(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("most, looked_at, per_task", [(1, 1, 50_000), (10, 20, 3), (3, 10**6, 50_000), (1000, 5, 50_000)])
def test_top_evidence(spark, monkeypatch, most, looked_at, per_task):
    """Ties, copies, items of frequent terms only, and frequent terms dealt over several tasks."""
    monkeypatch.setattr(search, "PER_TASK", per_task)
    docs, items, _, _ = tables(spark)
    docs += [(500 + j, "The pump life. Valve strains!") for j in range(30)]
    items += [(400, "pump"), (401, "the of"), (402, "pump pump life unheard")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for m, p in items:
        found = []
        for k, t in docs:
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", (t or "").strip()) if s]
            found += [(-n, k, j, s) for j, s in enumerate(sentences) if (n := len(stems(s) & stems(p)))]
        want += [(m, r, k, j, -n, s) for r, (n, k, j, s) in enumerate(sorted(found)[:most], 1)]
    assert sorted(map(tuple, search.top_evidence(d, i, most, looked_at).collect())) == sorted(want)
    assert search.top_evidence(d.limit(0), i).count() == 0


def test_all_passages_are_registered():
    assert {"phrase_search", "phrase_places", "term_overlap_ranked"} <= queries.QUERIES.keys()


def test_top_evidence_of_many_terms(spark, monkeypatch):
    """Items with too many terms to broadcast: sentences are dealt by their terms, with the same result; of few terms nothing is dealt."""
    _, _, d, i = tables(spark)
    few = search.top_evidence(d, i, 3)
    assert "_salt" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    many = search.top_evidence(d, i, 3)
    assert "_salt" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_an_index_is_made_of_texts_that_are_shuffled_once(spark):
    plan = queries.inverted_index_roundtrip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Exchange hashpartitioning(doc_id#" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("few", [search.FEW_PHRASES, 0])
def test_few_and_many_phrases_stand_in_the_same_places(spark, monkeypatch, few):
    """At a text's ends, longer than the words around another's anchor, with an anchor that is frequent or far in."""
    monkeypatch.setattr(search, "FEW_PHRASES", few)
    long = " ".join(f"w{i % 7}" for i in range(40))
    docs = [(1, f"{long} rare"), (2, f"rare {long}"), (3, f"x {long} rare y rare"), (4, "rare"), (5, long[3:]), (5, "end w0"), (None, "rare"), (6, "w0 " * 300)]
    items = [(1, f"{long} rare"), (2, "rare"), (3, "w0 w1"), (4, "w0"), (4, "w0"), (5, "w6 w0 w1 w2 w3 w4 rare"), (6, "end w0"), (7, "w0 unheard"), (8, "...")]
    words = lambda t: plain(t).split()
    want = [(k, m, at) for k, t in docs if k is not None for m, p in items if words(p) for at in range(len(words(t))) if words(t)[at : at + len(words(p))] == words(p)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = search.phrase_places(d, i)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 600
    assert found.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("start", "int")]
    assert search.phrase_places(d, i.where("item_id > 6")).collect() == []


def test_few_phrases_shuffle_no_document(spark):
    _, _, d, i = tables(spark)
    plan = search.phrase_places(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan
