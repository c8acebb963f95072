import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import mixing, sharding
from attesta.llm.common import globally_ranked, skew_lookup
from tests.llm.helpers import EN, SCHEMA, STRANGE, frame, odd_documents, syllables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full = set()
    while True:
        left, share = sum(sizes.values()) - sum(cap * sizes[n] for n in full), sum(weight[n] for n in names if n not in full)
        more = {n for n in names if n not in full and left * weight[n] / share > cap * sizes[n]} if share else set()
        if not more:
            return {n: cap * sizes[n] if n in full else left * weight[n] / share for n in names}
        full |= more


def test_mix(spark):
    rows = odd_documents()
    for schema in (SCHEMA, STRANGE):
        out = mixing.mix(frame(spark, rows, schema)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
        size, sizes, taken = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}, Counter(), Counter()
        for r in rows:
            sizes[r[3]] += size[r[0]]
        target = brute_targets(sizes)
        assert len(out) == len(rows)
        largest = Counter()
        for r in out:
            assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
            assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        for s in sizes:
            assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(frame(spark, rows).repartition(7)).select("doc_id", "taken").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_mix_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    out = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])).collect()
    assert {r["taken"] for r in out} == {0} and {r["target"] for r in out} == {0.0}
    repeated = mixing.mix(frame(spark, [(1, "a b c", None, "x", 1)] * 5 + [(2, "a b", None, "y", 1)])).collect()
    assert len({r["taken"] for r in repeated if r["doc_id"] == 1}) == 1


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        at = sharding.hilbert_index(grid, bits)
        assert sorted(at) == list(range(len(grid)))
        path = grid[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # each step is to a neighbour


def test_shard(spark):
    rows = odd_documents() + [(160, "twice", "en", "s1", 1)] * 2
    for schema in (SCHEMA, STRANGE):
        out = sharding.shard(frame(spark, rows, schema), 7).collect()
        assert len(out) == len(rows)
        shards = Counter(r["shard"] for r in out)
        assert set(shards) == set(range(7)) and max(shards.values()) - min(shards.values()) <= 1
        for s, n in shards.items():
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
        ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
        assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in out)
    assert sharding.shard(frame(spark, [])).count() == 0
    assert sorted(r["shard"] for r in sharding.shard(frame(spark, rows[:3])).collect()) == [0, 13, 26]


def test_shards_prune_files(spark, tmp_path):
    """Of 64 shards a filter on two dimensions reads few, and the rows are those of the table."""
    rng = random.Random(7)
    rows = [(i, f"{i:04}" + "x" * int(2 ** rng.uniform(0, 14)), f"l{rng.randrange(8)}", f"s{rng.randrange(32):02}", 1) for i in range(4000)] + [(9, None, None, None, None), (9, None, None, None, None)]
    docs, path = frame(spark, rows), str(tmp_path / "shards")
    sharding.write(docs, path, 64)
    back = spark.read.parquet(f"{path}/data")
    assert Counter(map(tuple, back.select("doc_id", "text", "lang", "source", "n_chars").collect())) == Counter(rows)
    for bounds, most in (({"lang": ("l3", "l3"), "source": ("s04", "s07")}, 10), ({"source": ("s30", "s31"), "size": (16, 100)}, 12), ({"lang": ("l0", "l0")}, 24)):
        found = sharding.read(spark, path, bounds)
        kept = [r for r in rows if all(x is not None and lo <= x <= hi for x, (lo, hi) in ((r[2] if c == "lang" else r[3] if c == "source" else len(r[1] or "") + 16, b) for c, b in bounds.items()))]
        assert sorted(r["doc_id"] for r in found.collect()) == sorted(r[0] for r in kept)
        assert "PartitionFilters: [shard" in found._jdf.queryExecution().executedPlan().toString()
        ranges = spark.read.parquet(f"{path}/ranges")
        for name, (lo, hi) in bounds.items():
            ranges = ranges.where((F.col(f"least_{name}") <= hi) & (F.col(f"most_{name}") >= lo))
        assert ranges.count() <= most


def test_lookup_and_rank(spark):
    fact = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = fact.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    expected = sorted(map(tuple, fact.join(dim.drop("n"), "k", "left").select("id", "top").collect()))
    for small in (10_000, 0):
        assert sorted(map(tuple, skew_lookup(fact, dim, "k", "n", small, 10).select("id", "top").collect())) == expected
    ranked = globally_ranked(fact, [F.col("k")], "r").collect()
    assert [r["r"] for r in sorted(ranked, key=lambda r: r["r"])] == list(range(1000))
    assert [r["k"] for r in sorted(ranked, key=lambda r: r["r"])] == sorted(r["k"] for r in ranked)


def test_equal_texts_are_one_run(spark):
    """Of several languages and sources: in one shard, or in shards next to each other and without other texts between."""
    rng = random.Random(6)
    texts = [None, "", *[syllables(rng, rng.randint(1, 60), EN) for _ in range(40)]]
    rows = [(i, texts[i % 3] if i % 4 == 0 else rng.choice(texts), rng.choice(["en", "de", None]), f"s{rng.randint(0, 8)}", 1) for i in range(600)]
    said = {i: t or "" for i, t, *_ in rows}
    out = sorted(sharding.shard(frame(spark, rows), 20).collect(), key=lambda r: (r["shard"], r["slot"]))
    runs = [t for i, t in enumerate(said[r["doc_id"]] for r in out) if i == 0 or t != said[out[i - 1]["doc_id"]]]
    assert len(runs) == len(set(said.values()))
    cut = {t: {r["shard"] for r in out if said[r["doc_id"]] == t} for t in runs}
    assert all(max(s) - min(s) == len(s) - 1 for s in cut.values()) and sum(len(s) > 1 for s in cut.values()) <= 19


def test_rows_without_ids_are_mixed_by_their_texts(spark):
    rows = [(None, f"word{i} " * 10, None, "s0", 1) for i in range(400)] + [(i, "w " * 4000, None, "s1", 1) for i in range(1)]
    out = mixing.mix(frame(spark, rows), weights=(1, 3)).where("source = 's0'").collect()
    assert abs(sum(r["taken"] for r in out) - out[0]["target"]) <= 10 and len({r["copies"] for r in out}) == 2
