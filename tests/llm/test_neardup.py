import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from attesta.llm import neardup
from tests.llm.helpers import EN, SCHEMA, STRANGE, frame, odd_documents, syllables, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, similarity=0.8):
    sets = {r[0]: shingles(r[1]) for r in rows}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near_copies():
    rng = random.Random(3)
    rows, at = odd_documents(), 1000
    for g in range(12):
        base = syllables(rng, 120, EN).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = syllables(rng, 1, EN)
            rows.append((at, " ".join(copy), "en", "s1", 1))
            at += 1
    rows += [(2000 + i, "four words in all", None, None, None) for i in range(3)] + [(2010, "four words in all too", None, None, None)]
    return rows


@pytest.mark.parametrize("block,grams", [(2048, 1_000_000), (5, 700)])
def test_links_and_classes(spark, monkeypatch, block, grams):
    monkeypatch.setattr(neardup, "SMALL", block)
    monkeypatch.setattr(neardup, "BUCKET", block)
    monkeypatch.setattr(neardup, "GRAMS", grams)
    rows = near_copies()
    expected = brute(rows)
    for schema in (SCHEMA, STRANGE) if block > 5 else (SCHEMA,):
        got = {r["doc_id"]: (r["class_id"], r["links"]) for r in neardup.jaccard_join(frame(spark, rows, schema)).collect()}
        assert got == expected


def test_edges(spark):
    assert neardup.jaccard_join(frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, " \n", None, None, None)]
    assert sorted((r["doc_id"], r["class_id"], r["links"]) for r in neardup.jaccard_join(frame(spark, rows)).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    repeated = neardup.jaccard_join(frame(spark, [(5, "the same words again and again", None, None, None)] * 3)).collect()
    assert [(r["class_id"], r["copies"]) for r in repeated] == [(5, 3)] * 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r["id"]: r["comp"] for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{300 + i: 300 for i in range(30)}}


def test_bands_reach_recall():
    for s, recall in ((0.8, 0.9999), (0.5, 0.99)):
        bands, rows = neardup.bands_for(s, recall)
        assert 1 - (1 - s**rows) ** bands >= recall and bands * rows <= 128


def test_ids_that_repeat_or_are_null(spark):
    one, two = "a text of five words", "another text of five words"
    rows = [(7, one), (7, two), (7, two), (None, one), (None, "all by itself without any id"), (9, None), (None, "")]
    got = Counter((r["doc_id"], r["class_id"], r["links"], r["copies"]) for r in neardup.jaccard_join(frame(spark, rows)).collect())
    assert got == Counter([(7, 7, 1, 2), (7, 7, 1, 2), (7, 7, 1, 2), (None, 7, 1, 2), (None, None, 0, 1), (9, 9, 0, 1), (None, None, 0, 1)])


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(11), thue_morse(11, "ba")
    rows = [(1, f"{a} w x y z"), (2, f"{b} w x y z"), (3, f"{a}  w x y z")]
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in neardup.jaccard_join(frame(spark, rows)).collect()} == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def test_large_group_is_settled_by_its_center(spark, monkeypatch):
    """Near copies of one text: blocks are counted whole, no pair of them is verified, and no task holds more than two blocks."""
    monkeypatch.setattr(neardup, "SMALL", 64)
    rng = random.Random(4)
    base = syllables(rng, 300, EN).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(len(copy))] = f"new{i}"
        rows.append((i, " ".join(copy)))
    opened, plan = [], neardup.LargeGroups.to_verify

    def to_verify(self):
        found = plan(self)
        opened.append((found.count(), self.pairs.count()))
        return found

    monkeypatch.setattr(neardup.LargeGroups, "to_verify", to_verify)
    got = neardup.jaccard_join(frame(spark, rows)).collect()
    assert {(r["class_id"], r["links"]) for r in got} == {(0, 1499)} and len(got) == 1500
    assert opened == [(0, 24 * 25 // 2)]


def test_links_of_a_large_block_are_not_held():
    """4096 texts all linked, in two blocks: 8 million links and more, of which few are in memory at a time."""
    head = " ".join(f"w{i}" for i in range(60))
    rows = [(1, 1, 1 + i // 2048, i, f"{head} x{i}", 1) for i in range(4096)]
    made = []

    class Grouped:
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            table = pa.table(dict(zip(("comp", "pair", "side", "id", "text", "copies"), map(list, zip(*rows, strict=True)), strict=True)))
            tracemalloc.start()
            made.extend(run(iter(table.to_batches())))
            made.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    neardup.verified(Grouped(), 5, 0.8)
    *found, most = made
    assert sum(b.num_rows for b in found) == 4096 and {r for b in found for r in b["links"].to_pylist()} == {2048} and {r for b in found for r in b["root"].to_pylist()} == {0}
    assert most < 300e6, most
