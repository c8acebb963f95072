"""Whitening, license scans and collocations against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import collocation, licenses, whitening
from tests.llm.helpers import STRANGE, frame, odd_documents

# --- whitening -----------------------------------------------------------------------------------


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def by_numpy(rows, most):
    """Whole entries, exact deviations by Python's numbers, components of the exactly centred rows."""
    dims = max(len(v) for _, v in rows)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = lambda v: [n * c - s for c, s in zip(v, sums, strict=True)]
    centred = np.array([d(v) for v in fit], float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    share = values / np.trace(centred.T @ centred / n)
    return [(k, n, sum(e * e for e in d(v)), np.array(d(v), float) / n @ (basis / np.sqrt(values))) for (k, _), v in zip(rows, x, strict=True)], share


def test_whitening_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j / 3) + (2 if j == 1 else 0) for j in range(7)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third is one vector, fitted once
    want, share = by_numpy(rows, 4)
    got = whitening.whiten(vectors(spark, rows).repartition(3), most=4).collect()
    assert len(got) == len(rows)
    told = {k: (n, dev, w) for k, n, dev, w in want}
    for r in got:
        n, dev, w = told[r["vec_id"]]
        assert (r["n"], int(r["deviation"])) == (n, dev) and n == 300
        assert np.abs(np.abs(r["whitened"]) - np.abs(w)).max() < 1e-9
        assert np.abs(np.array(r["explained"]) - share).max() < 1e-9 and r["identity_error"] < 1e-9
    signs = {tuple(np.sign(np.array(r["whitened"]) * told[r["vec_id"]][2]).tolist()) for r in got}
    assert len(signs) == 1  # one sign for all rows


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.0]), (2, [3.0, -1.0, 0.0]), (3, [0.5, 0.25, 0.0]), (None, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0])]
    odd = [(*r, "x", 1, 2, 3.0) for r in rows + bad]
    got = whitening.whiten(vectors(spark, odd, ", n string, x long, deviation int, whitened double")).collect()
    assert Counter(r["vec_id"] for r in got) == Counter([1, 1, 2, 3, None])
    assert all(r["n"] == 3 and len(r["whitened"]) == 2 and r["identity_error"] < 1e-9 for r in got)  # the third entry never varies
    assert all(not r["whitened"] and not r["explained"] for r in whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0])])).collect())
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, bad)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [])])).count() == 1
    short = whitening.whiten(vectors(spark, [(1, [1.0, 0.0]), (2, [1.0]), (3, [2.0, 1.0])])).collect()
    assert {r["n"] for r in short} == {2}  # a missing entry is zero
    far = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert len(far) == 3 and all(np.isfinite(r["whitened"]).all() for r in far)


def test_deviations_beyond_64_bits():
    x = np.array([[10**12, -(10**12)], [3, 4]])
    n, sums = 10**9, [10**13, 5]
    d = whitening.deviations(x, n, sums)
    assert d.tolist() == [[10**21 - 10**13, -(10**21) - 5], [3 * 10**9 - 10**13, 4 * 10**9 - 5]]
    assert whitening.squared(d)[0] == (10**21 - 10**13) ** 2 + (10**21 + 5) ** 2


# --- licenses ------------------------------------------------------------------------------------


def licenses_by_hand(text, templates, phrases, share):
    """All blocks against all templates."""
    split = [(label, family, licenses.plain_words(t)) for label, family, t in templates]
    split = [(label, family, set(zip(w, w[1:], strict=False))) for label, family, w in split if len(w) > 1]
    stride = max(len(licenses.plain_words(t)) for _, _, t in templates)
    w = licenses.plain_words(text or "")
    places = sorted((i, label) for label, p in phrases for q in [licenses.plain_words(p)] for i in range(len(w)) if w[i : i + len(q)] == q)
    blocks = set()
    for b in range(len(w) // stride + 1):
        held = w[b * stride : (b + 2) * stride]
        held = set(zip(held, held[1:], strict=False))
        found = [(family, len(held & t) / len(t), label) for label, family, t in split if 100 * len(held & t) >= share * len(t)]
        blocks |= {(b, label, s) for family, s, label in found if s == max(x for f, x, _ in found if f == family)}
    return len(w), places, sorted(blocks)


def license_texts(rng):
    texts = [t for _, _, t in licenses.TEMPLATES]
    filler = lambda n: " ".join(rng.choice(["the", "of", "software", "license", "work", "öl", "x1", "this"]) for _ in range(n))
    out = [None, "", "...", "MIT", *texts, "under THE mit-license under the MIT license", "Apache License, Version 2.0 CC BY-NC"]
    for _ in range(80):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["", "foo", "the the"])
        out.append(f"{filler(rng.randint(0, 150))}\n * {' '.join(words)}\n{filler(rng.randint(0, 150))}")
    return [*out, filler(20_000) + texts[2] + filler(20_000), "ñ" * 30_000]


def test_license_scan_equals_all_blocks_by_all_templates(spark):
    texts = license_texts(random.Random(2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for share in (60, licenses.SHARE):
        got = {r["doc_id"]: r for r in licenses.scan(docs, share=share).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n, places, blocks = licenses_by_hand(t, licenses.TEMPLATES, licenses.PHRASES, share)
            r = got[i]
            assert r["n_words"] == n and sorted((p["start"], p["label"]) for p in r["places"]) == places, t
            assert sorted((b["block"], b["label"], b["score"]) for b in r["blocks"]) == blocks, t
            assert r["score"] == (1.0 if places else max((s for _, _, s in blocks), default=0.0))


def test_license_scan_finds_each_template_and_leaves_prose(spark):
    rng = random.Random(3)
    prose = " ".join(rng.choice("this software may be used under the terms of a license by any person for free".split()) for _ in range(5000))
    docs = spark.createDataFrame([(i, f"# {prose[:300]}\n# {t}") for i, (_, _, t) in enumerate(licenses.TEMPLATES)] + [(99, prose)], "doc_id long, text string")
    got = {r["doc_id"]: {b["label"] for b in r["blocks"]} for r in licenses.scan(docs).collect()}
    assert not got.pop(99) and all(licenses.TEMPLATES[i][0] in labels for i, labels in got.items())


def test_license_scan_of_odd_rows_runs_without_python(spark):
    docs = frame(spark, odd_documents(), STRANGE)
    found = licenses.scan(docs)
    assert found.count() == docs.count() and licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, templates=(), phrases=()).where("score > 0").count() == 0
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())
    twice = spark.createDataFrame([(None, "Released under the MIT License."), (None, "none"), (1, None), (1, "cc by nc")], "doc_id long, text string")
    assert sorted(r["score"] for r in licenses.scan(twice).collect()) == [0.0, 0.0, 1.0, 1.0]


# --- collocations --------------------------------------------------------------------------------


def phrases_by_hand(rows, least, longest=5, top=2000, absorb=100):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        count = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        outer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    outer[p[i : i + m]] = max(outer[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * outer[p] < absorb * a:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "the", "Ünder", "ünder", "日本", "x-1", "\x00", "o'c", "\x1f", "long" * 50]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", " \r\n", "!?", "\x0b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    return [*rows, *[("to be or not to be", "en")] * 60, ("a b " * 5000, "en"), (None, "en"), ("", None), (" \t\n", "fr"), ("a a a a a a a", "")]


@pytest.mark.parametrize("least, longest, top, absorb", [(12, 5, 2000, 100), (3, 4, 25, 60), (300, 2, 5, 100)])
def test_collocations_equal_brute_force(spark, least, longest, top, absorb):
    rows = phrase_rows(least)
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"rank": F.lit(1), "n": F.lit("x"), "phrase": F.lit(0)}).repartition(4)
    got = collocation.mine(docs, least, longest, top, absorb)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, least, longest, top, absorb)


def test_collocations_by_several_automata_and_small_buffers(spark, monkeypatch):
    rows = phrase_rows(8)
    for name, value in {"AUTOMATON_CHARS": 300, "HELD": 500, "KEPT": 5}.items():
        monkeypatch.setattr(collocation, name, value)
    got = collocation.mine(spark.createDataFrame(rows, "text string, lang string"), 12)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 12)


def test_collocations_of_odd_rows(spark):
    docs = frame(spark, odd_documents(), STRANGE)
    assert collocation.mine(docs.limit(0)).count() == 0 and collocation.mine(docs, 10**6).count() == 0
    got = collocation.mine(docs, 40)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 40)


def test_full_sketch_only_loosens_bounds(spark, monkeypatch):
    """Cells so few that all phrases pass the bounds: the counts decide."""
    rows = phrase_rows(5)
    monkeypatch.setattr(collocation, "MOST_BITS", 16)
    monkeypatch.setattr(collocation.Words, "grams", lambda self, at, n: (self.hash[at] * 0).astype(np.uint64))
    got = collocation.mine(spark.createDataFrame(rows, "text string, lang string"), 12)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 12)
