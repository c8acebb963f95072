import base64
import hashlib
import io
import math
import operator
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from tokenizers import Tokenizer

from attesta.llm import mtree, packing, urlfilter, warc
from tests.llm.helpers import SCHEMA, STRANGE, frame, odd_documents, thue_morse

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    rows = [(i, f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né日", f"http://a/{i}") for i in range(30)]
    rows += [(100, None, None), (101, "", "http://b/\r\nx: y"), (102, "x" * 300_000, "http://c"), (103, "\r\n\r\n", "u"), (104, "same", "u"), (104, "same", "u")]
    records = spark.createDataFrame([(*r, 1, 2) for r in rows], "record_key long, payload string, url string, payload_bytes int, _first int")
    path = str(tmp_path / "w")
    warc.write(warc.deduplicated(records), path, compression=compression)
    first, digest = {}, {}
    for k, p, _ in rows:
        digest[k] = base64.b32encode(hashlib.sha1((p or "").encode()).digest()).decode()
        first[digest[k]] = min(first.get(digest[k], k), k)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    text = {k: p or "" for k, p, _ in rows}
    for r in got:
        k = int(r["record_id"])
        again = first[digest[k]] != k
        assert r["record_type"] == ("revisit" if again else "response") and r["payload_digest"] == digest[k]
        assert r["payload_bytes"] == len(text[k].encode()) and r["refers_to"] == (str(first[digest[k]]) if again else None)
        assert bytes(r["payload"]) == (b"" if again else text[k].encode())
    assert {r["target_uri"] for r in got if r["record_id"] == "101"} == {"http://b/%0D%0Ax:%20y"}
    # tests of header fields go to the reader; payloads that nobody asks for are not decoded
    only = warc.read(spark, path, payload=False).where("record_type = 'revisit' and target_uri in ('http://a/8', 'http://a/9')")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan.replace("PushedFilters", "").split("BatchScan")[0], plan
    reader, other = warc.WarcReader({"path": path, "payload": "false"}), GreaterThan(("content_length",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("http://a/8", "http://a/9")), other])) == [other]
    assert sorted(x for p in reader.partitions() for b in reader.read(p) for x in b.column(1).to_pylist()) == ["8", "9"]
    assert sorted(r["record_id"] for r in only.collect()) == ["8", "9"] and only.first()["payload"] is None
    large = warc.deduplicated(records, 1000)
    assert {r["record_type"] for r in large.collect()} == {"response"}
    empty = str(tmp_path / "none")
    warc.write(warc.deduplicated(records.where("false")), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_files_are_split_and_stepped_over(spark, tmp_path):
    """Any split of a compressed file gives the same records; payloads that are not asked for are not even read."""
    rng = random.Random(3)
    rows = [(i, rng.randbytes(3000).hex(), f"http://a/{i}") for i in range(60)]
    path = str(tmp_path / "w")
    warc.write(warc.deduplicated(spark.createDataFrame(rows, "record_key long, payload string, url string").coalesce(1)), path)
    (name,) = (tmp_path / "w").glob("*.gz")
    data = name.read_bytes()
    # any tool reads it as gzip, member by member; ids and profiles are those of the format
    import gzip

    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\n") == 61 and plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.count(b"WARC-Record-ID: <urn:uuid:") == 61
    for size in (len(data), 10_000, 777):
        reader = warc.WarcReader({"path": path, "partitionbytes": str(size)})
        got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column(1).to_pylist(), b.column(7).to_pylist(), strict=True)]
        assert sorted(got) == sorted((str(i), p.encode()) for i, p, _ in rows)
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

    found = list(warc.member_records(Counting(data), 0, len(data), [("warc-type", frozenset(["response"]))], False))
    assert len(found) == 60 and all(b is None for _, b in found)
    # one stream for a whole file, as other writers make them
    whole = tmp_path / "one"
    whole.mkdir()
    (whole / "a.warc.gz").write_bytes(gzip.compress(plain))
    for size in (1 << 20, 5000):
        reader = warc.WarcReader({"path": str(whole), "partitionbytes": str(size), "info": "true"})
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 61


def test_urls(spark):
    urls = ["http://a.b.com/x", "HTTP://WWW.Example.COM/en/1?q=/de/", "https://x.example.com/en/1", "http://example.com", "https://net/fr/2#a", "ftp://a.net/de/", "nothing", "", None, "http://", "http://x.org/en/5?u=http://y.com/", "http://com/", "x://y://z/k", "http://ÉX.com/é"]
    pages = spark.createDataFrame([(i, u, "h", 1, "r") for i, u in enumerate(urls)] + [(99, "http://x.org/en/5", None, None, None)] * 40, "page_id long, url string, html string, ratio int, rule string")
    out = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    expect = {0: ("a.b.com", "/x", "com/", "allow"), 1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("x.example.com", "/en/1", "example.com/en/", "block"), 3: ("example.com", "", None, None), 4: ("net", "/fr/2", "net/fr/", "block"), 5: ("a.net", "/de/", None, None), 6: ("", "", None, "block"), 7: ("", "", None, "block"), 8: ("", "", None, "block"), 9: ("", "", None, "block"), 10: ("x.org", "/en/5", None, None), 11: ("com", "/", "com/", "allow"), 12: ("y:", "//z/k", None, None), 13: ("Éx.com", "/é", "com/", "allow")}
    for i, (host, path, rule, verdict) in expect.items():
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
        assert (r["ratio"] is None) == (rule is not None)
    assert urlfilter.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages.where("url is null")).collect()} == {"block"}


def test_url_models_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("good.com/news", "nice.org/story")) + f"/{rng.randint(0, 99)}", True) for _ in range(60)] + [(rng.choice(("spam.biz/win", "casino.xyz/cash")) + f"?{rng.randint(0, 9)}", False) for _ in range(60)]
    known = spark.createDataFrame(rows, "url string, good boolean").select(urlfilter.symbols(F.col("url")).alias("_text"), F.col("good").alias("_good"))
    texts = [(r["_text"], r["_good"]) for r in known.collect()]
    size = len(urlfilter.ALPHABET) + 3

    def probability(gram, good):
        if not gram:
            return 1 / size
        after = Counter(t[i + len(gram) - 1] for t, g in texts if g == good for i in range(1 - min(1, len(gram) - 1), len(t) - len(gram) + 1) if t[i : i + len(gram) - 1] == gram[:-1] and i + len(gram) - 1 >= 1)
        short = probability(gram[1:], good)
        return (after[gram[-1]] + len(after) * short) / (sum(after.values()) + len(after)) if after else short

    import math

    models = urlfilter.language_models(known)
    for n, m in enumerate(models, 1):
        for r in m.collect():
            d = math.log(probability(r[f"g{n}"], True)) - math.log(probability(r[f"g{n}"], False))
            assert abs(d - r[f"d{n}"]) < 1e-9, r
    probe = known.select("_text", "_good").distinct().withColumn("k", F.monotonically_increasing_id())
    scores = probe.join(urlfilter.ratios(probe, models, "k"), "k").collect()
    assert all((r["ratio"] > 0) == r["_good"] for r in scores)


def brute_top_k(rows, k=10):
    """From whole numbers, vectors filled up with zeros, queries told apart by their rows."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (q, x) in enumerate(good):
        if q is not None and q % 100 == 0:
            found = sorted(((-sum(map(operator.mul, x, y)), i is None, i or 0) for b, (i, y) in enumerate(good) if b != a))[:k]
            out.update((q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(found, 1))
    return out


def found_top_k(df, **more):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df, **more).collect())


SMALL_TREE = {"PIVOTS": 3, "PAGE": 40, "LEAF": 8, "BLOCK": 80, "ASKED": 3, "CHUNK": 2}


@pytest.mark.parametrize("size", [{}, SMALL_TREE])
def test_top_k(spark, monkeypatch, size):
    for name, value in size.items():
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(5)
    base = np.concatenate([rng.normal(c, 0.3, (120, 8)) for c in (-1, 0, 2)] + [np.ones((60, 8))])
    rows = [(int(i) * 5, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(3, None, 0), (200_000, [1.0] * 7 + [float("nan")], 0), (400_000, [1.0] * 7 + [None], 0), (500_000, [float("inf")] + [0.0] * 7, 0)]  # no part
    rows += [(300_000, [1.0] * 5, 0), (None, [1.0] * 8, 0), (None, [9.0] * 8, 0), rows[0], rows[1], (100, [2.0] * 8, 0), (600_000, [], 0), (7, [0.5] * 700, 0)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema)
    assert found_top_k(df) == brute_top_k(rows)
    # components of more than 32 bits, and products that floats do not hold
    large = [(0, [1.0, 2.0]), (1, [3e7, 1.0]), (2, [1.0, 1.0]), (2, [5.0, 5.0]), (4, [2.0, 2.0]), (100, [1e5 + 1 / 1024, 3.0]), (200, [1e5, -1e4 + 1 / 1024]), (300, [1e5, 3.0])]
    assert found_top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), k=3) == brute_top_k(large, 3)
    few = mtree.top_k(df.where("vec_id in (0, 10, 15) and size(embedding) = 8")).collect()
    assert sorted(r["rank"] for r in few if r["query_id"] == 0) == [1, 1, 2, 2, 3, 3]
    assert mtree.top_k(df.where("false")).count() == 0 and mtree.top_k(df.where("vec_id = 100").limit(1)).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        mtree.top_k(spark.createDataFrame([(0, [1e17])], "vec_id long, embedding array<double>")).collect()
    with pytest.raises(Exception, match="does not fit"):
        mtree.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")).collect()


def test_tree_skips_comparisons(spark, monkeypatch):
    """Where vectors lie in groups the bounds leave few; of points spread evenly over a sphere, as in the driver's table, they leave nearly all."""
    monkeypatch.setattr(mtree, "PAGE", 256)
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (40, 16))
    v = np.concatenate([rng.normal(c, 0.05, (100, 16)) for c in centers])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    compared = spark.sparkContext.accumulator(0)
    assert found_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), compared=compared) == brute_top_k(rows)
    queries = len(rows) // 100
    assert 0 < compared.value < 0.2 * queries * len(rows), compared.value / queries / len(rows)


def check_packed(rows, out, capacity):
    tok = Tokenizer.from_file(PATH)
    expected = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r["length"] for r in out)


def test_pack(spark):
    rows = odd_documents() + [(700, "It's don't WE'LL I'M ΣΑΣ İstanbul e\u0301 ﬁ 1234 a\x1cb <|endoftext|> end", None, None, None), (700, "again", None, None, None), (701, "a\u3000b\u2003c", None, None, None), (702, f"{thue_morse(11)} {thue_morse(11, 'ba')}", None, None, None), (703, f"{thue_morse(11, 'ba')} x {thue_morse(11)}", None, None, None)]
    for schema, capacity in ((SCHEMA, 4096), (STRANGE, 50)):
        out = packing.pack(frame(spark, rows, schema), PATH, capacity).collect()
        n, total = check_packed(rows, out, capacity)
        assert n <= -(-total // capacity) * 1.05 + 1
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_encoder_trusts_no_hash(monkeypatch):
    """With one hash for all words each is still given its own ids, whether it was met before or not."""
    monkeypatch.setattr(packing.wordvec, "run_hashes", lambda data, inside, start, end: np.zeros(len(start), np.uint64))
    encoder, tok = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for texts in (["some words and some", "more words"], ["words", None, "and others than those", "some"], [""]):
        ids, begin = encoder.encode(packing.pa.array(texts, packing.pa.string()), 1)
        for i, t in enumerate(texts):
            assert ids[begin[i] : begin[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_plan_is_whole_and_tight():
    rng = random.Random(8)
    for _ in range(30):
        capacity = rng.choice((7, 64, 500))
        counts = {rng.randint(1, capacity): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
        plan = packing.plan_best_fit(counts, capacity)
        room, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in plan:
            ranks[length] += range(rank, rank + n)
            for s in range(first, first + n):
                room[s].append((offset, length))
        assert all(sorted(ranks[x]) == list(range(counts[x])) for x in counts)
        for own in room.values():
            ends = [0, *[a + b for a, b in sorted(own)]]
            assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= capacity
        bound = -(-sum(a * b for a, b in counts.items()) // capacity)
        assert len(room) <= 11 / 9 * max(bound, sum(n for x, n in counts.items() if 2 * x > capacity)) + 1
