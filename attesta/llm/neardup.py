"""N-gram Jaccard join of documents: MinHash banding, then verification on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import wordvec
from attesta.llm.common import cut, globally_ranked, skew_lookup

#: Texts of a bucket whose sketches are compared at once.
BUCKET = 2048
#: A group of more texts than SMALL is cut into about WAYS blocks, of SMALL texts at least and LARGE at most, and of GRAMS
#: n-grams: many pairs of blocks for as many tasks, and few copies of each text.
SMALL, LARGE, WAYS, GRAMS = 128, 2048, 32, 500_000
#: Texts of a large group, about, that its centre is made of.
ASKED = 32
#: Stands for a null doc_id while rows are joined.
NO_ID = -(1 << 63)
#: Similarities are quotients of whole numbers: floats of them err by far less.
EPS = 1e-9


def bands_for(similarity: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall at the similarity with so many hashes.

    1 - (1 - s**rows)**bands is the chance that two sets with similarity s share a band.
    """
    best = (hashes, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 5) -> DataFrame:
    """id, key, grams, bands (a hash per band) and sketch (a byte per MinHash) of each text that has a word."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("grams", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    fold = wordvec.powers(wordvec.STEP, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in wordvec.slices(b.column(1), 1 << 19):
                doc, grams = wordvec.shingles(*wordvec.text_bytes(b.column(1).slice(lo, hi - lo)), n)
                if not len(doc):
                    continue
                count = np.bincount(doc, minlength=hi - lo)
                have = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[have]
                low = np.empty((len(mult), len(have)), np.uint64)
                for j in range(len(mult)):
                    low[j] = np.minimum.reduceat(grams * mult[j] + plus[j], first)
                low = wordvec.mixed(low)
                keys = wordvec.mixed((low.reshape(bands, rows, -1) * fold[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[:, None])
                flat = pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * bands), flat)
                sketch = np.ascontiguousarray((low & np.uint64(255)).astype(np.uint8).T)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo).take(pa.array(have)) for c in (0, 2)], pa.array(count[have], pa.int32()), listed, pa.array([r.tobytes() for r in sketch], pa.binary())], names=schema.names)

    return docs.select("id", "text", "key").mapInArrow(run, schema)


def by_group(df: DataFrame, key: list[str], make: Callable[[pa.Table], list[pa.RecordBatch]], schema: T.StructType, most: int = 4 << 20) -> DataFrame:
    """make over runs of whole groups of df, at least `most` bytes together: groups may be many and tiny, so they do not get a call each.

    Rows are dealt by key, sorted in their partition and read in turn; a group that the last batch leaves open waits for the next.
    """
    dealt = df.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < most:
                continue
            table = pa.Table.from_batches(held)
            differs = np.zeros(len(table), bool)
            for column in (table[k].to_numpy() for k in key):
                differs |= column != column[-1]
            whole = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if whole:
                yield from make(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                size = 0
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield from make(table)

    return dealt.mapInArrow(run, schema)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted rows, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), len(new))


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    return joined(np.arange(n), left, right)


def joined(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least members of the components, as these edges join them further, by repeated halving of paths over all at once."""
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the least id that edges (a, b) reach from it: stars contract until nothing changes.

    Each round every id takes the least label among itself and its neighbours, hangs its old label
    under that, and then takes its label's label. Labels and edges stay distributed, and a round is
    cut so that plans do not grow. The centre of a large star is a key that most edges share, as is
    the label of a large component; both are looked up by skew_lookup.
    """
    edges = edges.where(F.col("a") != F.col("b")).distinct()
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp"), F.count("*").alias("_rows")))
    while True:
        near = skew_lookup(both, label.withColumnRenamed("id", "b"), "b", "_rows").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("_near"))
        hooked = label.join(near, "id").withColumn("_new", F.least("comp", "_near"))
        under = hooked.where(F.col("_new") < F.col("comp")).groupBy(F.col("comp").alias("id")).agg(F.min("_new").alias("_under"))
        lower = cut(hooked.join(under, "id", "left").select("id", F.least("_new", F.coalesce("_under", "_new")).alias("_low"), F.col("comp").alias("_was"), F.col("_rows").alias("_degree")))
        used = lower.groupBy("_low").agg(F.count("*").alias("_rows"))
        jump = used.join(lower.select(F.col("id").alias("_low"), F.col("_low").alias("_two")), "_low")
        after = cut(skew_lookup(lower, cut(jump), "_low", "_rows").select("id", F.least("_low", F.coalesce("_two", "_low")).alias("comp"), "_was", F.col("_degree").alias("_rows")))
        if after.where(F.col("comp") < F.col("_was")).isEmpty():
            return after.select("id", "comp")
        label = after.drop("_was")


def buckets(sig: DataFrame) -> DataFrame:
    """id, band, n and least of the bands that several texts share: how many have it, and the least id of them.

    Counts are summed before the shuffle and looked up skew-safely, so a bucket that many texts are in meets in no task.
    """
    slim = sig.select("id", F.explode("bands").alias("band"))  # a band's number is in its hash
    live = cut(slim.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").withColumn("_rows", F.col("n")))
    return skew_lookup(slim, live, "band", "_rows", how="inner")


def candidate_edges(live: DataFrame, sig: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that join texts sharing a band (see `buckets`), if their sketches agree in at least `least` of the places.

    Within a bucket of at most BUCKET texts all sketches are compared; a larger one is one component as it is, which
    loses no link: it only leaves more to verify. A bucket yields an edge for each member at most.
    """
    kind = T.LongType()
    large = live.where(F.col("n") > BUCKET).select(F.col("id").alias("a"), F.col("least").alias("b"))
    small = live.where(F.col("n") <= BUCKET).select("id", "band")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def make(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        ids = t["id"].to_numpy()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        at = starts_of(t["band"].to_numpy())
        a, b = [], []
        two = np.flatnonzero(np.diff(at) == 2)
        x = at[two]
        same = (sketch[x] == sketch[x + 1]).mean(axis=1) >= least if len(x) else np.zeros(0, bool)
        a.append(np.maximum(ids[x], ids[x + 1])[same])
        b.append(np.minimum(ids[x], ids[x + 1])[same])
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo < 3:
                continue
            own = ids[lo:hi]
            order = np.argsort(own)
            own, marks = own[order], sketch[lo:hi][order]
            left, right = [], []
            for i in range(len(own) - 1):
                near = np.flatnonzero((marks[i + 1 :] == marks[i]).mean(axis=1) >= least)
                left.append(np.full(len(near), i))
                right.append(near + i + 1)
            root = roots(len(own), np.concatenate(left), np.concatenate(right))
            moved = root != np.arange(len(own))
            a.append(own[moved])
            b.append(own[root[moved]])
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=schema.names)]

    return by_group(small.join(sig.select("id", "sketch"), "id"), ["band"], make, schema).unionByName(large)


def verified(grouped: DataFrame, n: int, similarity: float) -> DataFrame:
    """id, links (copies of linked texts) and root (least linked id in the block) from rows comp, pair, side, id, text, copies.

    Each (comp, pair) holds the texts of two blocks, or of one, of a candidate component. Overlaps
    are counted exactly, a text against all others at once, over an index from n-gram to texts.
    """
    kind = T.LongType()
    schema = T.StructType([T.StructField("id", kind), T.StructField("links", T.LongType()), T.StructField("root", kind)])

    def links(own: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = own.take(pa.array(np.unique(own["id"].to_numpy(), return_index=True)[1]))
        ids, copies, side = own["id"].to_numpy(), own["copies"].to_numpy(), own["side"].to_numpy()
        m = len(ids)
        doc, gram = wordvec.exact_shingles(*wordvec.text_bytes(own["text"]), n)
        size = np.bincount(doc, minlength=m)
        count = np.bincount(gram)
        # n-grams that many of these texts hold are counted by a product of 0/1 matrices, the others through their lists of texts
        common = (count >= 16) & (count * 8 >= m)
        column = np.cumsum(common) - 1
        often = common[gram]
        held = np.zeros((m, int(common.sum())), np.float32)
        held[doc[often], column[gram[often]]] = 1
        doc, gram = doc[~often], gram[~often]
        post = doc[np.argsort(gram, kind="stable")]
        count = np.bincount(gram, minlength=len(count))
        first = np.cumsum(count) - count
        own_count = np.bincount(doc, minlength=m)
        begin = np.cumsum(own_count) - own_count
        total, root = np.zeros(m, np.int64), np.arange(m)
        for lo in range(0, m, 256):
            left, right = [], []  # the links of 256 texts at most are held at a time
            shared = held[lo : lo + 256] @ held.T
            for i in range(lo, min(m, lo + 256)):
                g = gram[begin[i] : begin[i] + own_count[i]]
                c = count[g]
                at = np.repeat(first[g] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                both = shared[i - lo] + np.bincount(post[at], minlength=m)
                # both / (size + size - both) >= similarity
                near = (both * (1 + similarity) >= similarity * (size + size[i]) - 1e-9) & (both > 0)
                near[i] = False
                if side.any():
                    near &= side != side[i]
                total[i] = copies[near].sum()
                # of links to texts of one component so far, one says as much as all
                j = np.flatnonzero(near)
                j = j[np.unique(root[j], return_index=True)[1]]
                left.append(np.full(len(j), i))
                right.append(j)
            root = joined(root, np.concatenate(left), np.concatenate(right))
        return ids, total, ids[root]

    def make(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        at = starts_of(t["comp"].to_numpy(), t["pair"].to_numpy())
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            out.append(links(t.slice(lo, hi - lo)))
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=schema.names)]

    return by_group(grouped, ["comp", "pair"], make, schema)


def from_centers(rows: DataFrame, n: int) -> DataFrame:
    """comp, id and away, the Jaccard distance to the centre, from rows comp, salt, side, id, text.

    The centre is the set of the n-grams that more than half of the texts of side 0 have; without any it is empty.
    """

    def make(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        at = starts_of(t["comp"].to_numpy(), t["salt"].to_numpy())
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            part = t.slice(lo, hi - lo)
            doc, gram = wordvec.exact_shingles(*wordvec.text_bytes(part["text"]), n)
            side, size = part["side"].to_numpy(), np.bincount(doc, minlength=hi - lo)
            asked = np.bincount(gram[side[doc] == 0], minlength=int(gram.max(initial=0)) + 1)
            center = asked * 2 > (side == 0).sum()
            both = np.bincount(doc, center[gram], minlength=hi - lo)
            away = 1 - both / (size + center.sum() - both)
            member = np.flatnonzero(side == 1)
            out.append((part["comp"].to_numpy()[member], part["id"].to_numpy()[member], away[member]))
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["comp", "id", "away"])]

    return by_group(rows, ["comp", "salt"], make, T.StructType([T.StructField("comp", T.LongType()), T.StructField("id", T.LongType()), T.StructField("away", T.DoubleType())]))


class LargeGroups:
    """Candidate components of more than SMALL texts or GRAMS n-grams, from members (comp, id, copies, _n, _blocks, _asked).

    A component's centre is what most of a few of its texts agree on (any set would do). Its texts are
    sorted by their Jaccard distance to the centre, over range partitions, and cut into blocks. The distance is a metric:
    texts whose distances to the centre differ by more than 1 - similarity are not linked, those for
    which they add up to no more than that are. So most pairs of blocks are settled by sums over
    blocks; only the others are verified. For near copies of one text this leaves few or none.
    """

    def __init__(self, members: DataFrame, texts: DataFrame, n: int, similarity: float) -> None:
        far = 1 - similarity
        salt = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
        full = members.join(texts, "id")
        some = full.where(F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 30)) < F.col("_asked") / F.col("_n") * (1 << 30))
        centers = some.select("comp", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("salt"), F.lit(0).alias("side"), "id", "text")
        salted = full.select("comp", salt.alias("salt"), F.lit(1).alias("side"), "id", "text")
        measured = from_centers(salted.unionByName(centers), n)
        ranked = globally_ranked(measured, [F.col("comp"), F.col("away")], "_rank")
        starts = ranked.groupBy("comp").agg(F.min("_rank").alias("_start"), F.count("*").alias("_rows"))
        placed = skew_lookup(ranked, cut(starts.withColumn("_size", F.col("_rows"))), "comp", "_rows").join(members.select("id", "copies", "_blocks"), "id")
        block = F.expr("(_rank - _start) * _blocks div _size").cast("int")
        self.members = cut(placed.select("comp", "id", "copies", "away", block.alias("block")))
        blocks = self.members.groupBy("comp", "block").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.sum("copies").alias("copies"))
        b = blocks.select("comp", F.col("block").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), F.col("copies").alias("other_copies"))
        near = blocks.join(b, "comp").where((F.col("block") <= F.col("other")) & (F.col("other_lo") - F.col("hi") <= far + EPS))
        self.pairs = cut(near.withColumn("sure", F.col("hi") + F.col("other_hi") <= far - EPS))
        # if a block is settled with any other, it is with the nearest, where all are linked to all
        near = self.pairs.where("sure and block = 0").select("comp", F.col("other").alias("block"))
        first = self.members.where("block = 0").groupBy("comp").agg(F.min("id").alias("b"))
        self.edges = self.members.join(near.join(first, "comp"), ["comp", "block"]).select(F.col("id").alias("a"), "b")

    def to_verify(self) -> DataFrame:
        """comp, pair, side and id: the texts of each pair of blocks that the centre's distances leave open."""
        open_pairs = self.pairs.where(~F.col("sure")).select("comp", "block", "other", (F.col("block") * F.lit(1 << 31) + F.col("other")).alias("pair"))
        slim = self.members.select("comp", "block", "id")
        left = slim.join(open_pairs, ["comp", "block"]).select("comp", "pair", F.when(F.col("block") == F.col("other"), 0).otherwise(1).alias("side"), "id")
        right = slim.join(open_pairs.where("block < other").select("comp", F.col("other").alias("block"), "pair"), ["comp", "block"]).select("comp", "pair", F.lit(2).alias("side"), "id")
        return left.unionByName(right)

    def settled(self) -> DataFrame:
        """id and links to the texts of blocks in which all are linked to it."""
        sure = self.pairs.where("sure")
        ways = sure.select("comp", "block", F.col("other_copies").alias("n"), (F.col("block") == F.col("other")).alias("own"))
        back = sure.where("block < other").select("comp", F.col("other").alias("block"), F.col("copies").alias("n"), F.lit(False).alias("own"))
        total = ways.unionByName(back).groupBy("comp", "block").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        return self.members.join(total, ["comp", "block"]).select("id", (F.col("n") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"))


def jaccard_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, links and copies for each row of docs (doc_id, text).

    Texts whose sets of n-word shingles have a Jaccard similarity of at least `similarity` are
    linked. links: other rows linked to this one, equal texts included. class_id: the least doc_id
    that links reach. copies: rows with this text.

    Equal texts, told by their SHA-256, become one representative. MinHash bands, as many and as wide
    as `recall` at the similarity asks for, are shuffled by their hash; texts that share one, and whose
    sketches (all MinHashes, a byte each) do not rule the similarity out by six standard errors, form
    candidate components, within which pairs are verified on the full sets of n-grams, compared as
    words, not as hashes. Components above SMALL texts or GRAMS n-grams are verified block by block,
    as far as distances to a centre do not settle blocks whole (see `LargeGroups`). No pair is ever a row,
    and links are joined into components as they are found.

    A text of fewer than n words has one shingle of all its words. A text without a word, or null,
    is linked to nothing (copies are not counted among such, it is 1) and is a class of its own.
    doc_id must be an integer; rows that repeat one stay rows of their own, whatever their texts; a
    null one keeps its class, named by the least doc_id that is not null, or null. Other columns are
    ignored. An empty table gives an empty result.
    """
    bands, rows = bands_for(similarity, recall)
    spread = math.sqrt(similarity * (1 - similarity) / (bands * rows))
    wordy = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kind = docs.schema["doc_id"].dataType
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", F.when(wordy, F.unhex(F.sha2("text", 256))).alias("key"))
    own = cut(keyed.select("id", "key"))
    least = F.coalesce(F.min(F.when(F.col("id") != NO_ID, F.col("id"))), F.lit(NO_ID))
    classes = own.where("key is not null").groupBy("key").agg(least.alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("tid", F.monotonically_increasing_id()))  # a number of its own for each text
    signed = signatures(keyed.where("key is not null"), n, bands, rows)
    rep = classes.select("key", F.col("rep").alias("id"), "tid", "copies")
    sig = cut(signed.join(rep, ["key", "id"]).select(F.col("tid").alias("id"), "grams", "bands", "sketch", "copies"))
    live = cut(buckets(sig))
    comp = components(candidate_edges(live, sig, similarity - 6 * spread))

    sized = cut(comp.join(sig.select("id", "grams", "copies").dropDuplicates(["id"]), "id"))
    counted = sized.groupBy("comp").agg(F.count("*").alias("_n"), F.sum("grams").alias("_g"))
    per_block = F.least(F.lit(LARGE), F.greatest(F.lit(SMALL), F.col("_n") / WAYS))
    blocks = F.greatest(F.ceil(F.col("_n") / per_block), F.ceil(F.col("_g") / GRAMS)).cast("int")
    asked = F.least(F.lit(ASKED), F.lit(GRAMS) * F.col("_n") / F.col("_g"))
    counted = cut(counted.select("comp", "_n", blocks.alias("_blocks"), asked.alias("_asked"), F.col("_n").alias("_rows")))
    dealt = cut(skew_lookup(sized, counted, "comp", "_rows"))
    found = keyed.where("key is not null").join(rep, ["key", "id"]).select(F.col("tid").alias("id"), "text")
    texts = found.join(dealt.select("id"), "id", "left_semi").dropDuplicates(["id"])
    paired = dealt.where("_blocks = 1").select("comp", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "id")
    large = None
    if not counted.where("_blocks > 1").isEmpty():
        texts = cut(texts)
        large = LargeGroups(dealt.where("_blocks > 1"), texts, n, similarity)
        paired = paired.unionByName(large.to_verify())
    checked = cut(verified(paired.join(texts, "id").join(dealt.select("id", "copies"), "id"), n, similarity))
    edges, links = checked.select(F.col("id").alias("a"), F.col("root").alias("b")), checked.select("id", "links")
    if large:
        edges, links = edges.unionByName(large.edges), links.unionByName(large.settled())
    linked = components(edges).join(classes.select(F.col("tid").alias("id"), F.when(F.col("rep") != NO_ID, F.col("rep")).alias("rep")), "id")
    named = cut(linked.groupBy("comp").agg(F.coalesce(F.min("rep"), F.lit(NO_ID)).alias("class_id"), F.count("*").alias("_rows")))
    linked = skew_lookup(linked.select("comp", F.col("id").alias("tid")), named, "comp", "_rows").select("tid", "class_id")
    total = links.groupBy(F.col("id").alias("tid")).agg(F.sum("links").alias("_links"))
    known = classes.join(total, "tid", "left").join(linked, "tid", "left")
    known = known.select("key", "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("copies").alias("_rows"))
    # wordless rows have keys of their own, so that they do not meet in one task
    own = own.withColumn("key", F.coalesce("key", F.concat(F.lit("#"), F.col("id").cast("string")).cast("binary")))
    out = skew_lookup(own, known, "key", "_rows")
    named_id = lambda c: F.when(c != NO_ID, c).cast(kind)
    return out.select(named_id(F.col("id")).alias("doc_id"), named_id(F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
