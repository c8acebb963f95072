"""Exact top-k search by inner product with a paged M-tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.llm.common import cut, globally_ranked, width
from attesta.llm.neardup import starts_of

#: Routing objects of the root, and objects of a page, of a leaf and of a block of pages that one task holds.
PIVOTS, PAGE, LEAF, BLOCK = 256, 2048, 64, 131_072
#: Components that the root, a page and a block hold at most: of longer vectors they hold fewer.
ROOT_CELLS, PAGE_CELLS, BLOCK_CELLS = 1 << 22, 1 << 20, 1 << 23
#: Blocks of one tree (the table of blocks that queries are routed by has so many rows, and one more for each routing
#: object), queries that one task asks a block, and queries that meet a page at once.
MOST_BLOCKS, ASKED, CHUNK = 1 << 16, 1_000_000, 1024
#: Bounds are floats, scores are integers: nothing is left out that is within this part of the largest product.
SLACK = 1e-9
#: Above it a sum of products may differ from the integer that it stands for.
EXACT = float(1 << 53)


def quantised(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """uid, id, n and v of each row whose vector is not null and has only finite components.

    v holds the n components floor(scale * x) as 32-bit integers, or as 64-bit ones if the vector
    needs them; one beyond 64 bits is an error, since its scores fit no long. Rows keep their vec_id,
    null or repeated; uid tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, ids, n, v = [], [], [], []
            if len(b.column(2)) and (same := alike(b.column(2), scale)) is not None:
                size = np.full(len(same), same.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array([x.tobytes() for x in same], pa.binary())], names=["uid", "id", "n", "v"])
                continue
            for u, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not x.is_valid or x.values.null_count:
                    continue
                y = x.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(y).all():
                    continue
                with np.errstate(over="ignore"):
                    y = np.floor(scale * y)
                most = float(np.abs(y).max(initial=0))
                if most >= 1 << 63:
                    raise OverflowError(f"a component of vec_id {i} times {scale} does not fit 64 bits")
                uid.append(u)
                ids.append(i)
                n.append(len(y))
                v.append(y.astype(np.int32 if most < 1 << 31 else np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(v, pa.binary())], names=["uid", "id", "n", "v"])

    slim = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "uid long, id long, n int, v binary")


def alike(vectors: pa.Array, scale: int) -> np.ndarray | None:
    """Their components as 32-bit integers, if all are usable, of one length and that small."""
    flat, size = vectors.flatten(), np.unique(np.diff(vectors.offsets.to_numpy()))
    if vectors.null_count or flat.null_count or len(size) > 1:
        return None
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.floor(scale * flat.to_numpy())
    return y.astype(np.int32).reshape(len(vectors), -1) if (np.abs(y) < 1 << 31).all() else None


def matrix(n: np.ndarray, v: list[bytes]) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros: floats where these hold every component, else 64-bit integers."""
    dim, wide = int(n.max(initial=0)), np.array([len(x) for x in v]) > 4 * n
    out = np.zeros((len(v), dim), np.int64)
    if len(v) and not wide.any() and (n == dim).all():
        return np.frombuffer(b"".join(v), np.int32).reshape(len(v), dim).astype(np.float64)
    for i, x in enumerate(v):
        out[i, : n[i]] = np.frombuffer(x, np.int64 if wide[i] else np.int32)
    return out if wide.any() and np.abs(out.astype(np.float64)).max() >= EXACT else out.astype(np.float64)


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, as floats; components that one side lacks are zero."""
    dim = min(a.shape[1], b.shape[1])
    return a[:, :dim].astype(np.float64, copy=False) @ b[:, :dim].astype(np.float64, copy=False).T


def squares(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float64, copy=False)
    return np.einsum("ij,ij->i", a, a)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, squares(a)[:, None] + squares(b)[None, :] - 2 * cross(a, b)))


def most_score(q2: np.ndarray, low: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The largest inner product of a query (q2: its square) with vectors not longer than norm and at least `low` away."""
    return (q2 + norm**2 - np.maximum(low, 0.0) ** 2) / 2


def below(score: float) -> float:
    """A float not above the score."""
    return float(score) if abs(score) < EXACT else float(score) - 2048.0


def best(row: np.ndarray, score: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, ties to the smaller id."""
    if score.dtype == object:  # integers beyond floats: their ranks
        score = np.unique(score, return_inverse=True)[1]
    order = np.lexsort((ids[at], -score, row))
    first = starts_of(row[order])
    rank = np.arange(len(order)) - np.repeat(first[:-1], np.diff(first))
    return order[rank < k]


class Page:
    """A node: a routing object, the objects' least and greatest distance to it, and leaves that each have a routing
    object, its distance to the page's, and a covering radius. Objects are stored with their distance to the leaf's."""

    def __init__(self, at: np.ndarray, x: np.ndarray) -> None:
        mean = x.astype(np.float64).mean(axis=0, keepdims=True)
        center = int(distances(mean, x)[0].argmin())
        parent = distances(x[center : center + 1], x)[0]
        leaf, away, chosen = np.zeros(len(x), np.int32), parent.copy(), [center]
        for k in range(1, math.ceil(len(x) / LEAF)):
            far = int(away.argmax())
            if away[far] <= 0:
                break
            d = distances(x[far : far + 1], x)[0]
            closer = d < away
            leaf[closer], away[closer] = k, d[closer]
            chosen.append(far)
        order = np.lexsort((away, leaf))
        self.at, self.x, self.away = at[order], x[order], away[order]
        first = starts_of(leaf[order])
        used = leaf[order][first[:-1]]
        self.first, self.last = first[:-1], first[1:]
        self.center, self.low, self.high = x[center : center + 1], float(parent.min()), float(parent.max())
        self.routing, self.parent = x[np.array(chosen)[used]], parent[np.array(chosen)[used]]
        self.radius = self.away[self.last - 1]
        norm = np.sqrt(squares(self.x))
        self.norm = float(norm.max())
        self.leaf_norm = np.maximum.reduceat(norm, self.first)
        self.largest = float(np.abs(self.x.astype(np.float64)).max(initial=0))

    def leaves_for(self, q: np.ndarray, q2: np.ndarray, floor: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Whether each leaf may hold something for each query, by stored distances first and then by its routing object's."""
        d = distances(q, self.center)
        may = (most_score(q2, np.maximum(d[:, 0] - self.high, self.low - d[:, 0]), self.norm) + slack >= floor)[:, None]
        may = may & (most_score(q2[:, None], np.abs(d - self.parent) - self.radius, self.leaf_norm) + slack[:, None] >= floor[:, None])
        rows, leaves = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if len(rows):
            some = np.ix_(rows, leaves)
            product = cross(q[rows], self.routing[leaves])
            away = np.sqrt(np.maximum(0.0, q2[rows, None] + squares(self.routing[leaves])[None, :] - 2 * product))
            most = np.minimum(most_score(q2[rows, None], away - self.radius[leaves], self.leaf_norm[leaves]), product + np.sqrt(q2[rows, None]) * self.radius[leaves])
            may[some] &= most + slack[rows, None] >= floor[rows, None]
        return may

    def scores(self, q: np.ndarray, q2: np.ndarray, floor: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query, place and score (floats, exact) of what reaches the query's floor, and how many objects were compared."""
        may = self.leaves_for(q, q2, floor, slack)
        rows = np.flatnonzero(may.any(axis=1))
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        if may[rows].mean() > 0.4:  # one product of all is quicker than one for each leaf
            s = cross(q[rows], self.x)
            r, c = np.nonzero(s >= floor[rows, None])
            return rows[r], c, s[r, c], s.size
        out, compared = [], 0
        for j in np.flatnonzero(may.any(axis=0)):
            rows, lo, hi = np.flatnonzero(may[:, j]), self.first[j], self.last[j]
            # objects are sorted by their distance to the routing object: the triangle inequality leaves a range of them
            d = distances(q[rows], self.routing[j : j + 1])
            near = (most_score(q2[rows, None], np.abs(d - self.away[lo:hi]), self.leaf_norm[j]) + slack[rows, None] >= floor[rows, None]).any(axis=0)
            c = lo + np.flatnonzero(near)
            s = cross(q[rows], self.x[c])
            compared += s.size
            r, i = np.nonzero(s >= floor[rows, None])
            out.append((rows[r], c[i], s[r, i]))
        return (*[np.concatenate(x) for x in zip(*out, strict=True)], compared)


class Block:
    """Pages, and the rows of their objects. Queries are searched best-first: the page with the greatest possible score comes first."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, page: np.ndarray, n: np.ndarray, v: list[bytes]) -> None:
        self.uid, self.ids, self.pages = uid, ids, []
        order = np.argsort(page, kind="stable")
        first = starts_of(page[order])
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            at = order[lo:hi]
            self.pages.append(Page(at, matrix(n[at], [v[i] for i in at])))

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int], int]:
        """Query, row and score of each query's k best of at least its floor, and how many objects were compared."""
        q2, floor = squares(q), floor.copy()
        norm, long = np.sqrt(q2), float(np.abs(q).sum(axis=1).max(initial=0))
        most = np.full((len(self.pages), len(q)), np.inf)
        for j, p in enumerate(self.pages):
            d = distances(q, p.center)[:, 0]
            most[j] = most_score(q2, np.maximum(d - p.high, p.low - d), p.norm)
        row, at, score, compared = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        for j in np.argsort(-most.max(axis=1), kind="stable"):
            p = self.pages[j]
            slack = SLACK * (norm + p.norm) ** 2
            asks = np.flatnonzero(most[j] + slack >= floor)
            if not len(asks):
                continue
            if q.dtype != np.float64 or p.x.dtype != np.float64 or long * p.largest >= EXACT:
                r, c, s, n = whole_scores(q[asks], p.x, floor[asks])
            else:
                r, c, s, n = p.scores(q[asks], q2[asks], floor[asks], slack[asks])
            compared += n
            r, c = asks[r], p.at[c]
            other = self.uid[c] != own[r]
            row, at, score = np.concatenate([row, r[other]]), np.concatenate([at, c[other]]), np.concatenate([score, s[other]])
            keep = best(row, score, at, self.ids, k)
            row, at, score = row[keep], at[keep], score[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
            if len(full):
                last = np.searchsorted(row, full, "right") - 1
                floor[full] = np.maximum(floor[full], [below(s) for s in score[last].tolist()])
        return row, at, [int(s) for s in score], compared


def whole_scores(q: np.ndarray, x: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for components so large that floats do not hold their products: in Python's integers, without bounds."""
    dim = min(q.shape[1], x.shape[1])
    s = q[:, :dim].astype(np.int64).astype(object) @ x[:, :dim].astype(np.int64).astype(object).T
    r, c = np.nonzero(s >= floor[:, None])
    return r, c, s[r, c], s.size


ASKING = "uid long, id long, n int, v binary, page long, pivot int, block int, floor double, part int, side int"
FOUND = "quid long, query_id long, vec_id long, score long"


def answered(both: DataFrame, k: int, compared: Accumulator | None) -> DataFrame:
    """Answers of each (block, part), whose objects (side 0) come before its queries (side 1): queries stream past a block."""
    key = ["block", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for b in batches:
            keys = [b.column(b.schema.get_field_index(c)).to_numpy() for c in (*key, "side")]
            at = starts_of(*keys)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                group, side, some = (keys[0][lo], keys[1][lo]), keys[2][lo], b.slice(lo, hi - lo)
                if group != now:
                    now, parts, block = group, [], None
                if side == 0:
                    parts.append(some)
                    continue
                if block is None and parts:
                    t = pa.Table.from_batches(parts)
                    ids = t["id"].fill_null((1 << 63) - 1).to_numpy()
                    block, nulls, parts = Block(t["uid"].to_numpy(), ids, t["page"].to_numpy(), t["n"].to_numpy(), t["v"].to_pylist()), t["id"].is_null().to_numpy(), []
                if block is None:
                    continue
                for first in range(0, some.num_rows, CHUNK):
                    t = pa.Table.from_batches([some.slice(first, CHUNK)])
                    q = matrix(t["n"].to_numpy(), t["v"].to_pylist())
                    row, place, score, n = block.search(q, t["uid"].to_numpy(), t["floor"].to_numpy(), k)
                    if compared is not None:
                        compared.add(int(n))
                    if any(abs(s) >= 1 << 63 for s in score):
                        raise OverflowError("a score does not fit a long")
                    vec = pa.array(block.ids[place], mask=nulls[place])
                    yield pa.RecordBatch.from_arrays([t["uid"].take(pa.array(row)).combine_chunks(), t["id"].take(pa.array(row)).combine_chunks(), vec, pa.array(score, pa.int64())], names=["quid", "query_id", "vec_id", "score"])

    dealt = both.repartition(*key).sortWithinPartitions(*key, "side", "pivot")
    return dealt.mapInArrow(run, FOUND)


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, compared: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by `every`, the k with the largest inner product.

    rows (vec_id, embedding): components become floor(scale * x). Scores are exact; ties go to the
    smaller vec_id, null last; a query is no candidate of its own, but other rows with its vec_id are.
    Rows that repeat a vec_id are queries and candidates of their own, so (query_id, rank) repeats
    with them. Vectors may differ in length: what one lacks counts as zeros. Vectors that are null or
    hold null or non-finite components take no part. Components or scores beyond 64 bits raise an
    error. Columns other than these two are ignored; an empty table gives an empty result.

    The tree: at most PIVOTS routing objects (of a hash-ordered sample, sent to all tasks) take the
    vectors nearest to them. Vectors are sorted by routing object and distance to it, over range
    partitions, and cut into pages of PAGE, so a region that holds a third of all vectors has many
    pages, each a ring of it. Every vector is indexed. BLOCK objects, of whole pages, are what a task
    holds. A query first asks its own block; its k-th score there is the floor for the others, to which
    it goes if their rings' distances to the routing objects leave a chance. Inside a block pages,
    leaves and objects are passed over by stored distances and covering radii (see `Page`).
    Objects are shuffled once for each million queries, queries once for each block they ask.

    `compared`, an accumulator of longs, counts the products computed.
    """
    kind = rows.schema["vec_id"].dataType
    spark = rows.sparkSession
    vectors = cut(quantised(rows, scale))
    total, dim, asked = vectors.agg(F.count("*"), F.max("n"), F.count_if(F.col("id") % every == 0)).first()
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", kind), T.StructField("score", T.LongType())])
    if not asked:
        return spark.createDataFrame([], schema)
    dim = max(1, dim)
    page = max(1, min(PAGE, PAGE_CELLS // dim))
    sample = vectors.orderBy(F.xxhash64("uid"), "uid").limit(max(1, min(PIVOTS, ROOT_CELLS // dim, math.ceil(total / page)))).select("n", "v").toArrow()
    pivots = matrix(sample["n"].to_numpy(), sample["v"].to_pylist())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy()
            step = max(1, ROOT_CELLS // max(1, int(n.max(initial=1))))
            for lo in range(0, b.num_rows, step):
                some = b.slice(lo, step)
                x = matrix(n[lo : lo + step], some.column(3).to_pylist())
                d = distances(x, pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), pa.array(np.sqrt(squares(x)))], names=[*some.schema.names, "pivot", "away", "norm"])

    placed = vectors.mapInArrow(assign, "uid long, id long, n int, v binary, pivot int, away double, norm double")
    ranked = globally_ranked(placed, [F.expr("length(bin(n))"), F.col("pivot"), F.col("away")], "_rank")
    # enough blocks for all tasks, and no more than the table of blocks may have
    pages = max(1, min(BLOCK // page, BLOCK_CELLS // dim // page, math.ceil(total / page / width(rows))), math.ceil(total / page / MOST_BLOCKS))
    objects = ranked.withColumn("page", F.expr(f"_rank div {page}")).withColumn("block", F.expr(f"page div {pages}").cast("int"))
    parts = math.ceil(asked / ASKED)

    # how near to and far from each routing object the objects of a block are: at most MOST_BLOCKS + PIVOTS rows a length class
    rings = objects.groupBy("block", "pivot").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.max("norm").alias("norm")).orderBy("block", "pivot").toArrow()
    ring_block, ring_pivot = rings["block"].to_numpy(), rings["pivot"].to_numpy()
    ring_low, ring_high, ring_norm = (rings[c].to_numpy() for c in ("lo", "hi", "norm"))
    block_first = starts_of(ring_block)[:-1]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block, other than its own, that may hold something of at least its floor."""
        for b in batches:
            n = b.column(2).to_numpy()
            step = max(1, min(ROOT_CELLS // max(1, int(n.max(initial=1))), ROOT_CELLS // len(ring_block)))
            for lo in range(0, b.num_rows, step):
                some = b.slice(lo, step)
                q = matrix(n[lo : lo + step], some.column(3).to_pylist())
                d = distances(q, pivots)[:, ring_pivot]
                q2 = squares(q)[:, None]
                most = most_score(q2, np.maximum(d - ring_high, ring_low - d), ring_norm) + SLACK * (np.sqrt(q2) + ring_norm) ** 2
                may = np.maximum.reduceat(most, block_first, axis=1) >= some.column(7).to_numpy()[:, None]
                r, c = np.nonzero(may)
                other = ring_block[block_first][c] != some.column(6).to_numpy()[r]
                r, c = r[other], c[other]
                taken = some.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*taken.columns[:6], pa.array(ring_block[block_first][c]), *taken.columns[7:]], names=taken.schema.names)

    names = [c.split()[0] for c in ASKING.split(", ")]
    part = F.pmod(F.xxhash64(F.lit(3), F.col("uid")), F.lit(parts)).cast("int")
    held = objects.withColumn("floor", F.lit(float("-inf"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(0)).select(names)
    queries = objects.where(F.col("id") % every == 0).withColumns({"floor": F.lit(float("-inf")), "part": part, "side": F.lit(1)}).select(names)
    near = cut(answered(held.unionByName(queries), k, compared))
    floors = near.groupBy(F.col("quid").alias("uid")).agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    least = F.col("_least").cast("double") - F.when(F.abs(F.col("_least").cast("double")) < EXACT, 0.0).otherwise(2048.0)  # not above it, see below()
    floored = queries.drop("floor").join(floors, "uid", "left").withColumn("floor", F.when(F.col("_n") == k, least).otherwise(F.lit(float("-inf"))))
    far = answered(held.unionByName(floored.select(names).mapInArrow(route, ASKING)), k, compared)
    place = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    ranked_best = near.unionByName(far).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked_best.select(F.col("query_id").cast(kind), F.col("rank").cast("int"), F.col("vec_id").cast(kind), "score")
