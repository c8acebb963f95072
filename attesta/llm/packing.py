"""Best-fit packing of token sequences, planned over a histogram of lengths."""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.llm import wordvec
from attesta.llm.common import cut

#: Words that a worker process keeps encoded, and the most bytes of one; others are encoded each time.
WORDS, LONGEST = 500_000, 64


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's own.

    The vocabulary's text is split at white space and case is dropped before merging, so the ids of
    a text are those of its words in turn. Each different word of a batch is looked up once, by its
    hash and then its bytes; the ids of all words are then copied at once. Unknown words of letters, alone or before a
    stop, are encoded in their lower-case form, many together, and cut where a word-end token
    stands; other unknown words go to the tokenizer one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.tails: dict[str, np.ndarray] = {}
        # hashes of the words kept, sorted; a word's ids are count of pool's from first on, its bytes size of text's from start on
        self.keys, self.pool, self.text = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.first, self.count, self.start, self.size = (np.zeros(0, np.int64) for _ in range(4))

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def of_words(self, words: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)
        at, cores, rest = [], [], []
        for i, w in enumerate(words):
            core = w.rstrip(".,!?;:")
            if core.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core) and "Σ" not in core and "İ" not in core):
                at.append(i)
                cores.append(core)
            else:
                rest.append(i)
        for lo in range(0, len(cores), 2000):
            some = cores[lo : lo + 2000]
            ids = self.plain(" ".join(some).lower())
            ends = np.flatnonzero(self.last[ids]) + 1
            parts = np.split(ids, ends[:-1]) if len(ends) == len(some) else [self.plain(c) for c in some]
            for i, core, part in zip(at[lo : lo + 2000], some, parts, strict=True):
                if tail := words[i][len(core) :]:
                    if tail not in self.tails:
                        if len(self.tails) > 10_000:
                            self.tails.clear()
                        self.tails[tail] = self.plain(tail)
                    part = np.concatenate([part, self.tails[tail]])
                out[i] = part
        for i, e in zip(rest, self.tok.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, each with end_id after it, and where each begins."""
        data, offsets = wordvec.text_bytes(texts)
        w = wordvec.words(data, offsets)
        own, where = wordvec.interned(data, w)
        kinds, size = w.hash[where], (w.end - w.start)[where]
        place = np.searchsorted(self.keys, kinds)
        known, taken = np.zeros(len(kinds), bool), np.zeros(len(kinds), bool)
        inside = np.flatnonzero(place < len(self.keys))
        taken[inside] = self.keys[place[inside]] == kinds[inside]
        inside = inside[taken[inside]]
        inside = inside[self.size[place[inside]] == size[inside]]
        known[inside] = wordvec.equal_bytes(data, w.start[where[inside]], self.text, self.start[place[inside]], size[inside])
        new = np.flatnonzero(~known)
        parts = self.of_words([data[a:b].tobytes().decode() for a, b in zip(w.start[where[new]].tolist(), w.end[where[new]].tolist(), strict=True)])
        first, count = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
        first[known], count[known] = self.first[place[known]], self.count[place[known]]
        count[new] = np.fromiter(map(len, parts), np.int64, len(parts))
        first[new] = len(self.pool) + np.cumsum(count[new]) - count[new]
        pool = np.concatenate([self.pool, *parts])
        n = len(texts)
        each = count[own]
        per_text = np.bincount(w.doc, each, minlength=n).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(int(begin[-1]), end_id, np.uint32)
        if len(own):
            step = np.arange(int(each.sum()))
            source = np.repeat(first[own] - (np.cumsum(each) - each), each) + step
            out[step + np.repeat(np.arange(n), per_text)] = pool[source]
        fit = np.flatnonzero((size[new] <= LONGEST) & ~taken[new])
        fit = fit[np.unique(kinds[new[fit]], return_index=True)[1]]
        often = np.bincount(own, minlength=len(kinds))[new[fit]]
        fit = fit[np.argsort(-often, kind="stable")[: WORDS - len(self.keys)]]
        if len(fit):
            self.keep(kinds[new[fit]], [parts[i] for i in fit], [data[a:b] for a, b in zip(w.start[where[new[fit]]], w.end[where[new[fit]]], strict=True)])
        return out, begin

    def keep(self, keys: np.ndarray, ids: list[np.ndarray], texts: list[np.ndarray]) -> None:
        """The ids of words that the batch brought, whose hashes none of those kept has."""
        count, size = np.array([len(x) for x in ids]), np.array([len(x) for x in texts])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count) - count])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.start = np.concatenate([self.start, len(self.text) + np.cumsum(size) - size])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.pool = np.concatenate([self.pool, *ids])
        self.text = np.concatenate([self.text, *texts])


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """The worker process's own, kept from task to task."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the place (_part, _nth) among the task's pieces of equal length."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("_part", T.IntegerType()), ("_nth", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nth = encoder_of(path), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            origin: list[int] = []
            for lo, hi in wordvec.slices(batch.column(1), 1 << 20):
                ids, begin = encoder.encode(batch.column(1).slice(lo, hi - lo), end_id)
                begin = begin.tolist()
                for i, (first, end) in enumerate(zip(begin[:-1], begin[1:], strict=True), lo):
                    for k, at in enumerate(range(first, end, capacity)):
                        size = min(capacity, end - at)
                        rows.append((k, at - first, size, zlib.crc32(ids[at : at + size]), part, nth[size]))
                        nth[size] += 1
                        origin.append(i)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [batch.column(0).take(pa.array(origin, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, how many, first sequence, offset), and so for all pieces.

    Sequences with equal room are kept as runs of numbers. The pieces of one length fill the runs
    with the least sufficient room, as many at once as the run has, and then new sequences. The
    plan's size depends on the capacity, not on the number of documents.
    """
    plan, runs, rooms, fresh = [], {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (k := bisect_left(rooms, length)) < len(rooms):
            room = rooms[k]
            first, n = runs[room].pop()
            used = min(n, left)
            plan.append((length, rank, used, first, capacity - room))
            if n > used:
                runs[room].append((first + used, n - used))
            if not runs[room]:
                del runs[room]
                rooms.pop(k)
            put(room - length, first, used)
            rank, left = rank + used, left - used
        if left:
            fit = capacity // length
            full, odd = divmod(left, fit)
            for n, inside in ((full, fit), (1, odd)):
                if n and inside:
                    for j in range(inside):
                        plan.append((length, rank, n, fresh, j * length))
                        rank += n
                    put(capacity - inside * length, fresh, n)
                    fresh += n
    return plan


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null text: none) and end_id. Only documents longer than capacity
    are cut, into pieces of capacity ids; the last piece may be shorter. The driver gets the number
    of pieces of each length, at most `capacity` rows, plans sequences over these counts (see
    `plan_best_fit`) and sends the plan back; each piece takes the planned slot at its rank among
    the pieces of its length. A rank is the place in its task plus the pieces of that length in
    earlier tasks, so a length that many pieces share is never sorted or gathered.

    Every row of docs is packed, repeated ones too. An empty table gives an empty result. Columns
    other than doc_id and text are ignored.
    """
    placed = cut(pieces(docs, path, capacity, end_id))
    per_part = placed.groupBy("_part", "length").agg((F.max("_nth") + 1).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = per_part.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    counts = {r[0]: r[1] for r in per_part.groupBy("length").agg(F.sum("_n")).collect()}
    plan = np.array(sorted(plan_best_fit(counts, capacity)), np.int64).reshape(-1, 5)
    key = (plan[:, 0] << 44) + plan[:, 1]
    ranked = placed.join(starts, ["_part", "length"]).withColumn("_rank", F.col("_nth") + F.col("_start")).drop("_part", "_nth", "_start")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = np.searchsorted(key, (length << 44) + rank, "right") - 1
            sequence = plan[row, 3] + rank - plan[row, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(plan[row, 4])], names=schema.names)

    return ranked.mapInArrow(slots, schema)
