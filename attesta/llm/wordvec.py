"""Words of a batch of texts as numpy arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
KEY, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes; a longer text is a range of its own."""
    _, offsets = text_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


#: The terms of the first 256 places of a run.
TERMS = mixed(np.arange(1 << 16, dtype=np.uint64) + KEY)


@dataclass
class Runs:
    """Runs of bytes (words, lines): start and end in data, the text each is in, and a hash of its bytes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Runs:
    """Maximal runs where gap is false, within each text."""
    inside = ~gap
    begins, ends = inside.copy(), inside.copy()
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that have bytes
    head = np.zeros(len(data), bool)
    head[first] = True
    begins[1:] &= gap[:-1] | head[1:]
    tail = np.zeros(len(data), bool)
    tail[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    ends[:-1] &= gap[1:] | tail[:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Runs(start, end, doc, run_hashes(data, inside, start, end))


def run_hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A sum of scrambled (place, byte) pairs. Equal hashes say that runs may be equal; `interned` says whether they are."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.flatnonzero(inside)
    term = ((at - np.repeat(start, size)) << 8) | data[at]
    value = TERMS[np.minimum(term, len(TERMS) - 1)]
    far = np.flatnonzero(term >= len(TERMS))
    value[far] = mixed(term[far].astype(np.uint64) + KEY)
    return mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))


def equal_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes of a from a_start[i] on are those of b from b_start[i] on; sizes are above 0."""
    if not len(size):
        return np.zeros(0, bool)
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    return np.logical_and.reduceat(a[np.repeat(a_start - first, size) + step] == b[np.repeat(b_start - first, size) + step], first)


def interned(data: np.ndarray, r: Runs) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run, the same for runs of equal bytes and for no others, and a run that has each number."""
    _, where, ids = np.unique(r.hash, return_index=True, return_inverse=True)
    ids = ids.reshape(-1)
    size, model = r.end - r.start, where[ids]
    again = np.flatnonzero((model != np.arange(len(ids))) & (size == size[model]))
    differs = size != size[model]
    differs[again] = ~equal_bytes(data, r.start[again], data, r.start[model[again]], size[again])
    if differs.any():
        more: dict[bytes, int] = {}
        found = where.tolist()
        for i in np.flatnonzero(differs).tolist():
            ids[i] = more.setdefault(data[r.start[i] : r.end[i]].tobytes(), len(found))
            if ids[i] == len(found):
                found.append(i)
        where = np.array(found)
    return ids, where


def window_ids(ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number of each n runs in a row of one text, the same for equal runs in turn and for no others, and its first run's place."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    many = int(ids.max(initial=0)) + 1
    out = ids[at]
    for j in range(1, n):
        out = np.unique(out * many + ids[at + j], return_inverse=True)[1].reshape(-1)
    return out, at


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> Runs:
    return runs(data, offsets, is_space(data))


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n words in a row of one text, and the index of its first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j, p in enumerate(powers(STEP, n)):
        total += hashes[j : j + count] * p
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return mixed(total[at]), at


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, hash) of each text's n-word shingles; a text of 1 to n - 1 words has one, of all its words."""
    w = words(data, offsets)
    hashes, at = windows(w.hash, w.doc, n)
    docs = w.doc[at]
    count = np.bincount(w.doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    if len(few := np.flatnonzero((count > 0) & (count < n))):
        own = np.array([mixed(np.add.reduce(w.hash[first[d] : first[d] + count[d]] * powers(STEP, int(count[d]))) + count[d].astype(np.uint64)[None])[0] for d in few], np.uint64)
        hashes, docs = np.concatenate([hashes, own]), np.concatenate([docs, few])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return docs[keep], hashes[keep]


def exact_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with a number for each n words in turn, which no others have, in place of a hash."""
    w = words(data, offsets)
    ids, _ = interned(data, w)
    grams, at = window_ids(ids, w.doc, n)
    docs = w.doc[at]
    count = np.bincount(w.doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    if len(few := np.flatnonzero((count > 0) & (count < n))):
        many = int(grams.max(initial=-1)) + 1
        seen: dict[tuple[int, ...], int] = {}
        own = [many + seen.setdefault(tuple(ids[first[d] : first[d] + count[d]].tolist()), len(seen)) for d in few]
        grams, docs = np.concatenate([grams, np.array(own, np.int64)]), np.concatenate([docs, few])
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    return docs[keep], grams[keep]
