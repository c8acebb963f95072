"""Frequent word sequences that hold together: sketch bounds, then exact counts by automata."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import wordvec as wv
from attesta.llm.common import cut, globally_ranked, shared_dir, skew_lookup, width

#: Bytes of a text: 1 between words, 2 between pieces, 0 in words. All are ASCII, so none is part of another character.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t")] = 1
KINDS[list(b".,;:!?\n\v\f\r")] = 2
#: A-Z in lower case, one space between words and one line feed between pieces.
PLAIN = bytes(32 if KINDS[b] == 1 else 10 if KINDS[b] == 2 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of the sketch. Its cells are dealt out by their high bits, CELL_BITS low bits to a row; 2**MOST_BITS cells in a row (bitmaps of 128 MB) at most.
DEPTH, CELL_BITS, MOST_BITS = 2, 16, 29
#: Cells that a task holds before it writes them, phrases likewise, and characters of one automaton.
HELD, KEPT, AUTOMATON_CHARS = 1 << 21, 200_000, 1 << 21
#: Bytes of text whose phrases a task lists or counts: the more, the fewer tasks have rows for the same phrase.
SHARD_BYTES = 1 << 27
NO_LANG = "und"


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


class Words:
    """The words of a slice of texts: where they are, their hashes (of language and bytes) and the piece each is in."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = wv.text_bytes(texts)
        self.data = np.frombuffer(PLAIN, np.uint8)[data]
        kind = KINDS[self.data]
        self.runs = wv.runs(self.data, offsets, kind > 0)
        self.piece = np.cumsum(kind == 2)[self.runs.start] + self.runs.doc if len(data) else self.runs.doc
        coded = langs.dictionary_encode()
        self.lang_names = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[self.runs.doc].astype(np.int64)
        salt = wv.mixed(np.array([zlib.crc32(x.encode()) for x in self.lang_names], np.uint64) + wv.KEY)
        self.hash = self.runs.hash ^ salt[self.lang] if len(self.lang_names) else self.runs.hash

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n words from `at` on."""
        total = np.zeros(len(at), np.uint64)
        for j, p in enumerate(wv.powers(wv.STEP, n)):
            total += self.hash[at + j] * p
        return wv.mixed(total + np.uint64(n))

    def pairs(self) -> np.ndarray:
        """Places of two words in a row of one piece."""
        return np.flatnonzero(self.piece[:-1] == self.piece[1:])

    def longer(self, heavy: np.ndarray, n: int) -> np.ndarray:
        """Places of n words in a row all of whose runs of n - 1 words are marked in `heavy`."""
        return np.flatnonzero(heavy[:-1] & heavy[1:]) if n > 2 else self.pairs()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for b in batches:
        texts, langs = b.column("text"), b.column("lang")
        for lo, hi in wv.slices(texts):
            yield Words(texts.slice(lo, hi - lo), langs.slice(lo, hi - lo))


def cells_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch, by other bits of it: row i has the cells from i * 2**bits on."""
    return [(hashes >> np.uint64(64 - bits)).astype(np.uint32), ((hashes & np.uint64((1 << bits) - 1)) + np.uint64(1 << bits)).astype(np.uint32)]


def marked(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash's cells are set in all rows."""
    out = np.ones(len(hashes), bool)
    for cell in cells_of(hashes, bits):
        out &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def flags(w: Words, at: np.ndarray, n: int, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """For each word, whether the n words from it on are at a place of `at` and in a set cell."""
    out = np.zeros(len(w.hash), bool)
    out[at[marked(w.grams(at, n), bitmap, bits)]] = True
    return out


def cell_rows(cells: list[np.ndarray], least: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Counts by cell, up to `least` each, as one row for each 2**CELL_BITS cells."""
    found, count = np.unique(np.concatenate(cells), return_counts=True)
    count = np.minimum(count, least).astype(np.uint8 if least < 256 else np.uint32)
    chunk = found >> CELL_BITS
    ends = np.flatnonzero(np.append(chunk[1:] != chunk[:-1], True)) + 1
    lo = 0
    for hi in ends.tolist():
        yield int(chunk[lo]), (found[lo:hi] & 0xFFFF).astype(np.uint16).tobytes(), count[lo:hi].tobytes()
        lo = hi


CELLS = "chunk int, cells binary, counts binary, lang string, n long"


def sketcher(least: int, bits: int, longest: int, pairs: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pd.DataFrame]]:
    """Counts two words in a row by cell and, as rows of chunk -1, the words of each language; with the bitmap of pairs, counts 3 to `longest` words."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "cells", "counts", "lang", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        words: dict[str, int] = {}
        for w in sliced(batches):
            if pairs is None:
                for name, n in zip(w.lang_names, np.bincount(w.lang, minlength=len(w.lang_names)).tolist(), strict=True):
                    words[name] = words.get(name, 0) + n
                held += cells_of(w.grams(w.pairs(), 2), bits)
            else:
                both = flags(w, w.pairs(), 2, pairs.value, bits)
                heavy = both
                for n in range(3, longest + 1):
                    at = w.longer(heavy, n)
                    held += cells_of(w.grams(at, n), bits)
                    heavy = np.zeros(len(both), bool)
                    heavy[at] = True
            if sum(map(len, held)) >= HELD:
                yield batch([(*row, None, None) for row in cell_rows(held, least)])
                held = []
        if sum(map(len, held)):
            yield batch([(*row, None, None) for row in cell_rows(held, least)])
        if words:
            yield batch([(-1, None, None, name, n) for name, n in words.items()])

    return count


def merger(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by chunk become one bitmap for each chunk, of the cells whose counts add up to `least`."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(1 << CELL_BITS, np.int64)
        done = lambda: pd.DataFrame({"chunk": [now], "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})
        for frame in frames:
            for chunk, cells, counts in zip(frame["chunk"], frame["cells"], frame["counts"], strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now = chunk
                    total[:] = 0
                total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint8 if least < 256 else np.uint32)
        if now is not None:
            yield done()

    return merge


def heavy_cells(cells: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of cells counted `least` times or more: DEPTH * 2**bits bits, whatever the number of rows."""
    dealt = cells.repartition(width(cells), "chunk").sortWithinPartitions("chunk")
    out = np.zeros(DEPTH * (1 << bits) // 8, np.uint8)
    size = (1 << CELL_BITS) // 8
    for r in dealt.select("chunk", "cells", "counts").mapInPandas(merger(least), "chunk int, bits binary").collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def lister(bits: int, longest: int, pairs: Broadcast, rest: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The different phrases whose bounds reach the threshold; a phrase may come more than once."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for w in sliced(batches):
            ids, _ = wv.interned(w.data, w.runs)
            heavy = np.zeros(len(w.hash), bool)
            for n in range(2, longest + 1):
                at = w.longer(heavy, n)
                heavy = flags(w, at, n, pairs.value if n == 2 else rest.value, bits)
                at = np.flatnonzero(heavy)
                same = w.lang[at]
                for j in range(n):
                    same = np.unique(same * (int(ids.max(initial=0)) + 1) + ids[at + j], return_inverse=True)[1].reshape(-1)
                for i in at[np.unique(same, return_index=True)[1]].tolist():
                    phrase = b" ".join(w.data[w.runs.start[i + j] : w.runs.end[i + j]].tobytes() for j in range(n))
                    seen.add((w.lang_names[w.lang[i]], phrase.decode()))
            if len(seen) >= KEPT:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*seen, strict=True)], names=["lang", "phrase"])
                seen = set()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*seen, strict=True)], names=["lang", "phrase"])

    return listed


#: The automata that this worker has built last, under their key.
BUILT: dict[str, dict[str, ahocorasick.Automaton]] = {}


def automata(key: str, phrases: dict[str, tuple[int, str]]) -> dict[str, ahocorasick.Automaton]:
    """One automaton a language, of phrases between delimiters; built once by each worker."""
    if key not in BUILT:
        BUILT.clear()
        made: dict[str, ahocorasick.Automaton] = {}
        for lang, (first, listed) in phrases.items():
            made[lang] = ahocorasick.Automaton()
            for i, phrase in enumerate(listed.split("\n")):
                made[lang].add_word(f" {phrase} ", first + i)
            made[lang].make_automaton()
        BUILT[key] = made
    return BUILT[key]


def guarded(texts: list[str]) -> str:
    """The texts in lower case with one space on either side of each word, and line feeds between pieces."""
    plain = "\n".join(texts).encode().translate(PLAIN)
    return re.sub(rb"[ \n]*\n[ \n]*|^ *| +$", b" \n ", re.sub(rb"  +", b" ", plain)).decode() + " "


def scanner(key: str, phrases: Broadcast, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each of `size` phrases stands in the shard, overlaps included. phrases: by language, its first number and all, one a line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automata(key, phrases.value)
        total = np.zeros(size, np.int64)
        for b in batches:
            coded = b.column("lang").dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                if lang not in made:
                    continue
                own = b.column("text").filter(pa.array(code == i))
                for lo, hi in wv.slices(own):
                    text = guarded(own.slice(lo, hi - lo).to_pylist())
                    total += np.bincount(np.fromiter((n for _, n in made[lang].iter(text)), np.int64), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["number", "f"])

    return scan


def text_bytes(text: DataFrame) -> int:
    return text.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def sharded(text: DataFrame, size: int) -> DataFrame:
    """text in partitions of SHARD_BYTES or so, if they are smaller; nothing is shuffled."""
    return text.coalesce(max(1, -(-size // SHARD_BYTES)))


def candidates(text: DataFrame, size: int, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase) for all phrases of 2 to `longest` words that may occur `least` times, with some that do not; and (lang, n), the words of each language."""
    spark = text.sparkSession
    # a word takes six bytes or so; a cell gets a quarter of `least` by chance
    bits = min(MOST_BITS, max(CELL_BITS, (4 * size // (6 * least)).bit_length()))
    first = cut(text.mapInArrow(sketcher(least, bits, longest, None), CELLS))
    pairs = spark.sparkContext.broadcast(heavy_cells(first.where("chunk >= 0"), least, bits))
    rest = spark.sparkContext.broadcast(heavy_cells(text.mapInArrow(sketcher(least, bits, longest, pairs), CELLS), least, bits) if longest > 2 else None)
    found = cut(sharded(text, size).mapInArrow(lister(bits, longest, pairs, rest), "lang string, phrase string").distinct())
    return found, first.where("chunk < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def counted(text: DataFrame, phrases: DataFrame, whole: int) -> DataFrame:
    """phrases (lang, phrase) with f, their occurrences in the texts of their language, by scans with automata of bounded size.

    Phrases are dealt to automata in the order of their languages, so each scan reads the texts of few.
    """
    spark = text.sparkSession
    ranked = cut(globally_ranked(phrases, [F.col("lang"), F.col("phrase")], "_place"))
    chars, rows = ranked.agg(F.sum(F.length("phrase") + 2), F.count("*")).first()
    parts = -(-(chars or 0) // AUTOMATON_CHARS)
    each, out = -(-rows // max(1, parts)), None
    for part in range(parts):
        own = ranked.where((F.col("_place") >= part * each) & (F.col("_place") < (part + 1) * each))
        by_lang: dict[str, list[str]] = {}
        for r in own.orderBy("_place").collect():  # languages in a row
            by_lang.setdefault(r["lang"], []).append(r["phrase"])
        held, size = {}, 0
        for lang, listed in by_lang.items():
            held[lang] = (size, "\n".join(listed))
            size += len(listed)
        held, langs = spark.sparkContext.broadcast(held), list(by_lang)
        read = text.where(F.col("lang").isin(langs)) if len(langs) <= 100 else text
        sums = sharded(read, whole).mapInArrow(scanner(uuid.uuid4().hex, held, size), "number long, f long").groupBy("number").agg(F.sum("f").alias("f"))
        placed = cut(sums.withColumn("_place", F.col("number") + part * each).drop("number"))
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        return ranked.select("lang", "phrase", F.lit(0).cast("long").alias("f"))
    return cut(ranked.join(out, "_place").select("lang", "phrase", "f"))


def looked_up(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of the phrase in column `part`, where a part may be that of many phrases."""
    keyed = cuts.withColumn("_key", F.struct("lang", F.col(part).alias("phrase")))
    rows = keyed.groupBy("_key").agg(F.count("*").alias("_rows"))
    dim = cut(rows.join(counts.select(F.struct("lang", "phrase").alias("_key"), F.col("f").alias(name)), "_key"))
    return skew_lookup(keyed, dim, "_key", "_rows", how="inner").drop("_key")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorb: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of docs (text, lang).

    A text is cut at . , ; : ! ? and line ends into pieces and these at spaces and tabs into words,
    A-Z in lower case. A candidate is a phrase of 2 to `longest` words that stands at least `least`
    times in pieces of its language (null: und), overlaps included (a). Cut after its first words,
    whose count is l, from the others, whose count is r, it scores floor(1000 a n / (l r)), n being
    the language's words; the worst cut counts, of equal ones the first. A candidate within a longer
    one that stands at least `absorb` percent as often is left out. rank orders by score, a, then
    phrase in byte order, up to `top`.

    Phrases are first counted by hash in a count-min sketch of two rows, whose cells grow with the
    corpus; the least count of its cells bounds that of a phrase from above, and a phrase is counted
    only if all shorter ones in it may reach `least`. What may reach it is compiled into automata, between
    delimiters, and the shards of the corpus are scanned for exact counts. The sketch's bitmap, all
    that the driver gets of it, has a bit for each least / 8 words or so, and 2**30 at most; beyond
    that its bounds are looser and the automata more, with the same result.

    Null and empty texts have no words; rows that repeat count as often as they stand; a text of any
    length is read whole. An empty table, or one without candidates, gives an empty result. Columns
    other than text and lang are ignored.
    """
    shared_dir(docs.sparkSession)
    text = prepared(docs)
    size = text_bytes(text)
    found, totals = candidates(text, size, least, longest)
    words = F.split("phrase", " ")
    single = found.select("lang", F.explode(words).alias("phrase"))
    counts = cut(counted(text, found.unionByName(single).distinct(), size).where(F.col("f") >= least).withColumn("words", words))

    several = counts.where(F.size("words") > 1)
    at = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    named = skew_lookup(several, totals.join(several.groupBy("lang").agg(F.count("*").alias("_rows")), "lang"), "lang", "_rows", how="inner")
    cuts = cut(named.select("lang", "phrase", F.col("f").alias("a"), "n", "words", at).select("lang", "phrase", "a", "n", "k", part(F.lit(1), F.col("k")).alias("_first"), part(F.col("k") + 1, F.size("words")).alias("_rest")))
    cuts = looked_up(cut(looked_up(cuts, counts, "_first", "l")), counts, "_rest", "r")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({whole('a')} * ({whole('n')} * 1000)) div ({whole('l')} * {whole('r')})")
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")).select("lang", "phrase", "a", "n", "w.score", "w.l", "w.r")

    # runs of 2 words or more within a longer phrase
    runs = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inner = counts.where(F.size("words") > 2).select("lang", F.explode(runs).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_outer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where("_outer is null or 100 * _outer < " + str(absorb) + " * a").drop("_outer")

    # ranked over range partitions: no task has all phrases of a language
    ranked = cut(globally_ranked(kept, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "_place"))
    starts = cut(ranked.groupBy("lang").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows")))
    ranked = skew_lookup(ranked, starts, "lang", "_rows").withColumn("rank", F.col("_place") - F.col("_first") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
