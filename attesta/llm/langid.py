"""Language ID: script ranges, per-word scores, and Viterbi decoding with a switching penalty."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import wordvec

#: Cells (buckets times languages) of a model: with more languages the n-grams share fewer buckets, so its size is bounded.
CELLS, MOST_BITS, LEAST_BITS = 1 << 24, 16, 6
#: Bytes of text that are scored at once for one to sixteen languages, and so many times fewer for more. A longer text is
#: read in pieces that end between words; of a word longer than a piece the sums pass from piece to piece.
PIECE = 1 << 17
#: Ranges of code points of the Unicode blocks that hold a script's letters.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xFB00, 0xFB06), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0xA640, 0xA69F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x0870, 0x08FF), ("arabic", 0xFB50, 0xFEFC),
    ("syriac", 0x0700, 0x074F), ("thaana", 0x0780, 0x07BF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("georgian", 0x1C90, 0x1CBF), ("georgian", 0x2D00, 0x2D2F),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF), ("kana", 0xFF66, 0xFF9F), ("bopomofo", 0x3100, 0x312F), ("han", 0x3005, 0x3005), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
)
#: Numbers of scripts: 0 is no letter, 1 a letter of another script.
SCRIPT_NAMES = ["", "other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
MARK = 255
SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@functools.cache
def scripts() -> np.ndarray:
    """The script of each code point up to the end of the second plane that is a letter, MARK for combining marks, else 0."""
    table = np.zeros(0x40000, np.uint8)
    table[[c for c in range(len(table)) if unicodedata.category(chr(c))[0] == "L"]] = SCRIPT_NAMES.index("other")
    for name, lo, hi in SCRIPTS:
        table[lo : hi + 1][table[lo : hi + 1] > 0] = SCRIPT_NAMES.index(name)
    table[[c for c in range(len(table)) if unicodedata.category(chr(c))[0] == "M"]] = MARK
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and how many bytes each takes."""
    if not len(data) or data.max() < 128:
        return data.astype(np.int64), np.ones(len(data), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    out = data[at].astype(np.int64)
    out[size > 1] &= (1 << (7 - size[size > 1])) - 1
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        out[more] = (out[more] << 6) | (data[at[more] + i] & 63)
    return out, size


@dataclass
class Words:
    """Runs of letters of one script, marks included, in lower-case texts: the text each is in, its place in code points, its script and n-gram buckets.

    Grams of word i are at grams[:, first[i] : first[i + 1]]: of three and of four bytes, ending at each byte and at the word's end.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def kinds(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The script of each code point, marks with that of what they stand on; `first` are true where a text begins."""
    kind = scripts()[np.minimum(points, len(scripts()) - 1)]
    if len(marks := np.flatnonzero(kind == MARK)):
        own = np.where((kind != MARK) | first, np.arange(len(kind)), 0)
        kind[marks] = kind[np.maximum.accumulate(own)[marks]]
        kind[kind == MARK] = 0
    return kind


def gram_buckets(spread: np.ndarray, bits: int) -> np.ndarray:
    """The buckets of the grams that end at each byte from the fourth on; a zero ends a word, and the three first bytes are what stands before."""
    b0, b1, b2, b3 = spread[3:], spread[2:-1], spread[1:-2], spread[:-3]
    b2 = b2 * (b1 > 0)
    b3 = b3 * (b2 > 0)
    three = b0 | (b1 << np.uint64(8)) | (b2 << np.uint64(16))
    shift = np.uint64(64 - bits)
    return np.stack([(three + np.uint64(1)) * SALTS[0] >> shift, ((three | (b3 << np.uint64(24))) + np.uint64(1)) * SALTS[1] >> shift]).astype(np.int32)


def split_words(data: np.ndarray, offsets: np.ndarray, bits: int = MOST_BITS) -> Words:
    points, size = code_points(data)
    at = np.cumsum(size) - size  # of code points in bytes
    base = np.searchsorted(at, offsets, "left")  # of texts in code points
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(base))
    new = np.zeros(len(points), bool)
    new[base[:-1][np.diff(base) > 0]] = True
    kind = kinds(points, new)
    letter = kind > 0
    begins = letter.copy()
    begins[1:] &= new[1:] | (kind[1:] != kind[:-1])
    idx = np.flatnonzero(letter)
    start = np.flatnonzero(begins)
    word = np.cumsum(begins)[idx] - 1
    count = np.bincount(word, minlength=len(start))
    # each word's bytes, and a zero after them
    inside = data[np.repeat(letter, size)]
    bytes_of = np.bincount(word, size[idx], minlength=len(start)).astype(np.int64)
    spread = np.zeros(len(inside) + len(start) + 3, np.uint64)
    spread[np.arange(len(inside)) + np.repeat(np.arange(len(start)), bytes_of) + 3] = inside
    return Words(doc[start], start - base[doc[start]], start + count - base[doc[start]], kind[start], gram_buckets(spread, bits), np.concatenate([[0], np.cumsum(bytes_of + 1)]))


def upto(data: np.ndarray, lo: int, most: int) -> int:
    """The end of the code point that ends `most` bytes after lo, or soon after."""
    hi = min(len(data), lo + most)
    while hi < len(data) and (data[hi] & 0xC0) == 0x80:
        hi += 1
    return hi


def long_word(data: np.ndarray, lo: int, script: int, most: int) -> int:
    """Where the word of a script that begins at lo ends."""
    while lo < len(data):
        hi = upto(data, lo, most)
        points, size = code_points(data[lo:hi])
        kind = scripts()[np.minimum(points, len(scripts()) - 1)]
        other = np.flatnonzero((kind != script) & (kind != MARK))
        if len(other):
            return lo + int(size[: other[0]].sum())
        lo = hi
    return lo


def in_pieces(data: np.ndarray, most: int, bits: int) -> Iterator[tuple[Words, bool]]:
    """The words of one text in pieces of about `most` bytes, placed in the whole text, each with whether its only word goes on in the next.

    Pieces end between words, so the words are those of the text at once. A word longer than a piece
    comes in several, all with its place in the text, and each gram of it is in one of them.
    """
    lo = at = 0
    while lo < len(data):
        hi = upto(data, lo, most)
        points, size = code_points(data[lo:hi])
        kind = kinds(points, np.arange(len(points)) == 0)
        ends = np.flatnonzero((kind[:-1] == 0) | (kind[1:] != kind[:-1]))
        if kind[-1] and hi < len(data) and not len(ends):
            hi = long_word(data, hi, kind[0], most)
            end = at + int(((data[lo:hi] & 0xC0) != 0x80).sum())
            for a in range(lo, hi, most):
                b = min(hi, a + most)
                spread = np.zeros(3 + b - a + (b == hi), np.uint64)
                before = min(3, a - lo)
                spread[3 - before : 3 + b - a] = data[a - before : b]
                grams = gram_buckets(spread, bits)
                yield Words(np.zeros(1, np.int64), np.array([at]), np.array([end]), kind[:1], grams, np.array([0, grams.shape[1]])), b < hi
        else:
            if kind[-1] and hi < len(data):
                hi = lo + int(size[: ends[-1] + 1].sum())
            end = at + int(((data[lo:hi] & 0xC0) != 0x80).sum())
            w = split_words(data[lo:hi], np.array([0, hi - lo]), bits)
            w.start, w.end = w.start + at, w.end + at
            yield w, False
        lo, at = hi, end


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # log-probability by bucket and language
    usual: np.ndarray  # whether a language uses a script
    penalty: float
    bits: int

    @property
    def piece(self) -> int:
        return max(1 << 10, PIECE * 16 // max(16, len(self.langs)))

    def gram_sums(self, w: Words) -> np.ndarray:
        out = np.empty((len(w.doc), len(self.langs)))
        step = max(1, (1 << 21) // len(self.langs))  # n-grams at once
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(w.first, w.first[lo] + step, "right")) - 1)
            g = w.grams[:, w.first[lo] : w.first[hi]]
            np.add.reduceat(self.score[g[0]] + self.score[g[1]], w.first[lo:hi] - w.first[lo], axis=0, out=out[lo:hi], dtype=np.float64)
            lo = hi
        return out

    def word_scores(self, w: Words, sums: np.ndarray | None = None) -> np.ndarray:
        """Of each word and language, against the best of the languages that use its script; `sums` are the words' `gram_sums`, where known."""
        out = self.gram_sums(w) if sums is None else sums
        possible = self.usual[w.script]
        best = np.where(possible, out, -np.inf).max(axis=1, keepdims=True, initial=-np.inf)
        return np.where(possible.any(axis=1)[:, None], np.where(possible, out - np.maximum(best, -1e300), -1e3), 0.0)

    def decode(self, s: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best path's language of each word, and each text's sums of scores.

        A switch costs `penalty`. If no run of words gains more than half of that by any other language
        than the one with the best sum, that language throughout is best: k stays elsewhere pay for at
        least k - 1 switches, and one stay alone gains nothing. Only the other texts are decoded step
        by step.
        """
        k = len(self.langs)
        totals = np.stack([np.bincount(doc, s[:, j], minlength=n) for j in range(k)], axis=1)
        best = totals.argmax(axis=1)
        path = best[doc]
        own = s[np.arange(len(s)), path]
        first = np.searchsorted(doc, np.arange(n + 1), "left")
        doubt = np.zeros(n, bool)
        for j in range(k):
            c = np.concatenate([[0.0], np.cumsum(s[:, j] - own)])
            apart = (c.max() - c.min() + 1) * doc
            low = np.minimum.accumulate(c[:-1] - apart) + apart
            gain = c[1:] - low
            doubt[doc[gain > self.penalty / 2]] = True
        for d in np.flatnonzero(doubt):
            way = Way(self.penalty, k)
            way.go(s[first[d] : first[d + 1]])
            path[first[d] : first[d + 1]] = way.back()
        return path, totals


class Way:
    """Viterbi over words that come piece by piece: the values of all languages, and for each word the best one before it and which languages it was left for."""

    def __init__(self, penalty: float, langs: int) -> None:
        self.penalty, self.langs, self.value = penalty, langs, None
        self.tops: list[int] = []
        self.left: list[np.ndarray] = []

    def go(self, s: np.ndarray) -> None:
        rows = s
        if self.value is None:
            self.value, rows = s[0], s[1:]
        if self.langs <= 16:  # lists are quicker than arrays of a few numbers
            left = self.few(rows.tolist())
        else:
            left = np.zeros((len(rows), self.langs), bool)
            for i, row in enumerate(rows):
                top = int(self.value.argmax())
                switched = self.value[top] - self.penalty
                left[i] = switched > self.value
                self.value = np.maximum(self.value, switched) + row
                self.tops.append(top)
            left = np.packbits(left, axis=1, bitorder="little")
        self.left.append(left)

    def few(self, rows: list[list[float]]) -> np.ndarray:
        value, penalty, masks = list(map(float, self.value)), self.penalty, []
        for row in rows:
            top = max(value)
            self.tops.append(value.index(top))
            top -= penalty
            if min(value) >= top:
                masks.append(0)
                value = [v + r for v, r in zip(value, row, strict=True)]
            else:
                masks.append(sum(1 << j for j, v in enumerate(value) if v < top))
                value = [(v if v >= top else top) + r for v, r in zip(value, row, strict=True)]
        self.value = np.array(value)
        return np.array(masks, "<u2").view(np.uint8).reshape(-1, 2)

    def back(self) -> np.ndarray:
        left = np.concatenate(self.left)
        now = int(self.value.argmax())
        out = np.empty(len(self.tops) + 1, np.int64)
        out[-1] = now
        for i in range(len(self.tops) - 1, -1, -1):
            if left[i, now >> 3] >> (now & 7) & 1:
                now = self.tops[i]
            out[i] = now
        return out


def lowered(text: str) -> Column:
    """The text in lower case, code point by code point."""
    return F.lower(F.translate(F.col(text), "\u0130", "i"))  # the one that would become two


def fit(docs: DataFrame, sample: int = 1000, penalty: float = 25.0) -> Model | None:
    """A model from docs (doc_id, text, lang) with text and lang: of each language
    about `sample` rows, or all of fewer, those with the least hashes of doc_id.

    Naive Bayes over hashed byte n-grams of words, add-one smoothed, and for each language the
    scripts that a hundredth of its words or more are in. Every language is learned: the driver gets a
    row for each, and a table of at most CELLS counts, since with more languages there are fewer
    buckets (2**LEAST_BITS at least, so the bound holds up to 262,144 languages). None without such rows.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    bits = max(LEAST_BITS, min(MOST_BITS, (CELLS // len(langs)).bit_length() - 1))
    # the share of a language's rows that makes `sample` of them, as a bound on the hash: no window over a frequent language's rows
    parts = docs.sparkSession.createDataFrame([(x, i, min(1 << 30, (sample << 30) // counts[x])) for i, x in enumerate(langs)], "lang string, _at int, _most long")
    texts = known.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_most")).select(F.col("_at").alias("lang"), lowered("text").alias("text"))
    size, width, every = 1 << bits, (1 << bits) + len(SCRIPT_NAMES), 1 << 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0

        def counted() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

        for b in batches:
            for lo, hi in wordvec.slices(b.column(1)):
                data, offsets = wordvec.text_bytes(b.column(1).slice(lo, hi - lo))
                lang = b.column(0).slice(lo, hi - lo).to_numpy().astype(np.int64) * width
                for w, goes_on in [(split_words(data, offsets, bits), False)] if hi - lo > 1 else in_pieces(data, 1 << 20, bits):
                    own = np.repeat(lang[w.doc], np.diff(w.first))
                    held += [own + w.grams[0], own + w.grams[1]] + [lang[w.doc] + size + w.script] * (not goes_on)
                    cells += 2 * len(own)
                    if cells > every:
                        yield counted()
                        held, cells = [], 0
        if held:
            yield counted()

    table = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((width, len(langs)), np.float32)
    cell = table["cell"].to_numpy()
    counts[cell % width, cell // width] = table["n"].to_numpy()
    grams, used = counts[:size] + np.float32(1), counts[size:]
    grams /= grams.sum(axis=0)
    return Model(langs, np.log(grams), used * 100 >= np.maximum(used.sum(axis=0), 1), penalty, bits)


class Labelled:
    """Texts' languages word by word: the path, and each text's language, score and number of letters."""

    def __init__(self, model: Model, w: Words, path: np.ndarray, totals: np.ndarray, n: int) -> None:
        size = (w.end - w.start).astype(float)
        scored = model.usual[w.script].any(axis=1)
        k = len(model.langs)
        bulk = np.bincount(w.doc[scored] * k + path[scored], size[scored], minlength=n * k).reshape(n, k)
        self.letters = np.bincount(w.doc, size, minlength=n)
        self.top = bulk.argmax(axis=1)
        rows = np.arange(n)
        beats = np.exp(np.minimum(0.0, totals - totals[rows, self.top][:, None])).sum(axis=1)
        self.score = bulk[rows, self.top] / np.maximum(self.letters, 1) / beats
        turn = np.ones(len(path), bool)
        turn[1:] = (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])
        at = np.flatnonzero(turn)
        self.lang, self.start, self.end = path[at], w.start[at], w.end[np.append(at[1:], len(path))[: len(at)] - 1]
        self.first = np.searchsorted(w.doc[at], np.arange(n + 1), "left")


def labelled(model: Model, data: np.ndarray, offsets: np.ndarray) -> Labelled:
    n = len(offsets) - 1
    w = split_words(data, offsets, model.bits)
    path, totals = model.decode(model.word_scores(w), w.doc, n) if len(w.doc) else (np.zeros(0, np.int64), np.zeros((n, len(model.langs))))
    return Labelled(model, w, path, totals, n)


def labelled_long(model: Model, data: np.ndarray) -> Labelled:
    """One text in pieces; the sums and the Viterbi values pass from piece to piece."""
    way, totals, parts, begun = Way(model.penalty, len(model.langs)), np.zeros((1, len(model.langs))), [], 0.0
    for w, goes_on in in_pieces(data, model.piece, model.bits):
        if len(w.doc):
            sums = model.gram_sums(w)
            sums[0] += begun
            begun = sums[0] if goes_on else 0.0
            if not goes_on:
                s = model.word_scores(w, sums)
                totals += s.sum(axis=0)
                way.go(s)
                parts.append((w.start, w.end, w.script))
    start, end, script = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    w = Words(np.zeros(len(start), np.int64), start, end, script.astype(np.uint8), np.zeros((2, 0)), np.zeros(0))
    return Labelled(model, w, way.back() if parts else np.zeros(0, np.int64), totals, 1)


def detect(docs: DataFrame, model: Model | None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score and spans, and the columns `keep`, for each row of docs (doc_id, text).

    Words are runs of letters of one script. The script narrows a word's languages; n-gram
    log-probabilities score them; the best sequence of languages, at a penalty for each switch, labels
    the words. spans: (lang, start, end) of runs of words in one language, in code points of the text.
    lang_pred: the language of the most letters, ties to the first by name. score: its share of the
    letters times the chance, by summed scores, that it beats the others.

    lang_pred is `und`, with score 0, for a null text, one without letters, or without a model. A
    text all in scripts that no learned language uses gets the first language, with score 0.
    Texts are read whole, where they are, long ones in pieces, with the same words and sums as in one, so memory does not grow with texts
    times languages; the model goes to every task (CELLS bounds it). Other columns are ignored, lang
    and source among them. Repeated rows get equal results; an empty table gives an empty one.
    """
    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    keep = [c for c in keep if c not in ("doc_id", "lang_pred", "score", "spans")]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", span), *[docs.schema[c] for c in keep]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"] if model else ["und"], object)
        for b in batches:
            for lo, hi in wordvec.slices(b.column(1), model.piece if model else PIECE):
                n = hi - lo
                data, offsets = wordvec.text_bytes(b.column(1).slice(lo, n))
                if model:
                    x = labelled_long(model, data) if len(data) > model.piece and n == 1 else labelled(model, data, offsets)
                    some = x.letters > 0
                    pred, score = np.where(some, x.top, -1), np.where(some, x.score, 0.0)
                    lang, start, end, first = x.lang, x.start, x.end, x.first
                else:
                    pred, score, first = np.full(n, -1), np.zeros(n), np.zeros(n + 1)
                    lang = start = end = np.zeros(0, np.int64)
                spans = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(names[lang], pa.string()), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], names=["lang", "start", "end"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(names[pred], pa.string()), pa.array(score), spans, *[c.slice(lo, n) for c in b.columns[2:]]], names=schema.names)

    return docs.select("doc_id", lowered("text").alias("_lower"), *keep).mapInArrow(run, schema)
