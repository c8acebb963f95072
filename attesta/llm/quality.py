"""Quality by line labelling: a linear-chain conditional random field marks content and boilerplate."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import wordvec

FEATURES = ("bias", "length", "symbols", "other marks", "capitals", "digits", "repeats an earlier line", "repeated windows", "repeats the last word", "ends a sentence", "word length", "words")
SYMBOLS, MARKS, STOPS = b"#*$%&|<>", b"!?\"'()+,-/:;=@[]\\^_`{}~", b".!?"


def byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


@dataclass
class Assessed:
    """Counts of each text and, of its lines that have a word, features, sizes in code points and numbers."""

    counts: dict[str, np.ndarray]
    x: np.ndarray
    size: np.ndarray
    number: np.ndarray
    first: np.ndarray  # of each text's lines, and the end


def assess_texts(texts: pa.Array) -> Assessed:
    data, offsets = wordvec.text_bytes(texts)
    n = len(texts)
    w = wordvec.words(data, offsets)
    inside = ~wordvec.is_space(data)
    head = (data & 0xC0) != 0x80  # first bytes of code points
    lines = wordvec.runs(data, offsets, data == 10)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    text_sum = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    inside_sum, symbol_sum = sums(inside), sums(byte_table(SYMBOLS)[data])

    # words in windows of three that the text has twice or more
    word, _ = wordvec.interned(data, w)
    window, at = wordvec.window_ids(word, w.doc, 3)
    _, own, often = np.unique(w.doc[at] * (window.max(initial=0) + 1) + window, return_inverse=True, return_counts=True)
    same = often[own.reshape(-1)] > 1
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + 3, -1)
    covered = np.cumsum(cover)[:-1] > 0

    wordy = inside_sum[lines.end] > inside_sum[lines.start]
    line = wordvec.interned(data, lines)[0][wordy]
    start, end, doc = lines.start[wordy], lines.end[wordy], lines.doc[wordy]
    again = np.ones(len(start), bool)
    again[np.unique(doc * (line.max(initial=0) + 1) + line, return_index=True)[1]] = False
    counts = {
        "n_words": np.bincount(w.doc, minlength=n),
        "word_chars": text_sum(sums(inside & head)),
        "n_symbols": text_sum(symbol_sum),
        "n_dup_lines": np.bincount(doc[again], minlength=n),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n),
    }

    of = lambda c: c[end] - c[start]
    line_words = np.searchsorted(w.start, end, "left") - np.searchsorted(w.start, start, "left")
    first_word = np.searchsorted(w.start, start, "left")
    word_sum = lambda mask: (c := sums(mask))[first_word + line_words] - c[first_word]
    stutter = np.zeros(len(w.start), bool)
    stutter[1:] = (word[1:] == word[:-1]) & (w.doc[1:] == w.doc[:-1])
    chars = of(sums(head)).astype(float)
    letters = np.maximum(of(inside_sum), 1)
    last = data[np.maximum(w.end[np.maximum(first_word + line_words - 1, 0)] - 1, 0)] if len(w.end) else np.zeros(len(start), np.uint8)
    capitals = sums((data >= 65) & (data <= 90))
    x = np.stack([
        np.ones(len(start)), np.log1p(chars) / 5, np.minimum(1, 5 * of(symbol_sum) / letters), np.minimum(1, 5 * of(sums(byte_table(MARKS)[data])) / letters), np.minimum(1, 2 * of(capitals) / letters),
        np.minimum(1, 5 * of(sums((data >= 48) & (data <= 57))) / letters), again.astype(float), word_sum(covered) / np.maximum(line_words, 1), word_sum(stutter) / np.maximum(line_words, 1), byte_table(STOPS)[last].astype(float),
        np.minimum(2, letters / np.maximum(line_words, 1) / 10), np.log1p(line_words) / 5,
    ], axis=1)
    return Assessed(counts, x, chars, lines_numbers(data, offsets, start, doc), np.searchsorted(doc, np.arange(n + 1), "left"))


def lines_numbers(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The number, from 0, of the line of its text that begins at each start."""
    breaks = np.flatnonzero(data == 10)
    return np.searchsorted(breaks, start, "left") - np.searchsorted(breaks, offsets[doc], "left")


@dataclass
class Model:
    """Boilerplate's score of a line is x @ weight, content's is 0; trans[a, b] is added where label b follows a (1: boilerplate)."""

    weight: np.ndarray
    trans: np.ndarray

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labelling of each text's lines."""
        gain = (x @ self.weight).tolist()
        (t00, t01), (t10, t11) = self.trans.tolist()
        label = np.zeros(len(gain), bool)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b = 0.0, gain[lo]
            back = []
            for g in gain[lo + 1 : hi]:
                from0, from1 = b + t10 > a + t00, b + t11 >= a + t01
                a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + g
                back.append((from0, from1))
            now = b > a
            label[hi - 1] = now
            for i in range(len(back) - 1, -1, -1):
                now = back[i][now]
                label[lo + i] = now
        return label


def fit_chain(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 150, prior: float = 1e-4, sticky: float = 1e-4, chunk: int = 48) -> Model:
    """Maximum a-posteriori weights by gradient steps (Adam) with forward-backward sums; longer texts train as chunks of lines.

    Every text counts the same, however many lines it has. prior and sticky are the precisions of the
    weights and of the transitions.
    """
    cuts = np.concatenate([np.arange(lo, hi, chunk) for lo, hi in zip(first[:-1], first[1:], strict=True) if lo < hi] + [[len(y)]]).astype(int)
    size = np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    cuts, size = cuts[:-1][order], size[order]
    steps = [cuts[: int(np.searchsorted(-size, -t, "left"))] + t for t in range(int(size.max(initial=0)))]  # rows of each position
    each = np.repeat(1 / np.maximum(np.diff(first), 1), np.diff(first))
    total = each.sum()
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    pair = np.zeros((2, 2))
    for t in range(1, len(steps)):
        np.add.at(pair, (y[steps[t] - 1], y[steps[t]]), each[steps[t]])
    seen = x.T @ (each * y)
    move, scale = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for r in range(1, rounds + 1):
        score = np.stack([np.zeros(len(y)), x @ model.weight], axis=1)
        fore, back = np.zeros_like(score), np.zeros_like(score)
        for t, rows in enumerate(steps):
            fore[rows] = score[rows] + (np.logaddexp.reduce(fore[rows - 1][:, :, None] + model.trans, axis=1) if t else 0)
        for t in range(len(steps) - 2, -1, -1):
            rows = steps[t + 1]
            back[rows - 1] = np.logaddexp.reduce(model.trans + (score[rows] + back[rows])[:, None, :], axis=2)
        both = fore + back
        whole = np.logaddexp.reduce(both, axis=1)
        p = np.exp(both[:, 1] - whole)
        rows = np.concatenate(steps[1:]) if len(steps) > 1 else np.zeros(0, int)
        chance = np.exp(fore[rows - 1][:, :, None] + model.trans + (score[rows] + back[rows])[:, None, :] - whole[rows][:, None, None])
        expected = np.einsum("nij,n->ij", chance, each[rows])
        grad = np.concatenate([(seen - x.T @ (each * p)) / total - prior * model.weight, ((pair - expected) / total - sticky * model.trans).ravel()])
        move, scale = 0.9 * move + 0.1 * grad, 0.99 * scale + 0.01 * grad**2
        step = 0.1 * (move / (1 - 0.9**r)) / (np.sqrt(scale / (1 - 0.99**r)) + 1e-9)
        model = Model(model.weight + step[:-4], model.trans + step[-4:].reshape(2, 2))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 750, lines: int = 256) -> Model | None:
    """A model from labelled documents: labels (doc_id, quality 0 or 1), of each quality the `sample` rows least by a hash of doc_id.

    Lines of good documents are content. Those of bad ones are what a first pass, which looks at lines
    one by one and takes them all for boilerplate, says of them; so good lines in bad documents count
    as content, and the transitions are learned from runs of both. Of a document with more
    than `lines` lines a stretch of that length is taken, at a place that a hash of doc_id says, and
    of rows with one doc_id the text with the least hash; so the driver holds at most 2 * sample * lines lines'
    features, never texts. None if either quality is missing.
    """
    ids = [labels.where(F.col("quality") == q).select("doc_id", F.lit(q).alias("quality")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    single = chosen.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in wordvec.slices(b.column(1)):
                a = assess_texts(b.column(1).slice(at, end - at))
                parts = []
                for i, (lo, hi) in enumerate(zip(a.first[:-1].tolist(), a.first[1:].tolist(), strict=True), at):
                    lo += zlib.crc32(str(b.column(0)[i]).encode()) % max(1, hi - lo - lines + 1)
                    parts.append(a.x[lo : min(hi, lo + lines)].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), b.column(2).slice(at, end - at), pa.array(parts, pa.binary())], names=["doc_id", "quality", "x"])

    rows = single.select("doc_id", "text", "quality").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("x", T.BinaryType())])).collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["quality"], r["doc_id"]))
    if {r["quality"] for r in rows} != {0, 1}:
        return None
    xs = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, len(FEATURES)) for r in rows]
    x, first = np.concatenate(xs).astype(float), np.cumsum([0, *map(len, xs)])
    bad = np.repeat([int(r["quality"] == 0) for r in rows], np.diff(first))
    alone = fit_chain(x, bad, first, sticky=1e3)
    return fit_chain(x, bad * alone.decode(x, first), first)


def assess(docs: DataFrame, model: Model | None, share: float = 0.5, min_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """Counts and verdict for each row of docs (doc_id, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer
    than min_words words, or over most_repeats per cent of them in 3-word windows that repeat),
    content_share (characters of the lines labelled content), boilerplate (numbers, from 0, of the
    other lines) and kept (not base_failed, and content_share at least `share`).

    Lines are what \\n separates and labelled if they have a word. Without a model every line is
    content. A text without a word, or null, has counts 0, content_share 0 and fails. Texts are
    read whole, in the task that reads them; nothing is shuffled. Repeated rows get equal results, an
    empty table gives an empty one. Other columns are ignored.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("boilerplate", T.ArrayType(T.IntegerType())), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in wordvec.slices(b.column(1)):
                a = assess_texts(b.column(1).slice(lo, hi - lo))
                label = model.decode(a.x, a.first) if model else np.zeros(len(a.x), bool)
                doc = np.repeat(np.arange(hi - lo), np.diff(a.first))
                content = np.bincount(doc, a.size * ~label, minlength=hi - lo) / np.maximum(np.bincount(doc, a.size, minlength=hi - lo), 1)
                failed = (a.counts["n_words"] < min_words) | (100 * a.counts["n_repeat_words"] > most_repeats * a.counts["n_words"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[label], minlength=hi - lo))]).astype(np.int32)
                boiler = pa.ListArray.from_arrays(pa.array(ends), pa.array(a.number[label].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(a.counts[c].astype(np.int64)) for c in counts], pa.array(failed), pa.array(content), boiler, pa.array(~failed & (content >= share))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
