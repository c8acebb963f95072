"""Secret scans: known shapes, and strings that a primed compressor finds new."""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate: an unbroken string of the characters that keys are written in, with a letter; a short one has a digit or mixes cases.
KEY_CHARS = "A-Za-z0-9+/_=-"
CANDIDATE = re.compile(rf"(?<![{KEY_CHARS}])(?![0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?=[0-9+/_=-]*[A-Za-z])(?:[{KEY_CHARS}]{{16,}}|(?=[{KEY_CHARS}]{{12,15}}(?![{KEY_CHARS}]))(?:(?=[A-Za-z+/_=-]*[0-9])|(?=[A-Za-z+/_=-]*[a-z][A-Z]+[a-z]))[{KEY_CHARS}]{{12,15}})")
#: Words before a candidate that make its context sensitive.
SENSITIVE = re.compile(r"(?i:password|passwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|\bpwd\b|\bkey\b)")
#: What may part the candidates that carry a sensitive context on: a dot, or the end of a line, also a written-out one.
BETWEEN = re.compile(r"\.|\x20*\r?\n[\x20\t]*|\\(?:r\\)?")
#: Where a statement ends, and what the line that opens an indented block ends with.
STATEMENT_END = re.compile(r"\r?\n|;|(?<=[.!?])\s")
OPENS_BLOCK = re.compile(r"[:{\[(=>|]\s*$")
#: Characters before a candidate that count as its context whatever ends in them.
CLOSE = 64
#: The marks around a private key, and what is a line between them: a key's last line is often short, and some have no digit.
MARKER = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_LINE = re.compile(r"(?:(?<![^\s])|(?<=-----)|(?<=\\[nr]))([A-Za-z0-9+/=]+)(?=\s|\\[nr]|-----|$)")
#: What code and settings are made of; the compressor knows these before it sees a document.
IDENTIFIERS = (
    "import export function return const class public private static void string integer boolean config settings environment "
    "default value key token secret password credential authorization bearer client server request response header session user "
    "account database connection host port path file name id uuid version http https www api url json xml yaml true false null "
    "example sample test demo dummy placeholder changeme your here goes insert replace redacted "
    "get set put post delete update create read write open close begin end index count size length type object array list map "
)
#: Stretches that stand for keys where there are none.
FILLERS = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 aaaaaaaa xxxxxxxx ffffffff ________ ======== -------- "


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: Lengths up to which strings have a level of their own: the longer one is, the nearer its bytes a character come to its entropy.
LENGTHS = (16, 24, 40, 80, 200, 2000)


@dataclass
class Model:
    """A zstandard dictionary, and for each of LENGTHS the compressed bytes a character from which a string counts as new."""

    dictionary: bytes
    least: tuple[float, ...]

    def is_new(self, novelty: float, length: int) -> bool:
        return novelty >= self.least[min(bisect_left(LENGTHS, length), len(LENGTHS) - 1)]


def names_in(words: Sequence[tuple[str, int]], n: int, seed: int) -> list[str]:
    """n made-up names and settings from words, drawn by their counts: what stands in code and is no secret."""
    rng = random.Random(seed)
    drawn = rng.choices([w for w, _ in words], [c for _, c in words], k=4 * n)
    shapes = ("{}_{}", "{}-{}-{}", "{}.{}={}", "{}{}", "{} {} {}", "{}/{}/{}.{}", "{}({})", '"{}": "{}"')
    out = []
    for i in range(n):
        shape, own = shapes[i % len(shapes)], drawn[4 * i : 4 * i + 4]
        out.append(shape.format(*[w.capitalize() if i % 3 == 0 and j else w for j, w in enumerate(own)]))
    return out


def strings_like_keys(n: int, least: int, most: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters, string.ascii_letters + string.digits + "-_")
    return ["".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randint(least, most))) for i in range(n)]


def trained(words: Sequence[tuple[str, int]], size: int = 8192) -> Model:
    """A dictionary of names made from four in five of the words, and the levels that best tell strings like keys from names made from the rest."""
    known = [(w, 20) for w in IDENTIFIERS.split()] + list(words)
    unseen = known[::5]
    known = [x for i, x in enumerate(known) if i % 5]
    lines = [" ".join(names_in(known, 8, seed)).encode() for seed in range(1500)]
    dictionary = zstandard.train_dictionary(size, lines, k=64, d=8).as_bytes() + " ".join([FILLERS, *[w for w, _ in reversed(known[: size // 4])]]).encode()
    novelty = Novelty(Model(dictionary, ()))
    around = [" ".join(names_in(known, 12, 10_000 + i)) for i in range(100)]

    def measured(x: str, i: int) -> float:
        before = around[i % 100][:200]
        return novelty.of(f"{before} {x} {around[-1 - i % 100][:100]}", [(len(before) + 1, len(before) + 1 + len(x))], Spans([]))

    names = [re.sub(f"[^{KEY_CHARS}]+", "-", x) for x in names_in(unseen, 2000, 99_999)]
    levels, shortest = [], 12
    for most in LENGTHS:
        bad = sorted(measured(x, i) for i, x in enumerate(strings_like_keys(200, shortest, most, most)))
        good = []
        for i in range(200):
            x = names[i]
            while len(x) < shortest:
                x += "-" + names[(i * 7 + len(x)) % len(names)]
            while len(x) < (shortest + most) // 2 and most > 40:
                x += "-" + names[(i * 7 + len(x)) % len(names)]
            good.append(measured(x[:most], i))
        good.sort()
        # the level with the least errors, names counting three times: most of what is looked at is no secret
        errors = lambda v, bad=bad, good=good: bisect_left(bad, v) + 3 * (len(good) - bisect_left(good, v))
        tried = [x / 1000 for x in range(300, 1000, 5)]
        fewest = min(map(errors, tried))
        best = [v for v in tried if errors(v) == fewest]
        levels.append(best[len(best) * 3 // 4])  # of levels as good as each other, one nearer to the keys
        shortest = most + 1
    return Model(dictionary, tuple(levels))


def fit(docs: DataFrame, most: int = 2000) -> Model:
    """A model from the `most` words that stand most often near sensitive words in all docs (doc_id, text), ties by code point.

    Words are runs of 3 to 24 letters and underscores, so keys and numbers do not come into the
    dictionary. Counted over whole texts, by partial aggregation; the driver gets `most` rows. To
    these a fixed list of common identifiers is added, so an empty table gives a model as well.
    """
    context = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s)(?:{SENSITIVE.pattern}).{{0,80}}"), F.lit(0))
    near = docs.where(F.col("text").isNotNull()).select(F.explode(context).alias("c"))
    counts = near.select(F.explode(F.regexp_extract_all("c", F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_]{3,24}(?![A-Za-z0-9_])"), F.lit(0))).alias("w")).groupBy("w").count()
    return trained([(r["w"], r["count"]) for r in counts.orderBy(F.desc("count"), "w").limit(most).collect()])


class Novelty:
    """Bytes that a string adds to its compressed surroundings, per character."""

    def __init__(self, model: Model, context: int = 400) -> None:
        dictionary = zstandard.ZstdCompressionDict(model.dictionary)
        self.zstd = zstandard.ZstdCompressor(level=19, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.context, self.model = context, model

    def is_new(self, text: str, pieces: list[tuple[int, int]], blanks: Spans) -> bool:
        return self.model.is_new(self.of(text, pieces, blanks), sum(b - a for a, b in pieces))

    def of(self, text: str, pieces: list[tuple[int, int]], blanks: Spans) -> float:
        """Of the pieces together, as lines. Other copies of them, and the spans in blanks, do not count as surroundings: a repeated secret is no less secret."""
        said = [text[a:b] for a, b in pieces]
        start, end, far = pieces[0][0], pieces[-1][1], self.context + max(map(len, said))
        # blanked before the cut, so that no copy is left in part at an edge
        before, after = (blanks.out_of(text, a, b) for a, b in ((max(0, start - far), start), (end, end + far)))
        for x in sorted(set(said), key=len, reverse=True):
            before, after = before.replace(x, " " * len(x)), after.replace(x, " " * len(x))
        around = before[-self.context :] + "\n" + after[: self.context] + "\n"
        alone = len(self.zstd.compress(around.encode()))
        return (len(self.zstd.compress((around + "\n".join(said)).encode())) - alone) / sum(map(len, said))


class Spans:
    """Disjoint spans of a text, by start."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)

    def within(self, start: int, end: int) -> range:
        """Places of the spans that overlap this one."""
        return range(bisect_right(self.ends, start), bisect_left(self.starts, end))

    def out_of(self, text: str, start: int, end: int) -> str:
        """text from start to end with blanks for the spans."""
        out, at, end = [], start, min(end, len(text))
        for i in self.within(start, end):
            a, b = max(self.starts[i], start), min(self.ends[i], end)
            out += [text[at:a], " " * (b - a)]
            at = b
        return "".join([*out, text[at:end]])


def base_values(text: str, base: list[tuple[int, int, int]]) -> set[str]:
    """The candidates that known shapes hold as their values."""
    return {v for a, k, b in base for v in CANDIDATE.findall(ASSIGN.match(text, a)[2] if k == 0 else text[a:b])}


def key_blocks(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Start, end and lines of what stands between the marks of private keys; a block's headers are no lines of it."""
    out, start = [], None
    for m in MARKER.finditer(text) if "-----BEGIN" in text else ():
        if m[1] == "END" and start is not None:
            lines = [x.span(1) for x in KEY_LINE.finditer(text, start, m.start())]
            first = next((i for i, (a, b) in enumerate(lines) if b - a >= 16), len(lines))
            if first < len(lines):
                out.append((start, m.start(), lines[first:]))
        start = m.end() if m[1] == "BEGIN" else None
    return out


class Contexts:
    """Which places of a text are in the statement, or in the indented block, of a sensitive word."""

    def __init__(self, text: str) -> None:
        words = [m.span() for m in SENSITIVE.finditer(text)]
        self.text, self.starts, self.ends = text, [a for a, _ in words], [b for _, b in words]
        self.statements = [m.end() for m in STATEMENT_END.finditer(text)] if words else []
        self.blocks: Spans | None = None

    def word_in(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, start)
        return i < len(self.starts) and self.ends[i] <= end

    def sensitive_blocks(self) -> Spans:
        """The lines below one that opens a block and has a sensitive word, as long as they are indented more."""
        found, stack, at = [], [], 0
        for line in self.text.split("\n"):
            bare = line.strip()
            if bare:
                indent = len(line) - len(line.lstrip())
                while stack and stack[-1][0] >= indent:
                    stack.pop()
                inside = bool(stack) and stack[-1][1]
                if inside:
                    found.append((at, 0, at + len(line)))
                stack.append((indent, inside or (OPENS_BLOCK.search(line) is not None and self.word_in(at, at + len(line)))))
            at += len(line) + 1
        return Spans(found)

    def has(self, start: int, end: int) -> bool:
        if not self.starts:
            return False
        i = bisect_right(self.statements, start)
        low, high = self.statements[i - 1] if i else 0, self.statements[i] if i < len(self.statements) else len(self.text)
        if self.word_in(low, start) or self.word_in(end, high):
            return True
        if self.blocks is None:
            self.blocks = self.sensitive_blocks()
        return bool(self.blocks.within(start, end))


def sensitive_runs(text: str, taken: list[tuple[int, int, int]], blanks: Spans, reach: int | None) -> list[list[tuple[int, int]]]:
    """The candidates in sensitive contexts, those that carry one context on in one run."""
    blocks = key_blocks(text)
    inside = Spans([(a, 0, b) for a, b, _ in blocks])
    close = CLOSE if reach is None else reach
    contexts: list[Contexts] = []

    def near(start: int, end: int) -> bool:
        if SENSITIVE.search(text, max(0, start - close), start) is not None:
            return True
        if reach is None and not contexts:
            contexts.append(Contexts(text))
        return reach is None and contexts[0].has(start, end)

    places = [(*m.span(), None) for m in CANDIDATE.finditer(text) if not blanks.within(*m.span()) and not inside.within(*m.span())]
    if not places and not blocks:
        return []
    runs = [[x for x in lines if not blanks.within(*x)] for _, _, lines in blocks]
    # known shapes are not candidates, but what follows them directly is in their context
    run, last = None, 0
    for start, end, kind in sorted([*places, *[(a, b, k) for a, k, b in taken]], key=lambda x: x[:2]):
        follows = run is not None and start >= last and BETWEEN.fullmatch(text, last, start)
        if not follows:
            run = [] if kind in (0, 1) or near(start, end) else None
            runs += [run] if run is not None else []
        if run is not None and kind is None:
            run.append((start, end))
        last = max(last, end)
    return [r for r in runs if r]


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, reach: int | None = None) -> list[tuple[int, int, int]]:
    blanks = Spans(taken)
    runs = sensitive_runs(text, taken, blanks, reach)
    pieces = sorted(x for r in runs for x in r)
    if not pieces:
        return []
    starts, copies, found = [a for a, _ in pieces], defaultdict(list), set()
    for i, (a, b) in enumerate(pieces):
        copies[text[a:b]].append(i)
    todo, waiting = deque(range(len(pieces))), set(range(len(pieces)))

    def take(said: str) -> None:
        """All copies are found; what stands near them is measured again, without them."""
        for i in copies.pop(said, ()):
            found.add(i)
            blanks.add(*pieces[i])
            near = range(bisect_left(starts, pieces[i][0] - 2 * novelty.context), bisect_right(starts, pieces[i][1] + novelty.context))
            again = [j for j in near if j not in waiting and j not in found]
            todo.extend(again)
            waiting.update(again)

    for said in base_values(text, taken):
        take(said)
    for run in runs:
        if len(run) > 1 and novelty.is_new(text, run, blanks):
            for a, b in run:
                take(text[a:b])
    while todo:
        i = todo.popleft()
        waiting.discard(i)
        if i not in found and novelty.is_new(text, pieces[i : i + 1], blanks):
            take(text[slice(*pieces[i])])
    return [(pieces[i][0], 3, pieces[i][1]) for i in sorted(found)]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with every union of overlapping spans replaced by mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: Model | None = None, reach: int | None = None, redact: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans and base_sha256 for each row of docs (doc_id, text).

    Known shapes are always reported: assignments to password-like names, access keys and long
    hexadecimal strings. The method adds strings (kind 'novel') of key characters (see CANDIDATE; pure
    numbers and dates are none) that stand in the context of a sensitive word, overlap no known
    shape, and add at least as many compressed bytes a character to their surroundings as the model says for their length, by
    zstandard primed with the model's dictionary (see `fit`; without a model, one of common
    identifiers only). A sensitive word's context is its statement, on either side of it, up to the end of
    the line, a semicolon or the end of a sentence; the indented block below a line that has the word and opens
    one; and CLOSE characters after it in any case. With `reach`, it is so many characters after it
    and no more. A candidate parted from one in such a context, or from a known
    assignment or access key, by no more than a dot or the end of a line is in its context too, and so
    is all between the marks of a private key; such runs are reported whole if they add as much
    together, else those of their candidates that do by themselves. Random letters and digits add 0.8 to 1, words and likenesses of
    what stands near them less. Other copies of the string and spans already found are blanked
    out of the surroundings; once one copy, or a known shape's value, is found, so are all copies in
    sensitive contexts. Spans are kind:start:end in code points, end exclusive, by start, then kind.

    With `redact` there is also the column redacted, the text with that mark for every span (null
    stays null); `keep` names columns that are carried along. Null or empty text has no spans, and base_sha256 that of the empty string. Every
    row is scanned whole, in the task that read it, in time that grows with its length; nothing is
    shuffled. Rows that repeat get equal results, an empty table an empty one. Other columns are
    ignored, and of `keep` those that the scan makes.
    """
    model = model or trained(())
    keep = [c for c in keep if c not in ("doc_id", "base_spans", "spans", "base_sha256", "redacted", *[f"n_{k}" for k in KINDS])]
    fields = [docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], *[T.StructField(n, T.StringType()) for n in ("base_spans", "spans", "base_sha256")]]
    schema = T.StructType(fields + ([T.StructField("redacted", T.StringType())] if redact is not None else []) + [docs.schema[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows, marked = [], []
                for text in batch.column(1).slice(lo, 500).to_pylist():
                    base = base_spans(text) if text else []
                    more = novel_spans(text, base, novelty, reach) if text else []
                    n = [0] * len(KINDS)
                    for _, k, _ in base + more:
                        n[k] += 1
                    rows.append((*n, listed(base), listed(base + more), hashlib.sha256(listed(base).encode()).hexdigest()))
                    if redact is not None:
                        marked.append(text and redacted(text, base + more, redact))
                kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 3
                arrays = [batch.column(0).slice(lo, 500), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(marked, pa.string())] if redact is not None else []) + [c.slice(lo, 500) for c in batch.columns[2:]], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("_text"), *keep).mapInArrow(run, schema)
