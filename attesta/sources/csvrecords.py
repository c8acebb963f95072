"""CSV files read in splits that may end anywhere, also inside a quoted field.

A line break in quotes is part of its record, and only all that stands before a line tells whether it
begins in quotes. So the splits are read twice: first each says where it would end, in quotes or not,
from either beginning, and how many records begin in it; both beginnings soon lead to one state, from
where one reading serves both. These few numbers, put together in order, give each split its true
beginning and the lines of its whole records, which are read where they are. The lines of a record
that spans splits, known by their places, are put together.
"""

from __future__ import annotations

import csv
import itertools
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of a split: its first line's id and its number of lines; how many lines go on with a record that was
#: open before; then for a beginning outside and in quotes whether it ends in quotes, the records that
#: begin, and the line where one that stays open begins. head is the text of a file's first record.
ENDS = "file string, block long, first long, lines long, lead long, out_quoted boolean, in_quoted boolean, out_records long, in_records long, out_tail long, in_tail long, head string"
RECORDS = "file string, record long, row_number long, values array<string>"
#: Records that a task hands on at a time.
BATCH = 10_000

def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line that begins in quotes, or outside, ends in quotes. A quote opens a field only where one begins, after blanks."""
    if '"' not in line:
        return quoted
    at = 0
    while True:
        if not quoted:
            while line[at : at + 1] == " ":
                at += 1
            quoted = line[at : at + 1] == '"'
            at += quoted
        if quoted:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            quoted = False
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def is_blank(line: str) -> bool:
    return line in ("", "\r")


def splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, Iterator[str]]]:
    """file and block, the first line's id, and the lines of each split; a task's splits come one after another."""

    def pieces() -> Iterator[tuple[tuple[str, int], int, list[str]]]:
        for b in batches:
            files, blocks, ids = b.column("file"), b.column("block"), b.column("at")
            at, lines = 0, b.column("value").to_pylist()
            while at < len(lines):
                key, end = (files[at].as_py(), blocks[at].as_py()), len(lines)
                if (files[end - 1].as_py(), blocks[end - 1].as_py()) != key:
                    end = next(i for i in range(at, end) if (files[i].as_py(), blocks[i].as_py()) != key)
                yield key, ids[at].as_py(), lines[at:end]
                at = end

    for key, group in itertools.groupby(pieces(), key=lambda p: p[0]):
        _, first, lines = next(group)
        yield key, first, itertools.chain(lines, itertools.chain.from_iterable(p[2] for p in group))


def open_reader(lines: Iterable[str]) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader((line + "\n" for line in lines), skipinitialspace=True)


def split_end(lines: Iterator[str], wants_head: bool) -> tuple:
    """The columns of ENDS from lines on."""
    state, records, began, lead, n = [False, True], [0, 0], [0, 0], None, 0
    head: list[str] | None = [] if wants_head else None
    whole = None
    while state[0] or state[1]:
        line = next(lines, None)
        if line is None:
            break
        for i in (0, 1):
            if not state[i] and not is_blank(line):
                records[i], began[i] = records[i] + 1, n
            state[i] = ends_quoted(line, state[i])
        n += 1
        if lead is None and not state[1]:
            lead = n
        if head is not None and whole is None and records[0]:
            head.append(line)
            whole = None if state[0] else "\n".join(head)
    else:
        # outside in both: one reading serves both
        held: list[str] = []
        last: list[str] = []

        def noted() -> Iterator[str]:
            for line in lines:
                held.append(line)
                yield line

        for values in open_reader(noted()):
            n += len(held)
            last, held = held, []
            if values:
                records = [r + 1 for r in records]
                if head is not None and whole is None and records[0] == 1:
                    whole = "\n".join(last)
        for line in last:
            state[0] = ends_quoted(line, state[0])
        if state[0]:
            state, began = [True, True], [n - len(last)] * 2
            whole = whole if records[0] > 1 else None
    lead = n if lead is None else lead
    tails = [max(began[i], lead * i) if state[i] else n for i in (0, 1)]
    return n, lead, *state, *records, *tails, whole


def split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ENDS for each split."""
    names = [c.split()[0] for c in ENDS.split(", ")]
    for (file, block), first, lines in splits(batches):
        row = (file, block, first, *split_end(lines, block == 0))
        kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


class Start(NamedTuple):
    """Where a split's whole records stand among its lines, and the numbers of the first of them."""

    skip: int
    stop: int
    record: int
    row_number: int


def whole_records(starts: dict[tuple[str, int], Start]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records that no split's edge cuts, numbered in their file from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, lines in splits(batches):
            start, done = starts[key], 0
            rows = filter(None, open_reader(itertools.islice(lines, start.skip, start.stop)))
            while some := list(itertools.islice(rows, BATCH)):
                for values in some:
                    if values[0][:1] == "\ufeff":
                        values[0] = values[0].lstrip("\ufeff").lstrip(" ")
                numbers = [pa.array(range(n + done, n + done + len(some)), pa.int64()) for n in (start.record, start.row_number)]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(some), pa.string()), *numbers, pa.array(some, pa.list_(pa.string()))], names=[c.split()[0] for c in RECORDS.split(", ")])
                done += len(some)

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def fields(record: pd.Series) -> pd.Series:
    """The values of one record each; blanks before a value go."""
    csv.field_size_limit(sys.maxsize)
    return record.map(lambda r: next(csv.reader([r.lstrip("\ufeff").rstrip("\r\n")], skipinitialspace=True), []))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of `headed_records`."""
    return headed_records(spark, path)[0]


def headed_records(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """file, record (from 0 in each file, the header's), row_number and values of each record of CSV files, at any split size; and the first record of each file.

    row_number is record + 1, and goes on over several files in the order of their paths, of whose
    first records each is a header.
    Quotes are doubled inside quotes; lines end with a line feed, with or without a carriage return.
    Empty lines are no records. The driver gets a row for each split. The lines of a record that spans
    splits are put together by its number; an open quote runs to the file's end.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("at"), "value")
    starts: dict[tuple[str, int], Start] = {}
    torn: list[tuple] = []  # file, block, record, row_number and the ids of the first line and past the last, two a split at most
    heads: dict[str, str | None] = {}
    before, quoted, record, last = 0, False, 0, None
    for r in sorted(lines.mapInArrow(split_ends, ENDS).collect()):
        if r["file"] != last:
            before += max(0, record - 1)
            quoted, record, last = False, 0, r["file"]
        side, place_of = ("in" if quoted else "out"), (r["file"], r["block"])
        skip, stop, began = (r["lead"] if quoted else 0), r[f"{side}_tail"], r[f"{side}_records"]
        if quoted:
            torn.append((*place_of, record - 1, record + before, r["first"], r["first"] + skip))
        if not record and began:
            heads[r["file"]] = r["head"]
        starts[place_of] = Start(skip, stop, record, record + before + 1)
        record, quoted = record + began, r[f"{side}_quoted"]
        if stop < r["lines"]:
            torn.append((*place_of, record - 1, record + before, r["first"] + stop, r["first"] + r["lines"]))
    records = lines.mapInArrow(whole_records(starts), RECORDS)
    if torn:
        records = records.unionByName(torn_records(spark, lines, torn))
    unknown = [f for f, text in heads.items() if text is None]
    found = {r["file"]: r["values"] for r in first_records(records, unknown)}
    known = {f: next(csv.reader([text.lstrip("\ufeff").rstrip("\r\n")], skipinitialspace=True), []) for f, text in heads.items() if text is not None}
    return records, known | found


def torn_records(spark: SparkSession, lines: DataFrame, torn: list[tuple]) -> DataFrame:
    pieces = spark.createDataFrame(torn, "file string, block long, record long, row_number long, first long, past long")
    parts = lines.join(F.broadcast(pieces), ["file", "block"]).where("at >= first and at < past")
    joined = parts.groupBy("file", "record", "row_number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["value"]), "\n")
    return joined.select("file", "record", "row_number", fields(text).alias("values"))


def first_records(records: DataFrame, files: list[str]) -> list[Row]:
    """Headers that no first split has whole."""
    return records.where((F.col("record") == 0) & F.col("file").isin(files)).collect() if files else []
