"""Lookups of a stream of DOIs: asked once, within each service's rate, and later again where a service refused."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from attesta.sources import live

Ask = Callable[[str, str], tuple[Any, ...]]
#: Requests a second that each service is asked.
RATES = {"crossref": 10.0, "openalex": 10.0, "semantic_scholar": 1.0, "pubmed": 3.0}
REFUSED = ("RATE_LIMITED", "TIMEOUT")
COLUMNS = [c.split()[0] for c in live.SCHEMA.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Share:
    """One task's share of a rate that `tasks` tasks keep together: its slots lie tasks / rate seconds apart, shifted by its number.

    A task waits for the slot of each request, and for one more after the last, so a batch takes as
    long as its requests may, and the next one begins within the rate.
    """

    def __init__(self, rate: float, tasks: int, number: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.every, self.clock, self.sleep = tasks / rate, clock, sleep
        self.slot = clock() + number / rate

    def wait(self) -> None:
        if (left := self.slot - self.clock()) > 0:
            self.sleep(left)
        self.slot = max(self.slot, self.clock()) + self.every


def paced(rows: Iterator[tuple[str, str]], shares: Mapping[str, Share], ask: Ask) -> Iterator[tuple[Any, ...]]:
    """The answer to each (source, doi), each asked in a slot of its source's share."""
    used = set()
    for source, doi in rows:
        shares[source].wait()
        used.add(source)
        yield ask(source, doi)
    for source in used:
        shares[source].wait()


def ask_service(source: str, doi: str) -> tuple[Any, ...]:
    return live.timed(source, doi, 20.0)


def asker(rates: Mapping[str, float], tasks: int, ask: Ask) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shares = {s: Share(r, tasks, context.partitionId() if context else 0) for s, r in rates.items()}
        pairs = (p for b in batches for p in zip(b.column("source_name").to_pylist(), b.column("doi_norm").to_pylist(), strict=True))
        kinds = [pa.string()] * 5 + [pa.int32()]
        for row in paced(pairs, shares, ask):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=COLUMNS)

    return run


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The answers below path; none where nothing is there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(live.SCHEMA).parquet(path) if there else spark.createDataFrame([], live.SCHEMA)


def ask_stream(dois: DataFrame, path: str, checkpoint: str, rates: Mapping[str, float] = RATES, tasks: int = 4, ask: Ask = ask_service) -> StreamingQuery:
    """Asks the services of `rates` for a stream of dois (doi_norm) and appends their answers (live.SCHEMA) below path.

    The stream's own source keeps the offsets. A batch asks only for what has no answer below path, so
    a DOI that comes again, or a batch that is run again after a restart, asks nothing twice; answers
    land with the commit of their batch. At most `tasks` tasks ask at a time and share each service's
    rate (see `Share`). Null DOIs are not asked. Refusals are answers too, and left to `retry_refused`.
    """
    names = F.explode(F.array(*[F.lit(s) for s in rates])).alias("source_name")

    def batch(df: DataFrame, _: int) -> None:
        known = landed(df.sparkSession, path).select("source_name", "doi_norm")
        wanted = df.select("doi_norm").where("doi_norm is not null").distinct().select(names, "doi_norm").join(known, ["source_name", "doi_norm"], "left_anti")
        wanted.repartition(tasks, "doi_norm").mapInArrow(asker(rates, tasks, ask), live.SCHEMA).write.mode("append").parquet(path)

    return dois.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Retry(StatefulProcessor):
    """A refused (source_name, doi_norm) waits for its timer, is asked again, and waits twice as long if refused again; its state goes with its answer."""

    def __init__(self, first_ms: int, most: int, ask: Ask) -> None:
        self.first_ms, self.most, self.ask = first_ms, most, ask

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for _ in rows:
            pass
        if not self.tries.exists():
            self.tries.update((0,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.first_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        n = self.tries.get()[0] + 1
        row = self.ask(*key)
        if row[3] in REFUSED and n < self.most:
            self.tries.update((n,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.first_ms * 2**n)
            return iter(())
        self.tries.clear()
        return iter([Row(**dict(zip(COLUMNS, row, strict=True)))])

    def close(self) -> None:
        pass


def retry_refused(answers: DataFrame, first_ms: int = 2000, most: int = 5, ask: Ask = ask_service) -> DataFrame:
    """The answers that refused requests among a stream of answers (live.SCHEMA) get later, by timers; the last refusal after `most` tries.

    Other answers pass by. A DOI that is refused again while it waits does not wait twice. Timed by
    processing time; the state store must be RocksDB's, which is set for the session here.
    """
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    refused = answers.where(F.col("error_status").isin(*REFUSED)).select("source_name", "doi_norm")
    return refused.groupBy("source_name", "doi_norm").transformWithState(Retry(first_ms, most, ask), live.SCHEMA, "Update", "ProcessingTime")
