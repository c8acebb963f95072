"""Answers of the bibliographic services, fetched over HTTPS by a Python data source.

spark.read.format("citations").option("dois", "10.1/a 10.1/b") or option("path", text files of DOIs, one
a line) gives a row for each DOI and service: source_name, doi_norm, payload, error_status,
error_reason, elapsed_ms. Payloads are parsed by `answers`. DOIs of the first option are dealt into
`partitions` buckets; of files each range of `partitionBytes` is a partition. A partition asks one
after the other. A table of DOIs, however large, is asked for in place by `fetch_all`. Nothing in the
verdict pipeline goes to the network.
"""

from __future__ import annotations

import io
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from attesta.functions.vocab import NOT_FOUND
from attesta.sources.parsers import PARSERS

AGENT = {"User-Agent": "attesta/1.0"}
EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
Get = Callable[[str, dict[str, str], float], str]


class Failed(Exception):
    def __init__(self, status: str, reason: str) -> None:
        super().__init__(reason)
        self.status, self.reason = status, reason


def get(url: str, headers: dict[str, str], timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=AGENT | headers), timeout=timeout) as answer:
        return answer.read().decode("utf-8")


def quoted(text: str, safe: str = "") -> str:
    return urllib.parse.quote(text, safe=safe)


def missing(call: Callable[[], str], reason: str) -> str:
    try:
        return call()
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise Failed("NOT_FOUND", reason) from e
        raise


def fetch_crossref(doi: str, fetch: Get, timeout: float) -> str:
    return json.dumps(json.loads(fetch(f"https://api.crossref.org/works/{quoted(doi)}", {}, timeout))["message"])


def fetch_openalex(doi: str, fetch: Get, timeout: float) -> str:
    query = urllib.parse.urlencode({"mailto": os.environ.get("ATTESTA_MAILTO", "attesta@example.org")})
    return missing(lambda: fetch(f"https://api.openalex.org/works/{quoted(f'doi:{doi}', ':')}?{query}", {}, timeout), NOT_FOUND["openalex"])


def fetch_semantic_scholar(doi: str, fetch: Get, timeout: float, delay: float = 2.0) -> str:
    """A refused request is repeated once, after a pause."""
    url = f"https://api.semanticscholar.org/graph/v1/paper/{quoted(f'DOI:{doi}', ':')}?fields=title,authors,year,abstract,externalIds,url,venue"
    key = os.environ.get("SEMANTIC_SCHOLAR_API_KEY")
    headers = {"x-api-key": key} if key else {}
    for last in (False, True):
        try:
            return missing(lambda: fetch(url, headers, timeout), NOT_FOUND["semantic_scholar"])
        except urllib.error.HTTPError as e:
            if e.code != 429:
                raise
            if last:
                raise Failed("RATE_LIMITED", "Semantic Scholar rate limit exceeded.") from e
            time.sleep(delay)
    raise AssertionError


def fetch_pubmed(doi: str, fetch: Get, timeout: float) -> str:
    found = json.loads(fetch(f"{EUTILS}esearch.fcgi?" + urllib.parse.urlencode({"db": "pubmed", "term": f"{doi}[AID]", "retmode": "json", "retmax": "2"}), {}, timeout))
    ids = [str(i) for i in found.get("esearchresult", {}).get("idlist", []) if str(i).strip()]
    if not ids:
        raise Failed("NOT_FOUND", NOT_FOUND["pubmed"])
    if len(ids) > 1:
        raise Failed("UNSUPPORTED", "PubMed returned multiple records for the DOI.")
    return missing(lambda: fetch(f"{EUTILS}efetch.fcgi?" + urllib.parse.urlencode({"db": "pubmed", "id": ids[0], "retmode": "xml"}), {}, timeout), NOT_FOUND["pubmed"])


FETCHERS = {"crossref": fetch_crossref, "openalex": fetch_openalex, "semantic_scholar": fetch_semantic_scholar, "pubmed": fetch_pubmed}


def ask(source: str, doi: str, fetch: Get = get, timeout: float = 20.0) -> tuple[str, str, str | None, str | None, str | None]:
    """A row that never raises: one DOI's trouble is no other's (OP-117)."""
    try:
        return source, doi, FETCHERS[source](doi, fetch, timeout), None, None
    except Failed as e:
        return source, doi, None, e.status, e.reason
    except TimeoutError as e:
        return source, doi, None, "TIMEOUT", str(e) or "Source lookup timed out."
    except Exception as e:  # noqa: BLE001
        return source, doi, None, "API_ERROR", str(e) or "Source lookup failed."


def timed(source: str, doi: str, timeout: float) -> tuple[Any, ...]:
    began = time.monotonic()
    return (*ask(source, doi, timeout=timeout), max(0, round((time.monotonic() - began) * 1000)))


class Bucket(InputPartition):
    def __init__(self, dois: list[str]) -> None:
        self.dois = dois


class Lines(InputPartition):
    """The lines of a file that begin from lo on, before hi."""

    def __init__(self, name: str, lo: int, hi: int) -> None:
        self.name, self.lo, self.hi = name, lo, hi


def files_of(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.dois, self.path = sorted(set(options.get("dois", "").split())), options.get("path")
        self.sources = [s for s in options.get("sources", " ".join(FETCHERS)).split() if s in FETCHERS]
        self.buckets, self.timeout = max(1, int(options.get("partitions", "1"))), float(options.get("timeout", "20"))
        self.step = int(options.get("partitionbytes", str(1 << 20)))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = [Bucket(self.dois[i :: self.buckets]) for i in range(self.buckets) if self.dois[i :: self.buckets]]
        if self.path:
            from pyarrow import fs

            system, root = files_of(self.path)
            infos = system.get_file_info([root])
            if infos[0].type == fs.FileType.Directory:
                infos = system.get_file_info(fs.FileSelector(root, recursive=True))
            for i in sorted((i for i in infos if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: i.path):
                out += [Lines(i.path, lo, min(i.size, lo + self.step)) for lo in range(0, i.size, self.step)]
        return out or [Bucket([])]

    def dois_of(self, partition: Bucket | Lines) -> Iterator[str]:
        if isinstance(partition, Bucket):
            yield from partition.dois
            return
        with files_of(self.path)[0].open_input_file(partition.name) as f:
            at = max(0, partition.lo - 1)  # the byte before tells whether a line begins here
            f.seek(at)
            lines = io.BufferedReader(f)
            if partition.lo:
                at += len(lines.readline())
            while at < partition.hi and (line := lines.readline()):
                at += len(line)
                if doi := line.decode("utf-8", "replace").strip():
                    yield doi

    def read(self, partition: Bucket | Lines) -> Iterator[tuple[Any, ...]]:
        for doi in self.dois_of(partition):
            for source in self.sources:
                yield timed(source, doi, self.timeout)


SCHEMA = "source_name string, doi_norm string, payload string, error_status string, error_reason string, elapsed_ms int"


class CitationsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "citations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def answers(fetched: DataFrame) -> DataFrame:
    """Fetched or landed payloads as source answers (schemas.SOURCE_ANSWER); each payload goes through its source's parser only."""
    record = F
    for source, parse in PARSERS.items():
        own = F.col("source_name") == source
        record = record.when(own & F.col("payload").isNotNull(), parse(F.when(own, F.col("payload"))))
    elapsed = ["elapsed_ms"] if "elapsed_ms" in fetched.columns else []
    return fetched.select("source_name", "doi_norm", record.alias("record"), "error_status", "error_reason", *elapsed)


def fetch(spark: SparkSession, dois: list[str], sources: list[str] | None = None, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(CitationsSource)
    return answers(spark.read.format("citations").option("dois", " ".join(dois)).option("sources", " ".join(sources or FETCHERS)).option("partitions", str(partitions)).load())


def fetch_all(dois: DataFrame, sources: list[str] | None = None, partitions: int = 16, timeout: float = 20.0) -> DataFrame:
    """Answers for the different values of dois (doi_norm), asked where Spark deals them: `partitions` tasks ask at a time, at most."""
    names = [s for s in sources or FETCHERS if s in FETCHERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [timed(s, doi, timeout) for doi in b.column(0).to_pylist() for s in names]
            kinds = [pa.string()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    wanted = dois.select("doi_norm").where("doi_norm is not null").distinct().repartition(partitions, "doi_norm")
    return answers(wanted.mapInArrow(run, SCHEMA))
