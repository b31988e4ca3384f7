"""A paged, sorted search service: as a data source with a task for each page, and asked once for each row of a table.

How a service is reached is a transport: a factory named ``module:function`` whose result is called with
(query, start, rows, sort) and gives a ``Reply``. ``http`` asks a server, ``stored`` answers from
files that Spark wrote. Requests that a service refuses for the moment (429, 5xx, no connection, no
answer in time) are made again, each time after twice the wait, or after what the service asks for.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import qlang
from ..operators._stored import store

PAGE_SCHEMA = "name string, query string, rank int, doc string"
#: A page holds so many times the documents that are wanted, as some will be left out; so many pages are read.
OVER_FETCH, PAGES = 3, 3
#: Abstracts of fewer characters aren't sampled.
LEAST_ABSTRACT = 100
#: Seconds between the requests of one task, and before the first repetition of a request.
DELAY, BACK_OFF = 0.5, 1.0
RETRIES = 3
#: Statuses after which a request is made again; 0 and 408 are those of a service that didn't answer.
_AGAIN = frozenset({0, 408, 429, 500, 502, 503, 504})


@dataclass
class Reply:
    """What a service said: an HTTP status, the documents of a page, how many there are in all, a message."""

    status: int = 200
    docs: list[dict] = field(default_factory=list)
    found: int = 0
    message: str = ""
    wait: float | None = None


Transport = Callable[[str, int, int, str], Reply]


def http(url: str, fields: str = "bibcode", token_env: str = "SEARCH_API_KEY", timeout: float = 30.0) -> Transport:
    """A server that answers in JSON as ``{"response": {"numFound": n, "docs": [...]}}``; its key is in an
    environment variable of the executors, never in a plan."""
    import os
    import urllib.error
    import urllib.parse
    import urllib.request

    def ask(query: str, start: int, rows: int, sort: str) -> Reply:
        asked = urllib.parse.urlencode({"q": query, "fl": fields, "rows": rows, "start": start, "sort": sort})
        request = urllib.request.Request(f"{url}?{asked}", headers={"Authorization": f"Bearer {os.environ.get(token_env, '')}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                said = json.load(r).get("response", {})
                return Reply(200, said.get("docs", []), said.get("numFound", 0))
        except urllib.error.HTTPError as e:
            body, wait = e.read().decode("utf-8", "replace"), e.headers.get("Retry-After", "")
            try:
                message = json.loads(body)["error"]["msg"]
            except (ValueError, KeyError, TypeError):
                message = body[:200]
            return Reply(e.code, message=message, wait=float(wait) if wait.isdigit() else None)

    return ask


def _key(query: str, sort: str) -> str:
    return hashlib.md5(f"{query}::{sort}".encode()).hexdigest()


#: Ranks that lie in one file of stored answers.
STORED_BLOCK = 100


def stored(folder: str) -> Transport:
    """Answers from files that ``store_answers`` wrote: only those of the ranks asked for are opened."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)

    def block(key: str, n: int) -> list[dict]:
        at = fs.FileSelector(f"{base}/key={key}/block={n}", allow_not_found=True)
        out = []
        for f in sorted(x.path for x in files.get_file_info(at) if x.base_name.endswith(".json")):
            with files.open_input_stream(f) as s:
                out += [json.loads(line) for line in s.read().decode().splitlines()]
        return out

    def ask(query: str, start: int, rows: int, sort: str) -> Reply:
        key = _key(query, sort)
        if rows:
            found = [d for n in range(start // STORED_BLOCK, (start + rows - 1) // STORED_BLOCK + 1) for d in block(key, n)]
        else:
            found = block(key, 0)
        docs = [json.loads(d["doc"]) for d in sorted(found, key=lambda d: d["rank"]) if start <= d["rank"] < start + rows]
        return Reply(200, docs, found[0]["found"] if found else 0)

    return ask


def store_answers(ranked: DataFrame, folder: str, sort: str) -> None:
    """Write the answers of a service: ``ranked (query, rank from 0, found, doc as JSON)``."""
    key = F.md5(F.concat("query", F.lit(f"::{sort}")).cast("binary"))
    x = ranked.select(key.alias("key"), F.floor(F.col("rank") / STORED_BLOCK).cast("int").alias("block"), "rank", "found", "doc")
    x.repartition("key", "block").write.partitionBy("key", "block").json(folder)


def ruled(rules: list) -> Transport:
    """Answers by the first of ``rules (expression, status, found, message)`` that is found in a query, else one result: for
    runs without a network."""
    import re

    known = [(re.compile(pattern), status, found, message) for pattern, status, found, message in rules]

    def ask(query: str, start: int, rows: int, sort: str) -> Reply:
        for pattern, status, found, message in known:
            if pattern.search(query):
                return Reply(status, found=found, message=message, wait=0.0)
        return Reply(200, found=1)

    return ask


def transport(name: str, options: dict) -> Transport:
    """The transport that ``module:function`` makes with ``options``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)(**options)


def asked(ask: Transport, query: str, start: int, rows: int, sort: str, retries: int = RETRIES, back_off: float = BACK_OFF) -> Reply:
    """A reply, after at most ``retries`` repetitions; that of a service which can't be reached has status 0 (or 408, if it
    didn't answer in time)."""
    for n in range(retries + 1):
        try:
            reply = ask(query, start, rows, sort)
        except TimeoutError as e:
            reply = Reply(408, message=str(e))
        except OSError as e:
            reply = Reply(0, message=str(e))
        if reply.status not in _AGAIN or n == retries:
            return reply
        time.sleep(back_off * 2**n if reply.wait is None else reply.wait)
    raise AssertionError


@dataclass
class Page(InputPartition):
    name: str
    query: str
    start: int
    rows: int


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = dict(options)

    def partitions(self) -> list[Page]:
        """A task for each page of each query."""
        over, pages = int(self.o.get("overfetch", OVER_FETCH)), int(self.o.get("pages", PAGES))
        return [Page(q["name"], q["query"], n * q["wanted"] * over, q["wanted"] * over) for q in json.loads(self.o["queries"]) for n in range(pages)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        ask = transport(self.o["transport"], json.loads(self.o.get("transportoptions", "{}")))
        time.sleep(float(self.o.get("delay", DELAY)) if partition.start else 0)
        reply = asked(ask, partition.query, partition.start, partition.rows, self.o.get("sort", "score desc"), int(self.o.get("retries", RETRIES)), float(self.o.get("backoff", BACK_OFF)))
        if reply.status != 200:
            raise RuntimeError(f"the service answered {reply.status} for {partition.query!r}: {reply.message}")
        n = len(reply.docs)
        columns = [pa.array([partition.name] * n, pa.string()), pa.array([partition.query] * n, pa.string()), pa.array(range(partition.start, partition.start + n), pa.int32()), pa.array([json.dumps(d, ensure_ascii=False) for d in reply.docs], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["name", "query", "rank", "doc"])


class PagedSearch(DataSource):
    """``spark.read.format("paged_search")``: ``name, query, rank, doc`` of the pages of some queries.

    Options: ``transport`` and ``transportOptions`` (JSON), ``queries`` (JSON list of name, query, wanted), ``sort``,
    ``overFetch``, ``pages``, ``delay``, ``retries``, ``backOff``. A short or empty page is no error; a page
    that the service refuses in the end fails its task."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


def pages(spark: SparkSession, queries: list[dict], transport: str, transport_options: dict | None = None, sort: str = "citation_count desc", **options) -> DataFrame:
    """``PagedSearch`` of ``queries`` (dicts of name, query, wanted)."""
    spark.dataSource.register(PagedSearch)
    read = spark.read.format("paged_search").option("queries", json.dumps(queries)).option("transport", transport).option("transportOptions", json.dumps(transport_options or {})).option("sort", sort)
    return read.options(**options).load()


def sample(fetched: DataFrame, queries: list[dict], known: DataFrame | None = None) -> DataFrame:
    """``name, rank, bibcode, abstract``: of each query in its turn the first ``wanted`` documents of ``fetched``
    that have an abstract of some length and that neither ``known (bibcode)`` nor an earlier query has (S16).
    A document that an earlier query passed over can still be had."""
    doc = F.from_json("doc", "bibcode string, abstract string")
    x = fetched.select("name", "rank", doc.alias("d")).select("name", "rank", F.coalesce("d.bibcode", F.lit("")).alias("bibcode"), "d.abstract")
    x = x.where(F.col("abstract").isNotNull() & (F.col("abstract") != "Not Available") & (F.length("abstract") >= LEAST_ABSTRACT))
    # The first place of a document in its query's list; a list is at most some pages long.
    x = x.groupBy("name", "bibcode").agg(F.min("rank").alias("rank"), F.min_by("abstract", "rank").alias("abstract"))
    taken = known.select("bibcode") if known is not None else None
    out = None
    for q in queries:
        mine = x.where(F.col("name") == q["name"])
        if taken is not None:
            mine = mine.join(taken, "bibcode", "left_anti")
        mine = mine.orderBy("rank").limit(q["wanted"]).select("name", "rank", "bibcode", "abstract")
        out = mine if out is None else out.unionByName(mine)
        taken = mine.select("bibcode") if taken is None else taken.unionByName(mine.select("bibcode"))
    return out


def _each(transport_name: str, options: dict, rows: int, sort: str, retries: int, back_off: float, delay: float):
    """One request for each row of ``id, query`` batches; replies as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = transport(transport_name, options)
        for batch in batches:
            said = []
            for query in batch.column(1).to_pylist():
                reply = Reply(400, message="no query") if query is None else asked(ask, query, 0, rows, sort, retries, back_off)
                said.append((reply.status, reply.found, reply.message, [str(d["bibcode"]) for d in reply.docs if "bibcode" in d]))
                if delay:
                    time.sleep(delay)
            status, found, message, ids = zip(*said, strict=True) if said else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status, pa.int32()), pa.array(found, pa.int64()), pa.array(message, pa.string()), pa.array(ids, pa.list_(pa.string()))], names=["id", "query", "status", "found", "message", "ids"])

    return run


def replies(queries: DataFrame, transport: str, transport_options: dict | None = None, rows: int = 0, sort: str = "score desc", tasks: int | None = None, retries: int = RETRIES, back_off: float = BACK_OFF, delay: float = 0.0) -> DataFrame:
    """``id, query, status, found, message, ids`` for each row of ``queries (id, query)``: equal queries are asked once.
    ``tasks`` bounds how many requests a service gets at a time."""
    once = queries.select("query").distinct().select(F.xxhash64("query").alias("id"), "query")
    once = once.repartition(tasks) if tasks else once
    said = once.mapInArrow(_each(transport, transport_options or {}, rows, sort, retries, back_off, delay), "id long, query string, status int, found long, message string, ids array<string>")
    return queries.select("id", "query").join(said.drop("id"), queries["query"].eqNullSafe(said["query"]), "left").select("id", queries["query"], "status", "found", "message", "ids")


def result_sets(queries: DataFrame, n: int, transport: str, transport_options: dict | None = None, **how) -> DataFrame:
    """``id, rank, bibcode``: the first ``n`` documents of each query by score (S17). A query that fails has none."""
    x = replies(queries, transport, transport_options, rows=n, **how).where("status = 200")
    return x.select("id", F.posexplode("ids").alias("rank", "bibcode")).withColumn("rank", F.col("rank") + 1)


def verdict(status: Column, found: Column, message: Column) -> Column:
    """What a service's answer says of a query: ``valid, error, warning``."""
    error = F.when(status == 400, F.concat(F.lit("parse error: "), F.when(message == "", "Unknown parse error").otherwise(message))).when(status == 401, "Invalid API key").when(status == 429, "API rate limit exceeded").when(status == 408, "API timeout")
    error = error.when(status == 0, F.concat(F.lit("API request error: "), message)).when(status != 200, F.concat(F.lit("API error: HTTP "), status.cast("string")))
    return F.struct((status == 200).alias("valid"), error.alias("error"), F.when((status == 200) & (found == 0), "Query returned 0 results").alias("warning"))


def remote_check(queries: DataFrame, transport: str, transport_options: dict | None = None, **how) -> DataFrame:
    """``id, query, valid, error, warning`` (F4): what the offline lint refuses isn't asked; the service decides on the rest."""
    linted = store(queries.select("id", "query", qlang.lint(F.col("query")).alias("found")), "linted")
    bad = linted.where("size(found) > 0").select("id", "query", F.lit(False).alias("valid"), F.array_join("found", "; ").alias("error"), F.lit(None).cast("string").alias("warning"))
    said = replies(linted.where("size(found) = 0"), transport, transport_options, **how)
    return said.select("id", "query", verdict(F.col("status"), F.col("found"), F.col("message")).alias("v")).select("id", "query", "v.*").unionByName(bad)
