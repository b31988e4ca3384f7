"""Validation by a service that takes so many requests a second: a token bucket and a cache as keyed state of a stream.

Each account has a bucket of ``burst`` tokens that fill at a rate. A query whose answer the account has cached
takes none; any other takes one, or waits until there is one, and its answer is cached before the next query
is looked at. Both are state, so a restarted stream goes on with the tokens and answers that it had, and
equal queries are asked once whatever batch they come in. Times are those of the rows; with ``pace`` a
task also waits for them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import search

#: Requests a second, and at once.
RATE, BURST = 5.0, 10
_OUT = "account string, id long, query string, valid boolean, tier int, num_results int, error string, from_cache boolean, waited double, sent_at double"


def tier(valid: bool, results: int | None) -> int:
    """3 if a query has results, 2 if it is only sound, 1 if the service refused it (F8)."""
    return 1 if not valid else 2 if results == 0 else 3


class Bucket:
    """Tokens of one account; ``last`` is when they were counted, ``None`` before the first request."""

    def __init__(self, rate: float, burst: int, tokens: float | None = None, last: float | None = None):
        self.rate, self.burst, self.tokens, self.last = rate, burst, float(burst) if tokens is None else tokens, last

    def take(self, at: float) -> float:
        """When a request of time ``at`` may be sent. One at a time: none is sent before the one before it."""
        now = at if self.last is None else max(at, self.last)
        if self.last is not None:
            self.tokens = min(float(self.burst), self.tokens + (now - self.last) * self.rate)
        if self.tokens >= 1.0:
            self.tokens -= 1.0
        else:
            now, self.tokens = now + (1.0 - self.tokens) / self.rate, 0.0
        self.last = now
        return now


class _Validator(StatefulProcessor):
    def __init__(self, transport: str, options: dict, rate: float, burst: int, keep_ms: int | None, pace: bool):
        self.how = (transport, options)
        self.rate, self.burst, self.keep_ms, self.pace = rate, burst, keep_ms, pace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, last double")
        self.cache = handle.getMapState("cache", "query string", "valid boolean, results int, error string", ttlDurationMs=self.keep_ms)
        self.ask = search.transport(*self.how)

    def _answer(self, query: str) -> tuple[bool, int | None, str | None]:
        reply = search.asked(self.ask, query, 0, 0, "score desc", back_off=search.BACK_OFF if self.pace else 0.0)
        if reply.status == 200:
            return True, 0 if reply.found == 0 else 1, None
        if reply.status == 400:
            return False, None, f"parse error: {reply.message or 'Unknown parse error'}"
        return False, None, {401: "Invalid API key", 429: "API rate limit exceeded", 408: "API timeout", 0: f"API request error: {reply.message}"}.get(reply.status, f"API error: HTTP {reply.status}")

    def _cached(self, query: str, seen: dict[str, tuple]) -> bool:
        """Whether the account has an answer, which then is in ``seen``. Answers that expire are looked up each time."""
        if query in seen and self.keep_ms is None:
            return True
        if hit := self.cache.containsKey((query,)):
            seen[query] = tuple(self.cache.getValue((query,)))
        return hit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        state = self.bucket.get() if self.bucket.exists() else None
        bucket = Bucket(self.rate, self.burst, *(state or ()))
        out = []
        seen: dict[str, tuple] = {}  # answers of this batch and those that it read, as a look into the state takes long
        for id_, query, at in zip(x["id"], x["query"], x["at"], strict=True):
            if hit := self._cached(query, seen):
                (valid, results, error), sent = seen[query], at
            else:
                sent = bucket.take(float(at))
                if self.pace:
                    time.sleep(max(0.0, sent - time.time()))
                valid, results, error = seen[query] = self._answer(query)
                self.cache.updateValue((query,), (valid, results, error))
            out.append((key[0], id_, query, valid, tier(valid, results), results, error, hit, float(sent - at), float(sent)))
        self.bucket.update((bucket.tokens, bucket.last))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        frame["num_results"] = frame["num_results"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


def validated(requests: DataFrame, transport: str, transport_options: dict | None = None, rate: float = RATE, burst: int = BURST, keep_ms: int | None = None, pace: bool = False) -> DataFrame:
    """``account, id, query, valid, tier, num_results, error, from_cache, waited, sent_at`` of a stream of
    ``requests (account, id, query, at)``, ``at`` in seconds (F8, J14).

    Rows of one batch are taken by ``at``, then ``id``; a row that comes in a later batch than a younger one is
    sent after it. A null query is an empty one, a null account an account of its own. An account's requests are sent
    one after another, as its limit asks for, so accounts are what runs side by side. Answers are kept
    for ``keep_ms`` milliseconds, without it for good: state then grows with the distinct queries.
    The session needs the RocksDB state store (``state_store``)."""
    x = requests.select(F.coalesce("account", F.lit("")).alias("account"), F.col("id").cast("long").alias("id"), F.coalesce("query", F.lit("")).alias("query"), F.col("at").cast("double").alias("at"))
    processor = _Validator(transport, transport_options or {}, rate, burst, keep_ms, pace)
    return x.groupBy("account").transformWithStateInPandas(processor, outputStructType=_OUT, outputMode="append", timeMode="ProcessingTime" if keep_ms else "None")


def state_store(spark) -> None:
    """Use the state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
