"""Polite fetching as a stateful stream: one machine a host says when which document is due.

Messages go in: documents wanted, and how fetches ended.  Tasks come out: a document to fetch, at
most one of a host at a time and ``spacing`` after the last one ended; and how each document
ended.  A host keeps a line of its documents, so a turn costs the same however many
wait.  What could not be connected to goes back into the line after HOLD_BACK; the third failure is final.
A fetch that nobody reports within LEASE is given out again under a new turn; what
an earlier turn reports then, or a repeated report, counts no more.

State and timers are Spark's (``transformWithState``), in processing time: a batch that is replayed has
the time that was logged for it, so it gives the same tasks again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skerry.functions.texts import host
from skerry.plans.shipping import ship
from skerry.sources import fetching

MESSAGE = "kind string, host string, document_id long, url string, spacing double, turn long, outcome string"
TASK = "host string, document_id long, url string, what string, turn long, failures int, at timestamp"
CONNECT = "connect"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Seconds; ``failures`` is how many failed connections are final (ST12)."""

    hold_back: float = 600.0
    lease: float = 900.0
    failures: int = fetching.FINAL_FAILURES


class HostMachine(StatefulProcessor):
    """The state of one host (ST11, ST12, ST13)."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the line's ends, when the host is free, its spacing, the document on the way, its turn, and since when
        self.host = handle.getValueState("host", "head long, tail long, free long, spacing long, flying long, turn long, since long")
        self.documents = handle.getMapState("documents", "id long", "url string, failures int")
        self.line = handle.getMapState("line", "place long", "id long")
        self.held = handle.getMapState("held", "id long", "due long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        at = self._read()
        for row in rows:
            if row.kind == "wanted":
                if row.spacing is not None:
                    at["spacing"] = int(row.spacing * 1000)
                if not self.documents.containsKey((row.document_id,)):
                    self.documents.updateValue((row.document_id,), (row.url, 0))
                    self._queue(at, row.document_id)
            elif at["flying"] is not None and (row.document_id, row.turn) == (at["flying"], at["turn"]):
                yield from self._ended(key, at, row.outcome, now)
        yield from self._next(key, at, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._next(key, self._read(), timerValues.getCurrentProcessingTimeInMs())

    def _read(self) -> dict:
        names = ("head", "tail", "free", "spacing", "flying", "turn", "since")
        return dict(zip(names, self.host.get() if self.host.exists() else (0, 0, 0, 0, None, 0, 0), strict=True))

    def _queue(self, at: dict, document: int) -> None:
        self.line.updateValue((at["tail"],), (document,))
        at["tail"] += 1

    def _ended(self, key, at: dict, outcome: str, now: int) -> Iterator[Row]:
        document = at["flying"]
        url, failures = self.documents.getValue((document,))
        at["flying"], at["free"] = None, now + at["spacing"]
        failures += outcome == CONNECT
        if outcome == CONNECT and failures < self.rules.failures:
            self.documents.updateValue((document,), (url, failures))
            self.held.updateValue((document,), (now + int(self.rules.hold_back * 1000),))
            yield self._row(key, document, url, "retry_later", at["turn"], failures, now)
        else:
            self.documents.removeKey((document,))
            yield self._row(key, document, url, "failed" if outcome == CONNECT else outcome, at["turn"], failures, now)

    def _next(self, key, at: dict, now: int) -> Iterator[Row]:
        """Give out the next document if the host is free, and set the timer for what has to wait."""
        waits = []
        for (document,), (due,) in list(self.held.iterator()):
            if due <= now:
                self.held.removeKey((document,))
                self._queue(at, document)
            else:
                waits.append(due)
        if at["flying"] is not None and at["since"] + int(self.rules.lease * 1000) <= now:
            self._queue(at, at["flying"])
            at["flying"] = None
        if at["flying"] is not None:
            waits = [at["since"] + int(self.rules.lease * 1000)]
        elif at["head"] < at["tail"]:
            if at["free"] <= now:
                (document,) = self.line.getValue((at["head"],))
                self.line.removeKey((at["head"],))
                at |= {"head": at["head"] + 1, "flying": document, "turn": at["turn"] + 1, "since": now}
                url, failures = self.documents.getValue((document,))
                yield self._row(key, document, url, "fetch", at["turn"], failures, now)
                waits = [now + int(self.rules.lease * 1000)]
            else:
                waits.append(at["free"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waits:
            self.handle.registerTimer(max(min(waits), now + 1))
        self.host.update(tuple(at.values()))

    @staticmethod
    def _row(key, document: int, url: str, what: str, turn: int, failures: int, now: int) -> Row:
        import datetime

        when = datetime.datetime.fromtimestamp(now / 1000)
        return Row(host=key[0], document_id=document, url=url, what=what, turn=turn, failures=failures, at=when)


def tasks(messages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The stream of tasks and ends for a stream of messages.  Needs the RocksDB state store; it is set for the session."""
    spark = messages.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return messages.groupBy("host").transformWithState(HostMachine(rules), TASK, "append", "processingTime")


def wanted(urls: DataFrame, spacing: DataFrame | None = None) -> DataFrame:
    """Messages for (document_id, url); ``spacing``: host and the seconds it asks for."""
    named = urls.select("document_id", "url", host(F.col("url")).alias("host"))
    paced = named.withColumn("spacing", F.lit(None).cast("double")) if spacing is None else named.join(spacing.select("host", "spacing"), "host", "left")
    return paced.select(F.lit("wanted").alias("kind"), "host", "document_id", "url", "spacing", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("outcome"))


def post(rows: DataFrame, folder: str, name: str | None = None) -> None:
    """Put messages where ``inbox`` finds them; under one name they are posted once."""
    rows.write.mode("overwrite").parquet(f"{folder}/of={name or uuid.uuid4().hex}")


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MESSAGE).parquet(f"{folder}/of=*")


def serve(spark: SparkSession, folder: str, log: str, checkpoint: str, fetcher: fetching.Fetcher, rules: Rules = Rules(), every: str = "1 second", read=None) -> StreamingQuery:
    """Fetch what is due and post how it ended, until stopped.

    ``log`` gets each batch's tasks and ends once; ``read`` makes outcomes (ok, junk or failed) of the
    pages (url, status, body, error), and may store them.  Each attempt is one request: retries are the machine's.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{log}/batch={number}")
        kept = spark.read.schema(TASK).parquet(f"{log}/batch={number}")
        due = kept.where("what = 'fetch'")
        if due.isEmpty():
            return
        pages = fetching.fetched(due.select("url"), fetcher, attempts=1)
        said = pages.select("url", F.when(F.col("status").isNull(), CONNECT).when(F.col("error").isNotNull(), "failed").otherwise("ok").alias("outcome")) if read is None else read(pages)
        ended = due.join(said.dropDuplicates(["url"]), "url")
        post(ended.select(F.lit("done").alias("kind"), "host", "document_id", "url", F.lit(None).cast("double").alias("spacing"), "turn", "outcome"), folder, f"batch-{number}")

    stream = tasks(inbox(spark, folder), rules)
    return stream.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
