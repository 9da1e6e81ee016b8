"""A data source of published feed slices, for batch and streaming reads.

    spark.dataSource.register(SliceSource)
    spark.readStream.format("feed_slices").options(base="https://...", feed="export", progress="hdfs://...").load()
    spark.read.format("feed_slices").options(base=..., feed="export", start=..., end=...).load()

Each slice gives a row for each line, and one with its state: ``ok``, ``empty``, ``missing`` (not
published for MISSING_AFTER seconds), ``pending`` (not published yet) or ``failed`` (any other error).

The stream's offset is the stamp of the last slice read.  A batch takes the next slices
up to the newest one that the listing names, ``bound`` of them at most, and ends before the first that
isn't there yet.  Spark tells a source where a batch starts only when it plans the batch, so the planned end is
noted in the ``progress`` file, too: the offset log is written before the note, and a batch that was logged but not
noted is planned again before anything else is asked, so after a restart the note is never behind.
Failed slices don't hold the stream back: their state is a row, ``watermark.contiguous`` stops
before them, and ``read`` takes their stamps again.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skerry.sources import fetching

#: Names of a feed's files after the stamp, and of the listing.
FILES = {"export": "export.CSV.zip", "gkg": "gkg.csv.zip"}
LISTING = "lastupdate.txt"
STEP = timedelta(minutes=15)
MISSING_AFTER = 3 * 3600
SCHEMA = "feed string, slice_key string, status string, rows long, error string, line string"
LINES = 4096
#: Slices that one task reads in a batch read.
CHUNK = 16


def stamp(moment: datetime) -> str:
    return moment.strftime("%Y%m%d%H%M%S")


def moment(key: str) -> datetime:
    return datetime.strptime(key, "%Y%m%d%H%M%S").replace(tzinfo=UTC)


def keys_after(start: str, end: str, limit: int | None = None) -> list[str]:
    """Stamps after ``start`` up to ``end``, ``limit`` at most."""
    count = max(0, (moment(end) - moment(start)) // STEP)
    return [stamp(moment(start) + STEP * (i + 1)) for i in range(count if limit is None else min(count, limit))]


@dataclass
class Slices(InputPartition):
    keys: list[str]


class _Feed:
    """What readers of either kind share."""

    def __init__(self, options: dict[str, str], fetcher: fetching.Fetcher | None):
        for name in ("base", "feed"):
            if not options.get(name):
                raise ValueError(f"option {name!r} is needed")
        if options["feed"] not in FILES:
            raise ValueError(f"unknown feed {options['feed']!r}; one of {sorted(FILES)}")
        self.base, self.feed = options["base"].rstrip("/"), options["feed"]
        self.fetcher = fetcher or fetching.fetcher_for(self.base)
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 0.5))
        self.limit = int(options.get("limit", 1 << 30))

    def url(self, key: str) -> str:
        return f"{self.base}/{key}.{FILES[self.feed]}"

    def newest(self) -> str:
        """The newest published slice of the feed (SRC05)."""
        status, body, error = fetching.fetch(self.fetcher, f"{self.base}/{LISTING}", self.attempts, pause=self.pause)
        if error:
            raise OSError(f"{LISTING}: {error}")
        return fetching.latest_stamp(body.decode("utf-8", "replace"), FILES[self.feed])

    def waiting(self, key: str) -> bool:
        """Whether a slice may still be published."""
        return (datetime.now(UTC) - moment(key)).total_seconds() <= MISSING_AFTER

    def lines(self, key: str) -> Iterator[pa.RecordBatch]:
        """A slice's lines, then its state (SRC06, ST04).  An archive is checked before its first line is given."""
        status, body, error = fetching.fetch(self.fetcher, self.url(key), self.attempts, self.limit, self.pause)
        rows = 0
        if status == 404:
            yield self._rows(key, [None], "pending" if self.waiting(key) else "missing", None, "not published by the feed")
            return
        if error is None:
            try:
                archive = zipfile.ZipFile(io.BytesIO(body))
                broken = archive.testzip()
                error = f"broken member {broken}" if broken else None
            except Exception as e:  # noqa: BLE001  any archive that can't be read has failed
                error = f"{type(e).__name__}: {e}"
        if error is not None:
            yield self._rows(key, [None], "failed", None, error[:500])
            return
        members = archive.namelist()
        if members:
            with archive.open(members[0]) as raw:
                held: list[str] = []
                for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == LINES:
                        rows += LINES
                        yield self._rows(key, held)
                        held = []
                rows += len(held)
                if held:
                    yield self._rows(key, held)
        yield self._rows(key, [None], "ok" if rows else "empty", rows, None)

    def _rows(self, key: str, lines: list, status: str | None = None, rows: int | None = None, error: str | None = None) -> pa.RecordBatch:
        n = len(lines)
        text = pa.string()
        columns = [pa.array([self.feed] * n), pa.array([key] * n), pa.array([status] * n, text), pa.array([rows] * n, pa.int64()), pa.array([error] * n, text), pa.array(lines, text)]
        return pa.RecordBatch.from_arrays(columns, names=["feed", "slice_key", "status", "rows", "error", "line"])

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for key in partition.keys:
            yield from self.lines(key)


class SliceReader(_Feed, DataSourceReader):
    """The slices from ``start`` to ``end``, both included, or of the stamps in ``keys`` (by commas); no watermark moves (ST03)."""

    def __init__(self, options: dict[str, str], fetcher: fetching.Fetcher | None):
        super().__init__(options, fetcher)
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        if not self.keys:
            start = options.get("start") or self.newest()
            self.keys = [start, *keys_after(start, options.get("end") or self.newest())]

    def partitions(self) -> list[Slices]:
        return [Slices(self.keys[i : i + CHUNK]) for i in range(0, len(self.keys), CHUNK)]


class SliceStreamReader(_Feed, DataSourceStreamReader):
    """Catching up in order, ``bound`` slices a batch (ST02).  A new stream begins with the newest slice, or after ``start``."""

    def __init__(self, options: dict[str, str], fetcher: fetching.Fetcher | None):
        super().__init__(options, fetcher)
        if not options.get("progress"):
            raise ValueError("option 'progress' is needed: a file on a file system that the driver keeps")
        self.note, self.bound, self.start = fetching.Note(options["progress"]), int(options.get("bound", 32)), options.get("start")
        self.at = self.note.read()

    def initialOffset(self) -> dict:
        self.at = self.start or stamp(moment(self.newest()) - STEP)
        return {"key": self.at}

    def latestOffset(self) -> dict:
        if self.at is None:  # a new stream: Spark asks for the end first
            self.initialOffset()
        end = self.at
        for key in keys_after(self.at, self.newest(), self.bound):
            if self.waiting(key) and not self.published(key):
                break
            end = key
        return {"key": end}

    def published(self, key: str) -> bool:
        """Only a 404 says that a slice isn't there; what else goes wrong is the reading task's to tell."""
        try:
            return self.fetcher.status(self.url(key)) != 404
        except Exception:  # noqa: BLE001
            return True

    def partitions(self, start: dict, end: dict) -> list[Slices]:
        self.at = end["key"]
        self.note.write(self.at)
        return [Slices([key]) for key in keys_after(start["key"], end["key"])]


class SliceSource(DataSource):
    """Options: base, feed (export or gkg), attempts, pause, limit; for a stream progress, bound, start; for a read start, end, keys."""

    fetcher: fetching.Fetcher | None = None

    @classmethod
    def name(cls) -> str:
        return "feed_slices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SliceReader:
        return SliceReader(dict(self.options), self.fetcher)

    def streamReader(self, schema) -> SliceStreamReader:
        return SliceStreamReader(dict(self.options), self.fetcher)


def registered(spark: SparkSession, fetcher: fetching.Fetcher | None = None) -> str:
    """Make the source known to a session, with a fetcher of one's own if given; its format name."""
    if fetcher is None:
        spark.dataSource.register(SliceSource)
        return SliceSource.name()
    own = type("OwnSliceSource", (SliceSource,), {"fetcher": fetcher, "name": classmethod(lambda cls: "own_feed_slices")})
    spark.dataSource.register(own)
    return own.name()


def states(rows: DataFrame) -> DataFrame:
    """(feed, slice_key, status, rows, error) of each slice read."""
    return rows.where("status IS NOT NULL").select("feed", "slice_key", "status", F.coalesce("rows", F.lit(0)).alias("rows"), "error")


def lines(rows: DataFrame) -> DataFrame:
    """(slice_key, line), for ``feeds.export_rows`` and ``feeds.article_rows``."""
    return rows.where("status IS NULL").select("slice_key", "line")


def write_slices(rows: DataFrame, base: str, feed: str, key: str = "slice_key", line: str = "line") -> DataFrame:
    """(slice_key, rows): lines as zipped slices in a folder, each slice by one task; and to be called as an action."""
    from skerry.plans.shipping import ship

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base_path = fetching.file_system(base)
        now, held = None, []

        def closed() -> pa.RecordBatch:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"{now}.csv", "".join(f"{x}\n" for x in held))
            with target.open_output_stream(f"{base_path}/{now}.{FILES[feed]}") as out:
                out.write(packed.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([len(held)], pa.int64())], names=["slice_key", "rows"])

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield closed()
                    now, held = k, []
                if text is not None:
                    held.append(text)
        if now is not None:
            yield closed()

    dealt = rows.select(key, line).repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, "slice_key string, rows long")
