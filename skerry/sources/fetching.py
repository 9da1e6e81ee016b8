"""Fetching pages and slices through a pluggable fetcher.

A fetcher is any object with ``get(url) -> (status, body)``; 404 means not published.
Hosts are served one page at a time: rows are dealt by host, and one partition goes
through its hosts in order, with a pause between pages of a host.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.texts import host
from skerry.plans.shipping import ship

RETRIED = frozenset({429, 500, 502, 503, 504})
FINAL_FAILURES = 3


class Fetcher(Protocol):
    def get(self, url: str) -> tuple[int, bytes]: ...

    def status(self, url: str) -> int: ...


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a place that pyarrow can reach, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass(frozen=True)
class FolderFetcher:
    """Files as if they were served: what isn't there is a 404."""

    def get(self, url: str) -> tuple[int, bytes]:
        system, path = file_system(url)
        try:
            with system.open_input_stream(path, compression=None) as stream:
                return 200, stream.read()
        except FileNotFoundError:
            return 404, b""

    def status(self, url: str) -> int:
        system, path = file_system(url)
        return 200 if system.get_file_info(path).type == pafs.FileType.File else 404


@dataclass(frozen=True)
class WebFetcher:
    """Pages of one host, or of any host; a redirect to a host other than the pinned one is refused."""

    host: str | None = None
    timeout: float = 30.0
    agent: str = "skerry"

    def _asked(self, url: str, method: str) -> tuple[int, bytes]:
        pinned = self.host

        def check(target: str) -> None:
            if pinned and urllib.parse.urlsplit(target).hostname != pinned:
                raise PermissionError(f"{target} isn't on {pinned}")

        class Same(urllib.request.HTTPRedirectHandler):
            def redirect_request(self, req, fp, code, msg, headers, newurl):
                check(newurl)
                return super().redirect_request(req, fp, code, msg, headers, newurl)

        check(url)
        request = urllib.request.Request(url, method=method, headers={"User-Agent": self.agent})
        try:
            with urllib.request.build_opener(Same).open(request, timeout=self.timeout) as reply:
                return reply.status, reply.read() if method == "GET" else b""
        except urllib.error.HTTPError as e:
            return e.code, b""

    def get(self, url: str) -> tuple[int, bytes]:
        return self._asked(url, "GET")

    def status(self, url: str) -> int:
        return self._asked(url, "HEAD")[0]


def fetcher_for(base: str) -> Fetcher:
    """By the kind of address; a web address pins its host."""
    parts = urllib.parse.urlsplit(base)
    return WebFetcher(parts.hostname) if parts.scheme in ("http", "https") else FolderFetcher()


class Note:
    """A short text in a file, replaced as a whole."""

    def __init__(self, uri: str):
        self.system, self.path = file_system(uri)

    def read(self) -> str | None:
        try:
            with self.system.open_input_stream(self.path) as stream:
                return stream.read().decode() or None
        except FileNotFoundError:
            return None

    def write(self, text: str) -> None:
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(f"{self.path}.new") as stream:
            stream.write(text.encode())
        self.system.move(f"{self.path}.new", self.path)


def fetch(fetcher: Fetcher, url: str, attempts: int = 3, limit: int = 5 << 20, pause: float = 0.5) -> tuple[int | None, bytes | None, str | None]:
    """(status, body, error); retried on overload, bounded in size (SRC10)."""
    status, error = None, None
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            status, body = fetcher.get(url)
        except Exception as e:  # noqa: BLE001  a dead host is a result
            error = f"{type(e).__name__}: {e}"
            continue
        error = None
        if status == 200:
            return (status, body, None) if len(body) <= limit else (status, None, "too large")
        if status not in RETRIED:
            break
    return status, None, error or f"status {status}"


def fetched(urls: DataFrame, fetcher: Fetcher, spacing: float = 0.0, **settings) -> DataFrame:
    """(url, status, body, error) of each address, one host never from two tasks at once (ST13)."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, float] = ("", 0.0)
        for batch in batches:
            rows = []
            for name, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == last[0] and spacing:
                    time.sleep(max(0.0, spacing - (time.monotonic() - last[1])))
                rows.append((url, *fetch(fetcher, url, **settings)))
                last = (name, time.monotonic())
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["url", "status", "body", "error"])

    dealt = urls.select(host(F.col("url")).alias("_host"), "url").repartition("_host").sortWithinPartitions("_host", "url")
    return dealt.mapInArrow(run, "url string, status int, body binary, error string")


def retry_state(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Connect failures added up; the third is final, a success clears them (ST12)."""
    joined = state.join(outcomes.select("url", F.col("error").isNotNull().alias("_failed")), "url", "full")
    failures = F.when(F.col("_failed").isNull(), F.coalesce("failures", F.lit(0))).when(F.col("_failed"), F.coalesce("failures", F.lit(0)) + 1).otherwise(0)
    return joined.select("url", failures.cast("int").alias("failures")).withColumn("final", F.col("failures") >= FINAL_FAILURES)


def outcome(pages: DataFrame, reason: str = "reason") -> DataFrame:
    """ok, junk or failed of fetched pages with their gate's reason (SRC13)."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col(reason).isNotNull(), "junk").otherwise("ok")
    return pages.withColumn("outcome", status)


def latest_stamp(listing: str, file: str = "") -> str:
    """The newest stamp in a feed's listing of its last files, of those whose name goes on with ``file`` (SRC05)."""
    stamps = re.findall(rf"/(\d{{14}})\.{re.escape(file)}", listing)
    if not stamps:
        raise ValueError("the listing names no slice")
    return max(stamps)
