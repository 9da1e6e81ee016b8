"""The slice source: states, bounded batches, restarts and backfills."""

import io
import threading
import zipfile
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from skerry.sources import feeds, fetching, slices
from skerry.streaming import ingest, watermark


def archive(lines):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x.csv", "".join(f"{x}\n" for x in lines))
    return packed.getvalue()


def export_line(i, url="http://x.example/a"):
    fields = [""] * 61
    fields[0], fields[1], fields[26], fields[27], fields[28], fields[53], fields[60] = str(i), "20240101", "145", "145", "14", "US", url
    return "\t".join(fields)


KEYS = ["20240101000000", *slices.keys_after("20240101000000", "20240101030000")]


@pytest.fixture
def folder(tmp_path):
    """13 slices: the third is missing, the fifth is no archive, the seventh is empty, the others have two lines and a short one."""
    base = tmp_path / "feed"
    base.mkdir()
    for n, key in enumerate(KEYS):
        if n == 2:
            continue
        body = b"no archive" if n == 4 else archive([] if n == 6 else [export_line(10 * n), "short\tline", export_line(10 * n + 1)])
        (base / f"{key}.export.CSV.zip").write_bytes(body)
    listing = "\n".join(f"1 h http://x/{k}.{f}" for k, f in ((KEYS[-1], "export.CSV.zip"), ("20300101000000", "gkg.csv.zip")))
    (base / "lastupdate.txt").write_text(listing)
    return base


STATES = {2: "missing", 4: "failed", 6: "empty"}


def expected(keys):
    return {k: STATES.get(KEYS.index(k), "ok") for k in keys}


def drain(spark, base, place, bound=4, stop_after=None):
    """Passes until one finds nothing; each ends with what its batch could take."""
    name, out, passes = slices.registered(spark), f"{place}/raw", []
    while stop_after is None or len(passes) < stop_after:
        source = spark.readStream.format(name).options(base=f"file://{base}", feed="export", progress=f"file://{place}/at", bound=bound, start="20231231234500").load()
        query = ingest.land(source, f"file://{out}", f"file://{place}/checkpoint")
        query.awaitTermination()
        took = sum(p["numInputRows"] for p in query.recentProgress)
        if not took:
            break
        passes.append(took)
    return spark.read.parquet(f"file://{out}"), passes


def test_stream_catches_up_in_bounded_passes_and_survives_restarts(spark, folder, tmp_path):
    first, passes = drain(spark, folder, tmp_path, stop_after=2)
    assert {r.slice_key for r in slices.states(first).collect()} == set(KEYS[:8]) and len(passes) == 2
    # each pass is a query of its own, so this one starts from the checkpoint in a new process
    rows, passes = drain(spark, folder, tmp_path)
    assert len(passes) == 2, "5 slices are left, 4 at most in a pass"
    got = {r.slice_key: r.status for r in slices.states(rows).collect()}
    assert got == expected(KEYS) and slices.states(rows).count() == len(KEYS)
    events = feeds.export_rows(slices.lines(rows))
    assert sorted(int(r.event_id) for r in events.collect()) == sorted(x for n in range(13) if n not in STATES for x in (10 * n, 10 * n + 1))
    # the gap-free run ends before the failed slice; a backfill reads it again
    slots = slices.states(rows).selectExpr("feed", "unix_timestamp(to_timestamp(slice_key, 'yyyyMMddHHmmss')) div 900 AS slot", "status")
    assert watermark.contiguous(slots).first().watermark - slots.agg({"slot": "min"}).first()[0] == 3
    (folder / f"{KEYS[4]}.export.CSV.zip").write_bytes(archive([export_line(1)]))
    again = spark.read.format("feed_slices").options(base=f"file://{folder}", feed="export", keys=KEYS[4]).load()
    assert [(r.status, r.rows) for r in slices.states(again).collect()] == [("ok", 1)]


def test_a_replayed_batch_lands_once(spark, folder, tmp_path):
    """The process dies after the rows are written and before the batch is committed: its commit is taken away."""
    drain(spark, folder, tmp_path, stop_after=2)
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    (tmp_path / "at").write_text(KEYS[3])  # nor was the note written
    rows, _ = drain(spark, folder, tmp_path)
    assert {r.slice_key: r.status for r in slices.states(rows).collect()} == expected(KEYS)
    assert slices.states(rows).count() == len(KEYS)


def test_backfill_reads_a_window(spark, folder):
    name = slices.registered(spark)
    rows = spark.read.format(name).options(base=f"file://{folder}", feed="export", start=KEYS[1], end=KEYS[5]).load()
    assert {r.slice_key: r.status for r in slices.states(rows).collect()} == expected(KEYS[1:6])


def test_slices_that_may_still_come_hold_the_stream(spark, tmp_path):
    now = datetime.now(UTC).replace(second=0, microsecond=0)
    now = now.replace(minute=now.minute // 15 * 15)
    keys = [slices.stamp(now - slices.STEP * i) for i in range(4, 0, -1)]
    base = tmp_path / "feed"
    base.mkdir()
    for key in (keys[0], keys[1], keys[3]):
        (base / f"{key}.gkg.csv.zip").write_bytes(archive(["x"]))
    (base / "lastupdate.txt").write_text(f"1 h http://x/{keys[3]}.gkg.csv.zip")
    reader = slices.SliceStreamReader({"base": f"file://{base}", "feed": "gkg", "progress": f"{tmp_path}/at"}, None)
    assert reader.initialOffset() == {"key": keys[2]}, "a new stream begins with the newest slice"
    reader.at = slices.stamp(slices.moment(keys[0]) - slices.STEP)
    assert reader.latestOffset() == {"key": keys[1]}
    rows = spark.read.format(slices.registered(spark)).options(base=f"file://{base}", feed="gkg", start=keys[2], end=keys[3]).load()
    assert {r.slice_key: r.status for r in slices.states(rows).collect()} == {keys[2]: "pending", keys[3]: "ok"}
    for missing in ({"base": "x"}, {"base": "x", "feed": "other"}):
        with pytest.raises(ValueError):
            slices.SliceStreamReader(missing | {"progress": "p"}, None)
    with pytest.raises(ValueError, match="progress"):
        slices.SliceStreamReader({"base": "x", "feed": "gkg"}, None)


def test_web_addresses_with_retries_and_a_pinned_host(spark):
    asked = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            key = self.path.rpartition("/")[2][:14]
            if self.path.endswith("lastupdate.txt"):
                return self.said(200, f"1 h http://x/{KEYS[4]}.export.CSV.zip".encode())
            if key == KEYS[1] and asked.count(self.path) < 3:
                return self.said(503, b"")
            if key == KEYS[2]:
                return self.said(404, b"")
            if key == KEYS[3]:
                return self.said(302, b"", "http://elsewhere.example/x.zip")
            return self.said(500, b"") if key == KEYS[4] else self.said(200, archive(["a", "b"]))

        def said(self, status, body, to=None):
            self.send_response(status)
            if to:
                self.send_header("Location", to)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = spark.read.format(slices.registered(spark)).options(base=f"http://127.0.0.1:{server.server_port}/v2", feed="export", start=KEYS[0], pause=0).load()
        got = {r.slice_key: (r.status, r.rows, r.error) for r in slices.states(rows).collect()}
    finally:
        server.shutdown()
    assert [got[k][:2] for k in KEYS[:5]] == [("ok", 2), ("ok", 2), ("missing", 0), ("failed", 0), ("failed", 0)]
    assert "elsewhere" in got[KEYS[3]][2] and got[KEYS[4]][2] == "status 500"


def test_notes_are_replaced(tmp_path):
    note = fetching.Note(f"{tmp_path}/deep/at")
    assert note.read() is None
    note.write("a")
    note.write("b")
    assert note.read() == "b"
