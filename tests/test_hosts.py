"""The host machine as a stream: turns, spacing, failures, restarts."""

import time

import pytest
from pyspark.sql import functions as F

from skerry.streaming import hosts


class Site:
    """Host b can't be reached, c's second page is gone, d answers from the second time on."""

    def __init__(self, log):
        self.log = log

    def get(self, url):
        import time as t

        begin = t.time()
        with open(self.log, "a") as f:
            f.write(f"{url} {begin}\n")
        with open(self.log) as f:
            times = sum(line.split()[0] == url for line in f)
        if "//b." in url or ("//d." in url and times == 1):
            raise ConnectionError("no answer")
        return (404, b"") if url.endswith("/c1") else (200, b"page")


URLS = [(10 * n + i, f"http://{h}.example/{h}{i}") for n, h in enumerate("abcd") for i in range(3 if h == "a" else 2)]


def run(spark, place, site, rules, until, most=90):
    query = hosts.serve(spark, f"file://{place}/in", f"file://{place}/log", f"file://{place}/state", site, rules, every="300 milliseconds")
    try:
        end = time.time() + most
        while time.time() < end:
            time.sleep(0.5)
            assert query.exception() is None
            try:
                rows = spark.read.schema(hosts.TASK).parquet(f"file://{place}/log").collect()
            except Exception:  # noqa: BLE001  nothing is written yet
                continue
            if until(rows):
                return rows
        raise AssertionError(f"not done: {rows}")
    finally:
        query.stop()


def ends(rows):
    return {r.document_id: (r.what, r.failures) for r in rows if r.what not in ("fetch", "retry_later")}


def test_hosts_take_turns_and_third_failures_are_final(spark, tmp_path):
    site = Site(f"{tmp_path}/asked")
    rules = hosts.Rules(hold_back=0.5, lease=60)
    spacing = spark.createDataFrame([("a.example", 1.0)], "host string, spacing double")
    messages = hosts.wanted(spark.createDataFrame(URLS, "document_id long, url string"), spacing)
    hosts.post(messages, f"file://{tmp_path}/in", "first")
    # stopped in the middle and started again from its checkpoint, with everything asked for once more
    some = run(spark, tmp_path, site, rules, lambda rows: len(ends(rows)) >= 3)
    hosts.post(messages.where(~F.col("document_id").isin(list(ends(some)))), f"file://{tmp_path}/in", "second")
    rows = run(spark, tmp_path, site, rules, lambda rows: len(ends(rows)) == len(URLS))
    assert ends(rows) == {0: ("ok", 0), 1: ("ok", 0), 2: ("ok", 0), 10: ("failed", 3), 11: ("failed", 3), 20: ("ok", 0), 21: ("failed", 0), 30: ("ok", 1), 31: ("ok", 1)}
    assert sum(r.what == "retry_later" for r in rows) == 6
    for h in "abcd":
        mine = sorted((r.turn, r.what == "fetch", r.at.timestamp()) for r in rows if r.host.startswith(h))
        turns = [m for m in mine if m[1]]
        assert [t[0] for t in turns] == list(range(1, len(turns) + 1)), "each turn is given out once"
        for turn, (number, _, began) in enumerate(turns[1:], 1):
            ended = max(m[2] for m in mine if m[0] == turns[turn - 1][0] and not m[1])
            assert began >= ended + (1.0 if h == "a" else 0.0), "a host is never due twice, nor before its spacing"


def test_lost_fetches_are_given_out_again_and_old_reports_are_ignored(spark, tmp_path):
    """Nobody fetches here; reports are posted by hand."""
    folder = f"file://{tmp_path}/in"
    hosts.post(hosts.wanted(spark.createDataFrame([(1, "http://x.example/1")], "document_id long, url string")), folder, "w")
    query = hosts.tasks(hosts.inbox(spark, folder), hosts.Rules(lease=1.0)).writeStream.format("memory").queryName("tasks_of_hosts").outputMode("append").trigger(processingTime="200 milliseconds").option("checkpointLocation", f"file://{tmp_path}/state").start()

    def wait(check):
        for _ in range(120):
            time.sleep(0.25)
            rows = spark.table("tasks_of_hosts").collect()
            if check(rows):
                return rows
        raise AssertionError(rows)

    def report(turn, outcome):
        row = [("done", "x.example", 1, "http://x.example/1", None, turn, outcome)]
        hosts.post(spark.createDataFrame(row, hosts.MESSAGE), folder)

    try:
        rows = wait(lambda rows: sum(r.what == "fetch" for r in rows) >= 2)
        report(1, "junk")
        last = max(r.turn for r in wait(lambda rows: sum(r.what == "fetch" for r in rows) >= 3))
        for ahead in range(6):  # the lease may run out meanwhile, so some turns to come are reported, too
            report(last + ahead, "ok")
        rows = wait(lambda rows: any(r.what == "ok" for r in rows))
        assert all(r.what in ("fetch", "ok") for r in rows) and sum(r.what == "ok" for r in rows) == 1
    finally:
        query.stop()


@pytest.mark.parametrize("value", [None, 2.5])
def test_wanted_has_all_columns_of_a_message(spark, value):
    urls = spark.createDataFrame([(1, "http://X.example/1")], "document_id long, url string")
    spacing = None if value is None else spark.createDataFrame([("x.example", value)], "host string, spacing double")
    row = hosts.wanted(urls, spacing).first()
    assert row.asDict() == {"kind": "wanted", "host": "x.example", "document_id": 1, "url": "http://X.example/1", "spacing": value, "turn": None, "outcome": None}
