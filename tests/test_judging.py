"""Providers, the reply log and the four judge modes."""

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from skerry.functions import prompts as P
from skerry.operators import judging, providers

QUICK = providers.Patience(size=4, attempts=3, pause=0.0)


class Counting:
    """Notes each prompt it is asked; every tenth fails, some only the first time, one call dies as a whole."""

    name = "counting"

    def __init__(self, notes):
        self.notes = notes

    def answer(self, prompts):
        import os

        out = []
        for p in prompts:
            with open(f"{self.notes}/{os.getpid()}", "a") as f:
                f.write(p + "\n")
            n = int(p.split()[1])
            out.append(ValueError(f"no {n}") if n % 10 == 3 else f"reply {n}")
        return out

    def asked(self):
        import pathlib

        return sorted(line for f in pathlib.Path(self.notes).iterdir() for line in f.read_text().split("\n") if line)


def test_each_prompt_is_asked_once_over_actions_and_restarts(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    provider, log = Counting(str(notes)), f"file://{tmp_path}/log"
    rows = spark.range(60).select("id", F.concat(F.lit("prompt "), (F.col("id") % 40).cast("string")).alias("prompt"), F.lit("x").alias("reply")).union(spark.createDataFrame([(99, None, "x")], "id long, prompt string, reply string"))
    first = providers.asked(rows.where("id < 25"), provider, log=log, patience=QUICK)
    assert first.count() == first.count() == 25
    whole = providers.asked(rows, provider, log=log, patience=QUICK)  # a restart: all rows, the same log
    got = {r.id: (r.reply, r.error) for r in whole.collect()}
    assert got == {i: (None, f"ValueError: no {i % 40}") if i % 40 % 10 == 3 else (f"reply {i % 40}", None) for i in range(60)} | {99: (None, None)}
    whole.count()
    assert provider.asked() == sorted(f"prompt {i}" for i in range(40))


def test_a_task_that_is_run_again_asks_for_the_rest_only(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()

    class Dying(Counting):
        """The worker is lost in the second call of its first attempt."""

        def answer(self, prompts):
            import os
            import pathlib

            from pyspark import TaskContext

            calls = pathlib.Path(self.notes).parent / f"calls-{TaskContext.get().partitionId()}"
            with calls.open("a") as f:
                f.write("x")
            if calls.read_text() == "xx":
                os._exit(1)
            return super().answer(prompts)

    # local mode gives a task one attempt, so the job is run again by hand with the log of the run
    provider, log = Dying(str(notes)), f"file://{tmp_path}/log"
    rows = spark.range(64).select("id", F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))
    for _ in range(12):
        try:
            got = providers.asked(rows, provider, log=log, patience=QUICK).collect()
            break
        except Exception:  # noqa: BLE001  a lost worker
            continue
    assert sorted(r.id for r in got) == list(range(64)) and all((r.error is None) == (r.id % 10 != 3) for r in got)
    assert provider.asked() == sorted(f"prompt {i}" for i in range(64))


def test_calls_are_asked_again_only_where_it_may_help():
    calls = []

    def call(prompts):
        calls.append(list(prompts))
        if "dead" in prompts and len(prompts) > 1:
            raise ValueError("the whole call")
        once = sum(p == "busy" for c in calls for p in c) <= 2
        return [providers.ProviderError("busy", True) if p == "busy" and once else ValueError("bad") if p in ("bad", "dead") else p.upper() for p in prompts]

    assert [str(x) for x in providers.ask(call, ["a", "busy", "bad"], QUICK)] == ["A", "BUSY", "bad"]
    assert calls == [["a", "busy", "bad"], ["busy"], ["busy"]]
    assert [str(x) for x in providers.ask(call, ["a", "dead"], QUICK)] == ["A", "bad"]
    assert isinstance(providers.ask(lambda p: [], ["a"], QUICK)[0], providers.ProviderError)


def test_services_with_a_pinned_host(spark):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            said = (body.get("messages") or [{"content": ""}])[0]["content"]
            if said == "busy" and sum(s[1].get("messages", [{}])[0].get("content") == "busy" for s in seen) == 1:
                return self.said(429, {}, {"Retry-After": "0"})
            if said == "refused":
                return self.said(400, {"error": "no"})
            if said == "inside":
                return self.said(200, {"error": {"message": "overloaded", "code": 503}})
            if "input" in body:
                return self.said(200, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]})
            host = "Other" if said == "elsewhere" else "Pinned"
            self.said(200, {"provider": host, "choices": [{"message": {"content": f"re {said}"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}})

        def said(self, status, body, headers=None):
            data = json.dumps(body).encode()
            self.send_response(status)
            for k, v in (headers or {}).items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        chat = providers.JsonChat(f"{url}/chat", "m", (("temperature", 0.0),), pinned="pinned", key="secret")
        rows = spark.createDataFrame([(p,) for p in ("hello", "busy", "refused", "inside", "elsewhere")], "prompt string")
        got = {r.prompt: (r.reply, r.error, r.input_tokens) for r in providers.asked(rows, chat, patience=QUICK, costs=True).collect()}
        vectors = providers.embedded(spark.createDataFrame([("a",), ("bbb",), (None,)], "text string"), providers.JsonEmbedder(f"{url}/embed", "e"), patience=QUICK)
        assert sorted(tuple(r.vector) for r in vectors.collect()) == [(0.0, 1.0), (1.0, 1.0), (3.0, 1.0)]
        down = providers.embedded(rows, providers.JsonEmbedder(f"{url.rsplit(':', 1)[0]}:1/embed", "e"), "prompt", QUICK).first()
        assert down.vector is None and "ProviderError" in down.embed_error
    finally:
        server.shutdown()
    assert got["hello"] == ("re hello", None, 7) and got["busy"][0] == "re busy"
    assert "400" in got["refused"][1] and "overloaded" in got["inside"][1] and "not by 'pinned'" in got["elsewhere"][1]
    asked = [s[1]["messages"][0]["content"] for s in seen if "messages" in s[1]]
    assert {p: asked.count(p) for p in set(asked)} == {"hello": 1, "busy": 2, "refused": 1, "inside": 3, "elsewhere": 1}
    assert "secret" not in chat.name and "secret" not in repr(chat) and seen[0][2] == "Bearer secret"


class Scripted:
    """Says yes to what a script lists for a subject; ``!`` in a subject fails, ``?`` gives no JSON."""

    name = "scripted"

    def __init__(self, yes, events=None):
        self.yes, self.events = yes, events or {}

    def answer(self, prompts):
        import re

        out = []
        for p in prompts:
            subject = min((p[: p.rfind(f"\n\n{q}")] for q in P.QUESTIONS if f"\n\n{q}" in p), key=len)
            word = re.search(r"(?:Article|Event): (\S+)", subject)[1]
            ids = [int(n) for n in re.findall(r"(?m)^Number (\d+)$", p)]
            kind = "route" if P.ROUTED in p or P.EVENT_ROUTED in p else "decide"
            yes = [i for i in ids if i in self.yes.get(word, {}).get(kind, ())]
            if "!" in word:
                out.append(TimeoutError("late"))
            elif "?" in word:
                out.append("I can't say")
            elif p.endswith(P.EVENTS):
                out.append(json.dumps({"events": [{"what": w, "status": "planned", "country": "FR"} for w in self.events.get(word, [])]}))
            elif p.endswith(P.CHOICES):
                out.append(json.dumps({"concept_ids": yes}))
            elif p.endswith(P.CHOICE):
                out.append(json.dumps({"concept_id": yes[0] if yes else None, "confidence": 0.5 + len(word) / 100}))
            else:
                out.append(json.dumps({"results": [{"concept_id": i, "matched": i in yes, "confidence": 0.9} for i in ids if i != 3]}))
        return out


@pytest.fixture
def classes(spark):
    """100 and 200 at the top; 110 under 100; leaves 1 and 2 under 110, 3 under 100 and 200, 4 under 200."""
    concepts = spark.createDataFrame([(i, f"n{i}", f"d{i}") for i in (1, 2, 3, 4, 100, 110, 200)], "concept_id int, name string, definition string")
    edges = spark.createDataFrame([(110, 100), (1, 110), (2, 110), (3, 100), (3, 200), (4, 200)], "child int, parent int")
    return concepts, edges


def world(spark, bodies):
    articles = spark.createDataFrame(list(enumerate(bodies)), "document_id long, body string")
    pairs = articles.select("document_id", F.lit(1).alias("concept_id"))
    return pairs, articles, pairs.where("false")


def test_down_the_hierarchy(spark, classes, tmp_path):
    concepts, edges = classes
    yes = {"both": {"route": (100, 200, 110), "decide": (1, 4)}, "one": {"route": (200,), "decide": (3, 4)}, "none": {"route": ()}}
    pairs, articles, done = world(spark, ["both", "one", "none", "late!", "odd?", None])
    how = {"edges": edges, "patience": QUICK, "log": f"file://{tmp_path}/log"}
    got = {(r.document_id, r.concept_id): (r.matched, r.error) for r in judging.judged("hierarchical", pairs, articles, concepts, done, Scripted(yes), **how).collect()}
    want = {(0, 100): True, (0, 200): True, (0, 110): True, (0, 1): True, (0, 2): False, (0, 3): False, (0, 4): True}
    want |= {(1, 100): False, (1, 200): True, (1, 3): False, (1, 4): True, (2, 100): False, (2, 200): False}  # 3 is left out of the reply
    failed = {(d, c): (None, e) for d, e in ((3, "TimeoutError: late"), (4, "unreadable reply"), (5, "no body")) for c in (100, 200)}
    assert got == {k: (v, None) for k, v in want.items()} | failed
    again = judging.judged("hierarchical", pairs, articles, concepts, spark.createDataFrame([(0, 1), (1, 4)], "document_id long, concept_id int"), Scripted({}), **how)
    assert {(r.document_id, r.concept_id) for r in again.collect()} == set(got) - {(0, 1), (1, 4)}, "the log answers for the first provider"


def test_by_events(spark, classes):
    concepts, edges = classes
    yes = {
        "fire": {"route": (100, 110), "decide": (2,)}, "flood": {"route": (200,), "decide": ()}, "calm": {"route": ()}, "storm": {"route": (100, 110, 200), "decide": (2,)},
    }
    events = {"busy": ["fire", "flood", "calm", "storm", "lost!"], "quiet": [], "dull": ["calm"]}
    pairs, articles, done = world(spark, ["busy", "quiet", "dull", "late!", None, "odd?"])
    verdicts, found = judging.assigned_events(pairs, articles, concepts, Scripted(yes, events), edges, patience=QUICK)
    got = {(r.document_id, r.what): (r.outcome, r.concept_id, r.routed_through, r.error) for r in found.collect()}
    assert got == {
        (0, "fire"): ("classified", 2, [100, 110], None), (0, "flood"): ("unclassified", None, [200], None), (0, "calm"): ("rejected", None, [], None),
        (0, "storm"): ("classified", 2, [100, 110, 200], None), (0, "lost!"): ("error", None, [], "TimeoutError: late"), (2, "calm"): ("rejected", None, [], None),
    }
    assert {r.outcome for r in found.collect()} == set(judging.OUTCOMES)
    rows = {(r.document_id, r.concept_id): (r.matched, r.confidence, r.error) for r in verdicts.collect()}
    assert {k: v[0] for k, v in rows.items() if v[2] is None} == {
        (0, 100): True, (0, 110): True, (0, 200): True, (0, 1): False, (0, 2): True, (0, 3): False, (0, 4): False,
        (1, 100): False, (1, 200): False, (2, 100): False, (2, 200): False,
    }
    assert rows[0, 2][1] == 0.55, "the surest event's confidence"
    assert {k: v[2] for k, v in rows.items() if v[2]} == {(d, c): e for d, e in ((3, "event extraction failed: TimeoutError: late"), (5, "event extraction failed: unreadable reply"), (4, "no body")) for c in (100, 200)}
    rest = judging.judged("extract", pairs, articles, concepts, spark.createDataFrame([(0, 2)], "document_id long, concept_id int"), Scripted(yes, events), edges=edges, patience=QUICK)
    assert {r.document_id for r in rest.collect()} == {1, 2, 3, 4, 5}


def test_batches_record_failures_on_every_pair(spark, classes):
    concepts, _ = classes
    _, articles, done = world(spark, ["one", "late!", "odd?", None])
    pairs = articles.select("document_id", F.explode(F.array(F.lit(3), F.lit(4))).alias("concept_id"))
    got = {(r.document_id, r.concept_id): (r.matched, r.error) for r in judging.judged("batch", pairs, articles, concepts, done, Scripted({"one": {"decide": (4,)}}), patience=QUICK).collect()}
    assert got[0, 3] == (False, None) and got[0, 4] == (True, None)
    assert {got[d, c] for d, c in got if d == 1} == {(None, "TimeoutError: late")} and {got[d, c] for d, c in got if d == 2} == {(None, "unreadable reply")}
    assert {got[d, c] for d, c in got if d == 3} == {(None, "no body")}
    with pytest.raises(ValueError, match="unknown mode"):
        judging.judged("route", pairs, articles, concepts, done, Scripted({}))


def test_leaves_are_ranked_for_each_event(spark, classes):
    """Allowed are the leaves reached and those under the parents answered yes; the nearest two of them are kept."""
    from skerry.operators import strategies

    _, edges = classes
    hashes = providers.HashEmbedder()
    whats = {(0, 0): "fire", (0, 1): "flood", (1, 0): "storm"}
    events = spark.createDataFrame([(d, o, w) for (d, o), w in whats.items()], "document_id long, ordinal int, what string").select("document_id", "ordinal", F.struct("what").alias("event"))
    passed = spark.createDataFrame([(0, 0, 100, True), (0, 0, 200, False), (0, 1, 200, True), (1, 0, 100, False)], "document_id long, ordinal int, concept_id int, matched boolean")
    reached = spark.createDataFrame([(0, 1, 1)], "document_id long, ordinal int, concept_id int")
    vectors = {i: [float(x) for x in hashes.embed([f"n{i}"])[0]] for i in (1, 2, 3, 4)}
    leaves = spark.createDataFrame(list(vectors.items()), "concept_id int, leaf_vector array<float>")
    got = {}
    for r in strategies.ranked_events(events, passed, reached, edges, leaves, hashes, k=2).collect():
        got.setdefault((r.document_id, r.ordinal), set()).add(r.concept_id)
    allowed = {(0, 0): (1, 2, 3), (0, 1): (1, 3, 4)}

    def near(key):
        own = hashes.embed([whats[key]])[0]
        return set(sorted(allowed[key], key=lambda c: -sum(a * b for a, b in zip(own, vectors[c], strict=True)))[:2])

    assert got == {key: near(key) for key in allowed}


def test_stand_in_vectors(spark):
    from skerry import catalog

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "item_id long, text string")
    got = {r.item_id: r.vector for r in providers.embedded(rows, providers.HashEmbedder(), patience=QUICK).collect()}
    want = providers.HashEmbedder().embed([f"text {i}" for i in range(70)])
    assert all(abs(a - b) < 1e-6 for i in range(70) for a, b in zip(got[i], want[i], strict=True))
    assert "SRC31_embedded" in catalog.queries()


def test_samples_multiply_prompts_behind_the_shuffle(spark, monkeypatch, tmp_path):
    from tests.test_calendar_windows import most_rows

    calls, frames = tmp_path / "calls", []
    calls.mkdir()

    class Counted(providers.HashChat):
        def answer(self, prompts):
            (calls / uuid.uuid4().hex).write_text(str(len(prompts)))
            return super().answer(prompts)

    whole = providers._log_missing
    monkeypatch.setattr(providers, "_log_missing", lambda questions, *rest: frames.append(questions) or whole(questions, *rest))
    rows = spark.range(90).selectExpr("id", "IF(id % 10 = 9, NULL, concat('about ', CAST(id % 30 AS STRING))) AS prompt")
    got = providers.asked(rows, Counted(), samples=3)
    shuffled, n = most_rows(frames[0])
    assert shuffled == 81 and n == 3 * 81
    found = got.collect()
    assert len(found) == 270 and all((r.reply is None) == (r.id % 10 == 9) for r in found)
    assert sum(int(f.read_text()) for f in calls.iterdir()) == 3 * 27, "each different prompt is asked once"
    plain = providers.asked(providers.sampled(rows, 3), providers.HashChat())
    assert sorted((r.id, r.sample, r.reply or "") for r in found) == sorted((r.id, r.sample, r.reply or "") for r in plain.collect())
    # a log holds samples one by one
    log = f"file://{tmp_path}/log"
    providers.asked(rows, Counted(), log=log)
    before = sum(int(f.read_text()) for f in calls.iterdir())
    again = providers.asked(rows, Counted(), log=log, samples=3)
    assert sum(int(f.read_text()) for f in calls.iterdir()) - before == 2 * 27
    assert sorted((r.id, r.sample, r.reply or "") for r in again.collect()) == sorted((r.id, r.sample, r.reply or "") for r in found)
