"""Providers of replies and vectors, and a log that keeps every reply that was paid for.

A chat provider is any object with ``name`` and ``answer(prompts) -> list``; it is pickled to
the executors.  An answer is a text, a ``Reply`` with what it cost, or an exception: one
prompt's failure isn't another's.  ``ProviderError`` says whether asking again may help, and after how long.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import prompts as P
from skerry.plans.cuts import shared_folder
from skerry.plans.shipping import ship
from skerry.sources.fetching import RETRIED, file_system


class ProviderError(RuntimeError):
    def __init__(self, message: str, retryable: bool = False, wait: float | None = None):
        super().__init__(message)
        self.retryable, self.wait = retryable, wait


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None


class ChatProvider(Protocol):
    name: str

    def answer(self, prompts: list[str]) -> list[str | Reply | Exception]: ...


class EmbeddingProvider(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashChat:
    """A stand-in without a model: it answers by the hash of what the question is about, and of each number asked for."""

    name: str = "hash"

    def answer(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        def yes(number: str) -> bool:
            return hashlib.sha256(f"{subject}#{number}".encode()).digest()[0] < 96

        subject = min((prompt[:at] for q in P.QUESTIONS if (at := prompt.rfind(f"\n\n{q}")) >= 0), key=len, default=prompt)
        asked = [n for n in re.findall(r"(?m)^Number (\d+)$", prompt[len(subject) :])]
        digest = hashlib.sha256(subject.encode()).digest()
        if prompt.endswith(P.VERDICTS):
            return json.dumps({"results": [{"concept_id": int(n), "matched": yes(n), "confidence": round(digest[1] / 255, 3)} for n in asked]})
        if prompt.endswith(P.EVENTS):
            return json.dumps({"events": [{"what": f"event {i} of {digest.hex()[:8]}", "status": "occurred", "country": "us"} for i in range(digest[0] % 4)]})
        if prompt.endswith(P.CHOICES):
            return json.dumps({"concept_ids": [int(n) for n in asked if yes(n)]})
        if prompt.endswith(P.CHOICE):
            return json.dumps({"concept_id": next((int(n) for n in sorted(asked, key=int) if yes(n)), None), "confidence": round(digest[1] / 255, 3)})
        whole = hashlib.sha256(prompt.encode()).digest()
        return f'{{"matched": {"true" if whole[0] < 96 else "false"}, "confidence": {whole[1] / 255:.3f}}}'


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors from the text's hash."""

    name: str = "hash"
    size: int = 16

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = [b - 127.5 for b in hashlib.shake_256(t.encode()).digest(self.size)]
            norm = sum(x * x for x in raw) ** 0.5
            out.append([x / norm for x in raw])
        return out


def post(url: str, payload: dict, headers: dict[str, str], timeout: float) -> dict:
    """The JSON that a service answers; overload and lost connections are errors that may be asked again, refusals aren't."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            body = json.load(reply)
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After", "")
        raise ProviderError(f"status {e.code}: {e.read()[:300].decode('utf-8', 'replace')}", e.code in RETRIED, float(after) if after.isdigit() else None) from e
    except (OSError, ValueError) as e:
        raise ProviderError(f"{type(e).__name__}: {e}", isinstance(e, OSError)) from e
    if isinstance(body, dict) and body.get("error"):
        error = body["error"] if isinstance(body["error"], dict) else {"message": body["error"]}
        raise ProviderError(str(error.get("message")), error.get("code") in RETRIED)
    return body


@dataclass(frozen=True)
class JsonChat:
    """A service with the usual chat completions in JSON.  A reply that the pinned host didn't serve is refused.

    ``url`` and ``key`` say where it runs and aren't part of ``name``; ``settings`` (temperature, seed, ...) are.
    """

    url: str
    model: str
    settings: tuple[tuple[str, object], ...] = ()
    pinned: str | None = None
    key: str = field(default="", repr=False)
    timeout: float = 600.0

    @property
    def name(self) -> str:
        return json.dumps([self.model, list(self.settings), self.pinned])

    def answer(self, prompts: list[str]) -> list[Reply | Exception]:
        out: list[Reply | Exception] = []
        for prompt in prompts:
            try:
                out.append(self._one(prompt))
            except Exception as e:  # noqa: BLE001  an error by prompt
                out.append(e)
        return out

    def _one(self, prompt: str) -> Reply:
        payload = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "response_format": {"type": "json_object"}, **dict(self.settings)}
        if self.pinned:
            payload["provider"] = {"only": [self.pinned], "allow_fallbacks": False}
        body = post(self.url, payload, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
        if self.pinned and str(body.get("provider", "")).lower() != self.pinned.lower():
            raise ProviderError(f"served by {body.get('provider')!r}, not by {self.pinned!r}")
        try:
            text, used = body["choices"][0]["message"]["content"], body.get("usage") or {}
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"no message in the reply: {str(body)[:200]}") from e
        return Reply(text or "", used.get("prompt_tokens"), used.get("completion_tokens"))


@dataclass(frozen=True)
class JsonEmbedder:
    """A service with the usual embeddings in JSON."""

    url: str
    model: str
    key: str = field(default="", repr=False)
    timeout: float = 120.0

    @property
    def name(self) -> str:
        return self.model

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = post(self.url, {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.timeout)
        found = sorted(body["data"], key=lambda d: d["index"])
        if len(found) != len(texts):
            raise ProviderError(f"{len(found)} vectors for {len(texts)} texts")
        return [d["embedding"] for d in found]


@dataclass(frozen=True)
class Patience:
    """How many prompts a call takes, how often one is asked, and the pause in seconds, which doubles up to ``longest``."""

    size: int = 32
    attempts: int = 4
    pause: float = 1.0
    longest: float = 60.0

    def wait(self, attempt: int, errors: list[Exception]) -> None:
        asked = [w for e in errors if (w := getattr(e, "wait", None)) is not None]
        time.sleep(min(self.longest, max([self.pause * 2**attempt, *asked])))


def _retryable(e: object) -> bool:
    return isinstance(e, (TimeoutError, ConnectionError)) or getattr(e, "retryable", False)


def ask(call: Callable[[list[str]], list], prompts: list[str], patience: Patience) -> list:
    """An answer or an exception for each prompt.  What may succeed later is asked again, without the others; a call that fails as a whole is asked prompt by prompt in the end."""
    out: list = [None] * len(prompts)
    open_ = list(range(len(prompts)))
    for attempt in range(patience.attempts):
        try:
            said = call([prompts[i] for i in open_])
            if len(said) != len(open_):
                raise ProviderError(f"{len(said)} answers to {len(open_)} prompts")
        except Exception as e:  # noqa: BLE001  the provider's own errors are data
            said = [e] * len(open_)
            if not _retryable(e) and len(open_) > 1:
                said = [x for i in open_ for x in ask(call, [prompts[i]], patience)]
        for i, x in zip(open_, said, strict=True):
            out[i] = x
        open_ = [i for i in open_ if _retryable(out[i])]
        if not open_ or attempt == patience.attempts - 1:
            break
        patience.wait(attempt, [out[i] for i in open_])
    return out


LOG = "key string, reply string, error string, input_tokens long, output_tokens long, seconds double"
_LOG = pa.schema([("key", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("seconds", pa.float64())])


def prompt_key(provider: ChatProvider, prompt: Column) -> Column:
    """A reply's key: who was asked what."""
    return F.sha2(F.concat(F.lit(f"{provider.name}\u001f"), prompt), 256)


def replies_of(spark: SparkSession, log: str) -> DataFrame:
    """Each key's reply, a readable one if there are several."""
    rows = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(log)
    return rows.groupBy("key").agg(F.min_by(F.struct("reply", "error", "input_tokens", "output_tokens", "seconds"), F.col("error").isNotNull()).alias("r")).select("key", "r.*")


def _log_missing(questions: DataFrame, provider: ChatProvider, log: str, patience: Patience) -> None:
    """Ask (key, prompt) and write each call's replies to a file of its own as soon as they are there.

    Rows of one key have to be in one task, which asks for the first.  A task that is run
    again finds the files of its earlier attempt and asks for the rest only.
    """
    run = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        target, path = file_system(log)
        name = f"{TaskContext.get().partitionId():06d}-"
        folder = f"{path}/run={run}"
        target.create_dir(folder, recursive=True)
        done, number = set(), 0
        for info in target.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith(name):
                done.update(pq.read_table(info.path, columns=["key"], filesystem=target)["key"].to_pylist())
                number += 1
        for batch in batches:
            rows = list({k: p for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if k not in done}.items())
            done.update(k for k, _ in rows)
            for s in range(0, len(rows), patience.size):
                some, begin = rows[s : s + patience.size], time.monotonic()
                said = ask(provider.answer, [p for _, p in some], patience)
                each = (time.monotonic() - begin) / len(some)
                lines = [_line(k, x, each) for (k, _), x in zip(some, said, strict=True)]
                table = pa.Table.from_pylist(lines, _LOG)
                with target.open_output_stream(f"{folder}/.{name}{number:06d}") as out:
                    pq.write_table(table, out)
                target.move(f"{folder}/.{name}{number:06d}", f"{folder}/{name}{number:06d}.parquet")
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    questions.mapInArrow(work, "n long").agg(F.sum("n")).collect()


def _line(key: str, said: object, seconds: float) -> dict:
    line = {"key": key, "seconds": seconds, "reply": None, "error": None, "input_tokens": None, "output_tokens": None}
    if isinstance(said, Exception):
        return line | {"error": f"{type(said).__name__}: {said}"[:1000]}
    if isinstance(said, Reply):
        return line | {"reply": said.text, "input_tokens": said.input_tokens, "output_tokens": said.output_tokens}
    return line | {"reply": said}


def sampled(rows: DataFrame, samples: int, prompt: str = "prompt") -> DataFrame:
    """Each prompt so many times; those after the first carry their number, so that no cache answers them alike."""
    each = rows.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return each.withColumn(prompt, F.when(F.col("sample") == 1, F.col(prompt)).otherwise(F.concat(prompt, F.lit("\nSample "), F.col("sample").cast("string"))))


def asked(
    rows: DataFrame, provider: ChatProvider, prompt: str = "prompt", log: str | None = None, patience: Patience = Patience(), costs: bool = False, samples: int = 1
) -> DataFrame:
    """``rows`` with ``reply`` and ``error`` (and what it cost); each different prompt is asked once (SRC32, ST17).

    With ``samples``, each row is there once a ``sample``.  Prompts are shuffled once, before samples multiply them
    (again by sample where a log of earlier replies is given).

    What the log holds isn't asked again, by whichever action, job or restart; failures
    are kept like replies.  Without a log, one in the shared folder is made for this call.
    A null prompt is not asked and has neither.  Leave speculation off: two attempts of a task at once would both ask.
    """
    spark = rows.sparkSession
    ship(spark)
    fresh = log is None
    log = log or f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    system, path = file_system(log)
    system.create_dir(path, recursive=True)

    def each(some: DataFrame, key: str) -> DataFrame:
        return (some if samples == 1 else sampled(some, samples, prompt)).withColumn(key, prompt_key(provider, F.col(prompt)))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.where(F.col(prompt).isNotNull()).select(prompt_key(provider, F.col(prompt)).alias("key"), prompt).repartition(parts, "key")
    questions = known if samples == 1 else each(known, "key").select("key", prompt)
    if not fresh:
        questions = questions.join(replies_of(spark, log).select("key"), "key", "left_anti")
    _log_missing(questions, provider, log, patience)
    keyed = each(rows, "asked_key")
    told = ["reply", "error", *(["input_tokens", "output_tokens", "seconds"] if costs else [])]
    found = replies_of(spark, log).select(F.col("key").alias("asked_key"), *told)
    return keyed.drop(*told).join(found, "asked_key", "left").drop("asked_key")


def embedded(objects: DataFrame, provider: EmbeddingProvider, text: str = "text", patience: Patience = Patience(size=64)) -> DataFrame:
    """``objects`` with ``vector`` and ``embed_error``; a text that can't be embedded has a null vector (SRC31)."""
    ship(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            said = [x for s in range(0, len(texts), patience.size) for x in ask(provider.embed, texts[s : s + patience.size], patience)]
            vectors = pa.array([None if isinstance(x, Exception) else x for x in said], pa.list_(pa.float32()))
            errors = pa.array([f"{type(x).__name__}: {x}" if isinstance(x, Exception) else None for x in said], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors, errors], names=[*batch.schema.names, "vector", "embed_error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema.fields)
    return objects.mapInArrow(run, f"{fields}, vector array<float>, embed_error string")
