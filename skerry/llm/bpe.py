"""Byte-pair encoding and decoding on a tokenization automaton.

``MergeAutomaton`` is compiled from the merges gadget by gadget.  Texts are split
into words by a transducer (``splitter``), each new word runs through the tables once,
and decoding puts the arc labels in a row again.  One pass, no shuffle.

Null is treated as the empty text: no ids.  Very long texts and words cost time in
proportion to their length.  Only the named columns are read; rows that are equal
give equal rows, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import pretokens
from skerry.plans.shipping import ship


def encode_texts(machine: pretokens.Compiled, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    pieces = [machine.parts(t) for t in texts]
    plain = [p for parts in pieces for special, p in parts if not special]
    codes: list[list[bytes]] = [[] for _ in plain]
    for i, found in machine.over_words(plain, machine.codes, machine.automaton.encode):
        codes[i].append(b"".join(found))
    ready, special = iter(codes), machine.automaton.special
    return [b"".join(special[p].to_bytes(4, "little") if s else b"".join(next(ready)) for s, p in parts) for parts in pieces]


def _mapped(docs: DataFrame, column: str, keep: tuple[str, ...], path: str | None, outputs: str, work) -> DataFrame:
    """``keep`` and what ``work(machine, values)`` makes of the column: one Arrow array for each output."""
    shared = pretokens.shared_vocabulary(docs.sparkSession, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pretokens.compiled(shared.value)
        for batch in rows:
            names = [*batch.schema.names[:-1], *(x.split()[0] for x in outputs.split(", "))]
            for begin in range(0, batch.num_rows, pretokens.SLICE):
                some = batch.slice(begin, pretokens.SLICE)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *work(machine, some.column(some.num_columns - 1))], names=names)

    source = docs.select(*keep, F.col(column).alias("_value"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, kept + outputs)


def _id_lists(codes: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    flat = np.frombuffer(b"".join(codes), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` and ``ids``, an array of integers."""

    def work(machine, column):
        return [_id_lists([c for some in pretokens.batches(column.to_pylist()) for c in encode_texts(machine, some)])]

    return _mapped(docs, text, keep, path, "ids array<int>", work)


def decode(coded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` and ``text``; null ids give the empty text, bytes that aren't UTF-8 the replacement character."""

    def work(machine, column):
        raw = (np.asarray(x or [], "<u4").tobytes() for x in column.to_pylist())
        return [pa.array([machine.automaton.decode(x).decode(errors="replace") for x in raw], pa.string())]

    return _mapped(coded, ids, keep, path, "text string", work)


def round_trip(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """``keep``, ``n_tokens``, and digests of the ids and of the text decoded from them; ``ids`` on demand."""
    ship(docs.sparkSession)

    def work(machine, column):
        codes, digests, texts = [], [], []
        for some in pretokens.batches(column.to_pylist()):
            for code in encode_texts(machine, some):
                codes.append(code if with_ids else len(code) // 4)
                digests.append(hashlib.sha256(code).hexdigest())
                back = machine.automaton.decode(code).decode(errors="replace")
                texts.append(hashlib.sha256(back.encode()).hexdigest())
        out = [pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        sizes = [len(c) // 4 for c in codes] if with_ids else codes
        return [pa.array(sizes, pa.int64()), *out, *([_id_lists(codes)] if with_ids else [])]

    outputs = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, text, keep, path, f"{outputs}, ids array<int>" if with_ids else outputs, work)
