"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other.  The first (``splitter``) cuts
texts into words: all texts are cut into chunks, each chunk's map from states to
states and counts is computed without knowing in which state the machine arrives,
and a parallel prefix scan composes the maps.  The second (``MergeAutomaton``) reads
the bytes of a word; its arcs carry how many tokens they emit more, and the sum over the
words of a text is its count.

Null and empty texts have 0 tokens.  Special strings inside a text count as their
one token, as the library does by default.  Very long texts go by sections, an endless
word in one.  Only the named columns are read; rows with equal ids give a row each,
and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import pretokens
from skerry.plans.shipping import ship


def counted(machine: pretokens.Compiled, texts: list[str]) -> list[int]:
    """The number of tokens of each text."""
    parts = [machine.parts(t) for t in texts]
    plain = [(i, p) for i, some in enumerate(parts) for special, p in some if not special]
    totals = [sum(special for special, _ in some) for some in parts]
    for k, found in machine.over_words([p for _, p in plain], machine.counts, machine.automaton.counts):
        totals[plain[k][0]] += sum(found)
    return totals


def count_tokens(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None
) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row; one pass, no shuffle."""
    ship(docs.sparkSession)
    shared = pretokens.shared_vocabulary(docs.sparkSession, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pretokens.compiled(shared.value)
        for batch in (whole.slice(begin, pretokens.SLICE) for whole in rows for begin in range(0, whole.num_rows, pretokens.SLICE)):
            tokens = [n for some in pretokens.batches(batch.column(batch.num_columns - 1).to_pylist()) for n in counted(machine, some)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(tokens, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    source = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, n_tokens long")
