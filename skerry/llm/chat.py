"""Chat formatting with a reversible template and a loss mask, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; array functions
merge neighbours of the same role into one block, add up the places and concatenate
the blocks, in time proportional to the conversation's length.  Within a block, the parts stay apart, so that the turns can be read
back one by one:

    <|begin|>user<|says|>first text<|part|>second text<|end|><|begin|>assistant ...

Roles and texts are escaped as in XML (``&`` ``<`` ``[`` become ``&amp;`` ``&lt;``
``&#91;``), so no control string of this template, and none in angle or square
brackets of another, survives in them; unescaping restores every text exactly.
The mask is an array of (start, length) in code points of the formatted string,
one for each assistant text.

Null text is the empty text, null role the empty role.  Rows with the same
conversation and turn are ordered by role and text as they are before escaping;
repeated rows are turns of their own; rows with a null turn come first, and a null conversation is one of its own.  Extra columns are ignored.  An
empty table gives an empty table.  A conversation is one row of the result, so it
has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exprs import let

BEGIN, SAYS, PART, END = "<|begin|>", "<|says|>", "<|part|>", "<|end|>"
#: Order counts: the ampersand is escaped first and restored last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LEARNT_ROLE = "assistant"
#: Turns whose places are added up in a row.
RUN = 256


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _before(sizes: Column) -> Column:
    """The sums of the sizes before each place, run by run so that only short arrays grow step by step."""

    def last(a: Column) -> Column:
        return F.element_at(a, -1)

    def summed(items: Column, size: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(last(a) + size(x))))

    def placed(runs: Column) -> Column:
        starts = F.zip_with(runs, summed(runs, last), lambda run, at: F.transform(F.slice(run, F.lit(1), F.size(run) - 1), lambda x: x + at))
        return F.flatten(F.filter(starts, lambda run: run.isNotNull()))

    cuts = F.sequence(F.lit(1), F.size(sizes), F.lit(RUN))
    return let(F.transform(cuts, lambda k: summed(F.slice(sizes, k, RUN), lambda x: x)), placed)


def _join(turns: Column) -> Column:
    """A struct of the formatted string and the mask, from sorted turn structs."""

    def opened(turn: Column, i: Column) -> Column:
        role = escaped(turn["role"])
        begin = F.concat(F.lit(BEGIN), role, F.lit(SAYS))
        opening = F.when(i == 0, begin).when(F.get(turns, i - 1)["role"] == turn["role"], F.lit(PART)).otherwise(F.concat(F.lit(END), begin))
        return F.struct(opening.alias("opening"), escaped(turn["text"]).alias("text"), (turn["role"] == LEARNT_ROLE).alias("learnt"))

    def whole(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: (F.length(p["opening"]) + F.length(p["text"])).cast("long"))

        def span(p: Column, at: Column) -> Column:
            return F.struct((at + F.length(p["opening"])).alias("start"), F.length(p["text"]).cast("long").alias("length"), p["learnt"].alias("learnt"))

        spans = F.filter(F.zip_with(parts, let(sizes, _before), span), lambda s: s["learnt"])
        return F.struct(
            F.concat(F.array_join(F.flatten(F.transform(parts, lambda p: F.array(p["opening"], p["text"]))), ""), F.lit(END)).alias("formatted"),
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("mask"),
        )

    return let(F.transform(turns, opened), whole)


def format_conversations(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each conversation: its id, ``formatted`` and ``mask``; one shuffle."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    collected = rows.groupBy(F.col(conversation).alias(conversation)).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    joined = collected.select(F.col(conversation), let(F.col("_turns"), _join).alias("_out"))
    return joined.select(F.col(conversation), "_out.formatted", "_out.mask")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|begin\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescaped(F.substring_index(block, SAYS, 1))
        rest = F.substring(block, F.instr(block, SAYS) + len(SAYS), F.length(block))
        body = F.substring(rest, F.lit(1), F.length(rest) - len(END))
        return F.transform(F.split(body, r"<\|part\|>"), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(
        F.transform(mask, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), ""
    )


def digest(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the learnt text, read back from the formatted strings."""
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("mask"))
    read = formatted.select(conversation, "formatted", turns.alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conversation,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS erole,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS etext,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(etext) + CASE WHEN before IS NULL THEN 17 + length(erole) WHEN before = role THEN 8
                                     ELSE 24 + length(erole) END) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
