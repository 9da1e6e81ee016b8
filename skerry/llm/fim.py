"""Fill-in-the-middle: texts cut into units, whose middle run is moved to the end.

A unit grammar says which characters end a unit and which may begin the next one.  It is translated to a
zero-width boundary: a place with a character of the one class before it and one of
the other class after it.  Splitting there gives the units, which together are the text again.
Two cuts are drawn from a hash of the id, so each run of a job draws the same ones.

Form ``psm`` writes prefix, suffix, middle, form ``spm`` suffix, prefix, middle, each
after its mark.  Form ``plain`` is the text as it is: where the draw says so, where the
text is empty, and where it contains a mark, as it could not be told from the marks
then.  So ``restore`` gives the exact text back.

Null text is treated as empty, a null id is drawn as an empty one, equal ids draw
equally (rows with equal texts then get equal outputs), very long texts take time in
proportion to their length, an empty table gives an empty table.  Extra columns are
kept by ``transform``, but for those that it sets: ``n``, ``form``, ``prefix_chars``,
``middle_chars`` and ``output``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exprs import let


@dataclass(frozen=True)
class Grammar:
    """A unit ends with a text that matches ``ends``, where a character of ``begins`` follows, or with the text."""

    ends: str
    begins: str

    @property
    def boundary(self) -> str:
        return f"(?<={self.ends})(?={self.begins})"


#: Any character; a pair of surrogates is one.
ANY = r"[\x{0}-\x{10FFFF}]"
GRAMMARS = {
    "char": Grammar(r"(?:[\x{10000}-\x{10FFFF}]|[\x{0}-\x{FFFF}])", ANY),
    # blanks belong to the word after them
    "word": Grammar(r"[^ \t\r\n]", r"[ \t\r\n]"),
    "line": Grammar(r"\n", ANY),
    "sentence": Grammar(r"(?:[.!?][ \t]{1,16}|\n)", r"[^ \t\n]"),
}


@dataclass(frozen=True)
class Marks:
    """What goes before each part.  Marks begin with one character that is nowhere else in them, so the first mark found is one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        first = {m[:1] for m in marks}
        if len(set(marks)) < 3 or len(first) != 1 or "" in first or any(m.count(m[0]) != 1 for m in marks):
            raise ValueError("marks have to differ and to begin with one character that is nowhere else in them")
        if any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("no mark may begin with another one")


def units(text: Column, unit: str = "line") -> Column:
    """The text's units; an empty or null text has none, though splitting would give one empty piece."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, GRAMMARS[unit].boundary))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits, from the SHA-256 of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, marks: Marks = Marks()) -> DataFrame:
    """``docs`` with ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain), and ``output``.

    ``rate`` percent of the texts are changed, ``spm`` percent of those to form spm.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains(whole, F.lit(m))
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")

    def cut(pieces: Column) -> Column:
        n = F.size(pieces)
        a, b = h1 % (n + 1), h2 % (n + 1)

        def part(begin: Column, end: Column) -> Column:
            return F.array_join(F.slice(pieces, (begin + 1).cast("int"), (end - begin).cast("int")), "")

        return F.struct(
            n.cast("long").alias("n"),
            part(F.lit(0), F.least(a, b)).alias("p"),
            part(F.least(a, b), F.greatest(a, b)).alias("m"),
            part(F.greatest(a, b), n).alias("s"),
        )

    def made(c: Column) -> Column:
        p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
        output = F.when(form == "plain", whole).when(form == "psm", F.concat(p, c["p"], s, c["s"], m, c["m"])).otherwise(F.concat(s, c["s"], p, c["p"], m, c["m"]))
        return F.struct(
            c["n"].alias("n"),
            form.alias("form"),
            F.when(form != "plain", F.length(c["p"])).cast("long").alias("prefix_chars"),
            F.when(form != "plain", F.length(c["m"])).cast("long").alias("middle_chars"),
            output.alias("output"),
        )

    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    cuts = let(units(F.col(text), unit), lambda pieces: let(cut(pieces), made))
    kept = [F.col(c) for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, F.inline(F.array(cuts)))


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that ``transform`` made the output of."""

    def after(part: Column, mark: str) -> Column:
        return F.substring(part, F.instr(part, mark) + len(mark), F.length(part))

    def before(part: Column, mark: str) -> Column:
        return F.substring(part, F.lit(1), F.instr(part, mark) - 1)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after the first mark, after the second one, and after the middle's."""
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        return before(rest, second), before(after(rest, second), marks.middle), after(after(rest, second), marks.middle)

    prefix, suffix, middle = parts(marks.prefix, marks.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(marks.suffix, marks.prefix)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def digest(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lengths, and hashes of the output and of the text rebuilt from it."""
    return made.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS d FROM documents
), h AS (
  SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS us,
         CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM h
), p AS (
  SELECT doc_id, text, n, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
