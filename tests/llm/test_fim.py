"""Fill-in-the-middle against plain Python, and its exact round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skerry.llm import fim

PIECES = {
    "char": r"(?s).",
    "word": r"[^ \t\r\n]+|[ \t\r\n]+[^ \t\r\n]*",
    "line": r"[^\n]*\n|[^\n]+",
}

TEXTS = [
    None, "", "one", "\n", "\n\n", "a\nb", "a\nb\n", "\r\na\x0b b\x85c\n\nd", " lead\n trail \n", "emoji \U0001f600\U0001f601\n\U0001f600",
    "has <P> in it\nx", "<S>", "x<M>", "<", "<P", "ends <\n<S\n", "a\n" * 3000 + "end", "tab\tword  two\r\nthree", "null \x00 char\ny",
]


def made(key, text, unit, rate=100, spm=50):
    text = text or ""
    pieces = re.findall(PIECES[unit], text)
    assert "".join(pieces) == text
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(pieces)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", sorted(PIECES))
@pytest.mark.parametrize("rate", [100, 60])
def test_units_forms_and_round_trip(spark, unit, rate):
    rows = [(i, t, "kept", i) for i, t in enumerate(TEXTS * 4)] + [(None, "no\nid", "kept", 0), (5, TEXTS[5], "kept", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, N int")
    out = fim.transform(docs, unit=unit, rate=rate).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert sorted(out.columns) == ["back", "doc_id", "extra", "form", "middle_chars", "n", "output", "prefix_chars", "text"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == made(r.doc_id, r.text, unit, rate)
        assert r.back == (r.text or "")
    if rate == 100:
        assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.where("false"), unit=unit).count() == 0


def test_sentences_are_the_text(spark):
    docs = spark.createDataFrame([(1, "One. Two!  Three?\nFour.5 five. ")], "doc_id long, text string")
    assert docs.select(fim.units(F.col("text"), "sentence").alias("u")).first().u == ["One. ", "Two!  ", "Three?\n", "Four.5 five. "]


def test_marks_that_cannot_be_told_apart_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)
