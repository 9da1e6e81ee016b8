import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from skerry.llm import bpe, pretokens, queries, splitter, tokencount

TEXTS = [
    None, "", " ", "  a  b ", "a\n\nb\n c", "it's they'll we'd", "x" * 3000, "ab" * 9000 + " " + "cd" * 9000, "word " * 9000, " " * 20000 + "z",
    "a<|endoftext|>b <|endoftext|> \n\n c<|endoftext|>", "<|endoftext|>", "naïve ﬁn 東京 😀😀 ​ x", "　x힣౜\U000323b0꟎ foo  " * 900,
    "aaa" * 50 + "=" * 700 + "-" * 65, "\x00\x1c\x1d\x85 tab\tx\r\ny", "1234567890" * 2000, "É" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pretokens.vocabulary_path())


@pytest.fixture(scope="module")
def machine():
    with open(pretokens.vocabulary_path(), "rb") as f:
        return pretokens.compiled(f.read())


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_counts_and_round_trip_agree_with_the_library(spark, library):
    docs = frame(spark, TEXTS)
    counts = {r.doc_id: r for r in tokencount.count_tokens(docs).collect()}
    trips = {r.doc_id: r for r in bpe.round_trip(docs, with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert counts[i].n_tokens == trips[i].n_tokens == len(ids)
        assert counts[i].n_bytes == len((text or "").encode())
        assert trips[i].ids == ids
        assert trips[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert trips[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_words_agree_with_the_library(machine, library):
    rng = random.Random(3)
    words = ["".join(rng.choice("aabcdeth iongsr") for _ in range(rng.randint(1, 90))).strip() or "a" for _ in range(3000)]
    words = [w for text in splitter.split(words) for w in text]
    encoded = machine.automaton.encode([w.encode() for w in words])
    counted = machine.automaton.counts([w.encode() for w in words])
    for word, ids, n in zip(words, encoded, counted, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
        assert n == len(ids) // 4


def test_split_agrees_with_the_library_on_every_kind_of_character(machine, library):
    codes = [*range(0x600), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), *range(0xA7C0, 0xA800), 0x558, 0x88F, 0x10EC5, 0x1247D, 0x13C9F, 0x323B0]
    texts = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}! {chr(c)} " for c in codes]
    for c, text, got in zip(codes, texts, splitter.split(texts), strict=True):
        assert got == by_library(library, text), hex(c)


def by_library(library, text):
    return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_chunk_maps_compose(library, monkeypatch):
    """Chunks of any length, borders at any place, and texts in sections."""
    rng = random.Random(2)
    alphabet = "  \t\n\u00a0\'\'\'\'srtvlemdDSab1!?é٣"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(2000)] + ["", "'", "'r", "a'l", "''re  \n", " x" * 300]
    want = [by_library(library, t) for t in texts]
    for size, stride in ((1, 8), (3, 2), (7, 8), (64, 3), (256, 8)):
        monkeypatch.setattr(splitter, "CHUNK", size)
        monkeypatch.setattr(splitter, "STRIDE", stride)
        assert splitter.split(texts) == want
    monkeypatch.setattr(splitter, "CHUNK", 8)
    for size in (1, 2, 5, 30):
        assert [[w for some in splitter.sections(t, size) for w in some] for t in texts[-60:-1]] == want[-60:-1]


def test_maps_are_those_of_single_steps():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, splitter.PAD + 1, (40, 50)).astype(np.uint8)
    after, begun = splitter.chunk_maps(kinds)
    for chunk in range(50):
        for state in range(splitter.STATES):
            now, n = state, 0
            for kind in kinds[:, chunk].tolist():
                now, where = splitter._transition(now, kind)
                n += where.bit_count()
            assert (now, n) == (after[chunk, state], begun[chunk, state])


def test_the_gadgets_decide_the_encoding(library):
    """Without the gadget that cuts a pair, the pair stays apart no more."""
    from skerry.llm.automaton import MergeAutomaton

    with open(pretokens.vocabulary_path(), "rb") as f:
        own = MergeAutomaton(f.read())
    word = "the"
    t, h = (own.labels.index(c.encode()) for c in "th")
    assert own.encode([word.encode()]) == [np.array(library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()]
    assert own._cut(np.array([t]), np.array([h])).all()
    gadget = next(g for g in range(1, len(own.cut_token)) if own.left[255 + g] == t and own.right[255 + g] == h)
    own.cut_token[gadget] = own.labels.index(b"\x00")
    own._arc_tables()
    assert not own._cut(np.array([t]), np.array([h])).any()
    own.cut_token[1:] = own.labels.index(b"\x00")
    own._arc_tables()
    own._known_key[:] = -1
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(12)) for _ in range(50)]
    assert own.encode([w.encode() for w in words]) != [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_queries_agree_with_the_library_on_all_documents(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = {r.doc_id: r for r in queries.op2_token_counts(spark, sf_dir).collect()}
    trips = {r.doc_id: r for r in queries.op8_bpe_round_trip(spark, sf_dir).collect()}
    assert set(counts) == set(trips) == set(docs)
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(text.encode()), len(ids), len(ids) > 1024)
        assert (trips[i].n_tokens, trips[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert trips[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_decode_any_ids(spark, library):
    ids = [[0, 5, 50256, 187, 1000], [], None, [49999, 255]]
    got = bpe.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in got} == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(ids)}


def test_empty_table_repeats_and_extra_columns(spark):
    assert tokencount.count_tokens(frame(spark, []).where("false")).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, n_tokens string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokencount.count_tokens(docs).collect()) == [("1", 2), ("1", 2), ("None", 0)]
    assert bpe.round_trip(docs).count() == 3
