"""Sentence spans, chat formatting, sharding, quality rules and pseudonyms."""

import datetime
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import chat, pii, quality, queries, sharding, spans
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(sf_dir, queries.ORACLE_SQL[name])


# sentence spans


def test_spans_keep_the_first(spark):
    shared = "First shared sentence here. Second shared one follows. Third shared one ends. "
    long = " ".join(f"w{i}" for i in range(60)) + ". "
    rows = [(2, "Own start. " + shared + "Own end."), (1, shared + "Tail of one."), (3, None), (4, ""), (5, long + "Five."), (6, "Six. " + long), (7, "no marks at all"), (1, shared + "Tail of one."), (None, shared)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string")
    got = {}
    for r in spans.deduplicate(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_removed, r.text))
    assert got[2] == [(3, "Own start. Own end.")]
    assert got[1] == [(0, shared + "Tail of one.")] * 2
    assert got[3] == [(0, None)] and got[4] == [(0, "")] and got[7] == [(0, "no marks at all")]
    assert got[5] == [(0, long + "Five.")] and got[6] == [(1, "Six. ")]
    assert got[None] == [(0, shared)]
    assert spans.deduplicate(docs.where("false")).count() == 0


@pytest.mark.parametrize("text", ["a. b! c?\n\nd", "...", "\n\n x \n", "one. Two.  Three", "4.0. is 1.2.3.4 ok. Fine"])
def test_sentences_are_the_whole_text(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(spans.sentences(F.col("t"))).first()[0]
    assert "".join(found) == text


def removed_by(rows, few, long):
    """What plain Python removes: {id: positions}.  It hashes the runs of two, three and five sentences, to see that those of two cover the others."""
    first, cover, out = {}, {}, {}
    plain = {doc: [re.sub("[ \t\r\n]+", " ", s).strip(" ") for s in re.findall(spans.SENTENCE, text)] for doc, text in rows}
    sizes = {doc: [s.count(" ") + 1 for s in found] for doc, found in plain.items()}
    for doc, found in sorted(plain.items()):
        for i in range(len(found)):
            ends = [k for k in (2, 3, 5) if i + k <= len(found)] + [1] * (sizes[doc][i] >= long or len(found) == 1)
            for k in ends:
                if first.setdefault(tuple(found[i : i + k]), (doc, i)) != (doc, i):
                    cover.setdefault(doc, set()).update(range(i, i + k))
    for doc, places in cover.items():
        stretch = []
        for p in [*sorted(places), None]:
            if stretch and p != stretch[-1] + 1:
                if sum(sizes[doc][x] for x in stretch) >= few or len(stretch) == len(plain[doc]):
                    out.setdefault(doc, set()).update(stretch)
                stretch = []
            stretch.append(p)
    return out


def cleaned_by(rows, few, long):
    gone = removed_by(rows, few, long)
    return {doc: (len(gone.get(doc, ())), "".join(s for i, s in enumerate(re.findall(spans.SENTENCE, text)) if i not in gone.get(doc, ()))) for doc, text in rows}


@pytest.mark.parametrize(("few", "long"), [(12, 25), (1, 1), (1, 25), (5, 8)])
def test_removals_agree_with_plain_python(spark, sf_dir, few, long):
    rng = np.random.default_rng(3)
    short = "".join(f"W{rng.integers(40)}. " for _ in range(60))
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10**6, short), (10**6 + 1, short), (10**6 + 2, "Own begin.\n" + short[7:]), (10**6 + 3, "one two\nthree\n" * 30), (10**6 + 4, "a. " * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in spans.deduplicate(docs, few=few, long=long).collect()}
    assert got == cleaned_by(rows, few, long)
    assert got[10**6 + 1] == (60, "")


def test_copies_of_short_texts_go_and_chance_hits_stay(spark):
    sentence = " ".join(f"w{i}" for i in range(24)) + "."
    texts = ["One two three four. Five six seven.", "Hi. Yes. No. Ok.", sentence, "Yes.", "1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n11\n12\n13\n"]
    rows = [(10 * k + i, t) for k in (0, 1) for i, t in enumerate(texts)]
    rows += [(100, "Hi. Yes. And then a clean text goes on with words of its own."), (101, f"It begins so. {sentence} It ends so."), (102, "1\n2\n3\nother\n" + texts[4][:-3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in spans.deduplicate(docs).collect()}
    assert all(got[i] == (0, t) for i, t in enumerate(texts)) and all(got[10 + i][1] == "" for i in range(len(texts)))
    assert got[100] == (0, rows[10][1]) and got[101] == (0, rows[11][1]), "two short sentences, and one of 24 words amid others"
    assert got[102] == (12, "1\n2\n3\nother\n")


@pytest.mark.parametrize("common", [1, 3, 1 << 40])
def test_common_spans_go_like_others(spark, monkeypatch, common):
    """Whether a span counts as common changes where it is looked up, not what is found."""
    line = "This notice of twelve words or more stands in very many texts here. Nobody may copy it or hand it on to others at all. "
    rows = [(i, f"Text {i} has a beginning of its own that no other text has in it. " + line * (1 + i % 2)) for i in range(40)]
    rows += [(i, f"Pair {i // 2} shares this sentence of its own with just one other text. And this one follows right behind it. ") for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {r.doc_id: sorted(r.repeated) for r in spans.repeats(docs).collect()}
    monkeypatch.setattr(spans, "COMMON", common)
    assert {r.doc_id: sorted(r.repeated) for r in spans.repeats(docs).collect()} == expected
    assert all((i in expected) == (i % 2 == 1) for i in range(40, 60)) and len(expected) == 39 + 10


def test_very_long_text_and_clashing_names(spark):
    long = " ".join(f"Sentence number {i} has some more words of its own here." for i in range(20_000))
    docs = spark.createDataFrame([(1, long, 9), (2, long, 9)], "doc_id long, text string, n_removed int")
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in spans.deduplicate(docs).collect()}
    assert got == {1: (20_000, 0, long), 2: (20_000, 20_000, "")}


# chat


def test_chat_reads_back(spark):
    rows = [(1, 2, "assistant", "b&lt;<|end|>&amp;["), (1, 1, "user", "</s>[INST] a [/INST]"), (1, 3, "assistant", "c"), (1, 3, "assistant", None), (2, 0, None, ""), (None, None, "assistant", "x")]
    out = chat.format_conversations(spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string"))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "</s>[INST] a [/INST]"), ("assistant", "b&lt;<|end|>&amp;["), ("assistant", ""), ("assistant", "c")]
    assert got[1].loss == "b&lt;<|end|>&amp;[c" and got[1].formatted.count(chat.BEGIN) == 2
    assert "[INST]" not in got[1].formatted and "</s>" not in got[1].formatted
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[None].loss == "x"


def test_ties_are_ordered_before_escaping(spark):
    rows = [(1, 1, "user", "<a"), (1, 1, "user", "1b"), (1, 1, "user", "1b"), (1, 2, "[x", "q"), (1, 2, "Zx", "r")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [tuple(t) for t in got] == [("user", "1b"), ("user", "1b"), ("user", "<a"), ("Zx", "r"), ("[x", "q")]


def test_long_conversations_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = [(1, i, ("user", "assistant", "assistant")[i % 3], f"<{i}" * (i % 4)) for i in range(3000)] + [(2, 0, "assistant", "y" * 500_000)]
    out = chat.format_conversations(spark.createDataFrame(turns, schema))
    got = {r.conv_id: r for r in out.select("conv_id", "mask", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].t] == [t[2:] for t in turns[:3000]]
    assert got[1].loss == "".join(t[3] for t in turns[:3000] if t[2] == "assistant") and len(got[1].mask) == 2000
    assert got[2].loss == "y" * 500_000
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


# sharding


def keyed(step, row):
    """Spark's xxhash64 of the step's name and the row."""
    h = 42
    for value in (f"17:{step}", *row):
        if value is not None:
            raw = value.encode() if isinstance(value, str) else int(value).to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_every_slot_agrees_with_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    parts = [[] for _ in range(sharding.PARTS)]
    for row in rows:
        parts[keyed("part", row) % sharding.PARTS].append(row)
    matrix = sharding.communication_matrix([len(p) for p in parts], queries.SHARDS, 17)
    shards = [[] for _ in range(queries.SHARDS)]
    for part, line in zip(parts, matrix.tolist(), strict=True):
        ranked = iter(sorted(part, key=lambda row: (keyed("local", row), row)))
        for shard, n in enumerate(line):
            shards[shard] += [next(ranked) for _ in range(n)]
    want = {}
    for shard, inside in enumerate(shards):
        inside.sort(key=lambda row: (keyed("again", row) % sharding.BUCKETS, keyed("again", row), row))
        want |= {row: (shard, slot) for slot, row in enumerate(inside)}
    got = queries.op6_sharding(spark, sf_dir).collect()
    assert {(r.doc_id, r["size"], r.text_crc32): (r.shard, r.slot) for r in got} == want and len(got) == len(rows)


def test_draws_beyond_numpy_follow_the_exact_law(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    draw, times = np.random.default_rng(4), 20_000
    for good, bad, size in ((5, 7, 6), (30, 8, 12), (3, 400, 50), (40, 45, 80), (1, 1, 1)):
        found = np.bincount([sharding._hypergeometric(draw, good, bad, size) for _ in range(times)], minlength=good + 1)
        law = np.array([math.comb(good, x) * math.comb(bad, size - x) if size >= x else 0 for x in range(good + 1)]) / math.comb(good + bad, size)
        seen = law * times > 5
        assert found[law == 0].sum() == 0
        assert (((found - law * times) ** 2)[seen] / (law * times)[seen]).sum() < 3 * seen.sum() + 12


def test_matrix_of_twenty_billion_rows():
    rng = np.random.default_rng(2)
    parts = (rng.multinomial(2 * 10**10, [1 / 512] * 512)).tolist()
    parts[0] += 9 * 10**9
    matrix = sharding.communication_matrix(parts, 24, 3)
    assert matrix.sum(axis=1).tolist() == parts and np.ptp(matrix.sum(axis=0)) <= 1 and matrix.min() >= 0
    rows, total = np.array(parts)[:, None], sum(parts)
    spread = np.sqrt(rows / 24 * (23 / 24) * (total - rows) / (total - 1))
    off = (matrix - rows / 24) / spread
    assert 0.95 < off.std() < 1.05 and abs(off).max() < 5.5


def test_clashing_names_and_few_rows(spark):
    rows = spark.createDataFrame([(i, -i, "s", i, 0.5) for i in range(5)], "_part long, _rank long, shard string, _bucket long, slot double")
    got = sharding.shuffled(rows, ("_part",), 7)
    assert sorted(got.columns) == sorted(["_part", "_rank", "_bucket", "shard", "slot"])
    assert sorted((r._part, r._rank, r._bucket, r.slot) for r in got.collect()) == [(i, -i, i, 0) for i in range(5)]


def test_shards_are_exact_and_uniform(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 5), "c") for i in range(3000)] + [(7, None, None), (7, None, None), (None, "é", "c")], "doc_id long, text string, shard string")
    rows = sharding.shard_documents(docs.drop("shard"), 7).collect()
    assert len(rows) == 3003
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = {s: len(x) for s, x in by.items()}
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    one = next(r for r in rows if r.doc_id is None)
    assert (one["size"], one.text_crc32) == (10, zlib.crc32("é".encode()))
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.shard_documents(docs.drop("shard").repartition(3), 7).collect()}
    where = np.array([[r.doc_id, r.shard] for r in rows if r.doc_id is not None])
    assert abs(np.corrcoef(where[:, 0], where[:, 1])[0, 1]) < 0.08
    assert sharding.shard_documents(docs.drop("shard").where("false"), 7).count() == 0


def test_matrix_has_exact_margins():
    parts = [5, 0, 17, 100, 3]
    matrix = sharding.communication_matrix(parts, 4, 1)
    assert matrix.sum(axis=1).tolist() == parts and sorted(matrix.sum(axis=0).tolist()) == [31, 31, 31, 32]
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(400)], axis=0)
    assert np.allclose(mean, 2.5, atol=0.25)


# quality


def repeats(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)})


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "a b c d e", "a b c d e f g a b c d e", "x " * 40, "l1 a\nl1 a\n\n \nl2", "# $ | <b> é\x0bü\x1cz"])
def test_measures(spark, text):
    m = quality.with_measures(spark.createDataFrame([(text,)], "text string")).first().measures
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    assert tuple(m) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeats(words))


def test_order_of_rules_changes_no_verdict(spark):
    texts = ["clean words make a sentence that is long enough to stay here", "a b", "!!# ## $$ %% word " * 5, "LOUD WORDS EVERYWHERE IN THIS TEXT WHICH IS ALL CAPITALS NOW", "same line of words\n" * 9, None]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, measures int")
    rules = quality.text_rules(F.coalesce("text", F.lit("")))
    first = [r[0] for r in docs.select(quality.verdict(rules)).collect()]
    assert first == [r[0] for r in docs.select(quality.verdict(rules[::-1])).collect()] == [True, False, False, False, False, False]
    assert [r.measures for r in quality.keep_good(docs).collect()] == [0]
    assert quality.keep_good(docs.where("false")).count() == 0
    assert {r.name for r in quality.ordered(docs, rules)} == {r.name for r in rules}


def test_very_long_and_repeated_texts_and_the_size_of_the_sample(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (1, long), (2, "again and again " * 20_000), (3, None)] + [(10 + i, f"short text {i}") for i in range(4000)], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in quality.report(docs.repartition(40)).collect() if r.doc_id < 4]
    assert sorted(got) == [(1, 60_000, 0, True), (1, 60_000, 0, True), (2, 60_000, 60_000, False), (3, 0, 0, False)]
    sizes = []
    quality.ordered(docs.repartition(40), quality.text_rules(F.coalesce("text", F.lit(""))), prepare=lambda s: sizes.append(s.count()) or s)
    assert 0 < sizes[0] <= quality.SAMPLE_ROWS


# pseudonyms


def changed(spark, text, key="k"):
    return pii.pseudonymize(spark.createDataFrame([(text, 1)], "text string, found int"), key).first().text


def luhn(digits):
    twice = [int(d) * (2 if (len(digits) - i) % 2 == 0 else 1) for i, d in enumerate(digits)]
    return sum(d - 9 if d > 9 else d for d in twice) % 10


def test_pseudonyms_keep_format_and_links(spark):
    text = 'card 4111 1111 1111 1111, 4785380592391139; ip 10.2.3.4. tel +1 (743) 555-3824 mail Ab.19@mail5.example.com!! on 2024-02-29 token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"** id 812088970'
    new = changed(spark, text)
    assert new == changed(spark, text) != changed(spark, text, "other")
    for secret in ("4111 1111", "4785380592391139", "10.2.3.4", "743", "Ab.19", "example", "2024-02-29", "9233a8ec", "812088970"):
        assert secret not in new
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert len(cards) == 2 and all(luhn(c.replace(" ", "")) == 0 for c in cards)
    assert datetime.date.fromisoformat(re.search(r"on (\S+) ", new)[1])
    assert all(int(x) < 256 for x in re.search(r"ip ([\d.]+)\. tel", new)[1].split("."))
    assert re.search(r'token = "([0-9a-f]{40})"\*\* id \d{9}$', new) and "+1 (" in new and ".com!!" in new
    again = changed(spark, "x 4785380592391139 y")
    assert again.split()[1] in new


@pytest.mark.parametrize("text", [None, "", "no data", "v1.2.3.4.5 and 300.1.1.1 and 01.2.3.4", "on 2024-02-30 or 1700-01-01", "GPL version 3. CC 4.0. 12345678", "a@b", "É 1 é"])
def test_clean_texts_stay(spark, text):
    assert changed(spark, text) == text


def test_permutations_are_one_to_one(spark):
    pairs = spark.range(2000).select("id", pii.permuted_grid("k", "t", F.col("id"), 40, 50).alias("g"), pii.permuted_text("k", "t", F.lpad(F.col("id").cast("string"), 4, "0")).alias("s"))
    rows = pairs.collect()
    assert {r.g for r in rows} == set(range(2000))
    assert len({r.s for r in rows}) == 2000 and all(re.fullmatch("[0-9]{4}", r.s) for r in rows)
    numbers = spark.range(3000).select(pii.pseudonym("k", F.concat(F.lit("10000000000"), F.lpad(F.col("id").cast("string"), 4, "0"))).alias("p"), "id").collect()
    assert len({r.p for r in numbers}) == 3000
    assert sum(luhn(r.p) == 0 for r in numbers) == sum(luhn(f"10000000000{r.id:04d}") == 0 for r in numbers)


def all_changed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r.text for r in sorted(pii.pseudonymize(rows, "k").collect())]


def iban_check(value):
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def as_zeros(text):
    return re.sub("[0-9]", "0", text)


def test_ibans_stay_ibans(spark):
    values = ["DE89370400440532013000", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]
    cases = [(v, a) for v in values for a in ("{}", "IBAN: {}, 2024.", "BE12 {} 1234", "card 4111 1111 1111 1111 and {} and {}")]
    texts = [a.format(v, v) for v, a in cases]
    for (value, around), text, new in zip(cases, texts, all_changed(spark, texts), strict=True):
        shape = "".join("[0-9]" if c.isdigit() else "[A-Z]" if c.isalpha() else c for c in value[4:])
        found = [m[0] for m in re.finditer(rf"{value[:2]}[0-9]{{2}}{shape}", new)]
        assert len(found) == around.count("{}") and len(set(found)) == 1 and all(iban_check(f) == 1 for f in found)
        assert value not in new and "4111 1111" not in new and len(new) == len(text)


def test_no_iban_hides_other_data(spark):
    new = changed(spark, "BE12 4111 1111 1111 1111 DE00 3704 0044 0532 0130 00 GB82.X@mail.com DE89370400440532013000@example.com")
    for secret in ("4111 1111", "3704 0044", "GB82.X", "DE8937", "example"):
        assert secret not in new
    assert new.startswith("BE12 ") and " DE00 " in new


def test_spaced_cards(spark):
    values = ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904", "4222 2222 22222"]
    bodies = ["6212 3456 7890 0000 00", "621234 567890000000"]
    values += [b + str(-luhn(re.sub("[^0-9]", "", b) + "0") % 10) for b in bodies]
    new = [n[2:-3] for n in all_changed(spark, [f"a {v}, b" for v in values])]
    for old, n in zip(values, new, strict=True):
        assert n != old and as_zeros(n) == as_zeros(old) and luhn(re.sub("[^0-9]", "", n)) == 0
    a, b = all_changed(spark, ["4111 1111 1111 1111 123", "4111 1111 1111 1111"])
    assert a == b + " 123"


def test_written_dates(spark):
    values = ["31.12.1984", "12/03/1975", "12/31/1975", "1.2.1984", "1/12/1984", "10/2/1984", "31-12-1984", "3/14/1999"]
    for value, text in zip(values, all_changed(spark, [f"on {v}. ok" for v in values]), strict=True):
        new = text[3:-4]
        assert new != value and as_zeros(new) == as_zeros(value)
        a, b, year = map(int, re.split(r"[./-]", new))
        second = int(re.split(r"[./-]", value)[1])
        assert datetime.date(year, *((a, b) if second > 12 else (b, a)))
    days = [datetime.date(1984, 1, 1) + datetime.timedelta(n) for n in range(366)]
    written = {w for d in days for w in (f"{d.day}/{d.month}/{d.year}", f"{d.month}/{d.day}/{d.year}", f"{d.day:02}/{d.month:02}/{d.year}", f"{d.month:02}/{d.day:02}/{d.year}")}
    assert len(set(all_changed(spark, sorted(written)))) == len(written)


def test_phones_long_secrets_and_dates_before_times(spark):
    phones = ["06 12 34 56 78", "06.12.34.56.78", "555.123.4567", "555 123 4567", "0171 1234567", "030/12345678", "020 7946 0958"]
    for value, text in zip(phones, all_changed(spark, [f"tel {v}!" for v in phones]), strict=True):
        assert text[4:-1] != value and as_zeros(text[4:-1]) == as_zeros(value) and re.fullmatch(pii.PHONE, text[4:-1])
    secrets = ["a1B2" * 33, "sk-" + "x9" * 80, "q" * 200 + "7", "0f" * 400]
    for value, text in zip(secrets, all_changed(spark, [f"key={v};" for v in secrets]), strict=True):
        assert len(text) == len(value) + 5 and value[8:40] not in text
    new = changed(spark, "1985-03-12T00:00:00Z")
    assert new[:10] != "1985-03-12" and new[10:] == "T00:00:00Z" and datetime.date.fromisoformat(new[:10])


def test_what_fails_its_check_stays(spark):
    texts = ["31.02.1984 and 45/45/1999 and 1.31.12.1984", "DE88370400440532013000 DE89", "/12/03/1975/ 1985-03-12Tx"]
    assert all_changed(spark, texts) == texts
