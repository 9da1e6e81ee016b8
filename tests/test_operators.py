import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import feed_time, gate, replies, texts
from skerry.operators import calendars, hierarchy, judging, matching, minhash, ranking, sampling
from skerry.operators.components import connected_components
from skerry.plans import runs
from skerry.sources import feeds, html_text, sheets
from skerry.plans.keyed import KeyedTable
from skerry.streaming import ingest
from skerry.streaming.watermark import contiguous


def column(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (None, "empty"),
        (" \n ", "empty"),
        ("Warning: Target URL returned error 403\nrest", "proxy_error"),
        ("Sorry, PAGE NOT FOUND on this site", "dead_page"),
        ("[a long label here](http://x.example/long/address) b", "link_dump"),
        ("Too short.", "too_thin"),
        ("word " * 60, None),
        ("This sentence has well over thirty characters. " * 3, None),
    ],
)
def test_gate(spark, text, reason):
    assert column(spark, gate.junk_reason, text) == reason


def test_stamps(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-02-29 23:59:59' AS t")
    floor = feed_time.floor_stamp(F.col("t"))
    got = rows.select(floor.alias("s"), feed_time.shifted(floor, 1).alias("n"), feed_time.seconds_to_next(F.col("t")).alias("w")).first()
    assert got == ("20240229234500", "20240301000000", 91.0)
    between = rows.select(feed_time.between(F.lit("20240229234500"), F.lit("20240301001500")).alias("b"), feed_time.between(F.lit("20240301000000"), F.lit("20240229234500")).alias("none")).first()
    assert between.b == ["20240301000000", "20240301001500"] and between.none == []


def test_replies(spark):
    assert column(spark, replies.verdict, 'sure! {"matched": true, "confidence": 7, "country": "de"} ok') == (True, 1.0, "DE")
    assert column(spark, replies.verdict, "no") == (None, None, None)
    got = column(spark, lambda c: replies.batch(c, F.array(F.lit(1), F.lit(2))), '{"results": [{"concept_id": 2, "matched": true}, {"concept_id": 9, "matched": true}]}')
    assert [(r.concept_id, r.matched, r.omitted) for r in got] == [(1, False, True), (2, True, False)]
    assert column(spark, lambda c: replies.choice(c, F.array(F.lit(3))), '{"choice": 4}') is None
    events = column(spark, replies.event_list, '{"events": [{"what": "a", "status": "Occurred", "country": "xyz"}, {"what": "b", "status": "?"}]}')
    assert [tuple(e) for e in events] == [("a", "occurred", None)]


def test_small_texts(spark):
    assert column(spark, texts.host, "HTTP://User@Ex.ORG:80/a?b") == "ex.org:80"
    assert column(spark, texts.iso_day, "20240105") == "2024-01-05" and column(spark, texts.iso_day, "soon") == "soon"
    assert column(spark, texts.calm_case, "PROTEST") == "protest" and column(spark, texts.calm_case, "Pro") == "Pro"


def test_first_tier_decides(spark):
    rows = spark.createDataFrame([("145", "145", "14"), ("1451", "145", "14"), ("", "", "14"), (None, None, None)], "event_code string, base_code string, root_code string")
    assert [r[0] for r in rows.select(matching.tier_code()).collect()] == ["145", "1451", "14", None]


def test_fallback_and_scope(spark):
    assert column(spark, matching.fallback_chain, "1451") == ["1451", "145", "14"]
    assert spark.range(1).select(matching.covered(F.lit(None).cast("array<int>"), F.array(F.lit(1)))).first()[0] is True
    assert spark.range(1).select(matching.covered(F.array(F.lit(2)), F.array(F.lit(1)))).first()[0] is False


def test_events_shadow_themes(spark):
    events = spark.createDataFrame([(5, 1, "145", None, "14"), (4, 1, "146", None, "14")], "feed_event_id long, document_id long, event_code string, base_code string, root_code string")
    articles = spark.createDataFrame([(1, ["A"]), (2, ["A", "A"])], "document_id long, themes array<string>")
    links = spark.createDataFrame([(7, "cameo", "145"), (8, "cameo", "146"), (9, "theme", "A")], "concept_id int, system string, code string")
    got = {r.document_id: (r.concept_id, r.system) for r in matching.matching_documents(events, articles, links).collect()}
    assert got == {1: (8, "cameo"), 2: (9, "theme")}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (101, 102), (5, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hierarchy(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (10, 20), (11, 10)], "child int, parent int")
    concepts = spark.createDataFrame([(i,) for i in (1, 2, 10, 11, 20)], "concept_id int")
    assert {tuple(r) for r in hierarchy.depths(concepts, edges).collect()} == {(1, 3), (2, 0), (10, 1), (11, 2), (20, 0)}
    assert {r.concept_id for r in hierarchy.leaves(concepts, edges).collect()} == {1, 2}
    with pytest.raises(hierarchy.CycleError):
        hierarchy.check_acyclic(edges.union(spark.createDataFrame([(20, 1)], edges.schema)))


def test_adaptive_cutoff(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.81, 2), (1, 3, 0.7, 3), (2, 1, 0.2, 1)], "document_id long, concept_id int, score double, rank int")
    kept = {(r.document_id, r.concept_id) for r in ranking.adaptive(rows, 0.3, 0.1, 5).where("kept").collect()}
    assert kept == {(1, 1), (1, 2)}


def test_pool_blocks_agree(spark, monkeypatch):
    documents = spark.createDataFrame([(d, [float(d % 3), 1.0]) for d in range(8)], "document_id long, vector array<double>")
    leaves = spark.createDataFrame([(c, [1.0, float(c)]) for c in range(9)], "concept_id int, leaf_vector array<double>")
    whole = sorted(map(tuple, ranking.pool(documents, leaves, 3).select("document_id", "concept_id", "score", "rank").collect()))
    monkeypatch.setattr(ranking, "BLOCK", 2)
    assert sorted(map(tuple, ranking.pool(documents, leaves, 3).select("document_id", "concept_id", "score", "rank").collect())) == whole


def test_watermark_stops_at_gaps(spark):
    def mark(rows):
        return {r.feed: r.watermark for r in contiguous(spark.createDataFrame(rows, "feed string, slot long, status string")).collect()}

    assert mark([("a", 1, "ok"), ("a", 2, "missing"), ("a", 4, "ok"), ("b", 5, "failed"), ("b", 6, "ok")]) == {"a": 2}
    assert mark([("a", 1, "ok"), ("a", 2, "pending"), ("a", 3, "ok")]) == {"a": 1}


def test_frozen_prefixes_are_proportional(spark):
    rows = spark.createDataFrame([(i, "big" if i < 300 else "small") for i in range(400)], "id long, s string")
    order = sorted((r.position, r.s) for r in sampling.frozen_order(rows, "id", ["s"]).collect())
    assert [p for p, _ in order] == list(range(400))
    for n in (40, 100, 200):
        big = sum(s == "big" for _, s in order[:n])
        assert abs(big - 0.75 * n) <= 2


def test_equal_order_takes_turns(spark):
    rows = spark.createDataFrame([(i, "w1" if i < 90 else "w2", "s") for i in range(100)], "id long, w string, s string")
    order = sorted((r.position, r.w) for r in sampling.equal_order(rows, "id", "w", ["s"]).collect())
    assert [p for p, _ in order] == list(range(100))
    assert 8 <= sum(w == "w2" for _, w in order[:20]) <= 10


def test_near_duplicates_and_standing_representatives(spark):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(1, base, None), (2, base + " more", None), (3, base, None), (4, " ".join(f"other{i}" for i in range(120)), None), (5, "short text", None), (6, "short text", None), (9, base, 3)]
    docs = spark.createDataFrame(rows, "document_id long, body string, duplicate_of long")
    got = {r.document_id: r.duplicate_of for r in minhash.deduplicate(docs).collect()}
    assert got == {1: 3, 2: 3, 3: None, 4: None, 5: None, 6: None, 9: 3}


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_near_links_join_what_all_pairs_join(spark, monkeypatch, block):
    """Families of signatures around centres, of which many share a band with members unlike them."""
    monkeypatch.setattr(minhash, "QUERIES", block)
    monkeypatch.setattr(minhash, "MEMBERS", block)
    rng = np.random.default_rng(5)
    rows = []
    for size in (60, 25, 8, 1, 2):
        centre = rng.integers(0, 1000, minhash.SLOTS)
        for _ in range(size):
            some = centre.copy()
            changed = rng.choice(minhash.SLOTS, rng.integers(0, 16), replace=False)
            some[changed] = rng.integers(0, 1000, len(changed))
            rows.append([int(x) for x in some])
    rows += rows[:5]
    signed = spark.createDataFrame([(i, 100, s) for i, s in enumerate(rows)], "document_id long, shingles int, signature array<int>")
    bands = [[tuple(s[i : i + minhash.BAND]) for i in range(0, minhash.SLOTS, minhash.BAND)] for s in rows]
    up = list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(rows)):
        for j in range(i):
            if any(x == y for x, y in zip(bands[i], bands[j], strict=True)) and np.mean(np.array(rows[i]) == rows[j]) >= 0.8:
                up[max(root(i), root(j))] = min(root(i), root(j))
    found = minhash.near_links(signed, 0.8)
    for r in found.collect():
        assert r.a > r.b and np.mean(np.array(rows[r.a]) == rows[r.b]) >= 0.8
    got = {r.node: r.component for r in minhash.connected_components(found).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == [root(i) for i in range(len(rows))]
    assert any(root(i) != i for i in range(len(rows))) and minhash.near_links(signed.where("false")).count() == 0


def test_signature_estimates_jaccard():
    a = minhash.text_shingles(" ".join(f"w{i}" for i in range(200)))
    b = minhash.text_shingles(" ".join(f"w{i}" for i in range(10, 200)))
    exact = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - exact) < 0.2


def test_verified(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, False), (3, None), (3, False)], "entry_id int, confirmed boolean")
    assert {r.entry_id: r.verified for r in calendars.verified(rows).collect()} == {1: True, 2: False, 3: None}


def test_judge_is_resumable_and_keeps_failures(spark):
    class Broken:
        name = "broken"

        def answer(self, prompts):
            raise TimeoutError("gone")

    pairs = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "document_id long, concept_id int")
    articles = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "document_id long, body string")
    concepts = spark.createDataFrame([(1, "n", "d")], "concept_id int, name string, definition string")
    done = pairs.where("document_id = 3")
    got = {r.document_id: (r.matched is None, r.error) for r in judging.judge(pairs, articles, concepts, done, judging.HashChat()).collect()}
    assert got == {1: (False, None), 2: (True, "no body")}
    got = {r.document_id: r.error for r in judging.judge(pairs, articles, concepts, done, Broken(), patience=judging.Patience(pause=0)).collect()}
    assert got == {1: "TimeoutError: gone", 2: "no body"}


def test_slices_from_zip(spark, tmp_path):
    def line(url, width=61, **at):
        fields = [""] * width
        fields[60 if width == 61 else 4] = url
        for i, v in at.items():
            fields[int(i[1:])] = v
        return "\t".join(fields)

    rows = [line("http://a", c0="1", c26="145", c27="145", c28="14", c53='x"y'), line(""), "short"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "\n".join(rows) + "\n")
    got = feeds.export_rows(feeds.zipped_lines(spark, f"file://{tmp_path}/a.zip")).collect()
    assert [(r.event_id, r.event_code, r.base_code, r.country, r.code) for r in got] == [("1", "", "145", 'x"y', "145")]
    article = line("http://b", 11, c0="r", c2="1", c8='T1,5;T"2,9', c10="1#n#US#;1#n#US#;2#n##")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", article + "\r\n" + line("http://c", 11, c2="2"))
    got = feeds.article_rows(feeds.zipped_lines(spark, f"file://{tmp_path}/b.zip")).collect()
    assert [(r.url, r.themes, r.countries) for r in got] == [("http://b", ['T"2', "T1"], ["US"])]


def test_lookups(spark, tmp_path):
    (tmp_path / "codes").write_text("01\tA b\n1\tx\nEVENT\ty\n0211\tz\n")
    assert {r.code for r in feeds.code_lookup(spark, f"file://{tmp_path}/codes").collect()} == {"01", "0211"}
    (tmp_path / "themes").write_text("T\t12\nU\tmany\n")
    assert [tuple(r) for r in feeds.theme_lookup(spark, f"file://{tmp_path}/themes").collect()] == [("T", 12)]


def test_extraction():
    html = "<html><nav><a>menu</a></nav><article><p>Hello <b>world</b></p><script>x()</script></article><footer>f</footer></html>"
    settings = html_text.EXTRACTORS
    assert html_text.extract(html, *settings["article"]) == "Hello world"
    assert html_text.extract(html, *settings["all"]) == "menu\nHello world\nf"
    assert html_text.extract(None, *settings["all"]) == ""


def test_calendar_is_refused_as_a_whole(spark, tmp_path):
    head = "id,kind,concept,country_iso3,date,end_date,precursor_of,description,sources,notes\n"
    (tmp_path / "good.csv").write_text(head + "a,event,c,DEU|FRA,2024-01-01,,,d,,\nb,precursor,c,DEU,2024-01-01,2024-01-02,a,d,,\n")
    good = sheets.read_calendar(spark, f"file://{tmp_path}/good.csv").collect()
    assert good[0].countries == ["DEU", "FRA"] and good[1].precursor_of == "a"
    for row in ("a,party,c,DEU,2024-01-01,,,d,,\n", "a,event,c,DEU,2024-13-01,,,d,,\n", "a,precursor,c,DEU,2024-01-01,,zz,d,,\n", "a,event,c,,2024-01-01,,,d,,\n"):
        (tmp_path / "bad.csv").write_text(head + row)
        with pytest.raises(ValueError, match="refused"):
            sheets.read_calendar(spark, f"file://{tmp_path}/bad.csv")


def test_label_imports(spark):
    rows = spark.createDataFrame([("u1", "C", "yes", "human"), ("u2", "C", "no", "human"), ("u1", "Z", "yes", "human"), ("u1", "C", "yes", "human"), ("", "C", "yes", "h")], "document_url string, concept string, matched string, source string")
    documents = spark.createDataFrame([(1, "u1")], "document_id long, url string")
    concepts = spark.createDataFrame([(5, "C")], "concept_id int, concept string")
    existing = spark.createDataFrame([(1, 5)], "document_id long, concept_id int")
    got = sheets.import_labels(rows, documents, concepts, existing)
    assert [tuple(r) for r in got["stubs"].collect()] == [("u2",)] and [r.concept for r in got["unknown"].collect()] == ["Z"]
    assert [(r.document_id, r.url) for r in got["labels"].collect()] == [(None, "u2")]
    assert sheets.import_labels(rows, documents, concepts, existing, overwrite=True)["labels"].count() == 2


def test_whole_document_sheet(spark):
    sheet = spark.createDataFrame([(1, "A; B"), (2, "none"), (3, ""), (4, "A;Q")], "document_id long, concepts string")
    leaves = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "concept_id int, concept string")
    got = {(r.document_id, r.concept_id): r.matched for r in sheets.whole_document_labels(sheet, leaves).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False, (2, 2): False, (2, 3): False}


def test_run_metrics_replace_only_their_runs(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    frame = lambda rows: spark.createDataFrame(rows, "run_id int, f1 double, n_labels long")
    sheets.write_run_metrics(frame([(1, 0.5, 9), (2, None, 3)]), path)
    sheets.write_run_metrics(frame([(1, 0.7, 9)]), path)
    assert [(r.run_id, r.f1) for r in sheets.leaderboard(spark, path).collect()] == [(1, 0.7), (2, None)]


def test_keys_and_sweeps():
    base = {"judge": {"model": "m"}}
    keys = runs.stage_keys(base)
    assert runs.stage_keys({"judge": {"model": "m", "host": "elsewhere"}}) == keys
    other = runs.stage_keys({"judge": {"model": "n"}})
    assert other["candidates"] == keys["candidates"] and other["judge"] != keys["judge"]
    configs = runs.sweep(base, {"judge.vote": ["any", "majority", "unanimous"], "candidates.cutoff.max_k": [5, 15]})
    assert len(configs) == 6 and len({runs.stage_keys(c)["retrieval"] for c in configs}) == 2
    with pytest.raises(ValueError, match="unknown"):
        runs.normalised({"juge": {}})
    assert runs.source_chain(1, {1: 2, 2: 1}) == [1, 2]


def test_snapshot_ignores_order_and_blanks(spark):
    def digest(rows):
        return runs.snapshot_hash(spark.createDataFrame(rows, "concept_id int, name string, definition string")).first()[0]

    assert digest([(1, "a", "b"), (2, "c", None)]) == digest([(2, "c", ""), (1, "a ", "b")]) != digest([(1, "a", "x"), (2, "c", None)])


def test_replayed_batches_add_nothing(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{sf_dir}/events.parquet")
    for round_ in ("one", "two"):
        source = ingest.stream(spark, f"file://{tmp_path}/in", schema)
        ingest.ingest(source, f"file://{tmp_path}/out", f"file://{tmp_path}/{round_}", ["event_id"]).awaitTermination()
        assert KeyedTable(spark, f"file://{tmp_path}/out", ["event_id"]).read().count() == 1000


def test_samples_by_allocation(spark):
    """A window with most rows does not take the others' turns, and every position is given once."""
    rows = spark.range(3000).selectExpr("id AS document_id", "CASE WHEN id % 10 = 0 THEN 'small' ELSE 'large' END AS window", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 END AS s")
    equal = {r.position: r.window for r in sampling.draw_sample(rows, ["s"]).collect()}
    assert sorted(equal) == list(range(3000))
    assert abs(sum(equal[i] == "small" for i in range(200)) - 100) <= 1
    shared = {r.position: r.window for r in sampling.draw_sample(rows, ["s"], allocation="proportional").collect()}
    assert sorted(shared) == list(range(3000)) and abs(sum(shared[i] == "small" for i in range(200)) - 20) <= 8
    with pytest.raises(ValueError):
        sampling.draw_sample(rows, ["s"], allocation="by size")
    assert sampling.draw_sample(rows.where("false"), ["s"]).count() == 0


def test_sample_sheet_without_titles_or_bodies(spark):
    order = spark.createDataFrame([(7, 0), (8, 1), (9, 2)], "document_id long, position long")
    docs = spark.createDataFrame([(7, None, "a"), (8, None, "first\nsecond  line"), (9, "T", None)], "document_id long, title string, body string")
    got = {r.position: (r.document_id, r.title, r.excerpt) for r in sampling.sample_sheet(order, docs, 2, 5).collect()}
    assert got == {2: (8, "first", "first second line"), 3: (9, "T", "")}


def test_prompts_leave_out_what_is_null(spark):
    from pyspark.sql import functions as F

    from skerry.functions import prompts

    rows = spark.sql("SELECT named_struct('concept_id', 1, 'name', 'Strike', 'definition', CAST(NULL AS STRING), 'inclusion', '', 'exclusion', 'threats') AS c, 'abcdefghij' AS body")
    text = prompts.article(F.lit(None).cast("string"), F.lit("T"), F.col("body"), 8)
    out = rows.select(prompts.pair(text, F.col("c")), prompts.concept_first(text, F.col("c")), prompts.extract(text, F.array("c")), prompts.route(text, F.array("c")), prompts.batch(text, F.array("c"))).first()
    assert out[0].startswith("Title: T\nArticle: abcde...\n\nClass: Strike\nDoesn't count if: threats\n\n")
    assert out[1].startswith("Class: Strike") and "\n- Strike: Strike\n" in out[2]
    assert "Number 1\nQuestion: Strike" in out[3] and "Number 1\nClass: Strike" in out[4]


def test_gate_knows_blanks_of_all_scripts(spark):
    from skerry.functions import gate

    pages = ["   　\n", "", None, "  x", ("Wort " * 60), "a b c"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, body string")
    got = {r.i: r.reason for r in rows.select("i", gate.junk_reason(F.col("body")).alias("reason")).collect()}
    assert got == {0: "empty", 1: "empty", 2: "empty", 3: "too_thin", 4: None, 5: "too_thin"}
