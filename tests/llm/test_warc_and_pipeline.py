import gzip
import hashlib
import json
import re

import corpus_pipeline
from skerry.llm import bpe, decontam, pii, quality, warc
from tests.llm.test_jaccard import brute as near


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    long = "<p>" + "é text " * 30 + "</p>"
    rows = [(3, "u3", long), (1, "u\n1", long), (2, "u2", "short"), (4, "u4", "short"), (5, None, None), (6, "u6", "\r\n\r\nWARC/1.1\r\n" + "x" * 200), (7, "u7", long), (None, "n", "z")]
    rows += [(10 + i, f"v{i}", f"page {i} " * 40) for i in range(40)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = {r.page_id: r for r in warc.through_archives(pages, f"file://{tmp_path}/w").collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        raw = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r.url == re.sub("[\r\n]", " ", url or "")
        if page in (3, 7):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 1, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
    names = sorted((tmp_path / "w" / "records").glob("*.warc.gz"))
    assert len(names) > 2
    for name in names:
        data = name.read_bytes()
        entries = [json.loads(x) for x in (name.parent / f"{name.name}.idx").read_text().splitlines()]
        assert sum(e["length"] for e in entries) == len(data)
        for e in entries:
            record = gzip.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {e['type']}".encode() in record
    assert warc.through_archives(pages.where("false"), f"file://{tmp_path}/e").count() == 0


def test_pipeline_agrees_with_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in docs.where(quality.verdict(quality.text_rules(docs["text"]))).collect()}
    firsts = near([(d, rows[d].text) for d in good], 5, 80)
    kept = {d for d in good if firsts[d][1] == d}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontam.Index(tuple(items))
    from tests.llm.test_decontam import brute

    kept = {d for d in kept if not brute(index, rows[d].text)}
    texts = pii.pseudonymize(docs, corpus_pipeline.PII_KEY)
    want = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(texts).collect() if r.doc_id in kept}
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: r.ids_sha256 for r in got.collect()} == want
    assert len(want) < len(rows)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "BPE encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()
