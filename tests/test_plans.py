import re
import subprocess
import sys
from pathlib import Path

import pytest

from skerry.plans import cuts, sieve

ROOT = Path(__file__).resolve().parents[1]


def test_sieve_agrees_with_plain_joins(spark, monkeypatch):
    monkeypatch.setattr(sieve, "BUCKETS", 8)
    rows = spark.createDataFrame([(i, i % 7, "x") for i in range(100)] + [(None, 1, "y")], "a long, b long, text string")
    keys = spark.createDataFrame([(3, 3), (50, 1), (99, 0), (99, 1)], "a long, b long")
    kept = sieve.without(rows, keys, "a", "b")
    plain = rows.join(keys, ["a", "b"], "left_anti").select(*rows.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    likely = {r.a for r in sieve.likely(rows, keys, "a").collect()}
    assert {3, 50, 99} <= likely
    assert sieve.without(rows, keys.where("false"), "a").count() == 101


def test_cut_keeps_rows_and_types(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS xs", "CAST(NULL AS string) AS s")
    again = cuts.cut(df)
    assert again.dtypes == df.dtypes and again.count() == 5
    assert "file:" in again.inputFiles()[0]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        cuts.shared_folder(Session())


def test_nothing_imports_the_corpus_subpackage():
    for source in (ROOT / "skerry").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT).parts:
            assert not re.search(r"skerry\.llm|corpus_pipeline", source.read_text()), source


def test_entry_works_without_the_corpus_subpackage():
    code = "import sys; sys.modules['skerry.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
