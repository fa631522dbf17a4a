"""Readers, writers, streams and the entry points."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tremorlake.sources import readers, writers
from tremorlake.streaming import maintenance


def test_repository(spark, tmp_path):
    for p, t in {"docs/a.md": "## X", "b.md": "no", "src/lib/a.ts": "const a = f()", ".git/c.ts": "no", "src/.x/d.ts": "no", "t.tsx": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.file_path: r.kind for r in readers.repository(spark, str(tmp_path)).collect()}
    assert got == {"docs/a.md": "md", "src/lib/a.ts": "ts", "t.tsx": "ts"}


def test_ground_truth_and_logs(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt/b.json").write_text(json.dumps({"cr_id": "2", "impacted_entities": [{"node": "a::b", "justification": "x"}]}, indent=1))
    (tmp_path / "gt/a.json").write_text(json.dumps({"cr_id": "1"}))
    (tmp_path / "gt/c.json").write_text("{broken")
    assert [r.cr_id for r in readers.ground_truth(spark, str(tmp_path / "gt")).collect()] == ["1", "2"]
    (tmp_path / "log.jsonl").write_text('{"call_index": 1, "config_hash": "h"}\n\nnot json\n{"call_index": 2}\n')
    assert sorted(r.call_index for r in readers.json_lines(spark, str(tmp_path / "log.jsonl")).collect()) == [1, 2]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.table(d, str(tmp_path / "t"), ("k",))
    writers.table(d.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ("k",))
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
    writers.append_log(d, str(tmp_path / "l"))
    writers.append_log(d, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    writers.metrics(d, str(tmp_path / "m"))
    assert readers.metrics(spark, str(tmp_path / "m"), "k string, v int").count() == 2
    meta = writers.metadata(spark.createDataFrame([("a", "1")], "key string, value string"), {"a": "2", "b": "3"})
    assert {(r.key, r.value) for r in meta.collect()} == {("a", "2"), ("b", "3")}
    assert writers.markdown(d.orderBy("k")).split("\n")[2] == "| a | 1 |"


def test_stream_of_file_versions(spark, tmp_path):
    schema, seen = "file_path string, content_hash string, version long", []
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    go = lambda: maintenance.changed_files(spark.readStream.schema(schema).parquet(src), str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: seen.append(sorted((r.file_path, r.status) for r in df.collect()))).awaitTermination(120)
    go()
    spark.createDataFrame([("a", "1", 2), ("b", "2", 2), ("c", "1", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    assert [x for x in seen if x] == [[("a", "new"), ("b", "new")], [("b", "changed"), ("c", "new")]]


def test_entry_without_the_training_data_operators():
    """The registry works when the optional subpackage isn't there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tremorlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bfs_capped' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=here, env=os.environ | {"PYTHONPATH": here}, timeout=120).returncode == 0


@pytest.mark.parametrize("name", ["analyze_v0", "analyze_v7"])
def test_analysis_is_deterministic_and_consistent(spark, small, name):
    from tremorlake.catalogue import QUERIES

    a = QUERIES[name](spark, small).collect()
    assert a and len({(r.cr, r.node_id) for r in a}) == len(a) and all("::" in r.node_id for r in a)
    assert all(r.is_seed == (r.depth == 0) == (r.chain == "") for r in a)
