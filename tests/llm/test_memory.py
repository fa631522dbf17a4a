"""What the stages of the pipeline hold at a time."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructType

from tests.llm.conftest import prose
from tremorlake.llm import decontaminate


@pytest.fixture
def narrow(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "256k")
    yield
    spark.conf.set(key, old)


def test_decontamination_shuffles_no_texts(spark, narrow):
    item = prose(1, 30)
    docs = spark.createDataFrame([(i, (item if i % 10 == 0 else "") + " " + prose(i + 2, 50)) for i in range(200)], "doc_id long, text string")
    kept = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 10}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan


def test_decontamination_scans_in_small_blocks():
    item = prose(9999, 30)
    found = decontaminate.patterns([(1, item)], 13)
    schema = StructType()
    for c in ("_id", "_item", "start", "end", "matched", "_w"):
        schema = schema.add(c, LongType())
    scan = decontaminate._scan(SimpleNamespace(_path="test_memory", value=list(found.items())), schema)
    texts = [prose(i, 400) + (" " + item if i % 50 == 0 else "") for i in range(2600)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["_id", "_text"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    hits = [i for b in scan(iter([batch])) for i in b.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits == [i for i in range(len(texts)) if i % 50 == 0] and peak < 64 << 20
