"""Tokens found by bytes are those of the column expression."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tremorlake.functions.text import tokenise
from tremorlake.operators import lexical


def test_tokens_by_bytes(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("aAbBcCzZ09 .-_éÉßKİſ日\n") for _ in range(r.randint(0, 30))) for _ in range(2000)] + [None, "", "ABCd", "aB", "ABc the", "x", "12", "12a", "XMLHttpRequest"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {x.id: list(x.ts or []) for x in df.select("id", tokenise(F.col("text")).alias("ts")).collect()}
    for start in (0, 17):  # a slice too
        rows, code, words = lexical.token_lists(pa.array(texts).slice(start))
        got = {i: [] for i in want if i >= start}
        for i, w in zip(rows, words.take(pa.array(code)).to_pylist()):
            got[int(i) + start].append(w)
        assert got == {i: w for i, w in want.items() if i >= start}
    counted = {(x.id, x.term): (x.tf, x.dl) for x in lexical.terms(df, "id", "text").collect()}
    assert counted == {(i, w): (ts.count(w), len(ts)) for i, ts in want.items() for w in ts}
    assert "split(" not in lexical.terms(df, "id", "text")._jdf.queryExecution().executedPlan().toString()  # the expression, one lambda a token, was most of the time


def test_overlap_takes_terms_once_a_text(spark):
    from tremorlake.operators import rescoring as R

    pool = spark.createDataFrame([(c, n) for c in (1, 2) for n in "ab"], "cr int, node_id string")
    texts = spark.createDataFrame([("a", None, "red apple tree"), ("b", "green apple", "unread"), ("c", None, None)], "node_id string, abstraction string, snippet string")
    asked = spark.createDataFrame([(1, 0, "red apple"), (1, 1, "green"), (2, 0, "pear")], "cr int, q int, text string")
    got, pairs = R.cross_encode(pool, texts, asked), R.cross_encode(pool, texts, asked, lambda rows: R.overlap(rows))
    assert sorted(map(str, got.collect())) == sorted(map(str, pairs.collect()))
    assert {(x.cr, x.node_id): x.raw for x in got.collect()} == {(1, "a"): 1.0, (1, "b"): 1.0, (2, "a"): 0.0, (2, "b"): 0.0}
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, x in enumerate(lines) if "Join " in x]
    assert not any("split(" in x for x in lines[: joins[1]])  # the second join makes the pairs
