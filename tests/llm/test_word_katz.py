"""Katz over words: against brute force, also as the registered query."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import prose
from tests.llm.test_models import toks
from tremorlake.llm import queries, shard_katz, word_katz


def brute(texts, order, tests):
    pad = lambda t: ["<>"] * (order - 1) + toks(t) + ["<>"]
    c = {k: Counter() for k in range(1, order + 1)}
    for s in map(pad, texts):
        for i in range(order - 1, len(s)):
            for k in range(1, order + 1):
                c[k][tuple(s[i - k + 1 : i + 1])] += 1
    symbols = len(c[1]) + 1
    p, alpha = {}, {}
    for k in range(1, order + 1):
        n = Counter(c[k].values())
        top = 6 * n[6] / n[1] if n[1] else 1.0
        d = {}
        for r in range(1, 6):
            if n[r] and n[r + 1] and top < 1 and 0 < (x := ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)) < 1:
                d[r] = x
        ctx = defaultdict(list)
        for g, m in c[k].items():
            ctx[g[:-1]].append((g, m))
        for h, gs in ctx.items():
            tot, disc = sum(m for _, m in gs), sum(m * d.get(m, 1.0) for _, m in gs)
            scale = tot / (tot + 1) if all(d.get(m, 1.0) == 1.0 for _, m in gs) else 1.0
            alpha[h] = (1 - scale * disc / tot) / max(1 - sum(p[g[1:]] if k > 1 else 1 / symbols for g, _ in gs), 1e-12)
            for g, m in gs:
                p[g] = scale * d.get(m, 1.0) * m / tot

    def prob(g):
        return p[g] if g in p else alpha[()] / symbols if len(g) == 1 else alpha.get(g[:-1], 1.0) * prob(g[1:])

    for h in [("<>",) * (order - 1), ("w1",) * (order - 1), ("?",) * (order - 1)]:
        assert abs(sum(prob((*h, w)) for (w,) in [*c[1], ("never seen",)]) - 1) < 1e-9
    return [(len(toks(t)) + 1, sum(math.log(prob(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))) for t in tests for s in [pad(t)]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, order):
    train = [prose(i, 40, 25) + "." for i in range(25)] + ["", None, "é漢 Hello, world!"]
    tests = ["w1 w2", "zzz 漢 Q w1 w2 w3 zzz zzz", "", None, prose(2, 40, 25)]
    path = word_katz.train(spark.createDataFrame([(t,) for t in train], "_text string"), order)
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(tests)], "doc_id long, text string, w1 string, p string")
    got = sorted(word_katz.score(d, path, order).collect(), key=lambda r: r.doc_id)
    want = brute(train, order, tests)
    assert [r.n_tokens for r in got] == [n for n, _ in want] and np.allclose([r.log_prob for r in got], [s for _, s in want], rtol=1e-9)


def test_query_scores_words(spark, tmp_path):
    texts = [prose(i, 60, 200) for i in range(30)] + [prose(3, 60, 200), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op8_lm_scoring(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    want = brute(texts, 3, texts)
    assert [r.n_tokens for r in got] == [n for n, _ in want] and np.allclose([r.log_prob for r in got], [s for _, s in want], rtol=1e-9)


def test_nasty(nasty, empty):
    got = word_katz.word_katz(nasty).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == nasty.count() and by[3].n_tokens == by[4].n_tokens == 1 and by[5].n_tokens == 60_001
    assert sum(r.doc_id == 9 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2
    assert word_katz.word_katz(empty).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("grams, block", [(40, 1 << 19), (400, 1 << 19), (1_000_000, 1 << 19), (400, 37), (1_000_000, 37)])
def test_shards_equal_brute_force(spark, monkeypatch, order, grams, block):
    """With few occurrences a shard, frequent middle words are split; shards of many are looked at in blocks."""
    monkeypatch.setattr(shard_katz, "BLOCK", block)
    train = [prose(i, 40, 25) + "." for i in range(25)] + ["", None, "é漢 Hello, world!"]
    tests = ["w1 w2", "zzz 漢 Q w1 w2 w3 zzz zzz", "", None, prose(2, 40, 25)]
    rows = lambda texts: spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, w1 string, p string")
    model = shard_katz.train(rows(train).selectExpr("doc_id _id", "text _text"), order, grams)
    assert model[0].shards > 3 or grams > 40
    for texts, got in ((tests, shard_katz.score(rows(tests), model)), (train, shard_katz.score(rows(train), model, seen=f"{model[1]}/seen"))):
        got, want = sorted(got.collect(), key=lambda r: r.doc_id), brute(train, order, texts)
        assert [r.n_tokens for r in got] == [n for n, _ in want] and np.allclose([r.log_prob for r in got], [s for _, s in want], rtol=1e-9)


def test_packed_occurrences_come_back():
    r = np.random.default_rng(3)
    words = r.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    codes = shard_katz.Codes(words[:200])
    for n in (0, 1, 7, 5000):
        u, v, w = (words[r.integers(0, k, n)] for k in (500, 60, 500))
        doc = r.integers(0, 70_000, n)
        got = codes.unpack(codes.pack(u, v, w, doc))
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(u.tolist(), v.tolist(), w.tolist(), doc.tolist()))


def test_shards_nasty(nasty, empty):
    got = shard_katz.word_katz(nasty, shard_grams=5000).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == nasty.count() and by[3].n_tokens == by[4].n_tokens == 1 and by[5].n_tokens == 60_001
    assert sum(r.doc_id == 9 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2
    assert shard_katz.word_katz(empty).count() == 0
