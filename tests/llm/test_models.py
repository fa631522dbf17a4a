"""Near-dedup, quality, language-model scoring, nearest neighbours and the pipeline: against brute force and held-out truth."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose, row
from tremorlake.llm import kernel, minhash, neighbours, quality


def word_list(t):
    return re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", (t or "").lower())


def shingles(t, n=3):
    w = word_list(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_groups(rows, tau):
    ids, parent = [i for i, _ in rows], {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    sets = {i: shingles(t) for i, t in rows}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= tau * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    out = defaultdict(list)
    for i in ids:
        out[find(i)].append(i)
    return {(i, g, len(m)) for g, m in out.items() if len(m) > 1 for i in m}


def edited(t, r, share):
    return " ".join(x if r.random() > share else f"e{r.randrange(999)}" for x in t.split())


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(1)
    rows, i = [], 0
    for k in range(30):
        base = prose(1000 + k, r.choice([5, 40, 200]), 3000)
        for c in range(r.choice([1, 1, 2, 6])):
            rows.append((i, base if r.random() < 0.3 else edited(base, r, 0.02)))
            i += 1
    rows += [(i + 1, None), (i + 2, ""), (i + 3, "a"), (i + 4, "A!"), (i + 5, prose(9, 50_000, 9999)), (i + 6, prose(9, 50_000, 9999) + " tail")]
    d = spark.createDataFrame([row(*x) for x in rows], SCHEMA).repartition(4)
    got = {(x.doc_id, x.group_id, x.group_size) for x in minhash.near_duplicates(d).collect()}
    assert got == brute_groups(rows, 0.5)
    kept = minhash.near_dedup(d)
    assert kept.columns == d.columns and kept.count() == len(rows) - sum(a != g for a, g, _ in got)


def test_bucket_of_several_groups_is_exact(spark):
    """With one coordinate a band buckets hold unlike documents: pairs that the least id doesn't link are compared too."""
    rows = [(i, prose(i % 5, 60, 30)) for i in range(40)]
    rows = [(i, edited(t, random.Random(i), 0.01)) for i, t in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.group_id, x.group_size) for x in minhash.near_duplicates(d, r=1, t=32).collect()}
    assert got == brute_groups(rows, 0.5)


def test_near_duplicates_nasty(nasty, empty):
    got = {(r.doc_id, r.group_id) for r in minhash.near_duplicates(nasty).collect()}
    assert {(1, 1), (2, 1), (11, 1), (6, 6), (7, 6)} <= got and not {i for i, _ in got} & {None, 3, 4, 5, 8, 10, 12}
    assert minhash.near_duplicates(empty).count() == 0 and minhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("n", [1, 3, 50, 3000])
def test_sketches_fill_every_coordinate_and_estimate(n):
    r = np.random.default_rng(n)
    a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n - n // 2).astype(np.uint64)]))
    s = minhash.fast_sketch(np.concatenate([a, b, a]), np.array([0, len(a), len(a) + len(b), 2 * len(a) + len(b)]), 128)
    assert (s != np.iinfo(np.uint64).max).all() and (s[0] == s[2]).all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - j) < 0.2


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 10), (20, 21), (5, 5)] + [(30 + i, 31 + i) for i in range(25)]
    got = {r[0]: r[1] for r in minhash.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {30 + i: 30 for i in range(26)}


# Kneser-Ney
def toks(t):
    return re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+|[^\sA-Za-z0-9_\x80-\U0010ffff]+", t or "")


def brute_kn(train, texts):
    c3, c2, c1 = Counter(), Counter(), Counter()
    for t in train:
        w = ["<>", "<>", *toks(t), "<>"]
        c3.update(zip(w, w[1:], w[2:]))
    for u, v, w in c3:
        c2[v, w] += 1
    for v, w in c2:
        c1[w] += 1

    def disc(c):
        n = [sum(x == i for x in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0]
        for i in (1, 2, 3):
            x = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else -1
            d.append(x if n[1] and 0 < x < i else 0.5 * i)
        return lambda k: d[min(k, 3)]

    d3, d2, d1 = disc(c3), disc(c2), disc(c1)
    t3, t2, t1 = defaultdict(int), defaultdict(int), sum(c1.values())
    g3, g2 = defaultdict(float), defaultdict(float)
    for (u, v, w), k in c3.items():
        t3[u, v] += k
        g3[u, v] += d3(k)
    for (v, w), k in c2.items():
        t2[v] += k
        g2[v] += d2(k)
    p0 = sum(d1(k) for k in c1.values()) / t1 / (len(c1) + 1)

    def p(u, v, w):
        x = p0 + (max(0, c1[w] - d1(c1[w])) / t1 if c1[w] else 0)
        if t2[v]:
            x = (c2[v, w] - d2(c2[v, w]) if c2[v, w] else 0) / t2[v] + g2[v] / t2[v] * x
        if t3[u, v]:
            x = (c3[u, v, w] - d3(c3[u, v, w]) if c3[u, v, w] else 0) / t3[u, v] + g3[u, v] / t3[u, v] * x
        return x

    out = []
    for t in texts:
        w = ["<>", "<>", *toks(t), "<>"]
        out.append(math.exp(-sum(math.log(p(*x)) for x in zip(w, w[1:], w[2:])) / (len(w) - 2)) if toks(t) else None)
    return out


def test_kneser_ney_equals_brute_force(spark):
    train = [prose(i, 60, 40) + "." for i in range(20)] + ["", "Hello, world!"]
    bad = ["awful words " + prose(99, 20, 40)]
    tests = [prose(50, 30, 60), "w1 w2 w3", "unseen tokens only", "", None, "Hello, world!"]
    sample = spark.createDataFrame([(t, 1) for t in train] + [(t, 0) for t in bad], "_text string, _trusted long")
    path = quality.train(sample)
    d = spark.createDataFrame([(i, "en", t) for i, t in enumerate(tests)], "_id long, _lang string, _text string")
    got = [r.perplexity for r in sorted(quality.scores(d, path).collect(), key=lambda r: r._id)]
    for a, b in zip(got, brute_kn(train, tests)):
        assert (a is None and b is None) or abs(a / b - 1) < 1e-4


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_s"), reason="needs enough labels in each language")
def test_classifier_on_held_out_labels(spark):
    """Labels that no model or threshold saw, over all labelled documents."""
    d, l = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2))
    got = quality.classify(d.join(l, "doc_id", "left_semi"), l.where(half == 0)).join(l.where(half == 1), "doc_id").toPandas()
    for lang, g in got.groupby("lang"):
        keep = lambda q, t: g[(g.quality == q) & (g.toxic == t)].keep.mean()  # noqa: E731, B023
        assert keep(1, 0) > 0.97 and keep(1, 1) < 0.02 and keep(0, 0) < 0.3, (lang, keep(1, 0), keep(1, 1), keep(0, 0))


def test_classifier_nasty(spark, nasty, empty):
    l = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (10, 0, 1), (9, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(nasty, l)
    assert got.count() == nasty.count() and got.columns == ["doc_id", "lang", "n_tokens", "perplexity", "toxicity", "keep"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].perplexity is None and not by[3].keep and not by[4].keep and not by[8].keep
    none = quality.classify(nasty, l.limit(0))
    assert {r.doc_id for r in none.where("keep").collect()} >= {1, 5, 9, 12} and none.count() == nasty.count()
    assert quality.classify(empty, l).count() == 0 and quality.classify(empty, l.limit(0)).count() == 0


# Nearest neighbours
def recall(df, k=10, **how):
    p = df.select("vec_id", "embedding").toPandas()
    x = np.stack(p.embedding.values).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    got = neighbours.nearest(df, k, **how).toPandas()
    sets, ids = got.groupby("vec_id").neighbour.apply(set), p.vec_id.values
    hit = np.mean([len(sets[ids[i]] & set(ids[np.argsort(-s[i], kind="stable")[:k]])) / k for i in range(len(x))])
    at = {v: i for i, v in enumerate(ids)}
    assert all(abs(s[at[r.vec_id], at[r.neighbour]] - r.similarity) < 2e-6 for r in got.head(200).itertuples())
    assert (got.groupby("vec_id").size() == k).all() and len(sets) == len(ids)
    return hit


def test_recall_of_every_row(spark, small):
    assert recall(spark.read.parquet(f"{small}/embeddings.parquet")) > 0.95
    r = np.random.default_rng(0)
    c = r.standard_normal((40, 24))
    x = [(int(i), (c[i % 40] + 0.3 * r.standard_normal(24)).tolist()) for i in range(3000)]
    assert recall(spark.createDataFrame(x, "vec_id long, embedding array<double>")) > 0.95


def test_neighbours_nasty(spark):
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(9)] + [(9, None), (10, [0.0, 0.0, 0.0]), (11, [1.0, 2.0]), (12, [1.0, None, 2.0]), (None, [1.0, 2.0, 3.0]), (3, [1.0, 0.0, 0.5]), (13, [float("nan"), 1.0, 1.0])]
    d = spark.createDataFrame([(*x, "q") for x in rows], "vec_id long, embedding array<double>, q string")
    got = neighbours.nearest(d, 2).collect()
    assert {r.vec_id for r in got} == set(range(9)) and all(r.similarity == 1.0 for r in got) and {r.neighbour for r in got if r.vec_id == 0} == {3, 6}
    assert neighbours.nearest(d.limit(0), 2).count() == 0
    assert neighbours.nearest(d.where("vec_id = 1"), 2).count() == 0


# Pipeline
def test_pipeline_stages_take_effect(spark, small):
    import corpus_pipeline as cp

    from tremorlake.llm import queries, token_counts

    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    now, seen = docs.cache(), {}
    for name, f in cp.STAGES:
        out = f(spark, now, small).cache()
        seen[name] = (now, out)
        now = out
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == docs.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    text = lambda df: {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    before, after = seen["quality"]
    kept = {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{small}/labels.parquet")).where("keep").collect()}
    assert ids(after) == kept and text(after).items() <= text(before).items()
    before, after = (text(x) for x in seen["line_dedup"])
    places, want = set(), {}
    for i in sorted(before):
        parts = before[i].split("\n")
        left = [x for x in parts if len(x) < 40 or x not in places]
        places |= {x for x in parts if len(x) >= 40}
        # within a document too only the first counts
        first, out = set(), []
        for x in left:
            if len(x) < 40 or x not in first:
                out.append(x)
            first.add(x)
        want[i] = "\n".join(out)
    assert after == {i: t for i, t in want.items() if t.strip(" ") != ""}
    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == {i for i, _ in rows} - {i for i, g, _ in brute_groups(rows, 0.5) if i != g}
    before, after = seen["decontamination"]
    items = [word_list(r.text) for r in bench.collect()]
    grams = {tuple(w[j : j + 13]) for w in items for j in range(max(1, len(w) - 12))}
    dirty = set()
    for i, t in text(before).items():
        w = word_list(t)
        if any(tuple(w[j : j + k]) in grams for k in {len(g) for g in grams} for j in range(len(w) - k + 1)):
            dirty.add(i)
    assert ids(after) == ids(before) - dirty
    before, after = seen["packing"]
    encode = token_counts.encoder(queries.TOKENIZER)
    size = {i: n for i, t in text(before).items() if (n := encode([t or ""])[0])}
    got = after.toPandas()
    assert got.groupby("doc_id").n_units.sum().to_dict() == size and got.groupby(["shard", "bin"]).n_units.sum().max() <= 4096
    run = cp.run(spark, small).toPandas()
    assert sorted(map(tuple, run.values.tolist())) == sorted(map(tuple, got.values.tolist()))
