"""The quality classifier's models are of all training text."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tests.llm.test_models import brute_kn
from tremorlake.llm import quality


def lowest_order(texts):
    """Kneser-Ney probabilities of words alone; None is an unseen one."""
    before = defaultdict(set)
    for t in texts:
        x = ["<>", "<>", *t.split(), "<>"]
        for u, v, w in zip(x, x[1:], x[2:]):
            before[w].add(v)
    c = {w: len(s) for w, s in before.items()}
    n = [sum(k == i for k in c.values()) for i in (1, 2, 3, 4)]
    d = quality.discounts(dict(enumerate(n, 1)))
    less, total = {w: d[min(k, 3) - 1] for w, k in c.items()}, sum(c.values())
    p0 = sum(less.values()) / total / (len(c) + 1)
    return {None: p0} | {w: (k - less[w]) / total + p0 for w, k in c.items()}


def test_all_training_documents_train(spark):
    good, bad = 2600, 1100
    text = {i: prose(i, 8, 300 + i) for i in range(good)} | {good + i: prose(i, 4, 300) + f" bad{i}" for i in range(bad)}
    docs = spark.createDataFrame([(i, "en", t) for i, t in text.items()], "doc_id long, lang string, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < good), int(i >= good)) for i in text], "doc_id long, quality int, toxic int")
    trains = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0).collect() if r.doc_id < good}
    assert len(trains) > 1200
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    p, q = lowest_order([text[i] for i in sorted(trains)]), lowest_order([text[i] for i in text if i >= good])
    for i, x in zip(text, brute_kn([text[i] for i in sorted(trains)], list(text.values()))):
        assert abs(got[i].perplexity / x - 1) < 1e-6
        odd = max(math.log(q[w] / p.get(w, p[None])) if w in q else -50.0 for w in text[i].split())
        assert abs(got[i].toxicity - odd) < 1e-6


@pytest.mark.parametrize("shard_grams, codes", [(60, 65535), (1 << 20, 12), (60, 12)])
def test_split_and_rare_words_equal_brute_force(spark, shard_grams, codes):
    train = [prose(i, 60, 12 + 3 * i) + "." for i in range(30)] + ["", "Hello, world!"]
    bad = ["awful words " + prose(99, 20, 40), "w1 awful w2"]
    tests = [prose(50 + i, 40, 90) for i in range(20)] + ["w1 w2 w3 .", "unseen tokens only", "", None, "Hello, world!"]
    model = quality.train(spark.createDataFrame([(t, 1) for t in train] + [(t, 0) for t in bad], "_text string, _trusted long").repartition(2), shard_grams, codes, 4000)
    assert (len(model[0].hot.keys) > 3 and model[0].shards > 20) == (shard_grams == 60) and model[0].whole == (codes == 65535)
    d = spark.createDataFrame([(i, "en", t) for i, t in enumerate(tests)], "_id long, _lang string, _text string").repartition(2)
    got = {r._id: r for r in quality.scores(d, model, 2).collect()}
    p, q = (lowest_order([t.replace(".", " .").replace(",", " ,").replace("!", " !") for t in x]) for x in (train, bad))
    for i, x in enumerate(brute_kn(train, tests)):
        assert got[i].perplexity is None and got[i].toxicity is None if x is None else abs(got[i].perplexity / x - 1) < 1e-6
        if x is not None and i < 22:
            odd = max(math.log(q[w] / p.get(w, p[None])) if w in q else -50.0 for w in tests[i].split())
            assert abs(got[i].toxicity - odd) < 1e-6
