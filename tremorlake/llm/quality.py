"""Quality classifier: interpolated modified Kneser-Ney on trusted text, thresholds by language-specific quantiles.

A document's perplexity under a trigram model of trusted text tells junk from
prose. A few insults among hundreds of words hardly move it, so a second
Kneser-Ney model, of text labelled toxic, gives each word the log ratio of its
lowest-order probabilities; a document's toxicity is its largest. Both are
thresholded by quantiles of trusted documents that trained neither model.

The models are of all training text. Distinct trigrams and their counts are
kept packed, in shards by their middle word as in shard_katz: a shard has all
counts that a probability needs but those of the word alone, and it is linear in
that word's probability, p = a + b p(w). Frequent words' probabilities are known
to all tasks, rare words' are joined to the (a, b) of where they are. Middle
words of more trigrams than a task should hold are split by the word before;
counts of their bigrams are merged and read by each shard that has a part.
Documents' trigrams are shuffled to the shards, in rounds by hash of the id, so
a task holds one shard of the model and a block of trigrams, and nothing is read
once for each block of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructType

from .kernel import Lookup, by_bytes, combine, mix, raw, release, tokens
from .shard_katz import _EDGE, _read, _unique, CODES, grams, Plan, vocabulary
from .shared import drop, folder, forget, let_go, written

#: Parts in which documents are scored, one after the other: what is shuffled at a time is a part of it.
ROUNDS = 4
#: Log ratio of words that no toxic text has.
NEVER = -50.0
#: Rows of counts: bigrams of split words, words, counts of counts of bigrams and of trigrams, trigrams.
PAIR, WORD, TWICE, THRICE, GRAMS = range(5)
#: Rows of scores: sums of a document's part in a shard, documents, occurrences of rare words.
SUM, DOC, RARE = range(3)


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more of modified Kneser-Ney from counts of counts; where these are too few, one half of the count."""
    n1, n2, *_ = m = [n.get(i, 0) for i in (1, 2, 3, 4)]
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [i - (i + 1) * y * m[i] / m[i - 1] if m[i - 1] else 0.0 for i in (1, 2, 3)]
    return tuple(x if n1 and 0 < x < i else 0.5 * i for i, x in enumerate(d, 1))


def _less(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def _packed(plan: Plan, held: list[tuple[np.ndarray, ...]]) -> list[pa.Array]:
    """[shards, blocks] of (u, v, w, tag)."""
    columns = [list(x) for x in zip(*held)]
    held.clear()
    u, v, w, tag = (np.concatenate(columns.pop(0)) for _ in range(4))
    s = plan.shard(u, v)
    o = np.argsort(s, kind="stable")
    at = np.concatenate([[0], np.flatnonzero(np.diff(s[o])) + 1, [len(o)]]) if len(o) else np.zeros(1, np.int64)
    parts = [o[i:j] for i, j in zip(at[:-1], at[1:])]
    return [pa.array([int(s[p[0]]) for p in parts], pa.int32()), pa.array([plan.codes.pack(u[p], v[p], w[p], tag[p]) for p in parts], pa.binary())]


def trigrams(sample: DataFrame, plan: Plan, most: int = 1 << 20) -> DataFrame:
    """(shard, block): packed trigrams of rows (_text, _trusted), tagged by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in by_bytes(batches, "_text", 1 << 20):
            g, first = grams(*tokens(*raw(b.column(0))), 3)
            held.append((*g, np.repeat(b.column(1).to_numpy(), np.diff(first))))
            size += len(g[0])
            if size >= most:
                yield pa.RecordBatch.from_arrays(_packed(plan, held), ["shard", "block"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(_packed(plan, held), ["shard", "block"])
        release()

    return sample.mapInArrow(run, "shard int, block binary")


def counts(plan: Plan, blocks: DataFrame) -> DataFrame:
    """(kind, shard, t, v, w, c, block) of the trigrams of whole shards, by class t; of class 1 also the distinct trigrams, tagged by their counts."""
    names = ["kind", "shard", "t", "v", "w", "c", "block"]

    def rows(kind: int, t: int, v: np.ndarray, w: np.ndarray, c: np.ndarray, shard: int = -1, block: bytes | None = None) -> pa.RecordBatch:
        one = lambda x, k: pa.array(np.full(len(c), x, k))
        return pa.RecordBatch.from_arrays([one(kind, np.int32), one(shard, np.int32), one(t, np.int32), pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array(c.astype(np.int64)), pa.array([block] * len(c), pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                held[s].append(x.as_py())
        for s in sorted(held):
            columns = [list(x) for x in zip(*map(plan.codes.unpack, held.pop(s)))]
            u, v, w, t = (np.concatenate(columns.pop(0)) for _ in range(4))
            none = np.zeros(4, np.uint64)
            for k in (0, 1):
                i = np.flatnonzero(t == k)
                at, c, _ = _unique(combine(combine(u[i], v[i]), w[i]))
                u3, v3, w3 = (x[i[at]] for x in (u, v, w))
                if k == 1:
                    yield rows(THRICE, k, np.arange(1, 5), none, np.bincount(np.minimum(c, 5), minlength=6)[1:5])
                    yield rows(GRAMS, k, none[:1], none[:1], np.array([len(c)]), s, plan.codes.pack(u3, v3, w3, c))
                at, c, _ = _unique(combine(v3, w3))
                v2, w2 = v3[at], w3[at]
                split = plan.hot.find(v2) >= 0
                yield rows(TWICE, k, np.arange(1, 5), none, np.bincount(np.minimum(c[~split], 5), minlength=6)[1:5])
                yield rows(PAIR, k, v2[split], w2[split], c[split])
                word, n = np.unique(w2[~split], return_counts=True)
                yield rows(WORD, k, np.zeros(len(word), np.uint64), word, n)
            del u, v, w, t
            release()

    return blocks.repartitionById(plan.shards, "shard").mapInArrow(run, "kind int, shard int, t int, v long, w long, c long, block binary")


def train(sample: DataFrame, shard_grams: int = 3 << 18, codes: int = CODES, others: int = 0) -> tuple[Plan, str]:
    """The model of all rows (_text, _trusted): what tasks share, and the folder of its tables.

    A task should hold shard_grams trigrams; others is about how many are
    scored in a round. The most frequent words, `codes` at most, are known to
    all tasks.
    """
    spark, path = sample.sparkSession, folder(sample.sparkSession)

    def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    words = kept(vocabulary(sample), "words")
    total, n_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = kept(words.orderBy(F.desc("c"), "w").limit(codes), "top")  # a table of fixed size
    # how often a word is in the middle, of training text or of what is scored, whichever is more
    often = F.col("c") * max(1.0, others / 2 / max(total, 1))
    hot = {r["w"]: r["parts"] for r in words.where((often > shard_grams / 2) & (F.col("w") != int(_EDGE))).select("w", F.ceil(often * 2 / shard_grams).alias("parts")).collect()}  # about 2 * total / shard_grams at most
    plan = Plan(3, max(1, -(-total // shard_grams), -(-others // (2 * shard_grams))), top.toPandas()["w"].to_numpy(np.int64).view(np.uint64), hot)
    plan.whole = n_words <= codes
    found = kept(counts(plan, trigrams(sample, plan)), "found", "kind", "shard")
    let_go(spark)
    pairs = kept(found.where(F.col("kind") == PAIR).groupBy("t", "v", "w").agg(F.sum("c").alias("c")).repartition("v"), "pairs", "t", "v")
    one = found.where(F.col("kind") == WORD).select("t", "w", "c").unionByName(pairs.select("t", "w", F.lit(1).cast("long").alias("c")))
    one = kept(one.groupBy("t", "w").agg(F.sum("c").alias("c")), "one")
    hist = defaultdict(lambda: defaultdict(int))
    for r in found.where(F.col("kind").isin(TWICE, THRICE)).groupBy("kind", "t", "v").agg(F.sum("c").alias("c")).collect():
        hist[r["kind"], r["t"]][r["v"]] += r["c"]
    for k, df in ((TWICE, pairs), (WORD, one)):
        for r in df.where("c <= 4").groupBy("t", "c").count().collect():
            hist[k, r["t"]][r["c"]] += r["count"]
    plan.d3, plan.d2 = discounts(hist[THRICE, 1]), discounts(hist[TWICE, 1])
    d1 = {t: discounts(hist[WORD, t]) for t in (0, 1)}
    sums = {r["t"]: r for r in one.groupBy("t").agg(F.sum("c").alias("n"), F.count("*").alias("v"), *[F.sum(F.when(F.col("t") == t, _less(d1[t]))).alias(f"d{t}") for t in (0, 1)]).collect()}  # two rows
    p0 = {t: r[f"d{t}"] / r["n"] / (r["v"] + 1) for t, r in sums.items()}
    plan.unseen = p0.get(1, 1.0)  # 1 where nothing was trained
    p = {t: F.max(F.when(F.col("t") == t, (F.col("c") - _less(d1[t])) / float(sums[t]["n"]) + p0[t])) if t in sums else F.lit(None).cast("double") for t in (0, 1)}
    odd = F.when(F.col("w") == int(_EDGE), F.lit(float("-inf"))).otherwise(F.coalesce(F.log(F.col("q") / F.col("p")), F.lit(NEVER)) if 1 in sums else F.lit(NEVER))
    single = one.groupBy("w").agg(F.coalesce(p[1], F.lit(plan.unseen)).alias("p"), p[0].alias("q")).select("w", "p", odd.alias("odd"))
    single = kept(single, "single")
    known = single.join(top.select("w"), "w").toPandas()  # as many as have codes
    i = plan.codes.lookup.find(known["w"].to_numpy(np.int64).view(np.uint64))
    plan.p1, plan.odd = np.full(len(top_keys := plan.codes.lookup.keys), plan.unseen), np.full(len(top_keys), NEVER)
    plan.p1[i], plan.odd[i] = known["p"].to_numpy(np.float64), known["odd"].to_numpy(np.float64)
    for name in ("words", "top", "one", "pairs/t=0", *(f"found/kind={k}" for k in range(GRAMS))):
        drop(spark, f"{path}/{name}")
    let_go(spark)
    return plan, path


def _sums(key: np.ndarray, *x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sorted distinct keys, sum of each x)."""
    o = np.argsort(key)
    k = key[o]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[start], *(np.add.reduceat(y[o], start) if len(k) else np.zeros(0) for y in x))


class Shard:
    """The discounted shares and what is left to lower orders of the trigrams of a shard."""

    def __init__(self, plan: Plan, path: str, shard: int):
        t = _read(f"{path}/found/kind={GRAMS}/shard={shard}", ["block"])
        parts = [plan.codes.unpack(b.as_py()) for b in t["block"]] if t is not None else []
        columns = [list(x) for x in zip(*parts)] or [[np.zeros(0, np.uint64)]] * 3 + [[np.zeros(0, np.int64)]]
        del parts, t
        u, v, w, c = (np.concatenate(columns.pop(0)) for _ in range(4))  # each column's parts are freed before the next is put together
        less = lambda d, c: np.array([0.0, *d])[np.minimum(c, 3)]
        context, left = combine(u, v), less(plan.d3, c)
        del u
        key, n, g = _sums(context, c.astype(np.float64), left)
        self.two = Lookup(key), g / n
        del key, g
        share = (c - left) / n[self.two[0].find(context)]
        del left, n, c
        key = combine(context, w)
        del context
        o = np.argsort(key)
        share, key = share[o], key[o]
        del o
        self.tri = Lookup(key), share
        del key, share
        at, c, _ = _unique(combine(v, w))
        v, w = v[at], w[at]
        split = plan.hot.find(v) >= 0
        v, w, c = v[~split], w[~split], c[~split]
        for h, n in zip(plan.hot.keys, plan.parts):  # those that have a part here, whether or not it was trained
            parts = combine(np.repeat(mix(np.array([h])), int(n)), np.arange(int(n), dtype=np.uint64))
            t = _read(f"{path}/pairs/t=1/v={h.view(np.int64)}", ["w", "c"]) if (parts % np.uint64(plan.shards) == shard).any() else None
            if t is not None:
                w2 = t["w"].to_numpy().view(np.uint64)
                v, w, c = np.append(v, np.full(len(w2), h)), np.append(w, w2), np.append(c, t["c"].to_numpy())
        left = less(plan.d2, c)
        key, n, g = _sums(v, c.astype(np.float64), left)
        self.one = Lookup(key), g / n
        share, key = (c - left) / n[self.one[0].find(v)], combine(v, w)
        o = np.argsort(key)
        self.bi = Lookup(key[o]), share[o]
        release()

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): the probabilities are a + b times those of the words alone."""

        def take(part: tuple[Lookup, np.ndarray], key: np.ndarray, none: float) -> np.ndarray:
            i = part[0].find(key)
            out = np.full(len(key), none)
            out[i >= 0] = part[1][i[i >= 0]]
            return out

        uv = combine(u, v)
        g = take(self.two, uv, 1.0)  # an unknown context leaves all to the lower order
        return take(self.tri, combine(uv, w), 0.0) + g * take(self.bi, combine(v, w), 0.0), g * take(self.one, v, 1.0)


def scores(docs: DataFrame, model: tuple[Plan, str], rounds: int = ROUNDS, most: int = 1 << 20, most_at_once: int = 1 << 18) -> DataFrame:
    """(_id, _lang, n_tokens, perplexity, toxicity) of rows (_id, _lang, _text), written.

    Their trigrams are packed by about `most` and looked up by about
    most_at_once, in rounds by hash of the id.
    """
    (plan, path), spark, out = model, docs.sparkSession, folder(docs.sparkSession)
    ids = [("_id", docs.schema["_id"].dataType), ("_lang", docs.schema["_lang"].dataType)]
    blocks = StructType().add("shard", IntegerType()).add("block", BinaryType()).add("_row", LongType()).add("n", LongType())
    sums = StructType().add("kind", IntegerType()).add("_row", LongType()).add("n", LongType()).add("w", LongType()).add("x", DoubleType()).add("y", DoubleType())
    final = StructType()
    for name, kind in ids:
        blocks, sums, final = blocks.add(name, kind), sums.add(name, kind), final.add(name, kind)
    final = final.add("n_tokens", LongType()).add("perplexity", DoubleType()).add("toxicity", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0

        def packed() -> pa.RecordBatch:
            s, x = _packed(plan, held)
            n = len(s)
            return pa.RecordBatch.from_arrays([s, x, pa.array(np.full(n, base)), pa.nulls(n, pa.int64()), *(pa.nulls(n, t) for t in types)], blocks.names)

        for b in by_bytes(batches, "_text", 1 << 20):
            types, row = (b.column(0).type, b.column(1).type), b.column(3).to_numpy()
            h, first = tokens(*raw(b.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array((row % plan.shards).astype(np.int32)), pa.nulls(b.num_rows, pa.binary()), b.column(3), pa.array(np.diff(first)), b.column(0), b.column(1)], blocks.names)
            g, first = grams(h, first, 3)
            if held and (size + len(g[0]) > most or row[-1] - base >= 1 << 32):
                yield packed()
                held, size = [], 0
            base = base if held else row[0]
            held.append((*g, np.repeat(row - base, np.diff(first))))
            size += len(g[0])
        if held:
            yield packed()
        release()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for b in batches:
            doc = b.filter(b.column(1).is_null())
            types, n = (b.column(4).type, b.column(5).type), doc.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, DOC, np.int32)), doc.column(2), doc.column(3), *[pa.nulls(n, t) for t in (pa.int64(), pa.float64(), pa.float64())], doc.column(4), doc.column(5)], sums.names)
            for s, x, base in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if x.is_valid:
                    held[s].append((x.as_py(), base))

        def rows(kind: int, row: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> pa.RecordBatch:
            n = len(row)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(row), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()) if w is None else pa.array(w.view(np.int64)), pa.array(x), pa.array(y), *(pa.nulls(n, t) for t in types)], sums.names)

        for s in sorted(held):
            shard, todo = Shard(plan, path, s), held.pop(s)
            while todo:
                parts, size = [], 0
                while todo and size < most_at_once:
                    x, base = todo.pop()
                    parts.append(plan.codes.unpack(x))
                    parts[-1] = (*parts[-1][:3], parts[-1][3] + base)
                    size += len(parts[-1][0])
                columns = [list(x) for x in zip(*parts)]
                del parts
                u, v, w, row = (np.concatenate(columns.pop(0)) for _ in range(4))
                a, b = shard.score(u, v, w)
                i = plan.codes.lookup.find(w)
                known = i >= 0
                p, odd = np.full(len(w), plan.unseen), np.full(len(w), NEVER)
                p[known], odd[known] = plan.p1[i[known]], plan.odd[i[known]]
                if not plan.whole:
                    rare = ~known
                    yield rows(RARE, row[rare], a[rare], b[rare], w[rare])
                    a, b, p, odd, row = a[known], b[known], p[known], odd[known], row[known]
                if len(row):
                    o = np.argsort(row, kind="stable")
                    row, lp, odd = row[o], np.log(a + b * p)[o], odd[o]
                    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    yield rows(SUM, row[start], np.add.reduceat(lp, start), np.maximum.reduceat(odd, start))
            del shard
            release()

    single = spark.read.schema("w long, p double, odd double").parquet(f"{path}/single")
    for r in range(rounds):
        at = folder(spark)
        part = docs.where(F.pmod(F.xxhash64("_id"), F.lit(rounds)) == r).select("_id", "_lang", "_text", F.monotonically_increasing_id().alias("_row"))
        part.mapInArrow(run, blocks).repartitionById(plan.shards, "shard").mapInArrow(judge, sums).write.partitionBy("kind").parquet(at)
        let_go(spark)
        each = spark.read.schema(sums).parquet(at)
        total = each.where(F.col("kind") == SUM).select("_row", "x", "y")
        if not plan.whole:
            p = F.log(F.col("x") + F.col("y") * F.coalesce("p", F.lit(plan.unseen)))
            total = total.unionByName(each.where(F.col("kind") == RARE).join(single, "w", "left").select("_row", p.alias("x"), F.coalesce("odd", F.lit(NEVER)).alias("y")))
        total = total.groupBy("_row").agg(F.sum("x").alias("x"), F.max("y").alias("y"))
        some = lambda c: F.when(F.col("n") > 0, c)
        each.where(F.col("kind") == DOC).select("_row", "_id", "_lang", "n").join(total, "_row").select("_id", "_lang", F.col("n").alias("n_tokens"), some(F.exp(-F.col("x") / (F.col("n") + 1))).alias("perplexity"), some(F.col("y")).alias("toxicity")).write.mode("append").parquet(out)
        drop(spark, at)
        let_go(spark)
    return spark.read.schema(final).parquet(out)


def classify(docs: DataFrame, labels: DataFrame, sample: int | None = None, perplexity_q: float = 0.995, toxicity_q: float = 0.99, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_tokens, perplexity, toxicity, keep) of all documents.

    labels has (id_col, quality, toxic). All trusted documents (quality 1,
    toxic 0) of a half chosen by hash of the id train the trusted model, and all
    toxic ones train the toxic model; only where `sample` is given, up to so
    many of each language and class. All documents of the other trusted half set
    the thresholds.
    A document is kept if its perplexity and toxicity are at most the
    quantiles perplexity_q and toxicity_q of its language's threshold documents;
    a language without any, or null, has those of all languages together. An
    id with several languages is labelled text of the least of them. Null or
    empty texts have null scores and aren't kept.
    Without trusted labels there is no model: everything with a token is kept
    and scores are null. Repeated rows are each judged; other columns are
    ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    lab = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = slim.groupBy("_id").agg(F.min("_lang").alias("_lang")).join(lab, "_id")
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.when(F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(2)) == 0, 1).otherwise(2)).when(F.col("toxic") == 1, 0)
    known = written(known.withColumn("_kind", kind).where("_kind is not null").select("_id", "_lang", "_kind"))
    chosen = known.where("_kind < 2")
    if sample is not None:
        w = Window.partitionBy("_lang", "_kind").orderBy(F.xxhash64("_id"), "_id")
        chosen = written(chosen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample))
    chosen = chosen.select("_id", "_kind")
    if not chosen.where("_kind = 1").limit(1).count():
        none = F.lit(None).cast("double")
        return slim.select(F.col("_id").alias(id_col), F.col("_lang").alias(lang_col), F.lit(None).cast("long").alias("n_tokens"), none.alias("perplexity"), none.alias("toxicity"), F.coalesce(F.length(F.trim("_text")) > 0, F.lit(False)).alias("keep"))
    text = written(slim.join(chosen, "_id").select("_text", F.col("_kind").cast("long").alias("_trusted")))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    model = train(text, others=size // 4 // ROUNDS)  # a token has four bytes or more with what is around it
    forget(text)
    scored = scores(slim, model)
    drop(slim.sparkSession, model[1])
    held = scored.join(known.where("_kind = 2").select("_id"), "_id", "left_semi")
    cut = [F.percentile("perplexity", F.lit(perplexity_q)).alias("p"), F.percentile("toxicity", F.lit(toxicity_q)).alias("t")]
    every = held.agg(*cut).first()
    by = {r["_lang"]: (r["p"], r["t"]) for r in held.groupBy("_lang").agg(*cut).collect() if r["_lang"] is not None and r["p"] is not None}
    most_p, most_t = F.lit(every["p"]), F.lit(every["t"])
    for lang, (p, t) in sorted(by.items()):
        most_p, most_t = F.when(F.col("_lang") == lang, F.lit(p)).otherwise(most_p), F.when(F.col("_lang") == lang, F.lit(t)).otherwise(most_t)
    if every["p"] is None:
        most_p, most_t = F.lit(float("inf")), F.lit(float("inf"))
    keep = F.coalesce((F.col("perplexity") <= most_p) & (F.col("toxicity") <= most_t), F.lit(False))
    return scored.select(F.col("_id").alias(id_col), F.col("_lang").alias(lang_col), "n_tokens", "perplexity", "toxicity", keep.alias("keep"))
