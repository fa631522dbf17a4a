"""LM scoring: Katz backoff over words with Good-Turing discounts and exactly normalised backoff weights, by shards.

A token is a case-sensitive word or run of punctuation, by its 64-bit hash, or
the end mark; contexts at the start of a text hold start marks. The occurrences
of the n-grams (u, v, w) of all texts are a table partitioned by their middle
word: a shard has all that a probability needs, from the trigram's count down
to the backoff weight of v, and asks only for the probabilities of single words.
Middle words of more occurrences than a task should hold are split by u; the
counts of their bigrams are merged in between and given back to the shards that
have them. Everything grows with the corpus; a task holds one shard.

Occurrences travel and are kept packed: frequent words as two-byte codes of a
table of fixed size, the others by their hash, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from .kernel import Lookup, by_bytes, combine, mix, raw, release, tokens
from .shared import drop, folder, let_go

CODES = (1 << 16) - 1
#: Occurrences of a shard that are looked at together.
BLOCK = 1 << 19
_EDGE = np.uint64(0x1234567)


def grams(h: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(words, first): the n-gram that ends at each token and at each end mark, as one array for each of its places."""
    rows, lead = len(first) - 1, order - 1
    seq = np.full(len(h) + order * rows, _EDGE, np.uint64)
    seq[np.arange(len(h)) + order * np.repeat(np.arange(rows), np.diff(first)) + lead] = h
    real = np.ones(len(seq), bool)
    for k in range(lead):
        real[(first + order * np.arange(rows + 1))[:-1] + k] = False
    at = np.flatnonzero(real)
    return [seq[at - lead + k] for k in range(order)], first + np.arange(rows + 1)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers, all first bytes ahead: they compress better so."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(b: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(-1, n).T).view(kind).reshape(-1) if n else np.zeros(0, kind)


class Codes:
    """Two-byte codes of words, 0 for those that have none."""

    def __init__(self, words: np.ndarray):
        self.lookup = Lookup(np.sort(words))

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, words without one)."""
        c = (self.lookup.find(x) + 1).astype(np.uint16)
        return c, x[c == 0]

    def join(self, c: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.empty(len(c), np.uint64)
        has = c > 0
        out[has] = self.lookup.keys[c[has] - 1]
        out[~has] = rest
        return out

    def pack(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray) -> bytes:
        """Occurrences of n-grams as bytes; their order isn't kept."""
        import zstandard

        (uc, _), (wc, _) = self.split(u), self.split(w)
        o = np.lexsort((wc, uc, v))
        u, v, w, uc, wc, doc = u[o], v[o], w[o], uc[o], wc[o], doc[o].astype(np.uint32)
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])[: len(v)])
        vc, ve = self.split(v[start])
        step = np.diff(uc, prepend=np.uint16(0))
        parts = [_planes(vc), ve.tobytes(), _planes(np.diff(np.append(start, len(v))).astype(np.uint32)), _planes(step), u[uc == 0].tobytes(), _planes(wc), w[wc == 0].tobytes(), _planes(doc)]
        head = np.array([len(start), len(v), *map(len, parts)], np.int64).tobytes()
        return zstandard.compress(head + b"".join(parts), 3)

    def unpack(self, block: bytes) -> tuple[np.ndarray, ...]:
        """(u, v, w, doc)"""
        import zstandard

        data = zstandard.decompress(block)
        nv, n, *size = np.frombuffer(data, np.int64, 10)
        at = np.concatenate([[80], 80 + np.cumsum(size)])
        p = [data[a:b] for a, b in zip(at[:-1], at[1:])]
        v = np.repeat(self.join(_numbers(p[0], np.uint16, nv), np.frombuffer(p[1], np.uint64)), _numbers(p[2], np.uint32, nv))
        uc, wc = np.cumsum(_numbers(p[3], np.uint16, n), dtype=np.uint16), _numbers(p[5], np.uint16, n)
        return self.join(uc, np.frombuffer(p[4], np.uint64)), v, self.join(wc, np.frombuffer(p[6], np.uint64)), _numbers(p[7], np.uint32, n).astype(np.int64)


class Plan:
    """What all tasks share: the order, the words with codes and their probabilities, the words whose shards are split, the discounts. Of fixed size but for the split words, which are as many as tasks fill a shard each."""

    def __init__(self, order: int, shards: int, common: np.ndarray, hot: dict[int, int]):
        self.order, self.shards, self.codes = order, shards, Codes(common)
        self.hot = Lookup(np.sort(np.array(list(hot), np.int64).view(np.uint64)))
        self.parts = np.array([hot[int(np.uint64(k).view(np.int64))] for k in self.hot.keys], np.uint64)
        self.discount: dict[int, dict[int, float]] = {}
        self.p1 = np.zeros(len(self.codes.lookup.keys))
        self.scale1 = self.alpha0 = self.unseen = self.once = 1.0

    def shard(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (self.spread(u, v) % np.uint64(self.shards)).astype(np.int32)

    def block(self, u: np.ndarray, v: np.ndarray, blocks: int) -> np.ndarray:
        """The block of a shard that n-grams are in; what a probability needs is in one block."""
        return (self.spread(u, v) // np.uint64(self.shards) % np.uint64(blocks)).astype(np.int32)

    def spread(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Hashes by middle word, and by part where that is split."""
        h = mix(v)
        i = self.hot.find(v)
        at = np.flatnonzero(i >= 0)
        h[at] = combine(h[at], mix(u[at]) % self.parts[i[at]])
        return h

    def ratio(self, k: int, c: np.ndarray) -> np.ndarray:
        """Discount ratios of counts of order k."""
        table = np.ones(7)
        for r, d in self.discount[k].items():
            table[r] = d
        return table[np.minimum(c, 6)]


def occurrences(docs: DataFrame, plan: Plan, path: str, rounds: int = 2, most: int = 1 << 20) -> None:
    """Writes the packed occurrences of rows (_id, _text) by shard, and with negative shards (_id, _row).

    In rounds by hash of the id, so that what is shuffled at a time is a part
    of it. Rows are numbered; a block's occurrences count theirs from its first.
    """
    kind = docs.schema["_id"].dataType
    schema = StructType().add("shard", IntegerType()).add("block", BinaryType()).add("_id", kind).add("_row", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, None

        def blocks() -> Iterator[pa.RecordBatch]:
            u, v, w, doc = (np.concatenate(x) for x in zip(*held))
            s = plan.shard(u, v)
            o = np.argsort(s, kind="stable")
            at = np.concatenate([[0], np.flatnonzero(np.diff(s[o])) + 1, [len(o)]])
            for i, j in zip(at[:-1], at[1:]):
                p = o[i:j]
                yield pa.RecordBatch.from_arrays([pa.array([s[p[0]]], pa.int32()), pa.array([plan.codes.pack(u[p], v[p], w[p], doc[p] - base)]), pa.nulls(1, id_type), pa.array([base])], schema.names)

        for b in by_bytes(batches, "_text", 1 << 20):
            id_type = b.column(0).type
            g, first = grams(*tokens(*raw(b.column(1))), plan.order)
            rows = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((-1 - rows % plan.shards).astype(np.int32)), pa.nulls(b.num_rows, pa.binary()), b.column(0), b.column(2)], schema.names)
            g = [np.zeros(len(g[0]), np.uint64)] * (3 - plan.order) + g
            if base is not None and (size + len(g[2]) > most or rows[-1] - base >= 1 << 32):
                yield from blocks()
                held, size, base = [], 0, None
            base = rows[0] if base is None else base
            held.append((*g, np.repeat(rows, np.diff(first))))
            size += len(g[2])
        if held:
            yield from blocks()
        release()

    for r in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("_id"), F.lit(rounds)) == r).select("_id", "_text", F.monotonically_increasing_id().alias("_row"))
        # numbers of different rounds must differ, those of a block be near: the round is the lowest digit of the partition's number
        part = part.withColumn("_row", F.shiftleft(F.shiftright("_row", 33) * rounds + r, 33) + F.col("_row").bitwiseAND((1 << 33) - 1))
        part.mapInArrow(run, schema).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)
        let_go(docs.sparkSession)


def _read(path: str, columns: list[str]) -> pa.Table | None:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    return pq.read_table(at, filesystem=system, partitioning=None, columns=columns)


def _occurrences(plan: Plan, path: str, shard: int) -> tuple[np.ndarray, ...]:
    """(u, v, w, row) of a shard."""
    t = _read(f"{path}/shard={shard}", ["block", "_row"])
    parts = [(*(x := plan.codes.unpack(b.as_py()))[:3], x[3] + base.as_py()) for b, base in zip(t["block"], t["_row"])] if t is not None else []
    if not parts:
        return (*[np.zeros(0, np.uint64)] * 3, np.zeros(0, np.int64))
    columns = [list(x) for x in zip(*parts)]
    del parts, t
    out = []
    while columns:  # each column's parts are freed before the next is put together
        out.append(np.concatenate(columns.pop(0)))
    return tuple(out)


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each value, by value; how many it has; the sorted values)."""
    o = np.argsort(key)
    k = key[o]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return o[new], np.diff(np.append(new, len(k))), k[new]


class Shard:
    """The probabilities and weights of the n-grams of a shard or of a block of it; given are those that it asked for."""

    def __init__(self, plan: Plan, given: pa.Table | None, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.plan = plan
        one = lambda c: given[c].to_numpy() if given is not None else np.zeros(0, np.int64)
        gv, gw, gp = one("v").view(np.uint64), one("w").view(np.uint64), one("p").astype(np.float64)
        word = gv == 0
        o = np.argsort(gw[word])
        self.rare = Lookup(gw[word][o]), gp[word][o]
        pair = combine(gv[~word], gw[~word])
        o = np.argsort(pair)
        hot = Lookup(pair[o]), gp[~word][o]
        if plan.order < 2:
            return
        # bigrams
        at, c, key = _unique(combine(v, w))
        bv, low = v[at], self.single(w[at])
        self.bi = Lookup(key)
        o = np.argsort(bv, kind="stable")
        p, alpha, start = self.level(2, bv[o], c[o], low[o])
        self.p2 = np.empty(len(key))
        self.p2[o] = p
        i = hot[0].find(key)
        self.p2[i >= 0] = hot[1][i[i >= 0]]
        self.one = Lookup(bv[o][start]), alpha  # those of split words aren't asked for
        del at, c, bv, low, o, p, i, pair, hot, given, gv, gw, gp, word
        if plan.order < 3:
            return
        context = combine(u, v)
        at, c, key = _unique(combine(context, w))
        context = context[at]
        o = np.argsort(context, kind="stable")
        context = context[o]
        p, alpha, start = self.level(3, context, c[o], self.p2[self.bi.find(combine(v[at], w[at]))][o])
        self.two = Lookup(context[start]), alpha
        del context, at, c, start
        self.tri = Lookup(key)
        self.p3 = np.empty(len(key))
        self.p3[o] = p

    def level(self, k: int, context: np.ndarray, c: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each n-gram, backoff weight of each context, where contexts start) of n-grams in the order of their contexts; low are the probabilities one order down."""
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        if not len(start):
            return np.zeros(0), np.zeros(0), start
        d = self.plan.ratio(k, c)
        n, dn, q, least = (f.reduceat(x, start) for f, x in ((np.add, c.astype(np.float64)), (np.add, d * c), (np.add, low), (np.minimum, d)))
        scale = np.where(least == 1.0, n / (n + 1), 1.0)  # where nothing is discounted, one unit of count is left over
        size = np.diff(np.append(start, len(context)))
        return np.repeat(scale / n, size) * d * c, (1 - scale * dn / n) / np.maximum(1 - q, 1e-12), start

    def single(self, w: np.ndarray) -> np.ndarray:
        """Probabilities of words that the shard has; it wasn't given those of words seen once, which are all alike."""
        i = self.plan.codes.lookup.find(w)
        j = self.rare[0].find(w)
        return np.where(i >= 0, self.plan.p1[i] if len(self.plan.p1) else 0.0, np.where(j >= 0, self.rare[1][j] if len(self.rare[1]) else 0.0, self.plan.once))

    def log_p(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log weight or probability, what is still to be multiplied with it: 0 nothing, 1 the word's own probability, 2 that of the bigram, as its split word has it in other shards too)."""
        y, open_ = np.zeros(len(w)), np.ones(len(w), np.int8)

        def take(at: np.ndarray, look: Lookup, p: np.ndarray, key: np.ndarray) -> np.ndarray:
            i = look.find(key)
            y[at[i >= 0]] += np.log(p[i[i >= 0]])
            return i >= 0

        every = np.arange(len(w))
        if self.plan.order == 3:
            context = combine(u, v)
            open_[take(every, self.tri, self.p3, combine(context, w))] = 0
            at = every[open_ > 0]
            take(at, *self.two, context[at])  # an unknown context weighs 1
        if self.plan.order >= 2:
            at = every[open_ > 0]
            open_[at[take(at, self.bi, self.p2, combine(v[at], w[at]))]] = 0
            at = every[open_ > 0]
            split = self.plan.hot.find(v[at]) >= 0
            open_[at[split]] = 2
            take(at[~split], *self.one, v[at[~split]])
        return y, open_


def _each(spark: SparkSession, shards: int, run, schema) -> DataFrame:
    """run(shard) → batches, a task for each shard."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                yield from run(s)
                release()

    return spark.range(0, shards, 1, shards).mapInArrow(every, schema)


def ratios(n: dict[int, int], k: int = 5) -> dict[int, float]:
    """Discount ratios of counts 1 to k from counts of counts; none where these don't give one in (0, 1)."""
    out = {}
    top = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        if n.get(r) and n.get(r + 1) and top < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)
            if 0 < d < 1:
                out[r] = d
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(w, c): counts of words and the end mark of rows (_text), counted in each batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text"):
            g, _ = grams(*tokens(*raw(b.column(0))), 1)
            k, n = np.unique(g[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["w", "c"])

    return docs.select("_text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, order: int = 3, shard_grams: int = 1_500_000, rounds: int = 2) -> tuple[Plan, str]:
    """The model of all rows (_id, _text), of order 1 to 3: what tasks share, and the folder of its tables.

    shard_grams is how many occurrences a task should hold; a middle word of
    more is split. What is shuffled goes in `rounds` parts, one after the other.
    The vocabulary is all words of the rows, the end mark, and one symbol for
    whatever else. Where no count of a context is discounted, one
    unit of count is left to what it hasn't been followed by, so every backoff
    weight is positive; the probabilities of each context sum to one exactly.
    """
    spark, path = docs.sparkSession, folder(docs.sparkSession)

    def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    words = kept(vocabulary(docs), "words")
    total, n_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("c"), "w").limit(CODES).collect()  # a table of fixed size
    # how often a word is in the middle is near its count; start marks are before every text
    starts = sum(r["c"] for r in words.where(F.col("w") == int(_EDGE)).collect())
    hot = {r["w"]: -(-2 * r["c"] // shard_grams) for r in words.where(F.col("c") > shard_grams // 2).collect() if r["w"] != int(_EDGE)}  # at most total / shard_grams * 2
    if starts > shard_grams // 2:
        hot[int(_EDGE)] = -(-2 * starts // shard_grams)
    plan = Plan(order, max(1, -(-total // shard_grams)), np.array([r["w"] for r in top], np.int64).view(np.uint64), hot if order > 2 else {})
    occurrences(docs, plan, f"{path}/seen", rounds)

    def count(s: int) -> Iterator[pa.RecordBatch]:
        u, v, w, _ = _occurrences(plan, f"{path}/seen", s)
        out = []

        def row(kind: int, v_: np.ndarray, w_: np.ndarray, c: np.ndarray) -> None:
            n = len(c)
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, s, np.int32)), pa.array(v_.view(np.int64)), pa.array(w_.view(np.int64)), pa.array(c.astype(np.int64))], ["kind", "shard", "v", "w", "c"]))

        def histogram(kind: int, c: np.ndarray) -> None:
            n = np.bincount(np.minimum(c, 7), minlength=8)[1:7]
            row(kind, np.arange(1, 7), np.zeros(6, np.int64), n)

        if plan.order >= 3:
            histogram(3, _unique(combine(combine(u, v), w))[1])
        if plan.order >= 2:
            at, c, _ = _unique(combine(v, w))
            split = plan.hot.find(v[at]) >= 0
            histogram(2, c[~split])
            row(0, v[at[split]], w[at[split]], c[split])
        rare = np.unique(w)
        rare = rare[plan.codes.lookup.find(rare) < 0]
        row(1, np.zeros(len(rare), np.uint64), rare, np.zeros(len(rare), np.int64))
        yield from out

    found = kept(_each(spark, plan.shards, count, "kind int, shard int, v long, w long, c long"), "found", "kind")
    pairs = kept(found.where("kind = 0").groupBy("v", "w").agg(F.sum("c").alias("c")), "pairs")
    hist = {k: {} for k in (1, 2, 3)}
    for r in found.where("kind >= 2").groupBy("kind", "v").agg(F.sum("c").alias("c")).collect():
        hist[r["kind"]][r["v"]] = r["c"]
    for k, df in ((1, words), (2, pairs)):
        for r in df.where("c <= 6").groupBy("c").count().collect():
            hist[k][r["c"]] = hist[k].get(r["c"], 0) + r["count"]
    plan.discount = {k: ratios(n) for k, n in hist.items()}

    def less(k: int):
        d = F.lit(1.0)
        for r, x in plan.discount[k].items():
            d = F.when(F.col("c") == r, F.lit(x)).otherwise(d)
        return d

    h = words.agg(F.sum(F.col("c") * less(1)).alias("dn"), F.min(less(1)).alias("nd")).first()
    plan.unseen = 1.0 / (n_words + 1)
    if total:
        plan.scale1 = total / (total + 1) if h["nd"] == 1.0 else 1.0
        plan.alpha0 = (1 - plan.scale1 * h["dn"] / total) / max(1 - n_words * plan.unseen, 1e-12)
    p1 = words.select("w", (F.lit(plan.scale1 / max(total, 1)) * less(1) * F.col("c")).alias("p"))
    kept(p1, "single")
    plan.once = plan.scale1 / max(total, 1) * float(plan.ratio(1, np.array([1]))[0])
    by = np.array([r["w"] for r in top], np.int64).view(np.uint64)
    c = np.array([r["c"] for r in top], np.int64)
    order_ = np.argsort(by)
    plan.p1 = (plan.scale1 / max(total, 1) * plan.ratio(1, c) * c)[order_]
    # split words: their bigrams' probabilities for the shards that have them
    x = pairs.withColumn("d", less(2)).join(p1, "w")
    ctx = x.groupBy("v").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("d")).alias("dn"), F.sum("p").alias("q"), F.min("d").alias("nd"))
    scale = F.when(F.col("nd") == 1.0, F.col("n") / (F.col("n") + 1)).otherwise(F.lit(1.0))
    ctx = kept(ctx.select("v", "n", scale.alias("scale"), ((1 - scale * F.col("dn") / F.col("n")) / F.greatest(1 - F.col("q"), F.lit(1e-12))).alias("alpha")), "split")
    p2 = kept(pairs.join(ctx, "v").select("v", "w", (F.col("scale") * less(2) * F.col("c") / F.col("n")).alias("p")), "pair")
    let_go(spark)
    some = words.where("c > 1").select("w", (F.lit(plan.scale1 / max(total, 1)) * less(1) * F.col("c")).alias("p"))
    for r in range(rounds):  # so that what is shuffled at a time is a part of it
        own = lambda df: df.where(F.pmod(F.xxhash64("w"), F.lit(rounds)) == r)  # noqa: B023, E731
        answers = own(found.where("kind = 0")).select("shard", "v", "w").join(own(p2), ["v", "w"]).select("shard", "v", "w", "p")
        answers = answers.unionByName(own(found.where("kind = 1")).select("shard", F.lit(0).cast("long").alias("v"), "w").join(own(some), "w").select("shard", "v", "w", "p"))
        answers.repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{path}/given")
        let_go(spark)
    for name in ("found", "pairs", "words"):
        drop(spark, f"{path}/{name}")
    let_go(spark)
    return plan, path


def score(docs: DataFrame, model: tuple[Plan, str], id_col: str = "doc_id", text_col: str = "text", seen: str | None = None) -> DataFrame:
    """(id, n_tokens, log_prob, perplexity) of all rows under the model; seen is where their occurrences are already, if they are.

    Null or empty texts have the end mark alone as their token. Repeated rows
    are each scored; other columns are ignored.
    """
    plan, path = model
    spark, names, own = docs.sparkSession, ["_row", "s", "n", "v", "w"], f"{path}/seen"
    if seen is None:
        seen = folder(spark)
        occurrences(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), plan, seen)

    def judge(s: int) -> Iterator[pa.RecordBatch]:
        u, v, w, row = _occurrences(plan, seen, s)
        if not len(w):
            return
        known = (u, v, w) if seen == own else _occurrences(plan, own, s)[:3]
        given = _read(f"{path}/given/shard={s}", ["v", "w", "p"])
        y, open_ = np.zeros(len(w)), np.zeros(len(w), np.int8)
        blocks = max(1, -(-len(known[2]) // BLOCK))
        of, of_known = plan.block(u, v, blocks), plan.block(*known[:2], blocks)
        for k in range(blocks):
            at = np.flatnonzero(of == k)
            if len(at):
                x = np.flatnonzero(of_known == k)
                y[at], open_[at] = Shard(plan, given, *(c[x] for c in known)).log_p(u[at], v[at], w[at])
        left = np.flatnonzero(open_)
        more = pa.RecordBatch.from_arrays([pa.array(row[left]), pa.array(np.zeros(len(left))), pa.array(np.zeros(len(left), np.int64)), pa.array(v[left].view(np.int64), mask=open_[left] < 2), pa.array(w[left].view(np.int64))], names)
        del u, v, w, known, of, of_known, open_
        o = np.argsort(row, kind="stable")
        row, y = row[o], y[o]
        del o
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        n = len(start)
        yield pa.RecordBatch.from_arrays([pa.array(row[start]), pa.array(np.add.reduceat(y, start)), pa.array(np.diff(np.append(start, len(row)))), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        if len(left):
            yield more

    sums, schema = folder(spark), "_row long, s double, n long, v long, w long"
    _each(spark, plan.shards, judge, schema).write.parquet(sums)
    each = spark.read.schema(schema).parquet(sums)
    single = spark.read.schema("w long, p double").parquet(f"{path}/single")
    pair = spark.read.schema("v long, w long, p double").parquet(f"{path}/pair").withColumnRenamed("p", "p2")
    weight = spark.read.schema("v long, alpha double").parquet(f"{path}/split")
    far = each.where("w IS NOT NULL").groupBy("_row", "v", "w").agg(F.count("*").alias("k")).join(single, "w", "left").join(pair, ["v", "w"], "left").join(weight, "v", "left")
    p = F.coalesce("p2", F.coalesce("alpha", F.lit(1.0)) * F.coalesce("p", F.lit(plan.alpha0 * plan.unseen)))
    far = far.select("_row", (F.col("k") * F.log(p)).alias("s"), F.lit(0).cast("long").alias("n"))
    total = each.where("w IS NULL").select("_row", "s", "n").unionByName(far).groupBy("_row").agg(F.sum("n").alias("n_tokens"), F.sum("s").alias("log_prob"))
    schema = StructType().add("shard", IntegerType()).add("_id", docs.schema[id_col].dataType).add("_row", LongType())
    ids = spark.read.schema(schema).parquet(seen).where("shard < 0").select("_id", "_row")
    return ids.join(total, "_row").select(F.col("_id").alias(id_col), "n_tokens", "log_prob", F.exp(-F.col("log_prob") / F.col("n_tokens")).alias("perplexity"))


def word_katz(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", shard_grams: int = 1_500_000) -> DataFrame:
    """score() of all documents under the model of all documents, whose occurrences are gathered once; an empty table gives an empty result."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    model = train(slim, order, shard_grams)
    return score(docs, model, id_col, text_col, f"{model[1]}/seen")
