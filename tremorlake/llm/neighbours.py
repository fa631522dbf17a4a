"""Approximate nearest neighbours: NN-descent by iterative joins of neighbours of neighbours, then greedy graph search.

Vectors travel normalised, as 32-bit floats, which order near-copies too; the
similarities of a result are computed from the vectors as given.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .kernel import combine, mix
from .shared import forget, let_go, written


def _block(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have `width` 32-bit floats."""
    if not len(column):
        return np.zeros((0, width), np.float32)
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float32, offs[-1] // 4)[offs[0] // 4 :].reshape(len(column), -1)


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], column: int = 0, rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by an integer column, cut only between its values."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = t.column(column).to_numpy(zero_copy_only=False)
        cut = int(_runs(key)[-2])
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
        held, size = [rest], rest.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(n, id, x, v) of the rows with an id and a finite, non-zero vector of length dim, numbered by n: x as given, v normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            y = (x[ok] / norm[ok, None]).astype(np.float32)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(keep) for i in range(3)), pa.array([r.tobytes() for r in y], pa.binary())], ["n", "id", "x", "v"])

    slim = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & (F.size("x") == dim) & ~F.exists("x", lambda y: y.isNull()))
    one = slim.groupBy("id").agg(F.min("x").alias("x")).select(F.monotonically_increasing_id().alias("n"), "id", "x")
    return one.mapInArrow(run, f"n long, id {df.schema[id_col].dataType.simpleString()}, x array<double>, v binary")


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows (u, v, s) the k of largest s of each u, each v once; sorted by u, then falling s, then v. Of equal rows the first given stays."""
    o = np.lexsort((np.arange(len(u)), v, -s, u))
    u, v, s = u[o], v[o], s[o]
    pair = np.lexsort((np.arange(len(u)), v, u))
    first = np.ones(len(u), bool)
    a, b = u[pair], v[pair]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first[pair[1:][same]] = False
    o, u, v, s = o[first], u[first], v[first], s[first]
    start = _runs(u)
    rank = np.arange(len(u)) - np.repeat(start[:-1], np.diff(start)) if len(u) else np.zeros(0, np.int64)
    keep = rank < k
    return (u[keep], v[keep], s[keep], *(m[o][keep] for m in more))


class _Pool:
    """Candidates (u, v, s) of a task, cut to the best k of each u now and then; full when even so they are many."""

    def __init__(self, k: int, most: int = 1 << 18):
        self.k, self.most, self.parts, self.size = k, most, [], 0

    def add(self, u: np.ndarray, v: np.ndarray, s: np.ndarray) -> bool:
        """Whether rows() should be taken now."""
        if len(u):
            self.parts.append((u, v, s.astype(np.float32)))
            self.size += len(u)
            if self.size > self.most:
                self.cut()
        return self.size > self.most // 2 and len(self.parts) == 1

    def cut(self) -> None:
        if self.parts:
            best = _best(*(np.concatenate(x) for x in zip(*self.parts)), self.k)
            self.parts, self.size = [best], len(best[0])

    def rows(self) -> pa.RecordBatch:
        self.cut()
        u, v, s = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s.astype(np.float32))], ["u", "v", "s"])


def first_graph(vec: DataFrame, n: int, k: int, dim: int, tables: int = 6, leaf: int = 256) -> DataFrame:
    """(u, v, s) to start from: each vector's best k in a leaf of each of `tables` random hyperplane partitions and one random one."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _block(b.column(1), dim)
            noise = mix(ids.view(np.uint64)) % np.uint64(max(1, -(-n // leaf)))
            for t in range(tables + 1):
                plane = np.random.default_rng(t).standard_normal((dim, bits))
                code = ((x @ plane > 0) @ (1 << np.arange(bits))).astype(np.int64) if t < tables else noise.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code + (np.int64(t) << 48)), b.column(0), b.column(1)], ["w", "id", "v"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(k)
        for b in _groups(batches):
            w, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _block(b.column(2), dim)
            at = _runs(w)
            for i, j in zip(at[:-1], at[1:]):
                for a in range(i, j, 2 * leaf):  # a crowded leaf is taken in parts
                    e = min(j, a + 2 * leaf)
                    if e - a < 2:
                        continue
                    s = x[a:e] @ x[a:e].T
                    np.fill_diagonal(s, -9)
                    m = min(k, e - a - 1)
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    if pool.add(np.repeat(ids[a:e], m), ids[a:e][top].reshape(-1), np.take_along_axis(s, top, 1).reshape(-1)):
                        yield pool.rows()
        yield pool.rows()

    placed = vec.mapInArrow(spread, "w long, id long, v binary").repartition("w").sortWithinPartitions("w", F.xxhash64("w", "id"))
    return placed.mapInArrow(local, "u long, v long, s float")


def _merge(rows: DataFrame, k: int) -> DataFrame:
    """One row (u, ids, sims, fresh) for each u of rows (u, v, s, fresh): its best k, where of one v the row that isn't fresh counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            u, v, s, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            o = np.argsort(f, kind="stable")
            # rows of one pair have one similarity but for rounding; the old row's counts
            u, v, s, f = u[o], v[o], s[o], f[o]
            pair = np.lexsort((f, v, u))
            keep = np.ones(len(u), bool)
            keep[1:] = (u[pair][1:] != u[pair][:-1]) | (v[pair][1:] != v[pair][:-1])
            p = pair[keep]
            u, v, s, f = _best(u[p], v[p], s[p], k, f[p])
            at = _runs(u)
            off = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (v, s.astype(np.float32), f.astype(bool))]
            yield pa.RecordBatch.from_arrays([pa.array(u[at[:-1]]), *lists], ["u", "ids", "sims", "fresh"])

    return rows.repartition("u").sortWithinPartitions("u").mapInArrow(run, "u long, ids array<long>, sims array<float>, fresh array<boolean>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = np.diff(b.column(1).offsets.to_numpy())
    return (np.repeat(b.column(0).to_numpy(), n), *(b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3)))


def _drawn(u: np.ndarray, v: np.ndarray, f: np.ndarray, step: int, most: int) -> np.ndarray:
    """The up to `most` fresh and `most` other rows of each u that are drawn in this step."""
    p = combine(combine(u.view(np.uint64), v.view(np.uint64)), np.full(len(u), step, np.uint64))
    o = np.lexsort((p, f, u))
    at = _runs(u[o].astype(np.int64) * 2 + f[o])
    rank = np.arange(len(u)) - np.repeat(at[:-1], np.diff(at))
    out = np.zeros(len(u), bool)
    out[o[rank < most]] = True
    return out


def descend(vec: DataFrame, k: int = 32, sample: int = 12, delta: float = 0.01, dim: int | None = None, told: Callable[[str], None] = lambda _: None) -> DataFrame:
    """(u, ids, sims, fresh): the graph of each vector's k nearest found, by falling similarity.

    In every step each vertex draws up to `sample` fresh and as many other
    edges, those that end in it are drawn likewise, and what they lead to is
    compared with each other where one side is fresh. It ends when less than
    delta of the edges are new; as a list only ever gets nearer, it does end.
    """
    n = vec.count()
    graph = written(_merge(first_graph(vec, n, k, dim).select("u", "v", "s", F.lit(True).alias("fresh")), k))
    for step in itertools.count():

        def edges(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u, v, _, f = _flat(b)
                d = _drawn(u, v, f, step, sample)
                u, v, f = u[d], v[d], f[d]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v])), pa.array(np.concatenate([v, u])), pa.array(np.concatenate([f, f])), pa.array(np.repeat([False, True], len(u)))], ["w", "a", "f", "back"])

        def thin(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            for b in _groups(batches):
                w, a, f, back = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                d = ~back
                r = np.flatnonzero(back)
                d[r[_drawn(w[r], a[r], f[r], step, sample)]] = True
                w, a, f = w[d], a[d], f[d]
                o = np.lexsort((~f, a, w))
                w, a, f = w[o], a[o], f[o]
                new = np.concatenate([[True], (w[1:] != w[:-1]) | (a[1:] != a[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(w[new]), pa.array(a[new]), pa.array(f[new])], ["w", "a", "f"])

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pool = _Pool(k)
            for b in _groups(batches, rows=20_000):
                w, a = b.column(0).to_numpy(), b.column(1).to_numpy()
                f, low, x = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), _block(b.column(4), dim)
                at = _runs(w)
                for i, j in zip(at[:-1], at[1:]):
                    if not f[i:j].any():
                        continue
                    s = x[i:j] @ x[i:j].T
                    ok = (s > low[i:j, None]) & (f[i:j, None] | f[None, i:j])
                    np.fill_diagonal(ok, False)
                    r, c = np.nonzero(ok)
                    if pool.add(a[i:j][r], a[i:j][c], s[r, c]):
                        yield pool.rows()
            yield pool.rows()

        def old(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u, v, s, f = _flat(b)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(f & ~_drawn(u, v, f, step, sample))], ["u", "v", "s", "fresh"])

        # a vertex takes no more than its k-th similarity; an unfilled one takes all
        low = graph.select(F.col("u").alias("a"), F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float").alias("low"))
        member = low.join(vec, F.col("a") == F.col("id")).select("a", "low", "v")
        drawn = graph.mapInArrow(edges, "w long, a long, f boolean, back boolean").repartition("w").sortWithinPartitions("w").mapInArrow(thin, "w long, a long, f boolean")
        met = drawn.join(member, "a").select("w", "a", "f", "low", "v").repartition("w").sortWithinPartitions("w").mapInArrow(local, "u long, v long, s float")
        kept = graph.mapInArrow(old, "u long, v long, s float, fresh boolean")
        before, graph = graph, written(_merge(kept.unionByName(met.withColumn("fresh", F.lit(True))), k))
        forget(before)
        let_go(graph.sparkSession)
        fresh, every = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("ids"))).first()
        told(f"step {step}: {fresh} of {every} edges are fresh")
        if not every or fresh < delta * every:
            break
    return graph


def enter(vec: DataFrame, queries: DataFrame, dim: int, ef: int, entries: int) -> DataFrame:
    """(q, ids, sims, fresh) to start from: of up to `entries` vertices, drawn by hash, the ef nearest to each query (q, own, v)."""
    drawn = vec.orderBy(F.xxhash64("id"), "id").limit(entries).collect()  # a fixed number of vectors
    ids = np.array([r["id"] for r in drawn], np.int64)
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in drawn]) if drawn else np.zeros((0, dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                own = part.column(1).to_numpy()
                s = _block(part.column(2), dim) @ x.T
                s[ids[None, :] == own[:, None]] = -9
                m = min(ef, s.shape[1])
                top = np.argsort(-s, axis=1, kind="stable")[:, :m]
                sims = np.take_along_axis(s, top, 1)
                ok = sims > -9
                offs = pa.array(np.concatenate([[0], np.cumsum(ok.sum(axis=1))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offs, pa.array(y[ok])) for y in (ids[top], sims.astype(np.float32), np.ones(ok.shape, bool))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["q", "ids", "sims", "fresh"])

    return queries.select("q", "own", "v").mapInArrow(run, "q long, ids array<long>, sims array<float>, fresh array<boolean>")


def search(vec: DataFrame, graph: DataFrame, queries: DataFrame, dim: int, ef: int = 192, expand: int = 24, entries: int = 2048, told: Callable[[str], None] = lambda _: None) -> DataFrame:
    """(q, ids, sims, fresh): greedy search of the graph for every query (q, own, v), own being a vertex to leave out.

    In each step the best `expand` vertices of a beam that haven't been visited
    are: what their lists lead to is compared with the query, and the best ef
    stay. It ends when every vertex of every beam has been visited. What moves
    is one vector for each vertex that a query meets in a step.
    """
    near = graph.select("u", "ids")
    beam = written(enter(vec, queries, dim, ef, entries))
    for step in itertools.count():

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, v, s, f = _flat(b)
                n = np.diff(b.column(1).offsets.to_numpy())
                last = np.cumsum(n) - 1
                bound = np.where(n >= ef, s[np.maximum(last, 0)] if len(s) else 0, -2.0).astype(np.float32)
                r = _next(q, f, expand)
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(v[r]), pa.array(bound[np.repeat(np.arange(b.num_rows), n)[r]])], ["q", "u", "low"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pool = _Pool(ef)
            for batch in batches:
                for at in range(0, batch.num_rows, 20_000):
                    b = batch.slice(at, 20_000)
                    q, v, low, own = (b.column(i).to_numpy() for i in range(4))
                    s = np.einsum("ij,ij->i", _block(b.column(4), dim), _block(b.column(5), dim))
                    ok = (s > low) & (v != own)
                    if pool.add(q[ok], v[ok], s[ok]):
                        yield pool.rows()
            yield pool.rows()

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, v, s, f = _flat(b)
                f = f.copy()
                f[_next(q, f, expand)] = False
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(f)], ["u", "v", "s", "fresh"])

        met = beam.mapInArrow(visit, "q long, u long, low float").join(near, "u").select("q", F.explode("ids").alias("v"), "low").groupBy("q", "v").agg(F.max("low").alias("low"))
        pairs = met.join(vec.select(F.col("id").alias("v"), F.col("v").alias("x")), "v").join(queries.select("q", "own", F.col("v").alias("y")), "q")
        found = pairs.select("q", "v", "low", "own", "x", "y").mapInArrow(compare, "u long, v long, s float")
        marked = beam.mapInArrow(mark, "u long, v long, s float, fresh boolean")
        before, beam = beam, written(_merge(marked.unionByName(found.withColumn("fresh", F.lit(True))), ef).withColumnRenamed("u", "q"))
        forget(before)
        let_go(beam.sparkSession)
        left = beam.where(F.exists("fresh", lambda x: x)).count()
        told(f"search step {step}: {left} beams are open")
        if not left:
            return beam


def _next(q: np.ndarray, f: np.ndarray, expand: int) -> np.ndarray:
    """Positions of the first `expand` fresh rows of each q; rows of a q go by falling similarity."""
    r = np.flatnonzero(f)
    at = _runs(q[r])
    rank = np.arange(len(r)) - np.repeat(at[:-1], np.diff(at)) if len(r) else r
    return r[rank < expand]


def nearest(df: DataFrame, k: int = 10, degree: int = 40, ef: int = 192, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None, told: Callable[[str], None] = lambda _: None) -> DataFrame:
    """(id, rank, neighbour, similarity): for every query its k nearest rows of df by cosine, rank from 1.

    queries has the columns id_col and vec_col and defaults to all rows of df;
    a row of the query's own id is never its neighbour. The graph links every
    row to `degree` others; a search holds the max(ef, 2 k) best, and goes on
    until all of them have been visited.

    Similarity falls with rank, ties go by the lower id, and is rounded to six
    places. Ids may be of any type that can be compared. Null ids and vectors
    that are null, of another length than most, zero, or with null or infinite
    values are left out; of rows with one id that of the least vector counts.
    Equal vectors are neighbours of similarity 1. Fewer than k others give
    fewer rows, an empty table none. Other columns are ignored.
    """
    sized = df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = df.schema[id_col].dataType.simpleString()
    empty = df.sparkSession.createDataFrame([], f"{id_col} {kind}, rank int, neighbour {kind}, similarity double")
    if sized is None or not sized["n"]:
        return empty
    dim, ef = sized["n"], max(ef, 2 * k)
    base = written(vectors(df, id_col, vec_col, dim))
    vec = base.select(F.col("n").alias("id"), "v")
    asked = base if queries is None else written(vectors(queries, id_col, vec_col, dim))
    own = base.select("id", F.col("n").alias("own"))
    query = written(asked.join(own, "id", "left").select(F.col("n").alias("q"), F.coalesce("own", F.lit(-1)).alias("own"), "v"))
    graph = descend(vec, max(degree, k), dim=dim, told=told)
    found = search(vec, graph, query, dim, ef, told=told)
    # the beam's similarities are off by what 32-bit floats round at most; whatever else of the beam may be among the k after rounding is compared too
    off = F.lit(1e-6 + 2.4e-7 * dim)
    kth = F.get("sims", F.least(F.lit(k), F.size("sims")) - 1)
    pair = found.withColumn("_low", kth - off).select("q", F.explode(F.slice("ids", F.lit(1), F.size(F.filter("sims", lambda s: s >= F.col("_low"))))).alias("n"))
    unit = F.transform("x", lambda x: x / F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y)))
    a, b = asked.select(F.col("n").alias("q"), F.col("id").alias("_q"), unit.alias("x")), base.select("n", F.col("id").alias("_n"), unit.alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sim = pair.join(a, "q").join(b, "n").select("_q", "_n", (F.round(dot, 6) + 0.0).alias("similarity"))
    w = Window.partitionBy("_q").orderBy(F.desc("similarity"), "_n")
    ranked = sim.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(id_col), "rank", F.col("_n").alias("neighbour"), "similarity")
