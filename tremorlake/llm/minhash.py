"""MinHash near-dedup: fast similarity sketching, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from .kernel import by_bytes, combine, mix, ngrams, raw, words
from .shared import folder, forget, written


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the sorted set of word n-gram hashes of each row; row i has first[i]:first[i+1]."""
    h, _, _, first = words(data, offs)
    g, row = ngrams(h, first, n)
    o = np.lexsort((g, row)) if len(g) else np.zeros(0, np.int64)
    g, row = g[o], row[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(offs)))


def fast_sketch(g: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, a row of t values for each set (Dahlgaard, Knudsen and Thorup).

    In round i < t every element goes to one bin with a value in [i, i+1); in
    round t+j every element goes to bin j. Rounds go on until each bin of the
    set is filled, so after 2t rounds every coordinate is. Two sets agree in a
    coordinate with probability their Jaccard similarity, concentrated as if
    the coordinates were independent. Empty sets keep the largest value.
    """
    rows = len(first) - 1
    sketch = np.full((rows, t), np.iinfo(np.uint64).max, np.uint64)
    flat = sketch.reshape(-1)
    size = np.diff(first)
    row = np.repeat(np.arange(rows), size)
    for i in range(2 * t):
        if not len(g):
            break
        x = mix(g + np.uint64((i * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
        bins = (x >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(x), i - t, np.uint64)
        # value: round in the top byte or two, then the hash
        value = np.uint64(i << 48) | (mix(x) >> np.uint64(16))
        np.minimum.at(flat, row * t + bins.astype(np.int64), value)
        full = (sketch != np.iinfo(np.uint64).max).all(axis=1)
        go = ~full[row]
        g, row = g[go], row[go]
    return sketch


def bands(sketch: np.ndarray, r: int) -> np.ndarray:
    """Hash of every r coordinates of each sketch, with the band's number in it."""
    t = sketch.shape[1]
    out = np.empty((len(sketch), t // r), np.uint64)
    for b in range(t // r):
        h = np.full(len(sketch), b + 1, np.uint64)
        for k in range(r):
            h = combine(h, sketch[:, b * r + k])
        out[:, b] = h
    return out


def sketches(docs: DataFrame, n: int, t: int, r: int) -> DataFrame:
    """(_id, s1, s2, size, bands) of rows (_id, _text) with a word; s1 and s2 identify the set of shingles."""
    schema = StructType().add("_id", docs.schema["_id"].dataType).add("s1", LongType()).add("s2", LongType()).add("size", LongType()).add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", 1 << 20):
            g, first = shingle_sets(*raw(b.column(1)), n)
            size = np.diff(first)
            has = np.flatnonzero(size)
            if not len(has):
                continue
            at = first[has]
            s1 = mix(np.add.reduceat(mix(g), at) + size[has].astype(np.uint64))
            s2 = mix(np.bitwise_xor.reduceat(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at))
            k = bands(fast_sketch(g, np.append(at, len(g)), t), r)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, k.shape[1]), pa.int32()), pa.array(k.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(size[has]), lists], ["_id", "s1", "s2", "size", "bands"])

    return docs.mapInArrow(run, schema)


def _filter(ids: DataFrame) -> tuple[str, int]:
    """(path, bits) of a Bloom filter of ids in the shared folder: 16 bits an id, 64 MB at most; beyond that it only lets more pass."""
    n = ids.count()
    bits = 1 << min(29, max(15, (16 * n).bit_length()))
    spots = F.array(*[F.pmod(F.xxhash64(F.lit(k), "_id"), F.lit(bits)) for k in range(4)])
    path = folder(ids.sparkSession)
    each = ids.select(F.explode(spots).alias("bit")).select(F.col("bit") + 1).toDF("bit")  # positions count from 1
    each.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")).write.parquet(path)
    return path, bits


def verify(docs: DataFrame, pairs: DataFrame, n: int, tau: float) -> DataFrame:
    """(a, b, same) of the pairs (a, b) of ids: whether the Jaccard similarity of the whole sets is at least tau.

    A Bloom filter of the ids keeps all other documents from being shuffled. A
    set goes to every pair's first id: rows are sorted by (a, salt) with a's
    set ahead, and read as a stream, so a group of any size needs the memory of
    two sets. Large groups are salted over tasks.
    """
    kind = docs.schema["_id"].dataType
    many = pairs.groupBy("a").agg((F.count("*") / 1000).cast("int").alias("_k")).where("_k > 1")
    salted = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_k", F.lit(1))).alias("_s"))
    ends = written(salted.select("a", "_s", "b", F.col("b").alias("_id")).union(salted.select("a", "_s", F.lit(None).cast(kind), F.col("a")).distinct()))
    path, bits = _filter(ends.select("_id").distinct())
    hashes = [F.pmod(F.xxhash64(F.lit(k), "_id"), F.lit(bits)).alias(f"_h{k}") for k in range(4)]
    sets_schema = StructType().add("_id", kind).add("_set", BinaryType())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path if path.startswith("file:") or "://" in path else f"file://{path}")
        have = np.zeros(bits // 8, np.uint8)
        t = pq.read_table(at, filesystem=system, partitioning=None)
        for bucket, bitmap in zip(t["bucket"].to_pylist(), t["bitmap"].to_pylist()):  # bucket k has the bits from (k - 1) * 32768
            part = np.frombuffer(bitmap, np.uint8)
            lo = (bucket - 1) * len(part)
            have[lo : lo + len(part)] |= part[: len(have) - lo]
        for x in by_bytes(batches, "_text", 1 << 20):
            ok = np.ones(x.num_rows, bool)
            for k in range(4):
                h = x.column(2 + k).to_numpy()
                ok &= (have[h >> 3] >> (h & 7)) & 1 == 1
            if not ok.any():
                continue
            x = x.filter(pa.array(ok))
            g, first = shingle_sets(*raw(x.column(1)), n)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([g[first[i] : first[i + 1]].tobytes() for i in range(x.num_rows)], pa.binary())], ["_id", "_set"])

    own = docs.select("_id", "_text", *hashes).mapInArrow(sets, sets_schema)
    stream = ends.join(own, "_id").select("a", "_s", "b", "_set").repartition("a", "_s").sortWithinPartitions("a", "_s", F.col("b").asc_nulls_first())
    schema = StructType().add("a", kind).add("b", kind).add("same", BooleanType())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for x in batches:
            a, b, s = x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3)
            keep, same = [], []
            for i, k in enumerate(b):
                g = np.frombuffer(s[i].as_buffer(), np.uint64)
                if k is None:
                    head = g
                    continue
                small, big = (head, g) if len(head) < len(g) else (g, head)
                at = np.searchsorted(big, small)
                both = int((big[np.minimum(at, len(big) - 1)] == small).sum()) if len(big) else 0
                keep.append(i)
                same.append(both >= tau * (len(g) + len(head) - both) - 1e-9)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], x.column(0).type), pa.array([b[i] for i in keep], x.column(2).type), pa.array(same)], ["a", "b", "same"])

    return stream.mapInArrow(compare, schema)


def components(edges: DataFrame) -> DataFrame:
    """(_id, group): the least id of the connected component of each id in edges (a, b), by alternating large and small stars.

    Least neighbours are aggregated before they are shuffled and joined back,
    so that the centre of a huge star is one row, and no task holds its leaves.
    """
    e = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        old, e = e, written(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).where("u <> v").distinct())
        forget(old, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("_id"), F.col("v").alias("group")).union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, tau: float = 0.5, shingle: int = 3, t: int = 128, r: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id, group_size): the documents that have a near duplicate; group_id is the least id of the group.

    Documents are near duplicates if the Jaccard similarity of their sets of
    `shingle`-word shingles is tau or more; groups are what such pairs connect.
    Candidates share a band of r of the t sketch coordinates. Documents of
    equal sets are one candidate. In each bucket all are compared with the
    bucket's least id; then every pair of the bucket that is not in one group
    by then is compared too, so the groups are those of comparing every pair.
    Nothing is capped; a pair of similarity s is a candidate with probability
    1 - (1 - s^r)^(t / r), 0.87 at s = 0.5 and 0.9999 at 0.7. Texts without a word, nulls among them, are nobody's
    duplicate. Null ids are left out. Ids should be
    unique: rows of one id are one document, which has the shingles of any of
    them. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & (F.length("_text") > 0))
    sk = written(sketches(slim, shingle, t, r))
    # one candidate for each set of shingles
    rep = sk.groupBy("s1", "s2").agg(F.min(F.struct("_id", "bands")).alias("x"), F.count("*").alias("n"))
    rep = written(rep.select("s1", "s2", "n", F.col("x._id").alias("_id"), F.col("x.bands").alias("bands")))
    several = rep.where("n > 1").select("s1", "s2", F.col("_id").alias("a"))
    copies = sk.select("_id", "s1", "s2").join(several, ["s1", "s2"]).where("a <> _id").select("a", F.col("_id").alias("b"))
    # a bucket's least id is aggregated before the shuffle; its members stay rows
    placed = rep.select("_id", F.explode("bands").alias("k"))
    shared = placed.groupBy("k").agg(F.min("_id").alias("a"), F.max("_id").alias("z")).where("a <> z").select("k", "a")
    buckets = written(placed.join(shared, "k"))
    star = buckets.where("_id <> a").select("a", F.col("_id").alias("b")).distinct()
    one = written(verify(slim, star, shingle, tau))
    group = written(components(one.where("same")))
    # pairs of a bucket that aren't in one group yet and weren't compared
    member = buckets.select("k", "_id").join(group, "_id", "left").select("k", "_id", F.coalesce("group", "_id").alias("g"))
    mixed = member.groupBy("k").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("k")
    member = written(member.join(mixed, "k", "left_semi"))
    l, m = member.alias("l"), member.alias("m")
    rest = l.join(m, (F.col("l.k") == F.col("m.k")) & (F.col("l._id") < F.col("m._id")) & (F.col("l.g") != F.col("m.g"))).select(F.col("l._id").alias("a"), F.col("m._id").alias("b")).distinct().join(one.select("a", "b"), ["a", "b"], "left_anti")
    two = verify(slim, written(rest), shingle, tau)
    edges = one.where("same").select("a", "b").union(two.where("same").select("a", "b")).union(copies)
    found = written(components(edges).distinct())
    size = found.groupBy("group").agg(F.count("*").alias("group_size"))
    return found.join(size, "group").select(F.col("_id").alias(id_col), F.col("group").alias("group_id"), "group_size")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, without those of a group that aren't its least id."""
    id_col = how.get("id_col", "doc_id")
    gone = near_duplicates(docs, **how).where(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
