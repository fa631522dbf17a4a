"""Best-fit packing: Best-two-fit over document sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType


class _Sizes:
    """Multiset of sizes 1..capacity with predecessor queries on a bit mask."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.count = np.bincount(sizes, minlength=capacity + 1)
        bits = np.packbits(self.count > 0, bitorder="little").tobytes()
        self.mask = int.from_bytes(bits, "little")

    def largest(self, most: int) -> int:
        """Largest size ≤ most; 0 if none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0

    def add(self, s: int, k: int) -> None:
        self.count[s] += k
        if k > 0:
            self.mask |= 1 << s
        elif not self.count[s]:
            self.mask &= ~(1 << s)

    def pair(self, most: int) -> tuple[int, int]:
        """Two sizes (a ≥ b) with the largest sum ≤ most, the largest a among equals; (0, 0) if none."""
        top = most - 1
        if top < 1:
            return 0, 0
        have = np.flatnonzero(self.count[: top + 1])
        if not len(have):
            return 0, 0
        prev = np.maximum.accumulate(np.where(self.count[: top + 1] > 0, np.arange(top + 1), 0))
        b = prev[np.minimum(have, most - have)]  # b ≤ a, or each pair is met twice
        alone = (b == have) & (self.count[have] < 2)
        b = np.where(alone, prev[np.maximum(have - 1, 0)], b)
        total = np.where(b > 0, have + b, 0)
        best = int(total.max())
        if not best:
            return 0, 0
        i = int(np.flatnonzero(total == best)[-1])
        return int(have[i]), int(b[i])


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size (1..capacity), bins numbered from 0 in the order they are closed.

    A bin takes the largest unpacked size that fits until none does. Then its
    smallest member is replaced by the two unpacked sizes that fill the gap
    left by it more tightly, if there are such. Equal sizes are taken in order
    of position.
    """
    left = _Sizes(sizes, capacity)
    todo, bins = len(sizes), []
    while todo:
        gap, own = capacity, []
        while gap and (s := left.largest(gap)):
            own.append(s)
            gap -= s
            left.add(s, -1)
        if gap and len(own) > 1:
            small = own[-1]  # taken in descending order
            a, b = left.pair(gap + small)
            if a + b > small:
                own.pop()
                left.add(small, 1)
                left.add(a, -1)
                left.add(b, -1)
                own += [a, b]
        todo -= len(own)
        bins.append(own)
    order = np.argsort(sizes, kind="stable")
    at = dict(zip(*(x.tolist() for x in np.unique(sizes[order], return_index=True))))
    out = np.empty(len(sizes), np.int64)
    for k, own in enumerate(bins):
        for s in own:
            out[order[at[s]]] = k
            at[s] += 1
    return out


def pack(docs: DataFrame, capacity: int = 16384, id_col: str = "doc_id", text_col: str = "text", size: str | None = None, shard_docs: int = 50_000) -> DataFrame:
    """(shard, bin, slot, id, start, n_units): a packing of all documents into bins of `capacity` units.

    size is a SQL expression for a document's length, such as a column of token
    counts; by default it has octet_length(text) units, one for each byte.
    Longer documents fill bins of their own and only the rest is packed with
    others, so start is where the piece begins in its document. Only ids and
    sizes are shuffled, as Arrow columns, so ids of any type come back as they
    were. Shards of about shard_docs documents, by hash of the id and size, are
    packed each for itself; the loss is less than a bin a shard. Documents of
    null or no length are not packed. Null ids are packed like others, after
    them among equal sizes. Repeated rows are packed each for itself; ties go by
    id. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), (F.expr(size) if size else F.octet_length(F.col(text_col))).cast("bigint").alias("_n")).where("_n > 0")
    from .shared import written

    slim = written(slim)
    shards = max(1, -(-slim.count() // shard_docs))
    names = ["shard", "bin", "slot", "_id", "start", "n_units"]

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("_n", "descending"), ("_id", "ascending")]))
        n = t["_n"].to_numpy().astype(np.int64)
        full, rest = n // capacity, n % capacity
        base = np.concatenate([[0], np.cumsum(full)])
        whole = np.repeat(np.arange(len(n)), full)
        k = np.arange(len(whole)) - base[whole]
        some = np.flatnonzero(rest)
        bins = np.concatenate([np.arange(len(whole)), best_two_fit(rest[some], capacity) + base[-1]])
        own = np.concatenate([whole, some])  # positions go by falling size, then id
        start = np.concatenate([k * capacity, (full * capacity)[some]])
        units = np.concatenate([np.full(len(whole), capacity), rest[some]])
        o = np.lexsort((start, own, -units, bins))
        bins, own, start, units = bins[o], own[o], start[o], units[o]
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        slot = np.arange(len(bins)) - np.repeat(first, np.diff(np.append(first, len(bins))))
        return pa.table([pa.array(np.full(len(bins), t["_s"][0].as_py())), pa.array(bins), pa.array(slot), t["_id"].take(pa.array(own)), pa.array(start), pa.array(units)], names)

    schema = StructType()
    for c in names:
        schema = schema.add(c, slim.schema["_id"].dataType if c == "_id" else LongType())
    # the size is in the hash so that rows of one id, however many, are spread
    keyed = slim.withColumn("_s", F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_n"), F.lit(shards)))
    return keyed.groupBy("_s").applyInArrow(run, schema).withColumnRenamed("_id", id_col)
