"""Katz backoff over words of any order by plain joins of rows: the simple form of shard_katz, which the query uses.

A token is a case-sensitive word or run of punctuation, by its 64-bit hash, or
the end mark; contexts at the start of a text hold start marks. The tables grow
with the words and n-grams of the corpus, so no task holds them: the distinct
n-grams of each document are joined with them, order by order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from .kernel import by_bytes, combine, raw, tokens
from .shard_katz import grams, ratios
from .shared import folder, written


def names(order: int) -> list[str]:
    return [f"w{i}" for i in range(1, order + 1)]


def _distinct(w: list[np.ndarray], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, count) of the distinct n-grams of each row; row is ascending."""
    key = w[0]
    for x in w[1:]:
        key = combine(key, x)
    o = np.lexsort((key, row))
    key, row = key[o], row[o]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
    return o[new], np.diff(np.append(new, len(key)))


def counts(docs: DataFrame, order: int) -> DataFrame:
    """(w1, ..., c) of the n-grams of rows (_text), counted in each batch before they are shuffled."""
    schema = StructType()
    for c in [*names(order), "c"]:
        schema = schema.add(c, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", 2 << 20):
            w, _ = grams(*tokens(*raw(b.column(0))), order)
            i, n = _distinct(w, np.zeros(len(w[0]), np.int8))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[i].view(np.int64)) for x in w), pa.array(n)], schema.names)

    return docs.mapInArrow(run, schema).groupBy(*names(order)).agg(F.sum("c").alias("c"))


def train(docs: DataFrame, order: int = 3) -> str:
    """Path of the model of all rows (_text): tables (w1, ..., p) and (w1, ..., alpha) by order in the shared folder.

    The vocabulary is all words of the rows, the end mark, and one symbol for
    whatever else. Where no count of a context is discounted, one unit of count
    is left to what it hasn't been followed by, so every backoff weight is
    positive; the probabilities of each context sum to one exactly.
    """
    table = {order: written(counts(docs, order))}
    for k in range(order - 1, 0, -1):
        low = [F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, k + 1)]
        table[k] = written(table[k + 1].groupBy(*low).agg(F.sum("c").alias("c")))
    symbols = table[1].count() + 1
    path = folder(docs.sparkSession)
    docs.sparkSession.range(1).select(F.lit(symbols).cast("long").alias("symbols")).write.parquet(f"{path}/kind=size")
    lower = None
    for k in range(1, order + 1):
        w, ctx = names(k), names(k - 1)
        d = F.lit(1.0)
        few = {r[0]: r[1] for r in table[k].where("c <= 6").groupBy("c").count().collect()}
        for r, v in ratios(few).items():
            d = F.when(F.col("c") == r, F.lit(v)).otherwise(d)
        x = table[k].select(*w, F.col("c").cast("double").alias("c"), d.alias("d"))
        if lower is None:
            x = x.withColumn("q", F.lit(1.0 / symbols))
        else:
            x = x.join(lower.toDF(*w[1:], "q"), w[1:])
        h = x.groupBy(*ctx).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("d")).alias("dn"), F.sum("q").alias("q"), F.min("d").alias("nd"))
        scale = F.when(F.col("nd") == 1.0, F.col("n") / (F.col("n") + 1)).otherwise(1.0)
        h = h.select(*ctx, "n", scale.alias("scale"), ((1 - scale * F.col("dn") / F.col("n")) / F.greatest(1 - F.col("q"), F.lit(1e-12))).alias("alpha"))
        h = written(h)
        every = x.join(h, ctx) if ctx else x.crossJoin(F.broadcast(h))  # without a context h is one row
        every.select(*w, (F.col("scale") * F.col("d") * F.col("c") / F.col("n")).alias("p")).write.parquet(f"{path}/kind=p/order={k}")
        h.select(*ctx, "alpha").write.parquet(f"{path}/kind=alpha/order={k}")
        lower = docs.sparkSession.read.parquet(f"{path}/kind=p/order={k}").select(*w, "p")
    return path


def score(docs: DataFrame, path: str, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, perplexity) of all rows under the model at path.

    Null or empty texts have the end mark alone as their token. Repeated rows
    are each scored; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    schema = StructType().add("_id", slim.schema["_id"].dataType)
    for c in ["_row", *names(order), "n"]:
        schema = schema.add(c, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", 1 << 20):
            w, first = grams(*tokens(*raw(b.column(1))), order)
            own = np.repeat(np.arange(b.num_rows), np.diff(first))
            i, n = _distinct(w, own)
            own = own[i]
            # the id goes with one n-gram of its row
            head = np.concatenate([[True], own[1:] != own[:-1]])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, mask=~head)), b.column(2).take(pa.array(own)), *(pa.array(x[i].view(np.int64)) for x in w), pa.array(n)], schema.names)

    todo = slim.mapInArrow(run, schema).withColumn("s", F.lit(0.0))
    parts = None
    for k in range(order, 0, -1):
        w, ctx = names(k), names(k - 1)
        p = spark.read.parquet(f"{path}/kind=p/order={k}").select(*w, "p")
        x = todo.join(p, w, "left")
        hit = F.col("p").isNotNull()
        # found n-grams are summed by row, the others go on one by one
        x = x.groupBy("_row", hit.alias("hit"), *[F.when(~hit, F.col(c)).alias(c) for c in w]).agg(F.max("_id").alias("_id"), F.sum("n").alias("n"), F.sum(F.col("s") + F.col("n") * F.coalesce(F.log("p"), F.lit(0.0))).alias("s"))
        x = written(x)
        found = x.where("hit").select("_id", "_row", "n", "s")
        parts = found if parts is None else parts.unionByName(found)
        alpha = spark.read.parquet(f"{path}/kind=alpha/order={k}").select(*ctx, "alpha")
        rest = x.where("not hit")
        rest = rest.join(alpha, ctx, "left") if ctx else rest.crossJoin(F.broadcast(alpha))
        todo = rest.select("_id", "_row", *[F.col(a).alias(b) for a, b in zip(w[1:], names(k - 1))], "n", (F.col("s") + F.col("n") * F.coalesce(F.log("alpha"), F.lit(0.0))).alias("s"))
    symbols = spark.read.parquet(f"{path}/kind=size").first()["symbols"]
    parts = parts.unionByName(todo.select("_id", "_row", "n", (F.col("s") - F.col("n") * float(np.log(symbols))).alias("s")))
    sums = parts.groupBy("_row").agg(F.max("_id").alias("_id"), F.sum("n").alias("n_tokens"), F.sum("s").alias("log_prob"))
    return sums.select(F.col("_id").alias(id_col), "n_tokens", "log_prob", F.exp(-F.col("log_prob") / F.col("n_tokens")).alias("perplexity"))


def word_katz(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() of all documents under the model of all documents; an empty table gives an empty result."""
    return score(docs, train(docs.select(F.col(text_col).alias("_text")), order), order, id_col, text_col)
