"""BM25 over a collection, and the ways its scores become ranked lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dims
from ..functions.text import saturate, tokenise


_UPPER, _LOWER, _DIGIT = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STOP = pa.array(dims.STOP, pa.large_string())
#: the characters outside ASCII whose lower case has ASCII letters
_ODD = "\u212a|\u0130"
_CAMEL = (re.compile("([a-z])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])"))


def tokens(text: str, stop: frozenset = frozenset(dims.STOP)) -> list[str]:
    """What functions.text.tokenise gives, of one text."""
    for camel in _CAMEL:
        text = camel.sub(r"\1 \2", text)
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if len(t) >= 2 and not t.isdigit() and t not in stop]


def token_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows, places, words): what functions.text.tokenise gives of each text, in order, as places in words; nulls have none. By bytes of all texts at once, as everything outside ASCII parts tokens."""
    texts = texts.cast(pa.large_string())
    odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False)
    slow = [(i, tokens(texts[i].as_py())) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))]
    plain = pc.if_else(pc.or_(odd, texts.is_null()), pa.scalar("", pa.large_string()), texts)
    if isinstance(plain, pa.ChunkedArray):
        plain = plain.combine_chunks()
    _, offsets, data = plain.buffers()
    at = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    at = at - at[0]
    kind = np.concatenate([[0], _KIND[raw], [0, 0]]).astype(np.uint8)
    here, before, after = kind[1:-2], kind[:-3], kind[2:-1]
    first = np.zeros(len(raw) + 1, bool)  # of a text
    first[at] = True
    first = first[:-1]
    ends = np.append(first[1:], True)
    up = here == _UPPER
    # aB and ABc part between a and B, A and B
    start = (here > 0) & (first | (before == 0) | up & (before == _LOWER) | up & (before == _UPPER) & (after == _LOWER) & ~ends)
    begin = np.flatnonzero(start)
    inside = here > 0
    place = np.cumsum(inside)
    offset = np.append(place[begin] - 1, place[-1] if len(place) else 0).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offset), pa.py_buffer(_FOLD[raw[inside]])])
    rows = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(begin, at)))
    d = words.dictionary_encode()
    w = d.dictionary
    keep = pc.and_(pc.greater_equal(pc.binary_length(w), 2), pc.invert(pc.or_(pc.match_substring_regex(w, "^[0-9]+$"), pc.is_in(w, _STOP)))).to_numpy(zero_copy_only=False)
    code = d.indices.to_numpy()
    ok = keep[code]
    rows, code = rows[ok], code[ok]
    if slow:
        more = pa.array([x for _, found in slow for x in found], pa.large_string())
        rows, code, w = np.concatenate([rows, *[np.full(len(found), i) for i, found in slow]]), np.concatenate([code, np.arange(len(more)) + len(w)]), pa.concat_arrays([w, more])
        o = np.argsort(rows, kind="stable")
        rows, d = rows[o], w.take(pa.array(code[o])).dictionary_encode()
        return rows, d.indices.to_numpy(), d.dictionary
    return rows, code, w


def _parts(texts: pa.Array, rows: int = 512, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(start, number) of few texts at a time, whatever their length."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        n = max(1, min(rows, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")) - at))
        yield at, n
        at += n


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl) of documents, one a row, each counted where it is read: no token is shuffled."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, term string, tf bigint, dl bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, size in _parts(b.column(1)):
                ids = b.column(0).slice(at, size)
                row, code, words = token_lists(b.column(1).slice(at, size))
                n = np.bincount(row, minlength=size)
                one, tf = np.unique(row * max(1, len(words)) + code, return_counts=True)
                row, code = np.divmod(one, max(1, len(words)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), words.take(pa.array(code)).cast(pa.string()), pa.array(tf.astype(np.int64)), pa.array(n[row].astype(np.int64))], ["id", "term", "tf", "dl"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl) of every document, those without a token too"""
    return docs.select(F.col(id_col).alias("id"), F.size(tokenise(F.col(text_col))).cast("bigint").alias("dl"))


def idf(postings: DataFrame, n_docs: DataFrame, epsilon: float = 0.25, written=lambda df: df) -> DataFrame:
    """(term, df, idf): Okapi idf; a negative one becomes epsilon times the mean of all, negative ones included. n_docs has one row (n). written keeps the counts, so that postings are counted once."""
    df = written(postings.groupBy("term").agg(F.count("*").alias("df"))).crossJoin(F.broadcast(n_docs))
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Lexicon:
    """What BM25 needs of a collection: postings (id, term, tf, dl), weights (term, idf), and its average length."""

    postings: DataFrame
    weights: DataFrame
    avgdl: float


def lexicon(docs: DataFrame, id_col: str, text_col: str, written=lambda df: df) -> Lexicon:
    """The index of a collection; written keeps its tables, so that texts are read once, whatever is asked."""
    postings = written(terms(docs, id_col, text_col))
    n = docs.agg(F.count("*").alias("n"))
    every = postings.agg(F.sum("tf").cast("double").alias("all")).crossJoin(n).first()
    return Lexicon(postings, written(idf(postings, n, written=written).select("term", "idf")), every["all"] / every["n"] if every["all"] else 1.0)


def bm25(index: Lexicon, queries: DataFrame, qid_col: str, qtext_col: str, k1: float = 1.5, b: float = 0.75, written=lambda df: df) -> DataFrame:
    """(qid, id, score): Okapi scores of the documents that share a term with the query; a repeated query term counts again.

    Statistics are of the whole collection. The queries' weighted terms are
    written, so that their size is known when they are joined with the
    postings: few of them are broadcast, many are shuffled.
    """
    asked = queries.select(F.col(qid_col).alias("qid"), F.explode(tokenise(F.col(qtext_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    hits = written(asked.join(index.weights, "term")).join(index.postings, "term")
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl))
    part = F.col("qtf") * F.col("idf") * (F.col("tf") * F.lit(k1 + 1)) / (F.col("tf") + norm)
    return hits.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each group, with their rank from 1; the window is cut in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def max_merge(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The largest score of each group: several queries become one list."""
    return scored.groupBy(*by).agg(F.max(score).alias(score))


def layer_quota(dense: DataFrame, lexical: DataFrame, by: list[str], layer: str, k: int = 12) -> DataFrame:
    """(by, id, score): of each layer the k best by the larger of cosine and saturated BM25, merged over the layers."""
    d = top_k(dense, k, [*by, layer]).select(*by, layer, "id", "score")
    x = top_k(lexical.where("score > 0"), k, [*by, layer]).select(*by, layer, "id", saturate(F.col("score")).alias("score"))
    best = max_merge(d.unionByName(x), [*by, layer, "id"])
    return max_merge(top_k(best, k, [*by, layer]), [*by, "id"])
