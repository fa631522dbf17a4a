"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from .kernel import _WORD, by_bytes, fold, raw
from .shared import written

_SPACE = np.uint8(32)
#: Bytes of text that are normalised at a time: a byte has some thirty in arrays beside it.
BLOCK = 1 << 20


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(text, offsets, source): folded words with one space around each; source has the byte in data that each kept byte came from."""
    low = fold(data)
    w = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    prev = np.empty(len(low), bool)
    prev[:1] = False
    prev[1:] = w[:-1]
    start = w & (~prev | edge[:-1])
    # one space before every word, one at the end of each row
    s = np.flatnonzero(start)
    kept = np.flatnonzero(w)
    pos = np.arange(len(kept)) + np.searchsorted(s, kept, "right") + (np.searchsorted(offs, kept, "right") - 1)
    n = len(kept) + len(s) + len(offs) - 1
    out = np.full(n, _SPACE, np.uint8)
    src = np.full(n, -1, np.int64)
    out[pos] = low[kept]
    src[pos] = kept
    new = np.searchsorted(kept, offs) + np.searchsorted(s, offs) + np.arange(len(offs))
    return out.tobytes(), new, src


def patterns(items: list[tuple[int, str | None]], window: int) -> dict[bytes, list[int]]:
    """Every window of `window` words of each item, the whole of a shorter one; items without words give none."""
    out: dict[bytes, list[int]] = {}
    for k, text in items:
        norm, _, _ = normalise(*raw(pa.array([text], pa.string())))
        w = norm.split()
        for i in range(max(1, len(w) - window + 1)) if w else ():
            own = out.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", [])
            if not own or own[-1] != k:
                own.append(k)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = 256 << 20) -> DataFrame:
    """(id, item, start, end, matched): each passage of a document that repeats `window` or more words of a test item.

    start and end are character offsets in the original text; overlapping hits
    of one item are one passage. Items shorter than the window match whole.
    The automaton is broadcast; test sets are small, and one whose patterns
    exceed most_bytes is scanned in several automata, each broadcast alone.
    Case and anything but words is ignored. Null or empty texts, items without
    words and an empty benchmark give no rows. Repeated items and rows each
    count; other columns are ignored.
    """
    spark = docs.sparkSession
    kind, ikind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = StructType().add("_id", kind).add("_item", ikind).add("start", LongType()).add("end", LongType()).add("matched", LongType())
    items = [(r[0], r[1]) for r in benchmark.select(item_col, item_text).where(F.col(item_text).isNotNull()).distinct().toLocalIterator()]
    found = patterns(items, window)
    parts, room = [{}], 0
    for p, k in found.items():
        if room + len(p) > most_bytes:
            parts.append({})
            room = 0
        parts[-1][p] = k
        room += len(p)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    send = spark.sparkContext.broadcast
    if len(parts) == 1:
        if not parts[0]:
            return spark.createDataFrame([], schema).withColumnsRenamed({"_id": id_col, "_item": item_col})
        return slim.mapInArrow(_scan(send(list(parts[0].items())), schema.add("_w", LongType())), schema).drop("_w").withColumnsRenamed({"_id": id_col, "_item": item_col})
    # a passage may be in several automata: hits of a row that meet are one
    from pyspark.sql import Window

    slim = written(slim.withColumn("_row", F.monotonically_increasing_id()))
    by_row = StructType().add("_row", LongType()).add("_item", ikind).add("start", LongType()).add("end", LongType()).add("matched", LongType()).add("_w", LongType())
    out = None
    for part in parts:
        hits = slim.select("_row", "_text").mapInArrow(_scan(send(list(part.items())), by_row), by_row)
        out = hits if out is None else out.unionByName(hits)
    w = Window.partitionBy("_row", "_item").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_g", F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(w))
    out = out.groupBy("_row", "_item", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("_w") + F.col("matched")) - F.min("_w")).alias("matched"))
    return out.join(slim.select("_row", "_id"), "_row").select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "start", "end", "matched")


_automata: dict[int, object] = {}


def _scan(items, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        from pyspark.sql.pandas.types import to_arrow_schema

        if items._path not in _automata:
            a = ahocorasick.Automaton()
            for p, k in items.value:
                a.add_word(p.decode("latin-1"), (len(p), k))
            a.make_automaton()
            _automata.clear()
            _automata[items._path] = a
        a, arrow = _automata[items._path], to_arrow_schema(schema)
        for b in by_bytes(batches, "_text", BLOCK):
            data, offs = raw(b.column(1))
            norm, new, src = normalise(data, offs)
            text = norm.decode("latin-1")
            ids, rows = b.column(0), []
            open_: dict[tuple[int, object], list[int]] = {}
            for last, (n, own) in a.iter(text):
                row = int(np.searchsorted(new, last, "right")) - 1
                first = last - n + 1
                if first < new[row]:
                    continue
                for k in own:
                    x = open_.get((row, k))
                    if x and first <= x[1]:
                        x[1] = last
                        continue
                    if x:
                        rows.append((row, k, *x))
                    open_[row, k] = [first, last]
            rows += [(r, k, *x) for (r, k), x in open_.items()]
            if rows:
                cols: list[list] = [[] for _ in arrow]
                for r, k, i, j in sorted(rows, key=lambda x: (x[0], x[2])):
                    doc = data[offs[r] : offs[r + 1]].tobytes()
                    s, e = int(src[i + 1] - offs[r]), int(src[j - 1] - offs[r]) + 1
                    cs = len(doc[:s].decode("utf-8", "replace"))
                    ce = cs + len(doc[s:e].decode("utf-8", "replace"))
                    for c, v in zip(cols, (ids[r].as_py(), k, cs, ce, text.count(" ", i, j), text.count(" ", int(new[r]), i))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, in which contamination() finds nothing. Rows of null id are kept.

    The ids found are written first: few of them are broadcast, and no text is shuffled, least of all beside the scan.
    """
    id_col = how.get("id_col", "doc_id")
    bad = written(contamination(docs, benchmark, **how).select(F.col(id_col).alias("_bad")).distinct())
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")
