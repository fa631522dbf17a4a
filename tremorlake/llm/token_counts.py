"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import by_bytes

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Every alternative of PATTERN that holds a non-space ends with one, so a cut before a space that follows a letter or digit never divides a piece.
_CUT = re.compile(r"(?<=\w)(?= \w)")


def pieces(text: str, most: int, space: bool = True) -> list[str]:
    """text in parts of about `most` characters, cut only where no token can span; a text without such a place stays whole.

    A part keeps the space that it begins with, or not (space), where the
    tokenizer puts one before every text itself.
    """
    out, at = [], 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start() + (not space)
    return [*out, text[at:]]


_encoders: dict[str, Callable[[list[str]], list[int]]] = {}


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """texts → token counts, by the kind of vocabulary file: .tiktoken, .json (tokenizers) or .model (sentencepiece). One per worker process."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _encoders[path] = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
        elif path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _encoders[path] = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            if any("\u2581" in sp.id_to_piece(i).lstrip("\u2581") for i in range(sp.get_piece_size())):
                raise ValueError(f"{path} has pieces that span words, so long texts can't be split")
            _encoders[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    return _encoders[path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, split_chars: int = 1 << 16) -> DataFrame:
    """(id, n_tokens) of every row.

    Rows are encoded in the partition where they are read, in batches of about
    batch_bytes of text; longer texts are split at boundaries that no token
    spans, before a single space between words. Null text gives null, empty
    text 0. Null ids stay null. Repeated rows are counted each for itself;
    other columns are ignored, whatever their names.
    """
    space = not tokenizer.endswith(".model")
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in by_bytes(batches, "_text", batch_bytes):
            texts = b.column(1).to_pylist()
            parts, owner = [], []
            for i, t in enumerate(texts):
                for p in [t] if t is None or len(t) <= split_chars else pieces(t, split_chars, space):
                    if p:
                        parts.append(p)
                        owner.append(i)
            n = [None if t is None else 0 for t in texts]
            for i, k in zip(owner, encode(parts)):
                n[i] += k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["_id", "_n"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("_id", kind).add("_n", LongType())
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(count, schema).select(F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"))
