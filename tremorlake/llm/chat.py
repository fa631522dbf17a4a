"""Chat formatting by a grammar round trip: render, reparse, compare, escape what conflicts until the turns are identical.

Grammar: ("<|im_start|>" role "\\n" content "<|im_end|>\\n")*. In an escaped
turn every "<", backslashes, "|" gets one backslash more, which the parser takes
away again, and a line end in a role is "<|nl|>". A null role or text is
"<|null|>" alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

START, END, NULL, LINE = "<|im_start|>", "<|im_end|>", "<|null|>", "<|nl|>"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")

Turn = tuple[str | None, str | None]


def _out(s: str | None, escape: bool, role: bool) -> str:
    if s is None:
        return NULL
    if escape:
        s = _MARK.sub(r"<\1\\|", s)
        if role:
            s = s.replace("\n", LINE)
    return s


def _back(s: str, role: bool) -> str | None:
    if s == NULL:
        return None
    if role:
        s = s.replace(LINE, "\n")
    return _ESCAPED.sub(r"<\1|", s)


def render(turns: list[Turn], escaped: set[int]) -> str:
    return "".join(f"{START}{_out(r, i in escaped, True)}\n{_out(t, i in escaped, False)}{END}\n" for i, (r, t) in enumerate(turns))


def parse(text: str) -> list[Turn]:
    """The turns of a rendered text, as far as it follows the grammar."""
    turns, at = [], 0
    while text.startswith(START, at):
        head = text.find("\n", at)
        tail = text.find(END + "\n", head + 1) if head >= 0 else -1
        if tail < 0:
            break
        role, body = text[at + len(START) : head], text[head + 1 : tail]
        if START in body or END in body or START in role or END in role:
            break
        turns.append((_back(role, True), _back(body, False)))
        at = tail + len(END) + 1
    return turns if at == len(text) else [*turns, (None, None)]


def conflicts(turn: Turn) -> bool:
    """Whether a turn as it is reads differently when parsed."""
    role, text = turn
    return any(s is not None and (START in s or END in s or s == NULL or _ESCAPED.search(s)) for s in turn) or role is not None and ("\n" in role or LINE in role)


def fit(turns: list[Turn]) -> tuple[str, int]:
    """(text, turns escaped): the rendering whose parse gives back the turns, with as few escaped as that asks for.

    All turns that hold a conflict are escaped at once; the parse then proves
    it, or shows the next one to escape.
    """
    escaped = {i for i, t in enumerate(turns) if conflicts(t)}
    while True:
        text = render(turns, escaped)
        got = parse(text)
        if got == turns:
            return text, len(escaped)
        # at the first difference is, or just before it, a turn that isn't escaped yet
        i = next((i for i, (a, b) in enumerate(zip(got, turns)) if a != b), min(len(got), len(turns)))
        i = min(i, len(turns) - 1)
        while i in escaped and i > 0:
            i -= 1
        if i in escaped:
            escaped |= set(range(len(turns)))
        escaped.add(i)


def _cut(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of conversations of about `most` bytes, a longer one alone."""
    for b in batches:
        at, size = 0, 0
        bytes_ = [sum(len(t or "") for t in x) for x in b.column(2).to_pylist()] if b.nbytes > most else [0] * b.num_rows
        for i, n in enumerate(bytes_):
            if size and size + n > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if b.num_rows:
            yield b.slice(at)


def chat_format(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_escaped, rendered) of every conversation; parse(rendered) gives back its roles and texts.

    Turns go by (turn, role, text), nulls first; repeated rows are turns of
    their own. Rows of null id are one conversation. Null roles and texts come
    back as null, empty ones as empty. An empty table gives none. Other columns
    are ignored.
    """
    grouped = turns.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(turn_col).isNotNull().alias("a"), F.col(turn_col).alias("t"), F.col(role_col).isNotNull().alias("b"), F.col(role_col).alias("r"), F.col(text_col).isNotNull().alias("c"), F.col(text_col).alias("x")))).alias("_t"))
    flat = grouped.select("_id", F.transform("_t", lambda t: t["r"]).alias("_r"), F.transform("_t", lambda t: t["x"]).alias("_x"))
    schema = StructType().add("_id", flat.schema["_id"].dataType).add("n_turns", LongType()).add("n_escaped", LongType()).add("rendered", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            out = [fit(list(zip(r, x))) for r, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            n = [len(r) for r in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([e for _, e in out], pa.int64()), pa.array([t for t, _ in out], pa.string())], schema.names)

    return flat.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
