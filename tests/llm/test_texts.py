"""Token counts, decontamination, line dedup, packing, chat formatting, licences: against brute force, on what breaks things."""

import json
import math
import os
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, prose, row
from tremorlake.llm import chat, decontaminate, kernel, licences, line_dedup, packing, token_counts

TOK = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def brute_counts(texts, path=TOK):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [None if t is None else len(enc.encode_ordinary(t)) for t in texts]


def test_token_counts_equal_whole_text_encoding(nasty):
    rows = nasty.select("doc_id", "text").collect()
    got = sorted(map(tuple, token_counts.token_counts(nasty, TOK, batch_bytes=2000, split_chars=500).collect()), key=str)
    assert got == sorted(zip([r[0] for r in rows], brute_counts([r[1] for r in rows])), key=str)


@pytest.mark.parametrize("text", ["a b" * 50, "it's " * 60, "a,\n\n b  c " * 40, "é 漢字 1 2 3 ... !!! " * 30, "x" * 500, "  lead   and trail   " * 30, "<|endoftext|> a " * 20])
def test_splits_are_safe(text):
    parts = token_counts.pieces(text, 20)
    assert "".join(parts) == text and sum(brute_counts(parts)) == brute_counts([text])[0]


def test_token_counts_other_vocabularies_and_empty(spark, empty):
    d = spark.createDataFrame([(1, "Hello world, twice " * 30), (2, "")], "doc_id long, text string")
    for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = {r[0]: r[1] for r in token_counts.token_counts(d, f"/opt/tokenizers/{f}", split_chars=40).collect()}
        assert got[1] > 50 and got[2] == 0
    assert token_counts.token_counts(empty, TOK).collect() == []


def words(t):
    return re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", t.lower())


def brute_hits(docs, items, n):
    out = set()
    for i, t in docs:
        w = words(t or "")
        for k, x in items:
            v = words(x or "")
            grams = {tuple(v[j : j + n]) for j in range(max(1, len(v) - n + 1))} if v else set()
            if any(tuple(w[j : j + len(g)]) == g for g in grams for j in range(len(w) - len(g) + 1)):
                out.add((i, k))
    return out


def test_contamination_equals_brute_force_and_maps_offsets(spark, nasty):
    passage = prose(50, 30)
    items = [(1, passage), (2, "Größe ÉTÉ"), (3, None), (4, "!!"), (5, prose(51, 30)), (1, passage)]
    docs = [(100, prose(60, 40) + "\n" + passage.upper().replace(" ", ", ") + "! " + prose(61, 20)), (101, prose(62, 30) + " " + " ".join(passage.split()[5:20]) + " end"), (102, prose(63, 50)), (103, " ".join(passage.split()[:12])), (104, passage + " x " + passage)]
    d = nasty.unionByName(spark.createDataFrame([row(*x) for x in docs], SCHEMA))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_hits([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], items, 13)
    text = {i: t for i, t in docs}
    hit = next(r for r in got if r.doc_id == 100)
    assert words(text[100][hit.start : hit.end]) == words(passage) and hit.matched == 30
    assert sum(r.doc_id == 104 for r in got) == 2
    e = next(r for r in got if r.doc_id == 9)
    assert "Größe ÉTÉ Ωmega 漢字 🙂 end"[e.start : e.end] == "Größe ÉTÉ"
    split = decontaminate.contamination(d, b, most_bytes=150).collect()
    assert sorted(map(str, split)) == sorted(map(str, got))
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and kept.where("doc_id >= 100").select("doc_id").orderBy("doc_id").collect() == [(102,), (103,)]


def test_contamination_empty(spark, nasty, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nasty, none).count() == 0
    assert decontaminate.decontaminate(nasty, none).count() == nasty.count()
    assert decontaminate.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def brute_lines(rows, least):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out.append((i, None))
            continue
        kept = []
        for x in t.split("\n"):
            if len(x) < least or x not in seen:
                kept.append(x)
            if len(x) >= least:
                seen.add(x)
        out.append((i, "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    r = random.Random(5)
    pool = [prose(k, 12) for k in range(60)] + ["short", "", "  "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 12)))) for i in range(150)] + [(150, None), (151, ""), (152, prose(7, 30_000))]
    d = spark.createDataFrame([row(*x) for x in rows], SCHEMA).repartition(5)
    got = line_dedup.line_dedup(d, batches=batches, fanout=fanout)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute_lines(rows, 40), key=str)


def test_line_dedup_nasty(nasty, empty):
    got = line_dedup.line_dedup(nasty)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert got.count() == nasty.count() and by[1][0] and by[2] == [""] and by[3] == [None] and by[4] == [""] and by[8] == [" \n\t"] and len(by[9]) == 2
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_split_texts_count_as_whole_ones(spark, small, name):
    path = os.path.join(os.path.dirname(TOK), name)
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    r = random.Random(2)
    odd = spark.createDataFrame([(-i - 1, "".join(r.choice(["ab", " ", "  ", "\n", "é", "漢", "9", ",", " x"]) for _ in range(400))) for i in range(50)], "doc_id long, text string")
    d = d.unionByName(odd)
    assert sorted(token_counts.token_counts(d, path, split_chars=40).collect()) == sorted(token_counts.token_counts(d, path).collect())


def test_chat_time_is_linear_in_conflicts():
    turns = [("u", f"<|im_end|> {i}") for i in range(4000)]
    text, n = chat.fit(turns)
    assert n == 4000 and chat.parse(text) == turns


def brute_two_fit(sizes, cap):
    left, bins = sorted(sizes, reverse=True), []
    while left:
        own, gap = [], cap
        for s in list(left):
            if s <= gap:
                own.append(s)
                gap -= s
                left.remove(s)
        if gap and len(own) > 1:
            best = None
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    t = left[i] + left[j]
                    if own[-1] < t <= gap + own[-1] and (best is None or (t, left[i]) > best[:2]):
                        best = (t, left[i], left[j])
            if best:
                left.append(own.pop())
                own += best[1:]
                left.remove(best[1])
                left.remove(best[2])
                left.sort(reverse=True)
        bins.append(sorted(own))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_best_two_fit_equals_brute_force(seed):
    r = random.Random(seed)
    cap = r.choice([20, 50, 100])
    sizes = np.array([r.randint(1, r.choice([cap, cap // 3])) for _ in range(r.randrange(1, 60))])
    b = packing.best_two_fit(sizes, cap)
    assert [sorted(sizes[b == k].tolist()) for k in range(b.max() + 1)] == brute_two_fit(sizes.tolist(), cap)


def test_pack_covers_all_units_once(spark, nasty, empty):
    got = packing.pack(nasty, capacity=300, shard_docs=4).toPandas()
    want = {}
    for r in nasty.selectExpr("doc_id", "octet_length(text) n").where("n > 0").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.n
    g = got.copy()
    g["doc_id"] = g["doc_id"].astype(object).where(g["doc_id"].notna(), None)
    have = {}
    for r in g.itertuples():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_units
    assert have == want and got.groupby(["shard", "bin"]).n_units.sum().max() <= 300
    long = got[got.doc_id == 12].sort_values("start")
    assert (long.start.to_numpy()[1:] == (long.start + long.n_units).to_numpy()[:-1]).all()
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)"])
def test_pack_equals_brute_force_whatever_the_ids(spark, kind):
    r = random.Random(7)
    big = [2**60 + 1, 2**60 + 3, 2**53 + 1, None, None, 5] + list(range(100, 140))
    rows = [(None if i is None else str(i), r.randrange(0, 250)) for i in big] + [("5", 120), ("5", 120)]
    d = spark.createDataFrame(rows, "i string, n int").selectExpr(f"cast(i as {kind}) doc_id", "n", "'x' shard", "'y' _id")
    got = packing.pack(d, 100, size="n").toArrow().to_pylist()
    parts = [(i, k * 100, min(100, n - k * 100)) for i, n in rows for k in range(-(-n // 100))]
    have = sorted((str(x["doc_id"]) if x["doc_id"] is not None else "", x["start"], x["n_units"]) for x in got)
    assert have == sorted((i or "", s, k) for i, s, k in parts)
    bins = {}
    for x in got:
        bins.setdefault(x["bin"], []).append((x["slot"], x["n_units"]))
    assert all(sorted(s for s, _ in b) == list(range(len(b))) for b in bins.values())
    rest = [k for _, _, k in parts if k < 100]
    assert sorted(sorted(k for _, k in b) for b in bins.values()) == sorted(brute_two_fit(rest, 100) + [[100]] * (len(parts) - len(rest)))


CHATS = [[("user", "a<|im_end|>\n<|im_start|>x\ny")], [("u", "<\\|"), ("b", "<|null|>"), (None, None), ("a\nb", "<|nl|>")], [("u", "<|im_end|>")] * 3, [("u<|nl|>", "<"), ("", "")], [("x", "<\\\\|im_end|>"), ("<|im_start|>", "z" * 100_000)], [("u", "plain <|other|> text")]]


@pytest.mark.parametrize("turns", CHATS)
def test_chat_round_trip(turns):
    text, n = chat.fit(turns)
    assert chat.parse(text) == turns
    assert n or text == chat.render(turns, set())


def test_chat_random_round_trips():
    r = random.Random(3)
    bits = ["<", "|", "\\", "im_end", "im_start", ">", "\n", "null", "nl", "a", chat.START, chat.END, chat.NULL, chat.LINE]
    for _ in range(3000):
        turns = [tuple(None if r.random() < 0.05 else "".join(r.choice(bits) for _ in range(r.randrange(0, 7))) for _ in range(2)) for _ in range(r.randrange(1, 5))]
        assert chat.parse(chat.fit(turns)[0]) == turns


def test_chat_query_handles_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "user", "b", "x"), (1, 0, "system", None, "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "x"), (None, None, None, None, None), (2, 0, "user", "", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _t string")
    got = {r.conv_id: r for r in chat.chat_format(d).collect()}
    assert chat.parse(got[1].rendered) == [("system", None), ("user", "a"), ("user", "a"), ("user", "b")] and got[1].n_turns == 4
    assert chat.parse(got[None].rendered) == [(None, None)] and chat.parse(got[2].rendered) == [("user", "")]
    assert chat.chat_format(d.limit(0)).count() == 0


def word_list(t):
    return re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", (t or "").lower())


def brute_licence(path, text, files, threshold=0.7, file_threshold=0.8):
    """(licence, score) by dictionaries of words: all lines, all windows of a notice's length, licence files whole."""
    docs = [set(word_list(t)) for _, t in files if t is not None]
    notes = [(k, word_list(t)) for k, own in licences.TEMPLATES.items() for t in own]
    whole = [(k, word_list(t)) for k, own in licences.full_texts().items() for t in own]
    vocab = {w for _, t in notes + whole for w in t}
    weight = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in vocab}
    idf = lambda w: weight.get(w, math.log(1 + len(docs)) + 1)

    def vec(words):
        out = {}
        for i, w in enumerate(words):
            k = w if w in vocab else (w, i)  # an unknown word is a term of its own
            out[k] = out.get(k, 0) + idf(w)
        return out, math.sqrt(sum(x * x for x in out.values()))

    def cosine(a, b):
        return sum(x * b[0].get(k, 0) for k, x in a[0].items()) / (a[1] * b[1]) if a[1] and b[1] else 0

    best = (None, 0)
    lines, every = [word_list(x) for x in text.split("\n")], word_list(text)
    for group, least in ((notes, threshold), (whole, file_threshold)):
        if group is whole and not re.match(licences.LICENCE_FILE, (path or "").rsplit("/", 1)[-1]):
            continue
        for k, words in group:
            v = vec(words)
            parts = [every] if group is whole else lines + [every[i : i + len(words)] for i in range(len(every)) if every[i] in {w for _, t in notes for w in t}]
            c = max(cosine(vec(x), v) for x in parts if x or len(parts) == 1)
            if c >= least - 1e-9 and c > best[1] + 1e-9:
                best = (k, c)
    return best


def wrapped(text, width, lead=""):
    import textwrap

    return "\n".join(textwrap.wrap(text, width, initial_indent=lead, subsequent_indent=lead))


def test_licences_inheritance_and_cosine(spark):
    from pyspark.sql import functions as F

    full = licences.full_texts()
    files = [("r/LICENSE", "Licensed under CC BY-NC 4.0."), ("r/a/b/x.py", prose(1, 50)), ("r/a/LICENSE.txt", "Copyright (c) 2024 Someone\n\n" + wrapped(full["MIT"][0], 70)), ("r/c/y.py", "code\nReleased under the MIT license\nmore code " + prose(2, 20)), ("q/z.py", prose(3, 30)), ("r/w.py", None), (None, "Released under the MIT License."), (None, None), ("r/e.py", ""), ("r/long.py", prose(4, 4000) + "\nLicensed under the Apache License, Version 2.0.")]
    files += [("g/COPYING", full["GPL-2.0"][0]), ("g/src/deep/x.c", prose(5, 9)), ("h/LICENSE", full["Apache-2.0"][0]), ("h/x.c", prose(6, 9)), ("i/x.c", prose(7, 30) + "\n" + wrapped(licences._MIT, 76, " * ") + "\n" + prose(8, 30)), ("i/y.c", wrapped("Copyright 2020 by us. " + licences._ISC, 60, "# ")), ("i/z.c", "/* This work is licensed under the GNU\n * General Public License,\n * version 3. */\n" + prose(9, 40))]
    d = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)] + [(3, *files[3], "x")], "doc_id long, path string, text string, licence string")
    got = sorted(licences.license_scan(d, F.col("path")).collect(), key=lambda r: r.doc_id)
    by = {r.doc_id: (r.licence, r.origin, r.source_path) for r in got}
    assert len(got) == len(files) + 1
    assert by[0] == ("CC-BY-NC-4.0", "own", "r/LICENSE") and by[1] == ("MIT", "inherited", "r/a/LICENSE.txt") and by[3][:2] == ("MIT", "own")
    assert by[4] == (None, "none", None) and by[5] == ("CC-BY-NC-4.0", "inherited", "r/LICENSE") and by[6][:2] == ("MIT", "own") and by[7][1] == "none" and by[8][1] == "inherited" and by[9][:2] == ("Apache-2.0", "own")
    assert by[10][:2] == ("GPL-2.0", "own") and by[11] == ("GPL-2.0", "inherited", "g/COPYING") and by[12][:2] == ("Apache-2.0", "own") and by[13] == ("Apache-2.0", "inherited", "h/LICENSE")
    assert by[14][:2] == ("MIT", "own") and by[15][:2] == ("ISC", "own") and by[16][:2] == ("GPL-3.0", "own")
    every = files + [files[3]]
    for r in got:
        licence, score = brute_licence(*files[r.doc_id], every) if files[r.doc_id][1] else (None, 0)
        assert (r.origin == "own") == (licence is not None), r
        if licence:
            assert abs(r.score - score) < 2e-6, (r, licence, score)
    assert licences.license_scan(d.limit(0), F.col("path")).count() == 0


@pytest.mark.parametrize("licence", sorted(licences.full_texts()))
def test_whole_licences_are_told_apart(licence):
    """Each full text, wrapped anew under another copyright, is nearest to its own template, in corpora of any frequencies."""
    full = licences.full_texts()
    text = "Copyright (C) 1999 An Author <a@b.example>\n\n" + wrapped(full[licence][0], 50, "  ")
    n = 100_000
    for common in (0, 200):
        t = licences._Templates(licences.TEMPLATES, full)
        df = {i: n * 9 // 10 if i % 1000 < common else 30 for i in range(len(t.vocab))}
        t = licences._Templates(licences.TEMPLATES, full, n, df)
        h = licences._hashes(text)
        k, cos = t.whole(t.lookup.find(h), np.array([0, len(h)]))
        assert t.names[k[0]] == licence and cos[0] > 0.9


def test_kernel_words_and_hashes():
    import pyarrow as pa

    data, offs = kernel.raw(pa.array(["Él Niño_1 foo-bar", "", None, "x", "él  niño_1"]))
    h, s, e, first = kernel.words(data, offs)
    assert first.tolist() == [0, 4, 4, 4, 5, 7] and (h[:2] == h[5:]).all() and len(set(h.tolist())) == 5
    r = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    look = kernel.Lookup(r)
    assert (look.find(r) == np.arange(len(r))).all() and (look.find(r + np.uint64(1)) == -1).all()
    assert (kernel.Lookup(r[:0]).find(r) == -1).all()


def test_chat_sql_agrees_on_conflicts(spark, tmp_path):
    import duckdb

    from tremorlake.llm.queries import CHAT_SQL

    r = random.Random(4)
    bits = ["<", "|", "\\", ">", "\n", "a", " ", chat.START, chat.END, chat.NULL, chat.LINE]
    rows = [(i, t, "".join(r.choice(bits[5:] if r.random() < 0.8 else bits) for _ in range(2)), "".join(r.choice(bits) for _ in range(r.randrange(0, 6)))) for i in range(300) for t in range(3)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d.write.parquet(str(tmp_path / "c"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = {x[0]: x[1:] for x in c.execute(f"SELECT conv_id, n_turns, n_escaped, rendered FROM ({CHAT_SQL})").fetchall()}
    got = {x.conv_id: (x.n_turns, x.n_escaped, x.rendered) for x in chat.chat_format(d).collect()}
    bad = [k for k in got if got[k] != want[k]]
    assert not bad, (len(bad), rows[3 * bad[0] : 3 * bad[0] + 3], got[bad[0]], want[bad[0]])


def test_line_dedup_sql_agrees(spark, small):
    import duckdb

    from tremorlake.llm.queries import LINE_DEDUP_SQL, op9_line_dedup

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = {x[0]: x[1:] for x in c.execute(f"SELECT doc_id, text, lang, source, n_chars FROM ({LINE_DEDUP_SQL})").fetchall()}
    assert {r.doc_id: tuple(r)[1:] for r in op9_line_dedup(spark, small).select("doc_id", "text", "lang", "source", "n_chars").collect()} == want
