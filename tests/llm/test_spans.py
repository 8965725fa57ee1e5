"""Substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veldspar.llm.anchors import sliding_argmin
from veldspar.llm.byte_spans import dedup_byte_spans, multikey_ties
from veldspar.llm.word_spans import dedup_word_spans


def brute_bytes(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + window] for b in data for s in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for doc, text in order:
        w = split(text)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (doc, s))
    out = {}
    for doc, text in order:
        w = split(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (doc, s):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc, text] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return [out[r] for r in rows]


def test_bytes(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = dedup_byte_spans(docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(brute_bytes(rows, 400))
    assert sum(r["n_removed"] for r in got) > 0


def test_words(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = dedup_word_spans(docs).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute_words(rows, 20))
    assert sum(r["n_removed"] for r in got) > 0


def test_ids_are_kept(docs):
    for f in (dedup_byte_spans, dedup_word_spans):
        assert sorted((r["id"] is None, r["id"] or 0) for r in f(docs).collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())


def test_empty_table(no_docs):
    assert dedup_byte_spans(no_docs).count() == 0 and dedup_word_spans(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_argmin(values, w):
    h = (np.array(values, dtype=np.uint64) << np.uint64(40))
    want = [int(np.argmin(h[k : k + w])) + k for k in range(len(h) - w + 1)]
    assert sliding_argmin(h, w).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=40))
def test_multikey_ties(pairs):
    items, group = multikey_ties([np.array([p[k] for p in pairs], dtype=np.uint64) for k in (0, 1)])
    tied = Counter(pairs)
    assert sorted(items.tolist()) == [k for k, p in enumerate(pairs) if tied[p] > 1]
    assert len({(g, pairs[i]) for g, i in zip(group.tolist(), items.tolist(), strict=True)}) == len({g for g in group.tolist()}) == len([p for p in tied if tied[p] > 1])


def repetitive(seed, n):
    """Texts from few words, with stretches taken from each other and periodic runs."""
    import random

    rng = random.Random(seed)
    texts = []
    for k in range(n):
        t = [rng.choice(["aa", "b", "ccc", "dd", "e", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 90))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts).split()
            at = rng.randrange(len(other) + 1)
            t[rng.randrange(len(t) + 1) : 0] = other[at : at + rng.randint(5, 60)]
        if rng.random() < 0.2:
            t += ["x", "yy"] * rng.randint(5, 40)
        texts.append(" ".join(t) + rng.choice(["", " ", "."]))
    ids = [rng.choice([k, k, k, k + 1000]) for k in range(n)]
    return list(dict(zip(ids, texts, strict=True)).items())


def test_repetitive_texts_in_small_blocks(spark, monkeypatch):
    from veldspar.llm import anchors, byte_spans, word_spans

    monkeypatch.setattr(anchors, "BLOCK", 400)
    monkeypatch.setattr(byte_spans, "PART_BYTES", 1000)
    monkeypatch.setattr(byte_spans, "BUCKET_ANCHORS", 20)
    monkeypatch.setattr(word_spans, "PART_NODES", 50)
    rows = repetitive(1, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["id"]: r for r in dedup_word_spans(df, window=8).collect()}
    for (i, _), want in zip(rows, brute_words(rows, 8), strict=True):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == want
    got = {r["id"]: r for r in dedup_byte_spans(df, window=64).collect()}
    for (i, _), want in zip(rows, brute_bytes(rows, 64), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


def test_kept_text_and_removed_spans_come_out(docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for f, split, glue in ((dedup_byte_spans, lambda t: [t[k : k + 1] for k in range(len(t))], b""), (dedup_word_spans, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t), b" ")):
        some = 0
        for r in f(docs).collect():
            kept = bytes(r["kept"]) if f is dedup_byte_spans else r["kept"].encode()
            assert hashlib.sha256(kept).hexdigest() == r["kept_sha256"]
            assert sum(s["beyond"] - s["first"] for s in r["removed"]) == r["n_removed"] and len(r["removed"]) == r["n_spans"]
            if r["id"] is not None:
                parts = split(texts[r["id"]].encode())
                for s in reversed(r["removed"]):
                    del parts[s["first"] : s["beyond"]]
                assert glue.join(parts) == kept
                some += bool(r["removed"]) and bool(kept)
        assert some


def test_sliding_argmin_of_more_values_than_positions_fit(monkeypatch):
    from veldspar.llm import anchors

    monkeypatch.setattr(anchors, "_POS_BITS", 5)
    h = np.random.default_rng(2).integers(0, 40, 500).astype(np.uint64) << np.uint64(40)
    for w in (1, 3, 20, 31):
        assert sliding_argmin(h, w).tolist() == [int(np.argmin(h[k : k + w])) + k for k in range(len(h) - w + 1)]


def test_ranks_order_windows_as_their_text():
    import random

    from veldspar.llm.byte_spans import window_ranks

    rng = random.Random(3)
    for window in (8, 20, 64, 100):
        data = bytes(rng.choice(b"ab\xff") for _ in range(300)) * 2
        digits = window_ranks(data, window)
        keys = list(zip(*(d.tolist() for d in digits), strict=True))
        texts = [data[k : k + window] for k in range(len(data) - window + 1)]
        assert len(keys) == len(texts)
        for a in range(0, len(texts), 7):
            for b in range(0, len(texts), 5):
                assert (keys[a] < keys[b], keys[a] == keys[b]) == (texts[a] < texts[b], texts[a] == texts[b])


def test_repeated_spans_stand_at_their_sources(spark):
    from veldspar.llm.word_spans import repeated_spans

    rows = repetitive(4, 60)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=8).collect()
    assert got
    for r in got:
        own, n = words[r["id"]], r["beyond"] - r["first"]
        assert n >= 8 and words[r["source_id"]][r["source_first"] : r["source_first"] + n] == own[r["first"] : r["beyond"]]
        assert (r["source_id"], r["source_first"]) < (r["id"], r["first"])
    # One long passage taken whole is one path, whatever anchors it has.
    a, b = " ".join(f"x{k}" for k in range(400)), " ".join(f"y{k}" for k in range(50))
    one = repeated_spans(spark.createDataFrame([(1, a), (2, f"{b} {a} {b}z")], "doc_id long, text string"), window=8).collect()
    assert [(r["id"], r["first"], r["beyond"], r["source_id"], r["source_first"]) for r in one if r["beyond"] - r["first"] > 100] == [(2, 50, 450, 1, 0)]


def test_hot_copies(spark, monkeypatch):
    """A text in most rows, short and long, with ids repeated and null."""
    from veldspar.llm import anchors

    monkeypatch.setattr(anchors, "LEAST", 5)
    monkeypatch.setattr(anchors, "SHARE", 4)
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(k, long) for k in range(40)] + [(k, "short text") for k in range(50, 90)] + [(3, long), (None, long), (None, "short text"), (100, long + " more"), (101, "own"), (50, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_word_spans(df).collect())
    assert got == sorted(brute_words(rows, 20))
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup_byte_spans(df).collect())
    assert got == sorted(brute_bytes(rows, 400))


def test_a_very_long_text(spark):
    """One text of a million words with passages of others, read in blocks."""
    import random

    rng = random.Random(9)
    parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(3)]
    filler = lambda n, k: " ".join(f"f{k}x{j}" for j in range(n))
    rows = [(1, parts[0]), (2, parts[1]), (5, f"{filler(400_000, 1)} {parts[0]} {filler(300_000, 2)} {parts[1]} {filler(300_000, 3)} {parts[2]}"), (7, parts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in dedup_word_spans(df).collect()}
    assert {i: r["n_removed"] for i, r in got.items()} == {1: 0, 2: 0, 5: 240, 7: 120}
    got = {r["id"]: r for r in dedup_byte_spans(df).collect()}
    assert [got[i]["n_removed"] >= len(t) for i, t in ((1, parts[0]), (2, parts[1]), (7, parts[2]))] == [True] * 3 and sum(map(len, parts)) <= got[5]["n_removed"] <= sum(map(len, parts)) + 12


def test_a_part_of_told_paths_only():
    """A bucket's part may hold no path that still has to find its sources."""
    import pyarrow as pa

    from veldspar.llm.word_spans import pieces

    ints = {c: pa.array([v], pa.int64()) for c, v in (("gram", 1), ("r1", 9), ("r2", 8), ("owner", 2), ("start", 4), ("off", 0), ("s1", 7), ("s2", 6), ("at", 30))}
    got = pieces(pa.table({"told": pa.array([True]), **ints, "nodes": pa.array([[11, 12, 13]], pa.list_(pa.int64()))}))
    assert got.to_pylist() == [{"r1": 9, "r2": 8, "first": 4, "n": 2, "s1": 7, "s2": 6, "at": 30}]
