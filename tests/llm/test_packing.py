import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veldspar.llm.packing import END, WordTokenizer, pack, sum_of_squares

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "", "a", "Hello, world! It's 42% done...", "don't we'll I'M THE END's", "naïve Çédille ÀÉÎ", "tab\tnew\nline\r\nend", "日本語 mixed", "ΑΣ sigma", "<|endoftext|> special",
    "“quoted” – dash… ‘x’", "İstanbul ıi ſtrange", "1234 a1b2 ½ ²", "\x00ctl\x1cx", "a b c", "écombining", "#$%***&&& !!! a---b", "'s 't 'll ''ve", "x" * 300,
]


def test_tokenizer_equals_the_library():
    w = WordTokenizer(PATH, most_chunks=5, most_words=5)
    for _ in range(2):  # with and without what is remembered
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in w.encode_all(TEXTS)] == [plain(t) for t in TEXTS]


def check(rows, got, capacity):
    by_row = {}
    spans = {}
    for r in got:
        by_row.setdefault(r["id"], []).append(r)
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    for i, t in rows:
        ids = [*plain(t), END]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_row[i])
        want = [(k, k * capacity, len(part := ids[k * capacity : (k + 1) * capacity]), zlib.crc32(np.array(part, dtype="<u4").tobytes())) for k in range(-(-len(ids) // capacity))]
        assert [x for x in own if x in want] == own and set(own) == set(want)
    return len(spans)


def test_pack(docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    got = pack(docs, PATH).collect()
    check(rows, [r for r in got], 4096)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) + 2
    assert sum(1 for r in got if r["id"] == 1 and r["piece"] == 0) == 2  # a repeated row is packed twice
    assert pack(no_docs, PATH).count() == 0


def test_several_groups_number_their_sequences_apart(docs):
    got = pack(docs, PATH, group_pieces=4).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096 and sum(fill.values()) == sum(r["length"] for r in got)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_sum_of_squares_places_everything(lengths):
    a = np.array(sorted(lengths, reverse=True))
    where, offset = sum_of_squares(a, 64)
    fill = np.bincount(where, weights=a)
    assert fill.max() <= 64 and len(fill) <= -(-a.sum() * 11 // (9 * 64)) + 4
    for b in range(len(fill)):
        own = np.argsort(offset[where == b])
        assert (np.cumsum(a[where == b][own]) - a[where == b][own]).tolist() == offset[where == b][own].tolist()


def test_packed_ids_come_out(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    for r in pack(docs, PATH, group_pieces=4).collect():
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        if r["id"] is not None:
            assert ids == [*plain(texts[r["id"]]), END][r["start"] : r["start"] + r["length"]]


def plain_sum_of_squares(lengths, capacity):
    """Each length to the place after which the squares sum to the least, by trying them all."""
    count, gaps, out = [0] * (capacity + 1), [], []
    for s in lengths:
        best = None
        for gap in [*range(s, capacity), None]:  # an open gap, smallest first, or a new bin
            if gap is not None and not count[gap]:
                continue
            after = list(count)
            left = (capacity if gap is None else gap) - s
            if gap is not None:
                after[gap] -= 1
            if left:
                after[left] += 1
            total = sum(x * x for x in after)
            if best is None or total < best[0]:
                best = (total, gap, after)
        count = best[2]
        if best[1] is None:
            gaps.append(capacity - s)
            out.append((capacity, capacity - s))
        else:
            out.append((best[1], best[1] - s))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=60))
def test_each_piece_goes_where_the_squares_sum_to_the_least(lengths):
    where, offset = sum_of_squares(np.array(lengths), 16)
    assert [(16 - o, 16 - o - n) for o, n in zip(offset.tolist(), lengths, strict=True)] == plain_sum_of_squares(lengths, 16)


def test_full_pieces_are_sequences_of_their_own(spark):
    df = spark.createDataFrame([(1, "word " * 9000), (2, "word " * 4095), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = pack(df, PATH, group_pieces=2).collect()
    full = [r["sequence_id"] for r in got if r["length"] == 4096]
    assert len(full) == 3 and len(set(full)) == 3 and not set(full) & {r["sequence_id"] for r in got if r["length"] < 4096}
    check([(1, "word " * 9000), (2, "word " * 4095)], got, 4096)


def test_a_word_is_encoded_once_for_all_texts(monkeypatch):
    """Words known from earlier texts or other chunks of the same ones are not encoded again."""
    seen = []
    encode = WordTokenizer._encode_words
    monkeypatch.setattr(WordTokenizer, "_encode_words", lambda self, words: seen.append(sorted(words)) or encode(self, words))
    w = WordTokenizer(PATH)
    texts = ["Alpha beta.", "(alpha) beta, gamma\n beta", "  ", "gamma. delta\t"]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in w.encode_all(texts)] == [plain(t) for t in texts]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in w.encode_all(texts[::-1])] == [plain(t) for t in texts[::-1]]
    assert seen == [["(", ")", ",", ".", "alpha", "beta", "delta", "gamma"], []]


def test_a_worker_keeps_its_tokenizer():
    from veldspar.llm.packing import coder_of

    assert coder_of(PATH) is coder_of(PATH)
