"""Best-fit packing by sums of squares.

Each document is tokenized and cut into pieces of at most `capacity` ids. A piece goes to
the place (an open bin of some gap, or a new bin) after which the squared counts of open
bins per gap sum to the least; equal places prefer the smallest gap. Full pieces are sequences
of their own. The others are packed in groups of a bounded expected number, longest first; a
group leaves a few bins partly empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import blocks_of
from .common import materialise, release

CAPACITY = 4096
END = 1
#: Pieces, full ones apart, that one packing group holds on average.
GROUP_PIECES = 1 << 17

#: Characters for which the fast path is exact: printable ASCII, tab and newlines, Latin
#: letters whose lower case is one letter, and common typographic marks.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡¿«»À-ÖØ-öø-įı-ſ–—‘’“”…]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")
_WORDS_OR_BREAK = re.compile(_WORDS.pattern + "|\n")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's.

    The tokenizer lower-cases, splits at white space and word classes and encodes each word
    for itself, so words are encoded once and remembered up to a fixed number. Of the texts
    of a call each distinct chunk between white space is split once and each distinct word
    looked up once, and the texts' ids are gathered by number. Texts beyond the fast path's characters, or with a special token's string, go through the
    tokenizer whole. most_chunks has no effect any more.
    """

    def __init__(self, path: str, most_chunks: int = 0, most_words: int = 500_000):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.most_words = most_words
        self.words: dict[str, bytes] = {}
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """One call for many words: the id that ends a word says where the next one starts."""
        out = {}
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = np.array(self.t.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw, at = ids.tobytes(), 0
            for w, stop in zip(part, stops, strict=True):
                out[w] = raw[at:stop]
                at = stop
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if _PLAIN.fullmatch(text) and not any(x in text for x in _SPECIAL):
                plain.append(k)
            else:
                out[k] = np.array(self.t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        split = pc.ascii_split_whitespace(pa.array([texts[k].lower() for k in plain], pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        # The distinct chunks' words, a line break after each chunk.
        found = _WORDS_OR_BREAK.findall("\n".join([*_listed(chunks.dictionary), ""]))
        words = pa.array(found, pa.string()).dictionary_encode()
        ids = self._ids(_listed(words.dictionary))
        at = np.asarray(words.indices)
        breaks = np.flatnonzero(np.asarray(pc.equal(words.dictionary, "\n"))[at])
        long = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, stops = _gathered(np.frombuffer(b"".join(ids), dtype="<u4"), long, at)
        chunk_stops = stops[np.concatenate(([0], breaks + 1))]
        flat, stops = _gathered(flat, np.diff(chunk_stops), np.asarray(chunks.indices))
        raw, cuts = flat.tobytes(), (4 * stops[np.asarray(split.offsets)]).tolist()
        for k, x, y in zip(plain, cuts[:-1], cuts[1:], strict=True):
            out[k] = raw[x:y]
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, none of a line break."""
        ids = list(map(self.words.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        fresh = self._encode_words([w for i in gaps if (w := words[i]) != "\n"])
        for i in gaps:
            ids[i] = fresh.get(words[i], b"")
        room = self.most_words - len(self.words)
        if room > 0:
            self.words.update(fresh if len(fresh) <= room else dict(list(fresh.items())[:room]))
        return ids


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


_coders: dict[str, WordTokenizer] = {}


def coder_of(path: str) -> WordTokenizer:
    """The worker's tokenizer: it and the words it remembers outlive a task."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = WordTokenizer(path)
    return _coders[path]


def _gathered(flat: np.ndarray, long: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of flat, of the given lengths one after another, in the order of their numbers
    `at`; and where each begins in the result, with its end."""
    many = long[at]
    stops = np.concatenate(([0], np.cumsum(many)))
    return flat[np.repeat((np.cumsum(long) - long)[at] - stops[:-1], many) + np.arange(stops[-1])], stops


def pieces_of(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every row; a null text has the end id only.

    ids: the piece's token ids, 4 bytes each, least first."""

    def coded(b: pa.RecordBatch, coder: WordTokenizer) -> Iterator[tuple[bytes, int]]:
        texts, own = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
        for part in blocks_of(texts, len):
            yield from zip(coder.encode_all(texts[part]), own[part], strict=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, end = coder_of(path), np.array([END], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for ids, i in coded(b, coder):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "ids"])
        release()

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        cut, "id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; full bins don't count
    where, offset, bins = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        at = 0
        if s < capacity:
            old = count[s:capacity]
            # The change of the sum, halved: 1 - (bins at gap g) + (bins at gap g - s).
            gain = old - np.concatenate(([0], count[1 : capacity - s]))  # a filled bin leaves the counts
            gain = np.where(old > 0, gain, -(1 << 40))
            best = int(gain.argmax())
            if old[best] > 0 and gain[best] > -count[capacity - s]:
                at = s + best
        if at:
            b = open_bins[at].pop()
            count[at] -= 1
        else:
            b, at, bins = bins, capacity, bins + 1
        where[k], offset[k], gap = b, capacity - at, at - s
        if gap:
            open_bins[gap].append(b)
            count[gap] += 1
    return where, offset


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    where[order], offset[order] = sum_of_squares(lengths[order], capacity)
    return where, offset


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    ids: the piece's token ids, 4 bytes each, least first; a sequence is its pieces' ids by
    offset. They stay in the shared folder while the pieces are placed by length.

    A null text counts as empty and still has its end id; repeated rows are packed each for
    itself; a null identifier stays null. Pieces of very long texts may meet in different
    sequences; their full pieces move nowhere. An empty table gives an empty result; other
    columns, whatever their names, are ignored. Groups are dealt by a hash of the piece's
    values and row, so a source, length or text that holds many rows spreads.
    """
    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    parts = materialise(pieces_of(docs, path, key, text, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = parts.filter(F.col("length") == capacity).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = parts.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    dealt = rest.drop("ids").withColumn("g", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "row"), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable")
        where, offset = pack_group(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = where * groups + pdf["g"], offset
        return pdf[["row", "sequence_id", "offset"]]

    placed = dealt.groupBy("g").applyInPandas(fill, "row long, sequence_id long, offset long")
    return full.select(*columns).unionByName(rest.join(placed, "row").select(*columns))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids").withColumnRenamed("id", "doc_id")
