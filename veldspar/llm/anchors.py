"""Anchors: the same few positions of equal windows, whichever text they stand in.

Of the grams in a window the one of least hash is the window's anchor (leftmost of equals).
Equal windows have the same anchor at the same offset, so windows can only be equal if they
share an anchor gram, and a window whose anchor gram occurs nowhere else is unique. Both
substring operators first find the repeated anchors and look at no other window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, materialise, release, shuffle_partitions

#: Characters of one vectorised block, unless one text is longer; a block's arrays take about
#: a hundred bytes for each.
BLOCK = 1 << 21
#: Bits that hold a position within a block in a sort key.
_POS_BITS = 27

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def combine(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each n consecutive values; shorter than h by n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out += h[i : i + m] * factors[i]
    return mix(out)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least (leftmost of equals) of each w consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    if len(h) > 1 << _POS_BITS and w < 1 << _POS_BITS:  # overlapping slices whose positions fit
        step = (1 << _POS_BITS) - w + 1
        return np.concatenate([sliding_argmin(h[k : k + step + w - 1], w) + k for k in range(0, n, step)])
    mask = np.uint64((1 << _POS_BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    blocks = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, w)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], front[w - 1 : w - 1 + n]) & mask).astype(np.int64)


def runs_of(grams: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, anchor, first window, last window).

    grams: hash of each gram of the texts' concatenation; starts, lengths: the texts' places
    in it. Positions are in the concatenation.
    """
    at = sliding_argmin(grams, window - gram + 1)
    many = np.maximum(lengths - window + 1, 0)
    total = int(many.sum())
    if not total:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    text = np.repeat(np.arange(len(lengths)), many)
    s = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)
    a = at[s]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [total])) - 1
    return text[new], a[new], s[new], s[last]


def row_key(content: Column) -> tuple[Column, Column]:
    """96 bits of the text's SHA-256 as two longs: the identity of a text."""
    hexed = F.sha2(content.cast("binary"), 256)
    return F.conv(F.substring(hexed, 1, 16), 16, -10).cast("long"), F.conv(F.substring(hexed, 17, 8), 16, 10).cast("long")


#: Texts of more than 1 / SHARE of all rows (and more than LEAST) are hot; there are SHARE at most.
SHARE, LEAST = 2048, 1000
#: Bytes kept of a hot text that is broadcast, at most: 8 MiB for all of them.
MAX_KEPT = 4096


class Texts:
    """A table's rows (id, r1, r2), and each distinct text once, in buckets by its identity.

    Texts move once, copies combined before; what is found out about them comes to them.
    owners: (r1, r2, owner, m, copies), the smallest id of a text (null if there is none), how
    many rows have it, and how many rows the text has. A null text is empty.
    """

    def __init__(self, docs: DataFrame, key: str, text: str):
        spark = docs.sparkSession
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("content"))
        r1, r2 = row_key(F.col("content"))
        keyed = rows.select("id", "content", r1.alias("r1"), r2.alias("r2"))
        self.rows = materialise(keyed.select("id", "r1", "r2"), "rows")
        self.buckets = shuffle_partitions(spark)
        self.contents = Bucketed(keyed.groupBy("r1", "r2").agg(F.first("content").alias("content")), self.buckets, "r1", "r2")
        alike = self.rows.groupBy("r1", "r2", "id").agg(F.count(F.lit(1)).alias("m"))
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "m")).alias("least")
        owners = alike.groupBy("r1", "r2").agg(least, F.sum("m").alias("copies"))
        self.owners = materialise(owners.select("r1", "r2", F.col("least.id").alias("owner"), F.col("least.m").alias("m"), "copies"), "owners")

    def table(self) -> DataFrame:
        """(r1, r2, content)"""
        return self.contents.table()

    def met(self, *others: DataFrame) -> DataFrame:
        """The texts joined with tables that have r1 and r2: inner the first, left the others."""
        out = self.table()
        for k, other in enumerate(others):
            out = out.join(other.hint("shuffle_hash"), ["r1", "r2"], "left" if k else "inner")
        return out

    def told(self, info: DataFrame) -> DataFrame:
        """All rows of the texts of info (r1, r2, copies, kept, ..), a hot text's where they are:
        hot texts of which little is kept are few and short enough to broadcast."""
        limit = max(LEAST, self.rows.count() // SHARE)
        names = [c for c in info.columns if c not in ("r1", "r2")]
        is_hot = (F.col("copies") > limit) & (F.octet_length("kept") <= MAX_KEPT)
        hot = info.filter(is_hot).select("r1", "r2", F.struct(*names).alias("hot"))
        tried = self.rows.join(F.broadcast(hot), ["r1", "r2"], "left")
        rest = tried.filter("hot is null").select("id", "r1", "r2").join(info.filter(~is_hot), ["r1", "r2"])
        return tried.filter("hot is not null").select("id", "r1", "r2", "hot.*").unionByName(rest)


def by_gram(handle: Callable[[pa.Table], pa.Table], limit: int, size: Callable[[pa.RecordBatch], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feeds rows that come in the order of their `gram` to handle, whole grams at a time, about
    `limit` of size together (more only where one gram has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have, due = 0, limit
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            have += size(b)
            if have < due:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            g = t.column("gram").to_numpy()
            other = np.flatnonzero(g != g[-1])
            if not len(other):
                due = 2 * have
                continue
            cut = int(other[-1]) + 1
            yield from handle(t.slice(0, cut)).to_batches()
            held = t.slice(cut).to_batches()
            have, due = sum(map(size, held)), limit
            due = max(due, 2 * have)
        if held:
            yield from handle(pa.Table.from_batches(held).combine_chunks()).to_batches()
        held = []
        release()

    return run


def blocks_of(texts: list, weight: Callable[[object], int]) -> Iterator[slice]:
    """Slices of texts whose weights sum to a block at most (one text at least)."""
    at = have = 0
    for k, t in enumerate(texts):
        n = weight(t)
        if have and have + n > BLOCK:
            yield slice(at, k)
            at, have = k, 0
        have += n
    if at < len(texts):
        yield slice(at, len(texts))


Grams = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


#: What the repeated-anchor step is to do with a row: tell whether its gram has two places;
#: only count it as a place; pass it on, its gram being known to have two.
ASKED, COUNTED, KNOWN = 0, 1, 2


def asked(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, kinds) for the anchors of a block: a gram that the block holds once is asked
    for; of one that it holds more often all rows are known and two are counted elsewhere."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))[: len(g)]
    n = np.diff(np.concatenate((first, [len(g)])))
    many = np.repeat(n > 1, n)
    twice = np.concatenate((first[n > 1], first[n > 1] + 1))
    rows = np.concatenate((order[~many], order[many], order[twice]))
    kinds = np.repeat(np.array([ASKED, KNOWN, COUNTED], dtype=np.int32), [int((~many).sum()), int(many.sum()), len(twice)])
    return rows, kinds


def repeated_anchors(texts: DataFrame, grams: Grams, window: int, gram: int) -> DataFrame:
    """(gram, lead, r1, loc) of every anchor whose gram stands in two places at least.

    loc: r2 in the upper, the anchor's position in the text in the lower 32 bits. Of a gram that a block of texts holds more than
    once, only two rows go to the gram's partition, the others to partitions of their own
    place: a very common gram does not gather. Equal rows may come more than once.
    texts: (content, r1, r2), each once.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            own1, own2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for part in blocks_of(texts, len):
                h, lead, starts, lengths = grams(texts[part])
                text, a, _, _ = runs_of(h, starts, lengths, window, gram)
                use, kind = asked(h[a])
                text, a = text[use], a[use]
                g, r, loc = h[a].view(np.int64), own1[part][text], (own2[part][text] << 32) | (a - starts[text])
                to = np.where(kind == KNOWN, mix(r.view(np.uint64) ^ mix(loc.view(np.uint64))).view(np.int64), g)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (to, kind, g, lead(a), r, loc))), ["to", "kind", "gram", "lead", "r1", "loc"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_out = None, False  # the last row so far; whether its gram has two places already
        names = ["gram", "lead", "r1", "loc"]
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(1, 6)]
            known = cols[0] == KNOWN
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in cols[1:]], names)
                cols = [c[~known] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(([x], c)) for x, c in zip(held, cols, strict=True)]
            kind, g, _, r1, loc = cols
            new_run = np.concatenate(([True], g[1:] != g[:-1]))
            first, run = np.flatnonzero(new_run), np.cumsum(new_run) - 1
            other = np.concatenate(([False], (r1[1:] != r1[:-1]) | (loc[1:] != loc[:-1]))) & ~new_run
            places = np.bincount(run, weights=other, minlength=len(first))
            out = other.copy()
            out[first[places > 0]] = True
            if held_out:
                out[0] = False
            held_out = bool(places[-1] > 0) or (len(first) == 1 and held_out)
            held = tuple(c[-1] for c in cols)
            out &= kind == ASKED
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols[1:]], names)

    kinds = "gram long, lead long, r1 long, loc long"
    found = texts.select("content", "r1", "r2").mapInArrow(emit, f"to long, kind int, {kinds}")
    dealt = found.repartition("to").sortWithinPartitions(F.col("kind") == KNOWN, "gram", "r1", "loc", "kind")
    return dealt.mapInArrow(repeated, kinds)
