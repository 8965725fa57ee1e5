"""Substring dedup of byte windows with a range-partitioned suffix array.

Only suffixes that can start a repeated window enter the array: those whose anchor gram is
repeated. Sampled splitters on the gram's leading bytes deal stretches of text with such
suffixes to buckets, so equal windows meet in one bucket and no run of equal ones spans a
boundary. A bucket puts its suffixes in the order of their text: stretches of 8 bytes get
their rank among all, twice as long ones the rank of their two halves, as in prefix doubling,
and a multikey sort by the ranks that make up a window, longest stretch first, refines ties.
Ranks are exact, so equal neighbours are equal in every byte. Hashes only find out beforehand
which stretches can have an equal at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Texts, blocks_of, by_gram, mix, repeated_anchors, runs_of
from .common import materialise, shuffle_partitions
from .word_spans import PART_ROWS, REMOVED, REMOVED_DDL, gaps, listed, merged

WINDOW = 400
GRAM = 32
#: Repeated anchors that one bucket holds on average, where the cluster's shuffle partitions are
#: too few. A bucket of any size is read in parts of whole grams.
BUCKET_ANCHORS = 1 << 17
#: Bytes of fragments whose windows a bucket compares at a time, unless one gram has more.
PART_BYTES = 1 << 21


def _joined(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return b"".join(parts), np.cumsum(lengths) - lengths, lengths


def words8(data: bytes, order: str = "<") -> np.ndarray:
    """The 8 bytes from each position on as a number."""
    if len(data) < 8:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray(shape=(len(data) - 7,), dtype=f"{order}u8", buffer=data, strides=(1,)).astype(np.uint64)


def _double(h: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Names of two adjacent stretches of `step` from names of one."""
    c = mix(np.array([2 * seed + 1, 2 * seed + 2], dtype=np.uint64)) | np.uint64(1)
    return mix(h[:-step] * c[0] + h[step:] * c[1]) if len(h) > step else np.zeros(0, dtype=np.uint64)


def gram_hashes(data: bytes) -> np.ndarray:
    """Name of the 32 bytes from each position on."""
    h = mix(words8(data))
    return _double(_double(h, 8, 1), 16, 2)


def _grams(texts: list[str]):
    data, starts, lengths = _joined(texts)
    big = np.frombuffer(data, dtype=np.uint8)

    def lead(a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(7):
            out = (out << 8) | big[a + k]
        return out

    return gram_hashes(data), lead, starts, lengths


def window_digits(data: bytes, window: int) -> list[np.ndarray]:
    """Names whose stretches together cover exactly the `window` bytes from a position on."""
    h, names = mix(words8(data)), {}
    step, seed = 8, 1
    while step <= window:
        names[step] = h
        h = _double(h, step, seed)
        step, seed = step * 2, seed + 1
    digits, at, n = [], 0, max(0, len(data) - window + 1)
    for size in sorted(names, reverse=True):
        while at + size <= window:
            digits.append(names[size][at : at + n])
            at += size
    if at < window:
        digits.append(names[8][window - 8 : window - 8 + n])
    return digits


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct keys, in order."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))[: len(keys)]
    return out


def window_ranks(data: bytes, window: int) -> list[np.ndarray]:
    """As window_digits(), but ranks in the order of the text instead of names: exact."""
    rank, ranks, step = _ranks(words8(data, ">")), {}, 8
    while True:
        ranks[step] = rank
        if 2 * step > window or len(rank) <= step:
            break
        rank = _ranks(rank[:-step] * np.int64(len(rank) + 1) + rank[step:])
        step *= 2
    digits, at, n = [], 0, max(0, len(data) - window + 1)
    for size in sorted(ranks, reverse=True):
        while at + size <= window:
            digits.append(ranks[size][at : at + n])
            at += size
    if at < window:
        digits.append(ranks[8][window - 8 : window - 8 + n])
    return digits


def multikey_ties(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(members, group): the items whose digits all equal another item's, ordered by digits.

    One digit after another, as a multikey quicksort: items that a digit tells from all others
    are done, ties go on to the next digit.
    """
    items = np.arange(len(digits[0]))
    group = np.zeros(len(items), dtype=np.int64)
    for d in digits:
        key = d[items]
        order = np.lexsort((key, group)) if group.any() else np.argsort(key, kind="stable")
        items, group, key = items[order], group[order], key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))[: len(items)]
        group = np.cumsum(new) - 1
        tied = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
        items, group = items[tied], group[tied]
        if not len(items):
            break
    return items, group


#: A fragment's state: its block holds it once; more often, and this one stands for all; or
#: more often, and another one does.
ONCE, TWICE, TOLD = 0, 1, 2


def repeated_fragments(gram: np.ndarray, off: np.ndarray, cut: list[bytes], r1: np.ndarray, r2: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state of each fragment of a block; the same place again is no second place."""
    state, seen = np.zeros(len(gram), dtype=np.int32), {}
    for k, key in enumerate(zip(gram.tolist(), off.tolist(), cut, strict=True)):
        first = seen.setdefault(key, k)
        if first != k and (r1[first], r2[first], start[first]) != (r1[k], r2[k], start[k]):
            state[first], state[k] = TWICE, TOLD
    return state


def repeated_windows(texts: Texts, window: int = WINDOW) -> DataFrame:
    """(r1, r2, spans) of every text with bytes to go; spans: [first, beyond) byte positions.

    Copies of a text count as one place.
    """
    anchors = materialise(repeated_anchors(texts.table(), _grams, window, GRAM), "anchors")
    buckets = min(100_000, max(shuffle_partitions(anchors.sparkSession), -(-anchors.count() // BUCKET_ANCHORS)))
    cuts = anchors.agg(F.percentile_approx("lead", [k / buckets for k in range(1, buckets)] or [0.5], 20 * buckets)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)
    own = texts.met(listed(anchors)).select("content", "r1", "r2", "places")

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text under the windows of each repeated anchor."""
        names = ["bucket", "state", "gram", "r1", "r2", "start", "off", "bytes"]
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in blocks_of(texts, len):
                data, starts, lengths = _joined(texts[part])
                grams = gram_hashes(data)
                text, a, lo, hi = runs_of(grams, starts, lengths, window, GRAM)
                lists = b.column(3).slice(part.start, part.stop - part.start)
                at = np.asarray(lists.flatten()) + np.repeat(starts, np.diff(np.asarray(lists.offsets)))
                wanted = np.zeros(len(data) + 1, dtype=bool)
                wanted[at] = True
                use = np.flatnonzero(wanted[a])
                text, a, lo, hi = text[use], a[use], lo[use], hi[use]
                big = np.frombuffer(data, dtype=np.uint8)
                lead = np.zeros(len(a), dtype=np.int64)
                for k in range(7):
                    lead = (lead << 8) | big[a + k]
                keys = [b.column(k).to_numpy()[part][text] for k in (1, 2)]
                start, off = lo - starts[text], a - lo
                cut = [data[x:y] for x, y in zip(lo.tolist(), (hi + window).tolist(), strict=True)]
                state = repeated_fragments(grams[a], off, cut, *keys, start)
                # Of fragments that a block holds more than once, one goes to their bucket.
                bucket = np.where(state == TOLD, (mix(keys[0].view(np.uint64) + start.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), np.searchsorted(cuts, lead, side="right"))
                cols = [bucket, state, grams[a].view(np.int64), *keys, start, off]
                cut = [b"" if told else x for told, x in zip((state == TOLD).tolist(), cut, strict=True)]
                cols[-1] = np.where(state == TOLD, hi - lo + 1, off)  # of a told fragment: its windows
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(cut, pa.binary())], names)

    dealt = own.mapInArrow(fragments, "bucket long, state int, gram long, r1 long, r2 long, start long, off long, bytes binary")

    def bucket_rows(t: pa.Table) -> pa.Table:
        told = t.filter(pc.equal(t.column("state"), TOLD))
        t = t.filter(pc.not_equal(t.column("state"), TOLD)).combine_chunks()
        rest = {c: told.column(c).to_numpy() for c in ("r1", "r2", "start", "off")}
        known = spans_of(rest["r1"], rest["r2"], rest["start"], rest["start"] + rest["off"] - 1)
        col = {c: t.column(c).to_numpy() for c in ("state", "gram", "r1", "r2", "start", "off")}
        parts = t.column("bytes").to_pylist()
        n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) - window + 1
        # Equal fragments: all their windows repeat, and one of them stands for all.
        seen: dict[tuple[int, int, bytes], int] = {}
        same = np.fromiter((seen.setdefault(x, k) for k, x in enumerate(zip(col["gram"].tolist(), col["off"].tolist(), parts, strict=True))), dtype=np.int64, count=len(parts))
        whole = (np.bincount(same, minlength=len(parts))[same] > 1) | (col["state"] == TWICE)
        w = np.flatnonzero(whole)
        tables = [known, spans_of(col["r1"][w], col["r2"][w], col["start"][w], col["start"][w] + n[w] - 1)]
        one = np.flatnonzero(same == np.arange(len(parts)))
        if len(one):
            one = one[can_repeat([parts[k] for k in one])]
        if not whole[one].all():
            tables.append(equal_neighbours({c: v[one] for c, v in col.items()}, [parts[k] for k in one]))
        return pa.concat_tables(tables)

    def spans_of(r1: np.ndarray, r2: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
        return pa.table({"r1": r1, "r2": r2, "first": pa.array(first, pa.int32()), "beyond": pa.array(last + window, pa.int32())})

    def windows_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The part that each window is of, and its place in it."""
        n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) - window + 1
        row = np.repeat(np.arange(len(parts)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    def can_repeat(parts: list[bytes]) -> np.ndarray:
        """The parts with a window whose name another window has."""
        row, _ = windows_of(parts)
        pos = np.arange(len(row)) + row * (window - 1)
        name = np.zeros(len(row), dtype=np.uint64)
        for d in window_digits(b"".join(parts), window):
            name = mix(name * np.uint64(0x9E3779B97F4A7C15) + d[pos])
        order = np.argsort(name)
        same = name[order][1:] == name[order][:-1]
        tied = np.zeros(len(parts), dtype=bool)
        tied[row[order[1:][same]]] = tied[row[order[:-1][same]]] = True
        return np.flatnonzero(tied)

    def equal_neighbours(col: dict[str, np.ndarray], parts: list[bytes]) -> pa.Table:
        """Stretches of windows of distinct parts that equal another window in every byte."""
        row, inside = windows_of(parts)
        pos = np.arange(len(row)) + row * (window - 1)
        items, _ = multikey_ties([d[pos] for d in window_ranks(b"".join(parts), window)])
        hit = np.zeros(len(row) + 1, dtype=np.int8)
        hit[items] = 1
        # Stretches of consecutive hits within a fragment.
        stop = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, dtype=bool)
        before = np.concatenate(([0], np.where(stop, 0, hit[:-1])))[: len(row)]
        first = np.flatnonzero((hit[:-1] == 1) & (before == 0))
        last = np.flatnonzero((hit[:-1] == 1) & (np.where(stop, 0, hit[1:]) == 0))
        r = row[first]
        return spans_of(col["r1"][r], col["r2"][r], col["start"][r] + inside[first], col["start"][r] + inside[last])

    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "gram")
    spans = by_gram(bucket_rows, PART_BYTES, lambda b: pc.sum(pc.binary_length(b.column("bytes"))).as_py() or 0)
    found = ordered.mapInArrow(spans, "r1 long, r2 long, first int, beyond int")
    return found.groupBy("r1", "r2").agg(F.sort_array(F.collect_list(F.struct("first", "beyond"))).alias("spans"))


def dedup_byte_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept, removed.

    kept: the bytes that stay; removed: the (first, beyond) byte stretches that went.
    A byte goes if a window over it also starts anywhere else. A null text is empty. Texts
    shorter than the window lose nothing; a text with a copy (a repeated row counts as one)
    goes whole, if long enough. Very long texts are read whole, in blocks. An empty table
    gives an empty result; a null id stays null; other columns, whatever their names, are
    ignored.
    """
    texts = Texts(docs, key, text)
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
    alone = texts.met(texts.owners.filter("copies = 1"), repeated_windows(texts, window)).select(F.col("owner").alias("id"), "content", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), REMOVED]
        for b in (x.slice(k, PART_ROWS) for x in batches for k in range(0, x.num_rows, PART_ROWS)):
            out = []
            for t, spans in zip(b.column(1), b.column(2), strict=True):
                data = t.as_py().encode("utf-8", "surrogatepass")
                runs = merged(spans.as_py(), False, len(data))
                kept = b"".join(data[x:y] for x, y in gaps(runs, len(data)))
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, runs))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names)

    single = alone.mapInArrow(cut, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, {REMOVED_DDL}")
    # A text with a copy goes whole or, if shorter than the window, stays whole.
    n, gone = F.octet_length("content").cast("long"), F.octet_length("content") >= window
    kept = F.when(gone, F.lit(b"")).otherwise(F.col("content").cast("binary"))
    whole = F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("first"), n.alias("beyond")))).otherwise(F.array().cast("array<struct<first: long, beyond: long>>"))
    info = texts.met(texts.owners.filter("copies > 1")).select(
        "r1", "r2", "copies", n.alias("n_bytes"), F.when(gone, n).otherwise(F.lit(0)).cast("long").alias("n_removed"), gone.cast("long").alias("n_spans"), kept.alias("kept"), whole.alias("removed")
    )
    several = texts.told(materialise(info.withColumn("kept_sha256", F.sha2("kept", 256)), "copies"))
    return single.unionByName(several.select(*names))


def op2_dedup_byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without the 400-byte strings that start elsewhere, too."""
    return dedup_byte_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "removed").withColumnRenamed("id", "doc_id")
