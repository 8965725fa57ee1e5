"""Substring dedup of word windows by De Bruijn compaction.

Nodes of the graph are the sequences of one word less than a window, edges the windows: an
edge leads from its first words to its last. Anchor grams find the edges that can repeat; a
run of consecutive edges with one anchor travels as one row, the path of its nodes. Paths meet
in buckets by their anchor gram, where every edge has all its sources. There each node's
distinct edges in and out are counted, and edges of one source that follow each other over a
node of one edge in and one out, with as many sources each, become one piece. Each later
source of a piece is told with the coordinates (text, word) of the earliest. Pieces of a text
whose sources go on without a gap, too, are compacted into maximal paths across buckets, and
the coordinates say which words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import Texts, blocks_of, by_gram, combine, mix, repeated_anchors, runs_of
from .common import SPACES, materialise, shuffle_partitions

WINDOW = 20
#: Rows whose kept text is built at a time.
PART_ROWS = 500
REMOVED = pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())]))
REMOVED_DDL = "removed array<struct<first: long, beyond: long>>"
GRAM = 5
#: Nodes that a bucket compares at a time, unless one gram has more.
PART_NODES = 1 << 19

_SPLIT = bytes(32 if b in SPACES else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text in UTF-8."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPLIT).split(b" ") if w]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of the texts, one after another; the texts' starts and lengths."""
    split = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = [w for ws in split for w in ws]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=np.uint64, count=len(flat))
    return h, np.cumsum(lengths) - lengths, lengths


def _grams(texts: list[str]):
    h, starts, lengths = word_hashes(texts)
    return combine(h, GRAM, 1), lambda a: np.zeros(len(a), dtype=np.int64), starts, lengths


def listed(anchors: DataFrame) -> DataFrame:
    """(r1, r2, places) with the sorted positions of a text's repeated anchors."""
    place = F.col("loc").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    r2 = F.shiftrightunsigned("loc", 32)
    return anchors.groupBy("r1", r2.alias("r2")).agg(F.sort_array(F.array_distinct(F.collect_list(place))).alias("places"))


def repeated_paths(gram: np.ndarray, off: np.ndarray, nodes: np.ndarray, ends: np.ndarray, owner: pa.Array, r1: np.ndarray, r2: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each path of a block the number of the earliest equal one in the block."""
    nulls = np.asarray(owner.is_null()).astype(np.int8)
    order = np.lexsort((start, r2, r1, np.asarray(owner.fill_null(0)), nulls))
    raw, cut = nodes.tobytes(), (ends * 8).tolist()
    source, seen = np.arange(len(gram)), {}
    for k, g, o in zip(order.tolist(), gram[order].tolist(), off[order].tolist(), strict=True):
        source[k] = seen.setdefault((g, o, raw[cut[k] : cut[k + 1]]), k)
    same = (r1[source] == r1) & (r2[source] == r2) & (start[source] == start)
    return np.where(same, np.arange(len(gram)), source)


PIECE = "r1 long, r2 long, first int, n int, s1 long, s2 long, at int"


def pieces(t: pa.Table) -> pa.Table:
    """The repeated pieces of a bucket's paths in their later sources, each with the earliest.

    t: (told, gram, r1, r2, owner, start, off, s1, s2, at, nodes); of told paths the whole is
    later than (s1, s2, at).
    """
    col = {c: t.column(c).to_numpy() for c in ("told", "gram", "r1", "r2", "start", "off", "s1", "s2", "at")}
    owner = t.column("owner").combine_chunks()
    nulls, owner = np.asarray(owner.is_null()).astype(np.int8), np.asarray(owner.fill_null(0))
    lists = t.column("nodes").combine_chunks()
    nodes, many = np.asarray(lists.flatten()).view(np.uint64), np.diff(np.asarray(lists.offsets))
    n = many - 1  # edges of each path
    row = np.repeat(np.arange(t.num_rows), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    tail = np.repeat(np.cumsum(many) - many, n) + inside
    start, told = col["start"][row] + inside, col["told"][row]
    # Equal edges have one anchor at one offset.
    place = mix(col["gram"][row].view(np.uint64) + (col["off"][row] - inside).astype(np.uint64))
    name = mix(nodes[tail] * np.uint64(3) + nodes[tail + 1]) ^ place
    use = np.flatnonzero(~told)
    by = row[use]
    order = use[np.lexsort((start[use], col["r2"][by], col["r1"][by], owner[by], nulls[by], name[use]))]
    run = np.concatenate(([True], name[order][1:] != name[order][:-1]))[: len(order)]
    edge = np.full(len(row), -1, dtype=np.int64)
    edge[order] = np.cumsum(run) - 1
    first = order[run]  # each edge's earliest source
    # An equal row again (the same place) is no other source.
    alike = lambda x, y: (col["r1"][row[x]] == col["r1"][row[y]]) & (col["r2"][row[x]] == col["r2"][row[y]]) & (start[x] == start[y])
    sources = np.bincount(edge[order], weights=run | ~alike(order, np.concatenate((order[:1], order[:-1]))), minlength=len(first)).astype(np.int64)
    earliest = first[edge[use]]
    s1, s2, at = (np.zeros(len(row), dtype=np.int64) for _ in range(3))
    s1[use], s2[use], at[use] = col["r1"][row[earliest]], col["r2"][row[earliest]], start[earliest]
    later = told.copy()
    later[use] = ~alike(use, earliest)
    t_at = np.flatnonzero(told)
    s1[t_at], s2[t_at], at[t_at] = col["s1"][row[t_at]], col["s2"][row[t_at]], col["at"][row[t_at]] + inside[t_at]
    # Distinct edges into and out of each node.
    names, flat = np.unique(nodes, return_inverse=True)
    out, into = (np.bincount(flat[x], minlength=len(names)) for x in (tail[first], tail[first] + 1))
    plain = (out == 1) & (into == 1)
    goes_on = np.zeros(len(row), dtype=bool)
    if len(row):
        count = np.append(sources, 0)[edge]  # of told paths, which may be all there are, 0
        smooth = plain[flat[tail[1:]]] & (count[1:] == count[:-1])
        follows = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1]) & (at[1:] == at[:-1] + 1)
        goes_on[1:] = (row[1:] == row[:-1]) & later[1:] & later[:-1] & follows & (told[1:] | smooth)
    begin = np.flatnonzero(later & ~goes_on)
    length = np.diff(np.concatenate((np.flatnonzero(~goes_on), [len(row)])))[later[~goes_on]] if len(row) else begin
    r = row[begin]
    return pa.table({
        "r1": col["r1"][r], "r2": col["r2"][r], "first": pa.array(start[begin], pa.int32()), "n": pa.array(length, pa.int32()), "s1": s1[begin], "s2": s2[begin], "at": pa.array(at[begin], pa.int32()),
    })


def later_paths(texts: Texts, window: int = WINDOW) -> DataFrame:
    """(r1, r2, first, beyond, s1, s2, at): the maximal stretches of a text's words [first, beyond)
    that stand earlier, at word `at` of the text (s1, s2). Of a text in several rows the one of
    smallest id counts."""
    anchors = materialise(repeated_anchors(texts.table(), _grams, window, GRAM), "anchors")
    own = texts.met(listed(anchors), texts.owners.select("r1", "r2", "owner")).select("content", "r1", "r2", "owner", "places")
    buckets = 64 * shuffle_partitions(anchors.sparkSession)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of edges whose anchor is repeated, as the nodes they go through."""
        names = ["bucket", "told", "gram", "r1", "r2", "owner", "start", "off", "s1", "s2", "at", "nodes"]
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in blocks_of(texts, len):
                h, starts, lengths = word_hashes(texts[part])
                grams = combine(h, GRAM, 1)
                text, a, lo, hi = runs_of(grams, starts, lengths, window, GRAM)
                lists = b.column(4).slice(part.start, part.stop - part.start)
                at = np.asarray(lists.flatten()) + np.repeat(starts, np.diff(np.asarray(lists.offsets)))
                wanted = np.zeros(len(h) + 1, dtype=bool)
                wanted[at] = True
                use = np.flatnonzero(wanted[a])
                text, a, lo, hi = text[use], a[use], lo[use], hi[use]
                node = combine(h, window - 1, 2)
                n = hi - lo + 2
                ends = np.concatenate(([0], np.cumsum(n)))
                flat = np.arange(int(ends[-1])) - np.repeat(ends[:-1], n) + np.repeat(lo, n)
                owner = b.column(3).slice(part.start, part.stop - part.start).take(pa.array(text))
                r1, r2 = (b.column(k).to_numpy()[part][text] for k in (1, 2))
                g, start, off, nodes = grams[a], lo - starts[text], a - lo, node[flat]
                source = repeated_paths(g, off, nodes, ends, owner, r1, r2, start)
                told = source != np.arange(len(source))
                # A path that stands earlier in this block needs no bucket of its gram.
                bucket = np.where(told, mix(r1.view(np.uint64) + start.astype(np.uint64)), mix(g)) % np.uint64(buckets)
                zero = lambda x: np.where(told, x, 0)
                cols = [pa.array(bucket.astype(np.int64)), pa.array(told), pa.array(g.view(np.int64)), pa.array(r1), pa.array(r2), owner, pa.array(start), pa.array(off)]
                cols += [pa.array(zero(r1[source])), pa.array(zero(r2[source])), pa.array(zero(start[source])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(nodes.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = "bucket long, told boolean, gram long, r1 long, r2 long, owner long, start long, off long, s1 long, s2 long, at long, nodes array<long>"
    ordered = own.mapInArrow(paths, kinds).repartition("bucket").sortWithinPartitions("gram")
    found = ordered.mapInArrow(by_gram(pieces, PART_NODES, lambda b: len(b.column(11).flatten())), PIECE)
    # Across buckets: a piece that goes on where its predecessor ends, in the text and in the
    # source, belongs to the same path.
    w = Window.partitionBy("r1", "r2").orderBy("first")
    before = [F.lag(c).over(w) for c in ("s1", "s2")]
    on = (F.lag(F.col("first") + F.col("n")).over(w) == F.col("first")) & (F.lag(F.col("at") + F.col("n")).over(w) == F.col("at")) & (before[0] == F.col("s1")) & (before[1] == F.col("s2"))
    starts = found.withColumn("new", (~F.coalesce(on, F.lit(False))).cast("int")).withColumn("path", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = starts.groupBy("r1", "r2", "path").agg(F.min(F.struct("first", "s1", "s2", "at")).alias("f"), F.max(F.col("first") + F.col("n")).alias("end"))
    return whole.select("r1", "r2", "f.first", (F.col("end") + (window - 1)).alias("beyond"), "f.s1", "f.s2", "f.at")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, first, beyond, source_id, source_first): every maximal stretch of a text's words that
    stands earlier, and where. Copies of a text are not told one by one."""
    texts = Texts(docs, key, text)
    ids = texts.owners.select("r1", "r2", F.col("owner").alias("id"))
    found = later_paths(texts, window).join(ids, ["r1", "r2"])
    source = ids.select(F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.col("id").alias("source_id"))
    return found.join(source, ["s1", "s2"]).select("id", "first", "beyond", "source_id", F.col("at").alias("source_first"))


def merged(spans: list[dict] | None, whole: bool, n: int) -> list[dict]:
    """Sorted spans as disjoint stretches, or all n as one."""
    if whole:
        return [{"first": 0, "beyond": n}]
    out: list[dict] = []
    for s in spans or ():
        if out and s["first"] <= out[-1]["beyond"]:
            out[-1]["beyond"] = max(out[-1]["beyond"], s["beyond"])
        else:
            out.append(dict(s))
    return out


def gaps(runs: list[dict], n: int) -> list[tuple[int, int]]:
    """What of n lies between disjoint stretches."""
    at = [0, *(x for r in runs for x in (r["first"], r["beyond"])), n]
    return list(zip(at[::2], at[1::2], strict=True))


def dedup_word_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_removed, n_spans, kept_sha256, kept, removed.

    kept: the words that stay, joined by a space; removed: the (first, beyond) stretches of
    words that went.
    A word goes if a window over it has the same words as a window that starts earlier
    (smaller id; null after all others; same id, earlier start). A null text has no words.
    Texts shorter than the window lose nothing; rows repeated with id and text are one
    document and are treated alike; copies of a text under a larger id go whole. Very long
    texts are read whole, in blocks. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    texts = Texts(docs, key, text)
    spans = later_paths(texts, window).groupBy("r1", "r2").agg(F.sort_array(F.collect_list(F.struct("first", "beyond"))).alias("spans"))
    names = ["n_words", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), REMOVED]
    ddl = f"n_words long, n_removed long, n_spans long, kept_sha256 string, kept string, {REMOVED_DDL}"

    def cut(copies: bool):
        """Rows (content, spans, ..) without the spans, or copies (content, ..), which go whole."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = 1 if copies else 2
            for b in (x.slice(k, PART_ROWS) for x in batches for k in range(0, x.num_rows, PART_ROWS)):
                out = []
                for k, t in enumerate(b.column(0)):
                    words = words_of(t.as_py())
                    n = len(words)
                    runs = merged(None if copies else b.column(1)[k].as_py(), copies and n >= window, n)
                    keep = [w for x, y in gaps(runs, n) for w in words[x:y]]
                    kept = b" ".join(keep)
                    out.append((n, n - len(keep), len(runs), hashlib.sha256(kept).hexdigest(), kept, runs))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*b.columns[own:], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*b.schema.names[own:], *names])

        return run

    first = texts.met(texts.owners, spans).select("content", "spans", F.col("owner").alias("id"), "m").mapInArrow(cut(False), f"id long, m long, {ddl}")
    # A row repeated with its id is the same document again.
    first = first.withColumn("again", F.explode(F.sequence(F.lit(1), "m"))).select("id", *names)
    info = texts.met(texts.owners.filter("copies > m")).select("content", "r1", "r2", "copies", "owner").mapInArrow(cut(True), f"r1 long, r2 long, copies long, owner long, {ddl}")
    others = texts.told(materialise(info, "copies")).filter(~F.col("id").eqNullSafe(F.col("owner")))
    return first.unionByName(others.select("id", *names))


def op6_dedup_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without the windows of 20 words seen earlier."""
    return dedup_word_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "removed").withColumnRenamed("id", "doc_id")
