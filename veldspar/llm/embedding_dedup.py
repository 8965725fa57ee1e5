"""Embedding near-dedup by sorted projection passes.

Each pass draws random hyperplanes, writes a vector's sides as one concatenated code and
orders all vectors by it; a range-partitioned sort puts close vectors near each other, and
each is compared with a bounded window of neighbours, across partition boundaries too.
Pairs at the threshold are linked and united over all passes. The number of passes follows
from the number of vectors, and each vector's chance to have missed a partner is measured
from the codes around it. Vectors in a crowded region, where that chance is still too high,
go through further passes with larger windows, and what is left then is compared in full.
A window is bounded, a cluster is not: inside a component every pair is compared in blocks
of bounded size, so large clusters lose no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

THRESHOLD = 0.95
WINDOW = 32
#: Chance to find a pair right at the threshold over all passes.
TARGET = 0.99
BITS = 62
#: Vectors of a block; a member of a component of m vectors is copied m / BLOCK times, and two
#: blocks' cosines take 32 MiB.
BLOCK = 2048
#: Crowded vectors are compared in full once there are no more than this, and in blocks of it.
CROWD = 4096
#: The largest window of the passes over crowded vectors.
MAX_WINDOW = 2048
SEED = 3


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, target: float = TARGET) -> int:
    """Passes after which a pair at the threshold shared a window at least once: in one pass it
    does if its codes agree in so many leading bits that `window` vectors do on average."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(1.0, math.log2(max(2, n) / window) + 1)
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - min(0.999, agree**bits))))


def planes(which: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, which, width]).standard_normal((width, BITS))


def values_of(column: pa.Array, dtype: str) -> list[bytes | None]:
    """Components as bytes; None for null, empty, zero and non-finite vectors."""
    out: list[bytes | None] = []
    for x in column.to_pylist():
        if not x or any(v is None for v in x):
            out.append(None)
            continue
        v = np.array(x, dtype=dtype)
        out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
    return out


def units_of(rows: list[bytes], dtype: str) -> np.ndarray:
    """Unit vectors in double precision of vectors of one width."""
    m = np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _links_in_window(ids: np.ndarray, m: np.ndarray, window: int, threshold: float, fresh: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the window at the threshold; of the first `fresh` rows none among themselves."""
    a, b = [ids[:0]], [ids[:0]]
    step = max(64, min(window, 1024))
    for lo in range(0, len(ids), step):
        i, j = np.nonzero(m[lo : lo + step] @ m[lo : lo + step + window].T >= threshold)
        good = (j > i) & (j - i <= window) & (j + lo >= fresh)
        a.append(ids[i[good] + lo])
        b.append(ids[j[good] + lo])
    return np.concatenate(a), np.concatenate(b)


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> 31
    return np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((x & 0x7FFFFFFF).astype(np.float64))[1])


def log_miss(codes: np.ndarray, window: int, threshold: float, open_left: bool, open_right: bool) -> np.ndarray:
    """Logarithm of each vector's chance to miss a partner right at the threshold in this pass.

    codes are sorted. A vector meets all that share more leading bits with it than the first
    one beyond its window does; at an open end, than the last one at hand does.
    """
    n = len(codes)
    at = np.arange(n)
    depth = np.zeros(n, dtype=np.int64)
    for beyond, end, is_open in ((at - window - 1, 0, open_left), (at + window + 1, n - 1, open_right)):
        inside = (beyond >= 0) & (beyond < n)
        shared = BITS - _bit_length(codes ^ codes[np.where(inside, beyond, end)])
        depth = np.maximum(depth, np.where(inside | is_open, shared + 1, 0))
    agree = 1 - math.acos(threshold) / math.pi
    return np.log1p(-np.where(depth > BITS, 0.0, np.minimum(agree**depth, 1 - 1e-12)))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with a link fewer than members."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))])
    child = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[child], nodes[roots[child]]


def projected_links(vectors: DataFrame, dtype: str, window: int, threshold: float, passes: range) -> tuple[DataFrame, DataFrame]:
    """(a, b) links found by the passes, and (node, miss) of each pass, as log_miss() tells;
    vectors: (node, width, unit), unit the components' bytes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths, units = b.column(1).to_numpy(), b.column(2).to_pylist()
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                m = units_of([units[k] for k in at], dtype)
                own = b.take(pa.array(at))
                for p in passes:
                    side = m @ planes(p, width) > 0
                    codes = side.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, dtype=np.int32)), pa.array(codes), *own.columns], ["pass", "code", "node", "width", "unit"])

    # A zero-pass column first: the order of all passes at once, in one range partitioning.
    coded = vectors.mapInArrow(code, "pass int, code long, node long, width int, unit binary")
    ordered = coded.repartitionByRange("pass", "width", "code", "node").sortWithinPartitions("pass", "width", "code", "node")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the partition, and its first and last rows for the boundaries."""
        names = ["a", "b", "part", "side", "pass", "code", "node", "width", "unit", "miss"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64()]

        def edge_rows(rows: list, part: int, side: int) -> pa.RecordBatch:
            cols = [*zip(*rows, strict=True)] or [()] * 5
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1]), pa.array([part] * n, kinds[2]), pa.array([side] * n, kinds[3]), *(pa.array(c, k) for c, k in zip(cols, kinds[4:9], strict=True)), pa.nulls(n, kinds[9])], names)

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        head: list = []
        tail: list = []
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            head += rows[: max(0, window - len(head))]
            both = tail + rows
            keys = [(r[0], r[3]) for r in both]
            cuts = [0, *(k for k in range(1, len(both)) if keys[k] != keys[k - 1]), len(both)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                old = max(0, len(tail) - x)
                codes = np.array([r[1] for r in both[x:y]], dtype=np.int64)
                miss = log_miss(codes, window, threshold, x == 0, y == len(both))[old:]
                if len(miss):
                    n = len(miss)
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds[:6]), pa.array([r[2] for r in both[x + old : y]], kinds[6]), pa.nulls(n, kinds[7]), pa.nulls(n, kinds[8]), pa.array(miss)], names)
                if y - x < 2:
                    continue
                ids = np.array([r[2] for r in both[x:y]], dtype=np.int64)
                m = units_of([r[4] for r in both[x:y]], dtype)
                a, c = _stars(*_links_in_window(ids, m, window, threshold, old))
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), *(pa.nulls(n, k) for k in kinds[2:])], names)
            tail = both[-window:]
        # Boundary p lies between partitions p and p + 1.
        if head:
            yield edge_rows(head, part - 1, 1)
            yield edge_rows(tail, part, 0)

    found = materialise(ordered.mapInArrow(neighbours, "a long, b long, part int, side int, pass int, code long, node long, width int, unit binary, miss double"), "passes")
    edges = found.filter("part >= 0").drop("a", "b", "miss")

    def across(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("pass", "width", "code", "node", "unit", "side")), strict=True))
        a, b = [], []
        for width in {r[:2] for r in rows}:
            own = [r for r in rows if r[:2] == width]
            ids = np.array([r[3] for r in own], dtype=np.int64)
            m = units_of([r[4] for r in own], dtype)
            x, y = _links_in_window(ids, m, window, threshold)
            a.append(x)
            b.append(y)
        a, b = _stars(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": a, "b": b})

    crossing = edges.groupBy("part").applyInArrow(across, "a long, b long")
    return found.filter("a is not null").select("a", "b").unionByName(crossing), found.filter("miss is not null").select("node", "miss")


def block_links(vectors: DataFrame, n: int, dtype: str, threshold: float) -> DataFrame:
    """(a, b) links that unite what any pair of the n vectors at the threshold does."""
    blocks = -(-n // CROWD)
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    pairs = F.explode(F.expr(f"transform(sequence(0, {blocks - 1}), s -> struct(least(s, block) as i, greatest(s, block) as j))"))
    dealt = vectors.select("node", "width", "unit", block.alias("block")).withColumn("p", pairs)

    def link(t: pa.Table) -> pa.Table:
        nodes, at, p = t.column("node").to_numpy(), t.column("block").to_numpy(), t.column("p")[0].as_py()
        m = units_of(t.column("unit").to_pylist(), dtype)
        i, j = np.flatnonzero(at == p["i"]), np.flatnonzero(at == p["j"])
        a, b = [nodes[:0]], [nodes[:0]]
        for lo in range(0, len(i), 512):
            x, y = np.nonzero(m[i[lo : lo + 512]] @ m[j].T >= threshold)
            x, y = nodes[i[x + lo]], nodes[j[y]]
            x, y = _stars(x[x != y], y[x != y])
            a.append(x)
            b.append(y)
        a, b = _stars(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("width", "p").applyInArrow(link, "a long, b long")


def found_links(vectors: DataFrame, n: int, dtype: str, window: int = WINDOW, threshold: float = THRESHOLD, passes: int | None = None) -> DataFrame:
    """(a, b) links such that each vector finds a partner at the threshold with a chance of TARGET.

    A pair needs the chance of one of its vectors only, so those that have it drop out.
    """
    passes = passes or passes_for(n, threshold, window)
    links, missed = projected_links(vectors, dtype, window, threshold, range(passes))
    done = passes
    while True:
        crowded = missed.groupBy("node").agg(F.sum("miss").alias("miss")).filter(F.col("miss") > math.log(1 - TARGET))
        left = materialise(vectors.join(crowded, "node").select("node", "width", "unit", "miss"), "crowded")
        n = left.count()
        if n <= CROWD or window >= MAX_WINDOW:
            break
        window *= 4
        more, missed = projected_links(left.select("node", "width", "unit"), dtype, window, threshold, range(done, done + passes))
        links, missed = links.unionByName(more), missed.unionByName(left.select("node", "miss"))
        done += passes
    return (links.unionByName(block_links(left, n, dtype, threshold)) if n else links).distinct()


def embedding_dedup(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different width; their component is their own id. Equal
    vectors link. Rows with a null id get no links, a null component and are kept. Rows
    repeated with the same id are one vector (the first by content counts). An empty table
    gives an empty result; other columns are ignored.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = values_of(b.column(1), dtype)
            good = [k for k, u in enumerate(rows) if u is not None and b.column(0)[k].is_valid]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good, pa.int64())), pa.array([len(rows[k]) // size for k in good], pa.int32()), pa.array([rows[k] for k in good], pa.binary())], ["node", "width", "unit"])

    # Vectors travel in the type they are stored in, and are compared in double precision.
    single = table.schema[vector].dataType.elementType.typeName() == "float"
    dtype, size = ("<f4", 4) if single else ("<f8", 8)
    ids = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    vectors = ids.mapInArrow(unit, "node long, width int, unit binary").groupBy("node").agg(F.min(F.struct("width", "unit")).alias("u")).select("node", "u.width", "u.unit")
    vectors = materialise(vectors, "vectors")
    components = materialise(connected_components(found_links(vectors, vectors.count(), dtype, window, threshold, passes)), "components")
    # Every pair of a component, block against block.
    blocks = components.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        components.join(blocks, "component")
        .withColumn("block", block)
        .withColumn("p", F.explode(F.expr("transform(sequence(0, blocks - 1), s -> struct(least(s, block) as i, greatest(s, block) as j))")))
        .join(vectors, "node")
        .select("component", "p", "block", "node", "unit")
    )

    def count(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_numpy()
        at = t.column("block").to_numpy()
        m = units_of(t.column("unit").to_pylist(), dtype)
        p = t.column("p")[0].as_py()
        i, j = at == p["i"], at == p["j"]
        near = m[i] @ m[j].T >= threshold
        if p["i"] == p["j"]:
            np.fill_diagonal(near, False)
            out, n = nodes[i], near.sum(axis=1)
        else:
            out, n = np.concatenate((nodes[i], nodes[j])), np.concatenate((near.sum(axis=1), near.sum(axis=0)))
        return pa.table({"node": out, "n": pa.array(n, pa.int64())})

    links = dealt.groupBy("component", "p").applyInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))
    told = components.join(links, "node").select("node", "component", "n_links")
    out = ids.select("id").join(told, F.col("id") == F.col("node"), "left")
    own = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at a cosine of 0.95."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
