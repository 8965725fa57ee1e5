"""Equi-joins with collision renaming, and joins on cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A right column whose name the left side has, too, gets this prefix.
PREFIX = "r_"
KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def rename_right(left: DataFrame, right: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The right side with colliding names prefixed until free, and old name to new."""
    taken, names = set(left.columns), {}
    for c in right.columns:
        new = c
        while new in taken:
            new = PREFIX + new
        taken.add(new)
        names[c] = new
    return right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """left JOIN right ON left.x = right.y [AND ..]; nulls match nothing, both keys stay.

    Which side is hashed or broadcast, and how skewed keys split, is left to the optimizer.
    """
    renamed, names = rename_right(left, right)
    condition = None
    for a, b in on:
        c = left[a] == renamed[names[b]]
        condition = c if condition is None else condition & c
    return left.join(renamed, condition, KINDS[how])


#: Rows of a block, on average, and its bytes, about, at most; blocks stay far below 2^15 rows.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Left rows of a block that are scored at a time.
STRIP = 512


def similarity_join(left: DataFrame, right: DataFrame, left_v: str, right_v: str, threshold: float, how: str = "inner", strict: bool = True) -> DataFrame:
    """left JOIN right ON COSINE_SIM(left.left_v, right.right_v) > threshold, of any kind.

    Both sides are stored as blocks of bounded size, and each task reads a partition of both
    tables and scores all their blocks by matrix products: nothing is copied or shuffled for it.
    A pair's rows are taken from the two blocks at hand, so pairs are not shuffled either. The
    outer kinds look a second time for rows without partner; there, a task compares a row no
    more once it has one. Work is the product of the sides, as the predicate demands; what is
    shuffled and written grows with the sides. Null vectors and vectors of different widths
    join with nothing, zero vectors (cosine 0) only if 0 passes the threshold.
    """
    renamed, names = rename_right(left, right)
    a, b = _blocks(left, left_v, "l"), _blocks(renamed, names[right_v], "r")
    fields = [(f"{s}{k}", f) for s, df in (("l", left), ("r", renamed)) for k, f in enumerate(df.schema.fields)]

    def taken(df: DataFrame, at: dict[str, Column]) -> DataFrame:
        return df.select(*[(F.col(c)[at[c[0]]] if c[0] in at else F.lit(None).cast(f.dataType)).alias(f.name) for c, f in fields])

    met = _product(a, b).withColumn("pairs", _pairs(threshold, strict)("lv", "rv")).withColumn("at", F.explode("pairs"))
    joined = taken(met, {"l": F.shiftright("at", 16), "r": F.col("at").bitwiseAND(0xFFFF)})
    outer = {"inner": "", "left": "l", "right": "r", "full": "lr"}[how]
    if not outer:
        return joined
    seen = _product(a.select("lb", "lv"), b.select("rb", "rv")).mapInArrow(_partnered(threshold, strict, outer), "side string, b long, at array<int>")
    # One table for both sides up to here, so that its shuffle is used twice.
    seen = seen.groupBy("b").agg(F.collect_list(F.struct("side", "at")).alias("seen"))
    for side, df in (("l", a), ("r", b)):
        if side in outer:
            own = seen.select(F.col("b").alias(f"{side}b"), F.flatten(F.filter("seen", lambda x: x["side"] == side)["at"]).alias("had"))
            every, had = F.sequence(F.lit(0), F.col(f"{side}n") - 1), F.coalesce("had", F.array().cast("array<int>"))
            joined = joined.unionAll(taken(df.join(own, f"{side}b", "left").withColumn("at", F.explode(F.array_except(every, had))), {side: F.col("at")}))
    return joined


def _blocks(df: DataFrame, v: str, side: str) -> DataFrame:
    """df as a table of blocks, a file each: its number {side}b, rows {side}n, vectors {side}v, and each column's values {side}0, {side}1, ..."""
    from ..plans.shared import stored

    whole = stored(df)
    rows, size = whole.count(), int(whole._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(1, -(-rows // BLOCK), min(rows, size // BLOCK_BYTES))
    row = {f"{side}{k}": F.col(f"`{c}`") for k, c in enumerate(df.columns)}
    name = f"{side}{df.columns.index(v)}"
    if whole.schema[v].dataType.simpleString() != "array<float>":
        name, row[f"{side}w"] = f"{side}w", F.col(f"`{v}`").cast("array<double>")
    dealt = whole.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("b"), F.struct(*[x.alias(c) for c, x in row.items()]).alias("row"))
    packed = dealt.groupBy("b").agg(F.collect_list("row").alias("row"))
    packed = stored(packed.select(F.col("b").alias(f"{side}b"), F.size("row").alias(f"{side}n"), *[F.col("row")[c].alias(c) for c in row]), rows_per_file=1)
    return packed.withColumn(f"{side}v", F.col(name))


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of a with all of b, read from both tables by pairs of partitions; nothing is broadcast."""
    return a.crossJoin(b.hint("shuffle_replicate_nl"))


def _pairs(threshold: float, strict: bool):
    """Of two blocks' vectors, the places of all pairs above the threshold, as i << 16 | j."""

    def places(x: pa.Array, y: pa.Array) -> pa.Array:
        found, ends = [np.empty(0, np.int32)], [0]
        for u, v in zip(x, y, strict=True):
            own = [i << 16 | j for i, j in _above(_units(u.values), _units(v.values), threshold, strict)]
            found += own
            ends.append(ends[-1] + sum(map(len, own)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))

    # Else the optimizer filters out empty lists by a second call.
    return F.arrow_udf(places, "array<int>").asNondeterministic()


def _partnered(threshold: float, strict: bool, sides: str):
    """Of each block of the sides, the places that have a partner in any block met here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict[tuple[str, int], np.ndarray] = {}
        for t in batches:
            for lb, u, rb, v in zip(*(t.column(c) for c in ("lb", "lv", "rb", "rv")), strict=True):
                x, y = _units(u.values), _units(v.values)
                l, r = had.setdefault(("l", lb.as_py()), np.zeros(len(u), bool)), had.setdefault(("r", rb.as_py()), np.zeros(len(v), bool))
                # Rows that look for a partner meet all others.
                for side, rows, others in (("l", x, y), ("r", y, x)):
                    if side in sides:
                        mine = l if side == "l" else r
                        open_ = [(w, at[~mine[at]], m[~mine[at]]) for w, (at, m) in rows.items()]
                        for i, j in _above({w: (at, m) for w, at, m in open_}, others, threshold, strict):
                            mine[i] = True
                            (r if side == "l" else l)[j] = True
        for (side, b), mine in had.items():
            if side in sides:
                yield pa.RecordBatch.from_pydict({"side": pa.array([side]), "b": pa.array([b], pa.int64()), "at": pa.array([np.flatnonzero(mine).astype(np.int32)], pa.list_(pa.int32()))})

    return run


def _units(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: places in the block, and the vectors there divided by their norms. Null and empty ones are left out."""
    flat, ends = np.asarray(vectors.flatten(), dtype=np.float64), np.asarray(vectors.offsets)
    ends, widths = ends - ends[0], np.diff(ends)
    found = {}
    for w in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == w)
        x = flat[(ends[at][:, None] + np.arange(w)).ravel()].reshape(len(at), w)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        found[w] = at.astype(np.int32), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return found


def _above(left: dict, right: dict, threshold: float, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs above the threshold, by strips of the left side.

    Single precision tells all but those right at the threshold; these are told in double.
    """

    def passes(s: np.ndarray) -> np.ndarray:
        return s > threshold if strict else s >= threshold

    for w in left.keys() & right.keys():
        (a, x), (b, y) = left[w], right[w]
        low, doubt = y.astype(np.float32).T, (w + 8) * 2.0**-23
        for k in range(0, len(a), STRIP):
            strip = x[k : k + STRIP]
            s = (strip.astype(np.float32) @ low).ravel()
            at = np.flatnonzero(s >= np.float32(threshold - doubt))
            near = np.flatnonzero(s[at] <= threshold + doubt)
            if len(near) > strip.size:
                at = np.flatnonzero(passes(strip @ y.T).ravel())
            elif len(near):
                i, j = np.divmod(at[near], len(b))
                at = np.delete(at, near[~passes(np.einsum("ij,ij->i", strip[i], y[j]))])
            if len(at):
                i, j = np.divmod(at, len(b))
                yield a[k + i], b[j]
