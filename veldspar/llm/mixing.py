"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source, exact length and a slot of their seeded hash. Each
source's budget is split into whole passes over the source and a remainder. The remainder
takes the same share of every length first; what is left, smaller than the number of
lengths times their size, is met by a bounded-knapsack dynamic programme over the lengths'
spare counts, whatever their size: over all reachable sums where there are few enough, else
over those around the quick plan. The counts are turned back into documents by their seeded hash order, slot
by slot, so only the one slot a count ends in is ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Hash slots of a length; a power of two.
SLOTS = 256
#: Words of rest that the bitset programme meets; larger rests go down greedily first, and
#: where that ends short of the budget, the programme over reachable sums has the last word.
DP_WORDS = 1 << 16


#: Reachable sums that a plan may hold: 48 MiB of them.
MAX_SUMS = 1 << 22


def knapsack(budget: int, lengths: list[int], spare: list[int]) -> list[int]:
    """How many of each length (at most spare) come nearest below or at budget; lengths are positive.

    The quick plan stands if it meets the budget up to the lengths' common divisor. Else, if no
    more than MAX_SUMS sums can be reached, all are and the best is taken: that is exact. A
    larger source's quick plan is mended: some of what it takes goes back, and that much is
    planned by sums again.
    """
    if sum(z * n for z, n in zip(lengths, spare, strict=True)) <= budget:
        return list(spare)
    unit = math.gcd(*lengths)
    small, goal = [z // unit for z in lengths], budget // unit
    take = _quick(goal, small, spare)
    if sum(z * n for z, n in zip(small, take, strict=True)) == goal:
        return take
    choices = 1
    for n in spare:
        choices = min(choices * (n + 1), MAX_SUMS + 1)
    return _by_sums(goal, small, spare) if min(goal, choices) <= MAX_SUMS else _mended(goal, small, spare, take)


def _mended(budget: int, lengths: list[int], spare: list[int], take: list[int]) -> list[int]:
    """A better plan near `take`: the copies that go back grow in number while the sums they
    can make stay within MAX_SUMS and the budget isn't met."""
    best, k = list(take), 1
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while True:
        freed, room = [0] * len(lengths), budget - sum(z * n for z, n in zip(lengths, best, strict=True))
        if room == 0:
            return best
        for i in order:
            n = min(best[i], k)
            if n and room + n * lengths[i] <= MAX_SUMS * max(1, min(lengths)):
                freed[i], room = n, room + n * lengths[i]
        open_ = [min(spare[i] - best[i] + freed[i], freed[i] + k) for i in range(len(lengths))]
        plan = _by_sums(room, lengths, open_)
        after = [best[i] - freed[i] + plan[i] for i in range(len(lengths))]
        if k > 64 or not any(freed):
            return max(best, after, key=lambda x: sum(z * n for z, n in zip(lengths, x, strict=True)))
        best = max(best, after, key=lambda x: sum(z * n for z, n in zip(lengths, x, strict=True)))
        k *= 4


def _by_sums(budget: int, lengths: list[int], spare: list[int]) -> list[int]:
    """Exact: each reachable sum is kept once, with the item that reached it first."""
    sums, by, items = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int32), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, k = min(spare[i], budget // lengths[i]), 1
        while left > 0 and sums[-1] < budget:
            n = min(k, left)
            new = sums[: np.searchsorted(sums, budget - n * lengths[i], side="right")] + n * lengths[i]
            at = np.searchsorted(sums, new)
            fresh = np.ones(len(new), dtype=bool)
            inside = at < len(sums)
            fresh[inside] = sums[at[inside]] != new[inside]
            by = np.insert(by, at[fresh], len(items))
            sums = np.insert(sums, at[fresh], new[fresh])
            items.append((i, n))
            left -= n
            k *= 2
    take, at = [0] * len(lengths), len(sums) - 1
    while by[at] >= 0:
        i, n = items[by[at]]
        take[i] += n
        at = int(np.searchsorted(sums, sums[at] - n * lengths[i]))
    return take


def _quick(budget: int, lengths: list[int], spare: list[int]) -> list[int]:
    """Greedy from the longest down to DP_WORDS of rest, then a reachability bitset over binary
    splits of the spare counts: exact for the rest.
    """
    take = [0] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rest = budget
    for i in order:
        if rest <= DP_WORDS:
            break
        n = min(spare[i], (rest - DP_WORDS // 2) // lengths[i])
        if n > 0:
            take[i] += n
            rest -= n * lengths[i]
    if rest <= 0 or rest > DP_WORDS:
        return take
    mask = (1 << (rest + 1)) - 1
    reach, seen = 1, []  # seen: before each item, what was reachable
    for i in reversed(order):
        left = min(spare[i] - take[i], rest // lengths[i])
        k = 1
        while left > 0:
            n = min(k, left)
            after = (reach | (reach << (n * lengths[i]))) & mask
            if after != reach:
                seen.append((reach, i, n))
                reach = after
            left -= n
            k *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for before, i, n in reversed(seen):
        if not before >> at & 1:
            take[i] += n
            at -= n * lengths[i]
    return take


def plan_source(counts: pd.DataFrame, budget: float) -> pd.DataFrame:
    """counts: size, n of one source. Adds whole (passes that every document gets) and share
    (how many documents of the size get one pass more)."""
    counts = counts.sort_values("size").reset_index(drop=True)
    sizes, have = counts["size"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.int64)
    total = int((sizes * have).sum())
    goal = int(round(budget))
    whole = min(MAX_REPEATS, goal // total) if total else 0
    rest = goal - whole * total if whole < MAX_REPEATS else 0
    share = (have.astype(object) * rest // total).astype(np.int64) if total else have * 0
    left = rest - int((share * sizes).sum())
    usable = [i for i in range(len(sizes)) if sizes[i] > 0 and have[i] > share[i]]
    for i, n in zip(usable, knapsack(left, [int(sizes[i]) for i in usable], [int(have[i] - share[i]) for i in usable]), strict=True):
        share[i] += n
    return counts.assign(whole=whole, share=share)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes;
    a target stops at MAX_REPEATS times its source's size and the excess is shared again.
    Ranks come from a range-partitioned sort, the level from aggregates, so the number of
    sources is not bounded by one task.
    """
    ordered = sizes.orderBy(F.col("source").asc_nulls_last())
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("source string, source_size long, rank long")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(MAX_REPEATS)).alias("most")), "sources")
    total = ranked.agg(F.sum(F.col("source_size"))).first()[0] or 0
    level, count = 0.0, -1
    while True:
        full = F.col("most") <= F.col("w") * F.lit(level)
        n, held, open_w = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == count or not open_w:
            break
        count, level = n, (total - (held or 0.0)) / open_w
    return ranked.select("source", "source_size", F.least("most", F.col("w") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, taken, whole, extra.

    size: words `[^\\x20\\x09-\\x0D]+` (null text: 0). taken: words the mix takes of the row,
    repeats counted, at most MAX_REPEATS times its size. Null sources form one source, placed
    last. Rows of equal hash (repeated rows) are told apart arbitrarily but in number exactly.
    A very long text is one number here, however long. An empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    mark = F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("long"), F.col(f"`{source}`"))
    rows = materialise(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), mark.alias("mark")), "sizes")
    rows = rows.withColumn("slot", F.pmod(F.shiftright("mark", 40), F.lit(SLOTS)).cast("int"))
    counts = rows.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    goal = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        out = plan_source(pdf[["size", "n"]], float(pdf["target"].iloc[0]))
        for c in ("source", "source_size", "target"):
            out[c] = pdf[c].iloc[0]
        return out[["source", "source_size", "target", "size", "whole", "share"]]

    g = goal.withColumnRenamed("source", "s2")
    # One row per source and length: as many as there are lengths, whatever the source holds.
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    planned = by_size.join(g, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").groupBy("source").applyInPandas(
        plan, "source string, source_size long, target double, size long, whole int, share long"
    )
    planned = planned.select(F.col("source").alias("s2"), "source_size", "target", F.col("size").alias("z2"), "whole", "share")
    # A length's share goes to its slots in turn; at most SLOTS rows a length.
    turn = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.withColumn("before", F.coalesce(F.sum("n").over(turn), F.lit(0)))
    slots = slots.join(planned, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")))
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("share") - F.col("before")))
    planned = slots.select("s2", "source_size", "target", "z2", F.col("slot").alias("l2"), "n", "whole", extra.cast("long").alias("extra"))
    planned = materialise(planned, "plan")
    on = F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("slot") == F.col("l2"))
    told = rows.join(planned, on).drop("s2", "z2", "l2")
    # Only the slot in which a length's count ends is ranked; the others go whole or not at all.
    settled = told.filter("extra = 0 or extra = n").withColumn("one", (F.col("extra") > 0).cast("int"))
    w = Window.partitionBy("source", "size", "slot").orderBy("mark", "id")
    split = told.filter("extra > 0 and extra < n").withColumn("one", (F.row_number().over(w) <= F.col("extra")).cast("int"))
    both = settled.unionByName(split)
    passes = F.col("whole") + F.col("one")
    return both.select("id", "size", "source", "source_size", "target", (F.col("size") * passes).alias("taken"), passes.alias("passes"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the weights 5, 2, 1 of their sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8) -> DataFrame:
    """The rows of docs with their columns, each as often as the mix takes it (0 to MAX_REPEATS).

    Rows that share identifier, source and size are alike to the mix: what it takes of them
    together is dealt out among them as evenly as it goes. Nulls as in mix(); an empty table
    stays empty; columns may have any names.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    alike = ("k2", "s2", "z2")
    plan = mix(docs, key, text, source, seed).select(F.col("id").alias("k2"), F.col("source").alias("s2"), F.col("size").alias("z2"), "passes")
    plan = plan.groupBy(*alike).agg(F.sum("passes").alias("all"), F.count(F.lit(1)).alias("rows")).filter("all > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{source}`").cast("string").alias("s"), size.alias("z"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    taken = own.join(plan.hint("shuffle_hash"), F.col("k").eqNullSafe(F.col("k2")) & F.col("s").eqNullSafe(F.col("s2")) & F.col("z").eqNullSafe(F.col("z2")))
    # Nearly always one row: only repeated identifiers are numbered.
    one = taken.filter("rows = 1").withColumn("n", F.lit(1))
    more = taken.filter("rows > 1").withColumn("n", F.row_number().over(Window.partitionBy("k", "s", "z").orderBy("h")))
    both = one.unionByName(more).withColumn("times", F.expr("cast(all div rows + if(n <= all % rows, 1, 0) as int)")).filter("times > 0")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
