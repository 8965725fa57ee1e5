import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldspar.llm.exact_dedup import distinct_documents, exact_dedup
from veldspar.llm.mixing import knapsack, mix, mixed_documents


def expected_groups(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        k = keep(known) if known else None
        out += [(i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact(docs, keep):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, exact_dedup(docs, keep=keep).collect()), key=str) == expected_groups(rows, max if keep == "max" else min)


def test_bytes_decide_where_digests_lie(spark):
    rows = [(k, t) for k, t in enumerate(["ax", "ay", "ax", "az", "b", "ay", "ay", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup(df, digest=lambda t: F.substring(t, 1, 1)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((x[:4] for x in expected_groups(rows)), key=str)


def test_distinct_documents(docs, no_docs):
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in docs.collect()})
    assert exact_dedup(no_docs).count() == 0 and distinct_documents(no_docs).count() == 0


def test_no_python_on_the_native_path(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_knapsack_hits_what_can_be_hit():
    assert sum(a * n for a, n in zip([7, 5], knapsack(24, [7, 5], [3, 3]), strict=True)) == 24
    assert knapsack(3, [7, 5], [3, 3]) == [0, 0]
    assert sum(a * n for a, n in zip([1000, 1], knapsack(2_500_000, [1000, 1], [2499, 5000]), strict=True)) == 2_500_000


def level(sizes, weights):
    """Targets by repeated sharing of the excess, as stated."""
    total, share = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    full: set = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        for s in sizes:
            share[s] = 3.0 * sizes[s] if s in full else rest * weights[s] / w
        over = {s for s in sizes if s not in full and share[s] > 3 * sizes[s]}
        if not over or over | full == set(sizes):
            return share
        full |= over


def mixture(spark, n=600):
    rows = []
    for k in range(n):
        source = "a" if k % 3 == 0 else None if k % 17 == 0 else f"s{k % 7}"
        rows.append((k, " ".join(["w"] * (k * 7 % 60)) if k % 50 else None, source))
    return spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string")


def test_mix(spark):
    df = mixture(spark)
    got = mix(df).toPandas()
    assert len(got) == df.count()
    counted = Counter({(r["doc_id"]): len((r["text"] or "").split()) for r in df.collect()})
    assert all(counted[i] == z for i, z in zip(got["id"], got["size"], strict=True))
    sizes = got.assign(s=got["source"].fillna("\U0010ffff")).groupby("s")["size"].sum().to_dict()
    order = sorted(sizes)
    want = level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s, part in got.assign(s=got["source"].fillna("\U0010ffff")).groupby("s"):
        assert abs(part["target"].iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert (part["source_size"] == sizes[s]).all() and (part["taken"] <= 3 * part["size"]).all()
        assert abs(part["taken"].sum() - want[s]) < 3  # one source only has lengths of threes
    again = mix(df.repartition(5)).toPandas()
    key = ["id", "taken"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), again[key].sort_values(key).reset_index(drop=True))


def test_mixed_documents(spark, docs, no_docs):
    df = mixture(spark)
    taken = mix(df).agg(F.sum("taken")).first()[0]
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == taken
    assert mix(docs).count() == docs.count() and mixed_documents(docs).columns == docs.columns
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def best_sum(budget, lengths, spare):
    sums = {0}
    for z, n in zip(lengths, spare, strict=True):
        sums = {x + k * z for x in sums for k in range(n + 1) if x + k * z <= budget}
    return max(sums)


def test_few_very_long_documents_come_nearest_the_budget():
    rng = random.Random(4)
    cases = [(225_000, [200_000, 150_000, 100_000], [1, 1, 1]), (70_000, [80_000, 60_000], [1, 1])]
    for _ in range(60):
        lengths = rng.sample(range(1, 300_000), rng.randint(1, 6))
        cases.append((rng.randint(0, 900_000), lengths, [rng.randint(0, 4) for _ in lengths]))
    for budget, lengths, spare in cases:
        take = knapsack(budget, lengths, spare)
        assert all(0 <= n <= m for n, m in zip(take, spare, strict=True))
        assert sum(z * n for z, n in zip(lengths, take, strict=True)) == best_sum(budget, lengths, spare)


def test_large_sources_are_mended(monkeypatch):
    """More sums than may be held: the plan is still as good as it gets."""
    from veldspar.llm import mixing

    monkeypatch.setattr(mixing, "MAX_SUMS", 500)
    monkeypatch.setattr(mixing, "DP_WORDS", 8)
    rng = random.Random(5)
    for _ in range(40):
        lengths = sorted(rng.sample(range(5, 90), 6))
        spare = [rng.randint(1, 9) for _ in lengths]
        total = sum(z * n for z, n in zip(lengths, spare, strict=True))
        budget = rng.randint(total // 3, total - 1)
        take = knapsack(budget, lengths, spare)
        got = sum(z * n for z, n in zip(lengths, take, strict=True))
        assert all(0 <= n <= m for n, m in zip(take, spare, strict=True)) and got <= budget
        assert budget - got <= budget - best_sum(budget, lengths, spare) + 2


def test_columns_of_any_name_stay(spark):
    rows = [(k, "w " * k, "s", f"k{k}", 1.5, "x") for k in range(1, 12)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None, None)], "doc_id long, text string, source string, __key string, `a.b` double, passes string")
    for out in (mixed_documents(df), distinct_documents(df)):
        assert out.schema == df.schema
        assert set(map(tuple, out.collect())) <= {*rows, (None,) * 6}
    assert sum(len((r["text"] or "").split()) for r in mixed_documents(df).collect()) == mix(df).agg(F.sum("taken")).first()[0]
