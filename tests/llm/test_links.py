"""Jaccard join, embedding dedup and components against brute force."""

import random
import re

import numpy as np
import pytest

from veldspar.llm import embedding_dedup as dedup
from veldspar.llm import shingle_join
from veldspar.llm.components import connected_components
from veldspar.llm.embedding_dedup import embedding_dedup, passes_for
from veldspar.llm.shingle_join import distinct_by_shingles, jaccard_components


def united(nodes, pairs):
    up = {x: x for x in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, united(ids, pairs)


def test_jaccard(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes, components = brute([r for r in rows if r[0] is not None])
    got = jaccard_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (sizes[r["id"]], components[r["id"]])
    assert components[3] == 1 and components[30] == 1 and components[8] == 7
    nulls = sorted((r["n_shingles"], r["component_id"]) for r in got if r["id"] is None and r["n_shingles"])
    assert nulls == [(sizes[1], 1)]


def test_jaccard_near_the_threshold_and_in_blocks(spark, monkeypatch):
    """Many near copies of a few texts, some just linked and some just not, in small blocks."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60 + 40 * g)]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**9)}"
            if rng.random() < 0.3:
                t = t[: rng.randint(len(t) // 2, len(t))]
            rows.append((len(rows), " ".join(t)))
    monkeypatch.setattr(shingle_join, "BLOCK_CLASSES", 4)
    got = {r["id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)[1]


def test_distinct_rows(docs):
    kept = distinct_by_shingles(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and not {2, 3, 30, 8} & set(ids) and {4, 5, 6, 7} <= set(ids)


def test_empty_tables(spark, no_docs):
    assert jaccard_components(no_docs).count() == 0 and distinct_by_shingles(no_docs).count() == 0
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)] + [(100 + k, 101 + k) for k in range(30)] + [(3, 3)]
    rows = connected_components(spark.createDataFrame([*pairs, (None, 1), *pairs[:5]], "a long, b long")).collect()
    want = united({x for p in pairs if p[0] != p[1] for x in p}, [p for p in pairs if p[0] != p[1]])
    assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        rows += [rng.standard_normal(16)]
    for size in (400, 5, 3):  # a cluster larger than every window and block
        c = rng.standard_normal(16)
        rows += [c + 0.05 * rng.standard_normal(16) for _ in range(size)]
    return [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(rows)]


def test_embeddings(spark):
    rows = vectors()
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] * 16), (1005, rows[40][1][:8]), (None, rows[40][1]), rows[0], (1006, rows[50][1]), (1007, [None] * 16), (1008, [x * 1e-30 for x in rows[0][1]])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + odd], "vec_id long, embedding array<double>, node string, unit int")
    got = {r["id"]: r for r in embedding_dedup(df).collect() if r["id"] is not None}
    good = [r for r in rows + odd if r[0] is not None and r[0] not in range(1000, 1006) and r[0] != 1007]
    m = {i: np.array(v, dtype=float) for i, v in good}
    ids = sorted(m)
    x = np.array([m[i] / np.abs(m[i]).max() for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = united(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert {i: got[i]["n_links"] for i in ids} == dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    assert {i: got[i]["component_id"] for i in ids} == want
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[1008]["component_id"] == 0 and embedding_dedup(df).count() == df.count()


def test_recall_at_the_threshold(spark):
    """Pairs right at a cosine of 0.95 among unrelated vectors: at least nine of ten are found."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [a, 0.951 * a + (1 - 0.951**2) ** 0.5 * b]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    assert sum(r["n_links"] for r in embedding_dedup(df).collect()) >= 0.9 * 600
    assert passes_for(10**9) > passes_for(10**4)


@pytest.mark.parametrize("crowd", [4096, 100])
def test_recall_in_a_hot_region(spark, monkeypatch, crowd):
    """A third of the vectors at pairwise cosines of 0.8, with isolated pairs at 0.955 among them;
    the smaller crowd takes the passes with larger windows, too."""
    monkeypatch.setattr(dedup, "CROWD", crowd, raising=False)
    monkeypatch.setattr(dedup, "MAX_WINDOW", 512, raising=False)
    rng = np.random.default_rng(12)

    def units(n):
        x = rng.standard_normal((n, 64))
        return x / np.linalg.norm(x, axis=1)[:, None]

    centre = units(1)[0]

    def around(x):
        x = x - (x @ centre)[:, None] * centre
        return 0.8**0.5 * centre + 0.2**0.5 * x / np.linalg.norm(x, axis=1)[:, None]

    a = around(units(150))
    b = units(150)
    b -= (b * a).sum(axis=1)[:, None] * a
    b -= (b @ centre)[:, None] * centre
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    rows = np.concatenate((a, 0.955 * a + (1 - 0.955**2) ** 0.5 * b, around(units(1700)), units(4000)))
    near = rows @ rows.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = sum(r["n_links"] for r in embedding_dedup(df).collect())
    assert near.sum() >= 300
    assert got >= 0.98 * near.sum()


def test_shared_boilerplate_makes_no_clusters(spark, monkeypatch):
    """Texts that share 40 % of their words, and two near copies among them: the root leaves all others."""
    rng = random.Random(21)
    shared = [f"b{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(k, " ".join(shared + [f"u{rng.randrange(10**9)}" for _ in range(120)])) for k in range(200)]
    rows.append((900, rows[7][1] + " and more"))
    seen = {}
    keep = shingle_join.materialise

    def spy(df, name, *more):
        seen[name] = keep(df, name, *more)
        return seen[name]

    monkeypatch.setattr(shingle_join, "materialise", spy)
    got = {r["id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)[1] and got[900] == 7
    assert seen["routed"].count() == 2


def test_a_common_token_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "PART_TOKENS", 50)
    rng = random.Random(22)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(120):
        t = list(base)
        t[rng.randrange(90)] = f"x{k}"
        rows.append((k, " ".join(t) if k % 3 else " ".join(rng.sample(base, 60))))
    got = {r["id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == brute(rows)[1]


def test_a_hub_of_many_links(spark, monkeypatch):
    from veldspar.llm import components

    monkeypatch.setattr(components, "LEAST", 20)
    pairs = [(0, k) for k in range(1, 300)] + [(k, k + 1000) for k in range(1, 50)] + [(5000, 5001), (2000, 299)]
    rows = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == united({x for p in pairs for x in p}, pairs)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f g h", "k1", 1.5, "p"), (2, "a b c d e f g h", "k2", 2.5, "q"), (3, None, "k3", None, "r"), (4, "x", None, 0.5, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string, `a.b` double, id string")
    out = distinct_by_shingles(df)
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == [rows[0], rows[2], rows[3]]


def test_nothing_shared_in_a_part(spark):
    """Texts that share no shingle at all link with nothing."""
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(9))) for k in range(6)], "doc_id long, text string").coalesce(1)
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()) == [(k, 5, k) for k in range(6)]


def test_boilerplate_connects_no_families(spark, monkeypatch):
    """Near copies whose texts all share 40 % of their words meet their own family only."""
    rng = random.Random(23)
    shared = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(60):
        own = [f"u{k}x{j}" for j in range(120)]
        rows += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + own[:-2] + [f"v{k}", f"w{k}"]))]
    seen = {}
    keep = shingle_join.materialise

    def spy(df, name, *more):
        seen[name] = keep(df, name, *more)
        return seen[name]

    monkeypatch.setattr(shingle_join, "materialise", spy)
    got = {r["id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)[1] and got[7] == 6
    assert seen["clusters"].groupBy("cluster").count().agg({"count": "max"}).first()[0] == 2


def test_rarest_first():
    """Each entry once, a token's count taken from any entry of its block."""
    entries = [(1, 5, 9, 0), (1, 6, 9, 3), (1, 5, 8, 7), (1, 5, 9, 3), (2, 5, 9, 3), (2, 5, 8, 7), (1, 6, 7, 3)]
    got = shingle_join.rarest_first(*(np.array(c, dtype=np.int64) for c in zip(*entries, strict=True)))
    assert list(zip(*(c.tolist() for c in got), strict=True)) == [(1, 5, 9), (1, 5, 8), (1, 6, 7), (1, 6, 9), (2, 5, 9), (2, 5, 8)]
