"""Every registered query against its SQL, over the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from veldspar.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """Values as they are; only the two sides' kinds of lists are made one."""
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rank(row):
    return tuple((v is None, isinstance(v, float), str(round(v, 2) + 0.0) if isinstance(v, float) else str(v)) for v in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=rank)
    rel = duck.sql(registry.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=rank)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            # Lists must be equal to the last bit, the sign of zero included; single numbers nearly.
            assert repr(x) == repr(y) or isinstance(x, float) and isinstance(y, float) and (x == y or math.isclose(x, y, rel_tol=1e-6))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    assert entry.entry(spark).columns == ["vec_id", "label", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_stay_in_the_jvm(spark, sf_dir):
    plan = registry.QUERIES["filter_project"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan
    top = registry.QUERIES["cosine_topk"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top and "Python" not in top
    agg = registry.QUERIES["avg_vec_group"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "partial_avg" in agg


@pytest.mark.parametrize("name, threshold", [("similarity_join_inner", 0.4), ("dsl_similarity_join", 0.35)])
def test_whole_similarity_joins_equal_brute_force(spark, sf_dir, name, threshold):
    """Pairs of any two vectors, those of equal parity and of large ids included."""
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    a, b = np.nonzero(m @ m.T > threshold)
    got = sorted((r["aid"], r["bid"]) for r in registry.QUERIES[name](spark, sf_dir).collect())
    assert got == sorted(zip(ids[a].tolist(), ids[b].tolist(), strict=True))
    assert any((x - y) % 2 == 0 and x != y for x, y in got) and any(x >= 100 and y >= 100 and x != y for x, y in got)


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_whole_outer_joins_keep_all_rows(spark, sf_dir, how):
    rows = registry.QUERIES[f"{how}_join"](spark, sf_dir).collect()
    customers, orders = ({r[0] for r in spark.read.parquet(f"{sf_dir}/{x}.parquet").select(c).collect()} for x, c in (("customer", "c_custkey"), ("orders", "o_orderkey")))
    assert how == "right" or customers <= {r["c_custkey"] for r in rows}
    assert how == "left" or orders <= {r["o_orderkey"] for r in rows}
