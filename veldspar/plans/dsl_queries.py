"""Registered queries that go through the query language and its session."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Session
from .registry import E64, _norm, literal, query, t

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    for name in TABLES:
        if name in ("nation", "region") or "://" in sf_dir or os.path.exists(f"{sf_dir}/{name}.parquet"):
            s.register(name, t(spark, sf_dir, name))
    return s


def script(name: str, source: str, sql: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A query that is the last statement of a script."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(session(spark, sf_dir).script(source)[-1].frame)

    run.__name__ = name
    query(sql)(run)


def r(*columns: str, digits: int = 4) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


script(
    "cte",
    "WITH rich AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000), n AS (SELECT n_nationkey, n_name FROM nation)\n"
    "SELECT n_name, COUNT(*) AS customers, SUM(c_acctbal) AS total FROM rich JOIN n ON c_nationkey = n_nationkey GROUP BY n_name",
    "WITH rich AS (SELECT * FROM customer WHERE c_acctbal > 5000) SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS total FROM rich JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    r("total"),
)
script(
    "subquery_from",
    "SELECT x.o_orderstatus, MAX(x.o_totalprice) AS most FROM (SELECT o_orderstatus, o_totalprice FROM orders WHERE o_totalprice < 100000) AS x GROUP BY o_orderstatus",
    "SELECT o_orderstatus, round(max(o_totalprice), 4) AS most FROM (SELECT * FROM orders WHERE o_totalprice < 100000) GROUP BY o_orderstatus",
    r("most"),
)
script(
    "dsl_join_window",
    "SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name, RANK() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC) AS rk, SUM(o_totalprice) OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS running\n"
    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "SELECT o_orderkey, c_name, rank() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC) AS rk,"
    " round(sum(o_totalprice) OVER (PARTITION BY c_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running"
    " FROM orders JOIN customer ON o_custkey = c_custkey",
    r("running", digits=2),
)
script(
    "dsl_group_having",
    "SELECT l_returnflag, AVG(l_quantity) AS qty, SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS cheap, COUNT(*) * 2 AS twice FROM lineitem\n"
    "WHERE l_linenumber IN (1, 2, 3) AND l_quantity BETWEEN 5 AND 45 GROUP BY l_returnflag HAVING AVG(l_quantity) > 1 ORDER BY qty DESC",
    "SELECT l_returnflag, round(avg(l_quantity), 4) AS qty, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS cheap, count(*) * 2 AS twice FROM lineitem"
    " WHERE l_linenumber IN (1, 2, 3) AND l_quantity BETWEEN 5 AND 45 GROUP BY l_returnflag HAVING avg(l_quantity) > 1",
    r("qty"),
)
script(
    "dsl_union",
    "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1",
    "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT * FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1))",
)
script(
    "dsl_vector_centroids",
    "SELECT label, AVG_VEC(embedding) AS centroid, COUNT(*) AS n FROM embeddings GROUP BY label",
    "SELECT label, list(v ORDER BY k) AS centroid, any_value(n) AS n FROM (SELECT label, k, round(avg(x::DOUBLE)::FLOAT::DOUBLE, 4) + 0.0 AS v, count(*) AS n FROM"
    " (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings) GROUP BY label, k) GROUP BY label",
    lambda df: df.withColumn("centroid", F.transform("centroid", lambda x: F.round(x.cast("double"), 4) + F.lit(0.0))),
)
script(
    "dsl_similarity_join",
    "DATASET a FROM embeddings SELECT vec_id AS aid, embedding AS v\nDATASET b FROM embeddings SELECT vec_id AS bid, embedding AS v\nSELECT aid, bid FROM a JOIN b ON COSINE_SIM(a.v, b.v) > 0.35",
    f"SELECT a.vec_id AS aid, b.vec_id AS bid FROM embeddings a JOIN embeddings b"
    f" ON list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ({_norm('a.embedding::DOUBLE[]')} * {_norm('b.embedding::DOUBLE[]')}) > 0.35",
)
script(
    "pipeline_filter_sort_limit",
    "DEFINE PIPELINE big AS WHERE o_totalprice > 1000 THEN SELECT o_orderkey, o_totalprice AS price THEN ORDER BY price DESC, o_orderkey THEN LIMIT 20\nAPPLY PIPELINE big ON orders INTO top",
    "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_totalprice > 1000 ORDER BY price DESC, o_orderkey LIMIT 20",
)
script(
    "pipeline_normalize",
    "DEFINE PIPELINE units AS SELECT vec_id, VEC_SCALE(embedding, 3) AS v THEN NORMALIZE v\nAPPLY PIPELINE units ON embeddings INTO unit\nSELECT vec_id, L2_NORM(v) AS n FROM unit",
    "SELECT vec_id, 1.0::DOUBLE AS n FROM embeddings",
    r("n"),
)
script(
    "transform_into",
    "TRANSFORM customer SELECT c_custkey, UPPER(c_mktsegment) AS seg, c_acctbal / 2 AS half WHERE c_acctbal > 0 INTO positive\nSELECT * FROM positive",
    "SELECT c_custkey, upper(c_mktsegment) AS seg, round(c_acctbal / 2, 4) AS half FROM customer WHERE c_acctbal > 0",
    r("half"),
)
script(
    "update_rows",
    'UPDATE part SET p_size = p_size + 100, p_brand = CASE WHEN p_size > 120 THEN "late" ELSE p_brand END WHERE p_size > 10 AND p_size < 40\nSELECT p_partkey, p_size, p_brand FROM part',
    "SELECT p_partkey, CASE WHEN p_size > 10 AND p_size < 40 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_size > 20 AND p_size < 40 THEN 'late' ELSE p_brand END AS p_brand FROM part",
)
script(
    "delete_rows",
    "DELETE FROM supplier WHERE s_nationkey IN (1, 2, 3) OR s_acctbal < 0\nSELECT s_suppkey, s_nationkey FROM supplier",
    "SELECT s_suppkey, s_nationkey FROM supplier WHERE NOT (s_nationkey IN (1, 2, 3) OR s_acctbal < 0)",
)
script(
    "insert_rows",
    'DATASET items COLUMNS (id: Int, name: String?, price: Float DEFAULT 1.5, v: Vector(2))\nINSERT INTO items VALUES (1, "a", 2.5, [1, 0])\nINSERT INTO items (id = 2, v = [0.5, 0.25])\nSELECT id, name, price, L2_NORM(v) AS n FROM items',
    "SELECT * FROM (VALUES (1::BIGINT, 'a', 2.5::DOUBLE, 1.0::DOUBLE), (2, NULL, 1.5, 0.559)) AS x(id, name, price, n)",
    lambda df: df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("price", "n")}).withColumn("n", F.round("n", 3)),
)
script(
    "computed_column",
    "DATASET line FROM lineitem SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount\nALTER DATASET line ADD COLUMN net = l_extendedprice * (1 - l_discount)\nSELECT l_orderkey, l_linenumber, net FROM line",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
    r("net"),
)
script(
    "lazy_column",
    "DATASET cust FROM customer SELECT c_custkey, c_acctbal\nALTER DATASET cust ADD COLUMN band = CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END LAZY\n"
    "UPDATE cust SET c_acctbal = 0 - 1 WHERE c_custkey < 50\nMATERIALIZE cust\nSELECT band, COUNT(*) AS n FROM cust GROUP BY band",
    "SELECT (CASE WHEN c_custkey < 50 OR c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END)::BIGINT AS band, count(*) AS n FROM customer GROUP BY 1",
)
script(
    "add_column_default",
    'DATASET n FROM nation SELECT n_nationkey\nALTER DATASET n ADD COLUMN kind: String DEFAULT "x"\nALTER DATASET n ADD COLUMN w: Int\nALTER DATASET n ADD COLUMN score: Float?\nSELECT * FROM n',
    "SELECT n_nationkey, 'x' AS kind, 0::BIGINT AS w, NULL::DOUBLE AS score FROM nation",
    lambda df: df.withColumn("score", F.col("score").cast("double")),
)
_Q = "[" + ", ".join(str(v) for v in literal()) + "]"
script(
    "search_topk",
    f"CREATE VECTOR INDEX ON embeddings(embedding)\nSEARCH embeddings ON embedding QUERY {_Q} LIMIT 12 INTO near\nSELECT vec_id FROM near",
    f"SELECT vec_id FROM embeddings ORDER BY list_dot_product({E64}, {_Q}::DOUBLE[]) / {_norm(E64)} DESC, vec_id LIMIT 12",
)
script(
    "dsl_null_rules",
    "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k, COALESCE(NULLIF(n_regionkey, 1), 0 - 1) AS shown, n_nationkey / n_regionkey AS q, CAST(n_name AS INT) AS no FROM nation WHERE NOT (NULLIF(n_regionkey, 1) = 2) OR NULLIF(n_regionkey, 1) IS NULL",
    "SELECT n_nationkey, nullif(n_regionkey, 1) AS k, coalesce(nullif(n_regionkey, 1), -1)::BIGINT AS shown, CASE WHEN n_regionkey <> 0 THEN n_nationkey // n_regionkey END::BIGINT AS q, NULL::BIGINT AS no FROM nation"
    " WHERE NOT (nullif(n_regionkey, 1) = 2) OR nullif(n_regionkey, 1) IS NULL",
)
