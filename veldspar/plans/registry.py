"""Registered queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as V
from ..operators import aggregate, join, order, search, window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def rounded(c: Column) -> Column:
    return F.transform(c, lambda x: F.round(x.cast("double"), 5) + F.lit(0.0))  # no negative zero


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding of smallest vec_id."""
    return t(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


def literal(width: int = 64) -> list[float]:
    """A fixed query vector."""
    return [((k * 7) % 11 - 5) / 10 for k in range(width)]


Q64 = "[" + ", ".join(f"{v}" for v in literal()) + "]::DOUBLE[]"
E64 = "embedding::DOUBLE[]"


def _norm(v: str) -> str:
    return f"sqrt(list_sum([x * x for x in {v}]))"


# --- vectors -------------------------------------------------------------------------------


@query(
    f"SELECT vec_id, label, round(list_dot_product(e, q) / ({_norm('e')} * {_norm('q')}), 6) AS score FROM (SELECT vec_id, label, {E64} AS e,"
    f" (SELECT {E64} FROM embeddings ORDER BY vec_id LIMIT 1) AS q FROM embeddings) ORDER BY list_dot_product(e, q) / ({_norm('e')} * {_norm('q')}) DESC, vec_id LIMIT 10"
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.similarity_topk(t(spark, sf_dir, "embeddings"), "embedding", query_vector(spark, sf_dir), 10, tie_break=["vec_id"])
    return top.select("vec_id", "label", r6(F.col("score")).alias("score"))


@query(f"SELECT vec_id, round(list_dot_product({E64}, {Q64}) / ({_norm(E64)} * {_norm(Q64)}), 6) AS score FROM embeddings WHERE list_dot_product({E64}, {Q64}) / ({_norm(E64)} * {_norm(Q64)}) > 0.1")
def cosine_threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.threshold_filter(t(spark, sf_dir, "embeddings"), "embedding", literal(), 0.1)
    return near.select("vec_id", r6(V.cosine_sim("embedding", literal())).alias("score"))


@query(f"SELECT vec_id, round({_norm(E64)}, 6) AS norm FROM embeddings")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", r6(V.l2_norm("embedding")).alias("norm"))


@query(f"SELECT vec_id, round(list_dot_product({E64}, {Q64}), 6) AS dot FROM embeddings")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", r6(V.dot("embedding", literal())).alias("dot"))


@query(f"SELECT vec_id, round(list_distance({E64}, {Q64}), 6) AS distance FROM embeddings")
def euclidean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", r6(V.distance("embedding", literal())).alias("distance"))


@query(f"SELECT vec_id, [round((x / {_norm(E64)})::FLOAT::DOUBLE, 5) + 0.0 for x in {E64}] AS unit FROM embeddings")
def normalize_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", rounded(V.normalize("embedding")).alias("unit"))


@query("SELECT vec_id, [round((x + x)::DOUBLE, 5) + 0.0 for x in embedding] AS doubled FROM embeddings")
def vec_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", rounded(V.vec_add("embedding", "embedding")).alias("doubled"))


@query("SELECT vec_id, [round((x * 3)::DOUBLE, 5) + 0.0 for x in embedding] AS tripled FROM embeddings")
def vec_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", rounded(V.vec_scale("embedding", 3)).alias("tripled"))


def _vec_sql(f: str) -> str:
    return (
        f"SELECT label, list(v ORDER BY k) AS vec FROM (SELECT label, k, round({f}(x::DOUBLE)::FLOAT::DOUBLE, 4) + 0.0 AS v FROM"
        " (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings) GROUP BY label, k) GROUP BY label"
    )


def _vec_group(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = V.aggregates.vec_agg(kind, F.col("embedding"), [64])
        out = aggregate.group_agg(t(spark, sf_dir, "embeddings"), ["label"], {"vec": made})
        return out.select("label", F.transform("vec", lambda x: F.round(x.cast("double"), 4) + F.lit(0.0)).alias("vec"))

    run.__name__ = f"{kind}_vec_group"
    return run


for _kind in ("avg", "sum", "min", "max"):
    query(_vec_sql(_kind))(_vec_group(_kind))


@query(_vec_sql("avg"))
def avg_vec_any_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.vec_by_position(t(spark, sf_dir, "embeddings"), ["label"], "embedding", "avg", "vec")
    return out.select("label", F.transform("vec", lambda x: F.round(x.cast("double"), 4) + F.lit(0.0)).alias("vec"))


# --- matrices ------------------------------------------------------------------------------


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("vec_id", V.as_matrix(F.col("embedding"), 8, 8).alias("m"), F.slice("embedding", 1, 8).alias("v"))


def _nested(c: Column) -> Column:
    return F.transform(c, lambda row: F.transform(row, lambda x: F.round(x.cast("double"), 5) + F.lit(0.0)))


@query("SELECT vec_id, [[round(embedding[i * 8 + j + 1]::DOUBLE, 5) + 0.0 for j in range(8)] for i in range(8)] AS m, [round(x::DOUBLE, 5) + 0.0 for x in embedding] AS flat, embedding IS NULL AS misfit FROM embeddings")
def cast_vector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "embeddings").select("vec_id", V.as_matrix(F.col("embedding"), 8, 8).alias("m"), V.as_matrix(F.col("embedding"), 8, 7).alias("bad"))
    return g.select("vec_id", _nested(F.col("m")).alias("m"), rounded(V.as_vector(F.col("m"), 64)).alias("flat"), F.col("bad").isNotNull().alias("misfit"))


@query("SELECT vec_id, [round(x::DOUBLE, 5) + 0.0 for x in embedding] AS flat FROM embeddings")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("vec_id", rounded(V.flatten(F.col("m"))).alias("flat"))


@query("SELECT vec_id, [[round(embedding[i * 8 + j + 1]::DOUBLE, 5) + 0.0 for i in range(8)] for j in range(8)] AS m FROM embeddings")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("vec_id", _nested(V.transpose(F.col("m"))).alias("m"))


def by_place(df: DataFrame, key: str, *vectors: str) -> DataFrame:
    """A row for each number of the vectors: the key, the vector's name, the place, the value."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(v).alias("part"), F.col(v).cast("array<double>").alias("x")) for v in vectors])).alias("p")).select(
        key, "p.part", F.posexplode("p.x").alias("k", "value")
    )


@query(
    f"WITH e AS (SELECT vec_id, {E64} AS e FROM embeddings), m AS (SELECT vec_id, 'mm' AS part, [list_sum([e[(p // 8) * 8 + k + 1] * e[(p % 8) * 8 + k + 1] for k in range(8)])::FLOAT::DOUBLE for p in range(64)] AS x FROM e"
    " UNION ALL SELECT vec_id, 'mv', [list_sum([e[i * 8 + k + 1] * e[k + 1] for k in range(8)])::FLOAT::DOUBLE for i in range(8)] FROM e)"
    " SELECT vec_id, part, unnest(range(len(x)))::INT AS k, round(unnest(x), 4) + 0.0 AS value FROM m"
)
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    mm, mv = V.matmul(F.col("m"), V.transpose(F.col("m"))), V.matmul(F.col("m"), F.col("v"), vector=True)
    return by_place(g.select("vec_id", F.flatten(mm).alias("mm"), mv.alias("mv")), "vec_id", "mm", "mv").withColumn("value", F.round("value", 4) + F.lit(0.0))


@query("SELECT vec_id, '8x8' AS shape, '64x1' AS vector_shape FROM embeddings")
def mat_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.mat_shape(V.as_matrix(F.col("embedding"), 8, 8)).alias("shape"), V.mat_shape(F.col("embedding"), matrix=False).alias("vector_shape"))


@query("SELECT vec_id, [[round(((embedding[i * 8 + j + 1]::DOUBLE * 2)::FLOAT::DOUBLE + 1)::FLOAT::DOUBLE, 5) + 0.0 for j in range(8)] for i in range(8)] AS m FROM embeddings")
def matrix_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = V.mat_arith("+", F.col("m"), F.col("m"))
    return _grid(spark, sf_dir).select("vec_id", _nested(V.mat_arith("+", twice, F.lit(1.0), scalar=True)).alias("m"))


@query(
    "SELECT label, list(r ORDER BY i) AS m FROM (SELECT label, i, list(v ORDER BY j) AS r FROM (SELECT label, k // 8 AS i, k % 8 AS j, round(sum(x::DOUBLE)::FLOAT::DOUBLE, 4) + 0.0 AS v FROM"
    " (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings) GROUP BY label, k) GROUP BY label, i) GROUP BY label"
)
def sum_matrix_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select("label", V.as_matrix(F.col("embedding"), 8, 8).alias("m"))
    out = aggregate.group_agg(e, ["label"], {"m": V.aggregates.vec_agg("sum", F.col("m"), [8, 8])})
    return out.select("label", F.transform("m", lambda r: F.transform(r, lambda x: F.round(x.cast("double"), 4) + F.lit(0.0))).alias("m"))


# --- projection, filter, scalars -----------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity >= 45 AND NOT (l_returnflag = 'R') AND l_discount <> 0.05")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").filter((F.col("l_quantity") >= 45) & ~(F.col("l_returnflag") == "R") & (F.col("l_discount") != 0.05))
    return li.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 4, 9, 16, 25) OR p_retailprice BETWEEN 1000 AND 1010 OR p_name IS NULL")
def in_between_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    return p.filter(F.col("p_size").isin(1, 4, 9, 16, 25) | F.col("p_retailprice").between(1000, 1010) | F.col("p_name").isNull()).select("p_partkey", "p_size")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def case_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low")
    code = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    return t(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"), code.alias("code"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag, coalesce(nullif(l_returnflag, 'N'), l_linestatus, 'x') AS shown FROM lineitem")
def coalesce_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = V.nullif(F.col("l_returnflag"), F.lit("N"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"), F.coalesce(flag, "l_linestatus", F.lit("x")).alias("shown"))


@query("SELECT p_partkey, trunc(p_retailprice)::BIGINT AS whole, p_size::VARCHAR AS size_text, p_size <> 0 AS has_size, try_cast(p_brand AS BIGINT) AS no_number, p_brand <> '' AS named FROM part")
def cast_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    kind = lambda c: p.schema[c].dataType
    return p.select(
        "p_partkey", V.cast_int(F.col("p_retailprice"), kind("p_retailprice")).alias("whole"), F.col("p_size").cast("string").alias("size_text"),
        V.cast_bool(F.col("p_size"), kind("p_size")).alias("has_size"), V.cast_int(F.col("p_brand"), kind("p_brand")).alias("no_number"), V.cast_bool(F.col("p_brand"), kind("p_brand")).alias("named"),
    )


@query("SELECT p_partkey, CASE WHEN p_size - 10 <> 0 THEN trunc(p_partkey::DOUBLE / (p_size - 10))::BIGINT END AS q, round(p_retailprice / p_size, 6) AS each FROM part")
def int_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, each = V.div(F.col("p_partkey"), F.col("p_size") - 10, True), V.div(F.col("p_retailprice"), F.col("p_size"), False)
    return t(spark, sf_dir, "part").select("p_partkey", q.alias("q"), F.round(each, 6).alias("each"))


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS n, trim(c_name) AS trimmed, concat(c_name, '/', c_mktsegment) AS joined, substr(c_name, 1, 4) AS head, substr(c_name, 5) AS tail FROM customer")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return t(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(c).alias("up"), F.lower("c_mktsegment").alias("low"), V.length(c).cast("long").alias("n"), V.trim(c).alias("trimmed"),
        V.concat_text(c, F.lit("/"), F.col("c_mktsegment")).alias("joined"), V.substr(c, F.lit(1), F.lit(4)).alias("head"), V.substr(c, F.lit(5)).alias("tail"),
    )


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.distinct(t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


# --- joins ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    j = join.equi_join(o, t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [("o_custkey", "c_custkey")])
    return j.select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("total"))


def _outer(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, o = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        return join.equi_join(c, o, [("c_custkey", "o_custkey")], how)

    run.__name__ = f"{how}_join"
    return run


for _how in ("left", "right", "full"):
    query(f"SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM customer {_how.upper()} JOIN orders ON c_custkey = o_custkey")(_outer(_how))


@query(
    "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', (SELECT min(r_name) FROM region)) GROUP BY n_name"
)
def chained_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = t(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    j = join.equi_join(t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])
    j = join.equi_join(j, t(spark, sf_dir, "nation"), [("c_nationkey", "n_nationkey")])
    j = join.equi_join(j, t(spark, sf_dir, "region").filter(F.col("r_name").isin("ASIA", "EUROPE", least)), [("n_regionkey", "r_regionkey")])
    return aggregate.group_agg(j, ["n_name"], {"orders": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)})


@query("SELECT a.n_nationkey, a.n_name, b.n_nationkey AS r_n_nationkey, b.n_name AS r_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "nation")
    return join.equi_join(n, n, [("n_regionkey", "n_regionkey")]).select("n_nationkey", "n_name", "r_n_nationkey", "r_n_name")


_COS = f"list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ({_norm('a.embedding::DOUBLE[]')} * {_norm('b.embedding::DOUBLE[]')})"


def _similar(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = t(spark, sf_dir, "embeddings")
        a, b = e.select(F.col("vec_id").alias("aid"), F.col("embedding").alias("av")), e.select(F.col("vec_id").alias("bid"), F.col("embedding").alias("bv"))
        return join.similarity_join(a, b, "av", "bv", 0.4, how).select("aid", "bid")

    run.__name__ = f"similarity_join_{how}"
    return run


for _how in ("inner", "left", "right", "full"):
    query(
        f"WITH j AS (SELECT a.vec_id AS aid, b.vec_id AS bid FROM embeddings a JOIN embeddings b ON {_COS} > 0.4) SELECT * FROM j"
        + (" UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id NOT IN (SELECT aid FROM j)" if _how in ("left", "full") else "")
        + (" UNION ALL SELECT NULL, vec_id FROM embeddings WHERE vec_id NOT IN (SELECT bid FROM j)" if _how in ("right", "full") else "")
    )(_similar(_how))


# --- aggregation ---------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.global_agg(
        t(spark, sf_dir, "lineitem"),
        {"n": F.count(F.lit(1)), "total": F.round(F.sum("l_extendedprice"), 2), "discount": F.round(F.avg("l_discount"), 6), "first_ship": F.min("l_shipdate"), "last_ship": F.max("l_shipdate")},
    )


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def global_agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.global_agg(t(spark, sf_dir, "lineitem").filter("l_quantity < 0"), {"n": F.count(F.lit(1)), "total": F.sum("l_linenumber")})


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_linenumber)::BIGINT AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_quantity), 6) AS qty, count(*) AS n"
    " FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING avg(l_quantity) > 5"
)
def group_agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.group_agg(
        t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
        {"lines": F.sum("l_linenumber"), "net": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), "qty": F.round(F.avg("l_quantity"), 6), "n": F.count(F.lit(1))},
        F.col("qty") > 5,
    )


@query("SELECT l_returnflag, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS big, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS cheap FROM lineitem GROUP BY l_returnflag")
def sum_case_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.group_agg(
        t(spark, sf_dir, "lineitem"), ["l_returnflag"],
        {"big": F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)), "cheap": F.count(F.when(F.col("l_discount") > 0.05, 1))},
    )


@query("SELECT c_mktsegment, sum(c_nationkey)::BIGINT * 2 + count(*) AS mixed FROM customer GROUP BY c_mktsegment")
def group_by_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = aggregate.group_agg(t(spark, sf_dir, "customer"), ["c_mktsegment"], {"s": F.sum("c_nationkey"), "n": F.count(F.lit(1))})
    return g.select("c_mktsegment", (F.col("s") * 2 + F.col("n")).alias("mixed"))


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def min_max_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return aggregate.group_agg(t(spark, sf_dir, "events"), ["event_type"], {"n": F.count(v), "total": F.round(F.sum(v), 4), "low": r6(F.min(v)), "high": r6(F.max(v))})


# --- windows -------------------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_ORDER = [("ts", False), ("event_id", False)]


@query(f"SELECT event_id, row_number() OVER ({_W}) AS rn FROM events")
def row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.rank_window(t(spark, sf_dir, "events"), "row_number", "rn", ["user_id"], _ORDER).select("event_id", "rn")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS drk FROM part")
def rank_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    p = window.rank_window(p, "rank", "rk", ["p_brand"], [("p_size", True)])
    return window.rank_window(p, "dense_rank", "drk", ["p_brand"], [("p_size", True)]).select("p_partkey", "rk", "drk")


@query(f"SELECT event_id, round(lag(value) OVER ({_W}), 6) AS before, round(lead(value, 2) OVER ({_W}), 6) AS after2 FROM events")
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = window.lag(t(spark, sf_dir, "events"), "value", "before", partition=["user_id"], order=_ORDER)
    e = window.lead(e, "value", "after2", 2, partition=["user_id"], order=_ORDER)
    return e.select("event_id", r6(F.col("before")).alias("before"), r6(F.col("after2")).alias("after2"))


_F = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, round(sum(value) OVER {_F}, 4) AS s, round(avg(value) OVER {_F}, 9) AS a, count(value) OVER {_F} AS n, round(min(value) OVER {_F}, 6) AS low, round(max(value) OVER {_F}, 6) AS high FROM events")
def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    for kind, name in (("sum", "s"), ("avg", "a"), ("count", "n"), ("min", "low"), ("max", "high")):
        e = window.running(e, kind, F.col("value"), name, ["user_id"], _ORDER)
    return e.select("event_id", F.round("s", 4).alias("s"), F.round("a", 9).alias("a"), "n", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(
    "SELECT vec_id, 'mean' AS part, k::INT AS k, round((avg(x::DOUBLE) OVER (PARTITION BY label, k ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::FLOAT::DOUBLE, 4) + 0.0 AS value"
    " FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings)"
)
def running_vec_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = window.running_vec(t(spark, sf_dir, "embeddings"), "avg", "embedding", [64], "mean", ["label"], [("vec_id", False)])
    return by_place(e, "vec_id", "mean").withColumn("value", F.round("value", 4) + F.lit(0.0))


# --- order, limit, sets, nesting -----------------------------------------------------------


@query("SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def order_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order.order_by(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)])
    return order.limit_offset(o, 25, 10).select("o_orderkey", F.round("o_totalprice", 2).alias("total"))


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.union(*_keys(spark, sf_dir))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.union(*_keys(spark, sf_dir), keep_all=False)


from . import dsl_queries, signal_queries, store_queries, tensor_queries  # noqa: E402, F401
