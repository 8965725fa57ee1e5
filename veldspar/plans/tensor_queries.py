"""Registered queries of the tensor statements: columns of the tables taken into tensors, and back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dsl_queries import session
from .registry import query

#: The tensors that most queries start from: two columns of nation, by place.
_START = "LET a = nation.n_nationkey\nLET b = nation.n_regionkey\n"
_N = "n AS (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS k, n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b FROM nation)"


def told(spark: SparkSession, tensors: dict) -> DataFrame:
    """(name, k, value): the numbers of each tensor by place."""
    rows = [(n, k, float(x) + 0.0) for n, a in tensors.items() for k, x in enumerate(a.ravel().tolist())]
    return spark.createDataFrame(rows, "name string, k int, value double")


def tensors(name: str, source: str, sql: str, names: str, digits: int = 4) -> None:
    """A query that gives the tensors `names` after a script."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        s.script(source)
        return told(spark, {n: s.db.tensors[n].value().astype(float).round(digits) for n in names.split()})

    run.__name__ = name
    query(sql)(run)


def _rows(**values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, k, {v} AS value FROM n" for n, v in values.items())


tensors(
    "tensor_elementwise",
    _START + "VECTOR two = [10, 20]\nLET s = ADD a b\nLET i = a - b\nLET d = SUBTRACT a b\nLET m = MULTIPLY a b\nLET o = b + 1\nLET q = DIVIDE a o\nLET h = a / 2.0\nLET c = SCALE a BY 3\nLET r = a + two\nLET t = MULTIPLY a two",
    f"WITH {_N} " + _rows(s="a + b", i="a - b", d="a - b", m="a * b", o="b + 1", q="round((a / (b + 1))::FLOAT::DOUBLE, 4)", h="a / 2", c="a * 3", r="a + CASE k WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 0 END", t="a * CASE k WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 1 END"),
    "s i d m o q h c r t",
)
tensors(
    "tensor_shapes",
    _START + "LET m = RESHAPE a TO [5, 5]\nLET t = TRANSPOSE m\nLET f = FLATTEN t\nLET st = STACK a b\nLET one = m[1, 2]\nLET part = m[1:3, *]\nLET col = m[:, 1]\nLET tail = a[20:]",
    f"WITH {_N} SELECT 'm' AS name, k, a AS value FROM n UNION ALL SELECT 't', ((k % 5) * 5 + k // 5)::INT, a FROM n UNION ALL SELECT 'f', ((k % 5) * 5 + k // 5)::INT, a FROM n UNION ALL SELECT 'st', k, a FROM n UNION ALL SELECT 'st', k + 25, b FROM n"
    " UNION ALL SELECT 'one', 0, a FROM n WHERE k = 7 UNION ALL SELECT 'part', k - 5, a FROM n WHERE k BETWEEN 5 AND 14 UNION ALL SELECT 'col', (k // 5)::INT, a FROM n WHERE k % 5 = 1 UNION ALL SELECT 'tail', k - 20, a FROM n WHERE k >= 20",
    "m t f st one part col tail",
)
tensors(
    "tensor_linear",
    _START + "LET m = RESHAPE a TO [5, 5]\nLET t = TRANSPOSE m\nLET p = MATMUL m t\nLET dot = CORRELATE a WITH b\nLET cos = SIMILARITY a WITH b\nLET far = DISTANCE a TO b\nLET unit = NORMALIZE b",
    f"WITH {_N} SELECT 'p' AS name, ((x.k // 5) * 5 + y.k // 5)::INT AS k, sum(x.a * y.a) AS value FROM n x JOIN n y ON x.k % 5 = y.k % 5 GROUP BY x.k // 5, y.k // 5"
    " UNION ALL SELECT 'dot', 0, sum(a * b) FROM n UNION ALL SELECT 'cos', 0, round((sum(a * b) / sqrt(sum(a * a) * sum(b * b)))::FLOAT::DOUBLE, 4) FROM n UNION ALL SELECT 'far', 0, round(sqrt(sum((a - b) * (a - b)))::FLOAT::DOUBLE, 4) FROM n"
    " UNION ALL SELECT 'unit', k, round((b / (SELECT sqrt(sum(b * b)) FROM n))::FLOAT::DOUBLE, 4) FROM n",
    "p dot cos far unit",
)
tensors(
    "tensor_definitions",
    "VECTOR v = [1, 2.5, -3]\nMATRIX m = [[1, 2], [3, 4]]\nDEFINE t AS TENSOR [2, 1, 2] VALUES [5, 6, 7, 8]\nDEFINE w AS STRICT TENSOR [3] VALUES [1, 0, 2]\nLET p = (v + w) * 2 - v\nDERIVE half FROM v / 2.0\nLAZY LET z = NORMALIZE w\nBIND copy TO t",
    "SELECT * FROM (VALUES ('v', 0, 1::DOUBLE), ('v', 1, 2.5), ('v', 2, -3), ('m', 0, 1), ('m', 1, 2), ('m', 2, 3), ('m', 3, 4), ('copy', 0, 5), ('copy', 1, 6), ('copy', 2, 7), ('copy', 3, 8),"
    " ('p', 0, 3), ('p', 1, 2.5), ('p', 2, 1), ('half', 0, 0.5), ('half', 1, 1.25), ('half', 2, -1.5), ('z', 0, 0.4472), ('z', 1, 0), ('z', 2, 0.8944)) AS x(name, k, value)",
    "v m copy p half z",
)
tensors(
    "tensor_stats",
    "LET total = SUM embeddings.embedding\nLET mean = MEAN embeddings.embedding\nLET spread = STDEV embeddings.embedding\nLET keys = SUM nation.n_nationkey\nLET sd = STDEV customer.c_acctbal",
    "WITH e AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT 'total' AS name, 0 AS k, round(sum(x), 2) AS value FROM e UNION ALL SELECT 'mean', 0, round(avg(x), 2) + 0.0 FROM e UNION ALL SELECT 'spread', 0, round(stddev_pop(x), 2) FROM e"
    " UNION ALL SELECT 'keys', 0, round(sum(n_nationkey), 2) FROM nation UNION ALL SELECT 'sd', 0, round(stddev_pop(c_acctbal), 2) FROM customer",
    "total mean spread keys sd",
    2,
)
_SPECTRUM = (
    "z AS (SELECT f, sum(b * cos(2 * pi() * ((f * k) % 24) / 24)) AS re, -sum(b * sin(2 * pi() * ((f * k) % 24) / 24)) AS im FROM (SELECT * FROM n WHERE k < 24), (SELECT unnest(range(13)) AS f) GROUP BY f)"
)
tensors(
    "tensor_spectra",
    _START + "LET x = b[0:24]\nLET z = FFT x\nLET back = IFFT z\nLET mag = MAGNITUDE z\nLET p = PSD x WINDOW 24\nLET c = MATCHED_FILTER x WITH x\nLET band = BANDPASS x FROM 0.0 TO 12.0 WITH RATE 24.0",
    f"WITH {_N}, {_SPECTRUM} SELECT 'back' AS name, k, b AS value FROM n WHERE k < 24 UNION ALL SELECT 'band', k, b FROM n WHERE k < 24 UNION ALL SELECT 'mag', f::INT, round(sqrt(re * re + im * im), 2) FROM z UNION ALL SELECT 'p', f::INT, round(re * re + im * im, 2) FROM z"
    " UNION ALL SELECT 'c', x.k, sum(y.b * w.b) FROM n x, n y, n w WHERE x.k < 24 AND y.k < 24 AND w.k < 24 AND w.k = (x.k + y.k) % 24 GROUP BY x.k",
    "back band mag p c",
    2,
)


@query("SELECT n_nationkey::DOUBLE AS key, n_regionkey::DOUBLE AS region, n_nationkey::DOUBLE * 2 AS twice FROM nation WHERE n_regionkey > 0")
def tensor_first_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.script('LET a = nation.n_nationkey\nLET b = nation.n_regionkey\nLET raw = dataset("raw")\nraw.add_column(key, a)\nATTACH b TO raw.region\nBIND copy TO raw\nLET c = copy.key * 2\nATTACH c TO copy.twice')
    out = s.sql("SELECT key, region, twice FROM copy WHERE region > 0")
    return out.select(*[out[c].cast("double").alias(c) for c in out.columns])


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey::DOUBLE + n_regionkey AS total FROM nation")
def attach_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.script("LET a = nation.n_nationkey\nLET b = nation.n_regionkey\nLET t = a + b\nATTACH t TO nation.total")
    out = s.sql("SELECT * FROM nation")
    return out.withColumn("total", out["total"].cast("double"))


@query(
    "SELECT * FROM (VALUES ('lineage', 0, 'unit <- NORMALIZE'), ('lineage', 1, '  s <- ADD'), ('lineage', 2, '    v <- ROOT'), ('lineage', 3, '    w <- ROOT'), ('shape', 0, '[3]'), ('kinds', 0, 'lazy: lazy, not computed'), ('kinds', 1, 's: strict, shape [3]'),"
    " ('kinds', 2, 'unit: strict, shape [3]'), ('kinds', 3, 'v: normal, shape [3]'), ('kinds', 4, 'w: strict, shape [3]'), ('stored', 0, 'unit'), ('loaded', 0, '[3]')) AS x(what, k, line)"
)
def tensor_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.script("VECTOR v = [1, 2, 3]\nDEFINE w AS STRICT TENSOR [3] VALUES [1, 1, 1]\nLET s = v + w\nLET unit = NORMALIZE s\nLAZY LET lazy = SUM v\nSAVE TENSOR unit")
    said = {"lineage": "SHOW LINEAGE unit", "shape": "SHOW SHAPE unit", "kinds": "SHOW ALL TENSORS", "stored": "LIST TENSORS"}
    rows = [(what, k, line) for what, q in said.items() for k, line in enumerate(s.execute(q).message.splitlines())]
    s.script("RESET\nLOAD TENSOR unit")
    return spark.createDataFrame([*rows, ("loaded", 0, s.execute("SHOW SHAPE unit").message)], "what string, k int, line string")
