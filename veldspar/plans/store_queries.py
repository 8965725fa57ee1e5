"""Registered queries of sources, sinks, the catalogue and what is shown of it."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Session
from ..sources import find_connector, inspect
from .dsl_queries import session
from .registry import query, t


def place(s: Session, name: str) -> str:
    """A path of this query's own in the session's folder."""
    folder = os.path.join(s.root, f"query-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, name)


def lines(spark: SparkSession, said: dict[str, str]) -> DataFrame:
    rows = [(what, k, line) for what, text in said.items() for k, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "what string, k int, line string")


def _expected(*rows: tuple[str, int, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('{}', {}, '{}')".format(a, b, c.replace("'", "''")) for a, b, c in rows) + ") AS x(what, k, line)"


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def csv_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPORT CSV, and the chosen fields of the file read back by the connector."""
    s = session(spark, sf_dir)
    path = place(s, "c.csv")
    s.script(f'EXPORT CSV customer TO "{path}"\nUSE DATASET FROM "{path}" AS back FIELDS (c_custkey, c_name, c_nationkey, c_mktsegment)')
    return s.sql("SELECT * FROM back")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    path = place(s, "n.csv")
    s.script(f'EXPORT nation TO "{path}"\nIMPORT CSV FROM "{path}" AS back')
    return s.sql("SELECT * FROM back")


@query("SELECT vec_id, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 4) + 0.0 AS first FROM embeddings")
def export_csv_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors leave as JSON text."""
    s = session(spark, sf_dir)
    path = place(s, "e.csv")
    s.execute(f'EXPORT CSV embeddings TO "{path}"')
    v = F.from_json("embedding", "array<double>")
    return spark.read.csv(path, header=True).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("width"), (F.round(F.get(v, F.lit(0)), 4) + F.lit(0.0)).alias("first"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def import_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet table imported as a package, and loaded."""
    s = session(spark, sf_dir)
    s.script(f'IMPORT DATASET FROM "{sf_dir}/part.parquet" AS part_package FIELDS (p_partkey, p_name, p_size, p_retailprice)\nLOAD DATASET part_package')
    return s.sql("SELECT * FROM part_package")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def save_and_load_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.script("DATASET rich FROM supplier WHERE s_acctbal > 0 SELECT s_suppkey, s_nationkey, s_acctbal\nSAVE DATASET rich\nRESET\nLOAD DATASET rich")
    return s.sql("SELECT * FROM rich")


_STAT = "SELECT '{0}' AS column_name, count(*) FILTER ({0} IS NULL)::BIGINT AS null_count, round(min({0})::DOUBLE, 4) AS low, round(max({0})::DOUBLE, 4) AS high, round(avg({0})::DOUBLE, 2) AS mean FROM lineitem"


@query(" UNION ALL ".join(_STAT.format(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")))
def package_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stats.json of a saved package."""
    s = session(spark, sf_dir)
    s.script("DATASET li FROM lineitem SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount\nSAVE DATASET li")
    with open(s.folder("datasets", "li", "stats.json")) as f:
        stats = json.load(f)
    rows = [(c, v["null_count"], round(v["min"], 4), round(v["max"], 4), round(v["mean"], 2)) for c, v in stats.items() if not c.startswith("__")]
    return spark.createDataFrame(rows, "column_name string, null_count long, low double, high double, mean double")


@query("SELECT 'c_acctbal' AS column_name, count(*) FILTER (c_acctbal IS NULL)::BIGINT AS null_count, round(min(c_acctbal), 4) AS low, round(max(c_acctbal), 4) AS high FROM customer WHERE c_custkey > 10")
def row_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a session's dataset after a change, computed when they are asked for."""
    s = session(spark, sf_dir)
    s.script("DELETE FROM customer WHERE c_custkey <= 10")
    got = s.statistics("customer")["c_acctbal"]
    return spark.createDataFrame([("c_acctbal", got["null_count"], round(got["min"], 4), round(got["max"], 4))], "column_name string, null_count long, low double, high double")


@query("SELECT n_nationkey::DOUBLE AS key, n_regionkey::DOUBLE AS region FROM nation")
def numpy_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays of an .npz file as the columns of a dataset."""
    s = session(spark, sf_dir)
    rows = t(spark, sf_dir, "nation").collect()
    path = place(s, "n.npz")
    np.savez(path, key=np.array([r["n_nationkey"] for r in rows]), region=np.array([r["n_regionkey"] for r in rows]), other=np.ones(3))
    s.execute(f'USE DATASET FROM "{path}" AS arrays FIELDS (key, region)')
    out = s.sql("SELECT key, region FROM arrays")
    return out.select(out["key"].cast("double").alias("key"), out["region"].cast("double").alias("region"))


@query("SELECT n_nationkey::INT AS k, (n_nationkey * 10 + n_regionkey)::DOUBLE AS value FROM nation")
def zarr_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of two chunks, with a checksum behind each."""
    from ..sources.arrays import crc32c

    s = session(spark, sf_dir)
    rows = sorted(t(spark, sf_dir, "nation").collect())
    path, n = place(s, "n.zarr"), len(rows)
    a = np.array([r["n_nationkey"] * 10 + r["n_regionkey"] for r in rows], dtype="<f4")
    os.makedirs(os.path.join(path, "data", "c"))
    chunk = -(-n // 2)
    meta = {"zarr_format": 3, "node_type": "array", "shape": [n], "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [chunk]}}}
    meta |= {"chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]}
    for file, value in (("zarr.json", {"zarr_format": 3, "node_type": "group"}), ("data/zarr.json", meta)):
        with open(os.path.join(path, file), "w") as f:
            json.dump(value, f)
    for k in range(2):
        raw = np.pad(a[k * chunk : (k + 1) * chunk], (0, chunk - len(a[k * chunk : (k + 1) * chunk]))).tobytes()
        with open(os.path.join(path, "data", "c", str(k)), "wb") as f:
            f.write(raw + crc32c(raw).to_bytes(4, "little"))
    s.execute(f'USE DATASET FROM "{path}" AS z')
    values = s.db.tensors["z_data"].value().tolist()
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, value double")


@query("SELECT * FROM (VALUES ('shape', 'a', '[25]'), ('shape', 'cube', '[25, 2, 3]'), ('type', 'a', 'float'), ('type', 'cube', 'array<float>'), ('warning', 'short', 'left out')) AS x(what, name, value)")
def shape_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspecting a file tells, shapes of any rank among it, and the array that does not fit."""
    from ..sources import read_dataset

    s = session(spark, sf_dir)
    path = place(s, "a.npz")
    np.savez(path, a=np.arange(25), cube=np.zeros((25, 2, 3)), short=np.ones(4))
    got, seen = read_dataset(spark, path), inspect(spark, path)
    rows = [("shape", f.name, str(f.metadata["shape"])) for f in got.frame.schema] + [("type", f.name, f.dataType.simpleString()) for f in seen]
    rows += [("warning", "short", "left out") for w in got.warnings if "left out short" in w]
    return spark.createDataFrame(rows, "what string, name string, value string")


_PATHS = {"a.csv": "csv", "b.npy": "npy", "c.npz": "npz", "d.h5": "hdf5", "e.hdf5": "hdf5", "f.zarr": "zarr", "g.parquet": "parquet", "h.jsonl": "json"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in _PATHS.items()) + ") AS x(path, connector)")
def connector_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, find_connector(p)) for p in _PATHS], "path string, connector string")


@query("SELECT column_name AS name, column_type AS type FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'bigint'), ('c_acctbal', 'float'), ('c_mktsegment', 'string')) AS x(column_name, column_type)")
def connector_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    path = place(s, "c.csv")
    s.execute(f'EXPORT CSV customer TO "{path}"')
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in inspect(spark, path)], "name string, type string")


@query(
    _expected(
        ("schema", 0, "n_nationkey: Int"), ("schema", 1, "n_name: String?"), ("schema", 2, "size: Float?"), ("schema", 3, "twice: Int? LAZY"), ("indexes", 0, "near(n_nationkey): HASH"), ("datasets", 0, "near: 5 rows, 4 columns"),
        ("audit", 0, "near is sound"), ("lists", 0, "near"), ("deliver", 0, "ready"), ("versions", 0, "1 5"), ("versions", 1, "2 5"), ("metadata", 0, "ann"), ("say", 0, "hello"), ("rows", 0, "near: n_nationkey Int, n_name String, size Float, twice Int"),
    )
)
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET METADATA, CREATE INDEX, SAVE, LIST, DELIVER, AUDIT and the SHOW statements."""
    s = Session(spark)
    s.script("DATASET near COLUMNS (n_nationkey: Int, n_name: String?, size: Float?)")
    for k, n in enumerate(t(spark, sf_dir, "nation").orderBy("n_nationkey").limit(5).collect()):
        s.execute(f'INSERT INTO near VALUES ({n["n_nationkey"]}, "{n["n_name"]}", {k}.5)')
    s.script('ALTER DATASET near ADD COLUMN twice = n_nationkey * 2 LAZY\nCREATE INDEX ON near(n_nationkey)\nSAVE DATASET near\nSET DATASET near METADATA author = "ann"\nSAVE DATASET near')
    versions = [x.split() for x in s.execute("SHOW DATASET VERSIONS near").message.splitlines()]
    said = {
        "schema": s.execute("SHOW SCHEMA near").message, "indexes": s.execute("SHOW INDEXES near").message, "datasets": s.execute("SHOW ALL DATASETS").message, "audit": s.execute("AUDIT DATASET near").message,
        "lists": s.execute("LIST DATASETS").message, "deliver": "ready" if "is ready for delivery" in s.execute("DELIVER near").message else "", "versions": "\n".join(f"{k + 1} {v[2]}" for k, v in enumerate(versions)),
        "metadata": json.loads(s.execute("SHOW DATASET METADATA near").message)["user"]["author"], "say": s.execute('SHOW "hello"').message, "rows": s.execute("SHOW near").message,
    }
    return lines(spark, said)


@query(_expected(("before", 0, "default *"), ("before", 1, "lab"), ("inside", 0, "default"), ("inside", 1, "lab *"), ("own", 0, "t: 1 rows, 1 columns"), ("after", 0, "default *"), ("reset", 0, "no datasets")))
def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE, USE and DROP DATABASE, RESET; a database holds its own datasets."""
    s = Session(spark)
    said = {}
    s.script("CREATE DATABASE lab\nCREATE DATABASE IF NOT EXISTS lab")
    said["before"] = s.execute("SHOW DATABASES").message
    s.script("USE lab\nDATASET t COLUMNS (a: Int)\nINSERT INTO t VALUES (1)")
    said["inside"], said["own"] = s.execute("SHOW DATABASES").message, s.execute("SHOW ALL DATASETS").message
    s.script("RESET SESSION")
    said["reset"] = s.execute("SHOW ALL DATASETS").message or "no datasets"
    s.script("USE default\nDROP DATABASE lab\nDROP DATABASE IF EXISTS lab")
    said["after"] = s.execute("SHOW DATABASES").message
    return lines(spark, said)


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def stored_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAVE, DROP, LOAD and APPLY PIPELINE; the steps told are those defined."""
    s = session(spark, sf_dir)
    s.script('DEFINE PIPELINE p AS WHERE o_orderstatus = "F" THEN ORDER BY o_totalprice DESC, o_orderkey THEN LIMIT 15 THEN SELECT o_orderkey, o_totalprice * 2 AS twice\nSAVE PIPELINE p\nDROP PIPELINE p\nLOAD PIPELINE p')
    if s.execute("SHOW PIPELINES").message != "p: 4 steps" or len(s.execute("DESCRIBE PIPELINE p").message.splitlines()) != 5 or s.execute("LIST PIPELINES").message != "p":
        raise ValueError("the pipeline came back changed")
    out = s.execute("APPLY PIPELINE p ON orders INTO top").frame
    return out.withColumn("twice", F.round("twice", 2))


@query("SELECT n_regionkey, count(*) AS n, 'SUM(n_nationkey)' AS name, sum(n_nationkey)::BIGINT AS total, 1 + 2 * 3 - 4 / 2 AS value FROM nation GROUP BY n_regionkey")
def names_and_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that unnamed results get, and what binds first."""
    s = session(spark, sf_dir)
    out = s.sql("SELECT n_regionkey, COUNT(*) AS n, SUM(n_nationkey) FROM nation GROUP BY n_regionkey")
    name = next(c for c in out.columns if c.startswith("SUM"))
    value = s.sql("SELECT 1 + 2 * 3 - 4 / 2 AS value FROM region").first()[0]
    return out.select("n_regionkey", "n", F.lit(name).alias("name"), F.col(f"`{name}`").alias("total"), F.lit(float(value)).alias("value"))


@query(_expected(("error", 0, "cannot ORDER BY embedding: vectors and matrices have no order"), ("names", 0, "row_number"), ("names", 1, "lag"), ("explain", 0, "TakeOrderedAndProject")))
def window_names_and_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    said = {}
    try:
        s.sql("SELECT vec_id, ROW_NUMBER() OVER (ORDER BY embedding) AS n FROM embeddings")
    except ValueError as e:
        said["error"] = str(e)
    out = s.sql("SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY n_nationkey), LAG(n_name) OVER (ORDER BY n_nationkey) FROM nation")
    said["names"] = "\n".join(out.columns[1:])
    said["explain"] = "TakeOrderedAndProject" if "TakeOrderedAndProject" in s.execute("EXPLAIN SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3").message else ""
    return lines(spark, said)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on an indexed column: the filter reaches the Parquet scan, whose statistics prune."""
    s = session(spark, sf_dir)
    return s.script("CREATE INDEX ON customer(c_custkey)\nSELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")[-1].frame


@query("SELECT count(*) AS rows, 'Completed' AS status FROM nation")
def service_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over HTTP, and the same as a job."""
    import threading
    import time
    import urllib.request

    from ..service import serve

    s = session(spark, sf_dir)
    server = serve(s, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method: str, path: str, body: str = "") -> dict:
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", data=body.encode() or None, method=method)
        with urllib.request.urlopen(r, timeout=60) as f:
            return json.loads(f.read())

    try:
        text = "SELECT COUNT(*) AS n FROM nation"
        direct = call("POST", "/execute?format=json", text)["rows"][0][0]
        job = call("POST", "/jobs", text)["job_id"]
        until = time.monotonic() + 60
        while (status := call("GET", f"/jobs/{job}")["status"]) not in ("Completed", "Failed") and time.monotonic() < until:
            time.sleep(0.05)
        if call("GET", "/health") != {"status": "ok"} or call("GET", "/databases") != ["default"] or call("GET", f"/jobs/{job}/result")["rows"] != [[direct]]:
            raise ValueError("the service's answers differ")
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame([(direct, status)], "rows long, status string")
