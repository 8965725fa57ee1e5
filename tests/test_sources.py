"""Readers, packages, streaming and the service."""

import json
import time
import urllib.error
import urllib.request

import numpy as np
import pytest

from veldspar.service import Jobs, Scheduler, serve
from veldspar.session import Session
from veldspar.sources import SourceError, find_connector, inspect, package_stats, read_dataset


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path / "root"))


def test_csv(s, spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,name,value,active\n1,x,1.5,true\n2,y,,false\n")
    s.execute(f'USE DATASET FROM "{p}" AS d')
    assert [tuple(r) for r in s.sql("SELECT * FROM d ORDER BY id").collect()] == [(1, "x", 1.5, True), (2, "y", None, False)]
    assert s.execute("SHOW SCHEMA d").message == "id: Int?\nname: String?\nvalue: Float?\nactive: Bool?"
    s.execute(f'USE DATASET FROM "{p}" AS e FIELDS (value, id)')
    assert s.sql("SELECT * FROM e").columns == ["value", "id"]
    s.script(f'IMPORT CSV FROM "{p}" AS f\nIMPORT DATASET FROM "{p}" AS g\nLOAD DATASET g')
    assert s.sql("SELECT * FROM f").count() == s.sql("SELECT * FROM g").count() == 2
    assert [f.name for f in inspect(spark, str(p))] == ["id", "name", "value", "active"]
    with pytest.raises(SourceError, match="nope"):
        s.execute(f'USE DATASET FROM "{p}" FIELDS (nope)')


def test_numpy(s, spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    np.savez(tmp_path / "z.npz", a=np.arange(3), b=np.ones((3, 4), dtype=np.float32), c=np.ones(7), d=np.arange(24).reshape(3, 2, 4))
    s.script(f'USE DATASET FROM "{tmp_path}/m.npy" AS m\nUSE DATASET FROM "{tmp_path}/z.npz" AS z FIELDS (a, b)')
    assert [r[0] for r in s.sql("SELECT array FROM m").collect()] == [[0, 1], [2, 3], [4, 5]]
    assert s.db.tensors["z_b"].value().shape == (3, 4) and s.sql("SELECT SUM(a) AS t FROM z").first()[0] == 3
    got = read_dataset(spark, f"{tmp_path}/z.npz")
    assert len(got.warnings) == 1 and "c" in got.warnings[0] and got.frame.columns == ["a", "b", "d"]
    assert got.frame.schema["d"].metadata["shape"] == [3, 2, 4]
    with pytest.raises(SourceError):
        read_dataset(spark, f"{tmp_path}/z.npz", ["a", "c"])


def test_zarr(spark, tmp_path):
    root = tmp_path / "t.zarr"
    for name, a, chunk in (("data", np.array([1, 2, 3, 4, 5], dtype="<f4"), (2,)), ("grp/m", np.arange(20, dtype="<f8").reshape(5, 4), (3, 3))):
        d = root / name
        d.mkdir(parents=True)
        meta = {"zarr_format": 3, "node_type": "array", "shape": list(a.shape), "data_type": str(a.dtype), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}]}
        (d / "zarr.json").write_text(json.dumps(meta))
        for at in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunk, strict=True)]):
            block = np.zeros(chunk, dtype=a.dtype)
            part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk, strict=True))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            f = d / "c" / "/".join(map(str, at))
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(block.tobytes())
    (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group"}))
    got = read_dataset(spark, str(root))
    assert got.frame.columns == ["data", "grp/m"]
    assert [r[0] for r in got.frame.select("data").collect()] == [1, 2, 3, 4, 5]
    np.testing.assert_allclose(got.arrays["grp/m"], np.arange(20).reshape(5, 4))


def test_dispatch():
    assert [find_connector(p) for p in ("a.csv", "b.npy", "c.npz", "d.h5", "e.nc", "f.zarr", "g.parquet")] == ["csv", "npy", "npz", "hdf5", "hdf5", "zarr", "parquet"]
    with pytest.raises(SourceError):
        find_connector("x.unknown")


def test_hdf5_says_what_it_needs(spark, tmp_path):
    pytest.importorskip("numpy")
    try:
        import h5py  # noqa: F401

        pytest.skip("h5py is here")
    except ImportError:
        pass
    (tmp_path / "a.h5").write_bytes(b"x")
    with pytest.raises(SourceError, match="h5py"):
        read_dataset(spark, str(tmp_path / "a.h5"))


def test_stats(spark):
    df = spark.createDataFrame([(1, 2.0, "a", [1.0, 2.0]), (3, None, None, [3.0, 4.0])], "i long, f float, s string, v array<float>")
    got = package_stats(df)
    assert got["i"] == {"null_count": 0, "sparsity": 0.0, "min": 1.0, "max": 3.0, "mean": 2.0}
    assert got["f"]["null_count"] == 1 and got["s"]["sparsity"] == 0.5 and got["v"]["tensor_shape"] == [2]


def test_many_inserts_keep_the_plan_short(s):
    s.execute("DATASET t COLUMNS (a: Int)")
    for k in range(40):
        s.execute(f"INSERT INTO t VALUES ({k})")
        if k % 2:
            s.frame("t")
    assert s.sql("SELECT COUNT(*) AS n FROM t").first()[0] == 40
    assert len(s.execute("EXPLAIN t").message) < 20_000


def call(port, method, path, body=None, headers=None):
    r = urllib.request.Request(f"http://127.0.0.1:{port}{path}", data=body.encode() if body else None, method=method, headers=headers or {})
    try:
        with urllib.request.urlopen(r, timeout=60) as f:
            raw, code = f.read(), f.status
    except urllib.error.HTTPError as e:
        raw, code = e.read(), e.code
    try:
        return code, json.loads(raw)
    except ValueError:
        return code, raw


def test_service(s):
    import threading

    server = serve(s, 0)
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert call(port, "GET", "/health") == (200, {"status": "ok"})
        assert call(port, "POST", "/execute", "DATASET t COLUMNS (a: Int, b: String)\nINSERT INTO t VALUES (1, 'x')")[0] == 200
        code, got = call(port, "POST", "/execute?format=json", "SELECT * FROM t")
        assert (code, got["rows"]) == (200, [[1, "x"]])
        assert call(port, "POST", "/execute", json.dumps({"command": "SELECT a FROM t"}), {"Content-Type": "application/json"})[1] == b"rows[1]{a}:\n  1"
        assert call(port, "POST", "/execute", "SELECT nope FROM t")[0] == 400
        assert call(port, "POST", "/execute", "x" * 20_000)[0] == 413
        assert call(port, "POST", "/databases/lab")[0] == 201 and "lab" in call(port, "GET", "/databases")[1]
        assert call(port, "POST", "/execute", "SELECT * FROM t", {"X-Database": "lab"})[0] == 400
        assert call(port, "DELETE", "/databases/lab")[0] == 200
        job = call(port, "POST", "/jobs", "SELECT COUNT(*) AS n FROM t")[1]["job_id"]
        for _ in range(100):
            if call(port, "GET", f"/jobs/{job}")[1]["status"] == "Completed":
                break
            time.sleep(0.2)
        assert call(port, "GET", f"/jobs/{job}/result")[1]["rows"] == [[1]]
        assert call(port, "DELETE", f"/jobs/{job}")[0] == 409
        task = call(port, "POST", "/schedule", json.dumps({"name": "tick", "command": "INSERT INTO t VALUES (2, 'y')", "interval_secs": 60}))[1]
        time.sleep(2.5)
        assert call(port, "GET", "/schedule")[1][0]["runs"] == 1
        assert call(port, "DELETE", f"/schedule/{task['id']}")[0] == 200
        call(port, "POST", "/execute", "SAVE DATASET t")
        assert call(port, "GET", "/delivery/datasets/t/manifest.json")[1]["name"] == "t"
        assert call(port, "GET", "/delivery/datasets/t/secret")[0] == 404
    finally:
        server.shutdown()


def test_a_pending_job_can_be_cancelled():
    import threading

    gate = threading.Event()
    jobs = Jobs(lambda c, d: {"ran": gate.wait(5)}, workers=1)
    first, second = jobs.submit("a"), jobs.submit("b")
    assert jobs.cancel(second.id)
    gate.set()
    jobs.pool.shutdown()
    assert (first.status, second.status) == ("Completed", "Cancelled") and not jobs.cancel(first.id)


def test_a_failing_task_goes_on():
    runs = []

    def run(c, d):
        runs.append(c)
        raise ValueError("no")

    sched = Scheduler(run, tick=0.01)
    t = sched.add("t", "x", 0.03)
    time.sleep(0.3)
    sched.ended.set()
    assert len(runs) >= 2 and t.last_error == "no"


def test_streaming(spark, sf_dir, tmp_path):
    from veldspar.streaming import read_events, to_table, windowed_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = tmp_path / "in"
    events.repartition(3).write.parquet(str(source))
    counted = windowed_counts(read_events(spark, str(source), events.schema), "ts", "1 day", "3650 days", ["event_type"], "value")
    q = to_table(counted, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    memory = counted.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    memory.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == events.count()


def test_client_command_line_and_time_limit(s, monkeypatch, capsys):
    import threading

    from veldspar.__main__ import main
    from veldspar.service import server as module
    from veldspar.service.client import Client, ServiceError

    server = serve(s, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        c = Client(url)
        c.execute("DATASET t COLUMNS (a: Int)")
        c.execute("INSERT INTO t VALUES (4)")
        assert c.execute("SELECT a FROM t")["rows"] == [[4]] and c.databases() == ["default"]
        assert main(["jobs", "submit", "SELECT a FROM t", "--url", url]) == 0
        job = json.loads(capsys.readouterr().out)
        for _ in range(100):
            if c.job(job)["status"] == "Completed":
                break
            time.sleep(0.1)
        assert main(["jobs", "result", job, "--url", url]) == 0 and json.loads(capsys.readouterr().out)["rows"] == [[4]]
        assert main(["schedule", "add", "tick", "SELECT a FROM t", "60", "--url", url]) == 0
        task = json.loads(capsys.readouterr().out)["id"]
        assert main(["schedule", "remove", task, "--url", url]) == 0 and c.schedules() == []
        assert main(["jobs", "status", "00", "--url", url]) == 1
        monkeypatch.setattr(module, "TIME_LIMIT", 0.2)
        monkeypatch.setattr(server.service, "execute", lambda *a: time.sleep(2))
        with pytest.raises(ServiceError) as e:
            c.execute("SELECT a FROM t")
        assert e.value.code == 408
    finally:
        server.shutdown()


def test_inspect_reads_headers_only(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(3), y=np.zeros((3, 2, 2)), z=np.ones(9))
    with open(tmp_path / "b.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (10**9, 4)})  # no data behind it
    assert [(f.name, f.metadata["shape"]) for f in inspect(spark, str(tmp_path / "a.npz"))] == [("x", [3]), ("y", [3, 2, 2])]
    assert inspect(spark, str(tmp_path / "b.npy"))[0].metadata["shape"] == [10**9, 4]


def test_first_value_and_statistics(s):
    s.script("DATASET t COLUMNS (a: Int, b: Float?)\nINSERT INTO t VALUES (4, 1.5)\nINSERT INTO t (a = 6)")
    assert s.first_value("t", "a") in (4, 6) and s.statistics("t")["b"] == {"null_count": 1, "sparsity": 0.5, "min": 1.5, "max": 1.5, "mean": 1.5}
