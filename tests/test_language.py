"""Statements of the query language against hand-computed results."""

import pytest

from veldspar.dsl import ParseError, parse, split_statements
from veldspar.session import QueryError, Session, SessionError


@pytest.fixture
def s(spark, tmp_path):
    out = Session(spark, str(tmp_path / "root"))
    out.script(
        """
        DATASET items COLUMNS (id: Int, price: Float, category: String?)
        INSERT INTO items VALUES (1, 10, "x")
        INSERT INTO items VALUES (2, 20, "x")
        INSERT INTO items VALUES (3, 5, "y")
        INSERT INTO items VALUES (4, 20, "x")
        DATASET docs COLUMNS (id: Int, category: String, embedding: Vector(3))
        INSERT INTO docs VALUES (1, "a", [1, 0, 0])
        INSERT INTO docs VALUES (2, "a", [0, 1, 0])
        INSERT INTO docs (id = 3, category = "b", embedding = [0, 0, 2])
        DATASET users COLUMNS (uid: Int, name: String)
        INSERT INTO users VALUES (1, "ann")
        INSERT INTO users VALUES (9, "bob")
        DATASET orders COLUMNS (id: Int, user_id: Int)
        INSERT INTO orders VALUES (1, 1)
        INSERT INTO orders VALUES (2, 2)
        """
    )
    return out


def rows(s, q):
    return [tuple(r) for r in s.sql(q).collect()]


def test_select_filter_order(s):
    assert rows(s, "SELECT id FROM items WHERE price * 2 > 15 AND NOT category = 'y' ORDER BY price DESC, id LIMIT 2 OFFSET 1") == [(4,), (1,)]
    assert rows(s, "SELECT id FROM items WHERE id IN (1, 3) OR price BETWEEN 20 AND 30 ORDER BY id") == [(1,), (2,), (3,), (4,)]
    assert rows(s, "SELECT DISTINCT category FROM items ORDER BY category") == [("x",), ("y",)]
    assert rows(s, "SELECT id / 2 AS half, 0 - id AS neg, -id AS neg2, id / 0 AS none FROM items WHERE id = 3") == [(1, -3, -3, None)]
    assert rows(s, "SELECT id FROM items OFFSET 3") == [(4,)]
    assert s.sql("SELECT items.id, price * 2 FROM items").columns == ["__cmp_0", "__cmp_1"]


def test_aggregates(s):
    assert rows(s, "SELECT category, SUM(price * id) AS t, COUNT(*) AS n FROM items GROUP BY category HAVING AVG(price) > 5 ORDER BY n") == [("x", 130.0, 3)]
    assert s.sql("SELECT category, SUM(price) FROM items GROUP BY category").columns == ["category", "SUM(price)"]
    assert rows(s, "SELECT COUNT(*) AS n FROM items WHERE id > 100") == []
    assert rows(s, "SELECT MAX(price) - MIN(price) AS spread, SUM(CASE WHEN price > 9 THEN 1 ELSE 0 END) AS big FROM items") == [(15.0, 3)]
    s.execute("INSERT INTO items (id = 5, price = 1)")
    assert rows(s, "SELECT category, COUNT(category) AS n FROM items GROUP BY category ORDER BY category") == [(None, 0), ("x", 3), ("y", 1)]
    with pytest.raises(QueryError):
        s.sql("SELECT id, COUNT(*) AS n FROM items GROUP BY category")


def test_vectors(s):
    assert rows(s, "SELECT id, COSINE_SIM(embedding, [0, 0, 5]) AS c, L2_NORM(embedding) AS n FROM docs WHERE COSINE_SIM(embedding, [0, 0, 1]) > 0.5") == [(3, 1.0, 2.0)]
    assert rows(s, "SELECT category, AVG_VEC(embedding) AS m FROM docs GROUP BY category ORDER BY category") == [("a", [0.5, 0.5, 0.0]), ("b", [0.0, 0.0, 2.0])]
    assert rows(s, "SELECT VEC_ADD(embedding, [1, 1]) AS v, VEC_SCALE(embedding, 3) AS w, NORMALIZE(embedding) AS u FROM docs WHERE id = 3") == [([1.0, 1.0], [0.0, 0.0, 6.0], [0.0, 0.0, 1.0])]
    assert rows(s, "SELECT DISTANCE(embedding, [0, 0, 0]) AS d, DOT(embedding, embedding) AS q FROM docs WHERE id = 3") == [(2.0, 4.0)]
    assert rows(s, "SELECT COSINE_SIM([0, 0], [1, 0]) AS z FROM docs LIMIT 1") == [(0.0,)]
    assert rows(s, "SELECT SUM(embedding) OVER (ORDER BY id) AS v FROM docs ORDER BY id")[-1] == ([1.0, 1.0, 2.0],)
    with pytest.raises(ValueError):
        s.sql("SELECT id FROM docs ORDER BY embedding")


def test_ragged_vectors_fail(s):
    s.script('DATASET m COLUMNS (cat: String, v: Vector(0))\nINSERT INTO m VALUES ("a", [1, 2])\nINSERT INTO m VALUES ("a", [1, 2, 3])')
    with pytest.raises(Exception, match="widths"):
        s.sql("SELECT cat, SUM_VEC(v) AS t FROM m GROUP BY cat").collect()


def test_matrices(s):
    s.script("DATASET g COLUMNS (id: Int, m: Matrix(2, 3))\nINSERT INTO g VALUES (1, [[1, 2, 3], [4, 5, 6]])")
    assert rows(s, "SELECT MAT_SHAPE(m) AS a, TRANSPOSE(m) AS t, FLATTEN(m) AS f FROM g") == [("2x3", [[1, 4], [2, 5], [3, 6]], [1, 2, 3, 4, 5, 6])]
    assert rows(s, "SELECT MATMUL(m, TRANSPOSE(m)) AS p, MATMUL(m, [1, 0, 1]) AS v, MATMUL(m, m) AS bad FROM g") == [([[14, 32], [32, 77]], [4, 10], None)]
    assert rows(s, "SELECT CAST(m AS VECTOR(6)) AS v, CAST(m AS VECTOR(5)) AS no, CAST(CAST(m AS VECTOR(6)) AS MATRIX(3, 2)) AS r FROM g") == [([1, 2, 3, 4, 5, 6], None, [[1, 2], [3, 4], [5, 6]])]
    assert rows(s, "SELECT m + m AS a, m / 2 AS h, SUM(m) OVER (ORDER BY id) AS r FROM g") == [([[2, 4, 6], [8, 10, 12]], [[0.5, 1, 1.5], [2, 2.5, 3]], [[1, 2, 3], [4, 5, 6]])]
    assert rows(s, "SELECT SUM(m) AS t FROM g") == [([[1, 2, 3], [4, 5, 6]],)]


def test_joins(s):
    assert rows(s, "SELECT o.id AS id, u.name AS name FROM orders o JOIN users u ON o.user_id = u.uid") == [(1, "ann")]
    assert sorted(rows(s, "SELECT id, name FROM orders LEFT JOIN users ON uid = user_id"), key=str) == [(1, "ann"), (2, None)]
    assert sorted(rows(s, "SELECT id, name FROM orders FULL OUTER JOIN users ON user_id = uid"), key=str) == [(1, "ann"), (2, None), (None, "bob")]
    assert s.sql("SELECT * FROM items JOIN items ON id = id").columns == ["id", "price", "category", "r_id", "r_price", "r_category"]
    assert rows(s, "SELECT a.id AS x, b.id AS y FROM docs a JOIN docs b ON COSINE_SIM(a.embedding, b.embedding) > 0.9 ORDER BY x") == [(1, 1), (2, 2), (3, 3)]


def test_similarity_join_pads(s):
    s.script("DATASET c COLUMNS (cid: Int, w: Vector(3))\nINSERT INTO c VALUES (1, [1, 0, 0])\nINSERT INTO c VALUES (2, [-1, 0, 0])")
    for kind, want in (("LEFT", [(1, 1), (2, None)]), ("RIGHT", [(1, 1), (None, 2), (None, 3)]), ("FULL", [(1, 1), (2, None), (None, 2), (None, 3)])):
        assert sorted(rows(s, f"SELECT cid, id FROM c {kind} JOIN docs ON COSINE_SIM(w, embedding) > 0.8"), key=str) == sorted(want, key=str)


def test_windows(s):
    got = rows(s, "SELECT id, RANK() OVER (PARTITION BY category ORDER BY price DESC) AS rk, DENSE_RANK() OVER (PARTITION BY category ORDER BY price DESC) AS d, LAG(price) OVER (ORDER BY id) AS p, LEAD(price, 2) OVER (ORDER BY id) AS n FROM items ORDER BY id")
    assert got == [(1, 3, 2, None, 5.0), (2, 1, 1, 10.0, 20.0), (3, 1, 1, 20.0, None), (4, 1, 1, 5.0, None)]
    assert rows(s, "SELECT SUM(price) OVER (PARTITION BY category ORDER BY price) AS r FROM items WHERE category = 'x' ORDER BY r") == [(10.0,), (30.0,), (50.0,)]
    assert s.sql("SELECT id, ROW_NUMBER() OVER (ORDER BY id), COUNT(*) OVER (ORDER BY id) FROM items").columns == ["id", "row_number", "count(*)_over"]
    assert rows(s, "SELECT id, price - LAG(price) OVER (ORDER BY id) AS step FROM items ORDER BY id LIMIT 2") == [(1, None), (2, 10.0)]


def test_nesting(s):
    assert rows(s, "WITH a AS (SELECT id, price FROM items WHERE price > 5), b AS (SELECT id FROM a WHERE price < 20) SELECT * FROM b") == [(1,)]
    assert rows(s, "SELECT x.id AS id FROM (SELECT id, price FROM items WHERE price < 10) AS x") == [(3,)]
    assert sorted(rows(s, "SELECT category FROM items UNION SELECT category FROM docs")) == [("a",), ("b",), ("x",), ("y",)]
    assert len(rows(s, "SELECT category FROM items UNION ALL SELECT category FROM docs")) == 7
    assert rows(s, "SELECT x.id AS id FROM (SELECT id, price FROM items WHERE price < 10) AS x") == [(3,)]  # the alias is free again


def test_scalars(s):
    q = 'SELECT CASE category WHEN "x" THEN 1 ELSE 2 END AS c, COALESCE(NULLIF(category, "y"), "none") AS n, CAST("12" AS INT) AS i, CAST("q" AS INT) AS bad, CAST(price AS INT) AS w, CAST(id AS BOOL) AS b FROM items WHERE id = 3'
    assert rows(s, q) == [(2, "none", 12, None, 5, True)]
    q = 'SELECT UPPER(name) AS u, LENGTH("é") AS l, TRIM("  a b ") AS t, CONCAT(name, "-", name) AS c, SUBSTR(name, 2) AS r, SUBSTR(name, 0, 2) AS z, SUBSTR(name, -1) AS e FROM users WHERE uid = 1'
    assert rows(s, q) == [("ANN", 1, "a b", "ann-ann", "nn", "an", "")]


def test_changes(s):
    s.execute('UPDATE items SET price = price + 1, category = CASE WHEN price > 20 THEN "z" ELSE category END WHERE id > 1')
    assert rows(s, "SELECT id, price, category FROM items ORDER BY id") == [(1, 10.0, "x"), (2, 21.0, "z"), (3, 6.0, "y"), (4, 21.0, "z")]
    s.execute("DELETE FROM items WHERE category = 'z'")
    assert rows(s, "SELECT id FROM items ORDER BY id") == [(1,), (3,)]
    s.script("ALTER DATASET items ADD COLUMN n: Int DEFAULT 7\nALTER DATASET items ADD COLUMN v: Vector(2)\nALTER DATASET items ADD COLUMN twice = price * 2 LAZY")
    s.execute("UPDATE items SET price = 1, v = [3, 4] WHERE id = 1")
    assert rows(s, "SELECT id, n, v, twice FROM items ORDER BY id") == [(1, 7, [3, 4], 2.0), (3, 7, [0, 0], 12.0)]
    s.execute("MATERIALIZE items")
    assert "twice" in s.db.datasets["items"].frame.columns
    for bad in ('INSERT INTO items VALUES (1, "a", "b", 1, [1, 2], 2)', "INSERT INTO docs VALUES (1, 'a', [1, 2])", "INSERT INTO docs VALUES (1)", "ALTER DATASET items ADD COLUMN n = 1", "DATASET items COLUMNS (a: Int)"):
        with pytest.raises(SessionError):
            s.execute(bad)


def test_insert_takes_tensors(s):
    s.script("VECTOR q = [7, 8, 9]\nINSERT INTO docs VALUES (4, \"c\", q)")
    assert rows(s, "SELECT embedding FROM docs WHERE id = 4") == [([7, 8, 9],)]


def test_search_and_indexes(s):
    with pytest.raises(SessionError, match="vector index"):
        s.execute("SEARCH docs ON embedding QUERY [1, 0, 0] LIMIT 1")
    s.script("CREATE VECTOR INDEX i ON docs(embedding)\nCREATE INDEX ON docs(category)\nVECTOR q = [0, 1, 0.1]")
    assert rows(s, "SEARCH docs ON embedding QUERY q LIMIT 1 INTO best") == [(2, "a", [0, 1, 0])]
    assert rows(s, "SELECT id FROM best") == [(2,)]
    assert [r[0] for r in rows(s, "SEARCH docs WHERE embedding ~= [0, 0.5, 1] LIMIT 2")] == [3, 2]
    assert rows(s, "SELECT COUNT(*) AS n FROM search_results") == [(2,)]
    assert [r[0] for r in rows(s, "SEARCH found FROM docs QUERY [1, 0, 0] ON embedding K=1")] == [1]
    assert s.execute("SHOW INDEXES docs").message == "docs(category): HASH\ndocs(embedding): VECTOR"
    # With and without an index, a threshold gives the same rows.
    assert rows(s, "SELECT id FROM docs WHERE COSINE_SIM(embedding, [1, 0, 0]) > 0.9") == [(1,)]


def test_pipelines(s):
    s.script("DEFINE PIPELINE clean AS WHERE price > 5 THEN SELECT id, price AS p THEN ORDER BY p DESC, id THEN LIMIT 2\nAPPLY PIPELINE clean ON items INTO top")
    assert rows(s, "SELECT * FROM top") == [(2, 20.0), (4, 20.0)]
    s.script("SAVE PIPELINE clean\nDROP PIPELINE clean\nLOAD PIPELINE clean\nDEFINE PIPELINE unit AS NORMALIZE embedding\nAPPLY PIPELINE unit ON docs")
    assert "WHERE price > 5" in s.execute("DESCRIBE PIPELINE clean").message
    assert rows(s, "SELECT embedding FROM docs WHERE id = 3") == [([0, 0, 1],)]
    assert s.execute("SHOW PIPELINES").message == "clean: 4 steps\nunit: 1 steps"
    s.execute("TRANSFORM docs SELECT id, UPPER(category) AS cat WHERE id < 3")
    assert rows(s, "SELECT * FROM docs ORDER BY id") == [(1, "A"), (2, "A")]
    s.script("DATASET cheap FROM items FILTER price < 15 SELECT category, COUNT(*) AS n GROUP BY category ORDER BY category")
    assert rows(s, "SELECT * FROM cheap") == [("x", 1), ("y", 1)]


def test_databases_and_introspection(s):
    s.script("CREATE DATABASE lab\nCREATE DATABASE IF NOT EXISTS lab\nUSE lab")
    with pytest.raises(SessionError):
        s.sql("SELECT * FROM items")
    s.script("USE default\nDROP DATABASE lab\nDROP DATABASE IF EXISTS lab")
    with pytest.raises(SessionError):
        s.execute("DROP DATABASE default")
    assert s.execute("SHOW SCHEMA docs").message == "id: Int\ncategory: String\nembedding: Vector(3)"
    assert s.execute("SHOW DATABASES").message == "default *"
    assert "docs: 3 rows, 3 columns" in s.execute("SHOW ALL DATASETS").message
    assert "Scan" in s.execute("EXPLAIN PLAN SELECT id FROM items WHERE id = 1").message or "Filter" in s.execute("EXPLAIN SELECT id FROM items WHERE id = 1").message
    assert s.execute('SHOW "hello"').message == "hello"
    s.script('SET DATASET docs METADATA author = "me"')
    assert '"author": "me"' in s.execute("SHOW DATASET METADATA docs").message
    s.execute("RESET SESSION")
    with pytest.raises(SessionError):
        s.execute("SHOW docs")


def test_persistence(s, tmp_path):
    s.script("SAVE DATASET docs\nINSERT INTO docs VALUES (4, \"z\", [1, 1, 1])\nSAVE DATASET docs\nSAVE DATASET docs TO \"%s/pkg\"" % tmp_path)
    assert s.execute("LIST DATASETS").message == "docs" == s.execute("LIST DATASET PACKAGES").message
    assert len(s.execute("SHOW DATASET VERSIONS docs").message.splitlines()) == 2
    assert "ready" in s.execute("DELIVER docs").message
    assert "no manifest" in s.execute("DELIVER users").message
    s.script("RESET\nLOAD DATASET docs")
    assert rows(s, "SELECT AVG_VEC(embedding) AS m FROM docs WHERE id < 3") == [([0.5, 0.5, 0.0],)]
    assert "embedding: Vector(3)" in s.execute("SHOW SCHEMA docs").message
    s.script('SAVE DATASET docs TO "%s/x.parquet"\nLOAD DATASET y FROM "%s/x.parquet"\nLOAD DATASET z FROM "%s/x.parquet/data.parquet"' % ((tmp_path,) * 3))
    assert s.sql("SELECT * FROM y").count() == s.sql("SELECT * FROM z").count() == 4
    s.script('LOAD DATASET again FROM "%s/pkg"\nEXPORT docs TO "%s/out"' % (tmp_path, tmp_path))
    assert s.spark.read.csv(f"{tmp_path}/out", header=True).count() == 4
    s.delete_dataset("docs")
    assert s.execute("LIST DATASETS").message == ""


def test_script_framing():
    got = split_statements("-- note\nSELECT a\nFROM t\n  WHERE b = 1\nDATASET x COLUMNS (\n  a: Int, -- one\n  b: Float\n)\nWITH q AS (\n SELECT a FROM t)\nSELECT a FROM q\nSHOW \"(\"")
    assert [g.split()[0] for g in got] == ["SELECT", "DATASET", "WITH", "SHOW"]


@pytest.mark.parametrize("bad", ["SELECT FROM t", "SELECT a FROM t WHERE", "LET x =", "SELECT a FROM t GROUP a", "DATASET x COLUMNS (a)", "FROBNICATE x", "SELECT a FROM t ?", "SELECT [[1],[1,2]] FROM t"])
def test_parse_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_unknown_names(s):
    for bad in ("SELECT nope FROM items", "SELECT id FROM nope", "SELECT FOO(id) FROM items"):
        with pytest.raises((QueryError, SessionError)):
            s.sql(bad)


def test_similarity_join_below_zero_and_odd_names(spark):
    from veldspar.operators import join

    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0])], "`a.b` int, v array<float>")
    b = spark.createDataFrame([(7, [-1.0, 0.1]), (8, [0.0, 1.0])], "id int, w array<float>")
    got = join.similarity_join(a, b, "v", "w", -0.5, "inner").collect()
    assert sorted((r["a.b"], r["id"]) for r in got) == [(1, 8), (2, 7), (2, 8)]


def _cosines(a, b):
    import numpy as np

    x, y = (np.array([v for _, v in side]) for side in (a, b))
    return (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T


@pytest.mark.parametrize("how", ["full", "left", "right", "inner"])
def test_similarity_join_of_many_blocks(spark, monkeypatch, how):
    """All pairs, each once; rows shuffled grow with the sides, not with their product."""
    import numpy as np

    from veldspar.operators import join

    monkeypatch.setattr(join, "BLOCK", 16)
    sc, shuffled = spark.sparkContext, []

    def records():
        sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    for n in (128, 512):
        v = np.random.default_rng(7).normal(size=(2 * n, 6))
        a, b = ([(k, v[2 * k + s].tolist()) for k in range(n)] for s in (0, 1))
        c, before = _cosines(a, b), records()
        t = float(np.sort(c.max(axis=1))[n // 4])  # a quarter of the left rows have no partner
        frames = (spark.createDataFrame(x, f"{k} int, {w} array<double>").repartition(3) for x, k, w in ((a, "x", "v"), (b, "`y.z`", "w")))
        got = [tuple(r) for r in join.similarity_join(*frames, "v", "w", t + 1e-9, how).select("x", "`y.z`").collect()]
        shuffled.append(sum(k for s, k in records().items() if s not in before))
        i, j = np.nonzero(c > t + 1e-9)
        want = list(zip(i.tolist(), j.tolist(), strict=True))
        want += [(k, None) for k in range(n) if how in ("left", "full") and k not in set(i.tolist())]
        want += [(None, k) for k in range(n) if how in ("right", "full") and k not in set(j.tolist())]
        assert sorted(got, key=str) == sorted(want, key=str) and len(want) > len(i) - (how == "inner")
    assert shuffled[1] < 6 * shuffled[0]


def test_similarity_join_at_the_threshold_and_odd_vectors(spark):
    from veldspar.operators import join

    # Single precision holds the first two for the same.
    near = [(k, [0.6 + d, (1 - (0.6 + d) ** 2) ** 0.5]) for k, d in enumerate((1e-10, -1e-10, 0.1, -0.1))]
    a = spark.createDataFrame([*near, (10, None), (11, []), (12, [0.0, 0.0]), (13, [1.0, 0.0, 0.0]), (14, [None, 1.0])], "x int, v array<double>")
    b = spark.createDataFrame([(1, [2.0, 0.0], "p"), (2, [0.0, 0.0], None), (3, None, "q")], "x int, w array<float>, s string")

    def got(t, how, strict=True):
        return sorted(((r["x"], r["r_x"], r["s"]) for r in join.similarity_join(a, b, "v", "w", t, how, strict).collect()), key=str)

    within = [(0, 1, "p"), (2, 1, "p")]
    assert got(0.6, "inner") == within
    lonely = [(k, None, None) for k in (1, 3, 10, 11, 12, 13, 14)]
    assert got(0.6, "left") == sorted(within + lonely, key=str)
    assert got(0.6, "full") == sorted(within + lonely + [(None, 2, None), (None, 3, "q")], key=str)
    zero = [(k, 2, None) for k in (0, 1, 2, 3, 12, 14)] + [(k, 1, "p") for k in (12, 14)]
    assert got(0.0, "right", strict=False) == sorted([(k, 1, "p") for k in range(4)] + zero + [(None, 3, "q")], key=str)
    assert got(0.0, "right") == sorted([(k, 1, "p") for k in range(4)] + [(None, 2, None), (None, 3, "q")], key=str)


def test_similarity_join_of_the_language_shuffles_no_pairs(s):
    plan = s.sql("SELECT cid, id FROM (SELECT id AS cid, embedding AS w FROM docs) AS c JOIN docs ON COSINE_SIM(w, embedding) > 0.8")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
