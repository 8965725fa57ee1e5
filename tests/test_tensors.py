"""Tensor statements and the frequency domain against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar import signal
from veldspar.session import Session
from veldspar.tensors import TensorError


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path))


def value(s, name):
    return s.db.tensors[name].value()


def test_algebra(s):
    s.script("VECTOR a = [1, 2, 3]\nVECTOR b = [4, 5, 6]\nMATRIX m = [[1, 2], [3, 4]]\nDEFINE t AS TENSOR [2, 2, 2] VALUES [1, 2, 3, 4, 5, 6, 7, 8]")
    s.script("LET c = ADD a b\nLET d = (a + b) / 2.0\nLET e = MATMUL m m\nLET f = TRANSPOSE m\nLET g = RESHAPE t TO [4, 2]\nLET h = STACK a b\nLET i = SCALE a BY 3\nLET j = FLATTEN t\nLET k = STDEV a\nLET l = SUM t\nLET n = MEAN m\nLET o = NORMALIZE a\nLET p = a * 2 - b")
    np.testing.assert_allclose(value(s, "c"), [5, 7, 9])
    np.testing.assert_allclose(value(s, "d"), [2.5, 3.5, 4.5])
    np.testing.assert_allclose(value(s, "e"), [[7, 10], [15, 22]])
    np.testing.assert_allclose(value(s, "f"), [[1, 3], [2, 4]])
    assert value(s, "g").shape == (4, 2) and value(s, "h").shape == (2, 3) and value(s, "j").shape == (8,)
    np.testing.assert_allclose(value(s, "i"), [3, 6, 9])
    np.testing.assert_allclose(value(s, "k"), [np.std([1, 2, 3])], rtol=1e-6)
    assert value(s, "l")[0] == 36 and value(s, "n")[0] == 2.5
    np.testing.assert_allclose(np.linalg.norm(value(s, "o")), 1, rtol=1e-6)
    np.testing.assert_allclose(value(s, "p"), [-2, -1, 0])


def test_pairs_padding_and_errors(s):
    s.script("VECTOR a = [1, 2, 3]\nVECTOR b = [1, 1]\nVECTOR z = [0, 0, 0]\nMATRIX m = [[1, 2], [3, 4]]\nDEFINE w AS STRICT TENSOR [3] VALUES [1, 0, 0]")
    s.script("LET c = a + b\nLET p = MULTIPLY a b\nLET q = CORRELATE a WITH a\nLET r = SIMILARITY a WITH a\nLET d = DISTANCE a TO z")
    np.testing.assert_allclose(value(s, "c"), [2, 3, 3])
    np.testing.assert_allclose(value(s, "p"), [1, 2, 3])
    assert float(value(s, "q")) == 14 and abs(float(value(s, "r")) - 1) < 1e-6 and abs(float(value(s, "d")) - 14**0.5) < 1e-6
    for bad in ("LET x = a / z", "LET x = NORMALIZE z", "LET x = SIMILARITY a WITH z", "LET x = a + m", "LET x = w + b", "LET x = MATMUL m a", "LET x = RESHAPE m TO [3]", "LET x = STACK a b", "DEFINE q AS TENSOR [2] VALUES [1]"):
        with pytest.raises(TensorError):
            s.execute(bad)
    s.execute("LET y = w + a")
    assert s.db.tensors["y"].kind == "strict"


def test_slices(s):
    s.script("DEFINE m AS TENSOR [3, 4] VALUES [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]\nLET a = m[1, 2]\nLET b = m[0:2, *]\nLET c = m[:, 1]\nLET d = m[1:, 2:4]\nLET e = d")
    m = np.arange(12).reshape(3, 4)
    assert value(s, "a").shape == () and float(value(s, "a")) == 6
    np.testing.assert_allclose(value(s, "b"), m[0:2])
    np.testing.assert_allclose(value(s, "c"), m[:, 1])
    np.testing.assert_allclose(value(s, "e"), m[1:, 2:4])
    for bad in ("LET x = m[3, 0]", "LET x = m[0]", "LET x = m[0:9, 0]"):
        with pytest.raises(TensorError):
            s.execute(bad)


def test_lazy_and_lineage(s):
    s.script("VECTOR a = [3, 4]\nLAZY LET n = NORMALIZE (a + a)\nLET LAZY q = SUM a")
    assert s.db.tensors["n"].array is None and s.db.tensors["q"].kind == "lazy"
    np.testing.assert_allclose(s.execute("SHOW n").tensor, [0.6, 0.8], rtol=1e-6)
    lines = s.execute("SHOW LINEAGE n").message.splitlines()
    assert lines[0] == "n <- NORMALIZE" and "ROOT" in lines[-1]
    s.script("SAVE TENSOR n\nRESET\nLOAD TENSOR n")
    assert s.execute("SHOW LINEAGE n").message.splitlines() == lines
    assert s.execute("LIST TENSORS").message == "n" and s.execute("SHOW SHAPE n").message == "[2]"


def test_tensor_first_datasets(s):
    s.script('VECTOR t = [36.5, 37]\nMATRIX e = [[1, 2], [3, 4]]\nLET raw = dataset("raw")\nraw.add_column(temp, t)\nATTACH e TO raw.emb\nBIND copy TO raw')
    assert [tuple(r) for r in s.sql("SELECT temp, emb FROM raw ORDER BY temp").collect()] == [(36.5, [1, 2]), (37.0, [3, 4])]
    s.execute("LET back = raw.temp * 2")
    np.testing.assert_allclose(value(s, "back"), [73, 74])
    assert s.execute("AUDIT DATASET raw").message == "raw is sound"
    del s.db.tensors["e"]
    assert "no tensor e" in s.execute("AUDIT raw").message
    assert "broken" in s.execute("SHOW copy").message


def test_signal_round_trips():
    t = np.arange(64)
    x = np.sin(2 * np.pi * 5 * t / 64).astype(np.float32)
    z = signal.fft(x)
    assert z.shape == (2, 33) and signal.magnitude(z).argmax() == 5
    np.testing.assert_allclose(signal.ifft(z), x, atol=1e-5)
    both = x + np.sin(2 * np.pi * 20 * t / 64).astype(np.float32)
    np.testing.assert_allclose(signal.bandpass(both, 4, 6, 64), x, atol=1e-5)
    assert signal.psd(np.tile(x, 3), 64).argmax() == 5
    flat = signal.magnitude(signal.fft(signal.whiten(both + 0.01 * np.random.default_rng(1).standard_normal(64).astype(np.float32), signal.psd(both, 64))))
    assert flat.shape == (33,)
    burst = np.zeros(64, dtype=np.float32)
    burst[:8] = np.hanning(8)
    assert signal.matched_filter(np.roll(burst, 17), burst).argmax() == 17
    for bad in (lambda: signal.fft(z), lambda: signal.ifft(x), lambda: signal.psd(x, 0), lambda: signal.whiten(x, x), lambda: signal.bandpass(x, 5, 1, 64), lambda: signal.matched_filter(x, x[:3]), lambda: signal.fft(x[:0])):
        with pytest.raises(TensorError):
            bad()


def test_signal_columns_and_statements(spark, s):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.0, -1.0]), (2, None)], "id int, v array<float>")
    got = df.select("id", signal.column(signal.fft, matrix_out=True)(F.col("v")).alias("z"), signal.column(signal.psd, window=2)(F.col("v")).alias("p")).orderBy("id").collect()
    np.testing.assert_allclose(got[0]["z"], signal.fft(np.array([0, 1, 0, -1], dtype=np.float32)), atol=1e-6)
    assert got[1]["z"] is None and len(got[0]["p"]) == 2
    s.script("VECTOR g = [0, 1, 0, -1, 0, 1, 0, -1]\nLET z = FFT g\nLET r = IFFT z\nLET m = MAGNITUDE z\nLET n = PSD g WINDOW 8\nLET w = WHITEN g WITH n\nLET b = BANDPASS g FROM 1.0 TO 3.0 WITH RATE 8.0\nLET c = MATCHED_FILTER g WITH g")
    np.testing.assert_allclose(value(s, "r"), value(s, "g"), atol=1e-6)
    assert value(s, "c").argmax() in (0, 4) and value(s, "m").argmax() == 2


def test_relaxed_operations_pad():
    from veldspar import tensors

    a, b = np.array([4.0, 6.0, 8.0]), np.array([2.0])
    wide = np.array([2.0, 3.0])
    np.testing.assert_allclose(tensors.add_relaxed(a, wide), [6, 9, 8])
    np.testing.assert_allclose(tensors.subtract_relaxed(a, wide), [2, 3, 8])
    np.testing.assert_allclose(tensors.multiply_relaxed(a, wide), [8, 18, 8])
    np.testing.assert_allclose(tensors.divide_relaxed(a, wide), [2, 2, 8])
    np.testing.assert_allclose(tensors.add_relaxed(a, b), [6, 8, 10])


def test_column_aggregates_stay_distributed(spark, s):
    s.register("d", spark.range(1000).selectExpr("id AS n", "array(cast(id AS float), 1.0f) AS v"))
    s.script("LET a = SUM d.n\nLET b = MEAN d.v\nLET c = STDEV d.n")
    assert float(value(s, "a")[0]) == 499500 and float(value(s, "b")[0]) == 250.25
    np.testing.assert_allclose(value(s, "c"), [np.arange(1000).std()], rtol=1e-6)


def test_signal_columns_of_mixed_lengths(spark):
    df = spark.createDataFrame([(k, [float((k * i) % 5) for i in range(4 + 2 * (k % 3))]) for k in range(20)], "id int, v array<float>")
    for r in df.select("v", signal.column(signal.matched_filter)(F.col("v"), F.reverse("v")).alias("c"), signal.column(signal.bandpass, low=1.0, high=2.0, rate=8.0)("v").alias("b")).collect():
        x = np.array(r["v"], dtype=np.float32)
        np.testing.assert_allclose(r["c"], signal.matched_filter(x, x[::-1]), rtol=1e-5, atol=1e-5)
        np.testing.assert_allclose(r["b"], signal.bandpass(x, 1.0, 2.0, 8.0), rtol=1e-5, atol=1e-5)
