"""Registered queries of the frequency domain; a transform is a sum of cosines and sines, so SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import signal
from .registry import by_place, query, t

#: Samples and their transform: bins 0 to 32 of the 64 samples of each vector.
_SPECTRA = (
    "s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings),"
    " z AS (SELECT vec_id, f, sum(x * cos(2 * pi() * ((f * n) % 64) / 64)) AS re, -sum(x * sin(2 * pi() * ((f * n) % 64) / 64)) AS im FROM s, (SELECT unnest(range(33)) AS f) GROUP BY vec_id, f)"
)


def _back(weight: str, bins: str) -> str:
    """The samples of a weighted spectrum: the middle bins count twice."""
    return (
        f"SELECT vec_id, k, sum(CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END * ({weight}) * (re * cos(2 * pi() * ((f * k) % 64) / 64) - im * sin(2 * pi() * ((f * k) % 64) / 64))) / 64 AS v"
        f" FROM z, (SELECT unnest(range(64)) AS k) WHERE {bins} GROUP BY vec_id, k"
    )


def _told(part: str, source: str, digits: int = 4) -> str:
    return f"SELECT vec_id, '{part}' AS part, k::INT AS k, round(v::FLOAT::DOUBLE, {digits}) + 0.0 AS value FROM ({source})"


def _rounded(df: DataFrame, part: str, made: Column, digits: int = 4) -> DataFrame:
    return by_place(df.select("vec_id", made.alias(part)), "vec_id", part).withColumn("value", F.round("value", digits) + F.lit(0.0))


@query(f"WITH {_SPECTRA} " + _told("magnitude", "SELECT vec_id, f AS k, sqrt(re::FLOAT::DOUBLE * re::FLOAT::DOUBLE + im::FLOAT::DOUBLE * im::FLOAT::DOUBLE) AS v FROM z"))
def fft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectrum = signal.column(signal.fft, matrix_out=True)(F.col("embedding"))
    return _rounded(t(spark, sf_dir, "embeddings"), "magnitude", signal.column(signal.magnitude, matrix_in=True)(spectrum))


@query(f"WITH {_SPECTRA} " + _told("spectrum", "SELECT vec_id, f AS k, re AS v FROM z UNION ALL SELECT vec_id, 33 + f, im FROM z"))
def fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(t(spark, sf_dir, "embeddings"), "spectrum", F.flatten(signal.column(signal.fft, matrix_out=True)(F.col("embedding"))))


@query("SELECT vec_id, 'samples' AS part, unnest(range(64))::INT AS k, round(unnest(embedding)::DOUBLE, 4) + 0.0 AS value FROM embeddings")
def ifft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back."""
    spectrum = signal.column(signal.fft, matrix_out=True)(F.col("embedding"))
    return _rounded(t(spark, sf_dir, "embeddings"), "samples", signal.column(signal.ifft, matrix_in=True)(spectrum))


_CHUNKS = (
    "WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings),"
    " z AS (SELECT vec_id, n // 16 AS c, f, sum(x * cos(2 * pi() * ((f * n) % 16) / 16)) AS re, sum(x * sin(2 * pi() * ((f * n) % 16) / 16)) AS im FROM s, (SELECT unnest(range(9)) AS f) GROUP BY vec_id, c, f) "
)


@query(_CHUNKS + _told("psd", "SELECT vec_id, f AS k, avg(re * re + im * im) AS v FROM z GROUP BY vec_id, f"))
def psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(t(spark, sf_dir, "embeddings"), "psd", signal.column(signal.psd, window=16)(F.col("embedding")))


@query(f"WITH {_SPECTRA} " + _told("band", _back("1", "f BETWEEN 4 AND 16")))
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(t(spark, sf_dir, "embeddings"), "band", signal.column(signal.bandpass, low=4.0, high=16.0, rate=64.0)(F.col("embedding")))


@query(_told("correlation", "SELECT vec_id, k, list_sum([embedding[(k + i) % 64 + 1]::DOUBLE * embedding[64 - i] for i in range(64)]) AS v FROM embeddings, (SELECT unnest(range(64)) AS k)"))
def matched_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(t(spark, sf_dir, "embeddings"), "correlation", signal.column(signal.matched_filter)(F.col("embedding"), F.reverse("embedding")))


@query(f"WITH {_SPECTRA} " + _told("white", _back("1 / (sqrt((re * re + im * im)::FLOAT::DOUBLE) + 1.1920928955078125e-07)", "true")))
def whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", signal.column(signal.psd, window=64)(F.col("embedding")).alias("p"))
    return _rounded(e, "white", signal.column(signal.whiten)(F.col("embedding"), F.col("p")))
