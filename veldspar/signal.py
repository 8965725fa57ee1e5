"""The frequency domain: real signals, spectra as two rows (real, imaginary).

Each operation takes one array; `column` lifts one to a column of arrays, evaluated in
Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tensors import TensorError

EPS = float(np.finfo(np.float32).eps)


def _signal(op: str, a: np.ndarray, several: bool = False) -> np.ndarray:
    """several: a row for each signal; all operations work along the last axis."""
    if a.ndim != 1 + several or not a.shape[-1]:
        raise TensorError(f"{op} takes a vector with samples")
    return a.astype(np.float64)


def _spectrum(op: str, a: np.ndarray, several: bool = False) -> np.ndarray:
    if a.ndim != 2 + several or a.shape[-2] != 2 or not a.shape[-1]:
        raise TensorError(f"{op} takes a spectrum of two rows")
    return a[..., 0, :].astype(np.float64) + 1j * a[..., 1, :].astype(np.float64)


def fft(a: np.ndarray, several: bool = False) -> np.ndarray:
    z = np.fft.rfft(_signal("FFT", a, several))
    return np.stack((z.real, z.imag), axis=-2).astype(np.float32)


def ifft(a: np.ndarray, several: bool = False) -> np.ndarray:
    """The signal of even length 2 (M - 1) with this spectrum."""
    z = _spectrum("IFFT", a, several)
    n = z.shape[-1]
    return np.fft.irfft(z, 2 * (n - 1)).astype(np.float32) if n > 1 else z.real.astype(np.float32)[..., :0]


def magnitude(a: np.ndarray, several: bool = False) -> np.ndarray:
    return np.abs(_spectrum("MAGNITUDE", a, several)).astype(np.float32)


def psd(a: np.ndarray, window: int, several: bool = False) -> np.ndarray:
    """Mean squared spectrum of the chunks of `window` samples; a rest is left out."""
    x = _signal("PSD", a, several)
    n = x.shape[-1]
    if not 0 < window <= n:
        raise TensorError(f"PSD: a window of {window} does not fit {n} samples")
    chunks = x[..., : n // window * window].reshape(*x.shape[:-1], -1, window)
    return (np.abs(np.fft.rfft(chunks)) ** 2).mean(axis=-2).astype(np.float32)


def whiten(a: np.ndarray, p: np.ndarray, several: bool = False) -> np.ndarray:
    x = _signal("WHITEN", a, several)
    n = x.shape[-1]
    if p.ndim != 1 + several or p.shape[-1] != n // 2 + 1:
        raise TensorError(f"WHITEN: {n} samples need a spectrum of {n // 2 + 1}")
    return np.fft.irfft(np.fft.rfft(x) / (np.sqrt(p.astype(np.float64)) + EPS), n).astype(np.float32)


def bandpass(a: np.ndarray, low: float, high: float, rate: float, several: bool = False) -> np.ndarray:
    """Without the bins outside [low, high]."""
    x = _signal("BANDPASS", a, several)
    if not (0 <= low <= high and rate > 0):
        raise TensorError(f"BANDPASS: no band from {low} to {high} at the rate {rate}")
    z, n = np.fft.rfft(x), x.shape[-1]
    at = np.arange(z.shape[-1]) * rate / n
    return np.fft.irfft(np.where((at >= low) & (at <= high), z, 0), n).astype(np.float32)


def matched_filter(a: np.ndarray, b: np.ndarray, several: bool = False) -> np.ndarray:
    """Circular cross-correlation with the template b."""
    x, y = _signal("MATCHED_FILTER", a, several), _signal("MATCHED_FILTER", b, several)
    if x.shape[-1] != y.shape[-1]:
        raise TensorError("MATCHED_FILTER takes two signals of one length")
    return np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), x.shape[-1]).astype(np.float32)


def column(f: Callable[..., np.ndarray], matrix_in: bool = False, matrix_out: bool = False, **options: object) -> Callable[..., Column]:
    """f over columns of arrays: column(fft, matrix_out=True)("samples"). Null gives null.

    Rows of one length go through f together, as one array.
    """
    kind = "array<array<float>>" if matrix_out else "array<float>"

    def array(x: object) -> np.ndarray:
        return np.array([np.asarray(r, dtype=np.float32) for r in x] if matrix_in else x, dtype=np.float32)

    def run(*columns: pd.Series) -> pd.Series:
        out: list = [None] * len(columns[0])
        alike: dict[tuple, list[int]] = {}
        arrays = [[None if x is None else array(x) if k == 0 else np.asarray(x, dtype=np.float32) for x in c] for k, c in enumerate(columns)]
        for k, row in enumerate(zip(*arrays, strict=True)):
            if all(x is not None for x in row):
                alike.setdefault(tuple(x.shape for x in row), []).append(k)
        for rows in alike.values():
            for k, got in zip(rows, f(*(np.stack([a[k] for k in rows]) for a in arrays), several=True, **options), strict=True):
                out[k] = list(got) if matrix_out else got
        return pd.Series(out, dtype=object)

    def one(x: pd.Series) -> pd.Series:
        return run(x)

    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return run(x, y)

    for g, n in ((one, 1), (two, 2)):
        g.__annotations__ = {**dict.fromkeys(["x", "y"][:n], pd.Series), "return": pd.Series}
    return lambda *c: F.pandas_udf(one if len(c) == 1 else two, kind)(*c)
