"""Which reader takes a path, and what it makes of it.

Tables (CSV, Parquet and whatever Spark reads) stay distributed. Array files hold named
arrays; those that share the first one's number of rows become columns, N-D shapes are kept
in the column's metadata, and the others are left out with a warning, or are an error if
they were asked for by name.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import tensor_field
from .arrays import SourceError, read_hdf5, read_npy, read_npz, read_zarr, shapes


@dataclass
class Loaded:
    frame: DataFrame
    arrays: dict[str, np.ndarray] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


def _is_zarr(path: str) -> bool:
    return _extension(path) == "zarr" or os.path.isdir(path) and any(os.path.exists(os.path.join(path, f)) for f in ("zarr.json", ".zgroup"))


#: Reader name and the test for its paths, first match first.
CONNECTORS: list[tuple[str, Callable[[str], bool]]] = [
    ("csv", lambda p: _extension(p) == "csv"),
    ("npy", lambda p: _extension(p) == "npy"),
    ("npz", lambda p: _extension(p) == "npz"),
    ("hdf5", lambda p: _extension(p) in ("h5", "hdf5", "h5ad", "nc")),
    ("zarr", _is_zarr),
    ("parquet", lambda p: _extension(p) == "parquet"),
    ("json", lambda p: _extension(p) in ("json", "jsonl")),
    ("orc", lambda p: _extension(p) == "orc"),
]
_ARRAYS: dict[str, Callable[[str], dict[str, np.ndarray]]] = {"npy": read_npy, "npz": read_npz, "hdf5": read_hdf5, "zarr": read_zarr}


def find_connector(path: str) -> str:
    for name, takes in CONNECTORS:
        if takes(path):
            return name
    raise SourceError(f"no reader for {path}")


def read_csv(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """With a header; whole numbers are long, others float, the rest boolean or text."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if not df.columns:
        raise SourceError(f"{path} is empty")
    if fields:
        if missing := [f for f in fields if f not in df.columns]:
            raise SourceError(f"{path} has no field {', '.join(missing)}")
        df = df.select(*[f"`{f}`" for f in fields])
    to = {"integer": "bigint", "double": "float"}
    return df.select(*[F.col(f"`{f.name}`").cast(to[f.dataType.typeName()]).alias(f.name) if f.dataType.typeName() in to else F.col(f"`{f.name}`") for f in df.schema])


def chosen(arrays: dict[str, np.ndarray], path: str, fields: list[str] | None) -> tuple[dict[str, np.ndarray], list[str]]:
    if fields:
        if missing := [f for f in fields if f not in arrays]:
            raise SourceError(f"{path} has no field {', '.join(missing)}")
        arrays = {f: arrays[f] for f in fields}
    if not arrays:
        raise SourceError(f"{path} holds no numeric array")
    rows, out, warnings = None, {}, []
    for name, a in arrays.items():
        a = np.asarray(a, dtype=np.float32)
        n = a.shape[0] if a.ndim else 1
        rows = n if rows is None else rows
        if n == rows:
            out[name] = a
        elif fields:
            raise SourceError(f"{path}: {name} has {n} rows, the others {rows}")
        else:
            warnings.append(f"{path}: left out {name}, {n} rows instead of {rows}")
    return out, warnings


def frame_of_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """A row for each first index: a number, or a vector of what is behind it."""
    columns, fields = {}, []
    for name, a in arrays.items():
        a = a.reshape(-1) if a.ndim == 0 else a
        shape = {"shape": list(a.shape)}
        if a.ndim == 1:
            columns[name] = [float(x) for x in a]
            fields.append(T.StructField(name, T.FloatType(), True, shape))
        else:
            flat = a.reshape(a.shape[0], -1)
            columns[name] = [r.tolist() for r in flat]
            f = tensor_field(name, [flat.shape[1]])
            fields.append(T.StructField(name, f.dataType, True, {**f.metadata, **shape}))
    pdf = pd.DataFrame(columns)
    return spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), T.StructType(fields))


def read_dataset(spark: SparkSession, path: str, fields: list[str] | None = None) -> Loaded:
    kind = find_connector(path)
    if kind == "csv":
        return Loaded(read_csv(spark, path, fields))
    if kind in _ARRAYS:
        if not os.path.exists(path):
            raise SourceError(f"{path} does not exist")
        arrays, warnings = chosen(_ARRAYS[kind](path), path, fields)
        return Loaded(frame_of_arrays(spark, arrays), arrays, warnings)
    df = spark.read.load(path, format=kind)
    if fields:
        if missing := [f for f in fields if f not in df.columns]:
            raise SourceError(f"{path} has no field {', '.join(missing)}")
        df = df.select(*[f"`{f}`" for f in fields])
    return Loaded(df)


def inspect(spark: SparkSession, path: str) -> T.StructType:
    """The schema that reading the path would give; of array files only headers are read."""
    kind = find_connector(path)
    if kind not in _ARRAYS:
        return read_dataset(spark, path).frame.schema
    if not os.path.exists(path):
        raise SourceError(f"{path} does not exist")
    found = shapes(kind, path)
    rows = next(iter(found.values()), (1,))[:1]
    fields = []
    for name, shape in found.items():
        if (shape[:1] or (1,)) == (rows or (1,)):
            told = {"shape": list(shape)}
            f = tensor_field(name, [int(np.prod(shape[1:]))]) if len(shape) > 1 else T.StructField(name, T.FloatType())
            fields.append(T.StructField(name, f.dataType, True, {**f.metadata, **told}))
    return T.StructType(fields)
