"""Tensor column types: arrays of float whose dimensions live in the field's metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), True)
MATRIX = T.ArrayType(T.ArrayType(T.FloatType(), True), True)
KEY = "tensor"

#: Spellings of the scalar types.
SCALARS = {
    **dict.fromkeys(("INT", "INTEGER", "INT32", "INT64"), T.LongType()),
    **dict.fromkeys(("FLOAT", "FLOAT32", "FLOAT64", "DOUBLE"), T.FloatType()),
    **dict.fromkeys(("STRING", "TEXT", "VARCHAR"), T.StringType()),
    **dict.fromkeys(("BOOL", "BOOLEAN"), T.BooleanType()),
}


def tensor_field(name: str, dims: list[int], nullable: bool = True) -> T.StructField:
    """A vector (one dimension, 0: any) or matrix column."""
    kind = VECTOR if len(dims) != 2 else MATRIX
    return T.StructField(name, kind, nullable, {KEY: {"dims": list(dims) if len(dims) <= 2 else [0]}})


def field_of(name: str, spelled: str, dims: list[int] | None = None, nullable: bool = False) -> T.StructField:
    """A field from its type's spelling, e.g. INT, VECTOR with [3], MATRIX with [2, 2]."""
    word = spelled.upper()
    if word in SCALARS:
        return T.StructField(name, SCALARS[word], nullable)
    if word in ("VECTOR", "MATRIX", "TENSOR") and dims is not None:
        if word == "VECTOR" and len(dims) != 1 or word == "MATRIX" and len(dims) != 2:
            raise ValueError(f"{word} takes {1 if word == 'VECTOR' else 2} dimensions, not {len(dims)}")
        return tensor_field(name, dims, nullable)
    raise ValueError(f"unknown type {spelled}")


def dims_of(df: DataFrame, name: str) -> list[int] | None:
    """A tensor column's dimensions, if its metadata has them."""
    return df.schema[name].metadata.get(KEY, {}).get("dims")


def is_tensor(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType)


def is_matrix(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)


def with_dims(c: Column, name: str, dims: list[int]) -> Column:
    return c.alias(name, metadata={KEY: {"dims": list(dims)}})


def spelled(field: T.StructField) -> str:
    """The type's spelling in the query language."""
    kind, dims = field.dataType, field.metadata.get(KEY, {}).get("dims")
    if is_matrix(kind):
        return f"Matrix({', '.join(map(str, dims or (0, 0)))})"
    if is_tensor(kind):
        return f"Vector({(dims or [0])[0]})"
    names = {"long": "Int", "integer": "Int", "short": "Int", "byte": "Int", "float": "Float", "double": "Float", "string": "String", "boolean": "Bool"}
    return names.get(kind.typeName(), re.sub(r"\W.*", "", kind.simpleString()))


def zero_of(kind: T.DataType, dims: list[int] | None = None) -> object:
    """The default of a column that is neither nullable nor given one."""
    if is_matrix(kind):
        r, c = dims or (0, 0)
        return [[0.0] * c for _ in range(r)]
    if is_tensor(kind):
        return [0.0] * (dims or [0])[0]
    return {"string": "", "boolean": False, "float": 0.0, "double": 0.0}.get(kind.typeName(), 0)
