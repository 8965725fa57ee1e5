"""Named arrays: element-wise algebra, slicing, lineage and deferred evaluation, in float32.

A tensor is one array on the driver. The same operations over many rows are the column
functions of `functions`; those of the frequency domain are in `signal`.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


class TensorError(ValueError):
    pass


@dataclass(frozen=True)
class Lineage:
    op: str
    inputs: tuple[Lineage, ...] = ()
    name: str = ""
    execution: str = field(default_factory=lambda: uuid.uuid4().hex)

    def lines(self, depth: int = 0) -> list[str]:
        own = f"{'  ' * depth}{self.name or '_'} <- {self.op}"
        return [own, *(x for i in self.inputs for x in i.lines(depth + 1))]

    def as_dict(self) -> dict:
        return {"op": self.op, "name": self.name, "execution": self.execution, "inputs": [i.as_dict() for i in self.inputs]}

    @classmethod
    def from_dict(cls, d: dict) -> Lineage:
        return cls(d["op"], tuple(map(cls.from_dict, d["inputs"])), d["name"], d["execution"])


@dataclass
class Tensor:
    """kind: normal, strict or lazy. A lazy tensor holds how it is made until it is looked at."""

    array: np.ndarray | None
    lineage: Lineage
    kind: str = "normal"
    make: Callable[[], np.ndarray] | None = None

    @classmethod
    def of(cls, values: object, name: str = "", strict: bool = False, shape: list[int] | None = None) -> Tensor:
        a = np.asarray(values, dtype=np.float32)
        if shape is not None:
            if a.size != int(np.prod(shape, dtype=np.int64)):
                raise TensorError(f"{a.size} values do not fill the shape {shape}")
            a = a.reshape(shape)
        return cls(a, Lineage("ROOT", name=name), "strict" if strict else "normal")

    def value(self) -> np.ndarray:
        if self.array is None:
            self.array, self.make = np.asarray(self.make(), dtype=np.float32), None
        return self.array

    def data_hash(self) -> str:
        return hashlib.sha256(np.ascontiguousarray(self.value()).tobytes()).hexdigest()

    def to_json(self, name: str) -> str:
        a = self.value()
        return json.dumps({"name": name, "shape": list(a.shape), "data": [float(x) for x in a.ravel()], "kind": self.kind, "lineage": self.lineage.as_dict(), "hash": self.data_hash()})

    @classmethod
    def from_json(cls, text: str) -> Tensor:
        d = json.loads(text)
        a = np.array(d["data"], dtype=np.float32).reshape(d["shape"])
        return cls(a, Lineage.from_dict(d["lineage"]), "strict" if d["kind"] == "strict" else "normal")


_NEUTRAL = {"ADD": 0.0, "SUBTRACT": 0.0, "MULTIPLY": 1.0, "DIVIDE": 1.0}
_NUMPY = {"ADD": np.add, "SUBTRACT": np.subtract, "MULTIPLY": np.multiply, "DIVIDE": np.divide}


def elementwise(op: str, a: np.ndarray, b: np.ndarray, strict: bool = False) -> np.ndarray:
    """Same shapes, or one scalar; vectors of different length are padded with what changes
    nothing, unless strict. Dividing by zero is an error."""
    if a.shape != b.shape and a.size != 1 and b.size != 1 or strict and a.shape != b.shape:
        if strict or a.ndim != 1 or b.ndim != 1:
            raise TensorError(f"{op}: shapes {list(a.shape)} and {list(b.shape)} do not match")
        n = max(len(a), len(b))
        a, b = (np.pad(x, (0, n - len(x)), constant_values=_NEUTRAL[op]) for x in (a, b))
    elif a.shape != b.shape:
        a, b = (x.reshape(()) if x.size == 1 else x for x in (a, b))
    if op == "DIVIDE" and (b == 0).any():
        raise TensorError("DIVIDE: division by zero")
    return np.asarray(_NUMPY[op](a.astype(np.float32), b.astype(np.float32)), dtype=np.float32)


def _relaxed(op: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: elementwise(op, a, b)


#: The element-wise operations by name, padding shorter vectors.
add_relaxed, subtract_relaxed, multiply_relaxed, divide_relaxed = map(_relaxed, ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"))


def matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[0]:
        raise TensorError(f"MATMUL: shapes {list(a.shape)} and {list(b.shape)} do not match")
    return a @ b


def transpose(a: np.ndarray) -> np.ndarray:
    if a.ndim != 2:
        raise TensorError("TRANSPOSE takes a matrix")
    return a.T


def reshape(a: np.ndarray, shape: list[int]) -> np.ndarray:
    if a.size != int(np.prod(shape, dtype=np.int64)):
        raise TensorError(f"RESHAPE: {a.size} elements do not fill {shape}")
    return a.reshape(shape)


def stack(*arrays: np.ndarray) -> np.ndarray:
    if len(arrays) < 2 or len({a.shape for a in arrays}) != 1:
        raise TensorError("STACK takes two or more tensors of one shape")
    return np.stack(arrays)


def normalize(a: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt((a.astype(np.float64) ** 2).sum()))
    if norm == 0:
        raise TensorError("NORMALIZE: a zero tensor has no direction")
    return a / norm


def _alike(op: str, a: np.ndarray, b: np.ndarray) -> None:
    if a.ndim != 1 or b.ndim != 1 or len(a) != len(b):
        raise TensorError(f"{op} takes two vectors of one length")


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot product."""
    _alike("CORRELATE", a, b)
    return np.dot(a, b)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _alike("SIMILARITY", a, b)
    x, y = a.astype(np.float64), b.astype(np.float64)
    norms = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
    if norms == 0:
        raise TensorError("SIMILARITY: a zero vector has no direction")
    return np.dot(x, y) / norms


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _alike("DISTANCE", a, b)
    return np.sqrt(((a.astype(np.float64) - b) ** 2).sum())


def index(a: np.ndarray, at: list[int]) -> np.ndarray:
    if len(at) != a.ndim or any(not 0 <= i < n for i, n in zip(at, a.shape, strict=False)):
        raise TensorError(f"index {at} is outside the shape {list(a.shape)}")
    return np.asarray(a[tuple(at)])


def take(a: np.ndarray, parts: list[int | tuple[int | None, int | None]]) -> np.ndarray:
    """One part per dimension: an index, or a half-open range with open ends as None."""
    if len(parts) != a.ndim:
        raise TensorError(f"{len(parts)} slices for {a.ndim} dimensions")
    cut = []
    for p, n in zip(parts, a.shape, strict=True):
        if isinstance(p, int):
            if not 0 <= p < n:
                raise TensorError(f"index {p} is outside 0..{n - 1}")
            cut.append(p)
            continue
        lo, hi = p[0] or 0, n if p[1] is None else p[1]
        if not 0 <= lo <= hi <= n:
            raise TensorError(f"slice {lo}:{hi} is outside 0..{n}")
        cut.append(slice(lo, hi))
    return a[tuple(cut)]


def _one(f: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda a: np.asarray([f(a.astype(np.float64))], dtype=np.float32)


UNARY: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "TRANSPOSE": transpose, "FLATTEN": np.ravel, "NORMALIZE": normalize, "SUM": _one(np.sum), "MEAN": _one(np.mean), "STDEV": _one(np.std),
}
