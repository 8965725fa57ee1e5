"""Sessions: databases of tensors and datasets, and the language's statements over them.

A dataset is a DataFrame and what the catalogue knows of it. Statements build DataFrames;
rows move only for SHOW, SAVE, EXPORT and bounded column extractions.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import signal, tensors
from .dsl.compiler import Compiler, QueryError, Scope
from .dsl.lexer import split_statements
from .dsl.parser import Item, Select, Statement
from .dsl.statements import parse
from .functions.vector import normalize
from .operators.search import similarity_topk
from .plans.shared import stored
from .sources import export_csv, load_package, package_stats, read_dataset, save_package
from .sources.connectors import frame_of_arrays, read_csv
from .tensors import Lineage, Tensor, TensorError
from .types import KEY, dims_of, field_of, is_tensor, spelled, zero_of

#: After so many changes a dataset is written and read back, so its plan stays short.
CHANGES = 16
#: Values that a column taken into a tensor may have.
MAX_TENSOR = 10_000_000


_COLUMN_AGGREGATES = {"SUM": F.sum, "MEAN": F.avg, "STDEV": F.stddev_pop}


class SessionError(ValueError):
    pass


@dataclass
class Dataset:
    frame: DataFrame
    lazy: dict[str, tuple] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)  # inserted, not yet part of the frame
    changes: int = 0


@dataclass
class Database:
    name: str
    tensors: dict[str, Tensor] = field(default_factory=dict)
    datasets: dict[str, Dataset] = field(default_factory=dict)
    #: tensor-first datasets: column to the tensor's name
    references: dict[str, dict[str, str]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def clear(self) -> None:
        for x in (self.tensors, self.datasets, self.references, self.aliases):
            x.clear()


@dataclass
class Result:
    """What a statement gives: a table, a tensor, a message, or some of these."""

    message: str = ""
    frame: DataFrame | None = None
    tensor: np.ndarray | None = None

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []


def _own_root(spark: SparkSession) -> str:
    """A folder of the session's own: in the cluster's shared folder, if that is mounted here."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    path = "/" + shared.removeprefix("file:").lstrip("/")
    if shared and (shared.startswith("file:") or "://" not in shared):
        os.makedirs(f"{path}/veldspar", exist_ok=True)
        return tempfile.mkdtemp(prefix="session-", dir=f"{path}/veldspar")
    if not spark.sparkContext.master.startswith("local"):
        raise SessionError("a session on a cluster needs a root folder that the driver and all executors see")
    return tempfile.mkdtemp(prefix="veldspar-session-")


class Session:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or _own_root(spark)
        self.databases = {"default": Database("default")}
        if os.path.isdir(self.root):
            for d in sorted(os.listdir(self.root)):
                if os.path.isdir(f"{self.root}/{d}"):
                    self.databases.setdefault(d, Database(d))
        self.active = "default"
        self.pipelines: dict[str, tuple[list, str]] = {}
        self.warnings: list[str] = []

    @property
    def db(self) -> Database:
        return self.databases[self.active]

    def folder(self, *parts: str) -> str:
        return os.path.join(self.root, self.active, *parts)

    # --- entry points ---

    def execute(self, source: str) -> Result:
        """Run one statement; blank lines and comments do nothing."""
        from .dsl.lexer import tokenize

        if not tokenize(source):
            return Result()
        s = parse(source)
        return getattr(self, f"do_{s.kind}")(s)

    def script(self, source: str) -> list[Result]:
        return [self.execute(s) for s in split_statements(source)]

    def sql(self, source: str) -> DataFrame:
        """The DataFrame of a statement that gives one."""
        got = self.execute(source)
        if got.frame is None:
            raise SessionError("the statement gives no table")
        return got.frame

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame a dataset of the active database."""
        self.db.datasets[name] = Dataset(df)

    # --- datasets ---

    def _dataset(self, name: str) -> Dataset:
        name = self.db.aliases.get(name, name)
        if name in self.db.references:
            self._sync(name)
        if name not in self.db.datasets:
            raise SessionError(f"unknown dataset {name}")
        return self.db.datasets[name]

    def frame(self, name: str) -> DataFrame:
        """The dataset with inserted rows and lazy columns."""
        d = self._dataset(name)
        self._flush(d)
        df = d.frame
        for column, e in d.lazy.items():
            df = self._with(df, column, e)
        return df

    def _with(self, df: DataFrame, column: str, e: tuple) -> DataFrame:
        v = self.compiler.value(e, Scope(df))
        return df.withColumn(column, v.column.alias(column, metadata={KEY: {"dims": v.known}}) if v.known else v.column)

    @property
    def compiler(self) -> Compiler:
        return Compiler(self.frame)

    def _flush(self, d: Dataset) -> None:
        if d.rows:
            rows, d.rows = d.rows, []
            new = self.spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in d.frame.schema]))
            self._change(d, d.frame.unionByName(new))

    def _change(self, d: Dataset, df: DataFrame) -> None:
        d.changes += 1
        kept = {f.name: f.metadata for f in d.frame.schema if f.metadata}
        columns = [F.col(f"`{f.name}`").alias(f.name, metadata=kept[f.name]) if f.name in kept and not f.metadata else F.col(f"`{f.name}`") for f in df.schema]
        df = df.select(*columns)
        d.frame = stored(df) if d.changes % CHANGES == 0 else df

    def _put(self, name: str, df: DataFrame) -> None:
        """A dataset under the name; one that is there gives way, schema and all."""
        self.db.references.pop(name, None)
        self.db.datasets[name] = Dataset(df)

    def _literal(self, e: tuple, f: T.StructField) -> Any:
        """A literal, or a tensor's value, in the column's type."""
        if e[0] == "col" and e[1] is None and e[2] in self.db.tensors:
            v: Any = self.db.tensors[e[2]].value().tolist()
        elif e[0] in ("lit", "vector", "matrix"):
            v = e[1]
        elif e[0] == "neg" and e[1][0] == "lit":
            v = -e[1][1]
        else:
            raise SessionError(f"{f.name} takes a literal or a tensor's name")
        if v is None:
            if not f.nullable:
                raise SessionError(f"{f.name} is not nullable")
            return None
        kind = f.dataType
        dims = f.metadata.get(KEY, {}).get("dims")
        if is_tensor(kind):
            a = np.asarray(v, dtype=np.float32)
            if a.ndim != len(dims or [0]) or dims and any(n not in (0, m) for n, m in zip(dims, a.shape, strict=True)):
                raise SessionError(f"{f.name} is {spelled(f)}, the value has the shape {list(a.shape)}")
            return a.tolist()
        if isinstance(kind, T.FloatType | T.DoubleType) and isinstance(v, int | float) and not isinstance(v, bool):
            return float(v)
        if isinstance(kind, T.LongType) and isinstance(v, float) and v == int(v):
            return int(v)
        wanted = {"long": int, "string": str, "boolean": bool}.get(kind.typeName())
        if wanted is None or not isinstance(v, wanted) or isinstance(v, bool) != (wanted is bool):
            raise SessionError(f"{f.name} is {spelled(f)}, not {v!r}")
        return v

    def do_create_dataset(self, s: Statement) -> Result:
        if s.name in self.db.datasets or s.name in self.db.references:
            raise SessionError(f"dataset {s.name} exists")
        fields = [field_of(c["name"], c["type"], c["dims"], c["nullable"]) for c in s.columns]
        defaults = {}
        for c, f in zip(s.columns, fields, strict=True):
            if c["default"] is not None:
                defaults[f.name] = self._literal(c["default"], T.StructField(f.name, f.dataType, True, f.metadata))
        d = Dataset(self.spark.createDataFrame([], T.StructType(fields)))
        d.metadata["defaults"] = defaults
        d.metadata["nullable"] = {f.name: f.nullable for f in fields}
        self.db.datasets[s.name] = d
        return Result(f"created dataset {s.name}")

    def do_create_from(self, s: Statement) -> Result:
        if s.name in self.db.datasets:
            raise SessionError(f"dataset {s.name} exists")
        self._put(s.name, stored(self.compiler.select(s.select)))
        return Result(f"created dataset {s.name}")

    def do_insert(self, s: Statement) -> Result:
        d = self._dataset(s.dataset)
        nullable, defaults = d.metadata.get("nullable", {}), d.metadata.get("defaults", {})
        fields = [T.StructField(f.name, f.dataType, nullable.get(f.name, True), f.metadata) for f in d.frame.schema]
        if s.values is not None:
            if len(s.values) != len(fields):
                raise SessionError(f"{s.dataset} has {len(fields)} columns, not {len(s.values)}")
            row = tuple(self._literal(e, f) for e, f in zip(s.values, fields, strict=True))
        else:
            if unknown := set(s.named) - {f.name for f in fields}:
                raise SessionError(f"{s.dataset} has no column {', '.join(sorted(unknown))}")
            row = tuple(self._literal(s.named[f.name], f) if f.name in s.named else defaults.get(f.name) for f in fields)
        d.rows.append(row)
        return Result("1 row inserted")

    def _predicate(self, e: tuple | None, df: DataFrame) -> Any:
        return F.lit(True) if e is None else F.coalesce(self.compiler.column(e, Scope(df)), F.lit(False))

    def do_update(self, s: Statement) -> Result:
        d = self._dataset(s.dataset)
        df = self.frame(s.dataset)
        own = d.frame.columns
        chosen = df.withColumn("__hit", self._predicate(s.where, df))
        for name, e in s.sets:
            if name not in own:
                raise SessionError(f"{s.dataset} has no column {name}")
            f = d.frame.schema[name]
            if e[0] in ("vector", "matrix") or e[0] == "col" and e[1] is None and e[2] not in chosen.columns and e[2] in self.db.tensors:
                value = F.lit(self._literal(e, f))
            else:
                value = self.compiler.column(e, Scope(chosen))
            if not is_tensor(f.dataType) or e[0] not in ("vector", "matrix"):
                value = value.cast(f.dataType)
            chosen = chosen.withColumn(name, F.when(F.col("__hit"), value).otherwise(F.col(f"`{name}`")).cast(f.dataType))
        self._change(d, chosen.select(*[f"`{c}`" for c in own]))
        return Result(f"updated {s.dataset}")

    def do_delete(self, s: Statement) -> Result:
        d = self._dataset(s.dataset)
        df = self.frame(s.dataset)
        self._change(d, df.filter(~self._predicate(s.where, df)).select(*[f"`{c}`" for c in d.frame.columns]))
        return Result(f"deleted from {s.dataset}")

    def do_add_column(self, s: Statement) -> Result:
        d, c = self._dataset(s.dataset), s.column
        self._flush(d)
        if c["name"] in d.frame.columns or c["name"] in d.lazy:
            raise SessionError(f"column {c['name']} exists")
        f = field_of(c["name"], c["type"], c["dims"], c["nullable"])
        if c["default"] is not None:
            value = self._literal(c["default"], T.StructField(f.name, f.dataType, True, f.metadata))
        else:
            value = None if c["nullable"] else zero_of(f.dataType, f.metadata.get(KEY, {}).get("dims"))
        column = F.lit(value).cast(f.dataType)
        d.frame = d.frame.withColumn(f.name, column.alias(f.name, metadata=f.metadata) if f.metadata else column)
        d.metadata.setdefault("nullable", {})[f.name] = f.nullable
        d.metadata.setdefault("defaults", {})[f.name] = value
        return Result(f"added {f.name} to {s.dataset}")

    def do_add_computed(self, s: Statement) -> Result:
        d = self._dataset(s.dataset)
        self._flush(d)
        if s.name in d.frame.columns or s.name in d.lazy:
            raise SessionError(f"column {s.name} exists")
        df = self._with(self.frame(s.dataset), s.name, s.expr)  # also a check of the expression
        if s.lazy:
            d.lazy[s.name] = s.expr
        else:
            d.frame = df.select(*[f"`{c}`" for c in d.frame.columns], f"`{s.name}`")
        return Result(f"added {'lazy ' if s.lazy else ''}{s.name} to {s.dataset}")

    def do_materialize(self, s: Statement) -> Result:
        d = self._dataset(s.dataset)
        d.frame, d.lazy = stored(self.frame(s.dataset)), {}
        return Result(f"materialized {s.dataset}")

    def do_set_metadata(self, s: Statement) -> Result:
        d = self._dataset(s.dataset)
        d.metadata.setdefault("user", {})[s.key] = s.value
        d.metadata["version"] = d.metadata.get("version", 1) + 1
        path = self.folder("datasets", s.dataset, "metadata.json")
        if os.path.exists(path):
            with open(path) as f:
                meta = json.load(f)
            meta.setdefault("user", {})[s.key] = s.value
            meta["version"] += 1
            with open(path, "w") as f:
                json.dump(meta, f, indent=1)
        return Result(f"{s.dataset}: {s.key} = {s.value}")

    def do_select(self, s: Statement) -> Result:
        return Result(frame=self.compiler.select(s.select))

    def do_transform(self, s: Statement) -> Result:
        df = self.compiler.select(s.select)
        self._put(s.into or s.source, df)
        return Result(f"transformed {s.source} into {s.into or s.source}", df)

    # --- search ---

    def do_create_index(self, s: Statement) -> Result:
        d = self._dataset(s.dataset)
        if s.column not in d.frame.columns:
            raise SessionError(f"{s.dataset} has no column {s.column}")
        if s.vector and not is_tensor(d.frame.schema[s.column].dataType):
            raise SessionError(f"{s.column} is no vector column")
        d.indexes[s.column] = "VECTOR" if s.vector else "HASH"
        return Result(f"indexed {s.dataset}({s.column})")

    def _search(self, s: Statement) -> DataFrame:
        d = self._dataset(s.dataset)
        if d.indexes.get(s.column) != "VECTOR":
            raise SessionError(f"SEARCH needs a vector index on {s.dataset}({s.column})")
        q = s.query[1] if s.query[0] == "vector" else self._tensor(s.query[1]).value().tolist()
        df = self.frame(s.dataset)
        ties = [f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType)]
        return similarity_topk(df, s.column, q, s.k, "__score", ties).drop("__score")

    def do_search(self, s: Statement) -> Result:
        df = self._search(s)
        self._put(s.into or "search_results", df)
        return Result(f"{s.into or 'search_results'} holds the {s.k} best", df)

    # --- tensors ---

    def _tensor(self, name: str) -> Tensor:
        name = self.db.aliases.get(name, name)
        if name not in self.db.tensors:
            raise SessionError(f"unknown tensor {name}")
        return self.db.tensors[name]

    def do_tensor(self, s: Statement) -> Result:
        values = s.values
        self.db.tensors[s.name] = Tensor.of(values, s.name, s.strict, s.shape)
        return Result(f"defined {s.name}", tensor=self.db.tensors[s.name].array)

    def _eval(self, e: tuple) -> Tensor:
        """A tensor expression; what it reads is looked up now, what it computes is deferred."""
        kind = e[0]
        if kind == "lit":
            return Tensor.of([e[1]], str(e[1]))
        if kind in ("vector", "matrix"):
            return Tensor.of(e[1])
        if kind == "name":
            return self._tensor(e[1])
        if kind == "field":
            return self._column_tensor(e[1], e[2])
        if kind == "unary" and e[1] in _COLUMN_AGGREGATES and e[2][0] == "field" and (got := self._column_aggregate(e[1], *e[2][1:])):
            return got
        parts, run, op = self._operation(e)
        operands = [self._eval(p) for p in parts]
        strict = any(t.kind == "strict" for t in operands)
        out = Tensor(None, Lineage(op, tuple(t.lineage for t in operands)), "strict" if strict else "normal", lambda: run(strict, *[t.value() for t in operands]))
        return out

    def _operation(self, e: tuple) -> tuple[list[tuple], Callable[..., np.ndarray], str]:
        kind = e[0]
        if kind == "binary":
            return [e[2], e[3]], lambda strict, a, b: tensors.elementwise(e[1], a, b, strict and a.size != 1 and b.size != 1), e[1]
        if kind == "matmul":
            return [e[1], e[2]], lambda _, a, b: tensors.matmul(a, b), "MATMUL"
        if kind == "unary":
            f = tensors.UNARY.get(e[1]) or {"FFT": signal.fft, "IFFT": signal.ifft, "MAGNITUDE": signal.magnitude}[e[1]]
            return [e[2]], lambda _, a: f(a), e[1]
        if kind == "scale":
            return [e[1]], lambda _, a: a * np.float32(e[2]), "SCALE"
        if kind == "reshape":
            return [e[1]], lambda _, a: tensors.reshape(a, e[2]), "RESHAPE"
        if kind == "stack":
            return e[1], lambda _, *a: tensors.stack(*a), "STACK"
        if kind == "pair":
            f = {"correlate": tensors.correlate, "similarity": tensors.similarity, "distance": tensors.distance, "whiten": signal.whiten, "matched_filter": signal.matched_filter}[e[1]]
            return [e[2], e[3]], lambda _, a, b: f(a, b), e[1].upper()
        if kind == "psd":
            return [e[1]], lambda _, a: signal.psd(a, e[2]), "PSD"
        if kind == "bandpass":
            return [e[1]], lambda _, a: signal.bandpass(a, *e[2:]), "BANDPASS"
        if kind == "index":
            if all(isinstance(p, int) for p in e[2]):
                return [e[1]], lambda _, a: tensors.index(a, e[2]), "INDEX"
            return [e[1]], lambda _, a: tensors.take(a, e[2]), "SLICE"
        raise TensorError(f"no tensor expression: {kind}")

    def _column_aggregate(self, kind: str, ds: str, column: str) -> Tensor | None:
        """SUM, MEAN or STDEV of a row dataset's column, as an aggregate where its rows are."""
        ds = self.db.aliases.get(ds, ds)
        if column in self.db.references.get(ds, {}):
            return None
        df = self.frame(ds)
        if column not in df.columns:
            raise SessionError(f"{ds} has no column {column}")
        v, kind_of = F.col(f"`{column}`"), df.schema[column].dataType
        if not is_tensor(kind_of) and not isinstance(kind_of, T.NumericType | T.BooleanType):
            raise SessionError(f"{ds}.{column} is not numeric")
        if is_tensor(kind_of):
            v = F.explode(F.flatten(v) if isinstance(kind_of.elementType, T.ArrayType) else v)
        values = df.select(v.alias("v")).select(F.col("v").cast("double").alias("v"))

        def run() -> np.ndarray:
            got = values.agg(_COLUMN_AGGREGATES[kind]("v").alias("x"), F.max(F.col("v").isNull()).alias("holes")).first()
            if got["holes"] is not False:
                raise SessionError(f"{ds}.{column} holds nulls or no rows")
            return np.asarray([got["x"]], dtype=np.float32)

        return Tensor(None, Lineage(kind, (Lineage("ROOT", name=f"{ds}.{column}"),)), make=run)

    def _column_tensor(self, ds: str, column: str) -> Tensor:
        ds = self.db.aliases.get(ds, ds)
        if column in self.db.references.get(ds, {}):
            return self._tensor(self.db.references[ds][column])
        df = self.frame(ds)
        if column not in df.columns:
            raise SessionError(f"{ds} has no column {column}")
        rows = df.select(F.col(f"`{column}`").alias("v")).limit(MAX_TENSOR + 1).toPandas()["v"].tolist()
        if len(rows) > MAX_TENSOR:
            raise SessionError(f"{ds}.{column} has over {MAX_TENSOR} rows; use column functions instead")
        kind = df.schema[column].dataType
        if not is_tensor(kind) and not isinstance(kind, T.NumericType | T.BooleanType):
            raise SessionError(f"{ds}.{column} is not numeric")
        try:
            return Tensor.of([list(map(float, v)) for v in rows] if is_tensor(kind) and not isinstance(kind.elementType, T.ArrayType) else rows, f"{ds}.{column}")
        except (TypeError, ValueError):
            raise SessionError(f"{ds}.{column} holds nulls or values of different shape") from None

    def do_let(self, s: Statement) -> Result:
        e = s.expr
        if e[0] == "dataset":
            if e[1] in self.db.datasets and e[1] not in self.db.references:
                raise SessionError(f"dataset {e[1]} exists")
            self.db.references.setdefault(e[1], {})
            if s.name != e[1]:
                self.db.aliases[s.name] = e[1]
            return Result(f"created dataset {e[1]}")
        got = self._eval(e)
        if e[0] in ("name", "field"):
            out = Tensor(got.array, got.lineage, got.kind, got.make)
        else:
            if e[0] not in ("lit", "vector", "matrix"):
                got = Tensor(got.array, Lineage(got.lineage.op, got.lineage.inputs, s.name), got.kind, got.make)
            out = got
        if s.lazy:
            out.kind = "lazy"
        else:
            out.value()
        self.db.aliases.pop(s.name, None)
        self.db.tensors[s.name] = out
        return Result(f"defined {s.name}", tensor=out.array)

    def do_bind(self, s: Statement) -> Result:
        db, target = self.db, self.db.aliases.get(s.target, s.target)
        if target in db.tensors:
            db.tensors[s.name] = db.tensors[target]
        elif target in db.references:
            db.references[s.name] = dict(db.references[target])
        elif target in db.datasets:
            self._flush(db.datasets[target])
            d = db.datasets[target]
            db.datasets[s.name] = Dataset(d.frame, dict(d.lazy), json.loads(json.dumps(d.metadata)), dict(d.indexes))
        else:
            raise SessionError(f"unknown tensor or dataset {s.target}")
        return Result(f"bound {s.name} to {s.target}")

    def do_attach(self, s: Statement) -> Result:
        ds = self.db.aliases.get(s.dataset, s.dataset)
        t = self._tensor(s.tensor).value()
        if ds not in self.db.references and ds not in self.db.datasets:
            raise SessionError(f"unknown dataset {s.dataset}")
        if ds in self.db.references:
            columns = self.db.references[ds]
            for other in columns.values():
                if len(np.atleast_1d(self._tensor(other).value())) != len(np.atleast_1d(t)):
                    raise SessionError(f"{s.tensor} has {len(np.atleast_1d(t))} rows, {ds} has {len(np.atleast_1d(self._tensor(other).value()))}")
            columns[s.column] = self.db.aliases.get(s.tensor, s.tensor)
            return Result(f"attached {s.tensor} to {ds}.{s.column}")
        df = self.frame(ds)
        if (n := df.count()) != len(np.atleast_1d(t)):
            raise SessionError(f"{s.tensor} has {len(np.atleast_1d(t))} rows, {ds} has {n}")
        # Rows are numbered where they are, in one order of partitions, and meet the array's by number.
        df = stored(df)
        rows = df.rdd.zipWithIndex().map(lambda r: (r[1], tuple(r[0]))).toDF(T.StructType([T.StructField("__row", T.LongType()), T.StructField("__old", df.schema)]))
        new = frame_of_arrays(self.spark, {s.column: np.atleast_1d(t)}).schema[0]
        own = [(k, v) for k, v in enumerate(np.atleast_1d(t).tolist())]
        values = self.spark.createDataFrame(own, T.StructType([T.StructField("__at", T.LongType()), T.StructField("__new", new.dataType)]))
        joined = rows.join(values, F.col("__row") == F.col("__at"))
        old = [F.col(f"__old.`{f.name}`").alias(f.name, metadata=f.metadata) for f in df.schema if f.name != s.column]
        self._put(ds, joined.select(*old, F.col("__new").alias(s.column, metadata=new.metadata)))
        return Result(f"attached {s.tensor} to {ds}.{s.column}")

    def _sync(self, name: str) -> None:
        """The queryable table of a tensor-first dataset, columns by name."""
        columns = self.db.references[name]
        lost = [c for c, t in columns.items() if t not in self.db.tensors]
        if lost:
            raise SessionError(f"{name}: no tensor behind {', '.join(lost)}")
        arrays = {c: self.db.tensors[columns[c]].value() for c in sorted(columns)}
        if any(a.ndim > 2 for a in arrays.values()):
            raise SessionError(f"{name}: a tensor of rank over 2 is no column")
        old = self.db.datasets.get(name)
        frame = frame_of_arrays(self.spark, arrays) if arrays else self.spark.createDataFrame([], T.StructType([]))
        self.db.datasets[name] = Dataset(frame, metadata=old.metadata if old else {}, indexes=old.indexes if old else {})

    # --- pipelines ---

    def do_define_pipeline(self, s: Statement) -> Result:
        self.pipelines[s.name] = (s.steps, s.source)
        return Result(f"defined pipeline {s.name}")

    def _pipeline(self, name: str) -> tuple[list, str]:
        if name not in self.pipelines:
            raise SessionError(f"unknown pipeline {name}")
        return self.pipelines[name]

    def apply_steps(self, df: DataFrame, steps: list) -> DataFrame:
        """All steps as one plan."""
        for kind, arg in steps:
            if kind == "normalize":
                dims = dims_of(df, arg)
                made = normalize(F.col(f"`{arg}`"))
                df = df.withColumn(arg, made.alias(arg, metadata={KEY: {"dims": dims}}) if dims else made)
                continue
            s = Select(arg if kind == "select" else [Item(("star",))], "__in")
            if kind == "where":
                s.where = arg
            elif kind == "order":
                s.order = arg
            elif kind == "limit":
                s.limit = arg
            df = Compiler(lambda _, df=df: df).select(s)
        return df

    def do_apply_pipeline(self, s: Statement) -> Result:
        df = self.apply_steps(self.frame(s.dataset), self._pipeline(s.name)[0])
        self._put(s.into or s.dataset, df)
        return Result(f"applied {s.name} to {s.dataset}", df)

    def do_describe_pipeline(self, s: Statement) -> Result:
        steps, source = self._pipeline(s.name)
        return Result("\n".join([source, *(f"{k + 1}. {kind.upper()}" for k, (kind, _) in enumerate(steps))]))

    def do_drop_pipeline(self, s: Statement) -> Result:
        self._pipeline(s.name)
        del self.pipelines[s.name]
        return Result(f"dropped pipeline {s.name}")

    # --- databases ---

    def do_create_database(self, s: Statement) -> Result:
        if s.name in self.databases and not s.quiet:
            raise SessionError(f"database {s.name} exists")
        self.databases.setdefault(s.name, Database(s.name))
        os.makedirs(os.path.join(self.root, s.name), exist_ok=True)
        return Result(f"created database {s.name}")

    def do_use_database(self, s: Statement) -> Result:
        if s.name not in self.databases:
            raise SessionError(f"unknown database {s.name}")
        self.active = s.name
        return Result(f"using {s.name}")

    def do_drop_database(self, s: Statement) -> Result:
        if s.name == "default":
            raise SessionError("the default database stays")
        if s.name not in self.databases:
            if s.quiet:
                return Result()
            raise SessionError(f"unknown database {s.name}")
        del self.databases[s.name]
        shutil.rmtree(os.path.join(self.root, s.name), ignore_errors=True)
        if self.active == s.name:
            self.active = "default"
        return Result(f"dropped database {s.name}")

    def do_reset(self, s: Statement) -> Result:
        self.db.clear()
        self.pipelines.clear()
        return Result("session reset")

    # --- files ---

    def do_use_dataset(self, s: Statement) -> Result:
        got = read_dataset(self.spark, s.path, s.fields)
        name = s.name or os.path.splitext(os.path.basename(s.path.rstrip("/")))[0]
        self.warnings += got.warnings
        if got.arrays:
            columns = {}
            for c, a in got.arrays.items():
                t = f"{name}_{c}"
                self.db.tensors[t] = Tensor.of(a, t)
                columns[c] = t
            if all(a.ndim <= 2 for a in got.arrays.values()):
                self.db.references[name] = columns
                return Result("\n".join([f"loaded {name}", *got.warnings]))
        self._put(name, got.frame)
        return Result("\n".join([f"loaded {name}", *got.warnings]))

    def do_import_dataset(self, s: Statement) -> Result:
        got = read_dataset(self.spark, s.path, s.fields)
        name = s.name or os.path.splitext(os.path.basename(s.path.rstrip("/")))[0]
        save_package(got.frame, self.folder("datasets", name), name, lineage={"origin": s.path, "warnings": got.warnings})
        return Result("\n".join([f"imported {name}; LOAD DATASET {name} to use it", *got.warnings]))

    def do_import_csv(self, s: Statement) -> Result:
        name = s.name or os.path.splitext(os.path.basename(s.path))[0]
        self._put(name, read_csv(self.spark, s.path))
        return Result(f"imported {name}")

    def do_export(self, s: Statement) -> Result:
        export_csv(self.frame(s.name), s.path)
        return Result(f"exported {s.name} to {s.path}")

    def do_save_dataset(self, s: Statement) -> Result:
        d = self._dataset(s.name)
        meta = save_package(self.frame(s.name), s.path or self.folder("datasets", s.name), s.name, {"user": d.metadata.get("user", {})})
        return Result(f"saved {s.name}, version {meta['version']}")

    def do_load_dataset(self, s: Statement) -> Result:
        path = s.path or self.folder("datasets", s.name)
        if path.endswith(".parquet") and not os.path.exists(os.path.join(path, "schema.json")):
            self._put(s.name, self.spark.read.parquet(path))
            return Result(f"loaded {s.name}")
        df, meta = load_package(self.spark, path)
        self._put(s.name, df)
        self.db.datasets[s.name].metadata["user"] = meta.get("user", {})
        return Result(f"loaded {s.name}")

    def _json_path(self, s: Statement, kind: str) -> str:
        path = s.path or self.folder(kind, f"{s.name}.json")
        return os.path.join(path, f"{s.name}.json") if os.path.isdir(path) else path

    def do_save_tensor(self, s: Statement) -> Result:
        path = self._json_path(s, "tensors")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w") as f:
            f.write(self._tensor(s.name).to_json(s.name))
        return Result(f"saved {s.name}")

    def do_load_tensor(self, s: Statement) -> Result:
        with open(self._json_path(s, "tensors")) as f:
            self.db.tensors[s.name] = Tensor.from_json(f.read())
        return Result(f"loaded {s.name}", tensor=self.db.tensors[s.name].array)

    def do_save_pipeline(self, s: Statement) -> Result:
        from . import __version__

        path = self._json_path(s, "pipelines")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w") as f:
            json.dump({"name": s.name, "source": self._pipeline(s.name)[1], "version": __version__}, f, indent=1)
        return Result(f"saved pipeline {s.name}")

    def do_load_pipeline(self, s: Statement) -> Result:
        with open(self._json_path(s, "pipelines")) as f:
            source = json.load(f)["source"]
        got = parse(source)
        self.pipelines[s.name] = (got.steps, source)
        return Result(f"loaded pipeline {s.name}")

    def do_list(self, s: Statement) -> Result:
        kind = s.what.lower()
        if kind == "pipelines":
            return Result("\n".join(sorted(self.pipelines)))
        path = s.path or self.folder(kind)
        found = sorted(x.removesuffix(".json") for x in os.listdir(path)) if os.path.isdir(path) else []
        return Result("\n".join(found))

    def delete_dataset(self, name: str) -> None:
        """Remove the stored package."""
        shutil.rmtree(self.folder("datasets", name))

    def delete_tensor(self, name: str) -> None:
        os.remove(self.folder("tensors", f"{name}.json"))

    def do_deliver(self, s: Statement) -> Result:
        self._dataset(s.name)
        path = os.path.join(s.path or self.folder("datasets", s.name), "manifest.json")
        if os.path.exists(path):
            return Result(f"{s.name} is ready for delivery: {path}")
        return Result(f"{s.name} has no manifest yet; SAVE DATASET {s.name} first")

    # --- introspection ---

    def do_say(self, s: Statement) -> Result:
        return Result(s.text)

    def do_show(self, s: Statement) -> Result:
        name = self.db.aliases.get(s.name, s.name)
        if name in self.db.tensors:
            a = self.db.tensors[name].value()
            if self.db.tensors[name].kind == "lazy":
                self.db.tensors[name].kind = "normal"
            return Result(f"{s.name}: shape {list(a.shape)}\n{np.array2string(a, threshold=40)}", tensor=a)
        health = self._audit(name)
        if health:
            return Result("\n".join([f"{name}: reference graph is broken", *health]))
        df = self.frame(name)
        return Result(f"{s.name}: {', '.join(f'{f.name} {spelled(f)}' for f in df.schema)}", df)

    def first_value(self, name: str, column: str) -> Any:
        """A column of the dataset's first row; None if there is no row."""
        row = self.frame(name).select(F.col(f"`{column}`")).first()
        return row[0] if row else None

    def statistics(self, name: str) -> dict[str, Any]:
        """Nulls, minimum, maximum and mean of a dataset's columns, in one pass over its rows as they are now."""
        return package_stats(self.frame(name))

    def do_show_expr(self, s: Statement) -> Result:
        a = self._eval(s.expr).value()
        return Result(np.array2string(a, threshold=40), tensor=a)

    def do_show_all(self, s: Statement) -> Result:
        if s.what == "tensors":
            lines = [f"{n}: {t.kind}, " + ("not computed" if t.array is None else f"shape {list(t.array.shape)}") for n, t in sorted(self.db.tensors.items())]
        elif s.what == "datasets":
            for n in self.db.references:
                self._sync(n)
            lines = [f"{n}: {self.frame(n).count()} rows, {len(self.frame(n).columns)} columns" for n in sorted(self.db.datasets)]
        elif s.what == "databases":
            lines = [f"{n}{' *' if n == self.active else ''}" for n in sorted(self.databases)]
        else:
            lines = [f"{n}: {len(steps)} steps" for n, (steps, _) in sorted(self.pipelines.items())]
        return Result("\n".join(lines))

    def do_show_schema(self, s: Statement) -> Result:
        d = self._dataset(s.name)
        nullable = d.metadata.get("nullable", {})
        return Result("\n".join(f"{f.name}: {spelled(f)}{'?' if nullable.get(f.name, f.nullable) else ''}{' LAZY' if f.name in d.lazy else ''}" for f in self.frame(s.name).schema))

    def do_show_shape(self, s: Statement) -> Result:
        return Result(str(list(self._tensor(s.name).value().shape)))

    def do_show_lineage(self, s: Statement) -> Result:
        t = self._tensor(s.name)
        return Result("\n".join(t.lineage.lines()))

    def do_show_indexes(self, s: Statement) -> Result:
        names = [s.dataset] if s.dataset else sorted(self.db.datasets)
        return Result("\n".join(f"{n}({c}): {kind}" for n in names for c, kind in sorted(self._dataset(n).indexes.items())))

    def _stored_metadata(self, name: str) -> dict[str, Any] | None:
        path = self.folder("datasets", name, "metadata.json")
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return json.load(f)

    def do_show_metadata(self, s: Statement) -> Result:
        stored_meta = self._stored_metadata(s.name)
        own = self.db.datasets.get(s.name)
        if own is None and stored_meta is None:
            raise SessionError(f"unknown dataset {s.name}")
        meta = {**(stored_meta or {"version": 1, "origin": "session"})}
        if own is not None:
            meta["version"] = max(meta["version"], own.metadata.get("version", 1))
            meta["user"] = {**meta.get("user", {}), **own.metadata.get("user", {})}
        meta.pop("history", None)
        return Result(json.dumps(meta, indent=1, sort_keys=True))

    def do_versions(self, s: Statement) -> Result:
        meta = self._stored_metadata(s.name)
        if meta is None:
            raise SessionError(f"no saved dataset {s.name}")
        return Result("\n".join(f"{v['version']} {v['at']} {v['rows']} rows: {', '.join(v['columns'])}" for v in meta["history"]))

    def do_explain(self, s: Statement) -> Result:
        df = self.compiler.select(s.select) if s.select else self._search(s.search)
        return Result(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))

    def _audit(self, name: str) -> list[str]:
        return [f"{c}: no tensor {t}" for c, t in self.db.references.get(name, {}).items() if t not in self.db.tensors]

    def do_audit(self, s: Statement) -> Result:
        name = self.db.aliases.get(s.name, s.name)
        if name not in self.db.references and name not in self.db.datasets:
            raise SessionError(f"unknown dataset {s.name}")
        found = self._audit(name)
        return Result("\n".join(found) if found else f"{s.name} is sound")


__all__ = ["Dataset", "QueryError", "Result", "Session", "SessionError"]
