"""The dataset package: a Parquet table beside its schema, statistics, lineage and versions."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import dims_of, is_tensor
from .arrays import SourceError

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def package_stats(df: DataFrame) -> dict[str, dict[str, Any]]:
    """Per column: count of nulls, share of nulls, and of numbers min, max and mean; one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs.append(F.sum(c.isNull().cast("long")).alias(f"nulls{k}"))
        if isinstance(f.dataType, _NUMBERS):
            aggs += [F.min(c).alias(f"min{k}"), F.max(c).alias(f"max{k}"), F.avg(c).alias(f"mean{k}")]
        elif is_tensor(f.dataType):
            aggs += [F.min(F.size(c)).alias(f"low{k}"), F.max(F.size(c)).alias(f"high{k}")]
    got = df.agg(*aggs).first().asDict()
    rows = got["rows"]
    out: dict[str, dict[str, Any]] = {}
    for k, f in enumerate(df.schema):
        nulls = got[f"nulls{k}"] or 0
        own: dict[str, Any] = {"null_count": nulls, "sparsity": nulls / rows if rows else 0.0}
        for key in ("min", "max", "mean"):
            if f"{key}{k}" in got:
                v = got[f"{key}{k}"]
                own[key] = float(v) if v is not None else None
        if is_tensor(f.dataType):
            own["tensor_shape"] = dims_of(df, f.name) or ([got[f"low{k}"]] if got[f"low{k}"] == got[f"high{k}"] else None)
        out[f.name] = own
    return out | {"__rows": {"count": rows}}


def _write(path: str, value: Any) -> None:
    with open(path, "w") as f:
        json.dump(value, f, indent=1, default=str)


def _read(path: str) -> Any:
    with open(path) as f:
        return json.load(f)


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def save_package(df: DataFrame, folder: str, name: str, metadata: dict[str, Any] | None = None, lineage: Any = None) -> dict[str, Any]:
    """Write data.parquet and its sidecars; a changed schema is added to the versions."""
    os.makedirs(folder, exist_ok=True)
    before = _read(f"{folder}/metadata.json") if os.path.exists(f"{folder}/metadata.json") else {"version": 0, "history": [], "created": now()}
    data = f"{folder}/data.parquet"
    beside = f"{folder}/data.new.parquet"
    df.write.mode("overwrite").parquet(beside)  # the old table may be what df reads
    import shutil

    shutil.rmtree(data, ignore_errors=True)
    os.replace(beside, data)
    schema = json.loads(df.schema.json())
    stored = df.sparkSession.read.schema(df.schema).parquet(data)
    stats = package_stats(stored)
    digest = hashlib.sha256(json.dumps([schema, stats], sort_keys=True, default=str).encode()).hexdigest()
    version = before["version"] + 1
    columns = [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema]
    meta = {**before, **(metadata or {}), "name": name, "version": version, "hash": digest, "updated": now()}
    meta["history"] = [*before["history"], {"version": version, "at": now(), "columns": columns, "rows": stats["__rows"]["count"]}]
    _write(f"{folder}/schema.json", schema)
    _write(f"{folder}/stats.json", stats)
    _write(f"{folder}/lineage.json", lineage or {"origin": "session"})
    _write(f"{folder}/metadata.json", meta)
    _write(f"{folder}/manifest.json", {"name": name, "version": version, "hash": digest, "files": ["data.parquet", "schema.json", "stats.json", "lineage.json", "metadata.json"]})
    return meta


def load_package(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, Any]]:
    """The table with its column metadata, and the package's metadata."""
    if not os.path.exists(f"{folder}/schema.json"):
        raise SourceError(f"no dataset package in {folder}")
    schema = T.StructType.fromJson(_read(f"{folder}/schema.json"))
    return spark.read.schema(schema).parquet(f"{folder}/data.parquet"), _read(f"{folder}/metadata.json")


def export_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with a header; vectors and matrices as JSON."""
    columns = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)
