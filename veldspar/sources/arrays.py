"""Array files as named float32 arrays: NumPy, HDF5 (with h5py) and Zarr version 3."""

from __future__ import annotations

import gzip
import json
import os
from itertools import product

import numpy as np


class SourceError(ValueError):
    pass


def read_npy(path: str) -> dict[str, np.ndarray]:
    return {"array": np.load(path, allow_pickle=False)}


def read_npz(path: str) -> dict[str, np.ndarray]:
    with np.load(path, allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def read_hdf5(path: str) -> dict[str, np.ndarray]:
    """Numeric datasets; groups are flattened, their names joined by _."""
    try:
        import h5py
    except ImportError:
        raise SourceError(f"{path}: reading HDF5 needs the h5py library, which is not installed") from None
    out: dict[str, np.ndarray] = {}

    def visit(name: str, node: object) -> None:
        if isinstance(node, h5py.Dataset) and node.dtype.kind in "fiub":
            out[name.replace("/", "_")] = node[()]

    with h5py.File(path, "r") as f:
        f.visititems(visit)
    return out


def _crc_table() -> list[int]:
    """The table of the polynomial 0x82F63B78 (CRC-32C, reflected)."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def crc32c(raw: bytes) -> int:
    c = 0xFFFFFFFF
    for b in raw:
        c = c >> 8 ^ _CRC[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def _zarr_codecs(codecs: list[dict], raw: bytes, dtype: np.dtype) -> np.ndarray:
    endian = "little"
    for c in reversed(codecs):
        name, options = c["name"], c.get("configuration", {})
        if name == "bytes":
            endian = options.get("endian", "little")
        elif name == "gzip":
            raw = gzip.decompress(raw)
        elif name == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif name == "crc32c":
            raw, told = raw[:-4], raw[-4:]
            if crc32c(raw).to_bytes(4, "little") != told:
                raise SourceError("a Zarr chunk's checksum does not fit its bytes")
        else:
            raise SourceError(f"unsupported Zarr codec {name}")
    return np.frombuffer(raw, dtype=dtype.newbyteorder("<" if endian == "little" else ">"))


def _zarr_array(folder: str, meta: dict) -> np.ndarray:
    shape, dtype = tuple(meta["shape"]), np.dtype(meta["data_type"])
    chunk = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
    encoding = meta.get("chunk_key_encoding", {"name": "default"})
    sep = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
    fill = meta.get("fill_value", 0)
    out = np.full(shape, np.nan if fill == "NaN" else fill or 0, dtype=dtype)
    for at in product(*(range(-(-n // c)) for n, c in zip(shape, chunk, strict=True))):
        key = sep.join(map(str, at))
        if encoding["name"] == "default":
            key = f"c{sep}{key}" if at else "c"
        path = os.path.join(folder, key)
        if not os.path.exists(path):
            continue
        with open(path, "rb") as f:
            block = _zarr_codecs(meta.get("codecs", []), f.read(), dtype).reshape(chunk)
        place = tuple(slice(i * c, min(n, (i + 1) * c)) for i, c, n in zip(at, chunk, shape, strict=True))
        out[place] = block[tuple(slice(0, p.stop - p.start) for p in place)]
    return out


def read_zarr(path: str) -> dict[str, np.ndarray]:
    """Arrays of a store, groups visited in turn and names joined by /; a root array is `data`."""
    out: dict[str, np.ndarray] = {}

    def visit(folder: str, name: str) -> None:
        meta_path = os.path.join(folder, "zarr.json")
        if os.path.exists(meta_path):
            with open(meta_path) as f:
                meta = json.load(f)
            if meta.get("node_type") == "array":
                if np.dtype(meta["data_type"]).kind in "fiub":
                    out[name or "data"] = _zarr_array(folder, meta)
                return
        for sub in sorted(os.listdir(folder)):
            if os.path.isdir(os.path.join(folder, sub)):
                visit(os.path.join(folder, sub), f"{name}/{sub}" if name else sub)

    visit(path, "")
    return out


def _npy_shape(f) -> tuple[int, ...]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)[0]


def shapes(kind: str, path: str) -> dict[str, tuple[int, ...]]:
    """The shapes of a file's arrays, from headers alone."""
    if kind == "npy":
        with open(path, "rb") as f:
            return {"array": _npy_shape(f)}
    if kind == "npz":
        import zipfile

        out = {}
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                with z.open(name) as f:
                    out[name.removesuffix(".npy")] = _npy_shape(f)
        return out
    if kind == "zarr":
        out = {}
        for folder, _, files in sorted(os.walk(path)):
            if "zarr.json" in files:
                with open(os.path.join(folder, "zarr.json")) as f:
                    meta = json.load(f)
                if meta.get("node_type") == "array" and np.dtype(meta["data_type"]).kind in "fiub":
                    out[os.path.relpath(folder, path).replace(os.sep, "/") if folder != path else "data"] = tuple(meta["shape"])
        return out
    return {k: v.shape for k, v in read_hdf5(path).items()}
