"""Well-known binary, both byte orders, with Z and M: bytes to (kind, parts of (x, y, z, m)) and back, and columns of these in Arrow batches."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import GEOMETRY, points
from plumbline.session import share_code

_KINDS = {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon"}


def read(data: bytes) -> tuple[str, list[list[tuple]]]:
    shape, end = _read(data, 0)
    if end != len(data):
        raise ValueError("bytes after the geometry")
    return shape


def _read(data: bytes, at: int) -> tuple[tuple[str, list[list[tuple]]], int]:
    order = "<" if data[at] else ">"
    code = struct.unpack_from(f"{order}I", data, at + 1)[0]
    at += 5
    has_z, has_m = bool(code & 0x80000000) or code // 1000 % 10 in (1, 3), bool(code & 0x40000000) or code // 1000 % 10 in (2, 3)
    kind, size = (code & 0xFFFF) % 1000, 2 + has_z + has_m

    def one(at: int) -> tuple[tuple, int]:
        v = struct.unpack_from(f"{order}{size}d", data, at)
        return (v[0], v[1], v[2] if has_z else None, v[-1] if has_m else None), at + 8 * size

    def path(at: int) -> tuple[list[tuple], int]:
        n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
        out = []
        for _ in range(n):
            p, at = one(at)
            out.append(p)
        return out, at

    if kind == 1:
        p, at = one(at)
        return ("point", [] if math.isnan(p[0]) else [[p]]), at
    if kind == 2:
        points, at = path(at)
        return ("line", [points] if points else []), at
    if kind not in _KINDS:
        raise ValueError(f"geometry type {kind}")
    n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
    parts: list[list[tuple]] = []
    for _ in range(n):
        if kind == 3:
            ring, at = path(at)
            parts.append(ring)
        else:
            (_, inner), at = _read(data, at)
            parts += inner
    return (_KINDS[kind], parts), at


def write(kind: str, parts: list[list[tuple]], order: str = "<") -> bytes:
    flat = [p for part in parts for p in part]
    has_z, has_m = any(len(p) > 2 and p[2] is not None for p in flat), any(len(p) > 3 and p[3] is not None for p in flat)
    shift = 1000 * has_z + 2000 * has_m
    head = lambda code: struct.pack(f"{order}BI", order == "<", code + shift)
    nan = float("nan")

    def one(p: tuple) -> bytes:
        extra = ([nan if len(p) < 3 or p[2] is None else p[2]] if has_z else []) + ([nan if len(p) < 4 or p[3] is None else p[3]] if has_m else [])
        return struct.pack(f"{order}{2 + len(extra)}d", p[0], p[1], *extra)

    path = lambda part: struct.pack(f"{order}I", len(part)) + b"".join(map(one, part))
    count = struct.pack(f"{order}I", len(parts))
    if kind == "point":
        return head(1) + one(parts[0][0]) if len(parts) == 1 else head(4) + count + b"".join(head(1) + one(p[0]) for p in parts)
    if kind == "line":
        return head(2) + path(parts[0]) if len(parts) == 1 else head(5) + count + b"".join(head(2) + path(p) for p in parts)
    return head(3) + count + b"".join(map(path, parts))


def encoded(spark: SparkSession, geom: Column, big: Column | bool = False) -> Column:
    """Geometries as well-known binary; null and empty ones are null. big: big-endian, a column or for all rows."""
    share_code(spark)

    @F.pandas_udf("binary")
    def run(rows: pd.DataFrame, order: pd.Series) -> pd.Series:
        out = []
        for kind, sizes, x, y, z, m, large in zip(rows["kind"], rows["sizes"], rows["x"], rows["y"], rows["z"], rows["m"], order, strict=True):
            if kind is None or x is None or not len(x):
                out.append(None)
                continue
            known = lambda v: None if v is None or math.isnan(v) else v
            flat, at, parts = [(a, b, known(c), known(d)) for a, b, c, d in zip(x, y, z, m, strict=True)], 0, []
            for n in sizes:
                parts.append(flat[at : at + n])
                at += n
            out.append(write(kind, parts, ">" if large else "<"))
        return pd.Series(out, dtype="object")

    axis = lambda k: F.transform(points(geom), lambda p: p[k])
    flat = F.struct(geom["kind"].alias("kind"), F.transform(geom["parts"], F.size).alias("sizes"), *[axis(k).alias(k) for k in "xyzm"])
    return run(flat, big if isinstance(big, Column) else F.lit(big))


def decoded(spark: SparkSession, data: Column) -> Column:
    """Well-known binary as geometries; null stays null."""
    share_code(spark)

    @F.pandas_udf(GEOMETRY)
    def run(rows: pd.Series) -> pd.DataFrame:
        point = lambda p: dict(zip("xyzm", p, strict=True), id=None)
        found = [None if b is None else read(bytes(b)) for b in rows]
        parts = [f and [[point(p) for p in part] for part in f[1]] for f in found]
        return pd.DataFrame({"kind": pd.Series([f and f[0] for f in found], dtype="object"), "parts": pd.Series(parts, dtype="object")})

    return F.when(data.isNotNull(), run(data))
