"""Hashes and quantised keys (MTH1-MTH5)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

from loomtext.functions.arrow import arrow_function

_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1  # fixed values: FNV-1a, 64 bits


def fnv1a(data: bytes) -> str:
    h = _OFFSET
    for byte in data:
        h = ((h ^ byte) * _PRIME) & _MASK
    return format(h, "x")


@arrow_function(pa.string())
def fnv1a_hex(c: pa.Array) -> pa.Array:
    """MTH1: FNV-1a of the UTF-8 bytes, lower-case hex without padding."""
    return pa.array([None if x is None else fnv1a(x.encode("utf-8", "surrogatepass")) for x in c.to_pylist()], pa.string())


def sha256_prefix(c: Column, size: int = 16) -> Column:
    """MTH2: the first bytes of SHA-256 in hex."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 2 * size)


def crc32(c: Column) -> Column:
    """MTH3."""
    return F.crc32(c.cast("binary"))


def geometry_key(x: Column, y: Column, w: Column, h: Column) -> Column:
    """MTH4: hundredths of each, halves away from zero, comma-joined."""
    return F.concat_ws(",", *[F.round(v * 100).cast("long").cast("string") for v in (x, y, w, h)])


def quantized(v: Column, step: float) -> Column:
    """MTH5."""
    return F.round(v / step).cast("long")
