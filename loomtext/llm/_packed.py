"""Numbers packed into binary cells, for what chunks of documents send to parts of a hash range and get back."""

from __future__ import annotations

import numpy as np
import zstandard

CHUNK, MOST = 500_000, 32_000_000


def chunks(words: int) -> int:
    """How many chunks of documents, and parts of the hash range, so many words are dealt to.

    A chunk and a part hold ``CHUNK`` hashes each, or, so that what a chunk sends to a part
    doesn't shrink to single hashes, 8 times the square root of all; ``MOST`` (256 MB) ends that.
    """
    size = min(MOST, max(CHUNK, int(8 * words**0.5)))
    return max(1, -(-words // size))


def edges(parts: int) -> np.ndarray:
    """Where the parts of the hash range begin, but for the first."""
    return np.array([((1 << 64) * i) // parts for i in range(1, parts)], np.uint64)


def _press(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all of them: upper bytes that repeat compress."""
    return _press(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).ravel())


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_expand(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending hashes as gaps."""
    gaps = h.copy()
    gaps[1:] -= h[:-1]
    return pack(gaps)


def unpack_sorted(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(n) or int(n.max()) <= np.iinfo(k).max)
    return kind[1:].encode() + _press(n.astype(kind).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(_expand(data[2:]), "<" + data[:2].decode())
