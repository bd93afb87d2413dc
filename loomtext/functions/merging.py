"""Growing transcripts: overlap, revision and merge of text snapshots (STR4-STR8).

Plain functions for the turn assembler, and Arrow functions over columns.
"""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.compute as pc

from loomtext.functions.arrow import arrow_function

LONGEST_OVERLAP = 256


def common_prefix(a: str, b: str) -> int:
    """STR4."""
    return len(os.path.commonprefix((a, b)))


def common_suffix(a: str, b: str, prefix: int) -> int:
    """STR5: shared characters at the end, not counting those of the shared prefix."""
    room = min(len(a), len(b)) - prefix
    if room <= 0:
        return 0
    return len(os.path.commonprefix((a[len(a) - room :][::-1], b[len(b) - room :][::-1])))


def overlap(a: str, b: str) -> int:
    """STR6: longest end of ``a`` (2 to 256 characters) that begins ``b``."""
    for k in range(min(len(a), len(b), LONGEST_OVERLAP), 1, -1):
        if a.endswith(b[:k]):
            return k
    return 0


def is_revision(a: str, b: str) -> bool:
    """STR7: both are long enough and share most of their edges."""
    shorter = min(len(a), len(b))
    if shorter < 5:
        return False
    head = common_prefix(a, b)
    edges = head + common_suffix(a, b, head)
    return edges >= 3 and edges >= 0.6 * shorter


def merge(current: str, incoming: str) -> str:
    """STR8: one text from what was known and a new snapshot."""
    current, incoming = current.strip(), incoming.strip()
    if not current or not incoming:
        return current or incoming
    if current.endswith(incoming):
        return current
    if incoming.startswith(current) or is_revision(current, incoming):
        return incoming
    k = overlap(current, incoming)
    return current + incoming[k:] if k else f"{current} {incoming}"


def _pairwise(function, kind):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    return run


@arrow_function(pa.int32())
def common_prefix_column(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(common_prefix, pa.int32())(a, b)


@arrow_function(pa.int32())
def common_suffix_column(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(lambda x, y: common_suffix(x, y, common_prefix(x, y)), pa.int32())(a, b)


@arrow_function(pa.int32())
def overlap_column(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(overlap, pa.int32())(a, b)


@arrow_function(pa.bool_())
def revision_column(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(is_revision, pa.bool_())(a, b)


@arrow_function(pa.string())
def merge_column(a: pa.Array, b: pa.Array) -> pa.Array:
    a, b = pc.fill_null(a, ""), pc.fill_null(b, "")
    return _pairwise(merge, pa.string())(a, b)
