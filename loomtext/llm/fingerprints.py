"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

Every five-word shingle is hashed once; the top bits choose one of ``BINS`` bins
and the rest compete for the bin's minimum.  An empty bin probes other bins in
an order given by a fixed 2-universal sequence of its own and takes the first
full one (optimal densification).  The lowest ``BITS`` bits of each bin are
packed; the agreement of two fingerprints is corrected for chance matches.

Defined results.  Null and blank texts have no shingle: their fingerprint is '',
alike (1.0) to each other and unlike (0.0) any other.  Equal texts have equal
fingerprints.  Rows that share an id follow each other in the order of their
text.  Rows with a null id come first.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrow import rows
from ._hashing import SHINGLE, WordHasher

BINS = 512
BITS = 4
_BIN_BITS = BINS.bit_length() - 1
DOCS_PER_SLICE = 4000  #: documents between two neighbouring boundaries of the id order
SLICES_PER_ROOT = 4  #: and no more slices than so many times the square root of the documents, whose boundaries are one array; a slice is streamed, never held whole


@lru_cache(1)
def _hasher() -> WordHasher:
    return WordHasher(21)


@lru_cache(64)
def _probes(block: int, size: int = 256) -> np.ndarray:
    """Bins that each bin tries in attempts ``block * size`` and on."""
    rng = np.random.Generator(np.random.PCG64([22, block]))
    return rng.integers(0, BINS, (size, BINS), dtype=np.int16)


def _densify(low: np.ndarray, full: np.ndarray) -> np.ndarray:
    empty = np.flatnonzero(~full)
    block = 0
    while len(empty):
        if block == 64:  # after 16,384 tries: the next full bin to the right
            there = np.flatnonzero(full)
            low[empty] = low[there[np.searchsorted(there, empty) % len(there)]]
            break
        tries = _probes(block)[:, empty]
        hit = full[tries]
        row = hit.argmax(0)
        got = hit[row, np.arange(len(empty))]
        low[empty[got]] = low[tries[row[got], np.flatnonzero(got)]]
        empty = empty[~got]
        block += 1
    return low


def fingerprint(text: str | None, shingle: int = SHINGLE) -> str:
    """Base64 of ``BINS`` values of ``BITS`` bits; '' without words."""
    hasher = _hasher()
    h = np.sort(hasher.shingles(hasher.words(text), shingle))
    if not len(h):
        return ""
    bins = (h >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    low = np.zeros(BINS, np.uint8)
    full = np.zeros(BINS, bool)
    low[bins[first]] = (h[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    full[bins[first]] = True
    low = _densify(low, full)
    return base64.b64encode((low[0::2] << 4 | low[1::2]).tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """Unbiased estimate of the Jaccard similarity of two texts' shingles, from 0 to 1."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(base64.b64decode(a), np.uint8) ^ np.frombuffer(base64.b64decode(b), np.uint8)
    agree = (np.count_nonzero(x >> 4 == 0) + np.count_nonzero(x & 15 == 0)) / BINS
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (agree - chance) / (1 - chance))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.string())], ["doc_id", "fingerprint"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _beside_next(batches):
    """Rows of whole slices in order, with ``follows`` on a copied first row -> both fingerprints."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # slice, id, text, fingerprint of the row before

    def result(doc, text, mark, other, other_mark):
        new = edited(text, other)
        changed = mark if new == text else fingerprint(new)
        return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, other_mark)

    for batch in batches:
        out = []
        for piece, doc, text, follows in rows(batch, "slice", "doc_id", "text", "follows"):
            text = text or ""
            if held and held[0] != piece:
                held = None
            if held is None and follows:
                continue
            mark = fingerprint(text)
            if held:
                out.append(result(*held[1:], text, mark))
            held = None if follows else (piece, doc, text, mark)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)


def compare_with_next(docs: DataFrame, docs_per_slice: int = DOCS_PER_SLICE) -> DataFrame:
    """Each document beside its edited text and the next document in ascending id; the first follows the last.

    The id order is cut into slices by boundaries of the id alone; the first
    row of a slice is sent to the slice before it as well, so each text is
    shuffled once and every slice is worked on by itself.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = docs.count()
    slices = max(1, min(-(-count // docs_per_slice), int(SLICES_PER_ROOT * count**0.5)))
    cuts = sorted({int(x) for x in docs.approxQuantile("key", [i / slices for i in range(1, slices)], 0.25 / slices)}) if slices > 1 else []
    if cuts:
        one = docs.sparkSession.createDataFrame([(cuts,)], "cuts array<long>")  # a single row of 8 bytes for each slice
        docs = docs.join(F.broadcast(one), F.lit(True)).withColumn("slice", _search(F.col("key"), F.col("cuts"), len(cuts))).drop("cuts")
    else:
        docs = docs.withColumn("slice", F.lit(0))
    heads = docs.groupBy("slice").agg(F.min("key").alias("key")).orderBy("slice").collect()  # a row for each slice
    before = {heads[i].key: heads[i - 1].slice for i in range(len(heads))}
    if not heads:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(x) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[F.lit(0.0).alias(x) for x in ("near_edited", "near_next")]).where("false")
    spark = docs.sparkSession
    head = F.broadcast(spark.createDataFrame(list(before.items()), "key long, goes int"))
    copies = docs.join(head, "key").select("doc_id", "text", "key", F.col("goes").alias("slice"), F.lit(True).alias("follows"))
    every = docs.select("doc_id", "text", "key", "slice", F.lit(False).alias("follows")).unionByName(copies)
    dealt = every.repartitionByRange(len(heads), "slice").sortWithinPartitions("slice", "follows", "key", "text")
    return dealt.select("slice", "doc_id", "text", "follows").mapInArrow(
        _beside_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _search(key, cuts, n: int):
    """How many of the ``n`` sorted boundaries are at or below the key, by halving."""
    at = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def half(x, _):
        mid = F.floor((x["low"] + x["high"]) / 2).cast("int")
        below = (x["low"] < x["high"]) & (F.get(cuts, mid) <= key)
        return F.struct(F.when(below, mid + 1).otherwise(x["low"]).alias("low"), F.when(below, x["high"]).otherwise(F.least(mid, x["high"])).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), at, half, lambda x: x["low"])


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
