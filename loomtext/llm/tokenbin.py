"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds the ids of consecutive documents as one array of little-endian
unsigned 16-bit integers (32-bit for vocabularies above 65,536), followed by
two monotone Elias-Fano sequences: the ids of the documents, as distances from
the least of them, and the starts of the documents.  A sequence keeps the low
``l`` bits of each value packed side by side and the rest as gaps in a bit
vector, where value ``i`` is found by select(i) - i.  A sample of every
``SAMPLE``-th one's place, in 32 bits, lets select begin close by.  ``n`` values
below ``u`` take about ``n * (2 + log2(u / n))`` bits; there is no table of
64-bit numbers.  Documents are read one by one, each by select.

Layout, all numbers little-endian:
    8 bytes  magic ``LTIDS002``
    11 u64   documents, documents without an id, ids, bytes of an id, least document id (as i64),
             then for document ids and starts: low bits, bytes of high, samples
    ids | low, high, samples (u32) of the document ids | low, high, samples of the starts, each padded to 8 bytes

A task closes its file and begins the next at ``IDS_PER_FILE`` ids, so memory follows
neither the number of documents nor repeated ids, only the longest text.

Defined results.  Null and empty texts have the end id only.  Documents are in
ascending id, rows with a null id first; rows that share an id are in the order
of their text and are documents of their own.  The string of a special token in a
text is that token's id, as the library gives it.  Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._arrow import rows, trim
from ._encoding import encoder, groups
from ._shared import Workspace, few, file_system, write_atomically

MAGIC = b"LTIDS002"
HEAD = struct.Struct("<8s4Qq6Q")
SAMPLE = 256
END_ID = 0
DOCS_PER_FILE = 8_000  #: documents of a task, on average
IDS_PER_FILE = 16_000_000
FILES_PER_BLOCK = 1_024  #: files whose first ids are counted in one task
FILES_PER_READER = 4  #: files that a task reads, one after the other



# Elias-Fano -------------------------------------------------------------------


@dataclass
class EliasFano:
    """Monotone sequence of ``n`` values below ``universe``."""

    n: int
    low_bits: int
    low: np.ndarray  # uint8, packed
    high: np.ndarray  # uint8, packed, little bit order
    samples: np.ndarray  # uint32, bit place of every SAMPLE-th one

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        v = values.astype(np.uint64)
        bits = max(0, (universe // max(1, n)).bit_length() - 1) if n else 0
        if bits:
            low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(low.ravel(), bitorder="little")
        else:
            packed = np.empty(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, bits, packed, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Bit place of the ``i``-th one of the high part."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        skip = place & 7
        while True:
            chunk = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            chunk[:skip] = 0
            found = np.flatnonzero(chunk)
            if left < len(found):
                return 8 * byte + int(found[left])
            left -= len(found)
            byte, skip = byte + 64, 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            word = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
            low = (word >> (first & 7)) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low


# the file format ----------------------------------------------------------------


def _padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def file_chunks(doc_ids: list[int | None], bodies: list[np.ndarray], sizes: np.ndarray):
    """The bytes of a file, piece by piece; documents in ascending id, those without one first."""
    n = int(sizes.sum())
    width = bodies[0].dtype.itemsize if bodies else 2
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    starts = EliasFano.encode(np.cumsum(sizes) - sizes, n + 1)
    far = named.astype(np.uint64) - np.int64(least).astype(np.uint64)  # modulo 2**64: any two 64-bit ids
    names = EliasFano.encode(far, int(far[-1]) + 1 if len(far) else 1)
    shape = [x for ef in (names, starts) for x in (ef.low_bits, len(ef.high), len(ef.samples))]
    yield HEAD.pack(MAGIC, len(doc_ids), len(doc_ids) - len(named), n, width, least, *shape)
    for body in bodies:
        yield body.tobytes()
    yield bytes(-(n * width) % 8)
    for ef in (names, starts):
        for part in (ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u4").tobytes()):
            yield _padded(part)


class TokenFile:
    """Reader of one file; each document is found by select."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self._in = system.open_input_file(path)
        magic, self.n_docs, self.n_unnamed, self.n_ids, self.width, self._least, *shape = HEAD.unpack(self._in.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        at = HEAD.size + self.n_ids * self.width
        at += -(self.n_ids * self.width) % 8
        held = []
        for n, (low_bits, high, samples) in zip((self.n_docs - self.n_unnamed, self.n_docs), (shape[:3], shape[3:])):
            parts = []
            for size in ((n * low_bits + 7) // 8, high, 4 * samples):
                parts.append(self._in.read_at(size, at))
                at += size + -size % 8
            held.append(EliasFano(n, low_bits, np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4")))
        self.names, self.starts = held

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_unnamed else self._least + self.names[i - self.n_unnamed]

    def span(self, i: int) -> tuple[int, int]:
        return self.starts[i], self.starts[i + 1] if i + 1 < self.n_docs else self.n_ids

    def ids(self, i: int) -> np.ndarray:
        return self._between(*self.span(i))

    def _between(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._in.read_at((end - start) * self.width, HEAD.size + start * self.width), f"<u{self.width}")

    def documents(self):
        """(doc_id, start, ids) in order."""
        start = self.starts[0] if self.n_docs else 0
        for i in range(self.n_docs):
            end = self.starts[i + 1] if i + 1 < self.n_docs else self.n_ids
            yield self.doc_id(i), start, self._between(start, end)
            start = end


# writing and reading --------------------------------------------------------------


def _writer(folder: str, tokenizer: str, end_id: int, ids_per_file: int):
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer)
        docs, bodies, sizes, held = [], [], [], 0

        def close():
            nonlocal docs, bodies, sizes, held, made
            uri = f"{folder}/ids-{part:06d}-{made:04d}.bin"
            written = write_atomically(uri, file_chunks(docs, bodies, np.concatenate(sizes)))
            row = {"part": pa.array([part], pa.int32()), "nth": pa.array([made], pa.int32()), "uri": [uri], "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "bytes": pa.array([written], pa.int64())}
            docs, bodies, sizes, held, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, texts in groups(batch):
                ids, n = coder.encode(texts)
                bodies.append(np.insert(ids, np.cumsum(n), end_id))
                sizes.append(n + 1)
                docs += names[first : first + len(texts)]
                held += len(bodies[-1])
                if held >= ids_per_file:
                    yield close()
        if docs:
            yield close()
        trim()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, docs_per_file: int = DOCS_PER_FILE, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write the files and their manifest; returns the manifest, a row for each file, ordered by (part, nth)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = max(1, -(-docs.count() // docs_per_file))
    done = docs.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = done.mapInArrow(_writer(folder, tokenizer, end_id, ids_per_file), "part int, nth int, uri string, n_docs long, n_ids long, bytes long")
    few(manifest, tasks).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _reader(batches):
    for batch in batches:
        for uri, first in rows(batch, "uri", "first"):
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for doc, start, ids in TokenFile(uri).documents():
                out["doc_id"].append(doc)
                out["start"].append(first + start)
                out["n_tokens"].append(len(ids))
                out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def first_ids(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the ids of all files before: counted in blocks of files, then over the blocks."""
    block = F.floor(F.col("part") / FILES_PER_BLOCK)
    inside = Window.partitionBy("block").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("block", block).withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    # one row for every FILES_PER_BLOCK tasks meets in one task
    blocks = manifest.groupBy(block.alias("block")).agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return files.join(blocks.select("block", "before"), "block").select("uri", (F.col("before") + F.col("inside")).alias("first"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = first_ids(manifest).repartition(max(1, -(-manifest.count() // FILES_PER_READER)))
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    space = Workspace(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, space.path("ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, space.path("ids"))
