"""Best-fit packing of documents into training sequences under conflicts.

A bin takes no two pieces of one source and no two of one duplicate cluster.
Bins are ordered by what is left of their capacity and carry a bitmap of
sources and one of duplicate clusters.  For each piece, largest first, the
successor search starts at the smallest residual that holds it and continues
over larger ones until a bin whose bitmaps have neither bit is found: the
tightest compatible bin.  Without one a new bin is opened.

Documents are dealt by a hash of their id into shards of about ``SHARD_DOCS``
and each shard is packed by itself, so work and memory of a task don't follow
the input, and copies or a hot source are spread over all shards.  A document
longer than a bin is cut into whole bins and a rest, which is packed.

Defined results.  Sizes below 1, null and empty texts count as 1 token.  A null
source or cluster conflicts with nothing.  Ties are broken by id, then source.
Rows that share an id are packed each for itself.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrow import trim
from ._encoding import encoder, groups
from ._shared import Workspace, few
from .neardup import digested, near_duplicates, text_mark

CAPACITY = 2048
SHARD_DOCS = 8192
REMEMBERED = 1_200_000  #: words the encoder remembers beside what other operators of a pipeline hold


class BestFit:
    """Bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.occupied = 0  #: bit r: some open bin has r left
        self.by_left: dict[int, dict[tuple[int, int], list[int]]] = {}  #: left -> bitmaps -> bins
        self.left: list[int] = []

    def _put(self, b: int, left: int, marks: tuple[int, int]) -> None:
        self.left[b] = left
        if left:
            self.by_left.setdefault(left, {}).setdefault(marks, []).append(b)
            self.occupied |= 1 << left

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece with the given bits (0: no conflict)."""
        left = size - 1
        while rest := self.occupied >> (left + 1):
            left += (rest & -rest).bit_length()
            groups = self.by_left[left]
            for marks in groups:
                if not (marks[0] & source or marks[1] & cluster):
                    bins = groups[marks]
                    b = bins.pop()
                    if not bins:
                        del groups[marks]
                        if not groups:
                            del self.by_left[left]
                            self.occupied ^= 1 << left
                    self._put(b, left - size, (marks[0] | source, marks[1] | cluster))
                    return b, self.capacity - left
        self.left.append(0)
        b = len(self.left) - 1
        self._put(b, self.capacity - size, (source, cluster))
        return b, 0


def _shard(capacity: int):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        part = part.sort_by([("size", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        docs, sources, clusters, sizes = (part.column(n).to_pylist() for n in ("doc_id", "source", "cluster", "size"))
        source_bit = {s: 1 << i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
        # a cluster met once in the shard cannot conflict and needs no bit
        seen: dict[int, int] = {}
        for c in clusters:
            if c is not None:
                seen[c] = seen.get(c, 0) + 1
        cluster_bit = {c: 1 << i for i, c in enumerate(sorted(c for c, n in seen.items() if n > 1))}
        fit = BestFit(capacity)
        out = {k: [] for k in ("doc_id", "source", "piece", "piece_start", "n_tokens", "bin", "bin_start")}

        def tell(doc, source, piece, start, size, b, at):
            for k, v in zip(out, (doc, source, piece, start, size, b, at)):
                out[k].append(v)

        # whole bins of long documents first, then the pieces by size
        rest = []
        for doc, source, cluster, size in zip(docs, sources, clusters, sizes):
            whole, left = divmod(size, capacity)
            for k in range(whole):
                fit.left.append(0)
                tell(doc, source, k, k * capacity, capacity, len(fit.left) - 1, 0)
            if left:
                rest.append((left, doc, source, cluster, whole))
        rest.sort(key=lambda x: -x[0])
        for size, doc, source, cluster, whole in rest:
            b, at = fit.place(size, source_bit.get(source, 0), cluster_bit.get(cluster, 0))
            tell(doc, source, whole, whole * capacity, size, b, at)
        bins = np.array(out.pop("bin"), np.int64) + (shard << 32)
        kinds = {"doc_id": pa.int64(), "source": pa.string()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()} | {"bin_id": pa.array(bins)})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack rows of (doc_id, source, cluster long, size): one row per piece with its bin and place."""
    items = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"), F.greatest(F.coalesce(F.col("size"), F.lit(1)), F.lit(1)).cast("long").alias("size"))
    shards = max(1, -(-items.count() // shard_docs))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "size"), F.lit(shards)) if shards > 1 else F.lit(0)
    schema = "doc_id long, source string, piece long, piece_start long, n_tokens long, bin_start long, bin_id long"
    return items.withColumn("shard", shard.cast("long")).groupBy("shard").applyInArrow(_shard(capacity), schema)


def sized(docs: DataFrame) -> DataFrame:
    """Documents as items by an estimate: a token for every four bytes of UTF-8, not real ids; equal texts are a cluster."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "source", F.xxhash64(text).alias("cluster"), F.ceil(F.octet_length(text) / 4).alias("size"))


def _measured(docs: DataFrame, tokenizer: str, digest: bool) -> DataFrame:
    """Items of real ids; with ``digest`` what operator 1 asks of every text too, so that the texts are read once for both."""
    names = ["doc_id", "source", "cluster", *["t"][:digest]]

    def run(batches):
        coder = encoder(tokenizer, REMEMBERED)
        for batch in batches:
            sizes = [n + 1 for _, texts in groups(batch) for n in coder.sizes(texts).tolist()]
            columns = [batch.column(n) for n in names] + [pa.array(sizes, pa.int64())]
            digests = digested(batch.column("text")) if digest else []
            yield pa.RecordBatch.from_arrays(columns + digests, [*names, "size", *["c1", "c2", "words"][: len(digests)]])
        trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("cluster"), *[text_mark(text).alias("t")][:digest], text.alias("text"))
    return texts.mapInArrow(run, "doc_id long, source string, cluster long, size long" if not digest else "doc_id long, source string, cluster long, t long, size long, c1 long, c2 long, words long")


def sized_by_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents as items of their real ids over the whole text and the end id; equal texts are a cluster."""
    return _measured(docs, tokenizer, False)


def sized_and_digested(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The items of ``sized_by_ids`` with the digests of operator 1: the texts are read once for both."""
    return _measured(docs, tokenizer, True)


def near_clustered(items: DataFrame, docs: DataFrame, signs: DataFrame | None = None) -> DataFrame:
    """The items with their near-duplicate clusters; rows without an id keep that of their exact text."""
    near = near_duplicates(docs, signs=signs).where("doc_id IS NOT NULL").select("doc_id", "cluster_id")
    return items.join(near, "doc_id", "left").select("doc_id", "source", F.coalesce("cluster_id", "cluster").alias("cluster"), "size")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # written, so that the texts are tokenised once
    space = Workspace(spark, "packing")
    rows = docs.count()
    read = space.save(few(sized_and_digested(docs, public_tokenizers.path("byte_bpe_50k.json")), rows), "sizes")
    signs = read.where("doc_id IS NOT NULL").select("doc_id", "t", "c1", "c2", "words")
    return pack(space.save(few(near_clustered(read, docs, signs), rows), "items"))
