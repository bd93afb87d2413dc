"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

1. Texts of equal word sequences are one class, represented by its least id.
2. Document frequencies of all five-word shingles are counted exactly.  The
   representatives' texts are dealt to chunks once; a chunk sends each of its
   distinct shingle hashes once, sorted and packed, to the part of the hash
   range that counts it, and gets back the counts alone, in the same order.
3. Every representative is a weighted set: shingle -> tf * ln(1 + documents / df).
   ``SAMPLES`` improved consistent weighted samples are drawn from it; two
   documents agree in one with the probability of their weighted Jaccard
   similarity.  ``BAND_ROWS`` samples make a band.  A representative whose shingles
   that other classes hold too weigh less than the threshold's share of it reaches
   the threshold with no other, whatever that is, and is not sampled.
4. Representatives that share a band are linked where their exact weighted
   Jaccard similarity, with the same exact frequencies, reaches the threshold.
   Each is first compared with three pivots of its bucket.  Buckets that the
   links found leave in several components are then compared exhaustively
   across components, in blocks of ``BLOCK`` members, each block pair a task of
   its own; so no link of a bucket is lost and no task holds a whole bucket.
5. A cluster is a connected component, named by its least id.

A pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**12
= 0.998, one at 0.9 with 0.99999, at any size of the input.

Defined results.  Null and blank texts have no shingle and are copies of each
other.  Texts of fewer than five words have one shingle.  Rows that share an id
are one document and belong to one cluster.  Rows with a null id are not
compared or counted and have a null cluster.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrow import lists, rows, trim
from ._components import connected_components
from ._hashing import WordHasher, in_order, mix
from ._packed import chunks, edges, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from ._shared import Workspace, few

SAMPLES, BAND_ROWS = 48, 4
THRESHOLD = 0.8
BLOCK = 256
PAUSE = 2.0  #: seconds between two times that a worker gives memory back
_U = np.uint64


@lru_cache(1)
def _hasher() -> WordHasher:
    return WordHasher(31)


@lru_cache(1)
def _sampler() -> WeightedSampler:
    return WeightedSampler()


def _shingle_counts(text: str | None):
    hasher = _hasher()
    return np.unique(hasher.shingles(hasher.words(text)), return_counts=True)


# exact copies -------------------------------------------------------------------


_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))


DIGEST = "doc_id long, t long, c1 long, c2 long, words long"


def named_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t) of rows with an id; null is empty, and t tells the texts of rows that share an id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.where("doc_id IS NOT NULL").withColumn("t", text_mark("text"))


def text_mark(text):
    return F.xxhash64(text, F.hash(text))


def digested(texts: pa.Array) -> list[pa.Array]:
    """128 bits of the words in their order, in two columns, and how many words there are."""
    c1, c2, size = [], [], []
    for text in texts.cast(pa.string()).cast(pa.binary()):
        words = (text.as_py() or b"").translate(_BLANKS)
        if b"  " in words or words[:1] == b" " or words[-1:] == b" ":  # else one blank stands between words already
            words = b" ".join(words.split())
        d = hashlib.blake2b(words, digest_size=16).digest()
        c1.append(int.from_bytes(d[:8], "little", signed=True))
        c2.append(int.from_bytes(d[8:], "little", signed=True))
        size.append(len(words) - len(words.translate(None, b" ")) + 1 if words else 0)
    return [pa.array(x, pa.int64()) for x in (c1, c2, size)]


def _digests(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *digested(batch.column("text"))], ["doc_id", "t", "c1", "c2", "words"])


# document frequencies -------------------------------------------------------------


class _Chunk:
    """The representatives' shingles of one chunk: a row of ``owner``, ``place`` and ``tf`` for each of a text, in order of its hash."""

    def __init__(self, texts: pa.Table, classes: pa.Table):
        copies = {(d, t): n for d, t, n in zip(*(classes.column(c).to_pylist() for c in ("doc_id", "t", "n"))) if n is not None}
        self.ids, self.marks, self.rows, held = [], [], [], []
        for row, (doc, t) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("t").to_pylist())):
            n = copies.pop((doc, t), None)
            if n is not None:  # a representative; a row equal to one seen is not looked at again
                self.ids.append(doc)
                self.marks.append(t)
                self.rows.append(row)
                held.append(n)
        self.copies = np.array(held, np.int64)
        found = texts.column("text")
        h, owner = _hasher().shingles_of(found if len(held) == len(found) else found.take(pa.array(self.rows, pa.int64())))
        order, h = in_order(h)
        owner = owner.take(order)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = new.copy()
        first[1:] |= owner[1:] != owner[:-1]
        at = np.flatnonzero(first)
        self.distinct, self.place = h[new], np.cumsum(new)[at] - 1
        self.owner, self.tf = owner.take(at), np.diff(at, append=len(h))

    def counts(self) -> np.ndarray:
        """Rows of the chunk's classes that hold each distinct shingle."""
        return np.bincount(self.place, self.copies.take(self.owner), len(self.distinct)).astype(np.int64) if len(self.place) else np.empty(0, np.int64)


def _send(parts: int):
    """A chunk -> for each part of the hash range its distinct shingles and how many rows hold them."""
    begins = edges(parts)

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, classes: pa.Table) -> pa.Table:
        trim(PAUSE)
        chunk = _Chunk(texts, classes)
        cuts = [0, *np.searchsorted(chunk.distinct, begins).tolist(), len(chunk.distinct)]
        n = chunk.counts()
        held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        out = {
            "chunk": pa.array([key[0].as_py()] * len(held), pa.int64()),
            "part": pa.array(held, pa.int64()),
            "hashes": pa.array([pack_sorted(chunk.distinct[cuts[p] : cuts[p + 1]]) for p in held], pa.binary()),
            "n": pa.array([pack_counts(n[cuts[p] : cuts[p + 1]]) for p in held], pa.binary()),
        }
        return pa.table(out)

    return run


def _count(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """What all chunks sent to a part -> to each chunk the frequencies of what it sent."""
    chunk, hashes, counts = (part.column(c).to_pylist() for c in ("chunk", "hashes", "n"))
    sent = [unpack_sorted(x) for x in hashes]
    h = np.concatenate(sent)
    with np.errstate(over="ignore"):
        h *= _U(0x9E3779B97F4A7C15)  # a part's hashes begin alike; the product brings their lower bits up
    order, h = in_order(h)
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), h[1:] != h[:-1])))
    total = np.add.reduceat(np.concatenate([unpack_counts(x) for x in counts]).astype(np.int64).take(order), first)
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(total, np.diff(first, append=len(h)))
    df = np.split(df, np.cumsum([len(h) for h in sent])[:-1])
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array([key[0].as_py()] * len(chunk), pa.int64()), "df": pa.array([pack_counts(x) for x in df], pa.binary())})


# weighted sampling ------------------------------------------------------------------


class WeightedSampler:
    """Improved consistent weighted sampling; gamma variates are looked up by hash bits."""

    def __init__(self, samples: int = SAMPLES, seed: int = 32):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.seeds = rng.integers(1, 1 << 63, samples, dtype=np.uint64)[:, None] * _U(2) + _U(1)
        n = 1 << 16
        gamma = np.sort(rng.gamma(2.0, 1.0, n * 16)).reshape(n, 16).mean(1)  # quantiles of Gamma(2, 1)
        self.r = gamma.astype(np.float32)
        self.inverse = (1.0 / gamma).astype(np.float32)
        self.ln_c = np.log(gamma).astype(np.float32)

    def _part(self, h: np.ndarray, ln_w: np.ndarray):
        with np.errstate(over="ignore"):
            key = h[None, :] * self.seeds
            key ^= key >> _U(32)
            key *= _U(0x9E3779B97F4A7C15)
            key ^= key >> _U(29)
        lanes = key.view(np.uint16).reshape(*key.shape, 4)
        first = lanes[..., 0].astype(np.intp)
        r = self.r.take(first)
        beta = lanes[..., 2] * np.float32(2.0**-16)
        t = self.inverse.take(first)
        t *= ln_w
        t += beta
        np.floor(t, out=t)
        # ln a = ln c - r * (t - beta + 1)
        beta -= t
        beta -= np.float32(1.0)
        beta *= r
        beta += self.ln_c.take(lanes[..., 1].astype(np.intp))
        k = beta.argmin(1)
        at = np.arange(len(k))
        return beta[at, k], h[k], t[at, k]

    def sample(self, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One hash of (element, level) for each sample; memory doesn't follow the size of the set."""
        ln_w = np.log(weights).astype(np.float32)
        best = None
        for i in range(0, len(h), 2048):
            part = self._part(h[i : i + 2048], ln_w[i : i + 2048])
            best = part if best is None else tuple(np.where(part[0] < best[0], p, b) for p, b in zip(part, best))
        _, element, level = best
        with np.errstate(over="ignore"):
            return mix(element + level.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15))


def bands(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = samples.reshape(-1, BAND_ROWS)
        out = np.arange(1, len(parts) + 1).astype(np.uint64)
        for j in range(BAND_ROWS):
            out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, j])
        return out


def _weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.log1p(docs / df.astype(np.float64))


def _may_link(weight: np.ndarray, elsewhere: np.ndarray, owner: np.ndarray, owners: int, threshold: float) -> np.ndarray:
    """Whether an owner's elements that other classes hold too weigh enough for a similarity of the threshold; what is shared is no more than they."""
    whole = np.bincount(owner, weight, owners)
    return (whole > 0) & (np.bincount(owner, weight * elsewhere, owners) >= threshold * (1 - 1e-6) * whole)


def _sign(docs: int, threshold: float):
    """A chunk and its frequencies -> bands, frequencies and text of every representative that may have a link."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, other: pa.Table) -> pa.Table:
        trim(PAUSE)
        chunk = _Chunk(texts, other)
        back = sorted((p, d) for p, d in zip(other.column("part").to_pylist(), other.column("df").to_pylist()) if p is not None)
        df = np.concatenate([unpack_counts(d) for _, d in back]) if back else np.empty(0, np.int64)
        if len(df) != len(chunk.distinct):
            raise ValueError("a chunk's frequencies are not those of its shingles")
        own, w = df[chunk.place], chunk.tf * _weights(docs, df)[chunk.place]
        may = _may_link(w, own > chunk.copies.take(chunk.owner), chunk.owner, len(chunk.ids), threshold)
        at = np.flatnonzero(may.take(chunk.owner))
        at = at.take(np.argsort(chunk.owner.take(at), kind="stable"))
        wanted = np.flatnonzero(may)
        ends = np.searchsorted(chunk.owner.take(at), wanted, "right").tolist()
        ids, marks, places, found, packed = [], [], [], [], []
        for i, begin, end in zip(wanted.tolist(), [0, *ends], ends):
            mine = at[begin:end]
            ids.append(chunk.ids[i])
            marks.append(chunk.marks[i])
            places.append(chunk.rows[i])
            found.append(bands(_sampler().sample(chunk.distinct.take(chunk.place.take(mine)), w.take(mine))))
            packed.append(pack_counts(own.take(mine)))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "t": pa.array(marks, pa.int64()), "bands": lists(found), "df": pa.array(packed, pa.binary()), "text": texts.column("text").take(pa.array(places, pa.int64()))})

    return run


# comparison -------------------------------------------------------------------------


class _Weighted:
    """A document's (shingle, occurrence) elements, each of its shingle's weight."""

    def __init__(self, docs: int, text: str | None, df: bytes):
        self.h, self.tf = _shingle_counts(text)
        self.w = _weights(docs, unpack_counts(df))
        self.total = float((self.w * self.tf).sum())

    def similarity(self, other: _Weighted) -> float:
        _, i, j = np.intersect1d(self.h, other.h, assume_unique=True, return_indices=True)
        shared = float((self.w[i] * np.minimum(self.tf[i], other.tf[j])).sum())
        either = self.total + other.total - shared
        return shared / either if either else 1.0


def _verify(docs: int, threshold: float):
    def run(batches):
        for batch in batches:
            seen: dict[tuple[int, str | None], _Weighted] = {}
            out_l, out_r, sim = [], [], []
            for left, right, a, b, a_df, b_df in rows(batch, "l", "r", "l_text", "r_text", "l_df", "r_df"):
                one, two = (seen.get((doc, text)) or _Weighted(docs, text, df) for doc, text, df in ((left, a, a_df), (right, b, b_df)))
                if len(seen) > 500:
                    seen.clear()
                seen[left, a], seen[right, b] = one, two
                s = one.similarity(two)
                if s >= threshold:
                    out_l.append(left)
                    out_r.append(right)
                    sim.append(s)
            yield pa.RecordBatch.from_pydict({"l": pa.array(out_l, pa.int64()), "r": pa.array(out_r, pa.int64()), "similarity": pa.array(sim, pa.float64())})

    return run


def _across(docs: int, threshold: float):
    """One block pair of one bucket -> a spanning set of the links between different components."""

    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        ids, roots, own = (block.column(n).to_numpy() for n in ("doc_id", "root", "own"))
        order = np.argsort(ids, kind="stable")
        ids, roots, own = ids[order], roots[order], own[order]
        texts = block.column("text").take(pa.array(order))
        frequencies = block.column("df").take(pa.array(order))
        sets = [_Weighted(docs, t.as_py(), f.as_py()) for t, f in zip(texts, frequencies)]
        links_l, links_r = [], []
        if len(ids) > 1:
            parent = {r: r for r in set(roots.tolist())}

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            flat = np.concatenate([s.h for s in sets])
            owner = np.repeat(np.arange(len(sets)), [len(s.h) for s in sets])
            weight = np.concatenate([s.w for s in sets])
            tf = np.concatenate([s.tf for s in sets])
            totals = np.array([s.total for s in sets])
            # only elements that several members hold can be shared
            values, column, holders = np.unique(flat, return_inverse=True, return_counts=True)
            common = holders[column] > 1
            values, column = np.unique(flat[common], return_inverse=True)
            o, w, f = owner[common], weight[common], tf[common]
            shared = np.zeros((len(sets), len(sets)))
            for first in range(0, len(values), 4096):  # the product in slices of columns
                here = (column >= first) & (column < first + 4096)
                c, oo, ww, ff = column[here] - first, o[here], w[here], f[here]
                level = 1
                while len(c):  # min(tf) as a sum over levels that both reach
                    m = np.zeros((len(sets), min(4096, len(values) - first)), np.float32)
                    m[oo, c] = np.sqrt(ww)
                    shared += m @ m.T
                    level += 1
                    up = ff >= level
                    c, oo, ww, ff = c[up], oo[up], ww[up], ff[up]
            either = totals[:, None] + totals[None, :] - shared
            # single precision finds candidates; the exact measure decides
            near = np.argwhere(np.triu(shared >= (threshold - 1e-3) * either, 1))
            for i, j in near.tolist():
                a, b = find(roots[i]), find(roots[j])
                if a != b and sets[i].similarity(sets[j]) >= threshold:
                    parent[max(a, b)] = min(a, b)
                    links_l.append(int(ids[i]))
                    links_r.append(int(ids[j]))
        return pa.table({"l": pa.array(links_l, pa.int64()), "r": pa.array(links_r, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, signs: DataFrame | None = None) -> DataFrame:
    """doc_id, cluster_id (least id of the cluster), copy_of (least id with equal words), kept.

    ``signs``: the columns of ``DIGEST`` for ``named_texts``, if they are written already.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "neardup")
    named = named_texts(docs)

    size = docs.count()
    if signs is None:
        signs = space.save(few(named.mapInArrow(_digests, DIGEST), size), "signs")
    # aggregates are written before they are joined back: both sides are then plain shuffles, which Spark splits where a key is hot
    least = signs.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.count("*").alias("n"), F.max("words").alias("words"))
    least = space.save(few(least.select("c1", "c2", F.col("rep.doc_id").alias("copy_of"), F.col("rep.t").alias("t"), "n", "words"), size), "least")
    # a row for each text of a document; several only where rows share an id
    members = space.save(few(signs.select("doc_id", "c1", "c2").join(least.select("c1", "c2", "copy_of"), ["c1", "c2"]).select("doc_id", "copy_of").distinct(), size), "members")
    n, shingles, most = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    repeated = most > 1 and signs.groupBy("doc_id", "t").count().where("count > 1").limit(1).count()
    space.drop("signs")

    groups = chunks(shingles)
    chunk = F.pmod(F.xxhash64("doc_id", "t"), F.lit(groups)).alias("chunk")
    if repeated:
        named = named.groupBy("doc_id", "t").agg(F.first("text").alias("text"))  # equal rows become one before they are dealt
    texts = named.select(chunk, "doc_id", "t", "text").groupBy("chunk")
    classes = least.select(F.pmod(F.xxhash64("copy_of", "t"), F.lit(groups)).alias("chunk"), F.col("copy_of").alias("doc_id"), "t", "n")
    sent = texts.cogroup(classes.groupBy("chunk")).applyInArrow(_send(groups), "chunk long, part long, hashes binary, n binary")
    back = sent.groupBy("part").applyInArrow(_count, "chunk long, part long, df binary")
    # the texts' shuffle is the same on both sides of the counting, and made once
    known = classes.unionByName(back, allowMissingColumns=True)
    sampled = space.save(texts.cogroup(known.groupBy("chunk")).applyInArrow(_sign(n, threshold), "doc_id long, t long, bands array<long>, df binary, text string"), "sampled")
    space.release()  # all texts and shingles, which would lie beside the next shuffles
    spread = sampled.select("doc_id", F.explode("bands").alias("band"))
    bucket = spread.groupBy("band").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("d"))).alias("c"), F.count("*").alias("members")
    )
    bucket = bucket.where("a < b").select("band", "members", F.array_distinct(F.array("a", "b", "c.d")).alias("pivots"))
    shared = space.save(spread.join(space.save(few(bucket, size), "pivots"), "band"), "buckets")
    space.drop("least", "pivots")

    pairs = shared.select("doc_id", F.explode("pivots").alias("p")).where("doc_id <> p").select(F.least("doc_id", "p").alias("l"), F.greatest("doc_id", "p").alias("r")).distinct()
    pairs = space.save(few(pairs, size), "pairs")
    wanted = space.save(few(shared.select("doc_id").distinct(), size), "wanted")
    texts = space.save(sampled.join(wanted, "doc_id", "left_semi").select("doc_id", "text", "df"), "texts")
    space.drop("sampled")
    space.release()
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"), F.col("df").alias(f"{c}_df")) for c in ("l", "r"))
    links = pairs.join(left, "l").join(right, "r").select("l", "r", "l_text", "r_text", "l_df", "r_df").mapInArrow(_verify(n, threshold), "l long, r long, similarity double")
    # rows that share an id tie their texts together
    ties = members.where("doc_id <> copy_of").join(members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "doc_id").select(F.col("doc_id").alias("l"), F.col("copy_of").alias("r"))
    links = space.save(few(links.select("l", "r").unionByName(ties), size), "links")
    space.drop("pairs", "wanted")
    roots = connected_components(links, space, "round1")

    # the exact rest: buckets of four and more that still hold several components
    placed = shared.where("members > 3").select("band", "doc_id", "members").join(roots, shared["doc_id"] == roots["node"], "left")
    placed = placed.select("band", "doc_id", "members", F.coalesce("root", "doc_id").alias("root"))
    several = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    rest = placed.join(several, "band").select("band", "doc_id", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rest = rest.select("band", "doc_id", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rest = space.save(rest, "rest")
    found = rest.join(texts, "doc_id").groupBy("band", "i", "j").applyInArrow(_across(n, threshold), "l long, r long")
    found = found.join(roots.select(F.col("node").alias("l"), F.col("root").alias("lr")), "l", "left").join(roots.select(F.col("node").alias("r"), F.col("root").alias("rr")), "r", "left")
    more = space.save(few(found.select(F.coalesce("lr", "l").alias("l"), F.coalesce("rr", "r").alias("r")).distinct(), size), "more")
    space.drop("texts", "rest", "buckets", "links")
    merged = connected_components(more, space, "round2").select(F.col("node").alias("was"), F.col("root").alias("now"))

    up = members.groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"))
    up = up.join(roots, up["copy_of"] == roots["node"], "left").select("doc_id", "copy_of", F.coalesce("root", "copy_of").alias("root"))
    up = up.join(merged, up["root"] == merged["was"], "left").select("doc_id", F.coalesce("now", "root").alias("cluster_id"), "copy_of")
    up = up.withColumn("kept", F.col("doc_id") == F.col("cluster_id"))
    lost = docs.where("CAST(doc_id AS long) IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("long").alias("copy_of"), F.lit(True).alias("kept"))
    return up.unionByName(lost)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
