"""Substring dedup: level-wise doubling of repeated word windows.

A window is a run of consecutive words of one document.  The first level takes
windows of a short length; those whose words occur in more than one document
survive, and only they are extended to windows of twice the length for the next
level, and so on until the length asked for is reached (or, without one, until
no candidate survives).  At the last level a window's words are removed wherever
the same words also start a window in a document with a smaller id.

A repeated window of ``2n`` words holds ``n + 1`` repeated windows of ``n``
words, so a level that is not the last need only look at one of them: the
window of the smallest hash, which equal texts choose alike.  That keeps one
position in ``n / 2`` instead of all, without losing a repeat.

Documents are dealt to chunks once.  At each level a chunk sends every distinct
window hash once, packed, with the least and greatest id of the documents it is
in, to the part of the hash range that compares it, and gets back which
survive; so a passage that a third of all documents share is one entry of a
chunk, however often it occurs.  At the last level windows are told apart by
128 bits of two independent hashes (two of 10**13 windows are taken for each
other with a chance below 10**-12); a chance match at a level before costs work
only.

Defined results.  Null and empty texts have no words and keep ''.  Rows with a
null id are returned unchanged, since no id is smaller than theirs.  Rows that
share an id are one document: their common windows don't remove each other.
Equal rows have equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._hashing import WordHasher
from ._packed import chunks, edges, pack, pack_sorted, unpack, unpack_sorted
from ._shared import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 50


@lru_cache(2)
def _hasher(seed: int) -> WordHasher:
    return WordHasher(seed)


def _smallest(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive hashes."""
    width, m = 1, h
    while 2 * width <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(h) - n + 1], m[n - width : n - width + len(h) - n + 1]) if n > width else m


def _known_by(h: np.ndarray, length: int) -> np.ndarray:
    """For every window of twice the length the hash of the window in it that it is known by."""
    return _smallest(h, length + 1) if len(h) > length else h[:0]


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class _Chunk:
    """Candidate windows of ``length`` words of a chunk's documents.

    ``survived`` has the hashes that survived the level before, ascending (None at the first level).
    """

    def __init__(self, texts: pa.Table, length: int, last: bool, survived: np.ndarray | None):
        self.ids = texts.column("doc_id").to_pylist()
        self.texts = texts.column("text")
        one = _hasher(11)
        first, second, owner, at = [], [], [], []
        for row, (doc, text) in enumerate(zip(self.ids, self.texts)):
            if doc is None:
                continue
            words = one.words(text.as_py())
            if len(words) < length:
                continue
            if survived is None:
                alive = np.ones(len(words) - length + 1, bool)
            else:
                alive = _among(_known_by(one.windows(words, length // 2), length // 2), survived)
            if not alive.any():
                continue
            h = one.windows(words, length)
            if last:
                start = np.flatnonzero(alive)
                two = _hasher(12)
                second.append(two.windows(two.words(text.as_py()), length)[start])
                at.append(start)
                first.append(h[start])
            else:
                chosen = np.unique(_known_by(h, length))
                first.append(chosen if survived is None else chosen[np.isin(chosen, h[alive])])
            owner.append(np.full(len(first[-1]), row))
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        h, g, self.owner, self.at = cat(first, np.uint64), cat(second, np.uint64), cat(owner, np.int64), cat(at, np.int64)
        order = np.lexsort((g, h)) if last else np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        if last:
            new[1:] |= g[order][1:] != g[order][:-1]
        self.place = np.empty(len(h), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.h = h[order][new]
        self.g = g[order][new] if last else None
        doc = np.array([0 if d is None else d for d in self.ids], np.int64)[self.owner[order]] if len(h) else np.empty(0, np.int64)
        begin = np.flatnonzero(new)
        self.low = np.minimum.reduceat(doc, begin) if len(begin) else doc
        self.high = np.maximum.reduceat(doc, begin) if len(begin) else doc

    def cuts(self, begins: np.ndarray) -> list[int]:
        return [0, *np.searchsorted(self.h, begins).tolist(), len(self.h)]


def _survivors(other: pa.Table | None) -> np.ndarray | None:
    if other is None:
        return None
    cells = sorted((p, h) for p, h in zip(other.column("part").to_pylist(), other.column("alive").to_pylist()) if h is not None)
    kept = [unpack_sorted(h) for _, h in cells]  # parts are ranges: the whole is sorted
    return np.concatenate(kept) if kept else np.empty(0, np.uint64)


def _send(length: int, last: bool, parts: int, is_first: bool):
    begins = edges(parts)

    def send(chunk_id, texts: pa.Table, other: pa.Table | None) -> pa.Table:
        c = _Chunk(texts, length, last, _survivors(other))
        cuts = c.cuts(begins)
        held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        cell = lambda f, x: pa.array([f(x[cuts[p] : cuts[p + 1]]) for p in held], pa.binary())
        out = {"chunk": pa.array([chunk_id] * len(held), pa.int64()), "part": pa.array(held, pa.int64()), "h": cell(pack_sorted, c.h), "low": cell(pack, c.low), "over": cell(pack, c.high - c.low)}
        return pa.table(out | ({"g": cell(pack, c.g)} if last else {}))

    def first(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        return send(key[0].as_py(), texts, None)

    def later(key: tuple[pa.Scalar, ...], texts: pa.Table, other: pa.Table) -> pa.Table:
        return send(key[0].as_py(), texts, other)

    return first if is_first else later


def _compare(last: bool):
    """What all chunks sent to a part -> to each chunk the hashes that survive, or at the last level each window's least document."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        sent = [unpack_sorted(x) for x in part.column("h").to_pylist()]
        sizes = [len(x) for x in sent]
        h = np.concatenate(sent)
        low = np.concatenate([unpack(x) for x in part.column("low").to_pylist()])
        high = low + np.concatenate([unpack(x) for x in part.column("over").to_pylist()])
        g = np.concatenate([unpack(x, np.uint64) for x in part.column("g").to_pylist()]) if last else None
        order = np.lexsort((g, h)) if last else np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        if last:
            new[1:] |= g[order][1:] != g[order][:-1]
        begin = np.flatnonzero(new)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(low[order], begin)[place]
        out = {"chunk": part.column("chunk"), "part": part.column("part")}
        if last:
            return pa.table(out | {"least": pa.array([pack(x) for x in np.split(least, np.cumsum(sizes)[:-1])], pa.binary())})
        alive = np.split(least < np.maximum.reduceat(high[order], begin)[place], np.cumsum(sizes)[:-1])
        return pa.table(out | {"alive": pa.array([pack_sorted(x[k]) for x, k in zip(sent, alive)], pa.binary()), "n": pa.array([int(k.sum()) for k in alive], pa.int64())})

    return run


def _cut(length: int, has_survivors: bool):
    """A chunk's texts and its windows' least documents -> what is left of every row."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, other: pa.Table) -> pa.Table:
        c = _Chunk(texts, length, True, _survivors(other) if has_survivors else None)
        back = sorted((p, x) for p, x in zip(other.column("part").to_pylist(), other.column("least").to_pylist()) if x is not None)
        least = np.concatenate([unpack(x) for _, x in back]) if back else np.empty(0, np.int64)
        if len(least) != len(c.h):
            raise ValueError("a chunk's least documents are not those of its windows")
        ids = np.array([0 if d is None else d for d in c.ids], np.int64)
        gone = least[c.place] < ids[c.owner]
        owner, at = c.owner[gone], c.at[gone]
        edge = np.flatnonzero(np.diff(owner)) + 1
        starts = {int(o[0]): a for o, a in zip(np.split(owner, edge), np.split(at, edge)) if len(o)}
        out = {k: [] for k in ("n_words", "n_removed", "kept_text", "kept_sha256")}
        for row, text in enumerate(c.texts):
            words = WORD.findall(text.as_py() or "")
            left = words
            if row in starts:
                mark = np.zeros(len(words) + 1, np.int32)
                mark[starts[row]] += 1
                mark[starts[row] + length] -= 1
                left = [w for w, g in zip(words, (np.cumsum(mark[:-1]) > 0).tolist()) if not g]
            kept = " ".join(left)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(left))
            out["kept_text"].append(kept)
            out["kept_sha256"].append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
        return pa.table({"doc_id": texts.column("doc_id"), "rows": texts.column("rows"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.string()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    return run


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text, rows) of the documents, equal rows as one, and the number of chunks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = chunks(size // 6)
    docs = docs.withColumn("t", F.xxhash64("text", F.reverse("text"))).withColumn("rows", F.lit(1).cast("long"))
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # equal rows become one before they are dealt, and are given back at the end
        docs = docs.groupBy("doc_id", "t").agg(F.first("text").alias("text"), F.sum("rows").alias("rows"))
    return docs.select(F.pmod(F.xxhash64("doc_id", "t"), F.lit(n)).alias("chunk"), "doc_id", "text", "rows"), n


_SENT = "chunk long, part long, h binary, low binary, over binary"


def _level(texts, before: DataFrame | None, length: int, last: bool, parts: int) -> DataFrame:
    """One level: (chunk, part, alive, n) or, at the last, (chunk, part, least)."""
    schema = _SENT + (", g binary" if last else "")
    send = _send(length, last, parts, before is None)
    sent = texts.applyInArrow(send, schema) if before is None else texts.cogroup(before.groupBy("chunk")).applyInArrow(send, schema)
    return sent.groupBy("part").applyInArrow(_compare(last), f"chunk long, part long, {'least binary' if last else 'alive binary, n long'}")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, first: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 of every document.

    Levels are of ``first`` words (half the window, if that is even), twice as many, and so on to ``window``.
    The whole is one query, so that one shuffle of the texts serves all levels.
    """
    first = first or (window // 2 if window % 2 == 0 else window)
    if window < 1 or window % first or (window // first) & (window // first - 1):
        raise ValueError("window must be the first length, doubled a number of times")
    dealt, parts = _dealt(docs)
    texts = dealt.groupBy("chunk")
    length, before = first, None
    while length < window:
        before = _level(texts, before, length, False, parts)
        length *= 2
    least = _level(texts, before, length, True, parts)
    known = least if before is None else before.unionByName(least, allowMissingColumns=True)
    cut = texts.cogroup(known.groupBy("chunk")).applyInArrow(_cut(length, before is not None), "doc_id long, rows long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return cut.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("one", "rows")


def repeated_lengths(docs: DataFrame, first: int = WINDOW // 2) -> DataFrame:
    """(length, hashes): how many window hashes chunks know by survive each level, doubling until no candidate survives.

    Every level is written, so that the next begins from its survivors.
    """
    space = Workspace(docs.sparkSession, "substring")
    dealt, parts = _dealt(docs)
    texts = space.save(dealt, "texts").groupBy("chunk")
    length, before, found = first, None, []
    while True:
        before = space.save(_level(texts, before, length, False, parts), f"level-{length}")
        alive = before.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not alive:
            break
        found.append((length, alive))
        length *= 2
    space.drop("texts")
    return docs.sparkSession.createDataFrame(found, "length int, hashes long")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), bad AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM win) WHERE low < doc_id
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), mark AS (
  SELECT word.doc_id, word.i, word.word,
         max(bad.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS last_start
  FROM word LEFT JOIN bad ON word.doc_id = bad.doc_id AND word.i = bad.i
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE last_start > i - 50) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE last_start IS NULL OR last_start <= i - 50), '') AS t
  FROM mark GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
