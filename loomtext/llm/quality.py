"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a linear score of features of its whole text.  The
weights are learned from preference pairs (a document of label 1 over one of
label 0) by the logistic loss on the difference of their features.  The raw
score is cut at a score quantile (see ``_cut``) and mapped to 0..1 so that the
cut is at ``PREDICT``.

The labelled sample is bounded: the ``SAMPLE_ROWS`` rows of least id hash among
those not held out.  Everything else covers all documents.

Defined results.  Null and blank texts have the features of an empty text and a
score like any other.  Without labels of both kinds every score is ``PREDICT``.
Rows that share an id are scored each for itself and learned from once; labels
that share an id count once, with the lowest quality.  A null id is not held out and not learned from.
Extra columns are ignored.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_ROWS = 20_000
PAIRS = 200_000
PREDICT = 0.3
HELD_OUT_OF = 5

NAMES = ("upper", "symbols", "bangs", "pipes", "digits", "stops", "commas", "repeats", "distinct", "line_copies", "word_length", "long_words", "log_words", "wide", "blank")
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_SYMBOL = np.zeros(256)
_SYMBOL[[ord(c) for c in "#$%&*^~<>{}[]=+@_\\/"]] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1


def features(text: str | None) -> np.ndarray:
    text = text or ""
    words = text.split()
    if not words:
        return np.array([0.0] * (len(NAMES) - 1) + [1.0])
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = len(data), len(words)
    lines = [x for x in text.split("\n") if x]
    length = sum(map(len, words)) / w
    distinct = len(set(words))
    return np.array([
        counts @ _UPPER / max(1.0, counts @ _LETTER),
        counts @ _SYMBOL / n,
        min(1.0, counts[33] / w),
        min(1.0, counts[124] / w),
        counts @ _DIGIT / n,
        min(1.0, counts[46] / w),
        min(1.0, counts[44] / w),
        sum(map(operator.eq, words, words[1:])) / w,
        np.log1p(distinct) / np.log1p(w),
        1.0 - len(set(lines)) / max(1, len(lines)),
        min(20.0, abs(length - 5.0)),
        min(1.0, sum(1 for x in words if len(x) > 24) / w),
        np.log1p(w),
        counts[128:].sum() / n,
        0.0,
    ])


@dataclass
class Ranker:
    """Learned strengths; ``score`` is 0.3 at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = (self.raw(x) - self.cut) * self.slope + np.log(PREDICT / (1 - PREDICT))
        # the cut itself scores PREDICT, whatever rounding does
        out = 1.0 / (1.0 + np.exp(-np.clip(logit, -700, 700)))
        return np.where(logit >= np.log(PREDICT / (1 - PREDICT)), np.maximum(out, PREDICT), np.minimum(out, np.nextafter(PREDICT, 0)))


def _cut(better: np.ndarray, worse: np.ndarray) -> float:
    """A quantile cut that keeps label 1: below all but 0.2 % of it, and midway to label 0's upper quantile where they part."""
    low, high = np.quantile(better, 0.002), np.quantile(worse, 0.998)
    return float((low + high) / 2 if high < low else low)


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 51) -> Ranker:
    """Bradley-Terry strengths by Newton steps on the logistic loss of feature differences."""
    k = x.shape[1] if x.ndim == 2 else len(NAMES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.Generator(np.random.PCG64(seed))
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is ranked wrongly
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    ranker = Ranker(mean, scale, w, 0.0, 1.0)
    raw = ranker.raw(x)
    ranker.cut = _cut(raw[good], raw[bad])
    ranker.slope = 20.0 / max(20.0, float(raw.max() - raw.min()))
    return ranker


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ranker:
    """Fit on the bounded sample; held-out rows are never read."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches):
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("one")).select("doc_id", "one.*")  # of rows that share an id the least features
    rows = sorted(got.collect(), key=lambda r: r.doc_id)  # SAMPLE_ROWS rows at most
    return fit(np.array([r.x for r in rows]), np.array([r.quality for r in rows]))


def score_quality(docs: DataFrame, ranker: Ranker, *kept: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the further columns named, of every document."""

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(NAMES))
            score = ranker.score(x)
            columns = [batch.column(c) for c in ("doc_id", "held_out", *kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= PREDICT).astype(np.int32))], ["doc_id", "held_out", *kept, "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in kept if c != "text"]).withColumn("held_out", held_out())
    types = dict(docs.dtypes)
    extra = "".join(f", {c} {types[c]}" for c in kept)
    return docs.mapInArrow(run, f"doc_id long, held_out boolean{extra}, score double, predicted int")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
