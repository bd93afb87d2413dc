"""Evidence of a full spelling reaches every mention of its key."""

import numpy as np
from loomtext.llm import pii

SKIP = 8.3 * np.eye(5)


def test_marginals_of_a_long_path():
    """The one observed node is at an end; the mentions between say nothing by themselves."""
    n = 60
    unary = np.zeros((n, 5))
    unary[0] = [-50, -50, -50, -50, 0]
    got = pii.Field(np.empty(0), np.empty(0)).marginals(unary, [(i, i + 1, SKIP) for i in range(n - 1)])
    m = np.exp(SKIP) / np.exp(SKIP).sum(1, keepdims=True)
    want = [np.eye(5)[4] @ np.linalg.matrix_power(m, i) for i in range(n)]
    assert np.allclose(got, want, atol=2e-3)


def test_every_bare_mention_is_added_before_and_after_the_full_one():
    field = pii.Field(np.zeros((pii._BITS, 5)), np.stack([np.zeros((5, 5)), SKIP, np.zeros((5, 5))]))
    full, bare = "+1 (212) 555-0199", "212.555.0199"
    text = " and then ".join([bare] * 30 + [full] + [bare] * 30)
    base = pii.base_spans(text)
    assert len(base) == 1 and len(pii.added_spans(text, base, field)) == 60


def test_potentials_are_those_of_the_greatest_pseudo_likelihood():
    """The gradient of the ridged pseudo-likelihood vanishes at what is learned, computed case by case."""
    rng = np.random.default_rng(3)
    x, near, y = rng.integers(0, 2, (300, 4)).astype(float), rng.integers(0, 2, (300, 15)).astype(float), rng.integers(0, 5, 300)
    n = rng.integers(1, 9, 300).astype(float)
    field = pii.fit(x, near, y, n, ridge=1e-2 * n.sum(), steps=4000)
    weights, pairs = np.zeros_like(field.weights), np.zeros_like(field.pairs)
    for a, b, label, times in zip(x, near, y, n):
        logit = a @ field.weights + sum(b[5 * e : 5 * e + 5] @ field.pairs[e] for e in range(3))
        p = np.exp(logit - logit.max())
        p = p / p.sum() - np.eye(5)[label]
        weights += times * np.outer(a, p)
        for e in range(3):
            pairs[e] += times * np.outer(b[5 * e : 5 * e + 5], p)
    weights = weights / n.sum() + 1e-2 * field.weights
    pairs = pairs / n.sum() + 1e-2 * field.pairs
    assert np.abs(weights).max() < 2e-3 and np.abs(pairs + pairs.transpose(0, 2, 1)).max() < 4e-3


def measured(spark, folder):
    """Recall and precision of added spans on documents that were not learned from, each match spelled again beside decoys."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    mine = docs.where("crc32(cast(doc_id AS string)) % 2 = 0")
    field = pii.learn(mine)
    wanted = found = right = wrong = 0
    for r in docs.where("crc32(cast(doc_id AS string)) % 2 = 1").collect():
        text, spans = pii.respelled(r.text or "")
        if not spans:
            continue
        added = pii.added_spans(text, pii.base_spans(text), field)
        good = [s for s in spans if any(a[0] == s[0] and a[1] < s[2] and a[2] > s[1] for a in added)]
        wanted += len(spans)
        found += len(good)
        right += sum(any(a[0] == s[0] and a[1] < s[2] and a[2] > s[1] for s in spans) for a in added)
        wrong += sum(not any(a[0] == s[0] and a[1] < s[2] and a[2] > s[1] for s in spans) for a in added)
    return wanted, found / max(1, wanted), right / max(1, right + wrong)


def test_other_spellings_are_found_in_documents_not_learned_from(spark):
    wanted, recall, precision = measured(spark, "/root/testdata/sf0.01")
    assert wanted > 40 and recall >= 0.9 and precision >= 0.95, (wanted, recall, precision)
