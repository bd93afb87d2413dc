import random
from collections import Counter
from itertools import combinations

import numpy as np

from loomtext.llm import neardup
from loomtext.llm._hashing import WordHasher
from loomtext.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, cluster_id string"  # an extra column with a clashing name


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    docs = []
    for _ in range(25):
        base = words(rng, rng.randint(60, 200))
        for _ in range(rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            docs.append(" ".join(w))
    docs += [docs[0], docs[5], "one two", "one two", "", None, "   ", "x " * 3000]
    return list(enumerate(docs))


def brute(docs):
    """Components of exact TF-IDF weighted Jaccard >= 0.8 over the real shingle texts."""
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df = Counter(s for c in sets.values() for s in c)
    n = len(docs)
    weight = {s: float(np.log1p(n / k)) for s, k in df.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        low = sum(weight[s] * min(x[s], y[s]) for s in x if s in y)
        high = sum(weight[s] * v for s, v in x.items()) + sum(weight[s] * v for s, v in y.items()) - low
        if high == 0 or low / high >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def test_clusters_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], SCHEMA)
    got = {r.doc_id: r.cluster_id for r in near_duplicates(df).collect()}
    assert got == brute(docs)


def test_a_large_group_of_near_copies_is_linked_whole(spark, monkeypatch):
    """A chain around one base text: most pairs are below the threshold, the base text links them."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(3)
    base = words(rng, 150)
    docs = [" ".join(base)]
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)[0] + "x"
        docs.append(" ".join(w))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = {r.doc_id: r.cluster_id for r in near_duplicates(spark.createDataFrame([(i, t, "") for i, t in docs], SCHEMA)).collect()}
    want = brute(docs)
    differ = sum(got[i] != want[i] for i in got)
    assert differ <= 1, differ  # a pair at the threshold itself shares a band with 0.998


def test_nulls_ties_and_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", ""), (7, "a b c d e f", ""), (7, "a b c d e f", ""), (3, "q r s t u v", ""), (3, "a b c d e f", ""), (9, None, None)]
    got = sorted(((r.doc_id, r.cluster_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    # id 3 holds both texts, so 7 is in its cluster
    assert got == [(3, 3, True), (7, 3, False), (9, 9, True), (None, None, True)]


def test_samples_agree_like_weighted_jaccard():
    hasher, sampler = WordHasher(31), neardup.WeightedSampler(samples=2048)
    rng = np.random.default_rng(0)
    h = hasher.words(" ".join(f"w{i}" for i in range(300)))
    w1, w2 = rng.uniform(0.5, 5, 300), rng.uniform(0.5, 5, 300)
    w1[:60] = 0
    a, b = sampler.sample(h[w1 > 0], w1[w1 > 0]), sampler.sample(h, w2)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((a == b).mean() - want) < 0.04
