import random

from loomtext.llm.packing import BestFit, pack, sized

SCHEMA = "doc_id long, source string, cluster long, size long, bin_id string"


def tightest(items, capacity):
    """Best fit by looking at every bin: each piece goes to a compatible bin that none fits tighter, and to a new one only without."""
    fit = BestFit(capacity)
    bins = []
    for size, source, cluster in items:
        fits = [left for left, sources, clusters in bins if left >= size and not (sources & source) and not (clusters & cluster)]
        b, at = fit.place(size, source, cluster)
        if fits:
            left, sources, clusters = bins[b]
            assert left == min(fits) and not (sources & source) and not (clusters & cluster) and at == capacity - left
            bins[b] = (left - size, sources | source, clusters | cluster)
        else:
            assert b == len(bins) and at == 0
            bins.append((capacity - size, source, cluster))
        assert fit.left == [left for left, _, _ in bins]


def test_successor_search_finds_the_tightest_compatible_bin():
    rng = random.Random(1)
    for n in range(40):
        some = 5 if n % 2 else 40
        tightest([(rng.randint(1, 60), 1 << rng.randrange(some) if rng.random() < 0.9 else 0, rng.choice([0, 0, 1, 2, 4])) for _ in range(150)], 100)
        tightest([(rng.randint(1, 100), 0, 0) for _ in range(150)], 100)


def test_no_bin_breaks_a_rule_and_nothing_is_lost(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(4)}" if rng.random() < 0.9 else None, rng.choice([None, 1, 2, i + 100]), rng.randint(0, 700), "x") for i in range(600)] + [(7, "s1", 1, 50, "y"), (7, "s1", 1, 50, "y"), (None, None, None, None, None)]
    out = pack(spark.createDataFrame(rows, SCHEMA), capacity=256, shard_docs=100).collect()
    size = {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for d, _, _, n, _ in rows:
        want[d] = want.get(d, 0) + max(1, n or 1)
    assert size == want
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    cluster = {r[0]: r[2] for r in rows}
    for part in bins.values():
        part.sort(key=lambda r: r.bin_start)
        assert all(a.bin_start + a.n_tokens == b.bin_start for a, b in zip(part, part[1:])) and part[-1].bin_start + part[-1].n_tokens <= 256 and part[0].bin_start == 0
        sources = [r.source for r in part if r.source is not None]
        clusters = [cluster[r.doc_id] for r in part if cluster[r.doc_id] is not None]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)


def test_empty_and_repeatable(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "x" * 20_000, "a")], "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, pack(sized(docs)).collect()), key=repr) for _ in range(2))
    assert a == b and sum(r[4] for r in a) == 5002
