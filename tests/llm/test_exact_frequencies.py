"""Verification by exact document frequencies, and of every text of a shared id."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from loomtext.llm import _packed, neardup
from loomtext.llm.neardup import near_duplicates

from tests.llm.test_neardup import SCHEMA, brute, words


def test_links_follow_exact_frequencies_of_many_chunks(spark, monkeypatch):
    """Chunks and parts of a few documents each."""
    monkeypatch.setattr(_packed, "MOST", 400)
    rng = random.Random(5)
    common = words(rng, 30)  # a passage of many documents weighs little
    docs = [" ".join(common + words(rng, 30)) for _ in range(60)]
    for n in (4, 5, 6, 7, 8, 9, 10, 11):
        rest = words(rng, 110)
        docs += [" ".join(common + rest), " ".join(common + rest[: 110 - n] + words(rng, n))]
    docs = list(enumerate(docs))
    got = {r.doc_id: r.cluster_id for r in near_duplicates(spark.createDataFrame([(i, t, "") for i, t in docs], SCHEMA)).collect()}
    assert got == brute(docs)


def test_every_text_of_a_shared_id_is_compared(spark):
    rng = random.Random(6)
    a, b = words(rng, 120), words(rng, 120)
    near = [*b[:-1], "changed"]
    far = [*a[:-1], "other"]
    for first, second in ((a, b), (b, a)):
        rows = [(5, " ".join(first), ""), (5, " ".join(second), ""), (9, " ".join(near), ""), (11, " ".join(far), "")]
        got = {r.doc_id: r.cluster_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
        assert got == {5: 5, 9: 5, 11: 5}


def test_chunks_get_back_exact_frequencies(spark):
    rng = random.Random(8)
    some = words(rng, 40)
    texts = {i: [rng.choice(some) for _ in range(rng.randint(0, 60))] for i in range(50)}
    rows = [(i, 1, " ".join(w)) for i, w in texts.items()]
    chunks = [pa.table({"doc_id": [r[0] for r in part], "t": [1] * len(part), "text": [r[2] for r in part]}) for part in (rows[:20], rows[20:])]
    classes = [c.select(["doc_id", "t"]).append_column("n", pa.array([1 + d % 3 for d in c.column("doc_id").to_pylist()])) for c in chunks]
    sent = pa.concat_tables([neardup._send(7)((pa.scalar(i),), c, k) for i, (c, k) in enumerate(zip(chunks, classes))])
    back = pa.concat_tables([neardup._count((pa.scalar(p),), sent.filter(pc.equal(sent["part"], p))) for p in sorted(set(sent["part"].to_pylist()))])
    want = Counter()
    for i, w in texts.items():
        for s in {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ():
            want[s] += 1 + i % 3
    got = []
    for i, (c, k) in enumerate(zip(chunks, classes)):
        mine = sorted((p, d) for n, p, d in zip(*(back[x].to_pylist() for x in ("chunk", "part", "df"))) if n == i)
        held = neardup._Chunk(c, k)
        df = np.concatenate([_packed.unpack_counts(d) for _, d in mine])
        assert len(df) == len(held.distinct)
        got += dict(zip(held.distinct.tolist(), df.tolist())).items()
    assert sorted(dict(got).values()) == sorted(want.values())
    for h, n in got:
        assert dict(got)[h] == n  # both chunks were told the same
