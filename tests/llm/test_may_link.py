"""Only representatives that may reach the threshold with another are sampled."""

import pyarrow as pa
import pyarrow.compute as pc
from loomtext.llm import neardup


def signed(docs, threshold):
    """Ids that are sampled, of (id, text, rows of its class)."""
    ids, texts, copies = zip(*docs)
    marks = pa.array([0] * len(ids), pa.int64())
    chunk = pa.table({"doc_id": pa.array(ids, pa.int64()), "t": marks, "text": list(texts)})
    classes = pa.table({"doc_id": pa.array(ids, pa.int64()), "t": marks, "n": pa.array(copies, pa.int64())})
    key = (pa.scalar(0),)
    back = neardup._count(key, neardup._send(1)(key, chunk, classes))
    known = pa.concat_tables([classes, back], promote_options="default")
    return neardup._sign(sum(copies), threshold)(key, chunk, known)


def test_what_cannot_reach_the_threshold_is_not_sampled():
    words = [f"w{i}" for i in range(100)]
    base, near = " ".join(words), " ".join([*words[:99], "other"])
    part = " ".join(words[:60] + [f"u{i}" for i in range(40)])  # shares 56 of its 96 shingles
    alone = " ".join(f"v{i}" for i in range(100))
    docs = [(1, base, 1), (2, near, 3), (3, part, 1), (4, alone, 1), (5, alone + " more", 5), (6, " ".join(f"x{i}" for i in range(50)), 4), (7, "", 2)]
    out = signed(docs, 0.8)
    assert out.column("doc_id").to_pylist() == [1, 2, 4, 5] and pc.list_value_length(out.column("bands")).to_pylist() == [neardup.SAMPLES // neardup.BAND_ROWS] * 4
    assert signed(docs, 0.1).column("doc_id").to_pylist() == [1, 2, 3, 4, 5]
    everything = signed(docs, 0.0)
    assert everything.column("doc_id").to_pylist() == [1, 2, 3, 4, 5, 6]
    # what is given for the sampled ones doesn't depend on the others
    assert out.to_pylist() == [r for r in everything.to_pylist() if r["doc_id"] in (1, 2, 4, 5)]
