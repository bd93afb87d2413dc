"""The registered queries over the smallest tables, against plain versions of their contracts."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from loomtext.llm import pii
from loomtext.llm.queries import QUERIES
from tokenizers import Tokenizer

from tests.llm.test_neardup import brute
from tests.llm.test_texts import PATTERNS, plain_spans


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def clusters(spark, sf):
    return {r.doc_id: r for r in QUERIES["op1_minhash_near_dedup"](spark, sf).collect()}


@pytest.fixture(scope="module")
def sizes(texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: plain.encode(t, add_special_tokens=False).ids + [0] for d, t in texts.items()}


def test_near_duplicates(clusters, texts):
    assert {d: r.cluster_id for d, r in clusters.items()} == brute(sorted(texts.items()))
    words = {d: b" ".join(t.encode().split()) for d, t in texts.items()}
    least = {}
    for d in sorted(words):
        least.setdefault(words[d], d)
    assert all(r.copy_of == least[words[d]] and r.kept == (d == r.cluster_id) for d, r in clusters.items())


def test_packing(spark, sf, clusters, sizes):
    out = QUERIES["op2_best_fit_packing"](spark, sf).collect()
    held, bins = {}, {}
    for r in out:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert held == {d: len(ids) for d, ids in sizes.items()}
    for part in bins.values():
        sources = [r.source for r in part if r.source is not None]
        groups = [clusters[r.doc_id].cluster_id for r in part]
        assert sum(r.n_tokens for r in part) <= 2048 and len(set(sources)) == len(sources) and len(set(groups)) == len(groups)


def test_fingerprints(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op6_document_fingerprints"](spark, sf).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for d, following in zip(order, order[1:] + order[:1]):
        t, half = texts[d], len(texts[d]) // 2
        changed = t[: len(t) - half] + texts[following][:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1.0) >= (r.fingerprint == got[following].fingerprint)


def test_token_ids(spark, sf, sizes):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_ids"](spark, sf).collect()}
    start, want = 0, {}
    for d in sorted(sizes):
        want[d] = (start, len(sizes[d]), zlib.crc32(np.array(sizes[d], "<u4").tobytes()))
        start += len(sizes[d])
    assert got == want


def test_personal_data(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, sf).collect()}
    kinds = list(PATTERNS)
    assert sorted(got) == sorted(texts)
    for d, t in texts.items():
        spans, r = plain_spans(t), got[d]
        text = ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(text.split(",")) - {""} <= set(every) and len(every) == len(spans) + r.n_added
        assert all(re.fullmatch(rf"({'|'.join(pii.KINDS)}):\d+:\d+", x) for x in every)
