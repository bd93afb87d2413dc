"""Fingerprints, token files, WARC, PII, quality, substring dedup, licences and decontamination on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import _encoding, _packed, decontaminate, fingerprints as fp, licenses, pii, quality, substring, tokenbin, warc
from loomtext.llm._hashing import BLOCK, WordHasher

DOC = "doc_id long, text string, score string, spans int, fingerprint int"  # with clashing extra columns


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 0, 0) for i, t in rows], DOC)


# hashing ----------------------------------------------------------------------------------


def test_words_hash_alike_wherever_they_stand():
    h = WordHasher(5)
    one = h.words("alpha beta  gamma\nalpha")
    assert one[0] == one[3] and len(set(one.tolist())) == 3
    long = "w " * BLOCK + "alpha " + "x" * (BLOCK + 10) + " alpha"
    got = h.words(long)
    assert len(got) == BLOCK + 3 and got[-1] == one[0] and got[BLOCK] == one[0]
    assert len(h.words(None)) == len(h.words(" \t\n")) == 0
    a = h.windows(h.words("q w e r t y u i o p a s"), 10)
    assert a[1] == h.windows(h.words("w e r t y u i o p a"), 10)[0]


# fingerprints -------------------------------------------------------------------------------


def test_likeness_estimates_jaccard():
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    for share in (0.1, 0.5, 0.9):
        k = int(2000 * share)
        other = base[:k] + [f"v{i}" for i in range(2000 - k)]
        a, b = ({tuple(x[i : i + 5]) for i in range(1996)} for x in (base, other))
        got = fp.likeness(fp.fingerprint(" ".join(base)), fp.fingerprint(" ".join(other)))
        assert abs(got - len(a & b) / len(a | b)) < 0.1
    assert fp.fingerprint("") == fp.fingerprint(None) == "" and fp.likeness("", "") == 1.0 and fp.likeness("", fp.fingerprint("a")) == 0.0
    assert fp.fingerprint("same text") == fp.fingerprint("same text")


def test_each_document_beside_the_next(spark):
    rows = [(10, "aé" * 40), (3, None), (5, "b c d e f g h"), (20, "x" * 9), (21, ""), (4, "w " * 300)]
    for per in (1, 2, 100):
        got = {r.doc_id: r for r in fp.compare_with_next(frame(spark, rows), docs_per_slice=per).collect()}
        order = sorted(rows)
        for k, (i, t) in enumerate(order):
            t, n = t or "", order[(k + 1) % len(order)][1] or ""
            e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert r.fingerprint == fp.fingerprint(t) and r.edited_fingerprint == fp.fingerprint(e)
            assert r.near_next == fp.likeness(fp.fingerprint(t), fp.fingerprint(n)) and r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)


def test_next_with_ties_nulls_and_nothing(spark):
    assert fp.compare_with_next(frame(spark, [])).count() == 0
    one = fp.compare_with_next(frame(spark, [(1, "a b c d e f")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "n"), (2, "c")]
    assert fp.compare_with_next(frame(spark, rows), docs_per_slice=1).count() == 5


# token files ----------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=600))
def test_elias_fano_gives_every_start(gaps):
    values = np.cumsum(np.array(gaps, np.int64)) if gaps else np.empty(0, np.int64)
    ef = tokenbin.EliasFano.encode(values, int(values[-1]) + 1 if gaps else 1)
    assert [ef[i] for i in range(len(values))] == values.tolist()


TRICKY = st.lists(st.sampled_from([*"ab \n\t'éｘ", "  ", "12", "!!", "'s", "\x1c", "\xa0", "<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TRICKY, min_size=1, max_size=4))
def test_cached_encoding_is_the_tokenizers(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = _plain(path)
    ids, sizes = tokenbin.encoder(path).encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


WORDY = st.lists(st.sampled_from(["word", "words.", "x,", "Don't", "12", "a\nb", "é!", "end.\n\nNext", "…", "²."]), min_size=1, max_size=60).map(" ".join)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(WORDY, TRICKY), min_size=1, max_size=4))
def test_encoding_holds_over_generations_of_words(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, sizes = _encoding.encoder(path, remembered=8).encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [_plain(path).encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(name):
    path = public_tokenizers.path(name)
    texts = ["Some Words, again", "", "x <|endoftext|> y"]
    ids, sizes = tokenbin.encoder(path).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [_plain(path).encode(t, add_special_tokens=False).ids for t in texts]


_tokenizers = {}


def _plain(path):
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(5, "Hello world, again"), (2, None), (9, ""), (None, "first"), (7, "long " * 3000), (7, "a tie"), (-(1 << 63), "least"), ((1 << 63) - 1, "most <|endoftext|>")]
    for per, most in ((2, 10**6), (100, 10**6), (100, 1)):
        folder = f"file://{tmp_path}/t{per}"
        manifest = tokenbin.write_tokens(frame(spark, rows), folder, path, docs_per_file=per, ids_per_file=most)
        got = sorted(tokenbin.read_tokens(spark, folder).collect(), key=lambda r: r.start)
        start, plain = 0, _plain(path)
        want = []
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert [tuple(r) for r in got] == want
        f = tokenbin.TokenFile(manifest.orderBy("part", "nth").first().uri)
        assert f.doc_id(0) is None and f.ids(0).tolist() == plain.encode("first", add_special_tokens=False).ids + [0]
    empty = f"file://{tmp_path}/none"
    tokenbin.write_tokens(frame(spark, []), empty, path)
    assert tokenbin.read_tokens(spark, empty).count() == 0


# WARC -------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, sha1 string"


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a", "<p>x</p>", ""), (1, None, None, ""), (2, "u\r\nX: y", "<p>x</p>", ""), (4, "d", "é" * 100_000, ""), (5, "e", "", ""), (6, "f", "q", ""), (6, "f", "q", "")] + [(100 + i, "z", f"<html>{i}</html>" * 20, "") for i in range(60)]
    warc.write_warc(spark.createDataFrame(rows, PAGE), f"file://{tmp_path}/w")
    got = sorted(warc.read_warc(spark, f"file://{tmp_path}/w").collect(), key=lambda r: (r.page_id, r.record_type))
    by = {}
    for p, _, html, _ in rows:
        by.setdefault((html or "").encode(), []).append(p)
    want = sorted((p, len(b), warc.digest(b), "response" if k == 0 else "revisit", None if k == 0 else min(ps)) for b, ps in by.items() for k, p in enumerate(sorted(ps)))
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got] == want


def test_small_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")], PAGE)
    warc.write_warc(df, f"file://{tmp_path}/w", least_bytes=4)
    assert {r.page_id: r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    warc.write_warc(df.where("false"), f"file://{tmp_path}/n")
    assert warc.read_warc(spark, f"file://{tmp_path}/n").count() == 0


def test_one_long_record_leaves_a_trained_dictionary_and_reads_in_one_pass(tmp_path):
    long = warc.record(0, "u", b"<p>" + bytes(range(32, 127)) * 150_000, "D", None, False)
    records = [long] + [warc.record(i, "u", b"<html>" + str(i).encode() * 50, "D", None, False) for i in range(1, 40)]
    uri = f"file://{tmp_path}/long.warc.zst"
    from loomtext.llm._shared import write_atomically

    write_atomically(uri, warc.archive_chunks(records))
    got = list(warc.read_archive(uri))
    assert warc.parse(got[0])[0]["WARC-Type"] == "warcinfo" and got[1:] == records
    with open(f"{tmp_path}/long.warc.zst", "r+b") as f:
        f.truncate(f.seek(0, 2) - 30)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_archive(uri))


def test_equal_rows_have_record_ids_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([(6, "b", "q", ""), (6, "a", "q", ""), (7, "c", "q", ""), (None, "d", "q", "")], PAGE)
    warc.write_warc(df, f"file://{tmp_path}/w")
    uris = [r.uri for r in spark.read.parquet(f"{tmp_path}/w/manifest").collect()]
    fields = [warc.parse(x)[0] for u in uris for x in warc.read_archive(u)]
    pages = [f for f in fields if f["WARC-Type"] != "warcinfo"]
    assert len({f["WARC-Record-ID"] for f in pages}) == 4
    first = next(f for f in pages if f["WARC-Type"] == "response")
    assert first["WARC-Target-URI"] == "a" and all(f["WARC-Refers-To"] == first["WARC-Record-ID"] for f in pages if f is not first)


def test_archive_starts_with_its_dictionary(tmp_path):
    import struct

    import zstandard

    records = [warc.record(i, "u", b"<html>" + str(i).encode() * 50, "D", None, False) for i in range(40)]
    data = b"".join(warc.archive_chunks(records))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
    assert first.decompress(data[8 + size :]) == warc.information()
    assert zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(first.unused_data) == records[0]


# PII ----------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((k, *m.span()))
    return out


PARTS = st.lists(st.sampled_from(["a@b.co", "@", ".", "1.2.3.4", "300.1.1.1", "+1 ", "(555) ", "123-4567", "4111111111111111", "4111 1111 1111 1111", " ", "-", "x", "é", "0", "5500-0000-0000-0004", "a..b@c-d.e.f", "+", "%"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_patterns_equal_plain_regular_expressions(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_random_field_ties_spellings_together(spark):
    card, phone = "4111111111111111", "+1 (663) 555-6869"
    rows = [(i, f"call {phone[:-1]}{i % 10} or pay 4539578763621486 from 10.0.0.{i} mail m{i}@x.org done 20{i % 10} items") for i in range(60)]
    field = pii.learn(frame(spark, rows))
    text = f"call {phone} today, later dial 663-555-6869 again; version 1.2 of 1234567"
    got = {(r.spans, r.n_phone, r.n_added) for r in pii.find_pii(frame(spark, [(1, text)]), field).collect()}
    spans, n, added = next(iter(got))
    at = text.index("663-555-6869")
    assert n == 1 and added == 1 and f"phone:{at}:{at + 12}" in spans
    clean = f"nothing here but {card[:-1]}3 and 999.1.2.3 and 12 numbers"
    r = pii.find_pii(frame(spark, [(1, clean), (2, None), (3, "")]), field).orderBy("doc_id").collect()
    assert [x.spans for x in r] == ["", "", ""] and [x.n_card for x in r] == [0, 0, 0]
    assert pii.find_pii(frame(spark, []), pii.learn(frame(spark, []))).count() == 0


def test_redaction_keeps_other_columns(spark):
    field = pii.fit(np.empty((0, pii._BITS)), np.empty((0, 15)), np.empty(0, int), np.empty(0))
    df = spark.createDataFrame([(1, "a me@x.org b", "s", 12), (2, None, "s", None), (3, "clean", None, 5)], "doc_id long, text string, source string, n_chars long")
    assert [tuple(r) for r in pii.redact_pii(df, field).orderBy("doc_id").collect()] == [(1, "a <EMAIL> b", "s", 11), (2, None, "s", None), (3, "clean", None, 5)]
    assert pii.redact("abcdef", [(0, 1, 3), (2, 2, 5)]) == "a<EMAIL>f"


def test_marginals_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    unary = rng.normal(size=(4, 5))
    edges = [(0, 1, rng.normal(size=(5, 5))), (1, 2, rng.normal(size=(5, 5))), (1, 3, rng.normal(size=(5, 5)))]
    got = pii.Field(np.empty(0), np.empty(0)).marginals(unary, edges)
    want = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        p = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(e[y[i], y[j]] for i, j, e in edges))
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=2e-3)


# quality --------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = quality.op5_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() == d.count()
    want = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in d.select("doc_id").collect()}
    assert {r.doc_id: r.held_out for r in out.select("doc_id", "held_out").collect()} == want


def test_quality_of_odd_input(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, [(1, "a"), (2, None), (None, ""), (4, "X!! " * 30000)])
    got = quality.score_quality(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 4 and all(abs(r.score - 0.3) < 1e-9 and r.score >= 0.3 and r.predicted == 1 for r in got)  # one label only: nothing learned
    assert quality.learn(docs.where("false"), labels.where("false")).weights.any() == np.False_


def test_weights_are_those_of_the_least_pair_loss():
    """The ridged logistic loss of the drawn pairs' differences, recomputed pair by pair, has no slope at the weights."""
    rng = np.random.default_rng(5)
    label = (rng.random(200) < 0.7).astype(int)
    x = rng.normal(size=(200, 4)) + label[:, None] * [0.8, -0.5, 0.0, 0.2]
    got = quality.fit(x, label, pairs=3000, ridge=1e-3, seed=51)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    draw = np.random.Generator(np.random.PCG64(51))
    good, bad = draw.choice(np.flatnonzero(label == 1), 3000), draw.choice(np.flatnonzero(label == 0), 3000)

    def loss(w):
        return np.mean([np.log1p(np.exp(-(z[i] - z[j]) @ w)) for i, j in zip(good, bad)]) + 0.5e-3 * w @ w

    least = loss(got.weights)
    for k in range(4):
        for step in (1e-3, -1e-3):
            assert loss(got.weights + step * np.eye(4)[k]) > least
    # the strengths rank the pairs as their probabilities say: Bradley-Terry
    p = 1 / (1 + np.exp(-(z[good] - z[bad]) @ got.weights))
    assert abs(p.mean() - np.mean((z[good] - z[bad]) @ got.weights > 0)) < 0.12


def test_quality_learns_once_from_rows_that_share_an_id(spark):
    rng = random.Random(4)
    docs = [(i, "Good plain words, and more of them. " * rng.randint(3, 9) if i % 2 else "X!! | $$ #1 " * rng.randint(3, 9)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, often = (quality.learn(frame(spark, rows), labels) for rows in (docs, docs + docs[:5] * 400))
    assert np.allclose(once.weights, often.weights) and once.cut == often.cut


# substring dedup ---------------------------------------------------------------------------------------


def brute_removed(rows, window):
    first = {}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(tokens):
        for k in range(len(tokens[i]) - window + 1):
            first.setdefault(tuple(tokens[i][k : k + window]), i)
    out = {}
    for i, w in tokens.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(9)
    passages = [[rng.choice("abcdefg") for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 15))]
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "a " * 500), (104, "a " * 300)]
    for window, first in ((4, None), (10, None), (7, None), (12, 3), (16, 2)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(frame(spark, rows), window, first).collect()}
        assert got == brute_removed(rows, window)


def test_substrings_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(_packed, "MOST", 60)
    rng = random.Random(10)
    passages = [[rng.choice("abcd") for _ in range(rng.randint(8, 40))] for _ in range(4)]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 4)) for w in (rng.choice(passages) if rng.random() < 0.7 else [f"u{rng.randrange(10**6)}"] * 7))) for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(frame(spark, rows), 8, 2).collect()}
    assert got == brute_removed(rows, 8)


def test_levels_double_until_no_candidate_survives(spark):
    shared = " ".join(f"w{i}" for i in range(45))
    rows = [(1, "a b c " + shared), (2, shared + " x y"), (3, " ".join(f"v{i}" for i in range(200))), (4, None)]
    # windows are looked for that lie in a repeat of twice their length: 45 words hold two of 5, 10 and 20
    assert [r.length for r in substring.repeated_lengths(frame(spark, rows), 5).orderBy("length").collect()] == [5, 10, 20]
    assert substring.repeated_lengths(frame(spark, rows[2:]), 5).count() == 0


def test_substrings_of_shared_and_null_ids(spark):
    w = " ".join(f"w{i}" for i in range(12))
    rows = [(1, w), (1, w), (None, w), (2, w), (2, "short one"), (2, "a b " + w)]
    got = sorted(((r.doc_id, r.n_removed, r.n_words) for r in substring.dedup_substrings(frame(spark, rows), 10).collect()), key=repr)
    assert got == [(1, 0, 12), (1, 0, 12), (2, 0, 2), (2, 12, 12), (2, 12, 14), (None, 0, 12)]
    assert substring.dedup_substrings(frame(spark, []), 10).count() == 0


# licences and benchmark items ---------------------------------------------------------------------------


def test_licence_rules(spark):
    s = licenses.SENTENCES
    full = ". ".join(s[i].capitalize() for i in ("mit-head2", "mit-grant", "mit-notice", "mit-asis", "mit-liable")) + "."
    rows = [(1, full), (2, "Text here.\nReleased under the MIT License.\nAll rights reserved.\nmore"), (3, None), (4, ""), (5, "MIT"), (6, "Licensed under CC BY-NC 4.0.\nother\nLicensed under CC BY 4.0"), (6, "Licensed under CC BY-NC 4.0.\nother\nLicensed under CC BY 4.0"), (7, "word " * 50_000)]
    got = sorted((r.doc_id, r.first_sentence, r.licenses) for r in licenses.scan_licenses(frame(spark, rows)).collect())
    assert got == [(1, 0, "MIT"), (2, 1, "MIT,proprietary"), (6, 0, "CC-BY-NC-4.0"), (6, 2, "CC-BY-4.0")]
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_containment_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 12, 30, 90, 600])))) for i in range(40)] + [(98, None), (99, " ,.; "), (7, "tie of an id here")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if i % 2:
            part = rng.choice(items)[1] or ""
            p = part.split()
            if len(p) > 20 and i % 4 == 1:
                p[len(p) // 2] = "changed"
            w[10:10] = [x.upper() + "," for x in p]
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[5][1])]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_item int")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}

    def shingles(t, n):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = {}
    for j, t in items:
        n = min(5, len(re.findall(r"[^\W_]+", t or "")))
        q = shingles(t, n) if n else set()
        for i, d in docs:
            if q and i is not None:
                k = len(q & shingles(d, n))
                if k >= 0.8 * len(q) and k / len(q) > (lambda v: v[1] / v[0] if v else -1)(want.get((i, j))):
                    want[(i, j)] = (len(q), k)
    assert got == want and len(want) > 20
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench.where("false")).count() == 0


def test_rows_that_share_a_document_id_and_large_sketches(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    other = " ".join(f"v{i}" for i in range(30))
    docs = [(1, "a b " + item), (1, "a b " + item), (1, other + " c"), (2, "nothing"), (3, item.replace("w3", "x")), (None, item)]
    bench = spark.createDataFrame([(7, item, 0), (8, other, 0), (9, None, 0)], "item_id long, text string, n_item int")
    got = []
    for most in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        got.append(sorted((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()))
    assert got[0] == got[1] == [(1, 7, 16), (1, 8, 26)]


def test_sketches_cannot_miss():
    for n in list(range(1, 200)) + [500, 5000]:
        k, hits = decontaminate.sketch_plan(n, 0.8)
        assert k <= max(64, n) and (k - hits >= (n - -(-8 * n // 10)) or k == 64)
