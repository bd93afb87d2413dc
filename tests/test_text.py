import zlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomtext.functions import hashing
from loomtext.operators import text
from loomtext.operators.text import ChunkConfig, pack_segments, segment_text, split_long

PIECES = st.lists(st.sampled_from([*"ab .|-#>`~\n\r\\1)!가　", "<!--", "-->", "---", "```"]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.sampled_from(["text", "markdown"]), st.integers(5, 60))
def test_parts_put_together_are_the_text(t, kind, most):
    assert "".join(s[2] + s[1] + s[3] for s in segment_text(t, kind, most)) == t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 300)), max_size=60))
def test_chunks_keep_their_limits(sizes):
    c = ChunkConfig(100, 300, 500, 256, 6)
    chunks = {}
    for k, z in zip(pack_segments(sizes, c), sizes):
        chunks.setdefault(k, []).append(z)
    assert sorted(chunks) == list(range(len(chunks)))
    for part in chunks.values():
        assert len(part) == 1 or (sum(a for a, _ in part) <= 500 and sum(b for _, b in part) <= 256 and len(part) <= 6)


def test_balanced_case_of_many_lines(spark):
    lines = "\n".join(f"Line {i}: This sentence provides enough context for a stable text translation request." for i in range(170))
    config = ChunkConfig(400, 1200, 1600, 900, 20)
    docs = spark.createDataFrame([(1, lines)], "doc_id long, text string")
    found = text.chunks(docs, config).collect()
    assert len(found) > 1
    assert all(r.character_count <= 1600 and r.estimated_token_count <= 900 and len(r.segment_ids) <= 20 for r in found)
    ids = {r.id for r in text.translatable(text.segments(docs, config)).collect()}
    assert {i for r in found for i in r.segment_ids} == ids


def test_markdown_structure():
    body = "---\ntitle: x\n---\n# Guide\n\n> quote\n- item one\n1) two\n| a | b\\|c |\n|---|---|\n```\nlet answer = 42\n~~~\nplain <!-- no\n<!-- open\nstill\nend -->\n***\n"
    kinds = [(s[4], s[1], s[5]) for s in segment_text(body, "markdown", 100)]
    assert ("heading", "Guide", True) in kinds and ("blockQuote", "quote", True) in kinds and ("listItem", "item one", True) in kinds and ("listItem", "two", True) in kinds
    assert ("tableCell", "a", True) in kinds and ("tableCell", "b\\|c", True) in kinds
    assert [k for k, s, _ in kinds if s == "let answer = 42"] == ["codeBlock"]
    assert [k for k, s, _ in kinds if s == "still"] == ["preserved"]
    assert [k for k, s, _ in kinds if s == "***"] == ["preserved"]


def test_long_lines_are_cut_at_sentences_then_spaces():
    assert split_long("One. Two three four", 10) == [("One.", " "), ("Two three", " "), ("four", "")]
    assert split_long("abcdefghij", 4) == [("abcd", ""), ("efgh", ""), ("ij", "")]
    assert split_long(" abcdefghij", 4) == [(" abcdefghij", "")]
    assert split_long("abc   ", 3) == [("abc", "   ")]


def test_crlf_and_empty_lines(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.content, r.line_ending) for r in text.lines(docs).collect())
    assert got == [(1, 0, "a", "\r\n"), (1, 1, "b", "\r"), (1, 2, "c", "\n"), (2, 0, "", ""), (3, 0, "", "")]
    ends = docs.select("doc_id", text.line_ending_class(F.coalesce("text", F.lit(""))).alias("e")).collect()
    assert {r.doc_id: r.e for r in ends} == {1: "mixed", 2: "lf", 3: "lf"}


def test_code_and_structure_options():
    body = "# Head\n```\ncode\n```\n"
    shown = list(text._expose_code(segment_text(body, "markdown", 100)))
    assert [s[1] for s in shown if s[5]] == ["Head", "code"]
    folded = list(text._fold_prefix(segment_text(body, "markdown", 100)))
    assert folded[0][1:3] == ("# Head", "")


def test_hashes(spark):
    row = spark.createDataFrame([("hello",)], "t string").select(hashing.fnv1a_hex("t").alias("f"), hashing.crc32(F.col("t")).alias("c")).first()
    assert row.f == "a430d84680aabd0b" and row.c == zlib.crc32(b"hello")
