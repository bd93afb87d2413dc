"""Queries over whole tables and texts: the registered SQL over long pages that are alike at their beginnings only."""

import zlib

import pytest
from loomtext.functions import merging
from loomtext.plans.registry import ORACLE_SQL, QUERIES

from tests.compare import same


@pytest.fixture(scope="module")
def long_pages(spark, tmp_path_factory):
    """Pages of 45 lines, longer than any prefix, that are alike at their first characters only."""
    folder = str(tmp_path_factory.mktemp("long"))
    rows = [(p, "\n".join(f"line {i} of {p % 3}" + " wide" * (30 if (i + p) % 9 == 0 else i % 5) + (" é" if i == 40 else "") for i in range(45)), "en" if p % 2 else "ru", f"s{p % 4}", 0) for p in range(24)]
    rows += [(p, "1 " * 125 + "Latin" * (p // 4 % 2), "ru", "digits", 0) for p in range(100, 108)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"<p>{'same ' * 20}{i % 5}</p>") for i in range(20)], "page_id long, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.range(1000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(c, t, "user", "word, " * (5 + 7 * t)) for c in range(6) for t in range(4)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder


WHOLE = (
    "agg11_alignment agg13_joined agg14_confidence agg3_repeated_edges agg5_shared_templates agg7_header_footer fil2_language_route fil6_furniture grp7_assets jn10_resolved_blocks jn4_recognized jn5_link_targets"
    " jn6_overlay_conflicts jn7_occluded jn9_footers seg10_gaps seg11_color_runs stm12_agg18_speech str15_19_texts win8_gutters mth3_crc32"
).split()


@pytest.mark.parametrize("name", WHOLE)
def test_queries_run_over_whole_texts(spark, long_pages, name, monkeypatch):
    monkeypatch.setattr("tests.compare.TABLES", ["documents", "pages", "events", "conversations"])
    same(QUERIES[name](spark, long_pages), ORACLE_SQL[name], long_pages)


def test_merging_takes_the_whole_text(spark, long_pages):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{long_pages}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["str4_8_merging"](spark, long_pages).collect()}
    fnv = {r.doc_id: r.mth1 for r in QUERIES["mth1_fnv"](spark, long_pages).collect()}
    for d, t in texts.items():
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        third = len(t) // 3
        assert fnv[d] == f"{h:x}" and got[d].str6 == merging.overlap(t[: len(t) - third], t[third:])


def test_boxes_hold_all_lines(spark, long_pages):
    got = {r.page: r.characters for r in QUERIES["grp5_boxes"](spark, long_pages).collect()}
    lines = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{long_pages}/documents.parquet").collect()}
    assert all(got[d] >= sum(map(len, x)) for d, x in lines.items())


def test_crc32_of_a_table_equals_zlib(spark, long_pages):
    want = {r.doc_id: zlib.crc32(r.text.encode()) for r in spark.read.parquet(f"{long_pages}/documents.parquet").collect()}
    assert {r.doc_id: r.mth3 for r in QUERIES["mth3_crc32"](spark, long_pages).collect()} == want
