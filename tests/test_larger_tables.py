"""Rows that only larger tables hold: equal priorities and places, names beyond 9,999, shares exactly at a threshold."""

from loomtext.operators import envelope
from loomtext.plans.registry import ORACLE_SQL, QUERIES
from loomtext.sinks import exports

from tests.compare import same

PERIOD = 104_729  #: event ids this far apart have the same priority and place


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_of_equal_priorities_the_first_is_preferred(spark, tmp_path):
    folder = written(spark, tmp_path, "events", [(7 + k * PERIOD, u, f"t{k}") for u in range(20) for k in ((3, 5, 2, 6) if u % 2 else (6, 2, 5, 3))], "event_id long, user_id long, event_type string")
    got = {(r.user_id, r.translated_text, r.priority) for r in QUERIES["map5_preferred"](spark, folder).collect()}
    assert got == {(u, f"t2-{7 + 2 * PERIOD}", 7 * 7919) for u in range(20)}


def test_preferred_results_without_priority_or_order(spark):
    rows = [(1, "a", 5, 9), (1, "b", 5, 3), (1, "c", 4, 1), (1, None, 8, 0), (2, "x", None, 1), (2, "y", 1, None), (2, "z", 1, 4), (3, "n", None, 1)]
    results = spark.createDataFrame(rows, "k long, translated_text string, priority long, at long")
    assert {(r.k, r.translated_text, r.priority) for r in envelope.preferred_result(results, "k", order="at").collect()} == {(1, "b", 5), (2, "z", 1), (3, None, None)}
    for some in (results, results.orderBy("translated_text"), results.orderBy("at")):
        assert {(r.k, r.translated_text) for r in envelope.preferred_result(some.drop("at"), "k").collect()} == {(1, "b"), (2, "z"), (3, None)}


def test_names_are_numbered_beyond_9999(spark, tmp_path):
    docs = spark.range(10_050).selectExpr("id * 50 + 1 AS doc_id", "'s' AS source", "'en' AS lang").unionByName(spark.createDataFrame([(50, "s", "en")], "doc_id long, source string, lang string"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["snk5_names"](spark, str(tmp_path)).collect()
    urls = sorted(str(i) for i in (50, *range(1, 502_501, 50)))
    assert {r.url: r.output for r in got} == {u: f"en.ko.translated ({k}).txt" for k, u in enumerate(urls, 2)}


def test_names_stay_free_above_large_numbers(spark):
    wanted = spark.createDataFrame([("f", "a", "ko", "txt", f"u{i}") for i in range(2)], "folder string, base string, lang string, ext string, url string")
    taken = spark.createDataFrame([("f", f"a.ko.translated ({n}).txt") for n in (100_001, 12, 9_999_999_998)], "folder string, name string")
    assert {r.output for r in exports.output_names(wanted, taken, numbered=None).collect()} == {"a.ko.translated (9999999999).txt", "a.ko.translated (10000000000).txt"}
    names = {r.output for r in exports.output_names(wanted, taken).collect()}  # the reference's rule: beyond 9,999 a UUID
    assert len(names) == 2 and not any("(" in n for n in names)


def test_shares_exactly_at_the_threshold_occlude(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tests.compare.TABLES", ["documents"])
    rows = [(d, "\n".join("x" * (n + (1 if i % 4 == 1 else 0) * more) for i in range(8)), "en", "s", 0) for d, (n, more) in enumerate([(10, 1), (20, 2), (30, 3), (10, 0), (20, 1)])]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(QUERIES["jn7_occluded"](spark, folder), ORACLE_SQL["jn7_occluded"], folder)
    assert {r.id for r in QUERIES["jn7_occluded"](spark, folder).collect()} == {f"{d}-{i}" for d in range(3) for i in (0, 4)}


def test_documents_of_large_and_negative_page_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tests.compare.TABLES", ["documents"])
    rows = [(d, "\n".join("x" * (10 + 5 * (i % 4 == 1)) for i in range(8)), "en", "s", 0) for d in (-7, -13, 9_007_199_254_740_993, (1 << 63) - 1)]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(QUERIES["jn7_occluded"](spark, folder), ORACLE_SQL["jn7_occluded"], folder)


def test_overlays_inserted_at_one_place_follow_their_ids(spark, tmp_path):
    folder = written(spark, tmp_path, "events", [(7 + k * PERIOD, u, "view") for u in range(20) for k in ((3, 5, 2, 6) if u % 4 == 1 else (6, 2, 5, 3))], "event_id long, user_id long, event_type string")
    got = {(r.page, r.id, r.z) for r in QUERIES["srt4_overlays"](spark, folder).collect() if r.target == "documents" and r.page % 2}
    assert got == {(u, 7 + k * PERIOD, z) for u in range(1, 20, 2) for z, k in enumerate((2, 3, 5, 6))}
