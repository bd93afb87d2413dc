"""Commits, orders, packages, and joins that the fixtures of the queries don't reach."""

import xml.dom.minidom
from xml.parsers.expat import ExpatError

import pytest
from loomtext.operators import envelope, joins
from loomtext.sinks import exports
from loomtext.sources import stores


def test_commit_is_new_and_current(spark, tmp_path):
    rows = spark.range(3)
    path = str(tmp_path / "out")
    assert not exports.commit_new(rows, path, generation=1, current=2) and not (tmp_path / "out").exists()
    assert exports.commit_new(rows, path, generation=2, current=2) and spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        exports.commit_new(rows, path, generation=2, current=2)


def test_orders(spark):
    rows = spark.createDataFrame([(i, i * 7 % 5) for i in range(10)], "id long, created_at long")
    got = [(r.created_at, r.id) for r in exports.newest_first(rows).collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and [r.id for r in exports.newest_first(rows, most=3).collect()] == [i for _, i in got[:3]]
    parts = spark.createDataFrame([("b", "z"), ("a", "y"), ("a", "B"), ("a", "x/1")], "package string, name string")
    assert [tuple(r) for r in exports.sorted_parts(parts).collect()] == [("a", "B"), ("a", "x/1"), ("a", "y"), ("b", "z")]


def test_parts_are_parsed(spark):
    texts = ["<a/>", "<a><b></a></b>", "<a><b/></a>", "<a>", "", "x", "<?xml version='1.0'?><a>&lt;</a>", "<a>&</a>", "<a/><b/>", "<a x='1' x='2'/>", "<!-- c --><a/>"]
    rows = [("p", f"{i}.xml", t.encode()) for i, t in enumerate(texts)] + [("p", "n.xml", None), ("p", "raw.bin", b"<"), ("q", "need.xml", b"<a/>")]
    got = {(r.package, r.problem) for r in exports.part_problems(spark.createDataFrame(rows, "package string, name string, data binary"), ["need.xml"]).collect()}
    want = {("p", "missing: need.xml"), ("p", "malformed: n.xml")}
    for i, t in enumerate(texts):
        try:
            xml.dom.minidom.parseString(t)
        except ExpatError:
            want.add(("p", f"malformed: {i}.xml"))
    assert got == want


def test_names_avoid_taken_ones(spark):
    wanted = spark.createDataFrame([("f", "a", "ko", "txt", f"u{i}") for i in range(3)] + [("f", "a", "ko", "", "u9"), ("g", "a", "ko", "txt", "v")], "folder string, base string, lang string, ext string, url string")
    taken = spark.createDataFrame([("f", "a.ko.translated.txt"), ("f", "a.ko.translated (4).txt"), ("f", "other.txt"), ("h", "a.ko.translated.txt")], "folder string, name string")
    got = {r.url: r.output for r in exports.output_names(wanted, taken).collect()}
    names = set(got.values())
    assert {got[f"u{i}"] for i in range(3)} == {"a.ko.translated (5).txt", "a.ko.translated (6).txt", "a.ko.translated (7).txt"} and got["v"] == "a.ko.translated.txt"
    assert not names & {"a.ko.translated (4).txt"} and got["u9"].startswith("a.ko.translated")


def test_documents_that_share_page_numbers(spark):
    box = "doc long, page long, id string, x double, y double, w double, h double"
    rows = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 10.0, 10.0), (2, 1, "b", 0.0, 0.0, 10.0, 10.0)], box)
    texts = rows.selectExpr("*", "'same' AS text")
    assert [r.id for r in joins.drop_recognized_twice(texts, texts.where("doc = 2")).collect()] == ["a"]
    links = rows.where("doc = 2").selectExpr("doc", "page", "x", "y", "w", "h", "'u' AS url")
    assert {r.id: r.url for r in joins.link_targets(rows, links).collect()} == {"a": None, "b": "u"}
    notes = links.selectExpr("doc", "page", "x", "y", "w", "h", "CAST(NULL AS STRING) AS url")
    assert [r.id for r in joins.overlay_conflicts(rows, notes).collect()] == ["b"]
    assert [r.id for r in joins.occluded(rows, rows.where("doc = 2")).collect()] == ["b"]


def test_long_lists_are_used_whole(spark):
    devices = spark.createDataFrame([(f"Label {i:05d}", f"n{i:05d}", i) for i in range(1200)], "label string, name string, place int")
    wanted = spark.createDataFrame([(1, "label 01150"), (2, "N01199"), (3, "01077"), (4, None)], "request_id long, wanted string")
    got = {r.request_id: r.device for r in joins.resolve_device(wanted, devices, []).collect()}
    assert got == {1: "n01150", 2: "n01199", 3: "n01077", 4: "n00000"}
    models = spark.createDataFrame([(f"m{i}", i) for i in range(100)], "model string, place int")
    out = envelope.fan_out(spark.createDataFrame([(1, "x")], "request_id long, text string"), models, models.select("model").where("place % 2 = 0"), lambda m, t: m + t)
    assert out.count() == 100 and out.where("translated_text IS NOT NULL").count() == 50


def test_targets_of_many_steps(spark):
    deep = "/".join("abcdefgh")
    rels = f"{deep}/_rels/x.rels"
    good, bad = "../" * 8 + "top.xml", "../" * 8 + "gone.xml"
    long = "/" + "d" * 12_000 + ".xml"
    tag = lambda t: f'<Relationship Id="1" Target="{t}"/>'
    rows = [(rels, tag(good) + tag(bad) + tag("./v1.0/../v1.0/part.xml") + tag(long)), ("top.xml", ""), (f"{deep}/v1.0/part.xml", ""), (long[1:], "")]
    got = [r.part for r in joins.dangling_targets(spark.createDataFrame(rows, "name string, data string")).collect()]
    assert got == ["gone.xml"]


def test_lines_of_byte_chunks(spark):
    data = "é one\r\ntwo\n\nlong ".encode() + b"x" * 50 + "\nrest é".encode()
    cuts = [0, 1, 3, 9, 10, 14, 40, len(data)]
    rows = [(s, i, data[a:b]) for s in (1, 2) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame(rows, "stream long, seq long, bytes binary")
    got = sorted(map(tuple, stores.framed_lines(df).collect()))
    want = [x.removesuffix("\r") for x in data.decode().split("\n")[:-1]]
    assert got == [(s, i, x) for s in (1, 2) for i, x in enumerate(want)]
    with pytest.raises(Exception, match="line too long"):
        stores.framed_lines(df, most=40).collect()


def test_a_store_is_replaced_by_one_rename(spark, tmp_path):
    path = str(tmp_path / "store.json")
    for n in (3, 1):
        stores.write_store(spark.createDataFrame([(i, f"t{i}") for i in range(n)], "id long, text string"), path, "id")
        assert [r.id for r in stores.read_store(spark, path, "id long, text string").orderBy("id").collect()] == list(range(n))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["store.json"]
