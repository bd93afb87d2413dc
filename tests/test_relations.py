import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext.functions import geometry, strings, timing
from loomtext.operators import aggregates, envelope, joins, layout, scene
from loomtext.sinks import exports
from loomtext.sources import files, stores


def test_frames(spark):
    audio = base64.b64encode(b"\x11\x22\x33").decode()
    frames = [
        json.dumps({"serverContent": {"inputTranscription": {"text": "hello", "languageCode": "en"}, "outputTranscription": {"text": "안녕하세요", "languageCode": "ko"}, "modelTurn": {"parts": [{"inlineData": {"data": audio}}, {"text": "x"}, {"inlineData": {}}]}, "turnComplete": True}}),
        '{"setupComplete":{}}', "", "  ", '{"serverContent":{"inputTranscription":{"text":" "},"outputTranscription":{}}}', '{"error":{"status":"BAD","code":7}}',
    ]
    df = spark.createDataFrame(list(enumerate(frames)), "seq long, frame string")
    got = [(r.seq, r.tag, r.text) for r in stores.live_events(df).orderBy("seq", "ordinal").collect()]
    assert got == [(0, "inputTranscript", "hello"), (0, "outputTranscript", "안녕하세요"), (0, "audio", None), (0, "turnComplete", None), (1, "setupComplete", None), (5, "error", "BAD")]


def test_csv(spark):
    df = spark.createDataFrame([(1, "회의, 1", 0, "me", 'hello, "world"', "안녕\n하세요", 0)], "conv_id long, title string, seq long, speaker string, original string, translated string, s long").withColumn("at", F.timestamp_seconds("s"))
    out = exports.conversation_csv(df).first().csv.encode()
    assert out.startswith(b"\xef\xbb\xbf") and '"회의, 1","1970-01-01T00:00:00.000Z","me","hello, ""world""","안녕\n하세요"\r\n'.encode() in out


@pytest.mark.parametrize("name", [n for n, _ in files.MARKS])
def test_encoding_round_trip(name):
    data = dict(files.MARKS)[name] + "First line\r\nSecond line".encode(name)
    text, encoding, mark = files.decode(data)
    assert (text, encoding, mark) == ("First line\r\nSecond line", name, True)
    assert files.encode("번역\r\n번역", encoding, mark) == dict(files.MARKS)[name] + "번역\r\n번역".encode(name)


def test_decoding_without_mark(spark):
    assert files.decode(b"") == ("", "utf-8", False)
    assert files.decode(b"caf\xe9")[:2] == ("café", "latin-1")
    assert files.decode(b"\x00\xff\xfe\x01") == (None, None, False)
    assert files.encode("가", "latin-1", False) is None
    rows = [("a.md", b"x"), ("b.bin", b"%PDF-1.7"), ("c", b"# A\n- b\n```\nx\n```"), ("d", b"plain"), ("e", b"\xff\x00\x01\x02")]
    df = spark.createDataFrame([(u, len(b), bytearray(b)) for u, b in rows], "url string, byte_count long, content binary")
    got = {r.url: (r.kind, r.confidence) for r in files.detect(df).collect()}
    assert got == {"a.md": ("markdown", 100), "b.bin": ("pdf", 100), "c": ("markdown", 82), "d": ("text", 72), "e": (None, 0)}


def test_catalog(spark):
    class Pages(stores.CatalogSource):
        @staticmethod
        def fetch(cursor, limit):
            one = [
                {"id": "1", "model": "sol", "displayName": "Sol", "isDefault": True}, {"id": "2", "model": "h", "displayName": "H", "hidden": True},
                {"id": "3", "model": "i", "displayName": "I", "inputModalities": ["image"]}, {"id": "4", "model": "n"},
            ]
            two = [{"id": "5", "model": "sol", "displayName": "Again"}, {"id": "6", "model": "terra", "displayName": "Terra"}]
            return (one, "page-2") if cursor is None else (two, None)

    spark.dataSource.register(Pages)
    rows = stores.visible_models(spark.read.format("loomtext_catalog").load()).orderBy("place").collect()
    assert [(r.model, r.isDefault) for r in rows] == [("sol", True), ("terra", False)]


def test_line_framing(spark):
    framer = stores.LineFramer(most=10)
    assert framer.push(b'{"a"') == [] and framer.push(b":1}\r\nx\n") == [b'{"a":1}', b"x"]
    with pytest.raises(ValueError):
        framer.push(b"y" * 11)
    assert framer.push(b"ok\n") == [b"ok"]
    df = spark.createDataFrame([(1, 0, bytearray(b"a\r\nb")), (1, 1, bytearray(b"c\nd"))], "stream int, seq int, bytes binary")
    assert [r.line for r in stores.framed_lines(df).orderBy("line_no").collect()] == ["a", "bc"]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "history.json")
    schema = "id string, backend string, created_at timestamp"
    assert stores.read_store(spark, path, schema).count() == 0
    rows = spark.createDataFrame([("b", None, 1), ("a", "llm", 2)], "id string, backend string, s long").select("id", "backend", F.timestamp_seconds("s").alias("created_at"))
    stores.write_store(rows, path, "id")
    stores.write_store(rows, path, "id")
    assert [(r.id, r.backend, r.created_at.second) for r in stores.read_store(spark, path, schema).orderBy("id").collect()] == [("a", "llm", 2), ("b", None, 1)]


def test_envelope_rules():
    good = '<segments version="1"><segment id="a"> x &amp; <![CDATA[<y>]]> </segment>\n<segment id="b">z</segment></segments>'
    assert envelope.parse_envelope(good) == [{"id": "a", "text": "x & <y>"}, {"id": "b", "text": "z"}]
    for bad in ("", "<segments>stray</segments>", '<segments><segment id="">x</segment></segments>', '<segments><segment id="a"><b/></segment></segments>', "<other/>", "<segments/><segments/>", '<segments><segment id="a">x</segments>'):
        assert envelope.parse_envelope(bad) is None


def test_retry_until_valid(spark):
    df = spark.createDataFrame([("p", '<segments version="1"><segment id="a">x</segment></segments>')], "page_index string, envelope string")
    calls = []

    def flaky(text):
        calls.append(1)
        return "nonsense" if len(calls) < 3 else '```xml\n<segments><segment id="a">done</segment></segments>\n```'

    row = envelope.translate_pages(df, flaky, pause=0.0).first()
    assert (row.tries, row.problem, row["items"][0].text) == (3, None, "done")
    lost = envelope.translate_pages(df, lambda t: '<segments><segment id="zz">x</segment></segments>', pause=0.0).first()
    assert lost.problem == "unknown: zz" and lost["items"] == []


def test_response_layouts(spark):
    bodies = [
        '{"output_text":" a "}', '{"output":[{"text":""},{"text":"b"}]}', '{"output":[{"content":[{"text":"c"},{"text":"d"}]}]}', '{"candidates":[{"content":{"parts":[{"text":"e"},{"text":"f"}]}}]}',
        '{"promptFeedback":{"blockReason":"SAFETY"}}', '{"candidates":[{"finishReason":"MAX_TOKENS"}]}', '{"candidates":[{"finishReason":"SPII"}]}', "{}",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", envelope.response_text(F.col("body")).alias("r")).orderBy("i")
    assert [(r.r.text, r.r.problem) for r in df.collect()] == [("a", None), ("b", None), ("c\nd", None), ("e\nf", None), (None, "blocked: SAFETY"), (None, "truncated"), (None, "blocked: SPII"), (None, "empty")]


def test_fan_out(spark):
    requests = spark.createDataFrame([(1, "hi")], "request_id int, text string")
    models = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "model string, place int")
    available = spark.createDataFrame([("a",), ("b",)], "model string")

    def model(name, text):
        if name == "b":
            raise RuntimeError("down")
        return f"{name}:{text}"

    rows = envelope.fan_out(requests, models, available, model).orderBy("place").collect()
    assert [(r.model, r.translated_text, r.error) for r in rows] == [("b", None, "down"), ("a", "a:hi", None), ("c", None, "unavailable")]


def test_columns_and_blocks(spark):
    rows = [("Left one", 50.0, 720.0), ("Left two", 50.0, 702.0), ("Right one", 330.0, 720.0), ("Right two", 330.0, 702.0)]
    df = spark.createDataFrame([(0, f"l{i}", t, x, y, 100.0, 12.0, 12.0, "black", "native") for i, (t, x, y) in enumerate(reversed(rows))], "page int, id string, text string, x double, y double, w double, h double, size double, color string, source string")
    laid = layout.laid_out(df).orderBy("reading_order").collect()
    assert [(r.text, r.column_index) for r in laid] == [(t, 0 if x < 100 else 1) for t, x, _ in rows]
    assert [r.text for r in layout.block_rows(layout.laid_out(df)).orderBy("block").collect()] == ["Left one Left two", "Right one Right two"]


def test_furniture(spark):
    rows = [("Translate this content", 700.0, 18.0), ("INTERNAL • Copyright ©2023 Example, Inc.", 20.0, 8.0), ("9", 20.0, 8.0)]
    df = spark.createDataFrame(rows, "text string, y double, size double")
    kept = df.where(~layout.is_furniture(F.col("text"), F.col("y"), F.col("size"), F.col("size"), F.lit(0.0), F.lit(792.0))).collect()
    assert [r.text for r in kept] == ["Translate this content"]


def test_markers(spark):
    df = spark.createDataFrame([("• a", True), ("12) b", True), ("3.", True), (".", True), ("12 c", False), ("word", False), ("", False)], "t string, want boolean")
    for r in df.select("t", "want", layout.starts_with_marker(F.col("t")).alias("got")).collect():
        assert r.got == r.want == layout._marked(r.t), r


def test_warnings(spark):
    pages = spark.createDataFrame([("d", p) for p in range(14)], "doc string, page int")
    warnings = pages.withColumn("tag", F.lit("hybrid")).select("doc", "tag", "page")
    assert aggregates.grouped_warnings(warnings.union(warnings), pages).first().pages == "all 14"
    some = warnings.where("page IN (0, 1, 2, 4)")
    assert aggregates.grouped_warnings(some, pages).first().pages == "1-3, 5"


def test_robust_statistics(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 4.0],)], "v array<double>").select(aggregates.upper_median(F.col("v")).alias("m"), aggregates.median_deviation(F.col("v")).alias("d")).first()
    assert (df.m, df.d) == (3.0, 1.0)
    lines = spark.createDataFrame([(1, 10.0, 100.0, 10.0), (1, 10.0, 80.0, 10.0), (1, 10.0, 60.0, 10.0)], "b int, x double, w double, size double")
    assert aggregates.block_alignment(lines, "b").first().alignment == "left"
    words = spark.createDataFrame([(1, 0, "trans-"), (1, 1, "lation"), (1, 2, "done")], "b int, o int, t string")
    assert aggregates.joined_text(words, "o", "t", "b").first().text == "translation done"


def test_packages(spark):
    body = exports.package_bytes([("b.xml", b"2"), ("a.xml", b"1")])
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        assert z.namelist() == ["a.xml", "b.xml"] and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.testzip() is None
    with pytest.raises(ValueError):
        exports.package_bytes([("a", b""), ("a", b"")])
    parts = spark.createDataFrame([("x/_rels/p.rels", '<Relationship Id="1" Target="../y/q.xml"/><Relationship Target="gone.xml"/><Relationship Target="https://e"/>'), ("y/q.xml", "")], "name string, data string")
    assert [r.part for r in joins.dangling_targets(parts).collect()] == ["x/gone.xml"]


def test_output_names(spark):
    wanted = spark.createDataFrame([("u1", "f", "a", "ko", "txt"), ("u2", "f", "a", "ko", "txt"), ("u3", "f", "b", "ko", "")], "url string, folder string, base string, lang string, ext string")
    taken = spark.createDataFrame([("f", "a.ko.translated.txt")], "folder string, name string")
    got = {r.url: r.output for r in exports.output_names(wanted, taken).collect()}
    assert got == {"u1": "a.ko.translated (2).txt", "u2": "a.ko.translated (3).txt", "u3": "b.ko.translated"}


def test_delays(spark):
    rows = [("3", 0), ("Thu, 26 Nov 2026 10:00:02 GMT", 0), (None, 2), ("99", 0), ("x", 0)]
    df = spark.createDataFrame(rows, "h string, n int").select(timing.retry_delay(F.col("h"), F.col("n"), F.lit("2026-11-26 10:00:00").cast("timestamp")).alias("s"))
    assert [r.s for r in df.collect()] == [3.0, 2.0, 1.0, 5.0, 0.25]


def test_small_choices(spark):
    one = spark.range(1)
    row = one.select(
        strings.display_code(F.lit("zh_TW"), True).alias("a"), strings.ocr_hint(F.lit("zh-CN")).alias("b"), strings.error_text(F.lit("Bad"), F.lit("bad request")).alias("c"), strings.first_message(F.lit(" "), F.lit(None), F.lit(3)).alias("d"),
        strings.is_model_id(F.lit("model-1.5_pro")).alias("e"), strings.is_model_id(F.lit("-x")).alias("f"), strings.is_language_tag(F.lit("zh-Hans-CN")).alias("g"), strings.strip_fence(F.lit("```xml\n<a/>\n```")).alias("h"),
        strings.markdown_run(F.lit("a`b"), F.lit(True), F.lit(True), F.lit(True), F.lit("u")).alias("i"), strings.swap_languages(F.lit("auto"), F.lit("ko")).alias("j"), geometry.run_scale(F.lit(50.0), F.lit(100.0)).alias("k"),
        scene.text_visual_policy(F.array(F.struct(F.lit(True).alias("safe"), F.lit(True).alias("editable")))).alias("l"), envelope.has_exact_keys(F.lit('{"translation":1}'), "translation").alias("m"), strings.zip_adjacent(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("n"),
    ).first()
    assert row.a == "zh-Hant-TW" and row.b == "zh-Hans" and row.c == "bad request" and row.d == "code 3" and row.e and not row.f and row.g and row.h == "<a/>"
    assert row.i == "<u>***[a\\`b](u)***</u>" and tuple(row.j) == ("ko", "en") and row.k == 0.72 and row.l == "replace" and row.m and [tuple(x) for x in row.n] == [("a", "b"), ("b", "c")]


def test_contained_rectangles(spark):
    rows = [(0, "a", 0.0, 0.0, 100.0, 100.0, 0, True, False), (0, "b", 10.0, 10.0, 20.0, 20.0, 1, True, False), (0, "c", 10.0, 10.0, 20.0, 20.0, 2, True, True), (0, "d", -5.0, -5.0, 200.0, 200.0, 3, True, False)]
    df = spark.createDataFrame([(*r, 0.5, 0.5, 0.5) for r in rows], "page int, id string, x double, y double, w double, h double, paint_order int, opaque boolean, stroked boolean, r double, g double, b double")
    assert sorted(r.id for r in layout.without_contained(df).collect()) == ["c", "d"]


def test_reflow():
    assert scene.reflow("one two three four", [7.0, 9.0, 99.0], len) == ["one two", "three", "four"]
    assert scene.reflow("short", [10.0, 10.0], len) == ["short", ""]


def test_merges(spark):
    local, loaded = spark.createDataFrame([("a",), ("n",)], "id string"), spark.createDataFrame([("a",), ("b",), ("x",)], "id string")
    deleted = spark.createDataFrame([("x",)], "id string")
    assert sorted(r.id for r in joins.merge_on_load(local, loaded, deleted).collect()) == ["a", "b", "n"]
    assert sorted(r.id for r in joins.merge_on_load(local, loaded, deleted, cleared=True).collect()) == ["a", "n"]
    devices = spark.createDataFrame([("Mic A", "m1", 0), ("Mic B", "m2", 1)], "label string, name string, place int")
    wanted = spark.createDataFrame([(1, "mic b"), (2, "m1"), (3, "B"), (4, "zz")], "request_id int, wanted string")
    assert {r.request_id: r.device for r in joins.resolve_device(wanted, devices, ["m2"]).collect()} == {1: "m2", 2: "m1", 3: "m2", 4: "m2"}


def test_merged_boxes(spark):
    schema = "page int, id string, text string, x double, y double, w double, h double, size double, role string, alignment string"
    rows = [(0, "a", "one", 50.0, 700.0, 100.0, 12.0, 12.0, "editableContent", "left"), (0, "b", "two", 52.0, 680.0, 90.0, 12.0, 12.0, "editableContent", "left"), (0, "c", "far", 50.0, 600.0, 90.0, 12.0, 12.0, "editableContent", "left"), (0, "d", "big", 50.0, 590.0, 90.0, 12.0, 30.0, "editableContent", "left")]
    got = {r.id: r.text for r in layout.merged_boxes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"merged-a-b": "one\ntwo", "c": "far", "d": "big"}


def test_floating_boxes_by_level(spark):
    row = spark.range(1).select(*[scene.needs_floating_box(F.lit(0), F.lit(2), F.array(F.lit("f")), F.lit(False), F.array(F.lit(0.0), F.lit(8.0)), F.lit(10.0), F.lit("left"), x).alias(x) for x in ("never", "conservative", "balanced", "permissive")]).first()
    assert tuple(row) == (False, False, True, True)


def test_footer_neighbours(spark):
    schema = "page int, id string, x double, y double, w double, h double, size double, r double, g double, b double, source string, page_height double"
    rows = [(0, "seed", 50.0, 20.0, 100.0, 8.0, 8.0, 0.0, 0.0, 0.0, "native", 792.0), (0, "near", 160.0, 20.0, 100.0, 8.0, 8.0, 0.1, 0.0, 0.0, "native", 792.0), (0, "red", 160.0, 30.0, 100.0, 8.0, 8.0, 1.0, 0.0, 0.0, "native", 792.0), (0, "hop", 270.0, 20.0, 100.0, 8.0, 8.0, 0.1, 0.0, 0.0, "native", 792.0)]
    df = spark.createDataFrame(rows, schema)
    assert [r.id for r in joins.touching_chrome(df.where("id <> 'seed'"), df.where("id = 'seed'"), ("page",)).collect()] == ["near"]
