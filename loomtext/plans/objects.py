"""Queries on files' metadata, scene objects, packages, options, histories and text pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import geometry, strings
from loomtext.operators import aggregates, envelope, joins, layout, scene
from loomtext.plans._data import PAGE_LINES_SQL, page_lines, table
from loomtext.plans.relations import AGG3, AGG6, agg3_edges
from loomtext.sinks import exports
from loomtext.sources import files

_MARKER = r"""(regexp_extract(trim(regexp_replace({0}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')), '^[^ ]*') IN ('•', '◦', '○', '●', '▪', '▫', '‣', '⁃', '-', '–', '—', '*', 'o', 'O', '0', chr(61623))
  OR regexp_matches(regexp_extract(trim(regexp_replace({0}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')), '^[^ ]*'), '^\p{{N}}*[.)]+$'))"""


def _bit(n: int, of: str = "event_id"):
    return F.col(of) % n == 0


def src10_pdf_problems(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".txt", "", ".pdf"))), (F.col("event_id") % 5 + 1).cast("int"))
    meta = table(spark, d, "events").select(F.concat(F.lit("a.b/f"), F.col("event_id").cast("string"), ext).alias("url"), (~_bit(7)).alias("has_header"), _bit(11).alias("locked"), (~_bit(13)).alias("may_change"), _bit(17).alias("is_signed"), _bit(19).alias("has_form"), (F.col("event_id") % 23).alias("page_count"))
    return files.pdf_problems(meta)


SRC10 = """
WITH m AS (SELECT event_id AS i, 'a.b/f' || event_id || ['.pdf', '.PDF', '.txt', '', '.pdf'][event_id % 5 + 1] AS url FROM events),
p AS (SELECT url, CASE WHEN lower(regexp_extract(url, '[^/]*$')) NOT LIKE '%.pdf' THEN 'not a pdf' WHEN i % 7 = 0 THEN 'bad header' WHEN i % 11 = 0 THEN 'locked' WHEN i % 13 = 0 THEN 'changes not permitted' WHEN i % 17 = 0 THEN 'signed' WHEN i % 19 = 0 THEN 'form' WHEN i % 23 = 0 THEN 'empty' END AS problem FROM m)
SELECT url, problem FROM p WHERE problem IS NOT NULL
"""


def fil7_hidden(spark, d):
    e = table(spark, d, "events")
    shade = lambda k: (F.col("event_id") % k) / F.lit(100.0)
    light = lambda v: geometry.relative_luminance(v, v, v)
    ink, ground = shade(41), shade(37)
    contrast = geometry.contrast_ratio(light(ink), light(ground))
    return e.where(~layout.is_hidden(_bit(2), _bit(3), 3 * F.pow(ink - ground, 2), contrast)).select("event_id")


FIL7 = """
WITH e AS (SELECT event_id, (event_id % 41) / 100.0::DOUBLE AS a, (event_id % 37) / 100.0::DOUBLE AS b FROM events),
l AS (SELECT *, CASE WHEN a <= 0.03928 THEN a / 12.92 ELSE pow((a + 0.055) / 1.055, 2.4) END AS la, CASE WHEN b <= 0.03928 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS lb FROM e)
SELECT event_id FROM l WHERE NOT (event_id % 2 = 0 AND event_id % 3 <> 0 AND 3 * pow(a - b, 2) <= 0.0025 AND (greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) <= 1.08)
"""


def fil8_pages(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 60).alias("blocks"))
    return scene.pages_with_blocks(pages).select("doc_id", F.size("blocks").alias("blocks"))


FIL8 = "SELECT doc_id, CAST(len(b) AS INTEGER) AS blocks FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 60) AS b FROM documents) WHERE len(b) > 0"


def prj3_options(spark, d):
    level = lambda k: F.element_at(F.array(*map(F.lit, ("never", "conservative", "balanced", "permissive"))), (F.col("p_partkey") % k % 4 + 1).cast("int"))
    options = table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "pptx").otherwise("docx").alias("format"), level(5).alias("slide_merge_level"), level(7).alias("document_merge_level"), (F.col("p_size") % 3 == 0).alias("header_footer"), (F.col("p_size") % 4 == 0).alias("master"), (F.col("p_size") % 5 == 0).alias("keep_transparency"), (F.col("p_size") * 100).alias("raster_side"))
    out = scene.pipeline_options(options)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


PRJ3 = """
WITH p AS (SELECT *, p_size % 2 = 0 AS s, ['never', 'conservative', 'balanced', 'permissive'] AS l FROM part)
SELECT CASE WHEN s THEN 'pptx' ELSE 'docx' END AS format, l[p_partkey % CASE WHEN s THEN 5 ELSE 7 END % 4 + 1] AS merge_level, NOT s AND p_size % 3 = 0 AS header_footer, s AND p_size % 4 = 0 AS master, p_size % 5 = 0 AS keep_transparency,
  CAST(CASE WHEN s THEN 2400 ELSE least(100 * p_size, 3200) END AS INTEGER) AS raster_side, count(*) AS n FROM p GROUP BY ALL
"""


def grp4_list_alignment(spark, d):
    lines = page_lines(table(spark, d, "documents")).withColumn("block", F.floor(F.col("i") / 3)).withColumn("reading_order", F.col("i")).withColumn("alignment", F.when(F.col("i") % 2 == 0, "center").otherwise("right"))
    lines = lines.withColumn("text", F.when(F.col("i") % 9 == 0, F.concat(F.lit(" • "), "text")).when(F.col("i") % 9 == 3, F.concat(F.lit("12) "), "text")).otherwise(F.col("text")))
    return layout.list_alignment(lines, "doc", "page").select("id", "alignment")


GRP4 = f"""
WITH {PAGE_LINES_SQL}, l AS (SELECT id, doc, page, i, CASE i % 9 WHEN 0 THEN ' • ' || text WHEN 3 THEN '12) ' || text ELSE text END AS t FROM placed),
f AS (SELECT id, i, first_value(t) OVER (PARTITION BY doc, page, i // 3 ORDER BY i) AS head FROM l)
SELECT id, CASE WHEN {_MARKER.format('head')} THEN 'left' WHEN i % 2 = 0 THEN 'center' ELSE 'right' END AS alignment FROM f
"""


def agg4_promoted(spark, d):
    """Edge lines that recur become page furniture; some lines are that already."""
    lines, pages = agg3_edges(spark, d)
    lines = lines.withColumn("is_chrome", F.col("page") % 17 == 0)
    return aggregates.promote_edges(lines, aggregates.repeated_edges(lines, pages)).groupBy("doc", "page").agg(F.count_if("is_chrome").alias("chrome"), F.count("*").alias("lines"))


_PAGE_KEY = r"CASE WHEN regexp_matches(key, '^\p{Nd}+$') THEN '__page_number__' ELSE key END"
AGG4 = f"""
WITH rep AS ({AGG3}), {PAGE_LINES_SQL}, e AS (
  SELECT doc, page, CASE WHEN i < 2 THEN 'header' ELSE 'footer' END AS band, CAST(round(size / 0.5) AS BIGINT) AS font,
         CASE WHEN page % 13 < 7 THEN 'page header ' || page % 2 ELSE lower(trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) END AS key FROM placed WHERE i < 2 OR i >= n - 2
), k AS (SELECT doc, page, band, font, {_PAGE_KEY} AS key FROM e)
SELECT k.doc, k.page, count(*) FILTER (WHERE k.page % 17 = 0 OR rep.key IS NOT NULL) AS chrome, count(*) AS lines FROM k LEFT JOIN rep USING (doc, band, key, font) GROUP BY 1, 2
"""


def jn12_conversations(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), _bit(2).alias("provisional"), (F.col("event_id") % 5).alias("message_count"), F.lit("local").alias("side"))
    loaded = rows.withColumn("side", F.lit("loaded"))
    return joins.merge_conversations(rows.where("id % 3 = 0"), loaded).select("id", "side")


JN12 = """
WITH l AS (SELECT event_id AS id FROM events WHERE event_id % 3 = 0 AND NOT (event_id % 2 = 0 AND event_id % 5 = 0))
SELECT id, 'local' AS side FROM l UNION ALL SELECT event_id, 'loaded' FROM events WHERE event_id NOT IN (SELECT id FROM l)
"""


def jn18_client_responses(spark, d):
    said = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 3 != 0, F.concat_ws("-", "conv_id", "turn")).alias("id"), F.col("turn").alias("ordinal"), "text")
    return envelope.map_client_responses(said).select("conv_id", "ordinal", "id", "problem")


JN18 = "SELECT conv_id, turn AS ordinal, CASE WHEN turn % 3 <> 0 THEN conv_id || '-' || turn END AS id, CASE WHEN turn % 3 = 0 THEN 'no client id at ' || turn END AS problem FROM conversations"


def srt4_overlays(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("event_id") % 7).alias("paint_order"), (F.col("event_id") * 7919 % 104729).alias("inserted"), (F.col("user_id") % 2 == 0).alias("raster_fallback"))
    slides, documents = (layout.overlay_order(rows, s).select("page", "id", F.col("z").cast("long").alias("z"), F.lit(n).alias("target")) for s, n in ((True, "slides"), (False, "documents")))
    return slides.unionByName(documents)


SRT4 = """
WITH e AS (SELECT user_id AS page, event_id AS id, event_type AS kind, event_id % 7 AS o, event_id * 7919 % 104729 AS ins FROM events)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY o, kind, id) - 1 AS z, 'slides' AS target FROM e
UNION ALL SELECT page, id, CASE WHEN page % 2 = 0 THEN row_number() OVER (PARTITION BY page ORDER BY o, kind, id) ELSE row_number() OVER (PARTITION BY page ORDER BY ins) END - 1, 'documents' FROM e
"""


def srt6_latest_three(spark, d):
    """The three newest entries of the history: a report of three rows by its nature."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("created_at"))
    return exports.newest_first(rows, most=3).select("id")


SRT6 = "SELECT event_id AS id FROM events ORDER BY date_trunc('minute', ts) DESC, event_id LIMIT 3"


def set4_plan_without_background(spark, d):
    from loomtext.plans.relations import agg6_master_plan

    plan = agg6_master_plan(spark, d)
    grounds = plan.where("kind = 'text'").groupBy("doc").agg(F.min("key").alias("key"))
    return scene.without_background(plan, grounds).select("doc", "kind", "key", "count")


SET4 = f"WITH p AS ({AGG6}), g AS (SELECT doc, min(key) AS key FROM p WHERE kind = 'text' GROUP BY doc) SELECT p.doc, kind, p.key, count FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc = p.doc AND g.key = p.key)"


def set6_exact_keys(spark, d):
    k = F.col("turn") % 4
    json = F.when(k == 0, F.to_json(F.struct(F.col("text").alias("translation")))).when(k == 1, F.to_json(F.struct("role", F.col("text").alias("translation")))).when(k == 2, F.to_json(F.struct(F.col("text").alias("Translation")))).otherwise(F.lit("{}"))
    return table(spark, d, "conversations").select("conv_id", "turn", envelope.has_exact_keys(json, "translation").alias("exact"), envelope.has_exact_keys(json, "translation", "role").alias("both"))


SET6 = """
WITH j AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN json_object('translation', text) WHEN 1 THEN json_object('role', role, 'translation', text) WHEN 2 THEN json_object('Translation', text) ELSE json('{}') END AS j FROM conversations)
SELECT conv_id, turn, list_sort(json_keys(j)) = ['translation'] AS exact, list_sort(json_keys(j)) = ['role', 'translation'] AS "both" FROM j
"""


def arr_lines(spark, d):
    parts = F.split("text", "\n")
    pairs = strings.zip_adjacent(parts)
    return table(spark, d, "documents").select("doc_id", F.md5(strings.safe_get(parts, 3)).alias("fourth"), strings.safe_get(parts, -1).alias("before"), F.size(pairs).alias("pairs"), F.md5(F.array_join(F.transform(pairs, lambda p: F.concat(p["b"], F.lit("<"), p["a"])), "|")).alias("digest"))


ARR = """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, md5(p[4]) AS fourth, CAST(NULL AS VARCHAR) AS before, CAST(greatest(0, len(p) - 1) AS INTEGER) AS pairs, md5(array_to_string(list_transform(range(1, len(p)), lambda i: p[i + 1] || '<' || p[i]), '|')) AS digest FROM s
"""


def mth9_alignment(spark, d):
    shift = F.element_at(F.array(*map(F.lit, (0.0, 60.0, 118.0, 200.0))), (F.col("i") % 4 + 1).cast("int"))
    width = F.least(F.col("w"), F.lit(300.0)) / F.when(F.col("i") % 3 == 0, 1.0).otherwise(2.0)
    lines = page_lines(table(spark, d, "documents"))
    return lines.select("id", geometry.inferred_alignment(F.col("x") + shift, width, F.col("x"), F.lit(240.0), F.col("size"), layout.starts_with_marker(F.col("text"))).alias("alignment"))


MTH9 = f"""
WITH {PAGE_LINES_SQL}, l AS (SELECT id, text, [0.0, 60.0, 118.0, 200.0][i % 4 + 1]::DOUBLE AS before, least(w, 300.0) / CASE WHEN i % 3 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, least(greatest(0.8 * size, 5.0), 18.0)::DOUBLE AS t FROM placed),
a AS (SELECT *, 240 - before - w AS after FROM l)
SELECT id, CASE WHEN {_MARKER.format('text')} OR w >= 240 THEN 'left' WHEN abs(before - after) / 2 <= t AND before > t AND after > t THEN 'center' WHEN abs(after) <= t AND before > 2 * t THEN 'right' ELSE 'left' END AS alignment FROM a
"""


def map5_preferred(spark, d):
    results = table(spark, d, "events").select("user_id", "event_id", F.when(~_bit(4), F.concat_ws("-", "event_type", "event_id")).alias("translated_text"), (F.col("event_id") * 7919 % 104729).alias("priority"))
    return envelope.preferred_result(results, "user_id", order="event_id").select("user_id", "translated_text", "priority")


MAP5 = "SELECT user_id, max_by(event_type || '-' || event_id, event_id * 7919 % 104729) AS translated_text, max(event_id * 7919 % 104729) AS priority FROM events WHERE event_id % 4 <> 0 GROUP BY 1"


def dq4_changed_pages(spark, d):
    docs = table(spark, d, "documents")
    box = lambda move: F.array(*[F.array(F.lit(0.0) + move, F.lit(0.0), F.lit(612.0), F.lit(792.0)) for _ in range(5)])
    before = docs.where("doc_id % 23 <> 0").select(F.col("doc_id").alias("page"), box(F.lit(0.0)).alias("boxes"), (F.col("doc_id") % 4 * 90).alias("rotation"))
    moved = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 3 / 2.0).otherwise(F.lit(0.0))
    after = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("page"), box(moved).alias("boxes"), (F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("doc_id")) % 4 * 90).alias("rotation"))
    return scene.changed_pages(before, after)


DQ4 = """
WITH b AS (SELECT doc_id AS page, doc_id % 4 * 90 AS r FROM documents WHERE doc_id % 23 <> 0), a AS (SELECT doc_id AS page, CASE WHEN doc_id % 7 = 0 THEN doc_id % 3 / 2.0 ELSE 0 END AS x, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 4 * 90 END AS r FROM documents WHERE doc_id % 13 <> 0),
j AS (SELECT page, CASE WHEN a.r IS NULL OR b.r IS NULL THEN 'page count' WHEN a.r <> b.r THEN 'rotation' WHEN abs(x) > 0.5 THEN 'box' END AS problem FROM b FULL JOIN a USING (page))
SELECT page, problem FROM j WHERE problem IS NOT NULL
"""


def dq6_analysis(spark, d):
    lines = page_lines(table(spark, d, "documents")).select("page", "i", "id")
    lines = lines.unionByName(lines.where("i % 19 = 3"))
    named = F.when(F.col("i") % 13 == 4, F.concat("id", F.lit("?"))).otherwise(F.col("id"))
    blocks = lines.where("i % 17 <> 5").groupBy("page", F.floor(F.col("i") / 3).alias("block")).agg(F.collect_set(named).alias("line_ids"))
    return scene.analysis_problems(lines.select("page", "id"), blocks)


DQ6 = f"""
WITH {PAGE_LINES_SQL}, n AS (SELECT DISTINCT page, CASE WHEN i % 13 = 4 THEN id || '?' ELSE id END AS name FROM placed WHERE i % 17 <> 5)
SELECT page, 'no block: ' || id AS problem FROM placed WHERE i % 17 = 5 OR i % 13 = 4
UNION ALL SELECT page, 'no block: ' || id FROM placed WHERE (i % 17 = 5 OR i % 13 = 4) AND i % 19 = 3
UNION ALL SELECT page, 'unknown line: ' || name FROM n WHERE name LIKE '%?'
UNION ALL SELECT page, 'repeated line: ' || id FROM placed WHERE i % 19 = 3
"""


def dq3_packages(spark, d):
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<a><b>"), strings.xml_escape(F.col("text")), F.lit("</a></b>"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("<a><b>"), "text", F.lit("</b></a>"))).otherwise(F.concat(F.lit("<a><b>"), strings.xml_escape(F.col("text")), F.lit("</b></a>")))
    parts = table(spark, d, "documents").select(F.concat_ws("-", "source", F.col("doc_id") % 7).alias("package"), F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"), body.cast("binary").alias("data"))
    return exports.part_problems(parts, ["p3.xml", "[Content_Types].xml"])


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
DQ3 = f"""
WITH p AS (SELECT source || '-' || doc_id % 7 AS package, 'p' || doc_id || '.xml' AS name, CASE doc_id % 5 WHEN 0 THEN '<a><b>' || {_ESC} || '</a></b>' WHEN 1 THEN '<a><b>' || text || '</b></a>' ELSE '<a><b>' || {_ESC} || '</b></a>' END AS data FROM documents)
SELECT package, 'malformed: ' || name AS problem FROM p WHERE NOT regexp_full_match(data, '(?s)<a><b>([^<&]|&(amp|lt|gt|quot|apos);)*</b></a>') OR contains(data, ']]>')
UNION ALL SELECT package, 'missing: ' || r FROM (SELECT DISTINCT package FROM p) u, (VALUES ('p3.xml'), ('[Content_Types].xml')) v(r) WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.package = u.package AND q.name = r)
"""


def snk7_packages(spark, d):
    parts = table(spark, d, "documents").select(F.concat_ws("-", "source", "lang", F.col("doc_id") % 50).alias("package"), F.concat(F.lit("part"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("data"))
    packed = exports.packages(parts)
    end = F.substring("content", -22, 22)
    return packed.select("package", F.octet_length("content").alias("bytes"), F.hex(F.substring("content", 1, 4)).alias("first"), F.hex(F.substring(end, 1, 4)).alias("end"), F.conv(F.concat(F.hex(F.substring(end, 12, 1)), F.hex(F.substring(end, 11, 1))), 16, 10).cast("int").alias("parts"))


# a stored part has 30 bytes and its name before its data and 46 and its name in the directory, which ends with 22
SNK7 = """
SELECT source || '-' || lang || '-' || doc_id % 50 AS package, CAST(sum(76 + 2 * length('part' || doc_id || '.txt') + octet_length(encode(text))) + 22 AS INTEGER) AS bytes, '504B0304' AS first, '504B0506' AS "end", CAST(count(*) AS INTEGER) AS parts FROM documents GROUP BY 1
"""


def seg12_runs(spark, d):
    e = F.col("page_id")
    run = strings.markdown_run(F.concat("html", F.lit("\\ `x`")), e % 2 == 0, e % 3 == 0, e % 5 == 0, F.when(e % 7 == 0, F.col("url")))
    return table(spark, d, "pages").select("page_id", F.md5(run).alias("digest"))


SEG12 = r"""
WITH t AS (SELECT page_id AS i, url, replace(replace(html || '\ `x`', '\', '\\'), '`', '\`') AS t FROM pages),
a AS (SELECT i, CASE WHEN i % 7 = 0 THEN '[' || t || '](' || url || ')' ELSE t END AS t FROM t), b AS (SELECT i, CASE WHEN i % 3 = 0 THEN '*' || t || '*' ELSE t END AS t FROM a), c AS (SELECT i, CASE WHEN i % 2 = 0 THEN '**' || t || '**' ELSE t END AS t FROM b)
SELECT i AS page_id, md5(CASE WHEN i % 5 = 0 THEN '<u>' || t || '</u>' ELSE t END) AS digest FROM c
"""


def jn8_rectangles(spark, d):
    """Fifty rectangles a page, of whole points, so that containment is transitive and what stays doesn't depend on the order."""
    e = table(spark, d, "events")
    box = {"x": F.col("event_id") * 31 % 23, "y": F.col("event_id") * 17 % 19, "w": F.col("event_id") * 13 % 53 + 3, "h": F.col("event_id") * 7 % 47 + 3}
    rects = e.select(F.floor(F.col("event_id") / 50).alias("page"), F.col("event_id").alias("id"), F.col("event_id").alias("paint_order"), *[(4.0 * v).alias(k) for k, v in box.items()], *[(F.col("event_id") % 3 / F.lit(10.0)).alias(c) for c in "rgb"], (~_bit(11)).alias("opaque"), _bit(13).alias("stroked"))
    return layout.without_contained(rects, "page").select("page", "id")


JN8 = """
WITH r AS (SELECT event_id // 50 AS page, event_id AS id, 4 * (event_id * 31 % 23) AS x, 4 * (event_id * 17 % 19) AS y, 4 * (event_id * 13 % 53 + 3) AS w, 4 * (event_id * 7 % 47 + 3) AS h, event_id % 3 AS c, event_id % 11 <> 0 AND event_id % 13 <> 0 AS p FROM events)
SELECT page, id FROM r b WHERE NOT p OR NOT EXISTS (SELECT 1 FROM r a WHERE a.page = b.page AND a.p AND a.c = b.c AND a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h AND a.w >= b.w + 2 AND a.h >= b.h + 2)
"""

def src3_decoded(spark, d):
    """Texts as files in UTF-8 without and with a mark, UTF-16 and Latin-1, read and written again."""
    k = F.col("doc_id") % 4
    body = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(k == 2, F.encode("text", "UTF-16")).otherwise(F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1"))
    rows = table(spark, d, "documents").select("doc_id", body.alias("content")).withColumn("d", files.decoded("content"))
    same = files.encoded(F.col("d.text"), F.col("d.encoding"), F.col("d.mark")) == F.col("content")
    return rows.select("doc_id", F.col("d.encoding").alias("encoding"), F.col("d.mark").alias("mark"), F.md5(F.encode("d.text", "UTF-8")).alias("digest"), same.alias("same"))


SRC3 = r"""
WITH t AS (SELECT doc_id, doc_id % 4 AS k, CASE WHEN doc_id % 4 = 3 THEN regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN k = 2 AND text <> '' THEN 'utf-16-be' WHEN k = 3 AND regexp_matches(text, '[\x{80}-\x{FF}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding, k = 1 OR (k = 2 AND text <> '') AS mark, md5(text) AS digest, true AS same FROM t
"""


def agg6_background(spark, d):
    """The commonest ground of each source's pages, here their language and a part of their number."""
    rows = table(spark, d, "documents").select(F.col("source").alias("doc"), F.concat_ws("/", "lang", F.col("doc_id") % 3).alias("key"))
    return aggregates.master_background(rows)


BACKGROUND = "WITH n AS (SELECT source AS doc, lang || '/' || doc_id % 3 AS key, count(*) AS c FROM documents GROUP BY 1, 2) SELECT doc, max_by(key, (c, key)) AS key FROM n GROUP BY doc"

QUERIES = {
    "src3_decoded": src3_decoded, "agg6_background": agg6_background,
    "src10_pdf_problems": src10_pdf_problems, "fil7_hidden": fil7_hidden, "fil8_pages": fil8_pages, "prj3_options": prj3_options, "grp4_list_alignment": grp4_list_alignment, "agg4_promoted": agg4_promoted, "jn12_conversations": jn12_conversations,
    "jn18_client_responses": jn18_client_responses, "srt4_overlays": srt4_overlays, "srt6_latest_three": srt6_latest_three, "set4_plan_without_background": set4_plan_without_background, "set6_exact_keys": set6_exact_keys, "arr_lines": arr_lines,
    "mth9_alignment": mth9_alignment, "map5_preferred": map5_preferred, "dq4_changed_pages": dq4_changed_pages, "dq6_analysis": dq6_analysis, "dq3_packages": dq3_packages, "snk7_packages": snk7_packages, "seg12_runs": seg12_runs, "jn8_rectangles": jn8_rectangles,
}
ORACLE_SQL = {
    "src3_decoded": SRC3, "agg6_background": BACKGROUND,
    "src10_pdf_problems": SRC10, "fil7_hidden": FIL7, "fil8_pages": FIL8, "prj3_options": PRJ3, "grp4_list_alignment": GRP4, "agg4_promoted": AGG4, "jn12_conversations": JN12, "jn18_client_responses": JN18, "srt4_overlays": SRT4,
    "srt6_latest_three": SRT6, "set4_plan_without_background": SET4, "set6_exact_keys": SET6, "arr_lines": ARR, "mth9_alignment": MTH9, "map5_preferred": MAP5, "dq4_changed_pages": DQ4, "dq6_analysis": DQ6, "dq3_packages": DQ3, "snk7_packages": SNK7,
    "seg12_runs": SEG12, "jn8_rectangles": JN8,
}
