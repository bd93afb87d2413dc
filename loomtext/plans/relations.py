"""Queries on conversations, events and page layouts: joins, aggregates, windows, transcripts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomtext.functions import geometry, hashing, variants
from loomtext.operators import aggregates, envelope, joins, layout, sentences, turns
from loomtext.plans._data import PAGE_LINES_SQL, page_lines, table, turn_events
from loomtext.sinks import exports
from loomtext.sources import stores
from loomtext.streaming import flow


def src8_live_frames(spark, d):
    """Frames built from conversation turns and read back as events."""
    said = table(spark, d, "conversations").where("role <> 'system'")
    user = F.col("role") == "user"
    content = F.struct(
        F.when(user, F.struct(F.col("text"), F.lit("en").alias("languageCode"))).alias("inputTranscription"),
        F.when(~user, F.struct(F.col("text"), F.lit("ko").alias("languageCode"))).alias("outputTranscription"),
        F.when(~user, F.struct(F.array(F.struct(F.struct(F.base64(F.substring("text", 1, 9).cast("binary")).alias("data")).alias("inlineData"))).alias("parts"))).alias("modelTurn"),
        (~user).alias("turnComplete"),
    )
    frames = said.select("conv_id", F.col("turn").alias("seq"), F.to_json(F.struct(content.alias("serverContent"))).alias("frame"))
    return stores.live_events(frames, "conv_id").select("conv_id", "seq", "ordinal", "tag", "language_code", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.length("data").alias("bytes"))


SRC8 = r"""
WITH c AS (SELECT conv_id, turn AS seq, role, regexp_replace(regexp_replace(text, '^[\s\x{85}\p{Z}]+', ''), '[\s\x{85}\p{Z}]+$', '') AS text, text AS raw FROM conversations WHERE role <> 'system'), e AS (
  SELECT conv_id, seq, 0 AS k, 'inputTranscript' AS tag, 'en' AS language_code, text, NULL AS bytes FROM c WHERE role = 'user' AND text <> ''
  UNION ALL SELECT conv_id, seq, 0, 'outputTranscript', 'ko', text, NULL FROM c WHERE role <> 'user' AND text <> ''
  UNION ALL SELECT conv_id, seq, 1, 'audio', NULL, '', octet_length(encode(substr(raw, 1, 9))) FROM c WHERE role <> 'user'
  UNION ALL SELECT conv_id, seq, 2, 'turnComplete', NULL, '', NULL FROM c WHERE role <> 'user'
)
SELECT conv_id, seq, CAST(row_number() OVER (PARTITION BY conv_id, seq ORDER BY k) - 1 AS INTEGER) AS ordinal, tag, language_code, md5(text) AS digest, CAST(bytes AS INTEGER) AS bytes FROM e
"""


def stm_transcripts(spark, d):
    """Change log of the conversations, assembled turn by turn."""
    return turns.assemble(turn_events(table(spark, d, "conversations"))).select("conv_id", "speaker", "seq", "step", "change", "id", F.md5("original").alias("original"), F.md5("translated").alias("translated"))


def stm6_messages(spark, d):
    return turns.latest_messages(turns.assemble(turn_events(table(spark, d, "conversations"))))


def seg9_sentences(spark, d):
    said = table(spark, d, "conversations")
    s = sentences.sentences(F.col("text"))
    return said.select("conv_id", "turn", "role", s.alias("s")).select("conv_id", "turn", "role", F.size("s.completed").alias("completed"), F.md5(F.array_join("s.completed", "|")).alias("digest"), F.length("s.remainder").alias("rest"))


def jn14_pairs(spark, d):
    said = table(spark, d, "conversations")
    return turns.zipped(said.where("role = 'user'"), said.where("role = 'assistant'"), "conv_id", "turn", "text", "text").select("conv_id", "k", F.md5("a").alias("a"), F.md5("b").alias("b"))


JN14 = """
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations WHERE role = 'user'),
     v AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, CAST(k AS INTEGER) AS k, md5(u.text) AS a, md5(v.text) AS b FROM u JOIN v USING (conv_id, k)
"""


def snk1_csv(spark, d):
    said = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.lit("t, 1").alias("title"), F.col("role").alias("speaker"), F.col("text").alias("original"), F.lit('a "b"').alias("translated"), F.timestamp_seconds(F.col("turn")).alias("at"))
    return exports.conversation_csv(said).select("conv_id", F.md5("csv").alias("digest"), F.length("csv").alias("n"))


SNK1 = r'''
WITH r AS (
  SELECT conv_id, turn, '"t, 1","' || strftime(to_timestamp(turn) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') || '","' || replace(role, '"', '""') || '","' || replace(text, '"', '""') || '","a ""b"""' AS row FROM conversations
), c AS (
  SELECT conv_id, chr(65279) || '"conversation_title","timestamp","speaker","original_text","translated_text"' || chr(13) || chr(10) || string_agg(row, chr(13) || chr(10) ORDER BY turn, row) || chr(13) || chr(10) AS csv FROM r GROUP BY conv_id
)
SELECT conv_id, md5(csv) AS digest, CAST(length(csv) AS INTEGER) AS n FROM c
'''


def jn1_bijection(spark, d):
    """Turns as a page's blocks, answered with lost, repeated, blank and strange ids."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("page_index"), F.col("turn").alias("ordinal"), F.format_string("b%d", "turn").alias("id"), F.col("text").alias("text"))
    fault = F.col("page_index") % 5
    back = said.where(~((fault == 1) & (F.col("ordinal") == 0)))
    back = back.withColumn("text", F.when((fault == 2) & (F.col("ordinal") == 1), "  ").otherwise(F.concat(F.lit("x "), F.col("text"))))
    back = back.withColumn("id", F.when((fault == 3) & (F.col("ordinal") == 1), "b0").when((fault == 4) & (F.col("ordinal") == 1), "zz").otherwise(F.col("id")))
    return envelope.join_responses(said, back).groupBy("page_index", "status", F.array_join("problem_ids", ",").alias("ids")).agg(F.count("*").alias("blocks"), F.count("translated_text").alias("answered"))


JN1 = """
WITH q AS (SELECT conv_id AS page_index, turn AS ordinal, 'b' || turn AS id, text FROM conversations),
r AS (
  SELECT page_index, ordinal AS place, CASE WHEN page_index % 5 = 3 AND ordinal = 1 THEN 'b0' WHEN page_index % 5 = 4 AND ordinal = 1 THEN 'zz' ELSE id END AS id,
         CASE WHEN page_index % 5 = 2 AND ordinal = 1 THEN '  ' ELSE 'x ' || text END AS t FROM q WHERE NOT (page_index % 5 = 1 AND ordinal = 0)
), m AS (SELECT *, row_number() OVER (PARTITION BY page_index, id ORDER BY place) AS nth FROM r),
scan AS (SELECT page_index, arg_min(CASE WHEN nth > 1 THEN 'duplicate' ELSE 'blank' END, place) AS fault, min_by(id, place) AS fid FROM m WHERE nth > 1 OR trim(t) = '' GROUP BY 1),
f AS (SELECT page_index, id, q.ordinal, m.place, m.t FROM q FULL JOIN (SELECT * FROM m WHERE nth = 1) m USING (page_index, id)),
s AS (SELECT page_index, string_agg(id, ',' ORDER BY id) FILTER (WHERE ordinal IS NULL) AS unknown, string_agg(id, ',' ORDER BY id) FILTER (WHERE place IS NULL) AS missing FROM f GROUP BY 1)
SELECT page_index, coalesce(fault, CASE WHEN unknown IS NOT NULL THEN 'unknown' WHEN missing IS NOT NULL THEN 'missing' ELSE 'ok' END) AS status,
       coalesce(fid, unknown, missing, '') AS ids, count(*) AS blocks, count(t) AS answered
FROM f JOIN s USING (page_index) LEFT JOIN scan USING (page_index) WHERE ordinal IS NOT NULL GROUP BY 1, 2, 3
"""


def dq1_requests(spark, d):
    said = table(spark, d, "conversations").select((F.col("conv_id") - F.when(F.col("conv_id") % 11 == 0, 100000).otherwise(0)).alias("page_index"), F.col("turn").alias("ordinal"), F.when(F.col("turn") == 1, "b0").otherwise(F.format_string("b%d", "turn")).alias("id"), F.when(F.col("turn") == 2, " ").otherwise(F.col("text")).alias("text"))
    return envelope.request_problems(said)


DQ1 = """
WITH q AS (SELECT conv_id - CASE WHEN conv_id % 11 = 0 THEN 100000 ELSE 0 END AS page_index, turn AS ordinal, CASE WHEN turn = 1 THEN 'b0' ELSE 'b' || turn END AS id, CASE WHEN turn = 2 THEN ' ' ELSE text END AS text FROM conversations),
m AS (SELECT *, row_number() OVER (PARTITION BY page_index, id ORDER BY ordinal) AS nth FROM q),
r AS (SELECT *, CASE WHEN page_index < 0 THEN 'negative page' WHEN nth > 1 THEN 'duplicate id' WHEN trim(text) = '' THEN 'blank text' END AS rule FROM m)
SELECT page_index, min(ordinal) AS ordinal, min_by(rule, ordinal) AS rule FROM r WHERE rule IS NOT NULL GROUP BY page_index
"""


def agg3_edges(spark, d):
    """The first and last two lines of every page, and all pages."""
    lines = page_lines(table(spark, d, "documents")).where("i < 2 OR i >= n - 2")
    lines = lines.select("doc", "page", "text", "size", F.when(F.col("i") < 2, 0.9).otherwise(0.05).alias("bottom"), F.when(F.col("i") < 2, 0.95).otherwise(0.1).alias("top"))
    few = F.pmod("page", F.lit(13))
    lines = lines.withColumn("text", F.when(few < 7, F.concat(F.lit("Page  header "), (F.col("page") % 2).cast("string"))).otherwise(F.col("text")))
    return lines, table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"))


def agg3_repeated_edges(spark, d):
    """Edge lines that recur on the pages of a source."""
    return aggregates.repeated_edges(*agg3_edges(spark, d))


AGG3 = f"""
WITH {PAGE_LINES_SQL}, e AS (
  SELECT doc, page, CASE WHEN i < 2 THEN 'header' ELSE 'footer' END AS band, size,
         CASE WHEN page % 13 < 7 THEN 'page header ' || page % 2 ELSE lower(trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) END AS key
  FROM placed WHERE i < 2 OR i >= n - 2
), k AS (SELECT *, CASE WHEN regexp_matches(key, '^\\p{{Nd}}+$') THEN '__page_number__' ELSE key END AS kk FROM e WHERE key <> ''),
t AS (SELECT source AS doc, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1)
SELECT doc, band, kk AS key, CAST(round(size / 0.5) AS BIGINT) AS font, count(DISTINCT page) AS pages FROM k JOIN t USING (doc) WHERE n > 1 GROUP BY doc, band, kk, CAST(round(size / 0.5) AS BIGINT), n HAVING count(DISTINCT page) >= greatest(2, ceil(n / 2.0))
"""


def agg6_master_plan(spark, d):
    lines = page_lines(table(spark, d, "documents"))
    objects = lines.select("doc", "page", F.when(F.col("i") % 2 == 0, "text").otherwise("vector").alias("kind"), F.concat(F.col("x").cast("int").cast("string"), F.lit(":"), F.col("size").cast("int").cast("string")).alias("key"))
    return aggregates.master_plan(objects, lines)


AGG6 = f"""
WITH {PAGE_LINES_SQL}, o AS (SELECT doc, page, CASE WHEN i % 2 = 0 THEN 'text' ELSE 'vector' END AS kind, CAST(x AS INTEGER) || ':' || CAST(size AS INTEGER) AS key FROM placed),
t AS (SELECT doc, count(DISTINCT page) AS n FROM placed GROUP BY 1),
s AS (SELECT doc, kind, key, CASE WHEN kind = 'text' THEN count(DISTINCT page) ELSE count(*) END AS c FROM o GROUP BY 1, 2, 3)
SELECT doc, kind, key, c AS count FROM s JOIN t USING (doc) WHERE c >= greatest(2, ceil(n / 2.0))
"""


def layout_blocks(spark, d):
    """Reading order, columns and blocks of every page, one group per page."""
    lines = page_lines(table(spark, d, "documents")).select("doc", "page", "id", "text", "x", "y", "w", "h", "size", "color", "source")
    return layout.block_rows(layout.laid_out(lines, "doc", "page"), "doc", "page").select("doc", "page", "block", "reading_order", "column_index", F.size("line_ids").alias("lines"), F.md5("text").alias("digest"), "x", "y", "w", "h")


def jn4_recognized(spark, d):
    lines = page_lines(table(spark, d, "documents")).select(F.floor(F.col("page") / 10).alias("doc"), (F.col("page") % 10).alias("page"), "i", "id", "text", "x", "y", "w", "h")
    native = lines.where("i % 3 <> 0")
    seen = lines.withColumn("x", F.col("x") + F.when(F.col("i") % 2 == 0, 4.0).otherwise(300.0)).withColumn("text", F.when(F.col("i") % 3 == 1, F.upper("text")).otherwise(F.lit("other")))
    return joins.drop_recognized_twice(seen, native).select("doc", "page", "id")


JN4 = rf"""
WITH {PAGE_LINES_SQL}, l AS (SELECT * REPLACE (page // 10 AS doc, page % 10 AS page) FROM placed), n AS (SELECT * FROM l WHERE i % 3 <> 0),
o AS (SELECT doc, page, i, id, x + CASE WHEN i % 2 = 0 THEN 4.0 ELSE 300.0 END AS x, y, w, h, CASE WHEN i % 3 = 1 THEN upper(text) ELSE 'other' END AS text FROM l)
SELECT doc, page, id FROM o WHERE NOT EXISTS (
  SELECT 1 FROM n WHERE n.doc = o.doc AND n.page = o.page AND (
    (least(n.w, o.w) > 0 AND greatest(0, least(o.x + o.w, n.x + n.w) - greatest(o.x, n.x)) * greatest(0, least(o.y + o.h, n.y + n.h) - greatest(o.y, n.y)) / least(o.w * o.h, n.w * n.h) >= 0.4)
    OR (trim(regexp_replace(lower(o.text), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')) = trim(regexp_replace(lower(n.text), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))
        AND abs(o.x + o.w / 2 - n.x - n.w / 2) <= greatest(o.w, n.w) AND abs(o.y - n.y) <= 2 * greatest(o.h, n.h))))
"""


def jn11_merge(spark, d):
    """History on load: local rows, then loaded ones that are neither local nor deleted."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    local, loaded, deleted = rows.where("id % 3 = 0").withColumn("text", F.lit("local")), rows, rows.where("id % 5 = 0").select("id")
    return joins.merge_on_load(local, loaded, deleted).groupBy("text").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


JN11 = """
WITH m AS (SELECT event_id AS id, 'local' AS text FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0)
SELECT text, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM m GROUP BY text
"""


def jn16_lost(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return joins.lost_rows(rows, rows.where("event_id % 10 <> 0"), "user_id", "event_type")


JN16 = """
SELECT user_id, event_type, count(*) AS before, count(*) FILTER (WHERE event_id % 10 <> 0) AS after FROM events GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_id % 10 <> 0) < count(*)
"""


def agg19_latest(spark, d):
    return joins.latest_by(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


AGG19 = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1"


def fil16_generation(spark, d):
    rows = table(spark, d, "events").withColumn("generation", F.floor(F.col("value")))
    return joins.current_generation(rows, "user_id").select("user_id", "event_id", "generation")


FIL16 = "SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS generation FROM (SELECT *, max(floor(value)) OVER (PARTITION BY user_id) AS top FROM events) WHERE floor(value) = top"


def stm8_debounce(spark, d):
    return flow.debounced(table(spark, d, "events"), "user_id", idle_seconds=3600.0).select("user_id", "event_id")


STM8 = """
SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 3600000000
"""


def stm9_coalesced(spark, d):
    return flow.coalesced_writes(table(spark, d, "events"), "user_id", millis=86_400_000).select("user_id", "slot", "event_id", "changes")


STM9 = "SELECT user_id, CAST(floor(epoch_ms(ts) / 86400000.0) AS BIGINT) AS slot, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS changes FROM events GROUP BY 1, 2"


def win_functions(spark, d):
    """WIN1-WIN3: order, duplicates of a seed, first occurrences."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.floor(F.col("n_chars") / 100).cast("string").alias("seed"))
    rows = aggregates.numbered(docs, ["seed", "doc_id"], "source")
    rows = aggregates.occurrence_seeds(rows, "seed", "doc_id", "source")
    first = aggregates.first_occurrences(docs.select("source", "seed", "doc_id"), ["source", "seed"], "doc_id").withColumnRenamed("doc_id", "first_id")
    return rows.join(first, ["source", "seed"]).select("doc_id", F.col("reading_order").cast("int").alias("reading_order"), "stable_seed", "first_id")


WIN = """
WITH s AS (SELECT doc_id, source, CAST(floor(n_chars / 100.0) AS BIGINT)::VARCHAR AS seed FROM documents)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY seed, doc_id) - 1 AS INTEGER) AS reading_order,
       seed || CASE WHEN row_number() OVER (PARTITION BY source, seed ORDER BY doc_id) = 1 THEN '' ELSE '|' || row_number() OVER (PARTITION BY source, seed ORDER BY doc_id) - 1 END AS stable_seed,
       min(doc_id) OVER (PARTITION BY source, seed) AS first_id FROM s
"""


def win6_agg15_warnings(spark, d):
    docs = table(spark, d, "documents")
    tag = F.when(F.col("lang") == "en", "lowConfidence").otherwise("hybrid")
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    pages = docs.select(F.col("source").alias("doc"), page.alias("page"), tag.alias("tag"))
    return aggregates.grouped_warnings(pages.select("doc", "tag", "page"), pages)


WIN6 = """
WITH p AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, CASE WHEN lang = 'en' THEN 'lowConfidence' ELSE 'hybrid' END AS tag FROM documents),
i AS (SELECT *, page - row_number() OVER (PARTITION BY doc, tag ORDER BY page) AS island FROM p),
r AS (SELECT doc, tag, min(page) AS a, max(page) AS b FROM i GROUP BY doc, tag, island),
s AS (SELECT doc, tag, string_agg(CASE WHEN a = b THEN (a + 1)::VARCHAR ELSE (a + 1) || '-' || (b + 1) END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1, 2),
c AS (SELECT doc, tag, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT doc, count(*) AS n FROM p GROUP BY 1)
SELECT doc, tag, c.n AS page_count, c.n AS times, CASE WHEN c.n = t.n AND t.n > 1 THEN 'all ' || t.n ELSE s.pages END AS pages FROM c JOIN s USING (doc, tag) JOIN t USING (doc)
"""


def win4_advance(spark, d):
    lines = page_lines(table(spark, d, "documents"))
    one = aggregates.numbered(lines.where("x < 100"), [F.desc("y"), "i"], "page")
    return aggregates.line_advance(one, "page").join(aggregates.space_before(one, "page").groupBy("page").agg(F.round(F.sum("space_before"), 3).alias("room")), "page")


WIN4 = f"""
WITH {PAGE_LINES_SQL}, o AS (SELECT page, y + h AS top, y, lag(y + h) OVER w AS ptop, lag(y) OVER w AS py FROM placed WHERE x < 100 WINDOW w AS (PARTITION BY page ORDER BY y DESC, i)),
m AS (SELECT page, list_sort(list(ptop - top)) AS s FROM o WHERE ptop - top > 0 GROUP BY page),
r AS (SELECT page, round(sum(greatest(0, coalesce(py - top, 0))), 3) AS room FROM o GROUP BY page)
SELECT page, s[len(s) // 2 + 1] AS advance, room FROM m JOIN r USING (page)
"""


def agg9_color(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("area"), *[F.round(F.abs(F.get("embedding", i)) % 1, 3).cast("double").alias(c) for i, c in enumerate("rgb")])
    return aggregates.dominant_color(rows, "area").select("area", *[F.round(c, 6).alias(c) for c in "rgb"], "dominant", "samples")


AGG9 = """
WITH e AS (SELECT label AS area, round(abs(embedding[1]) % 1, 3)::DOUBLE AS r, round(abs(embedding[2]) % 1, 3)::DOUBLE AS g, round(abs(embedding[3]) % 1, 3)::DOUBLE AS b FROM embeddings),
k AS (SELECT *, least(11, floor(r * 12)) AS x, least(11, floor(g * 12)) AS y, least(11, floor(b * 12)) AS z FROM e),
s AS (SELECT area, x, y, z, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM k GROUP BY 1, 2, 3, 4),
o AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, x, y, z) AS p, sum(n) OVER (PARTITION BY area) AS t FROM s)
SELECT area, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, n AS dominant, CAST(t AS BIGINT) AS samples FROM o WHERE p = 1
"""


def mth_geometry(spark, d):
    lines = page_lines(table(spark, d, "documents"))
    a, b = {c: F.col(c) for c in "xywh"}, {"x": F.lit(100.0), "y": F.lit(600.0), "w": F.lit(300.0), "h": F.lit(100.0)}
    shade = (F.col("i") % 10) / 10
    return lines.select(
        "page", "i", hashing.geometry_key(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("key"), hashing.quantized(F.col("w"), 4.0).alias("q"), F.round(geometry.overlap_of_smaller(a, b), 6).alias("overlap"),
        F.round(geometry.contrast_ratio(geometry.relative_luminance(shade, shade, shade), F.lit(1.0)), 6).alias("contrast"), geometry.contrast_text_color(shade, shade, shade).alias("ink"),
        geometry.highlighted_characters(F.length("text"), F.col("i") * 1.0, F.lit(7.0)).alias("spoken"), geometry.points_to_emu(F.col("w")).alias("emu"), layout.starts_with_marker(F.col("text")).alias("marker"),
    )


MTH = rf"""
WITH {PAGE_LINES_SQL}, c AS (SELECT *, (i % 10) / 10.0::DOUBLE AS s FROM placed), u AS (SELECT *, CASE WHEN s <= 0.03928 THEN s / 12.92 ELSE pow((s + 0.055) / 1.055, 2.4) END AS l FROM c)
SELECT page, CAST(i AS INTEGER) AS i, CAST(round(x * 100) AS BIGINT) || ',' || CAST(round(y * 100) AS BIGINT) || ',' || CAST(round(w * 100) AS BIGINT) || ',' || CAST(round(h * 100) AS BIGINT) AS key,
  CAST(round(w / 4.0) AS BIGINT) AS q,
  round(CAST(greatest(0, least(x + w, 400) - greatest(x, 100)) * greatest(0, least(y + h, 700) - greatest(y, 600)) / least(w * h, 30000) AS DOUBLE), 6) AS overlap,
  round(1.05 / (0.2126 * l + 0.7152 * l + 0.0722 * l + 0.05), 6) AS contrast, CASE WHEN 0.2126 * s + 0.7152 * s + 0.0722 * s >= 0.52 THEN 'black' ELSE 'white' END AS ink,
  CAST(floor(length(text) * least(1.0, greatest(0.0, i / 7.0::DOUBLE))) AS INTEGER) AS spoken, CAST(round(w * 12700) AS BIGINT) AS emu,
  regexp_extract(trim(regexp_replace(text, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')), '^[^ ]*') IN ('•', '◦', '○', '●', '▪', '▫', '‣', '⁃', '-', '–', '—', '*', 'o', 'O', '0', chr(61623))
    OR regexp_matches(regexp_extract(trim(regexp_replace(text, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')), '^[^ ]*'), '^\p{{N}}*[.)]+$') AS marker
FROM u
"""


def jsn4_variants(spark, d):
    """Event properties as variants: typed access with integral doubles read as integers."""
    v = F.try_parse_json(F.col("props"))
    return table(spark, d, "events").select("event_id", F.schema_of_variant(v).alias("schema"), F.to_json(v).alias("json"))


def jsn4_typed(spark, d):
    """The properties beside halves, texts, flags and an inner object, each read as every type."""
    k = F.get_json_object("props", "$.k").cast("long")
    half = F.concat((F.floor(k / 2)).cast("string"), F.when(k % 2 == 0, ".0").otherwise(".5"))
    body = F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"h":'), half, F.lit(',"s":"'), "event_type", F.lit('","b":'), F.when(k % 3 == 0, "true").otherwise("false"), F.lit(',"o":{"n":'), k.cast("string"), F.lit("}}"))
    rows = table(spark, d, "events").select("event_id", F.parse_json(body).alias("v"))
    v = F.col("v")
    return rows.select(
        "event_id", variants.integer(v, "$.k").alias("k"), variants.integer(v, "$.h").alias("h"), variants.number(v, "$.h").alias("half"), variants.string(v, "$.s").alias("s"), variants.boolean(v, "$.b").alias("b"), variants.integer(v, "$.o.n").alias("n"),
        variants.integer(v, "$.s").alias("no_integer"), variants.string(v, "$.k").alias("no_string"), variants.boolean(v, "$.k").alias("no_flag"), variants.number(v, "$.none").alias("none"),
    )


JSN4 = """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k, CASE WHEN k % 2 = 0 THEN k // 2 END AS h, k / 2.0::DOUBLE AS half, event_type AS s, k % 3 = 0 AS b, k AS n, CAST(NULL AS BIGINT) AS no_integer, CAST(NULL AS VARCHAR) AS no_string, CAST(NULL AS BOOLEAN) AS no_flag, CAST(NULL AS DOUBLE) AS none FROM e
"""


QUERIES = {
    "jsn4_typed": jsn4_typed,
    "src8_live_frames": src8_live_frames, "stm_transcripts": stm_transcripts, "stm6_messages": stm6_messages, "seg9_sentences": seg9_sentences, "jn14_pairs": jn14_pairs, "snk1_csv": snk1_csv, "jn1_bijection": jn1_bijection,
    "dq1_requests": dq1_requests, "agg3_repeated_edges": agg3_repeated_edges, "agg6_master_plan": agg6_master_plan, "layout_blocks": layout_blocks, "jn4_recognized": jn4_recognized, "jn11_merge": jn11_merge, "jn16_lost": jn16_lost,
    "agg19_latest": agg19_latest, "fil16_generation": fil16_generation, "stm8_debounce": stm8_debounce, "stm9_coalesced": stm9_coalesced, "win_functions": win_functions, "win6_agg15_warnings": win6_agg15_warnings, "win4_advance": win4_advance,
    "agg9_color": agg9_color, "mth_geometry": mth_geometry, "jsn4_variants": jsn4_variants,
}
ORACLE_SQL = {
    "jsn4_typed": JSN4,
    "src8_live_frames": SRC8, "jn14_pairs": JN14, "snk1_csv": SNK1, "jn1_bijection": JN1, "dq1_requests": DQ1, "agg3_repeated_edges": AGG3, "agg6_master_plan": AGG6, "jn4_recognized": JN4, "jn11_merge": JN11, "jn16_lost": JN16,
    "agg19_latest": AGG19, "fil16_generation": FIL16, "stm8_debounce": STM8, "stm9_coalesced": STM9, "win_functions": WIN, "win6_agg15_warnings": WIN6, "win4_advance": WIN4, "mth_geometry": MTH, "agg9_color": AGG9,
}
