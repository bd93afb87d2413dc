"""Queries on positioned lines: geometric joins, statistics, windows, page furniture; all lines of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import aggregates, joins, layout
from loomtext.plans._data import PAGE_LINES_SQL, page_lines, table

_OVER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _lines(spark, d):
    return page_lines(table(spark, d, "documents"))


def _numbered(spark, d):
    """Lines of documents of ten pages each, whose page numbers are the same in every document."""
    return _lines(spark, d).withColumn("doc", F.expr("page div 10")).withColumn("page", F.col("page") % 10)


_NUMBERED = "l AS (SELECT * REPLACE (page // 10 AS doc, page % 10 AS page) FROM placed)"


def jn5_link_targets(spark, d):
    rows = _numbered(spark, d)
    links = rows.where("i % 2 = 0").select("doc", "page", (F.col("x") + 5).alias("x"), (F.col("y") - F.col("i") % 4 * 2).alias("y"), "w", "h", F.concat(F.lit("u"), (F.col("i") % 3).cast("string")).alias("url"))
    return joins.link_targets(rows.select("doc", "page", "id", "x", "y", "w", "h"), links).select("doc", "page", "id", "url")


JN5 = f"""
WITH {PAGE_LINES_SQL}, {_NUMBERED}, k AS (SELECT doc, page, x + 5 AS x, y - i % 4 * 2 AS y, w, h, 'u' || i % 3 AS url FROM l WHERE i % 2 = 0),
j AS (SELECT a.id, count(DISTINCT url) AS n, min(url) AS url FROM l a JOIN k b ON a.doc = b.doc AND a.page = b.page AND {_OVER} / least(a.w * a.h, b.w * b.h) >= 0.2 GROUP BY 1)
SELECT l.doc, l.page, l.id, CASE WHEN j.n = 1 THEN j.url END AS url FROM l LEFT JOIN j USING (id)
"""


def jn6_overlay_conflicts(spark, d):
    rows = _numbered(spark, d)
    notes = rows.where("i % 3 = 0").select("doc", "page", (F.col("x") + 20).alias("x"), "y", "w", "h", F.when(F.col("i") % 2 == 0, F.concat(F.lit("u"), F.col("i").cast("string"))).alias("url"))
    return joins.overlay_conflicts(rows.select("doc", "page", "id", "x", "y", "w", "h"), notes).select("doc", "page", "id")


JN6 = f"""
WITH {PAGE_LINES_SQL}, {_NUMBERED}, k AS (SELECT doc, page, x + 20 AS x, y, w, h, CASE WHEN i % 2 = 0 THEN 'u' || i END AS url FROM l WHERE i % 3 = 0)
SELECT a.doc, a.page, a.id FROM l a JOIN k b ON a.doc = b.doc AND a.page = b.page AND {_OVER} > 0 GROUP BY 1, 2, 3 HAVING max(CASE WHEN url IS NULL THEN 1 ELSE 0 END) = 1 OR count(DISTINCT url) > 1
"""


def jn7_occluded(spark, d):
    rows = _numbered(spark, d).select("doc", "page", "i", "id", "x", "y", "w", "h")
    front = rows.where("i % 4 = 1").withColumn("w", F.col("w") * 0.5).withColumn("x", F.col("x") - 280)
    return joins.occluded(rows, front).select("doc", "page", "id")


JN7 = f"""
WITH {PAGE_LINES_SQL}, {_NUMBERED}, k AS (SELECT doc, page, x - 280 AS x, y, w * 0.5 AS w, h FROM l WHERE i % 4 = 1)
SELECT a.doc, a.page, a.id FROM l a WHERE a.w * a.h > 0 AND EXISTS (SELECT 1 FROM k b WHERE a.doc = b.doc AND a.page = b.page AND {_OVER} >= 0.55 * (a.w * a.h))
"""


def jn10_resolved_blocks(spark, d):
    rows = _lines(spark, d)
    block = F.format_string("%d/%d", F.col("page"), F.floor(F.col("i") / 3).cast("int"))
    blocks = rows.withColumn("b", block).groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda v: v["id"]).alias("line_ids"), F.min("i").alias("i0")).select(F.col("b").alias("id"), "line_ids")
    line_texts = rows.where("i % 5 <> 0 AND i % 24 < 15").select("id", F.concat(F.lit("t"), F.col("i").cast("string")).alias("text"))
    block_texts = rows.where("i % 6 = 0").select(block.alias("id"), F.lit("block").alias("text"))
    return joins.resolve_blocks(blocks, line_texts, block_texts)


JN10 = f"""
WITH {PAGE_LINES_SQL}, l AS (SELECT page || '/' || i // 3 AS b, * FROM placed),
p AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE i % 5 <> 0 AND i % 24 < 15) AS direct, string_agg('t' || i, ' ' ORDER BY i) AS merged, bool_or(i % 6 = 0) AS whole FROM l GROUP BY b),
h AS (SELECT *, CASE WHEN direct = n THEN 'lines' WHEN direct > 0 THEN 'partial' WHEN whole THEN 'block' ELSE 'none' END AS how FROM p)
SELECT b AS id, how, CASE how WHEN 'lines' THEN merged WHEN 'block' THEN 'block' END AS translated_text FROM h
"""


def jn9_footers(spark, d):
    shade = (F.col("i") % 4) / 10
    rows = _numbered(spark, d).select("doc", "page", "i", "id", "x", (F.col("i") * 9.0).alias("y"), "w", F.lit(8.0).alias("h"), (F.col("size") - 3).alias("size"), shade.alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), "source", F.lit(792.0).alias("page_height"))
    return joins.touching_chrome(rows, rows.where("i % 5 = 0")).select("doc", "page", "id")


JN9 = f"""
WITH {PAGE_LINES_SQL}, l AS (SELECT page // 10 AS doc, page % 10 AS page, i, id, x, i * 9.0 AS y, w, 8.0 AS h, size - 3 AS size, (i % 4) / 10.0 AS r FROM placed)
SELECT a.doc, a.page, a.id FROM l a WHERE a.y + 8 <= 79.2 AND a.size <= greatest(10.0, 0.027 * 792) AND EXISTS (
  SELECT 1 FROM l b WHERE b.doc = a.doc AND b.page = a.page AND b.id <> a.id AND b.i % 5 = 0 AND b.y + 8 <= 79.2 AND greatest(a.x - (b.x + b.w), b.x - (a.x + a.w), 0) <= greatest(14, 2 * greatest(a.size, b.size))
    AND greatest(a.y - (b.y + 8), b.y - (a.y + 8), 0) <= greatest(8, 1.5 * greatest(a.size, b.size)) AND abs(a.size - b.size) <= 3 AND pow(a.r - b.r, 2) <= 0.08)
"""


def agg1_counts(spark, d):
    lines = page_lines(table(spark, d, "documents"))
    pages = lines.groupBy("doc", "page").agg(F.count("*").alias("line_count"), F.count_if(F.col("text").contains("|")).alias("warning_count"))
    counts = aggregates.document_counts(pages)
    rolled = aggregates.report(pages).select("doc", F.size("page_metrics").alias("metric_rows"), F.get("page_metrics", 0)["page"].alias("first_page"))
    return counts.join(rolled, "doc")


AGG1 = f"""
WITH {PAGE_LINES_SQL}, p AS (SELECT doc, page, count(*) AS lc, count(*) FILTER (WHERE contains(text, '|')) AS wc FROM placed GROUP BY 1, 2)
SELECT doc, count(*) AS pages, CAST(sum(lc) AS BIGINT) AS lines, CAST(sum(wc) AS BIGINT) AS warnings, count(*) FILTER (WHERE wc > 0) AS pages_with_warnings, CAST(count(*) AS INTEGER) AS metric_rows, min(page) AS first_page FROM p GROUP BY doc
"""


def agg5_shared_templates(spark, d):
    rows = _lines(spark, d).select("doc", "page", "id", F.col("text").alias("fingerprint"), F.lit("content").alias("role"), F.lit(0.95).alias("confidence"))
    return aggregates.shared_templates(rows).select("id", "role", F.round("confidence", 4).alias("confidence"))


AGG5 = f"""
WITH {PAGE_LINES_SQL}, l AS (SELECT doc, page, id, text AS f FROM placed), s AS (SELECT doc, f FROM l GROUP BY 1, 2 HAVING count(DISTINCT page) > 1)
SELECT l.id, CASE WHEN s.f IS NULL THEN 'content' ELSE 'sharedTemplate' END AS role, CASE WHEN s.f IS NULL THEN 0.95 ELSE 0.99 END::DOUBLE AS confidence FROM l LEFT JOIN s USING (doc, f)
"""


def agg7_header_footer(spark, d):
    rows = page_lines(table(spark, d, "documents")).where("i < 2 OR i >= n - 1")
    objects = rows.select("doc", "page", F.when(F.col("i") % 2 == 0, "text").otherwise("image").alias("kind"), F.when(F.col("page") % 3 == 0, F.col("page").cast("string")).otherwise(F.col("text")).alias("text"), F.col("size").cast("string").alias("key"), "x", F.when(F.col("i") < 2, 740.0).otherwise(30.0).alias("y"), "h")
    boxes = table(spark, d, "documents").groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("n")).select("doc", F.lit(0.0).alias("y"), F.lit(792.0).alias("h"), "n")
    return aggregates.header_footer_plan(objects, boxes)


AGG7 = rf"""
WITH {PAGE_LINES_SQL}, o AS (
  SELECT doc, page, CASE WHEN i % 2 = 0 THEN 'text' ELSE 'image' END AS kind, CASE WHEN page % 3 = 0 THEN page::VARCHAR ELSE text END AS t, size::DOUBLE::VARCHAR AS key, x, CASE WHEN i < 2 THEN 740.0 ELSE 30.0 END AS y FROM placed WHERE i < 2 OR i >= n - 1
), k AS (
  SELECT doc, CASE WHEN y > 700 THEN 'header' ELSE 'footer' END AS band,
    kind || '|' || CASE WHEN kind = 'image' THEN key WHEN regexp_matches(lower(trim(regexp_replace(t, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))), '^\p{{Nd}}+$') THEN '__page_number__' ELSE lower(trim(regexp_replace(t, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))) END
    || '|' || CAST(round(x / 4.0) AS BIGINT) || '|' || CAST(round(y / 4.0) AS BIGINT) AS plan_key FROM o
), n AS (SELECT source AS doc, count(*) AS n FROM documents GROUP BY 1)
SELECT doc, band, plan_key, count(*) AS times FROM k JOIN n USING (doc) GROUP BY doc, band, plan_key, n HAVING count(*) >= greatest(2, ceil(n / 2.0))
"""


def agg8_last(spark, d):
    rows = page_lines(table(spark, d, "documents"))
    return aggregates.last_representative(rows.withColumn("at", F.struct("page", "i")), ["doc", "size"], "at", "id")


AGG8 = f"WITH {PAGE_LINES_SQL} SELECT doc, size, max_by(id, (page, i)) AS id FROM placed GROUP BY 1, 2"


def agg11_alignment(spark, d):
    rows = _lines(spark, d).withColumn("x", F.col("x") + F.when(F.col("page") % 2 == 0, (240 - F.col("w")) / 2).otherwise(F.col("i") * 0.2)).withColumn("marker", layout.starts_with_marker(F.col("text")))
    return aggregates.block_alignment(rows, "page")


AGG11 = rf"""
WITH {PAGE_LINES_SQL}, l AS (
  SELECT *, x + CASE WHEN page % 2 = 0 THEN (240 - w) / 2 ELSE i * 0.2 END AS xx, regexp_extract(trim(regexp_replace(text, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')), '^[^ ]*') AS f FROM placed
), e AS (
  SELECT page, unnest(['left', 'center', 'right']) AS name, unnest([0, 1, 2]) AS o, unnest([xx, xx + w / 2, xx + w]) AS v, w, size, f IN ('•', '◦', '○', '●', '▪', '▫', '‣', '⁃', '-', '–', '—', '*', 'o', 'O', '0') OR regexp_matches(f, '^\p{{N}}*[.)]+$') AS m FROM l
), md AS (SELECT page, name, list_sort(list(v))[len(list(v)) // 2 + 1] AS med FROM e GROUP BY 1, 2),
dv AS (SELECT page, name, o, list_sort(list(abs(v - med)))[count(*) // 2 + 1] AS dev, count(*) AS n, max(size) AS f, max(w) - min(w) AS spread, bool_or(m) AS m FROM e JOIN md USING (page, name) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY dev, o) AS p, lead(dev) OVER (PARTITION BY page ORDER BY dev, o) AS nxt FROM dv)
SELECT page, CASE WHEN n >= 2 AND NOT m AND spread >= greatest(4.0, 0.7 * f) AND dev <= greatest(1.25, 0.11 * f) AND nxt - dev >= greatest(1.5, 0.22 * f) THEN name END AS alignment FROM r WHERE p = 1
"""


def agg13_joined(spark, d):
    rows = _lines(spark, d).withColumn("text", F.when(F.col("i") % 3 == 1, F.concat("text", F.lit("-"))).otherwise(F.col("text")))
    return aggregates.joined_text(rows, "i", "text", "page").select("page", F.md5("text").alias("digest"))


AGG13 = f"""
WITH {PAGE_LINES_SQL}, l AS (SELECT page, i, CASE WHEN i % 3 = 1 THEN text || '-' ELSE text END AS t FROM placed)
SELECT page, md5(replace(replace(string_agg(t, chr(1) ORDER BY i), '-' || chr(1), ''), chr(1), ' ')) AS digest FROM l GROUP BY page
"""


def agg14_confidence(spark, d):
    rows = _lines(spark, d).select("page", ((F.col("page") * 7 + F.col("i") * 3) % 20 / 20 + 0.3).alias("confidence"))
    return aggregates.low_confidence(rows, "page").select("page", F.round("confidence", 6).alias("confidence"))


AGG14 = f"WITH {PAGE_LINES_SQL} SELECT page, round(min((page * 7 + i * 3) % 20 / 20.0::DOUBLE + 0.3), 6) AS confidence FROM placed GROUP BY page HAVING min((page * 7 + i * 3) % 20 / 20.0::DOUBLE + 0.3) < 0.55"


def agg10_complexity(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("area"), *[F.round(F.abs(F.get("embedding", i)) % 1, 3).cast("double").alias(c) for i, c in enumerate("rgb")])
    return aggregates.is_complex(rows, aggregates.dominant_color(rows, "area"), "area").select("area", F.round("secondary", 6).alias("secondary"), F.round("mean_d2", 6).alias("mean_d2"), "complex")


AGG10 = """
WITH e AS (SELECT label AS area, round(abs(embedding[1]) % 1, 3)::DOUBLE AS r, round(abs(embedding[2]) % 1, 3)::DOUBLE AS g, round(abs(embedding[3]) % 1, 3)::DOUBLE AS b FROM embeddings),
k AS (SELECT *, least(11, floor(r * 12)) AS x, least(11, floor(g * 12)) AS y, least(11, floor(b * 12)) AS z FROM e),
s AS (SELECT area, x, y, z, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM k GROUP BY 1, 2, 3, 4),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, x, y, z) AS p FROM s) WHERE p = 1),
m AS (SELECT area, 1 - max(o.n) / count(*)::DOUBLE AS secondary, avg(pow(e.r - o.r, 2) + pow(e.g - o.g, 2) + pow(e.b - o.b, 2)) AS d2 FROM e JOIN o USING (area) GROUP BY area)
SELECT area, round(secondary, 6) AS secondary, round(d2, 6) AS mean_d2, secondary > 0.12 AND d2 > 0.02 AS complex FROM m
"""


def agg20_background(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 97).alias("area"), F.col("vec_id").alias("ordinal"), *[F.round(0.5 + F.get("embedding", i) / 100, 4).cast("double").alias(c) for i, c in enumerate("rgb")], F.when(F.col("vec_id") % 194 == 3, 0.5).otherwise(1.0).alias("a"))
    return aggregates.uniform_background(rows, "area").select("area", *[F.round(c, 6).alias(c) for c in "rgb"])


AGG20 = """
WITH e AS (SELECT vec_id % 97 AS area, vec_id AS o, round(0.5 + embedding[1] / 100, 4)::DOUBLE AS r, round(0.5 + embedding[2] / 100, 4)::DOUBLE AS g, round(0.5 + embedding[3] / 100, 4)::DOUBLE AS b, CASE WHEN vec_id % 194 = 3 THEN 0.5 ELSE 1.0 END AS a FROM embeddings),
f AS (SELECT *, first_value(r) OVER w AS r0, first_value(g) OVER w AS g0, first_value(b) OVER w AS b0 FROM e WINDOW w AS (PARTITION BY area ORDER BY o)),
s AS (SELECT area, count(*) >= 4 AND bool_and(abs(r - r0) <= 0.045 AND abs(g - g0) <= 0.045 AND abs(b - b0) <= 0.045 AND a >= 0.98) AS ok, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM f GROUP BY area)
SELECT area, CASE WHEN ok THEN round(r, 6) END AS r, CASE WHEN ok THEN round(g, 6) END AS g, CASE WHEN ok THEN round(b, 6) END AS b FROM s
"""


def win7_regions(spark, d):
    rows = page_lines(table(spark, d, "documents")).withColumn("y", F.col("y") - F.col("i") * 0.01)
    return layout.region_index(rows, "page").select("id", F.col("region").cast("long").alias("region"))


WIN7 = f"""
WITH {PAGE_LINES_SQL} SELECT id, CAST(coalesce(sum(CASE WHEN w >= 306 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y - i * 0.01 + h / 2 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS region FROM placed
"""


def win8_gutters(spark, d):
    columns = _lines(spark, d).groupBy("page", "x").agg(F.max("w").alias("w"))
    return layout.gutters(columns, "page").select("page", "x", F.round("left_bound", 3).alias("left_bound"), F.round("right_bound", 3).alias("right_bound"))


WIN8 = f"""
WITH {PAGE_LINES_SQL}, c AS (SELECT page, x::DOUBLE AS x, max(w) AS w FROM placed GROUP BY 1, 2)
SELECT page, x, round(coalesce((lag(x + w) OVER v + x) / 2, 0.0), 3)::DOUBLE AS left_bound, round(coalesce((x + w + lead(x) OVER v) / 2, 612.0), 3)::DOUBLE AS right_bound FROM c WINDOW v AS (PARTITION BY page ORDER BY x)
"""


def seg10_gaps(spark, d):
    rows = _lines(spark, d).select("page", F.col("i"), (F.col("i") * 20.0 + F.when(F.col("i") % 7 == 0, 0.0).otherwise(F.lit(0.0)) + F.floor(F.col("i") / 5) * 40).alias("x"), F.lit(10.0).alias("w"), F.when(F.col("i") % 10 == 0, 60.0).otherwise(8.0).alias("space_width"), "size")
    return layout.oversized_gaps(rows, "page").groupBy("page").agg(F.max("part").alias("parts"), F.sum("part").alias("total"))


SEG10 = f"""
WITH {PAGE_LINES_SQL}, g AS (SELECT page, i, i * 20.0 + (i // 5) * 40 AS x, CASE WHEN i % 10 = 0 THEN 60.0 ELSE 8.0 END AS sw, size FROM placed),
c AS (SELECT *, CASE WHEN sw > greatest(12.0, 2 * size) AND x - lag(x + 10.0) OVER (PARTITION BY page ORDER BY x) > greatest(12.0, 2 * size) THEN 1 ELSE 0 END AS cut FROM g),
p AS (SELECT page, sum(cut) OVER (PARTITION BY page ORDER BY x) AS part FROM c)
SELECT page, CAST(max(part) AS BIGINT) AS parts, CAST(sum(part) AS BIGINT) AS total FROM p GROUP BY page
"""


def seg11_color_runs(spark, d):
    rows = _lines(spark, d).select("page", F.col("i").alias("ordinal"), *[(F.floor(F.col("i") / k) / 10.0).alias(c) for c, k in zip("rgb", (3, 7, 50))])
    return layout.color_runs(rows, "page").groupBy("page").agg(F.max("run").alias("runs"), F.sum("run").alias("total"))


SEG11 = f"""
WITH {PAGE_LINES_SQL}, c AS (SELECT page, i, CASE WHEN i > 0 AND (i % 3 = 0 OR i % 7 = 0 OR i % 50 = 0) THEN 1 ELSE 0 END AS cut FROM placed),
p AS (SELECT page, sum(cut) OVER (PARTITION BY page ORDER BY i) AS run FROM c)
SELECT page, CAST(max(run) AS BIGINT) AS runs, CAST(sum(run) AS BIGINT) AS total FROM p GROUP BY page
"""


def fil6_furniture(spark, d):
    rows = _lines(spark, d).withColumn("text", F.when(F.col("i") % 4 == 0, F.col("page").cast("string")).when(F.col("i") % 4 == 1, F.lit("All Rights  Reserved.")).otherwise(F.col("text"))).withColumn("y", F.col("i") * 12.0)
    return rows.where(layout.is_furniture(F.col("text"), F.col("y"), F.col("h"), F.col("size"), F.lit(0.0), F.lit(792.0))).select("id")


FIL6 = rf"""
WITH {PAGE_LINES_SQL}, l AS (SELECT id, CASE i % 4 WHEN 0 THEN page::VARCHAR WHEN 1 THEN 'All Rights  Reserved.' ELSE text END AS t, i * 12.0 + 12 AS top, size FROM placed), n AS (SELECT *, lower(trim(regexp_replace(t, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))) AS k FROM l)
SELECT id FROM n WHERE (top <= 118.8 AND (contains(k, '©') OR contains(k, 'copyright') OR contains(k, 'all rights reserved') OR contains(k, 'confidential') OR contains(k, 'internal') OR contains(k, 'disclosure prohibited')))
  OR (top <= 71.28 AND size <= 19.8 AND regexp_matches(k, '^[\p{{Nd}}\s\p{{Z}}\p{{P}}]+$'))
"""


def grp7_assets(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("page"), (F.col("page_id") % 3).alias("occurrence"), F.col("html").alias("data"))
    return aggregates.image_assets(pages).groupBy("asset").agg(F.count("*").alias("uses"))


GRP7 = "SELECT substr(sha256(html), 1, 32) AS asset, count(*) AS uses FROM pages GROUP BY 1"


def grp5_boxes(spark, d):
    rows = _lines(spark, d).select("page", "id", "text", "x", "y", "w", "h", "size", F.lit("editableContent").alias("role"), F.lit("left").alias("alignment"))
    return layout.merged_boxes(rows).groupBy("page").agg(F.count("*").alias("boxes"), F.sum(F.length("text")).alias("characters"))


QUERIES = {
    "jn5_link_targets": jn5_link_targets, "jn6_overlay_conflicts": jn6_overlay_conflicts, "jn7_occluded": jn7_occluded, "jn9_footers": jn9_footers, "jn10_resolved_blocks": jn10_resolved_blocks, "agg1_counts": agg1_counts,
    "agg5_shared_templates": agg5_shared_templates, "agg7_header_footer": agg7_header_footer, "agg8_last": agg8_last, "agg10_complexity": agg10_complexity, "agg11_alignment": agg11_alignment, "agg13_joined": agg13_joined,
    "agg14_confidence": agg14_confidence, "agg20_background": agg20_background, "win7_regions": win7_regions, "win8_gutters": win8_gutters, "seg10_gaps": seg10_gaps, "seg11_color_runs": seg11_color_runs, "fil6_furniture": fil6_furniture,
    "grp5_boxes": grp5_boxes, "grp7_assets": grp7_assets,
}
ORACLE_SQL = {
    "jn5_link_targets": JN5, "jn6_overlay_conflicts": JN6, "jn7_occluded": JN7, "jn9_footers": JN9, "jn10_resolved_blocks": JN10, "agg1_counts": AGG1, "agg5_shared_templates": AGG5, "agg7_header_footer": AGG7, "agg8_last": AGG8,
    "agg10_complexity": AGG10, "agg11_alignment": AGG11, "agg13_joined": AGG13, "agg14_confidence": AGG14, "agg20_background": AGG20, "win7_regions": WIN7, "win8_gutters": WIN8, "seg10_gaps": SEG10, "seg11_color_runs": SEG11,
    "fil6_furniture": FIL6, "grp7_assets": GRP7,
}
