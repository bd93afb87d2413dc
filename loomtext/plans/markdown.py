"""Queries on Markdown: the documents' lines with headings, lists, fences, tables, comments and front matter put around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import text
from loomtext.plans._data import table
from loomtext.plans.documents import SEGMENT_CUTS, TOKENS_SQL

CONFIG = text.PROFILES["balanced"]


def markdown_documents(spark, d):
    """doc_id, text, kind: twelve kinds of lines in turn, and a front matter on every fifth document."""
    docs = table(spark, d, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\s\p{Z}\x85]"))

    def line(x, i):
        k = (i + F.col("doc_id")) % 12
        made = {0: F.concat(F.lit("# "), x), 1: F.concat(F.lit("- "), x), 2: F.lit("```"), 4: F.lit("  ```"), 5: F.concat(F.lit("| "), F.replace(x, F.lit("|"), F.lit("/")), F.lit(r" || b \| c |")), 6: F.concat(F.lit("<!-- "), x), 7: F.concat(x, F.lit(" -->")), 8: F.concat(F.lit("> "), x), 9: F.lit(" * * *"), 11: F.concat(F.lit("12) "), x)}
        out = x
        for n, c in made.items():
            out = F.when(k == n, c).otherwise(out)
        return out

    body = F.array_join(F.transform(lines, line), "\n")
    return docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, "---\ntitle: x\n---\n").otherwise(""), body).alias("text"), F.lit("markdown").alias("kind"))


def _rows(rows):
    suffix = F.when(~F.col("kind").isin("paragraph", "heading", "listItem", "blockQuote"), F.md5("suffix"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "id", "kind", "translates", F.md5("source_text").alias("digest"), "prefix", suffix.alias("suffix"))


def seg3_markdown(spark, d):
    """Kept lines, table cells and prefixed paragraphs."""
    return _rows(text.segments(markdown_documents(spark, d), CONFIG))


def seg14_15_code_and_structure(spark, d):
    """The same with lines of code translated and prefixes as part of the text."""
    return _rows(text.segments(markdown_documents(spark, d), CONFIG, code=True, structure=False))


def seg3_render(spark, d):
    """The segments put together again are the text."""
    rows = text.segments(markdown_documents(spark, d), CONFIG)
    same = text.translatable(rows).select("doc_id", "id", F.col("source_text").alias("translated_text"))
    return text.render(rows, same).select("doc_id", F.md5("text").alias("digest"))


def chk2_markdown(spark, d):
    """Chunks of the Markdown documents."""
    return text.chunks(markdown_documents(spark, d), CONFIG).groupBy("doc_id").agg(F.sum("character_count").alias("characters"), F.sum("estimated_token_count").alias("tokens"), F.sum(F.size("segment_ids")).alias("segments"))


_LINES = r"""
src AS (SELECT doc_id, doc_id % 5 = 0 AS front, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}\x{85}]')) AS p FROM documents),
c AS (SELECT doc_id, front, len(p) AS n, i, (i + doc_id) % 12 AS k, p[i + 1] AS c FROM (SELECT *, unnest(range(0, len(p))) AS i FROM src)),
made AS (
  SELECT doc_id, i + CASE WHEN front THEN 3 ELSE 0 END AS no, i < n - 1 AS ended, k = 6 OR (k = 7 AND i > 0) AS comment, k IN (2, 4) AS toggle, false AS front,
    CASE k WHEN 0 THEN '# ' || c WHEN 1 THEN '- ' || c WHEN 2 THEN '```' WHEN 4 THEN '  ```' WHEN 5 THEN '| ' || replace(c, '|', '/') || ' || b \| c |' WHEN 6 THEN '<!-- ' || c WHEN 7 THEN c || ' -->' WHEN 8 THEN '> ' || c WHEN 9 THEN ' * * *' WHEN 11 THEN '12) ' || c ELSE c END AS line FROM c
  UNION ALL SELECT doc_id, i, true, false, false, true, ['---', 'title: x', '---'][i + 1] FROM src, range(0, 3) r(i) WHERE front
  UNION ALL SELECT doc_id, 0, false, false, false, false, '' FROM src WHERE NOT front AND len(p) = 0
)
"""
RENDER = f"WITH {_LINES} SELECT doc_id, md5(string_agg(line || CASE WHEN ended THEN chr(10) ELSE '' END, '' ORDER BY no)) AS digest FROM made GROUP BY doc_id"

_W = r"[\s\x{85}\p{Z}]"
_SEGMENTS = rf"""
WITH RECURSIVE {_LINES}, state AS (
  SELECT *, trim(regexp_replace(regexp_replace(line, '^{_W}+', ''), '{_W}+$', '')) AS bare, coalesce(sum(CASE WHEN toggle THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside,
    length(line) - length(replace(line, '|', '')) AS pipes FROM made
), kinds AS (
  SELECT *, CASE WHEN front THEN 'frontMatter' WHEN comment THEN 'preserved' WHEN toggle OR inside THEN 'codeBlock' WHEN bare = '' OR regexp_full_match(bare, '(?:[-*_]{_W}*){{3,}}') OR regexp_full_match(bare, '\|?\s*:?-{{3,}}:?\s*(?:\|\s*:?-{{3,}}:?\s*)+\|?') THEN 'preserved' WHEN pipes >= 2 THEN 'table' ELSE 'plain' END AS held FROM state
), cells AS (
  SELECT doc_id, no, ended, line, list_filter(range(1, length(line) + 1), lambda i: line[i] = '|' AND (i = 1 OR line[i - 1] <> '\')) AS cuts FROM kinds WHERE held = 'table'
), edges AS (SELECT doc_id, no, ended, line, list_concat([1], cuts, [length(line) + 1]) AS e FROM cells WHERE len(cuts) >= 2),
cell AS (SELECT doc_id, no, j, substr(line, e[j + 1], e[j + 2] - e[j + 1]) AS cell, CASE WHEN j = len(e) - 2 AND ended THEN chr(10) ELSE '' END AS tail FROM (SELECT *, unnest(range(0, len(e) - 1)) AS j FROM edges)),
body AS (SELECT *, regexp_extract(cell, '(?s)[^\s\p{{Z}}\x{{85}}|](?:.*[^\s\p{{Z}}\x{{85}}|])?') AS body FROM cell),
lead AS (
  SELECT *, CASE WHEN regexp_matches(line, '^{_W}*#{{1,6}}{_W}+') THEN 'heading' WHEN regexp_matches(line, '^{_W}*>+{_W}*') THEN 'blockQuote' WHEN regexp_matches(line, '^{_W}*(?:[-*+]{_W}+|\p{{Nd}}+[.)]{_W}+)') THEN 'listItem' ELSE 'paragraph' END AS kind FROM kinds WHERE held = 'plain'
), lines AS (
  SELECT doc_id, no AS line_no, kind, line, CASE kind WHEN 'heading' THEN regexp_extract(line, '^{_W}*#{{1,6}}{_W}+') WHEN 'blockQuote' THEN regexp_extract(line, '^{_W}*>+{_W}*') WHEN 'listItem' THEN regexp_extract(line, '^{_W}*(?:[-*+]{_W}+|\p{{Nd}}+[.)]{_W}+)') ELSE '' END AS prefix,
    substr(line, length(CASE kind WHEN 'heading' THEN regexp_extract(line, '^{_W}*#{{1,6}}{_W}+') WHEN 'blockQuote' THEN regexp_extract(line, '^{_W}*>+{_W}*') WHEN 'listItem' THEN regexp_extract(line, '^{_W}*(?:[-*+]{_W}+|\p{{Nd}}+[.)]{_W}+)') ELSE '' END) + 1) AS content FROM lead
), {SEGMENT_CUTS}, seg(doc_id, no, part, id, kind, translates, source, prefix, suffix) AS (
  SELECT doc_id, no, 0, printf('preserved-%06d', no), CASE WHEN held = 'table' THEN 'preserved' ELSE held END, false, line, '', CASE WHEN ended THEN chr(10) ELSE '' END FROM kinds WHERE held IN ('frontMatter', 'preserved', 'codeBlock') OR (held = 'table' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.doc_id = kinds.doc_id AND e.no = kinds.no))
  UNION ALL SELECT doc_id, no, j, printf('table-%06d-%03d', no, j), CASE WHEN body = '' THEN 'preserved' ELSE 'tableCell' END, body <> '', CASE WHEN body = '' THEN cell ELSE body END, CASE WHEN body = '' THEN '' ELSE substr(cell, 1, strpos(cell, body) - 1) END, CASE WHEN body = '' THEN tail ELSE substr(cell, strpos(cell, body) + length(body)) || tail END FROM body
  UNION ALL SELECT doc_id, line_no, part, printf('text-%06d-%03d', line_no, part), kind, true, piece, CASE WHEN part = 0 THEN prefix ELSE '' END, NULL FROM cut JOIN lines USING (doc_id, line_no) WHERE part >= 0
)
"""
SEG3 = _SEGMENTS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, part) - 1 AS ordinal, id, kind, translates, md5(source) AS digest, prefix, md5(suffix) AS suffix FROM seg"
_OPEN = r"(translates OR (kind = 'codeBlock' AND trim(source) <> '' AND NOT starts_with(ltrim(source), '```') AND NOT starts_with(ltrim(source), '~~~')))"
SEG14 = _SEGMENTS + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, part) - 1 AS ordinal, id, kind, {_OPEN} AS translates, md5(CASE WHEN {_OPEN} THEN prefix ELSE '' END || source) AS digest, CASE WHEN {_OPEN} THEN '' ELSE prefix END AS prefix, md5(suffix) AS suffix FROM seg"
CHK2 = _SEGMENTS + f"SELECT doc_id, CAST(sum(length(source)) AS BIGINT) AS characters, CAST(sum({TOKENS_SQL.format('source')}) AS BIGINT) AS tokens, count(*) AS segments FROM seg WHERE translates GROUP BY doc_id"

QUERIES = {"seg3_markdown": seg3_markdown, "seg14_15_code_and_structure": seg14_15_code_and_structure, "seg3_render": seg3_render, "chk2_markdown": chk2_markdown}
ORACLE_SQL = {"seg3_markdown": SEG3, "seg14_15_code_and_structure": SEG14, "seg3_render": RENDER, "chk2_markdown": CHK2}
