"""Queries on documents and pages: lines, segments, chunks, rendering, strings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomtext.functions import hashing, scripts, strings, timing
from loomtext.functions.merging import common_prefix_column, common_suffix_column, merge_column, overlap_column, revision_column
from loomtext.operators import envelope, text
from loomtext.plans._data import table
from loomtext.sources import files

CONFIG = text.PROFILES["balanced"]


def src1_file_kind(spark, d):
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, (".MD", ".txt", ".pdf ", ".docx", ".Markdown", ".tsv", ""))), (F.col("doc_id") % 7 + 1).cast("int"))
    url = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    return docs.select("doc_id", files.kind_of_extension(files.extension(url)).alias("kind"))


SRC1 = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' WHEN 4 THEN 'markdown' WHEN 5 THEN 'text' END AS kind FROM documents
"""


def src2_detect(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("url"), F.octet_length("text").cast("long").alias("byte_count"), F.col("text").cast("binary").alias("content"))
    return files.detect(docs).select("url", "kind", "encoding", "byte_count", "is_empty", "confidence")


SRC2 = r"""
WITH l AS (
  SELECT doc_id, text, list_slice(regexp_split_to_array(text, '[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'), 1, 400) AS x FROM documents
), t AS (SELECT doc_id, text, list_transform(x, lambda v: regexp_replace(v, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')) AS x FROM l),
s AS (
  SELECT doc_id, text, coalesce(list_sum(list_transform(x, lambda v:
    CASE WHEN regexp_matches(v, '^#{1,6}[\s\x{85}\p{Z}]+\S') THEN 2 ELSE 0 END + CASE WHEN starts_with(v, '```') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(v, '^[-*+][\s\x{85}\p{Z}]+\S') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(v, '^\p{Nd}+[.)][\s\x{85}\p{Z}]+\S') THEN 1 ELSE 0 END
    + CASE WHEN contains(v, '](') OR starts_with(v, '> ') THEN 1 ELSE 0 END + CASE WHEN len(string_split(v, '|')) > 2 THEN 1 ELSE 0 END)), 0) AS score FROM t
)
SELECT 'doc-' || doc_id AS url, CASE WHEN score >= 3 THEN 'markdown' ELSE 'text' END AS kind, 'utf-8' AS encoding, CAST(octet_length(encode(text)) AS BIGINT) AS byte_count,
       text = '' AS is_empty, CAST(CASE WHEN score >= 3 THEN 82 ELSE 72 END AS INTEGER) AS confidence FROM s
"""


def seg1_lines(spark, d):
    return text.lines(table(spark, d, "documents")).select("doc_id", "line_no", F.length("content").alias("n"), F.md5("content").alias("digest"), F.hex("line_ending").alias("ending"))


_LINES_SQL = r"""
l AS (
  SELECT doc_id, unnest(x) AS raw, unnest(range(0, len(x))) AS line_no
  FROM (SELECT doc_id, CASE WHEN len(y) > 0 THEN y ELSE [''] END AS x FROM (SELECT doc_id, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+') AS y FROM documents))
), lines AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(raw, '[\r\n]+$', '') AS content, substr(raw, length(regexp_replace(raw, '[\r\n]+$', '')) + 1) AS ending FROM l)
"""
SEG1 = f"WITH {_LINES_SQL} SELECT doc_id, line_no, CAST(length(content) AS INTEGER) AS n, md5(content) AS digest, hex(ending) AS ending FROM lines"


def seg2_line_endings(spark, d):
    docs = table(spark, d, "documents")
    made = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", "\n", "\r")).otherwise(F.col("text"))
    return docs.select("doc_id", text.line_ending_class(made).alias("ending"))


SEG2 = """
SELECT doc_id, CASE WHEN NOT contains(text, chr(10)) THEN 'lf' WHEN doc_id % 3 = 0 THEN 'crlf' WHEN doc_id % 3 = 1 THEN 'cr' ELSE 'lf' END AS ending FROM documents
"""


def seg4_prefixes(spark, d):
    lines = text.lines(table(spark, d, "documents"))
    lead = F.element_at(F.array(*map(F.lit, ("## ", "> ", " - ", "12) ", "", "#", "3."))), (F.col("line_no") % 7 + 1).cast("int"))
    p = text.markdown_prefix(F.concat(lead, F.col("content")))
    return lines.select("doc_id", "line_no", p["prefix"].alias("prefix"), p["kind"].alias("kind"), F.md5(p["content"]).alias("digest"), text.is_thematic_break(F.repeat(F.lit("-"), (F.col("line_no") % 5).cast("int"))).alias("is_break"))


_W = r"[\s\x{85}\p{Z}]"
SEG4 = rf"""
WITH {_LINES_SQL}, m AS (SELECT doc_id, line_no, ['## ', '> ', ' - ', '12) ', '', '#', '3.'][line_no % 7 + 1] || content AS c FROM lines), k AS (
  SELECT *, CASE WHEN regexp_matches(c, '^{_W}*#{{1,6}}{_W}+') THEN 'heading' WHEN regexp_matches(c, '^{_W}*>+{_W}*') THEN 'blockQuote'
                 WHEN regexp_matches(c, '^{_W}*(?:[-*+]{_W}+|\p{{Nd}}+[.)]{_W}+)') THEN 'listItem' ELSE 'paragraph' END AS kind FROM m
), p AS (
  SELECT *, CASE kind WHEN 'heading' THEN regexp_extract(c, '^{_W}*#{{1,6}}{_W}+') WHEN 'blockQuote' THEN regexp_extract(c, '^{_W}*>+{_W}*')
                 WHEN 'listItem' THEN regexp_extract(c, '^{_W}*(?:[-*+]{_W}+|\p{{Nd}}+[.)]{_W}+)') ELSE '' END AS prefix FROM k
)
SELECT doc_id, line_no, prefix, kind, md5(substr(c, length(prefix) + 1)) AS digest, line_no % 5 >= 3 AS is_break FROM p
"""


def seg_segments(spark, d):
    rows = text.segments(table(spark, d, "documents"), CONFIG)
    return rows.select("doc_id", "ordinal", "id", "kind", "translates", F.md5("source_text").alias("digest"), "characters", "tokens", "chunk")


def seg_plain(spark, d):
    """Segments of plain text: lines, parts of long lines, kept blank lines."""
    rows = text.segments(table(spark, d, "documents"), CONFIG)
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "id", "kind", "translates", F.md5("source_text").alias("digest"), F.col("characters").cast("long").alias("characters"), F.col("tokens").cast("long").alias("tokens"))


def chk1_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


TOKENS_SQL = r"CAST(ceil((3 * length({0}) - 2 * length(regexp_replace({0}, '[^\x20-\x7E]', '', 'g')) + length(regexp_replace({0}, '[^\x{{AC00}}-\x{{D7AF}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}]', '', 'g'))) / 4.0) AS BIGINT)"
CHK1 = f"SELECT doc_id, {TOKENS_SQL.format('text')} AS tokens FROM documents"


def chk2_chunks(spark, d):
    """The flagship: documents to token-budgeted chunks, map-only."""
    return text.chunks(table(spark, d, "documents"), CONFIG).select("doc_id", "chunk", "id", F.size("segment_ids").alias("segments"), F.element_at("segment_ids", 1).alias("first_segment"), "character_count", "estimated_token_count")


# Long lines are cut by a recursion, segments packed by another, both one step a row; the tail merge is a join.
SEGMENT_CUTS = r"""cut(doc_id, line_no, part, piece, rest) AS (
  SELECT doc_id, line_no, -1, '', content FROM lines WHERE trim(content) <> ''
  UNION ALL
  SELECT doc_id, line_no, part + 1,
         CASE WHEN length(rest) <= 5200 THEN rest ELSE substr(rest, 1, k) END,
         CASE WHEN length(rest) <= 5200 THEN '' ELSE regexp_replace(substr(rest, k + 1), '^[ \t]+', '') END
  FROM (SELECT *, coalesce(nullif(5200 - coalesce(nullif(strpos(reverse(regexp_replace(substr(rest, 1, 5200), '[.!?。！？]', '.', 'g')), '.'), 0), 5201) + 1, 0),
                           nullif(5200 - coalesce(nullif(strpos(reverse(substr(rest, 1, 5200)), ' '), 0), 5200), 0), 5200) AS k FROM cut)
  WHERE rest <> ''
)"""
_SEGMENTS_SQL = rf"""
{_LINES_SQL.strip()}, {SEGMENT_CUTS}, seg AS (
  SELECT doc_id, line_no, part, printf('text-%06d-%03d', line_no, part) AS id, length(piece) AS c, {TOKENS_SQL.format('piece')} AS t,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) AS k
  FROM cut WHERE part >= 0
)
"""
SEG_PLAIN = rf"""
WITH RECURSIVE {_SEGMENTS_SQL}, every AS (
  SELECT doc_id, line_no, part, 'text-' AS p, 'plainLine' AS kind, true AS translates, piece AS s FROM cut WHERE part >= 0
  UNION ALL SELECT doc_id, line_no, 0, 'preserved-', 'preserved', false, content FROM lines WHERE trim(content) = ''
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS ordinal, p || printf('%06d', line_no) || CASE WHEN translates THEN printf('-%03d', part) ELSE '' END AS id, kind, translates, md5(s) AS digest, length(s) AS characters, {TOKENS_SQL.format('s')} AS tokens FROM every
"""
CHK2 = rf"""
WITH RECURSIVE {_SEGMENTS_SQL}, pack(doc_id, k, id, c, t, chunk, chars, toks, segs, closed) AS (
  SELECT doc_id, k, id, c, t, 0, c, t, 1, (c >= 2600 OR t >= 2200) AND c >= 700 FROM seg WHERE k = 1
  UNION ALL
  SELECT doc_id, k, id, c, t, chunk + new, chars, toks, segs, (chars >= 2600 OR toks >= 2200) AND chars >= 700
  FROM (
    SELECT s.doc_id, s.k, s.id, s.c, s.t, p.chunk, n.new, CASE n.new WHEN 1 THEN s.c ELSE p.chars + s.c END AS chars,
           CASE n.new WHEN 1 THEN s.t ELSE p.toks + s.t END AS toks, CASE n.new WHEN 1 THEN 1 ELSE p.segs + 1 END AS segs
    FROM pack p JOIN seg s ON s.doc_id = p.doc_id AND s.k = p.k + 1,
         LATERAL (SELECT CASE WHEN p.closed OR p.chars + s.c > 5200 OR p.toks + s.t > 2200 OR p.segs + 1 > 40 THEN 1 ELSE 0 END AS new) n
  )
), g AS (
  SELECT doc_id, chunk, sum(c) AS c, sum(t) AS t, count(*) AS n FROM pack GROUP BY 1, 2
), m AS (
  SELECT *, max(chunk) OVER (PARTITION BY doc_id) AS last, lag(c) OVER w AS pc, lag(t) OVER w AS pt, lag(n) OVER w AS pn FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)
), j AS (
  SELECT doc_id, chunk, CASE WHEN chunk = last AND chunk > 0 AND c < 700 AND c + pc <= 5200 AND t + pt <= 2200 AND n + pn <= 40 THEN chunk - 1 ELSE chunk END AS final FROM m
)
SELECT doc_id, CAST(final AS INTEGER) AS chunk, printf('chunk-%06d', final) AS id, CAST(count(*) AS INTEGER) AS segments, min_by(pack.id, k) AS first_segment,
       CAST(sum(c) AS BIGINT) AS character_count, CAST(sum(t) AS BIGINT) AS estimated_token_count
FROM pack JOIN j USING (doc_id, chunk) GROUP BY doc_id, final
"""


def chk_profiles(spark, d):
    docs = table(spark, d, "documents")
    out = None
    for name, config in text.PROFILES.items():
        one = text.chunks(docs, config).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("estimated_token_count").alias("tokens")).withColumn("profile", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _profile_sql(name: str) -> str:
    c = text.PROFILES[name]
    limits = {"5201": c.maximum + 1, "5200": c.maximum, "2600": c.target, "2200": c.tokens, "700": c.minimum, "40": c.segments}
    sql = re.sub(r"\b(5201|5200|2600|2200|700)\b|(?<=> )40\b|(?<=<= )40\b", lambda m: str(limits[m[0]]), CHK2)
    return f"SELECT doc_id, count(*) AS chunks, CAST(sum(estimated_token_count) AS BIGINT) AS tokens, '{name}' AS profile FROM ({sql}) GROUP BY doc_id"


CHK_PROFILES = " UNION ALL ".join(f"({_profile_sql(name)})" for name in text.PROFILES)


def jn2_chunk_segments(spark, d):
    docs = table(spark, d, "documents")
    rows = text.chunk_segments(text.chunks(docs, CONFIG), text.segments(docs, CONFIG))
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("segments"), F.count("problem").alias("problems"), F.sum(F.length("source_text")).alias("characters"))


JN2 = f"SELECT doc_id, chunk, CAST(segments AS BIGINT) AS segments, CAST(0 AS BIGINT) AS problems, character_count AS characters FROM ({CHK2})"


def jn3_identity_render(spark, d):
    rows = text.segments(table(spark, d, "documents"), CONFIG)
    same = text.translatable(rows).select("doc_id", "id", F.col("source_text").alias("translated_text"))
    return text.render(rows, same).select("doc_id", F.md5("text").alias("digest"))


JN3 = "SELECT doc_id, md5(text) AS digest FROM documents"


def jn1_model_round_trip(spark, d):
    """Chunks as pages through the envelope, a deterministic model, the identity join, and rendering."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    rows = text.segments(docs, CONFIG)
    asked = text.translatable(rows).select(F.concat_ws("-", "doc_id", "chunk").alias("page_index"), "ordinal", "id", F.col("source_text").alias("text"), "doc_id")
    sent = envelope.serialize_pages(asked)
    got = envelope.translate_pages(sent, envelope.tagged("ko"), pause=0.0).select("page_index", F.posexplode("items").alias("ordinal", "item")).select("page_index", "ordinal", "item.id", "item.text")
    joined = envelope.join_responses(asked.drop("doc_id"), got)
    back = joined.where("status = 'ok'").select(F.split_part("page_index", F.lit("-"), F.lit(1)).cast("long").alias("doc_id"), "id", "translated_text")
    return text.render(rows, back).select("doc_id", F.length("text").alias("n"), F.regexp_count("text", F.lit(r"\[ko\] ")).alias("tags"))


# every translated piece comes back trimmed with a mark before it; the rest of the text stays
JN1_TRIP = rf"""
WITH RECURSIVE {_SEGMENTS_SQL}, p AS (
  SELECT doc_id, count(*) AS tags, sum(5 + length(regexp_replace(regexp_replace(piece, '^[\s\x{{85}}\p{{Z}}]+', ''), '[\s\x{{85}}\p{{Z}}]+$', '')) - length(piece)) AS more FROM cut WHERE part >= 0 GROUP BY doc_id
)
SELECT doc_id, CAST(length(text) + coalesce(more, 0) AS INTEGER) AS n, CAST(coalesce(tags, 0) AS INTEGER) AS tags FROM documents LEFT JOIN p USING (doc_id) WHERE length(text) > 0
"""


def str_scalars(spark, d):
    t = F.col("text")
    half = F.floor(F.length(t) / 2).cast("int")
    front, back = F.substr(t, F.lit(1), half), F.substr(t, half + 1)
    return table(spark, d, "documents").select(
        "doc_id", F.md5(strings.trim_all(F.concat(F.lit(" \t"), t, F.lit("\n ")))).alias("str1"), F.md5(strings.normalize_spaces(t)).alias("str2"),
        F.md5(strings.repeated_text_key(F.when(F.col("doc_id") % 5 == 0, F.lit(" 12 ")).otherwise(t))).alias("str3"),
        F.md5(strings.strip_consumed(t, front)).alias("str9"), F.md5(strings.join_non_blank(front, F.lit("  "), back)).alias("str10"),
        F.md5(strings.xml_escape(t)).alias("str11"), F.md5(strings.xml_clean(F.concat(t, F.chr(F.lit(1))))).alias("str12"), strings.is_xml_text(t).alias("str13"), F.md5(strings.bounded(t)).alias("str14"),
        hashing.sha256_prefix(t, 16).alias("mth2"),
    )


_X = r"regexp_replace(regexp_replace({0}, '^[\s\x{{85}}\p{{Z}}]+', ''), '[\s\x{{85}}\p{{Z}}]+$', '')"
_N = r"trim(regexp_replace({0}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_E = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
STR = f"""
SELECT doc_id, md5({_X.format('text')}) AS str1, md5({_N.format('text')}) AS str2,
  md5(CASE WHEN doc_id % 5 = 0 THEN '__page_number__' ELSE lower({_N.format('text')}) END) AS str3,
  md5(CASE WHEN {_X.format('substr(text, 1, length(text) // 2)')} = '' THEN text ELSE {_X.format("substr(text, length(" + _X.format('substr(text, 1, length(text) // 2)') + ") + 1)")} END) AS str9,
  md5(array_to_string(list_filter([{_X.format('substr(text, 1, length(text) // 2)')}, {_X.format('substr(text, length(text) // 2 + 1)')}], lambda x: x <> ''), ' ')) AS str10,
  md5({_E.format('text')}) AS str11, md5({_E.format('text')}) AS str12, true AS str13,
  md5(CASE WHEN length(text) > 1024 THEN substr(text, 1, 1024) || '…' ELSE text END) AS str14,
  substr(sha256(text), 1, 32) AS mth2
FROM documents
"""


def mth3_crc32(spark, d):
    """CRC-32 of the whole texts."""
    return table(spark, d, "documents").select("doc_id", hashing.crc32(F.col("text")).alias("mth3"))


# the usual table by its rule, eight steps for each byte, then a byte of the text at a time
MTH3 = """
WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT doc_id, hex(encode(text)) AS x FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(x), 2), lambda p: CAST('0x' || substr(x, p, 2) AS BIGINT)) AS bytes FROM d)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c // 256, crc[xor(c % 256, y) + 1])), 4294967295) AS mth3 FROM b, t
"""


_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\x{{85}}\p{{Z}}]+', ''), '[\s\x{{85}}\p{{Z}}]+$', '')"


def str4_8_merging(spark, d):
    """The first two thirds of a document's text and its last two thirds as growing snapshots."""
    docs = table(spark, d, "documents")
    third = F.floor(F.length("text") / 3).cast("int")
    a, b = F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("text"), third + 1, F.length("text"))
    return docs.select("doc_id", common_prefix_column(a, b).alias("str4"), common_suffix_column(a, b).alias("str5"), overlap_column(a, b).alias("str6"), revision_column(a, b).alias("str7"), F.md5(merge_column(a, b)).alias("str8"))


def _agreeing(a: str, b: str) -> str:
    """SQL: how many first elements two lists share."""
    return f"coalesce(nullif(list_position(list_transform(list_zip({a}, {b}, true), lambda z: z[1] = z[2]), false), 0) - 1, least(len({a}), len({b})))"


STR4 = rf"""
WITH d AS (SELECT doc_id, substr(text, 1, length(text) - length(text) // 3) AS a, substr(text, length(text) // 3 + 1) AS b FROM documents),
e AS (SELECT doc_id, false AS bare, a, b FROM d UNION ALL SELECT doc_id, true, {_TRIM.format('a')}, {_TRIM.format('b')} FROM d),
l AS (SELECT *, CASE WHEN a = '' THEN [] ELSE string_split(a, '') END AS x, CASE WHEN b = '' THEN [] ELSE string_split(b, '') END AS y FROM e),
p AS (SELECT *, {_agreeing('x', 'y')} AS head FROM l), r AS (SELECT *, least(len(x), len(y)) - head AS room FROM p),
s AS (SELECT *, list_reverse(x)[1:room] AS u, list_reverse(y)[1:room] AS v FROM r), t AS (SELECT *, CASE WHEN room > 0 THEN {_agreeing('u', 'v')} ELSE 0 END AS tail FROM s),
o AS (SELECT *, coalesce(list_max(list_filter(range(2, least(len(x), len(y), 256) + 1), lambda k: ends_with(a, substr(b, 1, k)))), 0) AS shared,
        least(len(x), len(y)) >= 5 AND head + tail >= 3 AND head + tail >= 0.6 * least(len(x), len(y)) AS revised FROM t)
SELECT w.doc_id, CAST(w.head AS INTEGER) AS str4, CAST(w.tail AS INTEGER) AS str5, CAST(w.shared AS INTEGER) AS str6, w.revised AS str7,
  md5(CASE WHEN m.a = '' OR m.b = '' THEN m.a || m.b WHEN ends_with(m.a, m.b) THEN m.a WHEN starts_with(m.b, m.a) OR m.revised THEN m.b WHEN m.shared > 0 THEN m.a || substr(m.b, m.shared + 1) ELSE m.a || ' ' || m.b END) AS str8
FROM o w JOIN o m ON m.doc_id = w.doc_id AND m.bare AND NOT w.bare
"""


def mth1_fnv(spark, d):
    """FNV-1a of the whole texts."""
    return table(spark, d, "documents").select("doc_id", hashing.fnv1a_hex(F.col("text")).alias("mth1"))


MTH1 = """
WITH d AS (SELECT doc_id, hex(encode(text)) AS x FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(x), 2), lambda p: CAST('0x' || substr(x, p, 2) AS BIGINT)::HUGEINT) AS bytes FROM d)
SELECT doc_id, ltrim(lower(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, y: xor(h, y) * 1099511628211 % 18446744073709551616::HUGEINT)::UBIGINT)), '0') AS mth1 FROM b
"""


def fil2_language_route(spark, d):
    docs = table(spark, d, "documents")
    part, even = F.col("text"), F.col("doc_id") % 2 == 0
    code = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).when(F.col("doc_id") % 4 == 1, F.concat(F.upper("lang"), F.lit("_XX"))).when(F.col("doc_id") % 4 == 2, F.lit(" ")).otherwise(F.lit("ko"))
    field = F.when(even, "original").otherwise("translation")
    return docs.select("doc_id", scripts.accepts(field, part, code, F.col("lang"), F.lit("ko")).alias("accepted"), F.array_join(F.array_sort(scripts.observed_scripts(part)), ",").alias("scripts"))


FIL2 = r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN (NOT regexp_matches(text, '[A-Za-z\x{C0}-\x{24F}]')) OR lang IN ('en', 'fr', 'de', 'es')
                    WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN lang = 'ko' ELSE true END AS accepted,
       CASE WHEN regexp_matches(text, '[A-Za-z\x{C0}-\x{24F}]') THEN 'latin' ELSE '' END AS scripts
FROM documents
"""


def agg17_speech(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(timing.speech_weight(F.col("text")), 4).alias("weight"), F.round(timing.speech_seconds(F.col("text")), 4).alias("seconds"))


_SPACE = r"length(regexp_replace(text, '[^\s\x{85}\p{Z}]', '', 'g'))"
_PUNCT = r"length(regexp_replace(text, '\P{P}', '', 'g'))"
AGG17 = f"""
SELECT doc_id, round(w, 4) AS weight, round(greatest(0.35, w / 18.5), 4) AS seconds
FROM (SELECT doc_id, CAST(length(text) - {_SPACE} - {_PUNCT} + 0.35 * {_PUNCT} AS DOUBLE) AS w FROM documents)
"""


def snk2_names(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", strings.safe_file_name(F.col("url")).alias("name"), strings.safe_file_name(F.lit(" ../ ")).alias("blank"))


SNK2 = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '(?:[\s\x{85}\p{Z}]|[/\\:*?"<>|])', '_', 'g'), '^[_.]+', ''), '[_.]+$', '') AS name, 'live-conversation' AS blank FROM pages
"""


def seg13_underlines(spark, d):
    html = F.col("html")
    marked = F.regexp_replace(F.regexp_replace(html, "<li>", "<u>"), "</li>", "</U>")
    return table(spark, d, "pages").select("page_id", F.size(strings.underlined(marked)).alias("n"), F.md5(F.array_join(strings.underlined(marked), "|")).alias("digest"), F.length(strings.without_underline_tags(marked)).alias("length"))


SEG13 = r"""
WITH m AS (SELECT page_id, replace(replace(html, '<li>', '<u>'), '</li>', '</U>') AS t FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(t, '(?is)<u>(.*?)</u>', 1)) AS INTEGER) AS n, md5(array_to_string(regexp_extract_all(t, '(?is)<u>(.*?)</u>', 1), '|')) AS digest,
       CAST(length(regexp_replace(t, '(?is)<u>(.*?)</u>', '\1', 'g')) AS INTEGER) AS length FROM m
"""

QUERIES = {
    "src1_file_kind": src1_file_kind, "src2_detect": src2_detect, "seg1_lines": seg1_lines, "seg2_line_endings": seg2_line_endings, "seg4_prefixes": seg4_prefixes, "seg_segments": seg_segments, "seg_plain": seg_plain,
    "chk1_tokens": chk1_tokens, "chk2_chunks": chk2_chunks, "chk_profiles": chk_profiles, "jn2_chunk_segments": jn2_chunk_segments, "jn3_identity_render": jn3_identity_render, "jn1_model_round_trip": jn1_model_round_trip,
    "str_scalars": str_scalars, "mth3_crc32": mth3_crc32, "str4_8_merging": str4_8_merging, "mth1_fnv": mth1_fnv, "fil2_language_route": fil2_language_route, "agg17_speech": agg17_speech, "snk2_names": snk2_names, "seg13_underlines": seg13_underlines,
}
ORACLE_SQL = {
    "src1_file_kind": SRC1, "src2_detect": SRC2, "seg1_lines": SEG1, "seg2_line_endings": SEG2, "seg4_prefixes": SEG4, "seg_plain": SEG_PLAIN, "chk1_tokens": CHK1, "chk2_chunks": CHK2, "chk_profiles": CHK_PROFILES, "jn2_chunk_segments": JN2,
    "jn3_identity_render": JN3, "jn1_model_round_trip": JN1_TRIP, "str_scalars": STR, "mth3_crc32": MTH3, "str4_8_merging": STR4, "mth1_fnv": MTH1, "fil2_language_route": FIL2, "agg17_speech": AGG17, "snk2_names": SNK2, "seg13_underlines": SEG13,
}
