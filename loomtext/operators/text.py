"""Documents to lines, typed segments, token-budgeted chunks, and back (SEG1-SEG8, SEG14-15, CHK1-5, JN2-3, FIL1).

Segmenting and packing are a single pass over each document inside Arrow
batches, so the whole pipeline from text to chunks needs no shuffle; lines,
token estimates, prefixes and rendering are column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.functions.strings import WS, is_blank
from loomtext.schemas import CHUNKS, SEGMENT

# lines ----------------------------------------------------------------------------

_LINE = r"([^\r\n]*)(\r\n|\n|\r)|([^\r\n]+)"


def lines_array(text: Column) -> Column:
    """SEG1: array of lines, each with its ending; an empty text is one empty line."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LINE), 0)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def lines(docs: DataFrame) -> DataFrame:
    """SEG1: doc_id, line_no, content, line_ending."""
    raw = docs.select("doc_id", F.posexplode(lines_array(F.col("text"))).alias("line_no", "raw"))
    content = F.regexp_replace("raw", r"[\r\n]+$", "")
    return raw.select("doc_id", "line_no", content.alias("content"), F.substring("raw", F.length(content) + 1, F.length("raw")).alias("line_ending"))


def line_ending_class(text: Column) -> Column:
    """SEG2: ``mixed`` for several kinds of ending, else ``crlf``, ``cr`` or ``lf``."""
    crlf, rest = text.contains("\r\n"), F.replace(text, F.lit("\r\n"), F.lit(""))
    cr, lf = rest.contains("\r"), rest.contains("\n")
    kinds = crlf.cast("int") + cr.cast("int") + lf.cast("int")
    return F.when(kinds > 1, "mixed").when(crlf, "crlf").when(cr, "cr").otherwise("lf")


_HEADING = rf"^{WS}*#{{1,6}}{WS}+"
_QUOTE = rf"^{WS}*>+{WS}*"
_ITEM = rf"^{WS}*(?:[-*+]{WS}+|\p{{Nd}}+[.)]{WS}+)"


def markdown_prefix(line: Column) -> Column:
    """SEG4: struct(prefix, content, kind): the first of heading, quote and list item."""
    out = None
    for pattern, kind in reversed(((_HEADING, "heading"), (_QUOTE, "blockQuote"), (_ITEM, "listItem"))):
        prefix = F.regexp_extract(line, pattern, 0)
        rest = F.substring(line, F.length(prefix) + 1, F.length(line))
        one = F.struct(prefix.alias("prefix"), rest.alias("content"), F.lit(kind).alias("kind"))
        out = F.when(line.rlike(pattern), one).otherwise(F.struct(F.lit("").alias("prefix"), line.alias("content"), F.lit("paragraph").alias("kind")) if out is None else out)
    return out


_BREAK = rf"^(?:[-*_]{WS}*){{3,}}$"
_RULE = rf"^\|?{WS}*:?-{{3,}}:?{WS}*(?:\|{WS}*:?-{{3,}}:?{WS}*)+\|?$"


def is_thematic_break(line: Column) -> Column:
    """SEG5: a rule, or the rule row of a table."""
    return line.rlike(_BREAK) | line.rlike(_RULE)


def markdown_score(text: Column, most: int = 400) -> Column:
    """SRC4: evidence of Markdown in the first lines."""
    part = F.slice(F.split(text, r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"), 1, most)
    trimmed = F.transform(part, lambda x: F.regexp_replace(x, rf"^{WS}+|{WS}+$", ""))

    def one(x: Column) -> Column:
        flag = lambda c, n=1: F.when(c, n).otherwise(0)
        return (
            flag(x.rlike(rf"^#{{1,6}}{WS}+\S"), 2)
            + flag(x.startswith("```"), 2)
            + flag(x.rlike(rf"^[-*+]{WS}+\S"))
            + flag(x.rlike(rf"^\p{{Nd}}+[.)]{WS}+\S"))
            + flag(x.contains("](") | x.startswith("> "))
            + flag(F.regexp_count(x, F.lit(r"\|")) >= 2)
        )

    fence = F.exists(trimmed, lambda x: x.startswith("```"))
    return F.aggregate(trimmed, F.lit(0), lambda acc, x: acc + one(x)) + fence.cast("int")


# tokens ---------------------------------------------------------------------------

_FULL = r"[\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"
_QUARTER = r"[\x20-\x7E]"


def estimated_tokens(text: Column) -> Column:
    """CHK1: 1 for a Korean, Japanese or Chinese character, 1/4 for printable ASCII, 3/4 for others, rounded up."""
    full, quarter = F.regexp_count(text, F.lit(_FULL)), F.regexp_count(text, F.lit(_QUARTER))
    quarters = 4 * full + quarter + 3 * (F.length(text) - full - quarter)
    return F.ceil(quarters / 4).cast("long")


_FULL_RE = re.compile("[\uac00-\ud7af\u3040-\u30ff\u3400-\u9fff]")
_QUARTER_RE = re.compile(r"[\x20-\x7E]")


def count_tokens(text: str) -> int:
    if text.isascii() and text.isprintable():
        return -(-len(text) // 4)
    full, quarter = len(_FULL_RE.findall(text)), len(_QUARTER_RE.findall(text))
    return -(-(4 * full + quarter + 3 * (len(text) - full - quarter)) // 4)


# chunk settings ---------------------------------------------------------------------


@dataclass(frozen=True)
class ChunkConfig:
    """CHK4: limits of a chunk, kept consistent."""

    minimum: int = 700
    target: int = 2600
    maximum: int = 5200
    tokens: int = 2200
    segments: int = 40

    def __post_init__(self):
        least = max(100, self.minimum)
        most = max(least, self.maximum)
        for name, value in (("minimum", least), ("maximum", most), ("target", min(max(self.target, least), most)), ("tokens", max(256, self.tokens)), ("segments", max(1, self.segments))):
            object.__setattr__(self, name, value)


PROFILES = {
    "balanced": ChunkConfig(),
    "contextHeavy": ChunkConfig(1000, 4000, 7200, 3000, 60),
    "responsive": ChunkConfig(450, 1700, 3600, 1600, 28),
}


# segmenting -------------------------------------------------------------------------

_SPACE_CLASS = r"[\s\x85\u2028\u2029]"
_RE_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r)|([^\r\n]+)")
_RE_PREFIX = [
    (re.compile(r"\s*#{1,6}\s+"), "heading"),
    (re.compile(r"\s*>+\s*"), "blockQuote"),
    (re.compile(r"\s*(?:[-*+]\s+|\d+[.)]\s+)"), "listItem"),
]
_RE_RULES = (re.compile(r"(?:[-*_]\s*){3,}"), re.compile(r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?"))
_RE_BODY = re.compile(r"[^\s|](?:.*[^\s|])?", re.S)
_RE_STOP, _RE_BLANK, _RE_INLINE = re.compile("[.!?。！？]"), re.compile(r"\s"), re.compile(r"[^\S\r\n]*")


def split_long(content: str, most: int) -> list[tuple[str, str]]:
    """SEG7: (part, separator) pairs of at most ``most`` characters where a cut is found.

    A cut is after the last sentence end in reach, else at the last white
    space, else at the limit; inline white space after it is the separator.  A
    line whose only cut is at its beginning stays whole.
    """
    if len(content) <= most:
        return [(content, "")]
    ends = [m.end() for m in _RE_STOP.finditer(content)]
    blanks = [m.start() for m in _RE_BLANK.finditer(content)]
    parts, at = [], 0

    def last(places: list[int], reach: int) -> int:
        """The greatest of the places up to ``reach``; -1 without one."""
        k = bisect_right(places, reach)
        return places[k - 1] if k else -1

    while len(content) - at > most:
        end, blank = last(ends, at + most), last(blanks, at + most - 1)
        cut = end if end > at else blank if blank >= at else at + most
        if cut == at:
            break
        gap = _RE_INLINE.match(content, cut).end()
        parts.append((content[at:cut], content[cut:gap]))
        at = gap
    if at < len(content):
        parts.append((content[at:], ""))
    return parts


def _preserved(no: int, content: str, ending: str, kind: str = "preserved"):
    return (f"preserved-{no:06d}", content, "", ending, kind, False)


def _cells(no: int, content: str, ending: str):
    """SEG6: cells between unescaped pipes, each with the pipe before it."""
    cuts = [i for i, c in enumerate(content) if c == "|" and (i == 0 or content[i - 1] != "\\")]
    if len(cuts) < 2:
        yield _preserved(no, content, ending)
        return
    edges = [0, *cuts, len(content)]
    last = len(edges) - 2
    for k in range(last + 1):
        cell = content[edges[k] : edges[k + 1]]
        tail = ending if k == last else ""
        body = _RE_BODY.search(cell)
        name = f"table-{no:06d}-{k:03d}"
        if body is None:
            yield (name, cell, "", tail, "preserved", False)
        else:
            yield (name, body[0], cell[: body.start()], cell[body.end() :] + tail, "tableCell", True)


def _plain(no: int, content: str, ending: str, most: int, prefix: str, kind: str):
    parts = split_long(content, most)
    for k, (text, gap) in enumerate(parts):
        # the ending follows the separator of a last part, so nothing is lost
        yield (f"text-{no:06d}-{k:03d}", text, prefix if k == 0 else "", gap + (ending if k == len(parts) - 1 else ""), kind, True)


class _Markdown:
    """SEG3: what a line belongs to, given the lines before it."""

    def __init__(self):
        self.front = self.comment = self.fence = False

    def preserved_kind(self, no: int, line: str) -> str | None:
        if no == 0 and line == "---":
            self.front = True
        if self.front:
            self.front = no == 0 or line not in ("---", "...")
            return "frontMatter"
        if self.comment or line.startswith("<!--"):
            self.comment = "-->" not in line
            return "preserved"
        if line.startswith(("```", "~~~")):
            self.fence = not self.fence
            return "codeBlock"
        return "codeBlock" if self.fence else None


def segment_text(text: str | None, kind: str = "text", most: int = 5200):
    """Typed segments (id, source, prefix, suffix, kind, translates) whose parts together are the text."""
    markdown = _Markdown() if kind == "markdown" else None
    found = _RE_LINE.finditer(text or "")
    pairs = [(m[1], m[2]) if m[2] else (m[3], "") for m in found] or [("", "")]
    for no, (content, ending) in enumerate(pairs):
        line = content.strip()
        if markdown and (held := markdown.preserved_kind(no, line)):
            yield _preserved(no, content, ending, held)
        elif not line or markdown and any(r.fullmatch(line) for r in _RE_RULES):
            yield _preserved(no, content, ending)
        elif markdown and content.count("|") >= 2:
            yield from _cells(no, content, ending)
        elif markdown:
            prefix, name = next(((m[0], k) for r, k in _RE_PREFIX if (m := r.match(content))), ("", "paragraph"))
            yield from _plain(no, content[len(prefix) :], ending, most, prefix, name)
        else:
            yield from _plain(no, content, ending, most, "", "plainLine")


def _expose_code(segments):
    """SEG14: lines of code become translatable, fence lines don't."""
    for s in segments:
        body = s[1].strip()
        yield (*s[:5], True) if s[4] == "codeBlock" and body and not body.startswith(("```", "~~~")) else s


def _fold_prefix(segments):
    """SEG15: without protected structure the prefix is part of the source text."""
    for s in segments:
        yield (s[0], s[2] + s[1], "", *s[3:]) if s[5] and s[2] else s


# packing ------------------------------------------------------------------------------


def pack_segments(sizes: list[tuple[int, int]], c: ChunkConfig) -> list[int]:
    """CHK2, CHK3: the chunk of each translatable segment, from (characters, tokens)."""
    chunks: list[list[int]] = []  # characters, tokens, segments
    out = []
    open_ = False
    for chars, tokens in sizes:
        if open_:
            now = chunks[-1]
            open_ = now[0] + chars <= c.maximum and now[1] + tokens <= c.tokens and now[2] < c.segments
        if not open_:
            chunks.append([0, 0, 0])
        now = chunks[-1]
        now[0] += chars
        now[1] += tokens
        now[2] += 1
        out.append(len(chunks) - 1)
        open_ = now[0] < c.minimum or (now[0] < c.target and now[1] < c.tokens)
    if len(chunks) > 1 and chunks[-1][0] < c.minimum:
        both = [x + y for x, y in zip(chunks[-2], chunks[-1])]
        if both[0] <= c.maximum and both[1] <= c.tokens and both[2] <= c.segments:
            last = len(chunks) - 1
            out = [last - 1 if k == last else k for k in out]
    return out


_FIELDS = "characters int, tokens int, chunk int"


def _prepared(text: str | None, kind: str | None, config: ChunkConfig, code: bool, structure: bool):
    """A document's segments, their (characters, tokens), and the chunk of each translatable one."""
    found = segment_text(text, kind or "text", config.maximum)
    if code and kind == "markdown":
        found = _expose_code(found)
    if not structure:
        found = _fold_prefix(found)
    found = list(found)
    sizes = [(len(s[1]), count_tokens(s[1])) for s in found]
    return found, sizes, pack_segments([z for s, z in zip(found, sizes) if s[5]], config)


def _segmenter(config: ChunkConfig, code: bool, structure: bool):
    def run(batches):
        for batch in batches:
            docs, kinds = batch.column("doc_id"), batch.column("kind")
            columns: list[list] = [[] for _ in range(10)]
            offsets = [0]
            for text, kind in zip(batch.column("text"), kinds):
                found, sizes, packed = _prepared(text.as_py(), kind.as_py(), config, code, structure)
                chunk = iter(packed)
                for i, (s, z) in enumerate(zip(found, sizes)):
                    for column, value in zip(columns, (i, *s, *z, next(chunk) if s[5] else None)):
                        column.append(value)
                offsets.append(len(columns[0]))
            types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            names = ["ordinal", "id", "source_text", "prefix", "suffix", "kind", "translates", "characters", "tokens", "chunk"]
            rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], ["doc_id", "segments"])

    return run


def _chunker(config: ChunkConfig, code: bool, structure: bool):
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, kind in zip(*(batch.column(c) for c in ("doc_id", "text", "kind"))):
                found, sizes, packed = _prepared(text.as_py(), kind.as_py(), config, code, structure)
                ids: dict[int, list] = {}
                for k, (s, z) in zip(packed, ((s, z) for s, z in zip(found, sizes) if s[5])):
                    ids.setdefault(k, []).append((s[0], *z))
                for k, part in ids.items():
                    rows.append((doc.as_py(), k, f"chunk-{k:06d}", [p[0] for p in part], sum(p[1] for p in part), sum(p[2] for p in part)))
            types = [batch.column("doc_id").type, pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and kind (text or markdown; ``text`` where there is no such column)."""
    kind = F.col("kind") if "kind" in docs.columns else F.lit("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), kind.cast("string").alias("kind"))


def segmented(docs: DataFrame, config: ChunkConfig = PROFILES["balanced"], code: bool = False, structure: bool = True) -> DataFrame:
    """doc_id and the array of its segments, each with its chunk."""
    return _inputs(docs).mapInArrow(_segmenter(config, code, structure), f"doc_id long, segments array<struct<{_struct(SEGMENT)},{_struct(_FIELDS)}>>")


def _struct(columns: str) -> str:
    return ",".join(c.strip().replace(" ", ":") for c in columns.split(","))


def segments(docs: DataFrame, config: ChunkConfig = PROFILES["balanced"], **how) -> DataFrame:
    """SEG3-SEG8: one row per segment."""
    return segmented(docs, config, **how).select("doc_id", F.inline("segments"))


def translatable(rows: DataFrame) -> DataFrame:
    """FIL1."""
    return rows.where("translates")


def chunks(docs: DataFrame, config: ChunkConfig = PROFILES["balanced"], code: bool = False, structure: bool = True) -> DataFrame:
    """CHK2-CHK5: one row per chunk (doc_id, chunk, id, segment_ids, character_count, estimated_token_count).

    One pass over each document where it lies: no shuffle, work linear in its length.
    """
    return _inputs(docs).mapInArrow(_chunker(config, code, structure), CHUNKS)


def chunk_segments(chunk_rows: DataFrame, segment_rows: DataFrame) -> DataFrame:
    """JN2: chunk ids to segments in order; ``problem`` marks missing or untranslatable ids."""
    wanted = chunk_rows.select("doc_id", "chunk", F.posexplode("segment_ids").alias("place", "id"))
    known = segment_rows.select("doc_id", "id", "source_text", "translates")
    problem = F.when(F.col("translates").isNull(), "missing").when(~F.col("translates"), "not translatable")
    return wanted.join(known, ["doc_id", "id"], "left").select("doc_id", "chunk", "place", "id", "source_text", problem.alias("problem"))


def render(segment_rows: DataFrame, translations: DataFrame) -> DataFrame:
    """JN3: doc_id, text: translated segments, or their source where none is given, put together in order."""
    given = translations.select("doc_id", "id", "translated_text")
    text = F.coalesce(F.when(~is_blank(F.col("translated_text")), F.col("translated_text")), F.col("source_text"))
    piece = F.concat("prefix", F.when(F.col("translates"), text).otherwise(F.col("source_text")), "suffix")
    rows = segment_rows.join(given, ["doc_id", "id"], "left").select("doc_id", "ordinal", piece.alias("piece"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "piece"))), lambda x: x["piece"]), "").alias("text"))
