"""Requests and responses of a translation model: envelope, identity join, retrying map (JSN1-3, JN1, JN13, JN18, DQ1-2, MAP1-5, SET1, SET6)."""

from __future__ import annotations

import time
from collections.abc import Callable
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions.arrow import arrow_function
from loomtext.functions.strings import is_blank, is_xml_text, trim_all, xml_clean
from loomtext.operators.joins import LISTED

ROOT, ITEM = "segments", "segment"

# serialise ----------------------------------------------------------------------


def serialize_pages(blocks: DataFrame) -> DataFrame:
    """JSN1: page_index, envelope: the page's blocks as one XML text, in order."""
    item = F.concat(F.lit(f'<{ITEM} id="'), xml_clean(F.col("id")), F.lit('">'), xml_clean(F.col("text")), F.lit(f"</{ITEM}>"))
    rows = blocks.select("page_index", "ordinal", item.alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "item"))), lambda x: x["item"]), "\n")
    return rows.groupBy("page_index").agg(F.concat(F.lit(f'<{ROOT} version="1">\n'), body, F.lit(f"\n</{ROOT}>")).alias("envelope"))


class _Strict:
    """Receives parser events; anything but one root of flat segments is malformed."""

    def __init__(self):
        self.path: list[str] = []
        self.roots = 0
        self.items: list[dict] = []
        self.fault = False

    def start(self, name, attributes):
        depth = len(self.path)
        good = (depth == 0 and name == ROOT) or (depth == 1 and name == ITEM and attributes.get("id"))
        self.fault |= not good
        self.roots += depth == 0
        if depth == 1:
            self.items.append({"id": attributes.get("id", ""), "text": ""})
        self.path.append(name)

    def end(self, name):
        self.path.pop()

    def text(self, data):
        if len(self.path) == 2:
            self.items[-1]["text"] += data
        else:
            self.fault |= bool(data.strip())


def parse_envelope(xml: str | None) -> list[dict] | None:
    """JSN2: [{id, text}] with trimmed texts, or None where the envelope is malformed."""
    handler = _Strict()
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = handler.start, handler.end, handler.text
    parser.EntityDeclHandler = lambda *a: setattr(handler, "fault", True)
    try:
        parser.Parse((xml or "").strip().encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return None
    if handler.fault or handler.roots != 1:
        return None
    return [{"id": x["id"], "text": x["text"].strip()} for x in handler.items]


_ITEMS = pa.list_(pa.struct([("id", pa.string()), ("text", pa.string())]))


@arrow_function(_ITEMS)
def envelope_items(xml: pa.Array) -> pa.Array:
    return pa.array([parse_envelope(x) for x in xml.to_pylist()], _ITEMS)


# validation ---------------------------------------------------------------------


def request_problems(blocks: DataFrame) -> DataFrame:
    """DQ1: page_index, ordinal, rule: for each page its first violation in scan order."""
    again = F.row_number().over(Window.partitionBy("page_index", "id").orderBy("ordinal")) > 1
    rule = (
        F.when(F.col("page_index") < 0, "negative page")
        .when(is_blank(F.col("id")), "blank id")
        .when(again, "duplicate id")
        .when(is_blank(F.col("text")), "blank text")
        .when(~(is_xml_text(F.col("id")) & is_xml_text(F.col("text"))), "invalid character")
    )
    found = blocks.withColumn("rule", rule).where("rule IS NOT NULL")
    return found.groupBy("page_index").agg(F.min(F.struct("ordinal", "rule")).alias("f")).select("page_index", "f.ordinal", "f.rule")


def join_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """JN1: request blocks with their translation and the page's status.

    The status is the first of ``duplicate``, ``blank``, ``unknown``, ``missing``
    that the page's response shows, or ``ok``; ids that go with it are sorted.
    Order within a response is its ``ordinal``.
    """
    reply = responses.select("page_index", "id", F.col("ordinal").alias("place"), F.col("text").alias("translated_text"))
    nth = F.row_number().over(Window.partitionBy("page_index", "id").orderBy("place"))
    marked = reply.withColumn("nth", nth)
    asked = requests.select("page_index", "id", "ordinal", F.col("text").alias("source_text"))
    scan = marked.withColumn("fault", F.when(F.col("nth") > 1, "duplicate").when(is_blank(F.col("translated_text")), "blank")).where("fault IS NOT NULL")
    scan = scan.groupBy("page_index").agg(F.min(F.struct("place", "fault", "id")).alias("s")).select("page_index", "s.fault", F.array("s.id").alias("ids"))
    both = asked.join(marked.where("nth = 1"), ["page_index", "id"], "full_outer")
    side = F.when(F.col("ordinal").isNull(), "unknown").when(F.col("place").isNull(), "missing")
    sets = both.withColumn("side", side).groupBy("page_index").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "unknown", F.col("id")))).alias("unknown"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "missing", F.col("id")))).alias("missing"),
    )
    status = sets.join(scan, "page_index", "left").select(
        "page_index",
        F.coalesce("fault", F.when(F.size("unknown") > 0, "unknown"), F.when(F.size("missing") > 0, "missing"), F.lit("ok")).alias("status"),
        F.coalesce("ids", F.when(F.size("unknown") > 0, F.col("unknown")), F.when(F.size("missing") > 0, F.col("missing")), F.array().cast("array<string>")).alias("problem_ids"),
    )
    return both.where("ordinal IS NOT NULL").select("page_index", "ordinal", "id", "source_text", trim_all(F.col("translated_text")).alias("translated_text")).join(status, "page_index")


def map_client_responses(responses: DataFrame) -> DataFrame:
    """JN18: rows without a client id are errors that name their place."""
    return responses.withColumn("problem", F.when(F.col("id").isNull(), F.concat(F.lit("no client id at "), F.col("ordinal").cast("string"))))


def id_difference(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """SET1: ids of one side only, with the side, sorted."""
    a = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").select(key, F.lit("left").alias("side"))
    b = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").select(key, F.lit("right").alias("side"))
    return a.unionByName(b)


def has_exact_keys(json: Column, *keys: str) -> Column:
    """SET6: the object's keys are exactly these."""
    return F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)])


# responses ------------------------------------------------------------------------

RESPONSE = (
    "output_text string, output array<struct<text:string,content:array<struct<text:string>>>>, "
    "candidates array<struct<finishReason:string,content:struct<parts:array<struct<text:string>>>>>, "
    "promptFeedback struct<blockReason:string>"
)
# Reasons that mean a blocked answer.
BLOCKING = ("SAFETY", "RECITATION", "LANGUAGE", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "IMAGE_SAFETY", "IMAGE_PROHIBITED_CONTENT")


def response_text(body: Column) -> Column:
    """JSN3: struct(text, problem) of a response in any of its layouts."""
    r = F.from_json(body, RESPONSE)
    filled = lambda c: F.nullif(c, F.lit(""))
    texts = lambda a: F.filter(F.transform(a, lambda x: x["text"]), lambda t: t.isNotNull())
    reasons = F.transform(r["candidates"], lambda c: F.upper(trim_all(c["finishReason"])))
    blocked = F.upper(F.nullif(trim_all(r["promptFeedback"]["blockReason"]), F.lit("")))
    stop = F.get(F.filter(reasons, lambda x: x.isin("MAX_TOKENS", *BLOCKING)), 0)
    first = F.get(F.filter(texts(r["output"]), lambda t: t != ""), 0)
    content = F.array_join(texts(F.flatten(F.filter(F.transform(r["output"], lambda o: o["content"]), lambda c: c.isNotNull()))), "\n")
    parts = F.array_join(texts(F.flatten(F.filter(F.transform(r["candidates"], lambda c: c["content"]["parts"]), lambda c: c.isNotNull()))), "\n")
    text = filled(trim_all(F.coalesce(filled(r["output_text"]), first, filled(content), filled(parts))))
    problem = F.when(blocked.isNotNull(), F.concat(F.lit("blocked: "), blocked)).when(stop == "MAX_TOKENS", "truncated").when(stop.isNotNull(), F.concat(F.lit("blocked: "), stop)).when(text.isNull(), "empty")
    return F.struct(F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


# the model as a map -----------------------------------------------------------------

Model = Callable[[str], str]


def tagged(tag: str) -> Model:
    """A deterministic stand-in for a model: every segment gets a language tag in front."""

    def run(envelope: str) -> str:
        items = parse_envelope(envelope) or []
        body = "\n".join(f'<{ITEM} id="{_escape(x["id"])}">[{tag}] {_escape(x["text"])}</{ITEM}>' for x in items)
        return f'<{ROOT} version="1">\n{body}\n</{ROOT}>'

    return run


def _escape(s: str) -> str:
    from xml.sax.saxutils import escape

    return escape(s, {'"': "&quot;", "'": "&apos;"})


def _strip_fence(s: str) -> str:
    lines = s.strip().split("\n")
    fenced = len(lines) > 1 and lines[0].strip().lower() in ("```", "```xml") and lines[-1].strip() == "```"
    return "\n".join(lines[1:-1]).strip() if fenced else s.strip()


def check_reply(ids: list[str], reply: str) -> tuple[list[dict], str | None]:
    """Items of a reply in the order asked for, or what is wrong with it."""
    items = parse_envelope(_strip_fence(reply))
    if items is None:
        return [], "malformed"
    seen: dict[str, str] = {}
    for x in items:
        if x["id"] in seen:
            return [], f"duplicate: {x['id']}"
        if not x["text"]:
            return [], f"blank: {x['id']}"
        seen[x["id"]] = x["text"]
    if extra := sorted(set(seen) - set(ids)):
        return [], f"unknown: {','.join(extra)}"
    if lack := sorted(set(ids) - set(seen)):
        return [], f"missing: {','.join(lack)}"
    return [{"id": i, "text": seen[i]} for i in ids], None


def translate_pages(envelopes: DataFrame, model: Model, attempts: int = 3, pause: float = 0.35) -> DataFrame:
    """MAP1-MAP3: page_index, items, tries, problem. Pages without blocks don't appear and cost no call.

    A reply with a data error is asked for again; after the last attempt the
    page is skipped with its problem, and its source text stands.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for envelope in batch.column("envelope").to_pylist():
                ids = [x["id"] for x in parse_envelope(envelope) or []]
                items, problem, tries = [], None, 0
                while ids and tries < attempts:
                    if tries and pause:
                        time.sleep(pause)
                    tries += 1
                    try:
                        items, problem = check_reply(ids, model(envelope))
                    except Exception as e:  # noqa: BLE001  a failing call is retried like a bad reply
                        items, problem = [], f"{type(e).__name__}: {e}"
                    if problem is None:
                        break
                for column, value in zip(out, (items, tries, problem)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("page_index"), pa.array(out[0], _ITEMS), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["page_index", "items", "tries", "problem"])

    index = dict(envelopes.dtypes)["page_index"]
    return envelopes.select("page_index", "envelope").mapInArrow(run, f"page_index {index}, items array<struct<id:string,text:string>>, tries int, problem string")


def fan_out(requests: DataFrame, models: DataFrame, available: DataFrame, model: Callable[[str, str], str]) -> DataFrame:
    """JN13, MAP4: every request to every listed model that is available, in the models' order.

    One failure does not stop the rest.  The product is what is asked for; the list of models is broadcast if it is one (``LISTED`` rows).
    """
    known = available.select("model", F.lit(True).alias("available"))
    listed = models.select("model", "place").join(known, "model", "left").withColumn("available", F.coalesce("available", F.lit(False)))

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for name, text, up in zip(*(batch.column(c).to_pylist() for c in ("model", "text", "available"))):
                try:
                    texts.append(model(name, text) if up else None)
                    errors.append(None if up else "unavailable")
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("request_id", "model", "place", "available")), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["request_id", "model", "place", "available", "translated_text", "error"])

    pairs = requests.select("request_id", "text").crossJoin(F.broadcast(listed) if listed.limit(LISTED + 1).count() <= LISTED else listed)
    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, f"request_id {types['request_id']}, model string, place {types['place']}, available boolean, translated_text string, error string")


def preferred_result(results: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """MAP5: the result of highest ``priority`` that has arrived, per key; of equal ones the least ``order``, a whole number, then the greater text."""
    rest = [c for c in results.columns if c not in (*keys, order)]
    earlier = [F.bitwise_not(F.col(order).cast("long"))] if order else []
    rank = F.when(F.col("priority").isNotNull(), F.struct("priority", *earlier, "translated_text"))
    best = results.where("translated_text IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("b"))
    return best.select(*keys, "b.*")
