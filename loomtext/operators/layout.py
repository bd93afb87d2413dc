"""Positioned text of pages: columns, reading order, blocks, page furniture (SRT1-2, GRP1-6, WIN7-8, SEG10-11, FIL6-7, JN8).

Rows carry (page, id, text, x, y, w, h, size, color, source); y grows upwards.
Predicates are column expressions.  What depends on the order of a page's own
rows runs in one Arrow group per page, which a page bounds.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from dataclasses import dataclass
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions.strings import normalize_spaces

# List markers and words of legal footers.
MARKERS = ("•", "◦", "○", "●", "▪", "▫", "‣", "⁃", "-", "–", "—", "*", "o", "O", "0", "")
LEGAL = ("©", "copyright", "all rights reserved", "confidential", "internal", "disclosure prohibited")


def starts_with_marker(text: Column) -> Column:
    """GRP3: the first word is a bullet, or digits with only dots or brackets behind them."""
    first = F.split_part(normalize_spaces(text), F.lit(" "), F.lit(1))
    return first.isin(*MARKERS) | first.rlike(r"^\p{N}*[.)]+$")


def _marked(text: str) -> bool:
    first = (text.split() or [""])[0]
    tail = first.lstrip("".join(c for c in set(first) if c.isnumeric())) if first else ""
    return first in MARKERS or bool(tail) and not tail.strip(".)")


def is_furniture(text: Column, y: Column, h: Column, size: Column, page_y: Column, page_h: Column) -> Column:
    """FIL6: legal lines of the bottom 15 %, and small digits or punctuation of the bottom 9 %."""
    t = F.lower(normalize_spaces(text))
    top = y + h
    legal = F.exists(F.array(*[F.lit(w) for w in LEGAL]), lambda w: t.contains(w))
    number = (t != "") & t.rlike(r"^[\p{Nd}\s\p{Z}\p{P}]+$")
    return ((top <= page_y + 0.15 * page_h) & legal) | ((top <= page_y + 0.09 * page_h) & (size <= F.greatest(F.lit(10.0), 0.025 * page_h)) & number)


def is_hidden(trusted: Column, complex_ground: Column, distance2: Column, contrast: Column) -> Column:
    """FIL7: text in the colour of its ground."""
    return trusted & ~complex_ground & (distance2 <= 0.0025) & (contrast <= 1.08)


# order of a page --------------------------------------------------------------------


def _above(a: dict, b: dict) -> int:
    """SRT1: higher first unless nearly level, then from the left. Not transitive; inputs come in a fixed order."""
    top_a, top_b = a["y"] + a["h"], b["y"] + b["h"]
    if abs(top_a - top_b) > max(2.0, 0.35 * min(a["h"], b["h"])):
        return -1 if top_a > top_b else 1
    return (a["x"] > b["x"]) - (a["x"] < b["x"])


def vertical_order(lines: list[dict]) -> list[dict]:
    return sorted(lines, key=cmp_to_key(_above))


@dataclass
class Cluster:
    """Lines whose left edges are near each other; bounds and edges are kept as lines come."""

    left: float
    right: float
    edges: list[float]
    lines: list[dict]

    def distance(self, line: dict, near: float) -> float | None:
        """How far the line's left edge is from the middle one of the cluster, if the line fits in."""
        away = abs(line["x"] - self.edges[len(self.edges) // 2])
        narrow = max(1.0, min(line["w"], self.right - self.left))
        shared = max(0.0, min(line["x"] + line["w"], self.right) - max(line["x"], self.left))
        fits = away <= near or (shared >= 0.25 * narrow and away <= max(2 * near, 0.35 * narrow))
        return away if fits else None

    def add(self, line: dict) -> None:
        self.left, self.right = min(self.left, line["x"]), max(self.right, line["x"] + line["w"])
        insort(self.edges, line["x"])
        self.lines.append(line)


def clusters(lines: list[dict], page_width: float) -> list[Cluster]:
    """GRP6: clusters of lines by left edge, from left to right; a line joins the nearest that it fits."""
    near = max(12.0, 0.045 * page_width)
    found: list[Cluster] = []
    for line in sorted(lines, key=lambda r: (r["x"], -(r["y"] + r["h"]))):
        ranked = [(away, k) for k, c in enumerate(found) if (away := c.distance(line, near)) is not None]
        if ranked:
            found[min(ranked)[1]].add(line)
        else:
            found.append(Cluster(line["x"], line["x"] + line["w"], [line["x"]], [line]))
    return sorted(found, key=lambda c: c.left)


def _regions(bars: list[float], top: float, bottom: float):
    """The number of the region between two wide lines that a height is in; heights outside the page are in the last."""
    above = [top, *bars]
    below = [*bars, bottom]
    falling = all(a >= b for a, b in zip(above, below))
    depth = [-v for v in below]

    def region(middle: float) -> int:
        if falling:
            k = bisect_right(depth, -middle)
            return k if k < len(below) and middle <= above[k] else len(below)
        return next((k for k, (high, low) in enumerate(zip(above, below)) if low < middle <= high), len(below))

    return region


def reading_order(lines: list[dict], page: tuple[float, float, float, float]) -> list[dict]:
    """SRT2: wide lines divide the page into regions; a line's place is its region, its column, and its height in it."""
    _, page_y, page_w, page_h = page
    lines = sorted(lines, key=lambda r: (r["id"] or "", r["text"] or ""))
    is_wide = [r["w"] >= max(0.5 * page_w, 1.0) for r in lines]
    wide, body = ([r for r, w in zip(lines, is_wide) if w is k] for k in (True, False))
    columns = clusters(body, page_w)
    for r in wide:
        r["column_index"] = -1 if len(columns) > 1 else 0
    for number, cluster in enumerate(columns):
        for r in cluster.lines:
            r["column_index"] = number
    if len(columns) < 2:
        return vertical_order(lines)
    bars = vertical_order(wide)
    region = _regions([r["y"] + r["h"] / 2 for r in bars], page_y + page_h + 1, page_y - 1)
    placed: dict[tuple[int, int], list[dict]] = {(k, len(columns)): [bar] for k, bar in enumerate(bars)}
    for r in body:
        placed.setdefault((region(r["y"] + r["h"] / 2), r["column_index"]), []).append(r)
    return [r for key in sorted(placed) for r in vertical_order(placed[key])]


# blocks -------------------------------------------------------------------------------


def _pair(above: dict, line: dict, first: dict) -> dict[str, float | bool]:
    """What is measured between a line, the line above it, and the first of that line's block."""
    size = max(above["size"], line["size"])
    return {
        "list": _marked(first["text"] or ""),
        "marked": _marked(line["text"] or ""),
        "alike": (above["source"], above["color"]) == (line["source"], line["color"]),
        "column": above["column_index"] == line["column_index"] >= 0,
        "spanning": first["column_index"] < 0,
        "gap": above["y"] - (line["y"] + line["h"]),
        "tall": max(above["h"], line["h"]),
        "hang": (line["x"] - first["x"]) / max(6.0, 0.5 * min(above["size"], line["size"])),
        "shared": min(above["x"] + above["w"], line["x"] + line["w"]) - max(above["x"], line["x"]),
        "narrow": max(1.0, min(above["w"], line["w"])),
        "shift": abs(above["x"] - line["x"]) / max(24.0, 2.5 * size),
        "growth": abs(above["size"] - line["size"]) / max(1.5, 0.18 * above["size"]),
    }


def can_join(above: dict, line: dict, first: dict) -> bool:
    """GRP2: whether a line continues the block that began with ``first``; lines of a list item may overlap more."""
    p = _pair(above, line, first)
    closest = -0.42 if p["list"] and p["hang"] >= 1 else -0.15
    place = p["column"] or (p["list"] and p["spanning"])
    return bool(p["alike"] and place and not p["marked"] and closest * p["tall"] <= p["gap"] <= 0.85 * p["tall"] and p["shared"] >= 0.35 * p["narrow"] and p["shift"] <= 1 and p["growth"] <= 1)


LAYOUT = "reading_order int, column_index int, block int"


def _page(width: float, height: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ordered = reading_order(rows.to_pylist(), (0.0, 0.0, width, height))
        block, first = -1, None
        for place, line in enumerate(ordered):
            line["reading_order"] = place
            if first is None or not can_join(ordered[place - 1], line, first):
                block, first = block + 1, line
            line["block"] = block
        fields = [*rows.schema, pa.field("reading_order", pa.int32()), pa.field("column_index", pa.int32()), pa.field("block", pa.int32())]
        return pa.Table.from_pylist(ordered, pa.schema(fields))

    return run


def laid_out(lines: DataFrame, *keys: str, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """SRT2, WIN1, GRP1: every line with its reading order, column and block; one group per page."""
    schema = ", ".join(f"{c} {t}" for c, t in lines.dtypes)
    return lines.groupBy(*(keys or ("page",))).applyInArrow(_page(width, height), f"{schema}, {LAYOUT}")


def block_rows(lines: DataFrame, *keys: str) -> DataFrame:
    """GRP1, AGG12, AGG13: a row per block: its text, bounds, first column and lines."""
    from loomtext.operators.aggregates import joined_text

    keys = keys or ("page",)
    text = joined_text(lines, "reading_order", "text", *keys, "block")
    box = lines.groupBy(*keys, "block").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.min("reading_order").alias("reading_order"), F.min_by("column_index", "reading_order").alias("column_index"), F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "id"))), lambda v: v["id"]).alias("line_ids"),
    )
    return box.join(text, [*keys, "block"])


def list_alignment(lines: DataFrame, *keys: str) -> DataFrame:
    """GRP4: lines of blocks that begin with a list marker are aligned left."""
    first = F.first_value("text").over(Window.partitionBy(*(keys or ("page",)), "block").orderBy("reading_order"))
    return lines.withColumn("alignment", F.when(starts_with_marker(first), "left").otherwise(F.col("alignment")))


def region_index(lines: DataFrame, *keys: str, width: float = 612.0) -> DataFrame:
    """WIN7: how many wide lines are above each line."""
    wide = F.when(F.col("w") >= 0.5 * width, 1).otherwise(0)
    return lines.withColumn("region", F.coalesce(F.sum(wide).over(Window.partitionBy(*(keys or ("page",))).orderBy(F.desc(F.col("y") + F.col("h") / 2)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def gutters(columns: DataFrame, *keys: str, width: float = 612.0) -> DataFrame:
    """WIN8: each column (x, w) with the bounds halfway to its neighbours."""
    order = Window.partitionBy(*(keys or ("page",))).orderBy("x")
    right = F.col("x") + F.col("w")
    low = F.coalesce((F.lag(right).over(order) + F.col("x")) / 2, F.lit(0.0))
    high = F.coalesce((right + F.lead("x").over(order)) / 2, F.lit(width))
    return columns.withColumn("left_bound", low).withColumn("right_bound", high)


def oversized_gaps(glyphs: DataFrame, *keys: str) -> DataFrame:
    """SEG10: a visual row is cut where both the white space and the true gap between glyphs are wide."""
    order = Window.partitionBy(*keys).orderBy("x")
    limit = F.greatest(F.lit(12.0), 2 * F.col("size"))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    cut = F.when((F.col("space_width") > limit) & (gap > limit), 1).otherwise(0)
    return glyphs.withColumn("part", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def color_runs(runs: DataFrame, *keys: str, order: str = "ordinal") -> DataFrame:
    """SEG11: neighbours whose colours differ by more than 0.01 in a channel are apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    apart = F.greatest(*[F.abs(F.col(c) - F.lag(c).over(w)) for c in "rgb"]) > 0.01
    marked = runs.withColumn("cut", F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0))
    return marked.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


# text boxes and rectangles -----------------------------------------------------------------


def _merge_boxes(level: str):
    size_share, gap_least, gap_share, left_least, left_share = MERGE_LEVELS[level]

    def higher(a: dict, b: dict) -> int:
        top_a, top_b = a["y"] + a["h"], b["y"] + b["h"]
        if abs(top_a - top_b) > 0.5:
            return -1 if top_a > top_b else 1
        return (a["x"] > b["x"]) - (a["x"] < b["x"])

    def continues(now: dict, box: dict) -> bool:
        if {now["role"], box["role"]} != {"editableContent"} or now["alignment"] != box["alignment"]:
            return False
        scale = max(5.0, now["size"], box["size"])
        left = max(left_least, left_share * scale)
        if abs(now["size"] - box["size"]) > size_share * scale or now["y"] - (box["y"] + box["h"]) > max(gap_least, gap_share * scale):
            return False
        touching = box["y"] + box["h"] >= now["y"] and now["y"] + now["h"] >= box["y"]
        shared = max(0.0, min(now["x"] + now["w"], box["x"] + box["w"]) - max(now["x"], box["x"])) if touching else 0.0
        if shared < 0.22 * max(1.0, min(now["w"], box["w"])) and abs(now["x"] - box["x"]) > left:
            return False
        tabs = [r.get("tab_stops") or [] for r in (now, box)]
        return len(tabs[0]) == len(tabs[1]) and all(abs(p - q) <= left for p, q in zip(*tabs))

    def joined(now: dict, box: dict) -> dict:
        x, y = min(now["x"], box["x"]), min(now["y"], box["y"])
        new = now | {"x": x, "y": y, "w": max(r["x"] + r["w"] for r in (now, box)) - x, "h": max(r["y"] + r["h"] for r in (now, box)) - y}
        new |= {"id": f"merged-{now['id']}-{box['id']}", "text": f"{now['text']}\n{box['text']}", "size": max(now["size"], box["size"])}
        if "tab_stops" in now:
            new["tab_stops"] = (now["tab_stops"] or []) + (box["tab_stops"] or [])
        return new

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out: list[dict] = []
        for box in sorted(sorted(rows.to_pylist(), key=lambda r: r["id"]), key=cmp_to_key(higher)):
            if out and continues(out[-1], box):
                out[-1] = joined(out[-1], box)
            else:
                out.append(box)
        return pa.Table.from_pylist(out, rows.schema)

    return run


# Size difference as a share, gap and left edge each as points and as a share of the size.
MERGE_LEVELS = {"balanced": (0.18, 18.0, 1.25, 10.0, 1.25), "broad": (0.35, 36.0, 2.5, 24.0, 2.5)}


def merged_boxes(boxes: DataFrame, level: str = "balanced", *keys: str) -> DataFrame:
    """GRP5: boxes (role, alignment, …) from the top that continue the box built so far, which is what each is compared with."""
    if level == "separate":
        return boxes
    return boxes.groupBy(*(keys or ("page",))).applyInArrow(_merge_boxes(level), boxes.schema)


def _contained(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    def holds(a: dict, b: dict) -> bool:
        t = 0.75
        within = a["x"] - t <= b["x"] and a["y"] - t <= b["y"] and a["x"] + a["w"] + t >= b["x"] + b["w"] and a["y"] + a["h"] + t >= b["y"] + b["h"]
        return within and a["w"] >= b["w"] + 2 and a["h"] >= b["h"] + 2 and max(abs(a[c] - b[c]) for c in "rgb") <= 0.012

    def plain(r: dict) -> bool:
        return r["opaque"] and not r["stroked"] and r["w"] > 1 and r["h"] > 1

    kept: list[dict] = []
    for r in sorted(rows.to_pylist(), key=lambda r: (r["paint_order"], r["id"])):
        if plain(r):
            if any(plain(k) and holds(k, r) for k in kept):
                continue
            kept = [k for k in kept if not (plain(k) and holds(r, k))]
        kept.append(r)
    return pa.Table.from_pylist(kept, rows.schema)


def without_contained(rects: DataFrame, *keys: str) -> DataFrame:
    """JN8: opaque unstroked rectangles inside another of their colour go, in paint order (SRT3)."""
    return rects.groupBy(*(keys or ("page",))).applyInArrow(_contained, rects.schema)


def overlay_order(rows: DataFrame, slides: bool) -> DataFrame:
    """SRT4: (order, kind, id) on slides; in documents only on pages drawn as a picture, else as inserted; rows inserted at one place follow their ids."""
    use = F.lit(True) if slides else F.col("raster_fallback")
    keys = [F.when(use, F.col("paint_order")), F.when(use, F.col("kind")), F.when(use, F.col("id")), F.col("inserted"), F.col("id")]
    return rows.withColumn("z", F.row_number().over(Window.partitionBy("page").orderBy(*keys)) - 1)
