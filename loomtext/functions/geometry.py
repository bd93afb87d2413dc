"""Rectangles, colours and unit conversions (MTH6-MTH12). Rectangles are struct(x, y, w, h), y upwards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def area(r: Column) -> Column:
    return F.greatest(r["w"], F.lit(0.0)) * F.greatest(r["h"], F.lit(0.0))


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Overlap as a share of the smaller rectangle; 0 where that is empty."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, overlap_area(a, b) / small).otherwise(F.lit(0.0))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width as a share of the narrower rectangle."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    narrow = F.least(a["w"], b["w"])
    return F.when(narrow > 0, F.greatest(w, F.lit(0.0)) / narrow).otherwise(F.lit(0.0))


def mid_x(r: Column) -> Column:
    return r["x"] + r["w"] / 2


def mid_y(r: Column) -> Column:
    return r["y"] + r["h"] / 2


def union_bounds(prefix: str = "") -> list[Column]:
    """AGG12: aggregates for the rectangle around a group's rectangles (columns x, y, w, h)."""
    x, y, w, h = (F.col(prefix + n) for n in "xywh")
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("w"), (F.max(y + h) - F.min(y)).alias("h")]


def _linear(v: Column) -> Column:
    return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    """MTH7."""
    return 0.2126 * _linear(r) + 0.7152 * _linear(g) + 0.0722 * _linear(b)


def contrast_ratio(a: Column, b: Column) -> Column:
    """Of two luminances, 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def color_distance2(a: Column, b: Column) -> Column:
    """Squared distance of two struct(r, g, b)."""
    return sum((F.pow(a[c] - b[c], 2) for c in "rgb"), F.lit(0.0))


def contrast_text_color(r: Column, g: Column, b: Column) -> Column:
    """MTH8: black on light grounds, white on dark ones."""
    return F.when(0.2126 * r + 0.7152 * g + 0.0722 * b >= 0.52, "black").otherwise("white")


def inferred_alignment(left: Column, width: Column, column_left: Column, column_width: Column, size: Column, marker: Column) -> Column:
    """MTH9: alignment of a line in its column; list items and lines as wide as the column are left."""
    tolerance = F.least(F.greatest(0.8 * size, F.lit(5.0)), F.lit(18.0))
    before = left - column_left
    after = column_left + column_width - (left + width)
    return (
        F.when(marker | (column_width <= width), "left")
        .when((F.abs(before - after) / 2 <= tolerance) & (before > tolerance) & (after > tolerance), "center")
        .when((F.abs(after) <= tolerance) & (before > 2 * tolerance), "right")
        .otherwise("left")
    )


def highlighted_characters(length: Column, elapsed: Column, total: Column) -> Column:
    """MTH10: characters spoken after ``elapsed`` of ``total`` seconds."""
    share = F.least(F.greatest(elapsed / F.nullif(total, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(total <= 0, F.when(elapsed > 0, length).otherwise(0)).otherwise(F.floor(length * share)).cast("int")


def run_scale(target: Column, measured: Column) -> Column:
    """MTH11: horizontal scale of a run, kept within bounds."""
    return F.least(F.greatest(target / measured, F.lit(0.72)), F.lit(1.2))


def run_tracking(target: Column, measured: Column, gaps: Column) -> Column:
    """MTH11: extra space per gap, only near the right width and where it shows."""
    ratio = target / measured
    raw = F.least(F.greatest(0.35 * (target - measured) / F.greatest(gaps, F.lit(1)), F.lit(-0.18)), F.lit(0.18))
    return F.when(ratio.between(0.92, 1.08) & (F.abs(raw) >= 0.005), raw).otherwise(F.lit(0.0))


def points_to_emu(p: Column) -> Column:
    """MTH12: 12,700 to a point."""
    return F.round(p * 12700).cast("long")


def points_to_twips(p: Column) -> Column:
    return F.round(p * 20).cast("long")


def points_to_hundredths(p: Column) -> Column:
    return F.round(p * 100).cast("long")
