"""Choices about scene objects and package options (FIL8, FIL10-13, PRJ3, SET4, DQ4, DQ6, MAP6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def pages_with_blocks(pages: DataFrame) -> DataFrame:
    """FIL8."""
    return pages.where(F.size("blocks") > 0)


def image_can_be_drawn(native: Column, clipped: Column, has_alpha: Column, masked: Column, layered: Column, raster_fallback: Column, keep_alpha: Column) -> Column:
    """FIL10: transparent or masked images only if that is kept; over a repaired page picture native ones without a clip, else what the layered template allows."""
    return (keep_alpha | ~(has_alpha | masked)) & F.when(raster_fallback, native & ~clipped).otherwise(layered)


def vector_can_be_drawn(native: Column, alpha: Column, verified: Column, raster_fallback: Column, keep_vectors: Column) -> Column:
    """FIL11: over a page picture only opaque verified vectors, else all native ones. ``alpha`` is the lower of stroke and fill."""
    return keep_vectors & native & (~raster_fallback | ((alpha >= 0.999) & verified))


def text_visual_policy(lines: Column) -> Column:
    """FIL12: by all lines (array of struct(editable, safe)): preserve, replace or repair."""
    editable, safe = F.forall(lines, lambda x: x["editable"]), F.forall(lines, lambda x: x["safe"])
    return F.when((F.size(lines) == 0) | ~editable, "preserve").when(safe, "replace").otherwise("repair")


def needs_floating_box(shaded_lines: Column, lines: Column, fonts: Column, has_tabs: Column, indents: Column, size: Column, alignment: Column, level: str = "balanced") -> Column:
    """FIL13: text that a flowing paragraph can't hold: panels, several fonts, tabs, drifting indents, and by level more."""
    if level == "never":
        return F.lit(False)
    panel = (shaded_lines > 0) & ((shaded_lines == lines) | (lines == 1))
    mixed = (F.size(F.array_distinct(fonts)) > 1) | has_tabs
    spread = F.coalesce(F.array_max(indents) - F.array_min(indents), F.lit(0.0))
    scale = F.greatest(F.lit(5.0), size)
    if level == "conservative":
        return panel | mixed | (spread > F.greatest(F.lit(12.0), scale))
    several = lines > 1
    balanced = panel | mixed | (spread > F.greatest(F.lit(6.0), 0.5 * scale)) | (several & (alignment != "left"))
    return balanced | several if level == "permissive" else balanced


def pipeline_options(options: DataFrame) -> DataFrame:
    """PRJ3: one row of settings per format -> the row the pipeline runs with."""
    slides = F.col("format") == "pptx"
    return options.select(
        "format",
        F.when(slides, F.col("slide_merge_level")).otherwise(F.col("document_merge_level")).alias("merge_level"),
        F.when(slides, F.lit(False)).otherwise(F.col("header_footer")).alias("header_footer"),
        F.when(slides, F.col("master")).otherwise(F.lit(False)).alias("master"),
        "keep_transparency",
        F.when(slides, F.lit(2400)).otherwise(F.least(F.col("raster_side"), F.lit(3200))).alias("raster_side"),
    )


def without_background(plan: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """SET4: plan keys other than the document's background key."""
    return plan.join(backgrounds.select("doc", "key"), ["doc", "key"], "left_anti")


def changed_pages(before: DataFrame, after: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """DQ4: pages whose presence, boxes or rotation differ; boxes are arrays of four numbers."""
    b = after.select("page", F.col("boxes").alias("b2"), F.col("rotation").alias("r2"))
    both = before.join(b, "page", "full_outer")
    moved = F.exists(F.zip_with(F.flatten("boxes"), F.flatten("b2"), lambda x, y: F.abs(x - y) > tolerance), lambda v: v)
    problem = F.when(F.col("r2").isNull() | F.col("rotation").isNull(), "page count").when(F.col("rotation") != F.col("r2"), "rotation").when(moved, "box")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("page", "problem")


def analysis_problems(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """DQ6: page, problem: lines without a block, blocks that name unknown lines, repeated line ids."""
    named = blocks.select("page", F.explode("line_ids").alias("id"))
    lost = lines.join(named, ["page", "id"], "left_anti").select("page", F.concat(F.lit("no block: "), F.col("id")).alias("problem"))
    unknown = named.join(lines.select("page", "id"), ["page", "id"], "left_anti").select("page", F.concat(F.lit("unknown line: "), F.col("id")).alias("problem"))
    again = lines.groupBy("page", "id").agg(F.count("*").alias("n")).where("n > 1").select("page", F.concat(F.lit("repeated line: "), F.col("id")).alias("problem"))
    return lost.unionByName(unknown).unionByName(again)


def reflow(text: str, widths: list[float], measure: Callable[[str], float]) -> list[str]:
    """MAP6: a text over source lines of given widths.

    The longest beginning that fits is found by halving; it is cut back to white
    space if that keeps at least half, and never leaves up to two marks alone on
    the next line. Lines without text are ''.
    """
    out, rest = [], text.strip()
    for k, width in enumerate(widths):
        if not rest or k == len(widths) - 1:
            out.append(rest)
            rest = ""
            continue
        low, high = 1, len(rest)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if measure(rest[:mid]) <= width else (low, mid - 1)
        cut = low
        if cut < len(rest):
            back = max(rest.rfind(" ", 0, cut + 1), rest.rfind("\n", 0, cut + 1))
            cut = back if back >= cut / 2 and back > 0 else cut
            tail = rest[cut:].strip()
            if 0 < len(tail) <= 2 and not any(c.isalnum() for c in tail):
                cut = len(rest)
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return out
