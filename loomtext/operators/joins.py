"""Identity, merge and geometric joins (JN4-JN17, FIL16, SET3, SET5).

Geometric joins carry the equal keys (document, page), so that Spark hashes on
them and checks the geometry as a residual predicate.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions.geometry import area, color_distance2, mid_x, mid_y, overlap_area, overlap_of_smaller
from loomtext.functions.strings import normalize_spaces


def _rect(alias: str) -> dict[str, Column]:
    return {n: F.col(f"{alias}.{n}") for n in "xywh"}


PAGE = ("doc", "page")
LISTED = 10_000  #: rows of a listed side up to which it is broadcast


def _on_page(a: str, b: str, keys: tuple[str, ...]) -> Column:
    return reduce(and_, (F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys))


def _listed(side: DataFrame) -> DataFrame:
    """A side that is a list by its nature; a longer one is left to the planner."""
    return F.broadcast(side) if side.limit(LISTED + 1).count() <= LISTED else side


def drop_recognized_twice(recognized: DataFrame, native: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """JN4: recognised rows that no native row of the page covers or repeats."""
    a, b = _rect("o"), _rect("n")
    same = normalize_spaces(F.lower(F.col("o.text"))) == normalize_spaces(F.lower(F.col("n.text")))
    near = (F.abs(mid_x(a) - mid_x(b)) <= F.greatest(a["w"], b["w"])) & (F.abs(mid_y(a) - mid_y(b)) <= 2 * F.greatest(a["h"], b["h"]))
    return recognized.alias("o").join(native.alias("n"), _on_page("o", "n", keys) & ((overlap_of_smaller(a, b) >= 0.4) | (same & near)), "left_anti")


def link_targets(rows: DataFrame, links: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """JN5: rows with the one URL that links over them agree on, else null."""
    a, b = _rect("l"), _rect("k")
    hit = rows.alias("l").join(links.alias("k"), _on_page("l", "k", keys) & (overlap_of_smaller(a, b) >= 0.2))
    found = hit.groupBy("l.id").agg(F.count_distinct("k.url").alias("n"), F.min("k.url").alias("url"))
    return rows.join(found.select("id", F.when(F.col("n") == 1, F.col("url")).alias("url")), "id", "left")


def overlay_conflicts(overlays: DataFrame, annotations: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """JN6: overlays that touch an annotation other than links to one and the same URL."""
    a, b = _rect("o"), _rect("a")
    hit = overlays.alias("o").join(annotations.alias("a"), _on_page("o", "a", keys) & (overlap_area(a, b) > 0))
    plain = F.col("a.url").isNull()
    judged = hit.groupBy("o.id").agg(F.max(plain.cast("int")).alias("other"), F.count_distinct("a.url").alias("urls"))
    return overlays.join(judged.where("other = 1 OR urls > 1").select("id"), "id", "left_semi")


def occluded(templates: DataFrame, foreground: DataFrame, share: float = 0.55, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """JN7: template rows of which a foreground row of the page covers the share; none of them empty."""
    a, b = _rect("t"), _rect("f")
    # divided, as a quotient that is exactly the share rounds to the share itself, and share * area may round above the overlap
    covered = overlap_area(a, b) / F.nullif(area(a), F.lit(0.0))
    return templates.alias("t").join(foreground.alias("f"), _on_page("t", "f", keys) & (covered >= share), "left_semi")


def touching_chrome(rows: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """JN9: small native rows of the bottom tenth next to a seed there; one hop, as seeds are fixed. Rows carry r, g, b and page_height."""
    a, b = _rect("r"), _rect("s")
    gap_x = F.greatest(a["x"] - (b["x"] + b["w"]), b["x"] - (a["x"] + a["w"]), F.lit(0.0))
    gap_y = F.greatest(a["y"] - (b["y"] + b["h"]), b["y"] - (a["y"] + a["h"]), F.lit(0.0))
    height = F.col("r.page_height")
    large = F.greatest(F.col("r.size"), F.col("s.size"))
    close = (gap_x <= F.greatest(F.lit(14.0), 2 * large)) & (gap_y <= F.greatest(F.lit(8.0), 1.5 * large))
    shades = color_distance2(*({c: F.col(f"{t}.{c}") for c in ("r", "g", "b")} for t in ("r", "s")))
    alike = (F.abs(F.col("r.size") - F.col("s.size")) <= 3) & (shades <= 0.08)
    low = (F.col("r.source") == "native") & (a["y"] + a["h"] <= 0.1 * height) & (b["y"] + b["h"] <= 0.1 * height) & (F.col("r.size") <= F.greatest(F.lit(10.0), 0.027 * height))
    return rows.alias("r").join(seeds.alias("s"), _on_page("r", "s", keys) & (F.col("r.id") != F.col("s.id")) & low & close & alike, "left_semi")


def resolve_blocks(blocks: DataFrame, line_texts: DataFrame, block_texts: DataFrame) -> DataFrame:
    """JN10: how each block (id, line_ids, text) is translated.

    ``lines``: every line has a translation, merged in order; ``block``: no line
    has one and the block has; ``partial`` and ``none`` are for the caller to
    refuse or to skip with a warning.
    """
    lines = blocks.select("id", F.posexplode("line_ids").alias("place", "line_id"))
    hit = lines.join(line_texts.select(F.col("id").alias("line_id"), F.col("text").alias("line_text")), "line_id", "left")
    per = hit.groupBy("id").agg(F.count("*").alias("n"), F.count("line_text").alias("direct"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line_text"))), lambda x: x["line_text"]), " ").alias("merged"))
    out = blocks.join(per, "id", "left").join(block_texts.select("id", F.col("text").alias("block_text")), "id", "left")
    how = F.when(F.col("direct") == F.col("n"), "lines").when(F.coalesce("direct", F.lit(0)) > 0, "partial").when(F.col("block_text").isNotNull(), "block").otherwise("none")
    out = out.withColumn("how", how)
    return out.select("id", "how", F.when(F.col("how") == "lines", F.col("merged")).when(F.col("how") == "block", F.col("block_text")).alias("translated_text"))


def merge_on_load(local: DataFrame, loaded: DataFrame, deleted: DataFrame, key: str = "id", cleared: bool = False) -> DataFrame:
    """JN11, JN12, SET3: local rows first, then loaded ones that are neither local nor deleted; a cleared store keeps local rows only."""
    if cleared:
        return local
    rest = loaded.join(local.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti")
    return local.unionByName(rest)


def merge_conversations(local: DataFrame, loaded: DataFrame) -> DataFrame:
    """JN12: an unused provisional row of the local side goes before loaded rows are added."""
    used = local.where(~(F.col("provisional") & (F.col("message_count") == 0)))
    return used.unionByName(loaded.join(used.select("id"), "id", "left_anti"))


def resolve_device(wanted: DataFrame, devices: DataFrame, preferred: list[str]) -> DataFrame:
    """JN15: request_id, device: exact label, exact name, part of either, preferred names, else the first.

    Each wanted name is resolved once, then joined back to its requests.
    """
    w, label, name = F.col("w"), F.lower("label"), F.lower("name")
    liked = F.array_position(F.array(*[F.lit(p.lower()) for p in preferred]).cast("array<string>"), name)
    part = (w != "") & (label.contains(w) | name.contains(w) | w.contains(label) | w.contains(name))
    rank = F.when(label == w, 0).when(name == w, 1).when(part, 2).when(liked > 0, 3 + liked).otherwise(4 + len(preferred))
    asked = wanted.withColumn("w", F.coalesce(F.lower("wanted"), F.lit("")))
    pairs = asked.select("w").distinct().join(_listed(devices.select("label", "name", "place")), F.lit(True), "left")
    best = pairs.withColumn("rank", rank).groupBy("w").agg(F.min_by("name", F.struct("rank", "place")).alias("device"))
    return asked.join(best, "w").select("request_id", "device")


def lost_rows(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """JN16, DQ5: keys that occur less often after than before, with both counts; additions are fine."""
    a = before.groupBy(*keys).agg(F.count("*").alias("before"))
    b = after.groupBy(*keys).agg(F.count("*").alias("after"))
    return a.join(b, list(keys), "left").withColumn("after", F.coalesce("after", F.lit(0))).where("after < before")


def _flat(path: Column) -> Column:
    """A path without '.' and empty steps, and with each '..' taken off with the step before it."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.slice(steps, 1, 0)
    taken = F.aggregate(steps, empty, lambda done, x: F.when(x != "..", F.concat(done, F.array(x))).when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
    return F.array_join(taken, "/")


def dangling_targets(parts: DataFrame) -> DataFrame:
    """JN17, DQ3: relationship targets of package parts (name, data text) that no part has; web and mail targets are not looked for."""
    found = parts.where(F.col("name").endswith(".rels")).select("name", F.explode(F.regexp_extract_all("data", F.lit(r'(?s)<Relationship\b([^>]*)>'), 1)).alias("tag"))
    target = F.regexp_extract("tag", r'\bTarget="([^"]*)"', 1)
    outside = F.col("tag").rlike(r'TargetMode="External"') | F.lower("target").rlike("^(https?|mailto):")
    base = F.regexp_replace(F.regexp_replace("name", r"_rels/[^/]*$", ""), "/$", "")
    path = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), F.col("target")))
    wanted = found.withColumn("target", target).where((F.col("target") != "") & ~outside).select("name", _flat(path).alias("part"))
    return wanted.join(parts.select(F.col("name").alias("part")), "part", "left_anti")


def duplicate_names(parts: DataFrame, key: str = "name") -> DataFrame:
    """SET5."""
    return parts.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def current_generation(rows: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """FIL16: rows of the newest generation of their key; stale results go."""
    newest = rows.groupBy(key).agg(F.max(generation).alias("newest"))
    return rows.join(newest, key).where(F.col(generation) == F.col("newest")).drop("newest")


def last_answer(items: DataFrame, key: str = "turn_id") -> DataFrame:
    """SRT8: per turn the last ``final_answer``, else the last without a phase."""
    rank = F.when(F.col("phase") == "final_answer", 1).when(F.col("phase").isNull(), 0)
    return items.where(rank.isNotNull()).groupBy(key).agg(F.max_by("text", F.struct(rank, F.col("ordinal"))).alias("text"))


def latest_by(rows: DataFrame, key: str, at: str, ordinal: str) -> DataFrame:
    """AGG19: newest row per key; the first wins a tie."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), ordinal))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
