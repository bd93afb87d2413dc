"""Counts, representatives and robust statistics over pages and documents (AGG1-AGG20, WIN1-WIN6, GRP7).

Values that recur across pages are counted once per page (``count_distinct``)
or per occurrence (``count``); the two are separate operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions.geometry import color_distance2
from loomtext.functions.hashing import quantized
from loomtext.functions.strings import repeated_text_key


def document_counts(pages: DataFrame) -> DataFrame:
    """AGG1: per document its pages, lines, warnings and pages with any warning."""
    return pages.groupBy("doc").agg(
        F.count("*").alias("pages"), F.sum("line_count").alias("lines"), F.sum("warning_count").alias("warnings"), F.count_if(F.col("warning_count") > 0).alias("pages_with_warnings")
    )


def report(pages: DataFrame) -> DataFrame:
    """AGG2: one row per document: the roll-up and its page rows in order."""
    rows = F.array_sort(F.collect_list(F.struct("page", "line_count", "warning_count")))
    return pages.groupBy("doc").agg(F.sum("line_count").alias("lines"), F.sum("warning_count").alias("warnings"), rows.alias("page_metrics"))


def page_threshold(pages: Column) -> Column:
    """Half the pages, rounded up, but two at least."""
    return F.greatest(F.lit(2), F.ceil(pages / 2))


def repeated_edges(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """AGG3: (doc, band, key, font) that occur in a page's edge band on enough distinct pages.

    ``lines``: doc, page, text, top and bottom as shares of the page's own crop
    box (0 at the bottom), size. Documents of one page have none.
    """
    band = F.when(F.col("bottom") >= 0.82, "header").when(F.col("top") <= 0.18, "footer")
    keyed = lines.withColumn("band", band).where("band IS NOT NULL").withColumn("key", repeated_text_key(F.col("text"))).where("key <> ''").withColumn("font", quantized(F.col("size"), 0.5))
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    found = keyed.groupBy("doc", "band", "key", "font").agg(F.count_distinct("page").alias("pages"))
    return found.join(total, "doc").where((F.col("n") > 1) & (F.col("pages") >= page_threshold(F.col("n")))).select("doc", "band", "key", "font", "pages")


def promote_edges(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """AGG4: lines with ``is_chrome`` set where their edge key repeats; those already set stay."""
    band = F.when(F.col("bottom") >= 0.82, "header").when(F.col("top") <= 0.18, "footer")
    keyed = lines.withColumn("band", band).withColumn("key", repeated_text_key(F.col("text"))).withColumn("font", quantized(F.col("size"), 0.5))
    hit = repeated.select("doc", "band", "key", "font", F.lit(True).alias("hit"))
    return keyed.join(hit, ["doc", "band", "key", "font"], "left").withColumn("is_chrome", F.col("is_chrome") | F.coalesce("hit", F.lit(False))).drop("band", "key", "font", "hit")


def shared_templates(objects: DataFrame) -> DataFrame:
    """AGG5: objects whose fingerprint is on several pages are shared, with more confidence."""
    shared = objects.groupBy("doc", "fingerprint").agg(F.count_distinct("page").alias("pages")).where("pages > 1")
    out = objects.join(shared, ["doc", "fingerprint"], "left")
    many = F.col("pages").isNotNull()
    return out.withColumn("role", F.when(many, "sharedTemplate").otherwise(F.col("role"))).withColumn("confidence", F.when(many, F.least(F.lit(0.99), F.col("confidence") + 0.08)).otherwise(F.col("confidence"))).drop("pages")


def master_plan(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """AGG6: (doc, kind, key) for the master; text counts once a page, vectors and images per occurrence."""
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    seen = objects.groupBy("doc", "kind", "key").agg(F.count("*").alias("times"), F.count_distinct("page").alias("pages"))
    count = F.when(F.col("kind") == "text", F.col("pages")).otherwise(F.col("times"))
    return seen.join(total, "doc").withColumn("count", count).where(F.col("count") >= page_threshold(F.col("n"))).select("doc", "kind", "key", "count")


def master_background(backgrounds: DataFrame) -> DataFrame:
    """AGG6: the document's commonest background key; the greater key wins a tie."""
    seen = backgrounds.groupBy("doc", "key").agg(F.count("*").alias("times"))
    return seen.groupBy("doc").agg(F.max_by("key", F.struct("times", "key")).alias("key"))


def header_footer_plan(objects: DataFrame, first_boxes: DataFrame) -> DataFrame:
    """AGG7: like ``master_plan`` for running headers and footers.

    Every kind counts per occurrence; bands are of the first page's crop box
    (doc, y, h, n pages); page numbers are one key; geometry counts in 4 pt.
    """
    placed = objects.join(first_boxes.select("doc", F.col("y").alias("box_y"), F.col("h").alias("box_h"), "n"), "doc")
    low, high = (F.col("y") - F.col("box_y")) / F.col("box_h"), (F.col("y") + F.col("h") - F.col("box_y")) / F.col("box_h")
    band = F.when(low >= 0.82, "header").when(high <= 0.18, "footer")
    key = F.concat_ws("|", F.col("kind"), F.when(F.col("kind") == "text", repeated_text_key(F.col("text"))).otherwise(F.col("key")), *[quantized(F.col(c), 4.0).cast("string") for c in ("x", "y")])
    seen = placed.withColumn("band", band).where("band IS NOT NULL").withColumn("plan_key", key).groupBy("doc", "band", "plan_key").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    return seen.where(F.col("times") >= page_threshold(F.col("n"))).select("doc", "band", "plan_key", "times")


def last_representative(rows: DataFrame, keys: list[str], ordinal: str, *values: str) -> DataFrame:
    """AGG8: the row that came last for each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), ordinal).alias("v")).select(*keys, "v.*")


def dominant_color(samples: DataFrame, *keys: str) -> DataFrame:
    """AGG9: mean colour of the fullest of 12 x 12 x 12 buckets, the first of equals; ``dominant`` of ``samples`` lie in it."""
    bucket = [F.least(F.lit(11), F.floor(F.col(c) * 12)).cast("int").alias(f"b{c}") for c in "rgb"]
    seen = samples.select(*keys, *"rgb", *bucket).groupBy(*keys, "br", "bg", "bb").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    best = F.max_by(F.struct(*"rgb"), F.struct("n", F.struct(-F.col("br"), -F.col("bg"), -F.col("bb")))).alias("c")
    return seen.groupBy(*keys).agg(best, F.max("n").alias("dominant"), F.sum("n").alias("samples")).select(*keys, "c.r", "c.g", "c.b", "dominant", "samples")


def is_complex(samples: DataFrame, dominant: DataFrame, *keys: str) -> DataFrame:
    """AGG10: whether more than 12 % of the samples lie outside the dominant bucket, and all are far from its colour on average."""
    joined = samples.alias("s").join(dominant.alias("d"), list(keys))
    d2 = color_distance2(*({c: F.col(f"{a}.{c}") for c in "rgb"} for a in "sd"))
    out = joined.groupBy(*keys).agg((1 - F.max(F.col("d.dominant")) / F.count("*")).alias("secondary"), F.avg(d2).alias("mean_d2"))
    return out.withColumn("complex", (F.col("secondary") > 0.12) & (F.col("mean_d2") > 0.02))


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted array, the upper of two."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def median_deviation(values: Column) -> Column:
    m = upper_median(values)
    return upper_median(F.transform(values, lambda v: F.abs(v - m)))


def block_alignment(lines: DataFrame, *keys: str) -> DataFrame:
    """AGG11: the edge whose positions spread least, where it leads clearly; else null.

    Lines of nearly one width, single lines and lists (``marker``) say nothing.
    """
    per = lines.groupBy(*keys).agg(
        F.collect_list("x").alias("l"), F.collect_list(F.col("x") + F.col("w") / 2).alias("m"), F.collect_list(F.col("x") + F.col("w")).alias("r"),
        F.max("size").alias("f"), F.count("*").alias("n"), (F.max("w") - F.min("w")).alias("spread"),
        (F.bool_or("marker") if "marker" in lines.columns else F.lit(False)).alias("listed"),
    )
    d = {k: median_deviation(F.col(k)) for k in "lmr"}
    ranked = F.array_sort(F.array(*[F.struct(d[k].alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (k, name) in enumerate((("l", "left"), ("m", "center"), ("r", "right")))]))
    best, second = ranked[0], ranked[1]
    clear = (F.col("n") >= 2) & ~F.col("listed") & (F.col("spread") >= F.greatest(F.lit(4.0), 0.7 * F.col("f"))) & (best["d"] <= F.greatest(F.lit(1.25), 0.11 * F.col("f"))) & (second["d"] - best["d"] >= F.greatest(F.lit(1.5), 0.22 * F.col("f")))
    return per.select(*keys, F.when(clear, best["name"]).alias("alignment"))


def joined_text(rows: DataFrame, ordinal: str, text: str, *keys: str) -> DataFrame:
    """AGG13: texts in order, joined by spaces; a hyphen at the end of one is dropped and the next follows directly."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text))), lambda x: x[text])
    glue = lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(F.substring(a, 1, F.length(a) - 1), x)).otherwise(F.concat(a, F.lit(" "), x))
    return rows.groupBy(*keys).agg(F.aggregate(parts, F.lit(""), glue).alias("text"))


def low_confidence(rows: DataFrame, *keys: str, least: float = 0.55) -> DataFrame:
    """AGG14."""
    return rows.groupBy(*keys).agg(F.min("confidence").alias("confidence")).where(F.col("confidence") < least)


def page_ranges(rows: DataFrame, *keys: str, page: str = "page") -> DataFrame:
    """WIN6: runs of consecutive pages per key: first and last."""
    one = rows.select(*keys, page).distinct()
    island = F.col(page) - F.row_number().over(Window.partitionBy(*keys).orderBy(page))
    return one.withColumn("island", island).groupBy(*keys, "island").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("island")


def grouped_warnings(warnings: DataFrame, pages: DataFrame) -> DataFrame:
    """AGG15: (doc, tag, page_count, times, pages): the pages as ``1-3, 5`` or ``all N``; page numbers begin at 1."""
    seen = warnings.distinct()
    counts = seen.groupBy("doc", "tag").agg(F.count("*").alias("times"), F.count_distinct("page").alias("page_count"))
    spans = page_ranges(seen.where("page IS NOT NULL"), "doc", "tag")
    one = F.when(F.col("first") == F.col("last"), (F.col("first") + 1).cast("string")).otherwise(F.concat((F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string")))
    text = spans.groupBy("doc", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", one.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    out = counts.join(text, ["doc", "tag"], "left").join(total, "doc", "left")
    every = F.when((F.col("page_count") == F.col("n")) & (F.col("n") > 1), F.concat(F.lit("all "), F.col("n").cast("string"))).otherwise(F.coalesce("ranges", F.lit("")))
    return out.select("doc", "tag", "page_count", "times", every.alias("pages"))


# Warnings that must be acknowledged before a document is written.
ACKNOWLEDGED = (
    "hybridOCRUnavailable",
    "rotatedHybridOCRUnsupported",
    "lowOCRConfidence",
    "ocrRequired",
    "rotatedOCRUnsupported",
    "pageHasNoTranslatableText",
)


def needs_acknowledgement(warnings: DataFrame) -> DataFrame:
    """FIL9: documents with a warning that must be acknowledged."""
    return warnings.groupBy("doc").agg(F.bool_or(F.col("tag").isin(*ACKNOWLEDGED)).alias("blocked")).where("blocked").select("doc")


def progress(results: DataFrame, key: str = "request_id") -> DataFrame:
    """AGG16: counts of a comparison's states."""
    states = ("waiting", "running", "done", "failed", "unavailable")
    return results.groupBy(key).agg(*[F.count_if(F.col("state") == s).alias(s) for s in states], F.count("*").alias("total"))


def uniform_background(samples: DataFrame, *keys: str) -> DataFrame:
    """AGG20: mean of at least four opaque samples that are all within 0.045 of the first, else null."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "r", "g", "b", "a"))).alias("s")
    per = samples.groupBy(*keys).agg(ordered, *[F.avg(c).alias(f"mean_{c}") for c in "rgb"])
    near = F.forall("s", lambda x: (F.abs(x["r"] - F.col("s")[0]["r"]) <= 0.045) & (F.abs(x["g"] - F.col("s")[0]["g"]) <= 0.045) & (F.abs(x["b"] - F.col("s")[0]["b"]) <= 0.045) & (x["a"] >= 0.98))
    good = (F.size("s") >= 4) & near
    return per.select(*keys, *[F.when(good, F.col(f"mean_{c}")).alias(c) for c in "rgb"])


def numbered(rows: DataFrame, order: list, *keys: str, name: str = "reading_order") -> DataFrame:
    """WIN1: 0..n-1 in the given order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def occurrence_seeds(rows: DataFrame, seed: str, ordinal: str, *keys: str) -> DataFrame:
    """WIN2: the n-th duplicate of a seed gets ``|n`` behind it."""
    n = F.row_number().over(Window.partitionBy(*keys, seed).orderBy(ordinal)) - 1
    return rows.withColumn("stable_seed", F.when(n == 0, F.col(seed)).otherwise(F.concat(F.col(seed), F.lit("|"), n.cast("string"))))


def first_occurrences(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """WIN3: each key's first row; aggregation needs no sort and combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(*key, "v.*")


def line_advance(lines: DataFrame, *keys: str, order: str = "reading_order") -> DataFrame:
    """WIN4: upper median of the positive distances between neighbouring tops."""
    above = F.lag(F.col("y") + F.col("h")).over(Window.partitionBy(*keys).orderBy(order))
    step = lines.withColumn("step", above - (F.col("y") + F.col("h"))).where("step > 0")
    return step.groupBy(*keys).agg(upper_median(F.collect_list("step")).alias("advance"))


def space_before(lines: DataFrame, *keys: str, order: str = "reading_order") -> DataFrame:
    """WIN5: room between a line and the one above, never negative."""
    below = F.lag("y").over(Window.partitionBy(*keys).orderBy(order))
    return lines.withColumn("space_before", F.greatest(F.lit(0.0), F.coalesce(below - (F.col("y") + F.col("h")), F.lit(0.0))))


def image_assets(images: DataFrame, sharing: str = "document") -> DataFrame:
    """GRP7: asset key of each image: shared in the document, in its page, or single."""
    digest = F.substring(F.sha2(F.col("data").cast("binary"), 256), 1, 32)
    key = {"document": digest, "page": F.concat_ws("-", F.col("page").cast("string"), digest), "single": F.concat_ws("-", F.col("page").cast("string"), F.col("occurrence").cast("string"), digest)}[sharing]
    return images.withColumn("asset", key)
