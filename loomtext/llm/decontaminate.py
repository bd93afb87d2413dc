"""Benchmark decontamination: size-partitioned MinHash containment search, in SQL functions only.

Items are partitioned by their number of shingles, in powers of two.  The
MinHash sketch of an item is its ``k`` shingles of least hash; ``k`` and the
number of hits asked for are fixed for each partition from its largest size.
Every shingle of every document probes the sketches, so the search does not
depend on how long the document is.  Documents have no sketch of their own: a
short item in a long document has a Jaccard similarity near 0, which equal
MinHash values of both would not show.  An item with a share ``t`` of its shingles
in a document lacks at most (1 - t) of them: a sketch of more than that cannot
be missed, and where a partition's size would make it longer than
``MOST_HASHES`` the chance to miss is below 1e-12.  Candidates are verified by
exact containment of the shingles as strings.

A shingle is five words in lower case; words are runs of letters and digits.
Items of one to four words have one shingle of that length, and documents are
shingled at that length as well.

Defined results.  Null and blank items and documents match nothing.  Rows that
share a document id are one document, matched where any of its rows matches;
item rows that share an id are items of their own, reported with the greatest
containment.  Rows with a null id are not reported.  Extra columns are ignored.
"""

from __future__ import annotations

from math import comb, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import Workspace

SHINGLE = 5
CONTAINMENT = 0.8
MOST_HASHES = 64
ROW_BYTES = 32  #: a row of a sketch: three numbers of 8 bytes, one of 4 and the row's head
BROADCAST_BYTES = 64 << 20  #: sketches up to this size go to the documents; for larger ones both sides are shuffled by hash
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), lambda w: w != "")


def _starts(w: Column, length: int) -> Column:
    """Places where a shingle of ``length`` words starts; none in shorter texts."""
    return F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, length: int) -> Column:
    return F.transform(_starts(w, length), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(length)]))


def shingle_strings(w: Column, length: int) -> Column:
    return F.array_distinct(F.transform(_starts(w, length), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(length)])))


def sketch_plan(largest: int, containment: float) -> tuple[int, int]:
    """(hashes, hits asked for) of a partition whose largest item has ``largest`` shingles."""
    hits = 1 if largest < 32 else 2
    lacking = floor((1 - containment) * largest + 1e-9)
    sure = lacking + hits
    if sure <= MOST_HASHES:
        return sure, hits
    k = MOST_HASHES
    miss = sum(comb(largest - lacking, i) * comb(lacking, k - i) for i in range(hits)) / comb(largest, k)
    return (k, hits) if miss < 1e-12 else (sure, hits)


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair at or above the share."""
    spark = docs.sparkSession
    space = Workspace(spark, "decontaminate")
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.where("item_id IS NOT NULL AND size(w) > 0").withColumn("length", F.least(F.size("w"), F.lit(SHINGLE)))
    by_length = None
    for n in range(1, SHINGLE + 1):
        x = F.when(F.col("length") == n, shingle_strings(F.col("w"), n))
        by_length = x if by_length is None else F.coalesce(by_length, x)
    items = space.save(items.select("row", "item_id", "length", by_length.alias("shingles")).withColumn("n_item", F.size("shingles")), "items")
    sizes = items.groupBy(F.floor(F.log2("n_item")).cast("int").alias("part"), "length").agg(F.max("n_item").alias("largest")).collect()  # a row for each power of two and length

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    docs = texts.select("doc_id", words(F.col("text")).alias("w"))
    result = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    if not sizes:
        return spark.createDataFrame([], result)
    lengths = sorted({r.length for r in sizes})
    plans = {r.part: sketch_plan(max(s.largest for s in sizes if s.part == r.part), containment) for r in sizes}
    hashes = F.create_map(*[F.lit(x) for p, (k, _) in plans.items() for x in (p, k)])
    asked = F.create_map(*[F.lit(x) for p, (_, h) in plans.items() for x in (p, h)])

    parts = F.floor(F.log2("n_item")).cast("int")
    sketch = items.select("row", "item_id", "length", parts.alias("part"), F.explode("shingles").alias("shingle"))
    sketch = sketch.withColumn("h", F.when(F.col("length") == 1, F.xxhash64("shingle")).otherwise(F.lit(None)))
    for n in range(2, SHINGLE + 1):
        parts_n = F.split("shingle", " ")
        sketch = sketch.withColumn("h", F.when(F.col("length") == n, F.xxhash64(*[F.get(parts_n, F.lit(j)) for j in range(n)])).otherwise(F.col("h")))
    sketch = sketch.withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("h"))).where(F.col("nth") <= hashes[F.col("part")])
    sketch = space.save(sketch.select("h", "length", "row", "item_id", asked[F.col("part")].alias("asked")), "sketch")
    small = sketch.count() * ROW_BYTES <= BROADCAST_BYTES

    probes = None
    for n in lengths:
        one = docs.select("doc_id", F.explode(shingle_hashes(F.col("w"), n)).alias("h"))
        mine = sketch.where(F.col("length") == n).drop("length")
        met = one.join(F.broadcast(mine) if small else mine, "h")
        probes = met if probes is None else probes.unionByName(met)
    found = probes.distinct().groupBy("doc_id", "row", "asked").agg(F.count("*").alias("hits")).where("hits >= asked")
    found = space.save(found.select("doc_id", "row"), "found")

    # words are cut again for the candidates only, behind the join
    checked = found.join(texts, "doc_id").withColumn("w", words(F.col("text"))).drop("text").join(items, "row")
    mine = None
    for n in lengths:
        x = F.when(F.col("length") == n, shingle_strings(F.col("w"), n))
        mine = x if mine is None else F.coalesce(mine, x)
    checked = checked.withColumn("shared", F.size(F.array_intersect("shingles", mine)))
    checked = checked.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("shared").cast("long").alias("n_shared"), (F.col("shared") / F.col("n_item")).alias("containment"))
    checked = checked.where(F.col("containment") >= containment)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ish AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS l, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)
), dsh AS (
  SELECT DISTINCT doc_id, l, array_to_string(w[p:p + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM ish) WHERE len(w) >= l)
), n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n_item) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared, count(*) / CAST(any_value(n_item) AS DOUBLE) AS containment
FROM dsh JOIN ish USING (l, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""
