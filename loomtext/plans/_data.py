"""Driver tables, and page layouts derived from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_events(conversations: DataFrame) -> DataFrame:
    """Live events of the conversations: a user's turn is the original, an assistant's the translation that completes it."""
    said = conversations.where(F.col("role").isin("user", "assistant"))
    tag = F.when(F.col("role") == "user", "inputTranscript").otherwise("outputTranscript")
    tags = F.when(F.col("role") == "user", F.array(tag)).otherwise(F.array(tag, F.lit("turnComplete")))
    return said.select("conv_id", F.lit("other").alias("speaker"), F.col("turn").alias("seq"), F.posexplode(tags).alias("ordinal", "tag"), "text").withColumn("text", F.when(F.col("tag") != "turnComplete", F.col("text")))


def page_lines(docs: DataFrame) -> DataFrame:
    """Positioned lines: a document is a page of its source; long lines span, short ones sit in two columns."""
    parts = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.size(parts).alias("n"), F.posexplode(parts).alias("i", "text"))
    wide = F.length("text") > 120
    left = (F.col("i") % 2 == 0) | wide
    return rows.select(
        "doc", "page", "n", "i", F.format_string("%d-%d", "page", "i").alias("id"), "text",
        F.when(left, 50.0).otherwise(330.0).alias("x"), (760.0 - 18.0 * F.floor(F.col("i") / 2) - F.when(wide, 9.0).otherwise(0.0)).alias("y"),
        F.when(wide, 500.0).otherwise(F.least(F.lit(240.0), 6.0 * F.length("text"))).alias("w"), F.lit(12.0).alias("h"),
        F.when(F.col("i") == 0, 14.0).otherwise(11.0).alias("size"), F.lit("black").alias("color"), F.lit("native").alias("source"),
    )


PAGE_LINES_SQL = r"""
lines AS (
  SELECT source AS doc, doc_id AS page, len(p) AS n, i, p[i + 1] AS text
  FROM (SELECT source, doc_id, p, unnest(range(0, len(p))) AS i FROM (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents))
), placed AS (
  SELECT doc, page, n, i, page || '-' || i AS id, text, CASE WHEN i % 2 = 0 OR length(text) > 120 THEN 50.0 ELSE 330.0 END AS x,
         760.0 - 18.0 * (i // 2) - CASE WHEN length(text) > 120 THEN 9.0 ELSE 0.0 END AS y,
         CASE WHEN length(text) > 120 THEN 500.0 ELSE least(240.0, 6.0 * length(text)) END AS w, 12.0 AS h,
         CASE WHEN i = 0 THEN 14.0 ELSE 11.0 END AS size
  FROM lines
)
"""


def sha(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)
