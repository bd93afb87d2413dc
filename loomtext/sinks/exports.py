"""CSV, names, packages and reports (SNK1, SNK5-SNK8, SRT5-7)."""

from __future__ import annotations

import io
import zipfile
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions.arrow import arrow_function
from loomtext.functions.timing import iso8601

CSV_HEAD = ("conversation_title", "timestamp", "speaker", "original_text", "translated_text")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_text(messages: DataFrame, key: str, order: str, columns: list[Column], head: tuple[str, ...] = CSV_HEAD) -> DataFrame:
    """SNK1: key, csv: a conversation as CSV text: a mark first, every field quoted, CRLF behind every row."""
    row = F.concat_ws(",", *[_quoted(c) for c in columns])
    first = ",".join(f'"{h}"' for h in head)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return messages.groupBy(key).agg(F.concat(F.lit("﻿" + first + "\r\n"), F.array_join(rows, "\r\n"), F.lit("\r\n")).alias("csv"))


def conversation_csv(messages: DataFrame) -> DataFrame:
    """SNK1 for (conv_id, title, seq, at, speaker, original, translated)."""
    return csv_text(messages, "conv_id", "seq", [F.col("title"), iso8601(F.col("at")), *[F.col(c) for c in ("speaker", "original", "translated")]])


def output_names(wanted: DataFrame, taken: DataFrame, numbered: int | None = 9_999) -> DataFrame:
    """SNK5: url, output: ``base.lang.translated.ext``, never a taken name; collisions get `` (2)`` and on, beyond ``numbered`` a UUID of the name (None: numbers without end).

    ``wanted``: folder, base, lang, ext, url; ``taken``: folder, name.
    """
    name = F.concat_ws(".", "base", "lang", F.lit("translated"), F.nullif("ext", F.lit("")))
    rows = wanted.withColumn("stem", F.concat_ws(".", "base", "lang", F.lit("translated"))).withColumn("name", name)
    # a taken name belongs to the stem before its number and extension, so a folder's names and stems meet by equal keys
    number = F.regexp_extract("name", r" \((\d+)\)(?:\.[^.]*)?$", 1)
    used = taken.withColumn("stem", F.regexp_replace("name", r"( \(\d+\))?(\.[^.]*)?$", "")).unionByName(taken.withColumn("stem", F.regexp_replace("name", r" \(\d+\)$", "")))
    used = used.groupBy("folder", "stem").agg(F.max(F.when(number == "", 1).otherwise(number.try_cast("decimal(38,0)"))).alias("highest"))
    place = F.row_number().over(Window.partitionBy("folder", "name").orderBy(F.asc_nulls_last("url")))
    rows = rows.withColumn("place", place).join(used, ["folder", "stem"], "left").withColumn("n", F.coalesce("highest", F.lit(0)) + F.col("place"))
    tail = F.when(F.coalesce("ext", F.lit("")) == "", "").otherwise(F.concat(F.lit("."), F.col("ext")))
    plain = F.lit(True) if numbered is None else F.col("n") <= numbered
    mark = F.when(F.col("n") <= 1, "").when(plain, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" "), F.substring(F.sha2("url", 256), 1, 32)))
    return rows.select("url", "folder", F.concat("stem", mark, tail).alias("output"))


def commit_new(rows: DataFrame, path: str, generation: int, current: int) -> bool:
    """SNK6: written by Spark's committer under a new name, only while the work is current; never over another."""
    if generation != current:
        return False
    rows.write.mode("errorifexists").parquet(path)
    return True


MOST_PARTS, MOST_BYTES = 65_535, (1 << 32) - 1


def package_bytes(parts: list[tuple[str, bytes]]) -> bytes:
    """SNK7: parts sorted by name, stored without compression; the names are unique."""
    names = [n for n, _ in parts]
    if len(set(names)) < len(names):
        raise ValueError("duplicate part name")
    if len(parts) > MOST_PARTS or sum(len(d) for _, d in parts) > MOST_BYTES:
        raise ValueError("package too large")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=False) as z:
        for name, data in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def packages(parts: DataFrame) -> DataFrame:
    """SNK7: package, content: one archive per package of (package, name, data); a package is one group."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        body = package_bytes(list(zip(rows.column("name").to_pylist(), rows.column("data").to_pylist())))
        return pa.table({"package": pa.array([key[0].as_py()], pa.string()), "content": pa.array([body], pa.binary())})

    return parts.select("package", "name", "data").groupBy("package").applyInArrow(run, "package string, content binary")


@arrow_function(pa.bool_())
def is_well_formed(data: pa.Array) -> pa.Array:
    """Whether the bytes are one well-formed XML document; null for null."""

    def good(x: bytes) -> bool:
        try:
            expat.ParserCreate().Parse(x, True)
        except expat.ExpatError:
            return False
        return True

    return pa.array([None if x is None else good(x) for x in data.to_pylist()], pa.bool_())


def part_problems(parts: DataFrame, required: list[str]) -> DataFrame:
    """DQ3: package, problem: required parts that lack, and XML parts that don't parse."""
    need = parts.select("package").distinct().withColumn("name", F.explode(F.array(*[F.lit(r) for r in required])))
    lack = need.join(parts.select("package", "name"), ["package", "name"], "left_anti").select("package", F.concat(F.lit("missing: "), F.col("name")).alias("problem"))
    xml = parts.where(F.col("name").rlike(r"\.(xml|rels)$"))
    broken = xml.where(~F.coalesce(is_well_formed("data"), F.lit(False))).select("package", F.concat(F.lit("malformed: "), F.col("name")).alias("problem"))
    return lack.unionByName(broken)


def report_rows(reports: DataFrame) -> DataFrame:
    """SNK8: name and JSON of each report; the name is of the digest's first 16 bytes and the time."""
    digest = F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 32)
    name = F.concat(digest, F.lit("-"), F.date_format("created_at", "yyyyMMdd'T'HHmmss'Z'"), F.lit(".json"))
    rest = [c for c in reports.columns if c != "content"]
    return reports.select(name.alias("name"), F.to_json(F.struct(*rest)).alias("json"))


def newest_first(rows: DataFrame, at: str = "created_at", most: int | None = None) -> DataFrame:
    """SRT5, SRT6."""
    ordered = rows.orderBy(F.desc(at), "id")
    return ordered if most is None else ordered.limit(most)


def sorted_parts(parts: DataFrame) -> DataFrame:
    """SRT7."""
    return parts.orderBy("package", "name")
