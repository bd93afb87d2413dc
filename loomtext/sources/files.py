"""Files: kind, detection, decoding (SRC1-4, SRC10) and encoding back (SNK4)."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtext.functions.arrow import arrow_function
from loomtext.functions.strings import trim_all
from loomtext.operators.text import markdown_score

# Extensions by kind.
EXTENSIONS = {
    "pdf": ["pdf"],
    "markdown": ["md", "markdown", "mdown", "mkdn", "mkd", "mdwn"],
    "text": ["txt", "text", "log", "textile", "csv", "tsv"],
}

# Byte order marks, longest first where one begins another.
MARKS = (
    ("utf-8", b"\xef\xbb\xbf"),
    ("utf-32-le", b"\xff\xfe\x00\x00"),
    ("utf-32-be", b"\x00\x00\xfe\xff"),
    ("utf-16-le", b"\xff\xfe"),
    ("utf-16-be", b"\xfe\xff"),
)


def extension(url: Column) -> Column:
    return F.regexp_extract(url, r"\.([^./\\]+)$", 1)


def kind_of_extension(ext: Column) -> Column:
    """SRC1: null where the extension is not known."""
    e = F.lower(trim_all(ext))
    out = F.when(F.lit(False), "")
    for kind, names in EXTENSIONS.items():
        out = out.when(e.isin(names), kind)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """raw_files: url, byte_count, content."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("url"), F.col("length").alias("byte_count"), "content")


def decode(data: bytes) -> tuple[str | None, str | None, bool]:
    """SRC3: (text, encoding, had a mark); (None, None, False) where no encoding fits."""
    for name, mark in MARKS:
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name), name, True
            except UnicodeDecodeError:
                break
    try:
        return data.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    odd = sum(1 for b in data if b < 9 and b != 7)
    return (data.decode("latin-1"), "latin-1", False) if odd * 100 < len(data) else (None, None, False)


def encode(text: str, encoding: str, mark: bool) -> bytes | None:
    """SNK4: bytes in the file's own encoding and mark; None where a character has no code."""
    try:
        return (dict(MARKS).get(encoding, b"") if mark else b"") + codecs.encode(text, encoding)
    except UnicodeEncodeError:
        return None


_DECODED = pa.struct([("text", pa.string()), ("encoding", pa.string()), ("mark", pa.bool_())])


@arrow_function(_DECODED)
def decoded(content: pa.Array) -> pa.Array:
    found = [decode(x or b"") for x in content.to_pylist()]
    return pa.array([dict(zip(("text", "encoding", "mark"), x)) for x in found], _DECODED)


@arrow_function(pa.binary())
def encoded(text: pa.Array, encoding: pa.Array, mark: pa.Array) -> pa.Array:
    return pa.array([encode(t or "", e or "utf-8", bool(m)) for t, e, m in zip(text.to_pylist(), encoding.to_pylist(), mark.to_pylist())], pa.binary())


def detect(files: DataFrame) -> DataFrame:
    """SRC2: url, kind, encoding, byte_count, is_empty, markdown_score, confidence, text.

    The PDF magic wins, then the extension; else the decoded text is scored. A
    file that no encoding fits has no kind.
    """
    by_name = kind_of_extension(extension(F.col("url")))
    magic = F.substring(F.col("content"), 1, 5) == F.lit("%PDF-").cast("binary")
    sure = F.when(magic, "pdf").otherwise(by_name)
    out = files.withColumn("sure", sure).withColumn("d", F.when(F.coalesce("sure", F.lit("")) != "pdf", decoded("content")))
    out = out.withColumn("score", F.when(F.col("sure").isNull() & F.col("d.text").isNotNull(), markdown_score(F.col("d.text"))).otherwise(0))
    kind = F.coalesce("sure", F.when(F.col("d.text").isNull(), None).when(F.col("score") >= 3, "markdown").otherwise("text"))
    confidence = F.when(F.col("sure").isin("pdf", "markdown"), 100).when(F.col("sure") == "text", 98).when(F.col("d.text").isNull(), 0).when(F.col("score") >= 3, 82).otherwise(72)
    return out.select("url", kind.alias("kind"), F.col("d.encoding").alias("encoding"), "byte_count", (F.col("byte_count") == 0).alias("is_empty"), F.col("score").alias("markdown_score"), confidence.alias("confidence"), F.col("d.text").alias("text"), F.col("d.mark").alias("mark"))


def pdf_problems(meta: DataFrame) -> DataFrame:
    """SRC10: url, problem: the first guard that a PDF's metadata does not pass."""
    problem = (
        F.when(F.coalesce(kind_of_extension(extension(F.col("url"))), F.lit("")) != "pdf", "not a pdf")
        .when(~F.col("has_header"), "bad header")
        .when(F.col("locked"), "locked")
        .when(~F.col("may_change"), "changes not permitted")
        .when(F.col("is_signed"), "signed")
        .when(F.col("has_form"), "form")
        .when(F.col("page_count") == 0, "empty")
    )
    return meta.select("url", problem.alias("problem")).where("problem IS NOT NULL")
