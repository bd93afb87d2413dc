"""JSON stores, cursor-paged catalogs, framed lines and live frames (SRC5-9, FIL17, SNK3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomtext.functions.strings import first_message, is_blank, trim_all


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC5: a JSON array file as a table; a missing file is an empty table, missing fields are null."""
    system, p = _path(spark, path)
    if not system.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")


def write_store(rows: DataFrame, path: str, *order: str) -> None:
    """SNK3: the full snapshot as one pretty JSON array with sorted keys, put in place by one rename over the old one.

    A store is a user's document of bounded size; it is written by one task and
    one driver call.
    """
    import json

    spark = rows.sparkSession
    ordered = rows.orderBy(*order) if order else rows
    body = json.dumps([json.loads(x) for x in ordered.select(F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("j")).toPandas()["j"]], indent=2, sort_keys=True, ensure_ascii=False)
    system, target = _path(spark, path)
    _, part = _path(spark, path + ".part")
    out = system.create(part, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    target, part = system.makeQualified(target), system.makeQualified(part)
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(part, target, over)


class CatalogSource(DataSource):
    """SRC6: rows of a cursor-paged service, at most ``MOST_PAGES`` pages of ``PAGE`` rows.

    Subclasses give ``fetch(cursor, limit) -> (rows, next cursor)``; pages depend
    on each other, so one reader asks for them in turn.
    """

    PAGE, MOST_PAGES = 100, 100
    fetch: Callable

    @classmethod
    def name(cls) -> str:
        return "loomtext_catalog"

    def schema(self) -> str:
        return "id string, model string, displayName string, description string, isDefault boolean, hidden boolean, inputModalities array<string>, place long"

    def reader(self, schema) -> DataSourceReader:
        return _CatalogReader(type(self).fetch, self.PAGE, self.MOST_PAGES)


class _CatalogReader(DataSourceReader):
    def __init__(self, fetch, page: int, most: int):
        self.fetch, self.page, self.most = fetch, page, most

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        cursor, place = None, 0
        for _ in range(self.most):
            rows, cursor = self.fetch(cursor, self.page)
            for r in rows:
                yield (*(r.get(k) for k in ("id", "model", "displayName", "description")), bool(r.get("isDefault")), bool(r.get("hidden")), r.get("inputModalities"), place)
                place += 1
            if cursor is None:
                return


def visible_models(catalog: DataFrame) -> DataFrame:
    """FIL17: well-formed visible rows, the first of each model, then those that take text."""
    good = ~F.coalesce("hidden", F.lit(False)) & ~is_blank(F.col("id")) & ~is_blank(F.col("model")) & ~is_blank(F.col("displayName"))
    first = catalog.where(good).withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy("place"))).where("n = 1")
    return first.where(F.array_contains(F.coalesce("inputModalities", F.array(F.lit("text"))), "text")).drop("n")


MOST_LINE_BYTES = 16 << 20


class LineFramer:
    """SRC7: lines of a byte stream; a partial line is carried over, an overlong one is an error and is dropped."""

    def __init__(self, most: int = MOST_LINE_BYTES):
        self.most, self.carry = most, b""

    def push(self, chunk: bytes) -> list[bytes]:
        parts = (self.carry + chunk).split(b"\n")
        self.carry = parts.pop()
        if len(self.carry) > self.most or any(len(p) > self.most for p in parts):
            self.carry = b""
            raise ValueError("line too long")
        return [p[:-1] if p.endswith(b"\r") else p for p in parts]


def framed_lines(chunks: DataFrame, key: str = "stream", order: str = "seq", most: int = MOST_LINE_BYTES) -> DataFrame:
    """SRC7 in batch: whole lines of ordered byte chunks per stream; what follows the last line feed is not a line.

    A line's number is the count of line feeds before it, so lines, not streams, are put
    together in a group; a line of more than ``most`` bytes is an error.
    """
    pieces = F.split(F.decode("bytes", "ISO-8859-1"), "\n")  # a character for each byte
    counts = chunks.select(key, order, (F.size(pieces) - 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.join(counts.select(key, order, before.alias("first")), [key, order]).select(key, order, "first", F.posexplode(pieces).alias("nth", "piece"))
    rows = rows.groupBy(key, (F.col("first") + F.col("nth")).cast("int").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), "").alias("raw"))
    whole = rows.join(counts.groupBy(key).agg(F.sum("n").alias("total")), key).where("line_no < total")
    raw = F.when(F.length("raw") > most, F.raise_error(F.lit("line too long")).cast("string")).otherwise(F.regexp_replace("raw", r"\r$", ""))
    return whole.select(key, "line_no", F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8").alias("line"))


FRAME = (
    "setupComplete string, error struct<message:string,status:string,code:int>, "
    "serverContent struct<inputTranscription:struct<text:string,languageCode:string>,outputTranscription:struct<text:string,languageCode:string>,"
    "modelTurn:struct<parts:array<struct<text:string,inlineData:struct<data:string>>>>,interrupted:boolean,turnComplete:boolean>"
)
_EVENT = "struct<tag:string,text:string,language_code:string,data:binary>"


def _event(tag: str, text: Column | None = None, code: Column | None = None, data: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(tag).alias("tag"), (null if text is None else text).cast("string").alias("text"), (null if code is None else code).cast("string").alias("language_code"), (null if data is None else data).cast("binary").alias("data"))


def frame_events(frame: Column) -> Column:
    """SRC8: the events of one frame, in the order in which they are to be handled."""
    f = F.from_json(frame, FRAME)
    c = f["serverContent"]

    def said(tag: str, part: Column) -> Column:
        text = trim_all(part["text"])
        return F.when(F.coalesce(text, F.lit("")) != "", _event(tag, text, part["languageCode"]))

    audio = F.transform(F.coalesce(c["modelTurn"]["parts"], F.array().cast("array<struct<text:string,inlineData:struct<data:string>>>")), lambda p: F.when(F.try_to_binary(p["inlineData"]["data"], F.lit("base64")).isNotNull(), _event("audio", data=F.try_to_binary(p["inlineData"]["data"], F.lit("base64")))))
    before = F.array(
        F.when(f["setupComplete"].isNotNull(), _event("setupComplete")),
        F.when(f["error"].isNotNull(), _event("error", first_message(f["error"]["message"], f["error"]["status"], f["error"]["code"]))),
        said("inputTranscript", c["inputTranscription"]),
        said("outputTranscript", c["outputTranscription"]),
    )
    after = F.array(F.when(c["interrupted"], _event("interrupted")), F.when(c["turnComplete"], _event("turnComplete")))
    return F.filter(F.concat(before.cast(f"array<{_EVENT}>"), audio.cast(f"array<{_EVENT}>"), after.cast(f"array<{_EVENT}>")), lambda x: x.isNotNull())


def live_events(frames: DataFrame, *keys: str) -> DataFrame:
    """SRC8: a row per event of frames (…, seq, frame)."""
    return frames.select(*keys, "seq", F.posexplode(frame_events(F.col("frame"))).alias("ordinal", "e")).select(*keys, "seq", "ordinal", "e.*")
