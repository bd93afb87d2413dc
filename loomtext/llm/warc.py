"""WARC writer with a Zstandard dictionary in a leading skippable frame.

Each archive begins with a skippable frame (magic 0x184D2A5D) that holds a
dictionary trained on the archive's records, of each the first ``TRAIN_EACH``
bytes; the dictionary itself is Zstandard-compressed.  A ``warcinfo`` record and
then every record follow as frames of their own, compressed with that
dictionary, so a reader can seek to any record.  Where an archive has too few or
too uniform records to train on, the records' own beginnings are the
dictionary's content.  Of records with equal payloads the one with the smallest
page id is a response; the others are revisits that name it and carry the HTTP
head alone.

What a record refers to is looked up by a table of page id and digest, so the
html is dealt by both: copies of one payload don't meet in one task.

Defined results.  A null payload is empty.  Rows that share a page id and have
equal payloads: one stays the response, the rest are revisits of it, ordered by
url, and have record ids of their own.  Null page ids come last among equals.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._arrow import rows
from ._shared import Workspace, file_system, write_atomically

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
TRAIN_RECORDS = 2_000  #: records of an archive that its dictionary is trained on
TRAIN_EACH = 128 << 10
TRAIN_BYTES = 8 << 20
ARCHIVE_BYTES = 64 << 20  #: payload after which the next archive begins
DATE = "2024-01-01T00:00:00Z"  #: capture time is not in the table
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, twin: int = 1) -> str:
    """``twin`` numbers rows of equal page id and payload."""
    return f"<urn:loomtext:page:{'' if page_id is None else page_id}:{payload_digest}{'' if twin == 1 else f':{twin}'}>"


def information(captured: str = DATE) -> bytes:
    """The record that begins an archive."""
    block = b"software: loomtext\r\nformat: WARC File Format 1.1\r\n"
    name = digest(block + captured.encode())
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:loomtext:info:{name}>", f"WARC-Date: {captured}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool, captured: str = DATE, twin: int = 1) -> bytes:
    """One WARC/1.1 record."""
    clean = "".join(c for c in (url or "") if c >= " ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, payload_digest, twin)}",
        f"WARC-Date: {captured}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, payload_digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def archive_chunks(records: list[bytes]):
    """The bytes of an archive: dictionary frame, then a frame for each record."""
    import zstandard as zstd

    train, size = [], 0
    for r in records[:TRAIN_RECORDS]:
        r = r[:TRAIN_EACH]
        if size + len(r) <= TRAIN_BYTES:
            train.append(r)
            size += len(r)
    trained = None
    if len(train) >= 16:
        try:
            trained = zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), train)
        except zstd.ZstdError:  # too little or too uniform to train on: the records' own bytes serve as content
            trained = None
    if trained is None:
        trained = zstd.ZstdCompressionDict(b"".join(train)[: DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)
    body = zstd.ZstdCompressor(level=9).compress(trained.as_bytes())
    yield struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    press = zstd.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
    yield press.compress(information())
    for r in records:
        yield press.compress(r)


def read_archive(uri: str):
    """The records of an archive, one frame at a time."""
    import zstandard as zstd

    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"no dictionary frame: {uri}")
        plain = zstd.ZstdDecompressor().decompress(source.read(size))
        expand = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(plain))
        frame, parts, data = None, [], source.read(1 << 20)
        while data:
            frame = frame or expand.decompressobj()
            parts.append(frame.decompress(data))
            data = b""
            if frame.eof:
                yield b"".join(parts)
                data, frame, parts = frame.unused_data, None, []
            data = data or source.read(1 << 20)
        if frame:
            raise ValueError(f"cut off: {uri}")


def _writer(folder: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = made = 0

        def flush():
            nonlocal held, size, made
            uri = f"{folder}/pages-{part:06d}-{made:04d}.warc.zst"
            written = write_atomically(uri, archive_chunks(held))
            row = pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([written], pa.int64())})
            held, size, made = [], 0, made + 1
            return row

        for batch in batches:
            for page, url, html, key, first, nth, twin in rows(batch, "page_id", "url", "html", "sha1", "first_page", "nth", "twin"):
                payload = (html or "").encode("utf-8", "surrogatepass")
                name = base64.b32encode(bytes.fromhex(key)).decode()
                held.append(record(page, url, payload, name, first, bool(nth), twin=twin))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write archives and their manifest; payloads below ``least_bytes`` are never revisits."""
    spark = pages.sparkSession
    space = Workspace(spark, "warc-keys")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    keys = space.save(pages.select("page_id", "sha1", (F.octet_length("html") >= least_bytes).alias("long"), F.coalesce("url", F.lit("")).alias("url")), "keys")
    # written before it is joined back: both sides are then plain shuffles of narrow rows, which Spark splits where a payload is common
    first = space.save(keys.where("long").groupBy("sha1").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "first")
    place = space.save(keys.join(first, "sha1").select(F.col("page_id").alias("key_id"), F.col("sha1").alias("key_sha1"), "first_page").distinct(), "place")
    # equal ids and payloads are rare: only they need an order among themselves
    again = space.save(keys.groupBy("page_id", "sha1").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "n"), "again")
    marked = pages.join(place, F.col("page_id").eqNullSafe(F.col("key_id")) & (F.col("sha1") == F.col("key_sha1")), "left").drop("key_id", "key_sha1")
    twin = F.lit(1)
    if again.limit(1).count():
        marked = marked.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left").drop("again_id", "again_sha1")
        several = marked.where("n IS NOT NULL").withColumn("twin", F.row_number().over(Window.partitionBy("page_id", "sha1").orderBy("url")))
        marked = marked.where("n IS NULL").withColumn("twin", twin).unionByName(several)
    else:
        marked = marked.withColumn("twin", twin)
    other = F.col("first_page").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first_page")) | (F.col("twin") > 1))
    marked = marked.withColumn("nth", F.coalesce(other, F.lit(False)))
    marked.select("page_id", "url", "html", "sha1", "first_page", "nth", "twin").mapInArrow(_writer(folder), "uri string, records long, bytes long").write.mode("overwrite").parquet(f"{folder}/manifest")
    space.drop("keys", "first", "place", "again")
    return spark.read.parquet(f"{folder}/manifest")


def _page(name: str) -> int | None:
    text = name.split(":")[3]
    return int(text) if text else None


def _reader(batches):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for (uri,) in rows(batch, "uri"):
            out = []
            for data in read_archive(uri):
                fields, http, payload = parse(data)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (size != len(payload) or digest(payload) != name):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {uri}")
                out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, name, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record."""
    files = spark.read.parquet(f"{folder}/manifest").select("uri")
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(_reader, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), space.path("archives"))
    return read_warc(spark, space.path("archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1],
         lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) // d) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM f
"""
