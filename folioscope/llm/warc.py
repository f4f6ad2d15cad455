"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained on archived records, embedded in a leading skippable
frame (magic 0x184D2A5D), and every record is compressed on its own, so each can be read
from its offset. Equal payloads are stored once; the others become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged

DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of records that the dictionary is trained on, about, and of one record at most.
FIT_BYTES, FIT_RECORD = 4_000_000, 65_536
DICTIONARY_BYTES = 32_768
#: Repeated payloads that are broadcast; above, a bitmap of MAP_WORDS 64-bit words rules most
#: other pages out.
FEW, MAP_WORDS = 10_000, 1 << 20
#: A new archive is begun once one has this many bytes.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, not compressed. Its id derives from the page, so that reruns agree."""
    named = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    kind = "response" if refers_to is None else "revisit"
    clean = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", named(page_id)), ("WARC-Date", STAMP), ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", named(refers_to)), ("X-Refers-To-Page", str(refers_to))]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + http + payload + b"\r\n\r\n"


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; of too few records, their bytes as they are."""
    try:
        return zstandard.train_dictionary(size, records, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


class Writer:
    """Writes records to a stream; ``offset`` is where the next one begins."""

    def __init__(self, stream, dictionary: bytes, level: int = LEVEL):
        self.stream = stream
        held = zstandard.ZstdCompressor(level=9).compress(dictionary)
        self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
        self.offset = 8 + len(held)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True).compress

    def write(self, raw: bytes) -> int:
        at, packed = self.offset, self.pack(raw)
        self.stream.write(packed)
        self.offset += len(packed)
        return at


def read(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, payload) of every record of an archive, read in pieces."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(size))
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest, eof = b"", False
    while True:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    eof = True
                    break
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        if eof:
            return
        yield parse(b"".join(parts))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): the page that each repeated payload refers to.

    The largest id of each payload is found by its digest, combined before the shuffle. Few
    repeated payloads are broadcast. Of many, a bitmap of their hashes is (MAP_WORDS rows at
    most): pages that it rules out stay where they are, and only the others are shuffled.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(groups.where("n > 1 AND first IS NOT NULL").select(F.col("sha").alias("rsha"), "first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    plan = lambda of, known: of.join(known, F.col("sha") == F.col("rsha"), "left").select("page_id", "url", "html", refers.alias("refers_to"))
    if repeated.count() <= FEW:
        return plan(rows, F.broadcast(repeated))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * MAP_WORDS))
    bits = repeated.select(place("rsha").alias("at")).selectExpr("at div 64 AS word", "shiftleft(1L, cast(at % 64 as int)) AS bit")
    words = F.broadcast(staged(bits.groupBy("word").agg(F.bit_or("bit").alias("held"))))
    marked = rows.withColumn("at", place("sha")).join(words, F.expr("at div 64 = word"), "left")
    maybe = F.expr("coalesce(shiftrightunsigned(held, cast(at % 64 as int)) & 1L, 0L) = 1L")
    alone = marked.where(~maybe).select("page_id", "url", "html", F.lit(None).cast(groups.schema["first"].dataType).alias("refers_to"))
    return alone.unionByName(plan(marked.where(maybe).select("page_id", "url", "html", "sha"), repeated))


def samples(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> list[bytes]:
    """Distinct records for the dictionary, about FIT_BYTES in all, from all pages alike: by a
    hash of the payload under a bound that follows from the bytes there are. Of a record longer
    than FIT_RECORD, 16 evenly spaced pieces."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    size = F.least(F.octet_length(html), F.lit(FIT_RECORD))
    total = pages.agg(F.sum(size)).first()[0] or 0
    part = max(1, total // FIT_BYTES)
    piece = FIT_RECORD // 16
    spread = F.concat(*(F.substring(html, 1, piece) if k == 0 else F.substr(html, (F.length(html) * k / 16).cast("int"), F.lit(piece)) for k in range(16)))
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.when(F.length(html) > FIT_RECORD, spread).otherwise(html).alias("h"), F.xxhash64(html).alias("k"))
    # A payload counts once, however many pages repeat it; equal ones share the bound.
    held = rows.where(F.pmod("k", F.lit(part)) == 0).groupBy("k").agg(F.min(F.struct("i", "u", "h")).alias("r")).select("r.*")
    found = [record(r.i, r.u, p := r.h.encode("utf-8", "surrogatepass"), base32_sha1(p), None) for r in held.collect()]
    return sorted(found)


def write(self, raw: bytes) -> int:
        at, packed = self.offset, self.pack(raw)
        self.stream.write(packed)
        self.offset += len(packed)
        return at


def read(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, payload) of every record of an archive, read in pieces."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(size))
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest, eof = b"", False
    while True:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    eof = True
                    break
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        if eof:
            return
        yield parse(b"".join(parts))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): the page that each repeated payload refers to.

    The largest id of each payload is found by its digest, combined before the shuffle; only
    payloads of several pages are joined back, and only their digests travel.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(groups.where("n > 1 AND first IS NOT NULL").select(F.col("sha").alias("rsha"), "first"))
    few = repeated.count() <= 10_000
    joined = rows.join(F.broadcast(repeated) if few else repeated, F.col("sha") == F.col("rsha"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write(
    pages: DataFrame, folder: str | None = None, id_col="page_id", url_col="url", html_col="html", least_bytes: int = 0
) -> DataFrame:
    """Writes archives of all pages and returns their list: (path, records, bytes, raw_bytes).

    ``folder``: a URI that every executor can write to (a file system of pyarrow: file, hdfs,
    s3, gs); by default a new one under spark.checkpoint.dir. Files of failed or repeated
    attempts may remain there; the list, committed by Spark, names one attempt of each.

    Rows with equal payloads of ``least_bytes`` bytes or more refer to the row with the largest
    id; rows that share that id are all responses. Null html is an empty payload, a null url
    becomes urn:page:<id>; a null id counts as smaller than any. No pages: an empty list.
    """
    spark = pages.sparkSession
    folder = (folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    fit_on = samples(pages, id_col, url_col, html_col)
    dictionary = spark.sparkContext.broadcast(train_dictionary(fit_on) if fit_on else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        done, out, stream, writer, raw, n = [], None, None, None, 0, 0

        def close() -> None:
            stream.close()
            done.append((out, n, writer.offset, raw))

        for batch in batches:
            for i, u, h, r in zip(*(batch.column(c) for c in range(4)), strict=True):
                if writer is None or writer.offset >= ARCHIVE_BYTES:
                    if writer is not None:
                        close()
                    out, raw, n = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    stream = fs.open_output_stream(out, compression=None)
                    writer = Writer(stream, dictionary.value)
                payload = h.as_buffer().to_pybytes() if h.as_buffer() is not None else b""
                whole = record(i.as_py(), u.as_py(), payload, base32_sha1(payload), r.as_py())
                writer.write(whole)
                raw, n = raw + len(whole), n + 1
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes", "raw_bytes"])

    todo = planned(pages, id_col, url_col, html_col, least_bytes)
    held = staged(todo.mapInArrow(run, "path string, records long, bytes long, raw_bytes long"))
    # The file system's own name of the folder, without which a path can't be opened again.
    head = folder.split("://", 1)[0] if "://" in folder else "file"
    return held.withColumn("folder", F.lit(folder if "://" in folder else f"{head}://{folder}"))


def read_back(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the
    archives listed; a response's digest and length are worked out from its stored payload and
    must agree with its fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, payload in read(stream):
                        kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
                            raise ValueError(f"{path}: a record of page {fields['X-Page-Id']} is damaged")
                        whole = lambda k, f=fields: int(f[k]) if f.get(k) else None
                        rows.append((whole("X-Page-Id"), size, digest, kind, whole("X-Refers-To-Page")))
                        if len(rows) == 10_000:
                            yield _table(rows, names)
                            rows = []
                if rows:
                    yield _table(rows, names)

    listed = archives.select("path", "folder")
    spread = listed.repartition(max(1, listed.count()), "path")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


#: DuckDB SQL for what the archives hold; base32 goes by groups of five bits.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), b AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, x, max(page_id) OVER (PARTITION BY x) AS m,
    array_to_string(list_transform(range(1, 41), lambda k:
      substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(x, k, 1)) - 1) * 4 + 1, 4)), '') AS bits
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6),
    lambda j: CASE WHEN substr(bits, k * 5 + j, 1) = '1' THEN (1 << (5 - j)) ELSE 0 END))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM b
"""
