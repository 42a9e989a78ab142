"""Content-addressed WARC archive: payload bytes once, record headers apart.

An archive is a folder of two tables. ``payloads`` holds each different payload once, under
its SHA-256; ``headers`` a row for each record with the exact bytes of its WARC header and
of its HTTP header, and the key of its payload. A record is put together again, byte for
byte, by a join. A key is verified twice: when payloads are stored, all that share a key
must agree in length and SHA-1 as well; when they are read, the bytes must hash to it.

``records`` makes records of pages: of equal payloads of REVISIT bytes or more, the record
of the largest id is the response, and the others are revisits of it (profile
identical-payload-digest), without a body of their own. ``write_files`` and ``read_files``
exchange records with WARC files; records read from files keep their headers as they are.

Payloads meet in an aggregation that keeps one of each in every task, so copies never gather.
Records of a payload with many copies are dealt out over parts of PART records, and the
payload goes to each part, so no task gets a hot payload's records alone.

Defined results: a null payload is empty; null ids are the smallest, and of records that
repeat the largest id one is the response; a null URL is left out of the header, control
characters in one are percent-encoded; repeated rows are records of their own; an empty
table gives an empty archive; columns beside id, url and payload play no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir

#: Payloads of fewer bytes are always written as responses.
REVISIT = 1000
#: Records of one payload that a task puts together.
PART = 4096
#: pages have no time of their own.
DATE = "1970-01-01T00:00:00Z"
#: The format's names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"
#: Bytes that are read of a WARC file at a time.
_READ = 1 << 20


@dataclass(frozen=True)
class Archive:
    """headers: record_id, page_id, header, http, key (null without a payload), has_body, part.
    payloads: key, payload, parts (how many parts its records are dealt over)."""

    headers: DataFrame
    payloads: DataFrame


def field(header: Column, name: str) -> Column:
    """The value of a header's field; null where it is absent."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _urn(*parts: Column) -> Column:
    d = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts)))
    cut = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _lines(*lines: Column) -> Column:
    """The lines that are not null, each ended, and an empty one."""
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), _END), F.lit(_END + _END))


def _place(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def archive(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT, date: str = DATE) -> Archive:
    """Writes a record for each page under path, or into the shared folder."""
    path = path or _place(pages, "warc")
    bytes_ = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), bytes_.alias("payload"))
    slim = rows.select(
        F.monotonically_increasing_id().alias("place"), "page_id", "url", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")
    )
    # Written, so that places stay what they are, whatever is computed again.
    slim.write.parquet(f"{path}/rows")
    slim = pages.sparkSession.read.schema(slim.schema).parquet(f"{path}/rows")
    heads = slim.groupBy("key").agg(F.max(F.struct("page_id", "place")).alias("last"), F.count("*").alias("n"))
    same = heads.where("n > 1").select("key", F.col("last.place").alias("first_place"), F.col("last.page_id").alias("first_id"), "n")
    # A table of its own, so that Spark can divide a payload of many copies in the join.
    same.write.parquet(f"{path}/same")
    same = pages.sparkSession.read.schema(same.schema).parquet(f"{path}/same")
    df = slim.join(same, "key", "left").withColumn("revisit", F.coalesce((F.col("size") >= least) & (F.col("place") != F.col("first_place")), F.lit(False)))
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size").cast("string"), F.lit(_END + _END))
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    header = _lines(
        F.lit(VERSION), named("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), named("WARC-Record-ID", _urn(F.col("page_id"), F.col("place"))), F.lit(f"WARC-Date: {date}"),
        named("WARC-Target-URI", target), named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), named("WARC-Refers-To", _urn(F.col("first_id"), F.col("first_place")))), F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"), named("Content-Length", length.cast("string")),
    )
    made = df.select(
        _urn(F.col("page_id"), F.col("place")).alias("record_id"), "page_id", header.cast("binary").alias("header"), http.cast("binary").alias("http"), "key", (~F.col("revisit")).alias("has_body"),
        F.pmod(F.xxhash64("place"), F.ceil(F.coalesce("n", F.lit(1)) / PART)).alias("part"),
    )
    made.write.option("compression", "zstd").parquet(f"{path}/headers")
    _store(rows.select("payload"), path)
    return opened(pages.sparkSession, path)


def _store(rows: DataFrame, path: str) -> None:
    """Each different payload once. A key that two payloads share ends the job."""
    facts = rows.select(F.sha2("payload", 256).alias("key"), F.struct(F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1")).alias("fact"), "payload")
    one = facts.groupBy("key").agg(F.first("payload").alias("payload"), F.min("fact").alias("a"), F.max("fact").alias("b"), F.ceil(F.count("*") / PART).alias("parts"))
    checked = F.when(F.col("a") == F.col("b"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the key "), F.col("key"))))
    one.select(checked.alias("key"), "payload", "parts").write.option("compression", "zstd").parquet(f"{path}/payloads")


def opened(spark: SparkSession, path: str) -> Archive:
    """An archive that was written under path. The page_id is of the type it was written with."""
    return Archive(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


def whole(found: Archive) -> DataFrame:
    """record_id, page_id, header, http, has_body and payload of each record, revisits with
    the payload that they refer to. Bytes that don't hash to their key end the job."""
    right = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("key"))).cast("binary"))
    bodies = found.payloads.select("key", right.alias("payload"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return found.headers.join(bodies, ["key", "part"], "left").drop("key", "part")


def records(found: Archive) -> DataFrame:
    """record_id and record: the exact bytes of each."""
    body = F.when(F.col("has_body"), F.coalesce("payload", F.lit(b""))).otherwise(F.lit(b""))
    return whole(found).select("record_id", F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"))


def listing(found: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-1 of the bytes that were read),
    record_type and refers_to, the page of the response that a revisit names."""
    header = F.col("header")
    rows = whole(found).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), field(header, "WARC-Type").alias("record_type"),
        # A record that refers to none meets itself, so that these don't share one null key.
        F.coalesce(field(header, "WARC-Refers-To"), "record_id").alias("named"),
    )
    named = found.headers.select(F.col("record_id").alias("named"), F.col("page_id").alias("response"))
    refers = F.when(F.col("record_type") == "revisit", F.col("response"))
    return rows.join(named, "named", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


# -- files ---------------------------------------------------------------------------


def write_files(found: Archive, path: str, per_file: int = 50_000) -> None:
    """The records as WARC files. Their bytes go through Spark's text writer, whose line end
    is the end of a record, so that its committer covers lost tasks."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value")
    records(found).select(body).write.option("lineSep", _END + _END).option("maxRecordsPerFile", per_file).text(path)


class _Source:
    """A WARC file, gzip members or plain, that is read a piece at a time."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.rest = data, 0, b""
        self.zip = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def more(self) -> bool:
        piece = bytes(self.data[self.at : self.at + _READ])
        self.at += len(piece)
        if not piece:
            return False
        if self.zip is None:
            self.rest += piece
            return True
        out = []
        while piece:
            out.append(self.zip.decompress(piece))
            piece = self.zip.unused_data
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
        self.rest += b"".join(out)
        return True

    def until(self, end: bytes) -> bytes | None:
        at = self.rest.find(end)
        while at < 0:
            if not self.more():
                return None
            at = self.rest.find(end)
        return self.take(at + len(end))

    def take(self, n: int) -> bytes:
        while len(self.rest) < n and self.more():
            pass
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _parsed(data: memoryview) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record of a file. A file that ends inside a record raises."""
    src = _Source(data)
    while True:
        header = src.until(b"\r\n\r\n")
        if header is None:
            if src.rest.strip():
                raise ValueError("the file ends inside a header")
            return
        sizes = [line.split(b":", 1)[1] for line in header.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        block = src.take(int(sizes[0]))
        if len(block) < int(sizes[0]) or src.take(4) != b"\r\n\r\n":
            raise ValueError("the file ends inside a record")
        yield header, block


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """header, http (null unless the block is an HTTP message) and payload of each record
    of the WARC files under path, gzipped or not. A file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("content"):
                for header, block in _parsed(memoryview(blob.as_buffer())):
                    cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (header, block[:cut] if cut else None, block[cut:])], names=["header", "http", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "header binary, http binary, payload binary")


def archive_records(rows: DataFrame, path: str | None = None) -> Archive:
    """An archive of records as read_files gives them, headers kept byte for byte. Revisits
    have an empty payload of their own; their header names the record that they refer to."""
    path = path or _place(rows, "warc")
    key = F.sha2("payload", 256)
    counts = rows.select(key.alias("_key")).groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    made = rows.select(field(F.col("header"), "WARC-Record-ID").alias("record_id"), "header", F.coalesce("http", F.lit(b"")).alias("http"), key.alias("key"))
    made = made.join(counts, F.col("key") == F.col("_key"), "left")
    part = F.pmod(F.xxhash64("record_id", "header"), F.ceil(F.coalesce("n", F.lit(1)) / PART))
    made = made.select("record_id", F.lit(None).cast("long").alias("page_id"), "header", "http", "key", F.lit(True).alias("has_body"), part.alias("part"))
    made.write.option("compression", "zstd").parquet(f"{path}/headers")
    _store(rows.select("payload"), path)
    return opened(rows.sparkSession, path)


