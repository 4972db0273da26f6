"""WARC archives written from and read to a chunked record table."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

CHUNK = 1 << 16
EPOCH = "2024-01-01T00:00:00Z"
CHUNK_SCHEMA = "archive string, record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk int, data binary, last boolean, intact boolean"


def _open(uri: str):
    """File system and path of a folder or file: whatever pyarrow can reach, local or shared."""
    return fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), os.path.abspath(uri))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, salts: int = 16) -> DataFrame:
    """Record headers: record_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of `least` bytes or more, that with the largest id is the response and the others
    revisit it. The choice is an aggregate by digest, which is combined before it is shuffled; only digests that occur
    again are joined back, `salts` times over, so that a payload that a third of the records share is spread.
    Null payload: empty. Rows with equal id and payload: all are responses. Null url: empty. Null id: a response, which
    no other record refers to.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("record_id").alias("_to"), F.count("*").alias("_n"))
    first = first.where("_n > 1").select("payload_digest", "_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    keys = rows.select("record_id", "payload_digest", "payload_bytes").withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    again = keys.where(F.col("payload_bytes") >= least).join(first, ["payload_digest", "_salt"]).where(F.col("_to") != F.col("record_id")).select("record_id", "payload_digest", "_to").distinct()
    again = again.select(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"), "_to")
    typed = rows.join(again, (rows.record_id == again._id) & (rows.payload_digest == again._digest), "left")
    return typed.select("record_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("_to").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("_to").alias("refers_to"))


def chunks(recs: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table: record_id and chunk number, with headers on every row; revisits have one empty chunk."""
    data = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    cut_up = recs.withColumn("_data", data).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut_up.select("record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk", F.substring("_data", F.col("chunk") * size + 1, F.lit(size)).alias("data"), (F.col("chunk") == n - 1).alias("last"))


def _urn(record_id: int | None) -> str:
    return f"urn:vesper:{'null' if record_id is None else record_id}"


def _id(urn: str | None) -> int | None:
    """The id in <urn:vesper:id>."""
    name = urn.rpartition(":")[2][:-1] if urn else "null"
    return None if name == "null" else int(name)


def _head(r: dict) -> bytes:
    length = r["payload_bytes"] if r["record_type"] == "response" else 0
    lines = ["WARC/1.0", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{_urn(r['record_id'])}>", f"WARC-Date: {EPOCH}", "WARC-Target-URI: " + " ".join(r["url"].split()), f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
    if r["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{_urn(r['refers_to'])}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def write(recs: DataFrame, folder: str, partitions: int | None = None, chunk: int = CHUNK, level: int = 1) -> DataFrame:
    """Writes gzipped WARC files (a member for each record) to folder, which all executors and readers must share.

    Returns the manifest: archive (URI), records, bytes. Each partition of recs becomes an archive (`partitions` of
    them, if given). A record's chunk rows follow one another; a task streams them through one compressor and never
    holds a record. It writes under a name of its own and renames when done, so a
    task that runs twice leaves one whole archive. Empty input: no archives.
    """
    rows = chunks(recs.repartition(partitions, "record_id") if partitions else recs, chunk)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        there, base = _open(folder)
        name, temporary = f"{base}/part-{part:06d}.warc.gz", f"{base}/.{uuid.uuid4().hex}.tmp"
        out, packer, count = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk", "last")}
                if out is None:
                    there.create_dir(base, recursive=True)
                    out = there.open_output_stream(temporary, compression=None)
                if r["chunk"] == 0:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(r)))
                out.write(packer.compress(batch.column("data")[i].as_buffer()))
                if r["last"]:
                    out.write(packer.compress(b"\r\n\r\n"))
                    out.write(packer.flush())
                    count += 1
        if out is not None:
            size = out.tell()
            out.close()
            there.move(temporary, name)
            uri = folder.rstrip("/") + f"/part-{part:06d}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    return cut(rows.mapInArrow(store, "archive string, records long, bytes long"))


class _Members:
    """Bytes of a gzip file with many members, read and unpacked in pieces."""

    def __init__(self, source, piece: int):
        self.source, self.piece, self.raw, self.ready, self.unpacker = source, piece, b"", bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        if self.unpacker.eof:
            self.raw = self.unpacker.unused_data or self.raw
            self.unpacker = zlib.decompressobj(31)
        data = self.unpacker.unconsumed_tail or self.raw or self.source.read(self.piece)
        self.raw = b""
        if not data:
            return False
        self.ready += self.unpacker.decompress(data, self.piece)
        return True

    def head(self) -> bytes | None:
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        head = bytes(self.ready[:end])
        del self.ready[: end + 4]
        return head

    def take(self, most: int) -> bytes:
        while not self.ready:
            if not self.more():
                raise EOFError("the archive ends within a record")
        piece = bytes(self.ready[:most])
        del self.ready[:most]
        return piece


def read(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives of a manifest (column archive), see CHUNK_SCHEMA.

    An archive is streamed: a record's payload goes out in chunks of `chunk` bytes, and a running SHA-1 is compared
    with the record's own digest on its last chunk (`intact`; null before). Without `payloads` only last chunks go
    out, with null data; payloads are read and digested all the same.
    """
    names = CHUNK_SCHEMA.split(", ")
    names = [n.split()[0] for n in names]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()]

    def rows_of(uri: str) -> Iterator[tuple]:
        there, path = _open(uri)
        with there.open_input_stream(path, compression=None) as source:
            stream = _Members(source, chunk)
            while (head := stream.head()) is not None:
                fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
                left, k, digest = int(fields["content-length"]), 0, hashlib.sha1()
                row = [uri, _id(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], _id(fields.get("warc-refers-to")), int(fields["x-payload-length"]), fields["warc-payload-digest"].partition(":")[2]]
                while True:
                    piece = bytearray()
                    while left and len(piece) < chunk:
                        piece += stream.take(min(left, chunk - len(piece)))
                        left = int(fields["content-length"]) - k * chunk - len(piece)
                    digest.update(piece)
                    if payloads or not left:
                        yield (*row, k, bytes(piece) if payloads else None, not left, (row[3] == "revisit" or digest.hexdigest() == row[6]) if not left else None)
                    if not left:
                        break
                    k += 1
                for _ in range(4):
                    stream.take(1)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                for row in rows_of(uri):
                    held.append(row)
                    size += len(row[8] or b"") + 200
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    uris = manifest.select("archive")
    return uris.repartition(max(1, uris.count()), "archive").mapInArrow(load, CHUNK_SCHEMA)


def archive(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Writes every page to WARC archives below folder (by default in the shared checkpoint folder); their manifest."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return write(records(pages, **names), folder)


def verdict(table: DataFrame) -> Column:
    """Stops the query where an archive's payload doesn't match its digest."""
    return F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged WARC record "), F.col("record_id").cast("string"))))


SQL_OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
"""
