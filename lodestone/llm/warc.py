"""WARC archives: a writer (one gzip member per record, revisit records for repeated payloads) and a sequential reader
(incremental zlib decompression member by member, framing by Content-Length, verification of digests).

Scale: each task writes one archive to the shared folder and keeps one record in memory; the reader keeps one record
and one block of the file. The table of archives stays a table. Which payloads repeat is found on narrow rows
(digest, id); the pages themselves are shuffled only where the table of repeated payloads is too large to send."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import settle, shared_dir

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Pages of one payload that one task looks up, about.
CHUNK = 10_000
BLOCK = 1 << 18
ID_URI = "urn:page:"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that breaks the format or does not have the digest that it names."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, which names the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    name = "" if page_id is None else page_id
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID_URI}{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")))
    if revisit:
        fields += [("WARC-Refers-To", f"<{ID_URI}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text + block + b"\r\n\r\n") + pack.flush()


def members(file: BinaryIO, block: int = BLOCK) -> Iterator[bytes]:
    """The uncompressed bytes of each gzip member, one after the other."""
    rest = b""
    while True:
        unpack, parts, begun = zlib.decompressobj(31), [], False
        while not unpack.eof:
            data = rest or file.read(block)
            rest = b""
            if not data:
                if begun:
                    raise WarcError("the archive ends inside a member")
                return
            begun = True
            try:
                parts.append(unpack.decompress(data))
            except zlib.error as e:
                raise WarcError(f"a damaged member: {e}") from e
        rest = unpack.unused_data
        yield b"".join(parts)


def parsed(member: bytes) -> dict:
    """The record in a member: its head's fields (lower case), HTTP head and body, checked against its lengths and digests."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise WarcError("no record head")
    fields = {}
    for line in lines[1:]:
        k, mark, v = line.decode("utf-8").partition(":")
        if not mark:
            raise WarcError(f"a field without a colon: {k!r}")
        fields[k.strip().lower()] = v.strip()
    size = int(fields.get("content-length", "-1"))
    block, tail = rest[:size], rest[size:]
    if size < 0 or len(block) != size or tail != b"\r\n\r\n":
        raise WarcError("the content length does not frame the block")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise WarcError("the block does not have its digest")
    http, _, body = block.partition(b"\r\n\r\n")
    if fields.get("warc-type") == "response" and (want := fields.get("warc-payload-digest")) and want != f"sha1:{hashlib.sha1(body).hexdigest()}":
        raise WarcError("the payload does not have its digest")
    return {"fields": fields, "http": http, "body": body}


def row(read: dict) -> dict:
    """What a record says of its page."""
    fields = read["fields"]
    number = lambda uri: int(x) if (x := uri.strip("<>").removeprefix(ID_URI)) else None
    length = next((int(line.split(b":")[1]) for line in read["http"].split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")), len(read["body"]))
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload_bytes": length, "payload_digest": fields["warc-payload-digest"].partition(":")[2],
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": None if fields["warc-type"] == "revisit" else read["body"],
    }


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


ROWS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def revisits(spark: SparkSession, pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload digest and refers_to: of equal payloads of at least `least` bytes, all
    records but those with the largest page_id refer to it. Null html is an empty payload; a null page_id refers to
    the largest of its payload, and where there is none it is a response; rows that repeat the largest page_id are
    all responses."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    ready = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"))
    most = ready.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    most = settle(spark, most, "repeated-payloads")
    # A digest of many pages is dealt in chunks, and pages too small to repeat have keys of their own: no task gets all of them.
    hot = settle(spark, most.where(F.col("n") > CHUNK).select(F.col("digest").alias("key"), F.ceil(F.col("n") / CHUNK).cast("bigint").alias("chunks")), "hot-payloads")
    chunks, one = F.coalesce("chunks", F.lit(1).cast("bigint")), F.lit(0).cast("bigint")
    keyed = ready.withColumn("key", F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    keyed = keyed.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), chunks))
    last = most.withColumnRenamed("digest", "key").join(hot, "key", "left").select("key", "last", F.explode(F.sequence(one, chunks - 1)).alias("salt"))
    return keyed.join(last, ["key", "salt"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).select("page_id", "url", "html", "digest", "refers_to")


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write an archive per partition of pages and return the settled table of them: archive, records, bytes. A task
    that runs twice writes its own file and only the archive of the attempt that ends counts. Null html is an empty payload; a null url or page_id
    is none when it is read back; repeated rows are records each. A payload is held whole while it is written, however long. Columns are taken by the names
    that revisits() gives; an empty table gives no archive, or archives without records."""
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name = f"{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        with store.open_output_stream(os.path.join(path, name), compression=None) as out:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "refers_to")]
                for i in range(batch.num_rows):
                    page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                    data = record(page_id, url, (html or "").encode("utf-8"), digest, refers_to)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    rows = revisits(spark, pages).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint")
    return settle(spark, rows.withColumn("archive", F.concat(F.lit(folder + "/"), "archive")), "archives")


def read(archives: DataFrame, payloads: bool = True, flush: int = 256) -> DataFrame:
    """The records of the archives named in `archive`, in file order; a record that breaks the format fails the query.
    Payloads are held one at a time; without archives, or with empty ones, there are no rows. `archive` is the only column that is read."""
    schema = ROWS if payloads else T.StructType(ROWS.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(schema)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = _store(uri)
                with store.open_input_stream(path, compression=None) as file:
                    some = []
                    for member in members(file):
                        some.append(row(parsed(member)))
                        if len(some) >= flush:
                            yield pa.RecordBatch.from_pylist(some, form)
                            some = []
                    if some:
                        yield pa.RecordBatch.from_pylist(some, form)

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, schema)
