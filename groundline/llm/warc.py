"""Operator 4: WARC records in seekable Zstandard bundles.

A bundle groups its records into independent frames, appends the seek table and
an index from record identifiers to frame and offset in the frame. Equal
payloads of ``revisit_bytes`` or more are stored once: the record with the
smallest page_id is a response, the others are revisits of it.

Equal payloads are found by a grouped minimum over (page_id, digest) rows and
joined back by digest; both are light rows, and a digest that a third of all
pages share is combined on the map side and split by Spark in the join.

Defined results: a null html is empty; a null page_id is never a revisit nor
the response that others revisit, and is written with an empty identifier;
rows that repeat a page_id and its payload are all responses if it is the
smallest, and their identifiers end in the number of bundle and record, so each
is found; what refers to them names the identifier without that end. Other
columns are ignored; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .seekable import Reader, Writer

REVISIT_BYTES = 100
FRAME_BYTES = 1 << 18
RECORD_DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "bundle int, path string, n_records long, n_frames int, n_bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle int, frame int, place long"


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to, repeated) of the payloads that an earlier page has or that several rows have under one id."""
    html = common.text_or_empty("html")
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), (F.octet_length(html) >= least).alias("large"), F.sha2(html.cast("binary"), 256).alias("digest"))
    pairs = common.written(light.groupBy("page_id", "digest", "large").agg((F.count(F.lit(1)) > 1).alias("repeated")), "warc-pairs")
    first = pairs.where("large and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers_to = F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    return pairs.join(first, "digest", "left").select("page_id", "digest", refers_to, "repeated").where("refers_to is not null or repeated")


def _uri(page_id: int | None, digest: str, end: str = "") -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:16]}{end}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, end: str = "") -> tuple[str, bytes]:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and leaves out the payload. ``end`` ends its identifier."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", uri := _uri(page_id, digest, end)),
        ("WARC-Date", RECORD_DATE),
        *([("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to, digest))] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return uri, head.encode() + block + b"\r\n\r\n"


def parse(data: memoryview, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record at ``at``: its fields, HTTP header block, payload and end."""
    size = 65536
    while b"\r\n\r\n" not in (raw := bytes(data[at : at + size])) and at + size < len(data):
        size *= 4
    head, _, _ = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    fields = dict(x.split(": ", 1) for x in lines)
    begin = at + len(head) + 4
    end = begin + int(fields["Content-Length"])
    block = bytes(data[begin:end])
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload, end + 4


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes the bundles of ``pages`` (page_id, url, html) under ``path``; returns their manifest, itself written."""
    html = common.text_or_empty("html")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    known = revisits(pages, least)
    same = rows["page_id"].eqNullSafe(known["page_id"]) & (rows["digest"] == known["digest"])
    rows = rows.join(known, same, "left").select(rows["page_id"], "url", "html", "refers_to", "repeated")
    rows = rows.sortWithinPartitions("page_id", "url", "html")

    def bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/bundle-{(part := TaskContext.get().partitionId()):06d}-{uuid.uuid4().hex}.warc.zst"
        writer, held, size = None, [], 0
        uris, frames, places = [], [], []
        for batch in batches:
            for page_id, address, payload, refers_to, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                writer = writer or Writer(name)
                uri, data = record(page_id, address, payload.encode(), refers_to, f":{part}.{len(uris)}" if repeated else "")
                uris.append(uri)
                frames.append(len(writer.frames))
                places.append(size)
                held.append(data)
                size += len(data)
                if size >= frame_bytes:
                    writer.frame(b"".join(held))
                    held, size = [], 0
        if writer is None:
            return
        if held:
            writer.frame(b"".join(held))
        index = pa.table({"record_id": uris, "frame": pa.array(frames, pa.int32()), "place": pa.array(places, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        writer.close(sink.getvalue())
        yield pa.RecordBatch.from_pydict({"bundle": pa.array([part], pa.int32()), "path": [name], "n_records": [len(uris)], "n_frames": pa.array([len(writer.frames)], pa.int32()), "n_bytes": [writer.size]})

    return common.written(rows.mapInArrow(bundles, MANIFEST), "warc-manifest")


def _page(uri: str) -> int | None:
    number = uri[1:-1].split(":")[2]
    return int(number) if number else None


def read_bundles(manifest: DataFrame) -> DataFrame:
    """Every record of every bundle, with the digest of each stored payload held against its header."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["path"])
                for k in range(len(reader.frames)):
                    data, at, out = memoryview(reader.frame(k)), 0, []
                    while at < len(data):
                        fields, http, payload, end = parse(data, at)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if (kind := fields["WARC-Type"]) == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"a payload of {row['path']} is damaged")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        out.append((_page(fields["WARC-Record-ID"]), length, digest, kind, refers, fields.get("WARC-Target-URI"), row["bundle"], k, at))
                        at = end
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
                    names = [x.split()[0] for x in READ.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                reader.close()

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("bundle", "path").repartition(parts, "bundle").mapInArrow(read, READ)


def read_record(path: str, record_id: str) -> bytes:
    """One record of a bundle; only its frame is decompressed."""
    reader = Reader(path)
    index = pa.ipc.open_stream(reader.index()).read_all()
    k = index.column("record_id").to_pylist().index(record_id)
    data, at = memoryview(reader.frame(index.column("frame")[k].as_py())), index.column("place")[k].as_py()
    reader.close()
    return bytes(data[at : parse(data, at)[3]])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return read_bundles(write_bundles(pages, common.scratch(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op4_warc": f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
q as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then first_id end as refers_to
from q"""
}
