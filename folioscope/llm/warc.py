"""WARC archives: writing, and the monolithic gzip normaliser.

Each task writes its pages as WARC records into one gzip stream (one member for the whole file), inflates that
stream once, rewrites every record as a gzip member of its own and writes a sidecar index of offsets; records
are then read back by offset. Archives go to the shared folder through a file system named by its URI; a file is
written under a temporary name and moved, and carries its task attempt in its name, so a task that runs again
leaves no half-written archive in the result.

Defined cases: null html is an empty payload; a null page_id is written as "null" and is always a response;
a null url is about:blank; rows repeated with the same page_id are each a record of the same type; an empty
table writes no archive; extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_map, shared_dir, written

#: Fixed values of the format.
VERSION, DATE = b"WARC/1.1", "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
#: Equal payloads of at least so many bytes are revisits.
REVISIT_BYTES = 1000


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or with refers_to a revisit without the payload."""
    target = "".join(c if 0x21 <= ord(c) else f"%{ord(c):02X}" for c in (url or "about:blank"))
    block = HTTP if refers_to is not None else HTTP + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION.decode():
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records_of(stream, piece: int = 1 << 20):
    """The records of a gzip stream of any members, inflated once from front to end."""
    inflate, held, need = zlib.decompressobj(31), bytearray(), 0
    while True:
        raw = stream.read(piece)
        if not raw:
            break
        while raw:
            held += inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = bytes(held[at:end]).lower()
                mark = head.index(b"\r\ncontent-length:") + 17
                need = end + 4 - at + int(head[mark:].split(b"\r\n", 1)[0]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise(fs, source: str, target: str, level: int = 3) -> list[tuple[int, int]]:
    """Rewrite an archive with a member for each record; the sidecar index goes to target + ".idx"."""
    entries, at, lines = [], 0, []
    with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(f"{target}.tmp", compression=None) as out:
        for one in records_of(stream):
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = deflate.compress(one) + deflate.flush()
            out.write(member)
            head = one[: one.index(b"\r\n\r\n")].decode().split("\r\n")
            entries.append((at, len(member)))
            lines.append(json.dumps({"offset": at, "length": len(member), "id": head[2].partition(": ")[2], "type": head[1].partition(": ")[2]}))
            at += len(member)
    with fs.open_output_stream(f"{target}.idx.tmp", compression=None) as out:
        out.write("".join(x + "\n" for x in lines).encode())
    fs.move(f"{target}.tmp", target)
    fs.move(f"{target}.idx.tmp", f"{target}.idx")
    return entries


def read_back(fs, target: str):
    """(headers, payload) of every record that the sidecar index lists."""
    with fs.open_input_stream(f"{target}.idx", compression=None) as f:
        index = [json.loads(x) for x in f.read().decode().splitlines()]
    with fs.open_input_file(target) as f:
        for entry in index:
            f.seek(entry["offset"])
            headers, block = parsed(zlib.decompress(f.read(entry["length"]), 31))
            yield entry, headers, block.partition(b"\r\n\r\n")[2]


def _archive(batches, folder: str, keep_source: bool):
    fs, root = pa.fs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    name = f"{root}/pages-{context.partitionId():05d}-{context.taskAttemptId()}" if context else f"{root}/pages-{uuid.uuid4().hex}"
    number, out, size = 0, None, 0
    page = lambda x: None if x == "<urn:x-page:null>" else int(x[12:-1])

    def finish():
        stream, deflate = out
        stream.write(deflate.flush())
        stream.close()
        source, target = f"{name}-{number}.mono.gz", f"{name}-{number}.warc.gz"
        normalise(fs, source, target)
        if not keep_source:
            fs.delete_file(source)
        rows = []
        for entry, headers, payload in read_back(fs, target):
            kind, digest = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2]
            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{target} at {entry['offset']}: payload and digest differ")
            rows.append((page(headers["warc-record-id"]), int(headers["x-payload-length"]), digest, kind, page(headers["warc-refers-to"]) if kind == "revisit" else None, target.rpartition("/")[2], entry["offset"], entry["length"]))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"])

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{name}-{number}.mono.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
            payload = html or b""
            data = record(page_id, url, payload, digest, refers_to)
            out[0].write(out[1].compress(data))
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield finish()
                number, out, size = number + 1, None, 0
    if out is not None:
        yield finish()


def archived(pages: DataFrame, folder: str | None = None, keep_source: bool = False) -> DataFrame:
    """Write pages (page_id, url, html) to archives in `folder`; a row for each record as read back.

    Digests and the choice of responses are made in the JVM; a payload that many pages share is counted by
    partial sums, and the join that follows can split its rows over tasks. The archives are written here, once: the
    rows are those of the attempts that Spark has committed, and what other attempts have left in the folder goes.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    groups = rows.filter(F.length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(groups, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    made = written(arrow_map(rows, _archive, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long", folder, keep_source), "warc-index")
    _swept(made, folder)
    return made


def _swept(made: DataFrame, folder: str) -> None:
    """Deletes files of archives that no row names."""
    spark = made.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    named = {r["archive"].removesuffix(".warc.gz") for r in made.select("archive").distinct().toLocalIterator()}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if re.sub(r"\.(mono|warc)\.gz.*$", "", name) not in named:
            fs.delete(status.getPath(), False)


def op9(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS first FROM d WHERE n >= {REVISIT_BYTES} GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN g USING (digest)"""
