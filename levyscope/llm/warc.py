"""Web archives: a deterministic sharded writer, and a reader.

Pages are range-sorted by ``page_id`` and payload, so pages without an id or with one id spread; each task writes its range as
gzip members, one per record, and starts a new file when the compressed size passes ``roll_bytes``. Headers and digests are
made anew from the content, and nothing depends on the clock, so the same pages give the same bytes. Files are written under
temporary names; what the finished job reports is the manifest, and only files of the manifest get their names. The manifest
(name, bytes, records, sha256 of every file) is a table beside the archives, and ``_manifest.json`` with its totals is written
last. The reader opens what the manifest names and nothing else, and fails where the totals are missing or a file is not what
the manifest says, so neither a lost task nor a writer that died leaves anything that is read. The folder is named by a URI
that every executor reaches; pyarrow opens it.

Of records with equal payloads of at least ``min_payload`` bytes the one with the least ``page_id`` is the response and the
others are revisits of it. Null html is an empty payload, a null url an ``urn:page:`` name. Repeated rows of one page: the
first of equal ones is the response, the others revisit it. Pages without ``page_id`` come first and are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyscope.scale import stage, stage_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{payload_digest}')}>"


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member without a time."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode()) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int) -> bytes:
    """The record of a page; a revisit has the HTTP header but not the payload."""
    http, found = HTTP.format(len(payload)).encode(), digest(payload)
    block = http + payload if refers_to is None else http
    target = "".join(c for c in url if c not in "\r\n") if url else f"urn:page:{page_id}"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, found)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{found}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, found)), ("X-Refers-To-Page", str(refers_to))]
    return member(headers, block, level)


def info_record(name: str, level: int) -> bytes:
    block = b"software: levyscope\r\nformat: WARC file version 1.1\r\n"
    headers = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", name),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/warc-fields"),
    ]
    return member(headers, block, level)


def revisits(pages: DataFrame, min_payload: int) -> DataFrame:
    """(page_id, payload key, page of the response) of pages whose payload another page has; no payload travels."""
    keys = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    keys = keys.where(F.octet_length("html") >= min_payload).select("page_id", F.sha1(F.col("html").cast("binary")).alias("key"))
    keys = stage(keys, "payload-keys").df
    first = keys.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stage(first.select("key", "refers_to"), "first-payloads").df
    return keys.join(first, "key").where(F.col("page_id") != F.col("refers_to")).select("page_id", "key", "refers_to")


def write_archives(
    pages: DataFrame, folder: str, roll_bytes: int = 16 << 20, min_payload: int = 0, level: int = 4, prefix: str = "pages"
) -> DataFrame:
    """Write the pages below ``folder`` (not there yet) and return the manifest: name, bytes, records, sha256."""
    marks = stage(revisits(pages, min_payload), "revisits").df
    key = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    here = pages.select("page_id", "url", "html", key.alias("key"), F.lit(None).cast("long").alias("refers_to"))
    marks = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "key", "refers_to")
    n = pages.rdd.getNumPartitions()
    # a page's mark comes right before the page
    merged = here.unionByName(marks).repartitionByRange(n, "page_id", "key").sortWithinPartitions(
        "page_id", "key", F.col("refers_to").asc_nulls_last(), "url"
    )
    merged = merged.withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        attempt = uuid.uuid4().hex
        store.create_dir(f"{root}/_temporary/{attempt}")
        done, held, last, target, shard = [], None, None, None, None

        def close():
            nonlocal held
            if held:
                stream, path, name, size, records, sha = held
                stream.close()
                done.append((shard, name, path, size, records, sha.hexdigest()))
                held = None

        def put(data):
            held[0].write(data)
            held[3] += len(data)
            held[5].update(data)

        for batch in batches:
            for page_id, url, html, key, refers_to, shard in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (page_id, key) != last:
                    last, target = (page_id, key), None
                if refers_to is not None:
                    target = refers_to
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                if held is None:
                    name = f"{prefix}-{shard:05d}-{len(done):05d}.warc.gz"
                    path = f"_temporary/{attempt}/{name}"
                    held = [store.open_output_stream(f"{root}/{path}", compression=None), path, name, 0, 0, hashlib.sha256()]
                    put(info_record(name, level))
                put(page_record(page_id, url, payload, target, level))
                if target is None and page_id is not None and len(payload) >= min_payload:
                    target = page_id  # for the same page again
                held[4] += 1
                if held[3] >= roll_bytes:
                    close()
        close()
        if done:
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["shard", "name", "path", "bytes", "records", "sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    manifest = merged.mapInArrow(run, "shard int, name string, path string, bytes long, records long, sha256 string")
    manifest = stage(manifest, "manifest").df

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, path in zip(batch.column("name").to_pylist(), batch.column("path").to_pylist()):
                old, new = f"{root}/{path}", f"{root}/{name}"
                if store.get_file_info(old).type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    store.move(old, new)
            yield batch.select(["name", "bytes", "records", "sha256"])

    named = stage(manifest.mapInArrow(commit, "name string, bytes long, records long, sha256 string"), "committed").df
    named.write.parquet(f"{folder}/manifest")
    total = named.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("records")).first()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")  # files of lost attempts
    with store.open_output_stream(f"{root}/_manifest.json") as f:
        f.write(json.dumps(dict(zip(("files", "bytes", "records"), (x or 0 for x in total)))).encode())
    return named


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 20) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record at {line[:40]!r}")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            block = f.read(int(headers["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield headers, block


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload of a
    response. Only files of the manifest are read; they are checked against it, and digests against the content."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/_manifest.json") as f:  # not there: the archive was not finished
        total = json.loads(f.read())
    manifest = spark.read.parquet(f"{folder}/manifest").select("name", "bytes", "sha256")
    if manifest.count() != total["files"]:
        raise ValueError(f"the manifest of {folder} does not have {total['files']} files")
    n = max(1, min(total["files"], 4 * spark.sparkContext.defaultParallelism, total["bytes"] >> 20))
    files = manifest.repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, sha in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    content = f.read()
                if len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                out, held = [], 0
                for headers, block in parse(content):
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    found = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or digest(payload) != found):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not what its headers say")
                    page, target = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
                    page, target = page and int(page), target and int(target)
                    out.append((page, headers["WARC-Target-URI"], length, found, kind, target, payload if with_payload else None))
                    held += len(payload) if with_payload else 200
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    found = files.mapInArrow(run, ddl)
    return found if with_payload else found.drop("payload")


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    path = stage_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
