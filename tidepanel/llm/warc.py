"""WARC archives: write with an index, read by coalesced byte ranges.

Archives are gzipped record by record, so each record is a byte range of its
own.  Writing a partition yields one index row per record: file, offset,
length, URL and digest.  Reading takes any selection of index rows, sorts it by
file and offset, and fetches neighbouring records with one range read.

Files are written once under a name that no other attempt uses, and a file's
index rows leave the task only after it is closed: a task that is run again
leaves a file that no index row names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import written

FILE_BYTES = 256 << 20
#: one range read covers records at most so far apart, and so many bytes unless one record is longer
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
_INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_key string"
_DATE = "2024-01-01T00:00:00Z"


def qualified(spark, path: str) -> str:
    """A path with its scheme, as executors need it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(target).toString()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def _record(kind: str, uri: str | None, rid: str, digest: str, refers: str | None, block: bytes) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {_DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", uri))
    if digest:
        head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    head.append("Content-Type: " + ("application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response"))
    head.append(f"Content-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, directory: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row into ``directory`` and return the index, itself written.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the
    smallest key become response records, the others revisit records that name
    it and carry the HTTP head only.  Payload: the text in UTF-8.

    A null or empty payload has 0 bytes; a null key never is the one
    referred to unless all are null, when all are responses; a null URL leaves
    its header out; repeated rows are records of their own.  Other columns
    aren't written.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).alias("id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("page_key"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha")
    )
    slim = rows.where(F.length("payload") >= min_bytes).select("id", "page_key", "sha")
    firsts = slim.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    later = slim.join(firsts, "sha").where("id is null or id > first").select("page_key", "sha", F.col("first").cast("string").alias("refers")).distinct()
    rows = rows.select("page_key", "url", "payload", "sha").join(later, ["page_key", "sha"], "left")
    where = qualified(pages.sparkSession, directory)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(where)
        fs.create_dir(base, recursive=True)
        out, name, at, index = None, "", 0, []

        def shut() -> Iterator[pa.RecordBatch]:
            nonlocal out, at, index
            if out is not None:
                out.close()
                names = [f.split(" ")[0] for f in _INDEX.split(", ")]
                cols = list(zip(*index))
                kinds = {"offset": pa.int64(), "length": pa.int64()}
                yield from pa.table({n: pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, cols)}).to_batches(max_chunksize=10_000)
            out, at, index = None, 0, []

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_key", "url", "payload", "sha", "refers")]
            for page, uri, body, sha, refers in zip(*cols):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = _gzip(_record("warcinfo", None, f"urn:uuid:{uuid.uuid4()}", "", None, b"format: WARC File Format 1.1\r\n"))
                    out.write(data)
                    at = len(data)
                kind = "response" if refers is None else "revisit"
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                data = _gzip(_record(kind, uri, f"urn:x-page:{page}", digest, refers, block + body if refers is None else block))
                out.write(data)
                index.append((f"{where}/{name}", at, len(data), uri, digest, kind, page))
                at += len(data)
                if at >= FILE_BYTES:
                    yield from shut()
        yield from shut()

    return written(rows.select("page_key", "url", "payload", "sha", "refers").mapInArrow(go, _INDEX), "warc-index")


def parse(data: bytes) -> dict:
    """One record: type, page, digest, payload length, payload (None in a revisit) and the page it refers to.

    A response's digest and length are checked against its payload.
    """
    raw = zlib.decompress(data, 31)
    cut = raw.index(b"\r\n\r\n") + 4
    head = dict(x.split(": ", 1) for x in raw[: cut - 4].decode().split("\r\n")[1:])
    block = raw[cut : cut + int(head["Content-Length"])]
    http = block.index(b"\r\n\r\n") + 4
    size = int(re.search(rb"\r\nContent-Length: (\d+)", block[:http])[1])
    page = lambda h: head[h].removeprefix("<urn:x-page:").removesuffix(">") if h in head else None
    body = block[http:] if head["WARC-Type"] == "response" else None
    if body is not None and len(body) != size:
        raise ValueError(f"a payload of {len(body)} bytes where {size} were announced")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if body is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"the payload's digest isn't {digest}")
    return {"page_key": page("WARC-Record-ID"), "record_type": head["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "payload": body, "refers_to": page("WARC-Refers-To")}


def coalesced(ranges: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """Merge sorted (file, offset, length) into (file, start, end, indices) reads."""
    at = 0
    while at < len(ranges):
        file, start, length = ranges[at]
        end, take = start + length, [at]
        while (nxt := at + len(take)) < len(ranges):
            f, o, n = ranges[nxt]
            if f != file or o - end > GAP_BYTES or o + n - start > READ_BYTES:
                break
            end = max(end, o + n)
            take.append(nxt)
        yield file, start, end, take
        at += len(take)


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the selected index rows: page_key, record_type, payload_digest, payload_bytes, refers_to and, if asked for, payload (binary, null in revisits)."""
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    fields = ["page_key string", "record_type string", "payload_digest string", "payload_bytes long", "refers_to string"] + ["payload binary"] * payload
    names = [f.split(" ")[0] for f in fields]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict[str, object] = {}
        for batch in batches:
            ranges = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for file, start, end, take in coalesced(ranges):
                if file not in handles:
                    for h in handles.values():
                        h.close()
                    fs, path = _open(file)
                    handles = {file: fs.open_input_file(path)}
                data = handles[file].read_at(end - start, start)
                found = [parse(data[ranges[i][1] - start : ranges[i][1] - start + ranges[i][2]]) for i in take]
                yield from pa.table({n: pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names}).to_batches()
        for h in handles.values():
            h.close()

    return rows.mapInArrow(go, ", ".join(fields))
