"""WARC archives with a two-level capture index.

Records are written as gzip members, one archive a partition. Their captures, keyed by reversed
host, path and record id, are range-partitioned and sorted; each partition becomes an index file of
compressed blocks followed by a sparse directory of the blocks' first keys. A lookup finds the index
file by binary search in the files' first keys, the block by binary search in that file's
directory, the capture by binary search in the block, and then reads just the record's byte range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, new_folder, null_last

#: Captures a block and, up to so many index files that their first keys may be broadcast, a file.
A_BLOCK, A_FILE, FILES = 256, 8_192, 4_096
TAIL = "<QQ8s"
MAGIC = b"LKIDX\x00\x00\x01"
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key: host labels from the right, then path and query; no scheme, port or fragment."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").lower()
    except ValueError:
        return f"-){(url or '').strip()}"
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value: on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit names the response and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = http + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", clean(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode("utf-8", "replace") + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda block: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def page_of(urn: str | None) -> int | None:
    if urn is None or urn == "<urn:page:null>":
        return None
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


def opened(path: str):
    return pafs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, *, smallest: int = 0) -> DataFrame:
    """Write a record per page and return the captures: key, archive, offset, length.

    pages: page_id, url, html (null: empty). Of records with equal payloads of at least `smallest`
    bytes the one with the smallest page_id is a response and all others revisit it; smaller ones
    are responses. A null page_id comes after all others; rows that repeat the response are
    responses too. An archive left by a task that failed is not referred to.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("i", null_last("page_id"))
    firsts = p.select("sha1", "i").groupBy("sha1").agg(F.min("i").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha1", "first")
    p = p.join(firsts, "sha1", "left")
    small = F.octet_length("html") < smallest
    refers = F.when(~small & (F.col("i") > F.col("first")), F.col("first.id"))
    plan = p.select("page_id", "url", "html", refers.alias("refers"))

    def run(batches):
        path = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
        store, where = opened(path)
        out = None
        at = 0
        for batch in batches:
            rows = []
            if batch.num_rows and out is None:
                store.create_dir(where.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(where, compression=None)
            for d, u, h, r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                payload = h.encode("utf-8", "replace")
                member = record("response" if r is None else "revisit", d, u, payload, payload_digest(payload), r)
                out.write(member)
                rows.append({"key": f"{surt(u)} {'~' if d is None else format(d, '020d')}", "archive": path, "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return cut(plan.mapInArrow(run, "key string, archive string, offset long, length long"))


def write_index(captures: DataFrame, folder: str, *, files: int | None = None) -> DataFrame:
    """Sort captures into index files of compressed blocks; returns a row a file: first, index, captures.

    A file is: the blocks, the directory (JSON, compressed: first key, offset, length of each
    block), and a tail that says where the directory lies.
    """
    files = min(FILES, files or max(1, -(-captures.count() // A_FILE)))
    ranged = captures.repartitionByRange(files, "key").sortWithinPartitions("key", "archive", "offset")

    def run(batches):
        path = f"{folder}/index-{uuid.uuid4().hex}.idx"
        store, where = opened(path)
        out, held, directory, at, n = None, [], [], 0, 0

        def flush() -> None:
            nonlocal out, at
            if out is None:
                store.create_dir(where.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(where, compression=None)
            block = zlib.compress(json.dumps(held).encode(), 6)
            out.write(block)
            directory.append([held[0][0], at, len(block)])
            at += len(block)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(row)
                n += 1
                if len(held) == A_BLOCK:
                    flush()
        if held:
            flush()
        if out is not None:
            sparse = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(sparse)
            out.write(struct.pack(TAIL, at, len(sparse), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "index": path, "captures": n}])

    return cut(ranged.mapInArrow(run, "first string, index string, captures long"))


class IndexFile:
    """An open index file: its sparse directory, and one block at a time."""

    def __init__(self, path: str):
        store, where = opened(path)
        self.size = store.get_file_info(where).size
        self.file = store.open_input_file(where)
        at, length, magic = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), self.size - struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no index")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, at)))
        self.firsts = [x[0] for x in self.directory]
        self.held, self.block = -1, []

    def captures(self, key: str) -> list[list]:
        """All captures whose key is `key` or, for a key that ends in a space, starts with it."""
        found = []
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.directory) and (k == 0 or self.firsts[k] <= key or self.firsts[k].startswith(key)):
            if self.held != k:
                _, at, length = self.directory[k]
                self.block, self.held = json.loads(zlib.decompress(self.file.read_at(length, at))), k
            i = bisect.bisect_left(self.block, key, key=lambda c: c[0])
            while i < len(self.block) and (self.block[i][0] == key or (key.endswith(" ") and self.block[i][0].startswith(key))):
                found.append(self.block[i])
                i += 1
            k += 1
            if i < len(self.block):
                break
        return found


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Captures (key, archive, offset, length) of keys, for a whole table of them (column key).

    A full key names one record; one that ends in a space (the reversed-host key and a space) names
    all captures of a URL. The index files' first keys, at most 4,096, are broadcast; keys are then
    dealt by file and range, in sorted order, so that neighbours share blocks.
    """
    rows = index.select("first", "index").orderBy("first", "index").limit(FILES + 1).collect()
    if len(rows) > FILES:
        raise ValueError("too many index files")
    table = keys.sparkSession.sparkContext.broadcast(([r["first"] for r in rows], [r["index"] for r in rows]))

    def place(batches):
        firsts, _ = table.value
        for batch in batches:
            keys_, files_ = [], []
            for key in batch.column(0).to_pylist():
                lo = max(0, bisect.bisect_left(firsts, key) - 1)
                hi = bisect.bisect_right(firsts, key + "\U0010ffff" if key.endswith(" ") else key)
                for f in range(lo, max(hi, lo + 1)):
                    keys_.append(key)
                    files_.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(files_, pa.int32()), pa.array(keys_, pa.string())], ["file", "key"])

    def find(batches):
        held, current = -1, None
        for batch in batches:
            out = []
            for f, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f != held:
                    held, current = f, IndexFile(table.value[1][f])
                out += current.captures(key)
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "archive", "offset", "length"])

    if not rows:
        return keys.sparkSession.createDataFrame([], "key string, archive string, offset long, length long")
    width = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select("key").where("key is not null").distinct().mapInArrow(place, "file int, key string").repartitionByRange(width, "file", "key").sortWithinPartitions("file", "key")
    return dealt.mapInArrow(find, "key string, archive string, offset long, length long")


def read_records(captures: DataFrame) -> DataFrame:
    """Range-read captures: page_id, url, record_type, payload_digest, refers_to, payload (null for a revisit).

    Captures are dealt by archive and range of offsets, and read in that order.
    """
    width = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.select("archive", "offset", "length").repartitionByRange(width, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        held, file = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for path, at, length in zip(*(batch.column(j).slice(i, 256).to_pylist() for j in range(3))):
                    if path != held:
                        store, where = opened(path)
                        held, file = path, store.open_input_file(where)
                    warc, _, payload = parse_record(file.read_at(length, at))
                    kind = warc["warc-type"]
                    out.append({"page_id": page_of(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "record_type": kind, "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:"), "refers_to": page_of(warc.get("warc-refers-to")), "payload": payload if kind == "response" else None})
                yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, *, smallest: int = 0) -> DataFrame:
    """Write archives and index for all pages, then look every capture up and read its record back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url. A response's size
    and digest are those of the payload read back; a revisit's are those of the response that it
    names by page_id and digest, as a page_id may repeat with other payloads. A payload that is not
    what its record claims, and a revisit without its response, are errors. Null html is an empty payload; a null or odd url gets a key of its own; other columns are
    ignored.
    """
    folder = new_folder(bounded(pages.sparkSession), "warc")
    captures = write_archives(pages, folder, smallest=smallest)
    index = write_index(captures, folder)
    found = lookup(captures.select("key"), index)

    @F.pandas_udf("string")
    def digest(payloads):
        return payloads.map(lambda b: None if b is None else payload_digest(b))

    read = read_records(found)
    read = cut(read.select("page_id", "url", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), digest("payload").alias("own"), F.col("payload_digest").alias("claimed")))
    # what was read must be what was written
    read = read.withColumn("own", F.when(F.col("own").isNull() | (F.col("own") == F.col("claimed")), F.col("own")).otherwise(F.raise_error(F.lit("a payload is not what its record says"))))
    responses = read.where("record_type = 'response'")
    # a page may have several responses, so the digest tells which one; written out, so that Spark can split a payload that very many records revisit
    origin = cut(responses.select(F.col("page_id").alias("o"), F.col("n").alias("on"), F.col("own").alias("oo")).distinct())
    revisits = read.where("record_type = 'revisit'").join(origin, F.expr("refers_to <=> o and claimed = oo"), "left").withColumn("n", F.col("on")).withColumn("own", F.col("oo"))
    revisits = revisits.withColumn("n", F.coalesce("n", F.raise_error(F.lit("a revisit has no response")).cast("long")))
    columns = ["page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", "refers_to", "url"]
    return responses.select(*columns).union(revisits.select(*columns))
