"""WARC archives: writer with revisit records, splittable reader.

Writing: payload hashes are grouped (partial aggregates, no payload moves), and
each task writes its records as one ``.warc.gz`` of single-record gzip members.
A file's name is new for each attempt and only the files that successful tasks
report (the manifest) belong to the archive, so a retry leaves no double records.

Reading: files are cut into byte ranges.  A task looks for the gzip magic in its
range, checks a candidate by decoding its header and the first bytes of the
member, which must begin a WARC record, and owns every record that starts inside
its range; the last one is read on beyond the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.llm.store import new_folder, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:wordpair:page:"
SPLIT_BYTES = 4 << 20
#: Reading tasks at most; beyond that a task reads several ranges.
READ_TASKS = 20_000
CHUNK = 1 << 18

MANIFEST = "path string, bytes long, records long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, "
           "payload_bytes long, payload_digest string")

_EMBEDDED = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def open_fs(uri: str):
    """(filesystem, path) of a folder or file URI; a bare path is local."""
    from pyarrow import fs
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix(URN)
    return None if value == "null" else int(value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                 revisit: bool, date: str) -> bytes:
    """One WARC record (not compressed).  A revisit has the HTTP header with the
    full payload's length and no payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            + f"Content-Length: {len(payload)}\r\n\r\n".encode())
    block = http if revisit else http + payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$&'()*+,/:;=?@[]~-._"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, revisit``: of pages with equal payloads
    of at least ``min_bytes``, that with the smallest id is a response and others
    revisit it."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("h", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    groups = (rows.where("h is not null").groupBy("h")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and first_id is not null").select("h", "first_id"))
    # ids and hashes find out who revisits; payloads meet that by id and hash, so one
    # that many pages share is spread by their ids
    again = (rows.select("page_id", "h").join(groups, "h")
             .where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
             .select(F.col("page_id").alias("again"), "h", "first_id"))
    return (rows.join(again, (F.col("page_id").eqNullSafe(F.col("again"))) & (rows["h"] == again["h"]), "left")
            .select("page_id", "url", "payload", F.col("first_id").alias("refers_to"),
                    F.col("first_id").isNotNull().alias("revisit")))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
               level: int = 6) -> DataFrame:
    """Write one record a row under ``folder`` and return the manifest
    (``path, bytes, records``).

    A null html is an empty payload, a null url has no target header, a null id
    is stored as such (it is a response only if no equal payload has an id).
    Rows that repeat the smallest id of a payload are responses each.  An empty
    table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, refers_to, revisit = (x.as_py() for x in row)
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = gz.compress(record_bytes(page_id, url, payload, refers_to, revisit, date))
                member += gz.flush()
                out.write(member)
                size, n = size + len(member), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())],
                names=["path", "bytes", "records"])

    marked = mark_revisits(pages, id_col, url_col, html_col, min_bytes)
    return written(marked.mapInArrow(run, MANIFEST), "warc-manifest")


class RangeScanner:
    """The gzip members of an open file that start in a byte range."""

    def __init__(self, source, start: int, end: int):
        self.source, self.end = source, end
        self.at, self.buffer = start, b""   # file offset of the buffer

    def _fill(self, upto: int) -> bool:
        """Hold the file's bytes up to ``upto``, or to its end (then False)."""
        while self.at + len(self.buffer) < upto:
            self.source.seek(self.at + len(self.buffer))
            more = self.source.read(CHUNK)
            if not more:
                return False
            self.buffer += more
        return True

    def _drop(self, before: int) -> None:
        self.buffer = self.buffer[before - self.at:]
        self.at = before

    def _begins_record(self, pos: int) -> bool:
        """Whether the bytes at ``pos`` are a gzip header of a member that starts
        as a WARC record."""
        self._fill(pos + 4096)
        head = self.buffer[pos - self.at:pos - self.at + 4096]
        if len(head) < 18 or head[3] & 0xE0:
            return False
        try:
            return zlib.decompressobj(31).decompress(head, 16).startswith(VERSION[:7])
        except zlib.error:
            return False

    def members(self) -> Iterator[bytes]:
        pos = self.at
        while pos < self.end:
            self._fill(min(self.end, pos + CHUNK) + 2)
            i = self.buffer.find(MAGIC, pos - self.at)
            if i < 0:
                pos = max(pos, self.at + len(self.buffer) - 2)
                self._drop(pos)
                if not self._fill(pos + 3):
                    return
                continue
            pos = self.at + i
            if pos >= self.end:
                return
            self._drop(pos)
            if not self._begins_record(pos):
                pos += 1
                continue
            z, out = zlib.decompressobj(31), []
            try:
                while not z.eof:
                    if not self.buffer and not self._fill(self.at + 1):
                        raise zlib.error("the file ends inside a member")
                    out.append(z.decompress(self.buffer))
                    used = len(self.buffer) - len(z.unused_data)
                    self._drop(self.at + used)
            except zlib.error as e:
                raise ValueError(f"broken gzip member at {pos}") from e
            pos = self.at
            yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Fields of a record; the payload's digest and length are checked where the
    record holds it."""
    end = data.index(b"\r\n\r\n") + 2
    head = {k.decode().lower(): v.decode() for k, v in _EMBEDDED.findall(data[len(VERSION):end])}
    block = data[end + 2:end + 2 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n") + 4
    http = {k.decode().lower(): v.decode() for k, v in _EMBEDDED.findall(block[:http_end - 2])}
    size, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    payload = block[http_end:]
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {head['warc-record-id']} does not match its digest")
    url = head.get("warc-target-uri")
    return {"page_id": _page(head["warc-record-id"]),
            "url": None if url is None else urllib.parse.unquote(url), "record_type": kind,
            "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None,
            "payload_bytes": size, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES,
              with_payload: bool = False) -> DataFrame:
    """Records of ``files(path, bytes)``, one task a few byte ranges."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    ranges = (files.where("bytes > 0")
              .select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1,
                                                            F.lit(split_bytes).cast("long"))).alias("start"))
              .select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end")))
    # ranges are tiny rows: a number given stays as it is, else they would be coalesced
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), READ_TASKS), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = open_fs(path)
                rows: list[dict] = []
                held = 0
                with fs.open_input_file(name) as source:
                    for member in RangeScanner(source, start, end).members():
                        r = parse_record(member)
                        rows.append({k: r[k] for k in names})
                        held += len(r["payload"] or b"") if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types))))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types))))

    return ranges.mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    files = write_warc(pages, new_folder(spark, "warc"), min_bytes=min_bytes)
    return read_warc(spark, files, split_bytes)
