"""WARC archives: writing pages, and reading back by boundary-chain verification.

Readers cut files into byte ranges. Each range is searched for whatever looks
like the start of a record, and each such candidate gives its offset and that of
its successor. Payloads may hold the same bytes, so a candidate counts only if
it is reached from the file's start: pointer jumping over the candidates doubles
the number of records passed each round.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

VERSION = b"WARC/1.1\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
PAGE_URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a block that is read at once, and blocks that are held.
STEP, HELD = 1 << 18, 4
#: Bytes that are unpacked at a time, so that little is left over behind a record.
PIECE = 1 << 15
#: The most tasks that read archives; beyond, a task reads several ranges.
TASKS = 1 << 15


def payload_digest(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four digits to the base 32."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record: a response with the payload, or a revisit without it. Control characters of the url are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE_URN}{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode("utf-8", "replace") + END + block + END


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, compress: bool = True, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row under ``folder``, a file a task; returns (path, size, records).

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the largest id
    is the response and the others revisit it; rows equal in id and payload are
    all responses if that id is the largest. Payloads are equal if length, SHA-1
    and SHA-256 are, as texts can be made that share a SHA-1. Null html is the
    empty payload. A retried task writes a file of another name, and only files of finished tasks are listed.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    same = ["sha", "digest", "bytes"]
    keys = [F.sha2(payload, 256).alias("sha"), payload_digest(payload).alias("digest"), F.octet_length(payload).alias("bytes")]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), *keys)
    firsts = pages.select(F.col(id_col).alias("page_id"), *keys).where(F.col("bytes") >= min_bytes).groupBy(*same).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*same, "first", F.lit(True).alias("many"))
    firsts = scratch.save(firsts)  # so that both sides of the join are plain shuffles and a hot payload can be split among tasks
    revisit = F.coalesce("many", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(firsts, same, "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def write(batches):
        fs = where = out = None
        size = records = 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    where = f"{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out = fs.open_output_stream(f"{base}/{where}", compression=None)
                data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"])
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{where}"], "size": [size], "records": [records]})

    return rows.mapInArrow(write, "path string, size long, records long")


class _Window:
    """Random access to a file by blocks, of which the last few used are held."""

    def __init__(self, uri: str, size: int):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file, self.size, self.blocks, self.bytes_read = fs.open_input_file(path), size, {}, 0

    def block(self, n: int) -> bytes:
        found = self.blocks.pop(n, None)
        if found is None:
            self.file.seek(n * STEP)
            found = self.file.read(min(STEP, self.size - n * STEP))
            self.bytes_read += len(found)
            while len(self.blocks) >= HELD:
                del self.blocks[next(iter(self.blocks))]
        self.blocks[n] = found  # last in order: used last
        return found

    def piece(self, at: int, length: int) -> memoryview:
        """Up to ``length`` bytes from ``at`` on, of one block; empty at the end of the file."""
        if at >= self.size:
            return memoryview(b"")
        n = at // STEP
        return memoryview(self.block(n))[at - n * STEP : at - n * STEP + length]

    def get(self, at: int, length: int) -> bytes:
        """``length`` bytes from ``at`` on, fewer at the end of the file."""
        out = bytearray()
        while len(out) < length and (more := self.piece(at + len(out), length - len(out))):
            out += more
        return bytes(out)

    def close(self):
        self.file.close()


def _fields(head: bytes) -> dict[str, str]:
    return dict((a.strip().lower(), b.strip()) for a, _, b in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if a)


def _page(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{PAGE_URN}(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _payload(fields: dict, block: bytes) -> tuple[int, str, bool]:
    """(bytes, digest, whether what is here agrees with the head) of the full payload."""
    http, _, body = block.partition(END)
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    n = re.search(rb"(?i)content-length: *(\d+)", http)
    full = int(n[1]) if n else len(body)
    if fields.get("warc-type") == "revisit":
        return full, said, not body
    real = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return len(body), real, real == said and len(body) == full


def candidates_in(uri: str, size: int, start: int, stop: int, window=_Window) -> list[dict]:
    """Candidates that begin in [start, stop) of a file, each with the offset of its successor."""
    zipped, w, out = uri.endswith(".gz"), window(uri, size), []
    magic = GZIP_MAGIC if zipped else VERSION
    try:
        at = start
        while at < stop:
            here = min(stop, (at // STEP + 1) * STEP)
            data = w.get(at, here - at + len(magic) - 1)
            for m in re.finditer(re.escape(magic), data):
                got = _zipped(w, at + m.start()) if zipped else _plain(w, at + m.start())
                if got is not None:
                    fields, block, nxt = got
                    n, digest, agrees = _payload(fields, block)
                    out.append({"offset": at + m.start(), "next": nxt, "page_id": _page(fields.get("warc-record-id")), "payload_bytes": n, "payload_digest": digest, "record_type": fields.get("warc-type"), "refers_to": _page(fields.get("warc-refers-to")), "agrees": agrees})
            at = here
    finally:
        w.close()
    return out


def _zipped(w: _Window, offset: int):
    z, at, text = zlib.decompressobj(31), offset, bytearray()
    try:
        while not z.eof:
            data = w.piece(at, PIECE)
            if not data:
                return None
            text += z.decompress(data)
            at += len(data)
            if not text.startswith(VERSION[: len(text)]):
                return None
    except zlib.error:
        return None
    head, sep, rest = bytes(text).partition(END)
    if not sep or not head.startswith(VERSION):
        return None
    f = _fields(head)
    if not f.get("content-length", "").isdecimal():
        return None
    n = int(f["content-length"])
    if len(rest) != n + len(END) or not rest.endswith(END):
        return None
    return f, rest[:n], at - len(z.unused_data)


def _plain(w: _Window, offset: int):
    head = bytearray()
    while (cut := head.find(END)) < 0:  # a head is as long as it is: on to the blank line
        more = w.piece(offset + len(head), PIECE)
        if not more:
            return None
        head += more
    f = _fields(bytes(head[:cut]))
    if not f.get("content-length", "").isdecimal():
        return None
    first, n = offset + cut + len(END), int(f["content-length"])
    if first + n + len(END) > w.size or w.get(first + n, len(END)) != END:
        return None
    return f, w.get(first, n), first + n + len(END)


FOUND = "file long, offset long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, agrees boolean"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def read_warc(files: DataFrame, scratch: Scratch, chunk: int = 4 << 20) -> DataFrame:
    """The true records of (path, size, records): file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to, agrees.

    ``agrees`` tells whether a response's payload has the digest and the length
    that its head gives. A file whose true records are not ``records`` in
    number, or of which one does not agree, raises an error. An empty file has no records.
    """
    files = scratch.save(files.withColumn("file", F.monotonically_increasing_id()))
    ranges = files.where("size > 0").select("file", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("size") / chunk))).first()[0] or 1
    ranges = ranges.repartition(int(max(1, min(n, TASKS))))  # a given number is not coalesced, though the rows are few
    columns = [x.split() for x in FOUND.split(", ")]

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [{"file": r["file"], **c} for c in candidates_in(r["path"], r["size"], r["start"], min(r["start"] + chunk, r["size"]))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], _KINDS[k]) for c, k in columns], [c for c, _ in columns])

    found = scratch.save(ranges.mapInArrow(search, FOUND))
    # a row a record: too many to broadcast, however small the files are, so the joins are by sorting
    reached = scratch.save(found.where("offset = 0").select("file", "offset"))
    places = found.select("file", F.col("offset").alias("next"))
    jump = scratch.save(found.select("file", "offset", "next").join(places.hint("merge"), ["file", "next"], "left_semi"))
    while True:
        # offsets grow along a chain, so those 2**k records on are none of the 2**k reached before
        ahead = scratch.save(reached.join(jump.hint("merge"), ["file", "offset"]).select("file", F.col("next").alias("offset")))
        if ahead.isEmpty():
            break
        more = scratch.save(reached.union(ahead))
        longer = scratch.save(jump.join(jump.select("file", F.col("offset").alias("next"), F.col("next").alias("then")).hint("merge"), ["file", "next"]).select("file", "offset", F.col("then").alias("next")))
        scratch.drop(reached, ahead, jump)
        reached, jump = more, longer
    records = scratch.save(found.join(reached.hint("merge"), ["file", "offset"]).drop("next"))
    seen = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("agrees").alias("agrees"))
    torn = files.join(seen, "file", "left").where((F.coalesce("n", F.lit(0)) != F.col("records")) | ~F.coalesce("agrees", F.lit(True))).select("path", "records", "n", "agrees").take(5)
    if torn:
        raise RuntimeError(f"archives that do not read back whole: {torn}")
    return records


def archive_and_read(pages: DataFrame, compress: bool = True, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row for each row of ``pages``, read back from archives in the shared folder.

    Null html is the empty payload; a null url leaves the target out. An empty
    table writes no file and gives an empty table. Extra columns do not matter.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    files = scratch.save(write_warc(pages, f"{scratch.root}/archives", scratch, compress, min_bytes))
    return read_warc(files, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
