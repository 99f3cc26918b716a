"""WARC archives: a writer with revisit records, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import done, in_batches, own_folder, small, staged, table, text_of

MAGIC = b"\x1f\x8b\x08"
#: Bytes that one reading task owns, and that it fetches at a time.
SPLIT, CHUNK = 32 << 20, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives carry no time of their own; the date is a parameter of the writer.
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Record ids: of a page, and of a row without an id.
PAGE, NO_PAGE = "<urn:page:", "<urn:nopage>"
#: Reading tasks at most; each gets the byte ranges that are its share.
READERS = 100_000


def record(page_id: str | None, url: str, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One gzip member with a response record, or a revisit record that has the response's HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {NO_PAGE if page_id is None else f'{PAGE}{page_id}>'}", f"WARC-Date: {date}", "WARC-Target-URI: " + " ".join(url.split())]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def opened(uri: str):
    """(file system, path) for a URI that executors can reach: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, html: str = "html") -> DataFrame:
    """Writes a record per row below ``folder``; returns the files that hold them: (path, bytes, n).

    Of rows whose payloads (the html in UTF-8, null as empty) are equal and at least ``min_bytes`` long,
    that with the largest page_id is the response and the rest are revisits to it. A task writes a file of
    a name of its own, and only the files of tasks that succeeded are returned, so a task that is run
    again leaves no double. Rows with a null page_id are responses without an id; an empty table gives no
    file; other columns are ignored.
    """
    rows = pages.select(pages["page_id"].cast("string").alias("page"), pages["page_id"].alias("order"), F.coalesce(pages["url"], F.lit("")).alias("url"), text_of(pages, html).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    seen = rows.where("page is not null").select("order", "page", "digest", F.octet_length("html").alias("n"))
    seen = staged(seen.where(F.col("n") >= min_bytes).select("order", "page", "digest"), "warc-digests")
    owners = staged(seen.groupBy("digest").agg(F.max("order").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "owner"), "warc-owners")
    again = seen.join(owners, "digest").where("order <> owner").select("page", "digest", F.col("owner").cast("string").alias("refers_to")).distinct()
    again = staged(again, "warc-revisits")
    done(seen, owners)
    if small(again):
        again = F.broadcast(again)
    rows = rows.join(again, ["page", "digest"], "left").select("page", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        system.create_dir(top, recursive=True)
        name, n, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
        out = None
        for b in batches:
            for page, url, text, refers in zip(*(b.column(k).to_pylist() for k in ("page", "url", "html", "refers_to"))):
                data = record(page, url, text.encode("utf-8", "surrogatepass"), refers)
                out = out or system.open_output_stream(name, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "n"])

    return staged(in_batches(rows, run, "path string, bytes long, n long"), "warc-files")


class Window:
    """A file's bytes from some place on, fetched in pieces; bytes before the last ``drop`` are let go."""

    def __init__(self, handle, size: int, at: int):
        self.handle, self.size, self.base, self.data = handle, size, at, b""

    def more(self) -> bool:
        end = self.base + len(self.data)
        if end >= self.size:
            return False
        self.handle.seek(end)
        self.data += self.handle.read(min(CHUNK, self.size - end))
        return True

    def drop(self, to: int) -> None:
        self.data = self.data[to - self.base :]
        self.base = to


def member(window: Window, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at`` if it starts a WARC record, else None."""
    unpacker, parts, begun, used = zlib.decompressobj(31), [], False, at
    try:
        while not unpacker.eof:
            if used >= window.base + len(window.data) and not window.more():
                return None
            piece = window.data[used - window.base :]
            content = unpacker.decompress(piece)
            used += len(piece) - len(unpacker.unused_data)
            parts.append(content)
            if not begun and (head := b"".join(parts)) and len(head) >= 7:
                if not head.startswith(b"WARC/1."):
                    return None
                begun = True
    except zlib.error:
        return None
    whole = b"".join(parts)
    return (whole, used) if begun and b"\r\n\r\n" in whole else None


def members(handle, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose first byte lies in [start, end). The scan looks for the gzip magic and takes a place only if a WARC header decodes there."""
    window, at = Window(handle, size, start), start
    while at < end:
        found = window.data.find(MAGIC, max(at - window.base, 0))
        if found < 0:
            at = max(at, window.base + len(window.data) - len(MAGIC) + 1)
            window.drop(max(window.base, min(at, window.base + len(window.data))))
            if at >= end or not window.more():
                return
            continue
        at = window.base + found
        if at >= end:
            return
        window.drop(at)
        got = member(window, at)
        if got is None:
            at += 1
            continue
        yield got[0]
        at = got[1]
        window.drop(at)


def parsed(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields with lower-case names, HTTP header, payload)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def named(record_id: str) -> str | None:
    """The page's id in a record id; None for a row without one."""
    return None if record_id == NO_PAGE else record_id.removeprefix(PAGE).removesuffix(">")


def read_warc(files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of files(path, bytes) by byte ranges: page, url, record_type, payload_bytes, payload_digest, refers_to, html.

    A revisit has the length and digest of the payload that it stands for and no html. A response whose
    payload doesn't have the digest in its header raises an error.
    """
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(READERS, ranges.count())), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in ("path", "bytes", "start"))):
                out = []
                with system.open_input_file(path) as handle:
                    for content in members(handle, size, start, min(size, start + split)):
                        f, http, payload = parsed(content)
                        digest, page = f["warc-payload-digest"].removeprefix("sha1:"), named(f["warc-record-id"])
                        if f["warc-type"] == "response":
                            if base32_sha1(payload) != digest:
                                raise ValueError(f"record {page} of {path} doesn't have its payload digest")
                            out.append((page, f["warc-target-uri"], "response", len(payload), digest, None, payload.decode("utf-8", "surrogatepass")))
                        else:
                            full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            out.append((page, f["warc-target-uri"], f["warc-type"], full, digest, named(f["warc-refers-to"]), None))
                        if len(out) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
                            out = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return in_batches(ranges, run, "page string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, html string")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns what the reader finds there; see ``write_warc`` and ``read_warc`` for odd rows."""
    folder = f"{own_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_warc(write_warc(pages, folder, min_bytes), folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    r = archive(pages)
    return r.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
