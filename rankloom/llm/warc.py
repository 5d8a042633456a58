"""WARC archives: a writer with revisit records and a salvage reader.

Writer. Rows with equal payloads are told by SHA-1; the one with the largest id becomes a response, the others revisit it. Every task
writes archives of bounded size, one gzip member per record, under names of its own, and returns their names as rows. Only names that
came back from tasks that ended well count, so files of lost or repeated tasks are never read.

Reader. A record is taken if its gzip member (its version line, if the file isn't compressed) is whole and its lengths and digests hold.
After a failed check the reader looks for the next gzip member that holds a valid record, or the next version line with one, goes on
there, and reports the bytes between as a gap. It reads from the start of what isn't yet settled, so it holds about one record at a time; a
length beyond the end of the file or beyond MOST_BYTES is a failed check, so a damaged one doesn't make it read on. Archives are dealt to as
many tasks as there are archives, up to READ_TASKS. restore() compares the records read with those written and keeps the gaps in a table.

Defined results: null payload is the empty one; rows that tie for the largest id of a payload are all responses; a null id is smaller than any
other, and rows of a payload that has no known id are all responses; repeated rows give repeated records; a null url is left out; an
empty table gives no archive; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

#: Bytes after which a task begins another archive, and that the reader asks for at once.
ROLL, CHUNK = 32 << 20, 1 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
#: Bytes within which a record's header must end, and the most that a record or member may hold.
HEAD, MOST_BYTES = 1 << 20, 1 << 30
#: Tasks that read archives, at most.
READ_TASKS = 20_000


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a local path."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed. A revisit carries the HTTP head of its payload but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_fs(folder)
        out, name, n, size, done = None, "", 0, 0, []
        try:
            for b in batches:
                for page_id, url, payload, sha, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None:
                        name, n, size = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                        out = store.open_output_stream(f"{at}/{name.rpartition('/')[2]}", compression=None)
                    data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to)
                    data = member(data) if compress else data
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= ROLL:
                        out.close()
                        out = None
                        done.append((name, n, size))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return run


def write(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compress: bool = True) -> DataFrame:
    """Write an archive record for every row; a table of (file, records, bytes). Payloads under least_bytes are never revisited."""
    spark = ship(pages.sparkSession)
    folder = common.new_path(spark, "warc")
    store, at = open_fs(folder)
    store.create_dir(at, recursive=True)
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    again = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    joined = rows.join(again.drop("n"), "sha", "left")
    refers_to = F.when(F.col("last").isNotNull() & (F.length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    made = joined.select("id", "url", "payload", "sha", refers_to.alias("refers_to"))
    return common.cut(made.mapInArrow(_writer(folder, compress), "file string, records long, bytes long"), "warc-files")


class Source:
    """A file seen from a moving start: bytes before it are let go, bytes after it are read as needed."""

    def __init__(self, read: Callable[[int], bytes], size: int | None = None):
        self.read, self.size, self.data, self.start, self.ended = read, size, bytearray(), 0, False

    def more(self) -> bool:
        part = b"" if self.ended else self.read(CHUNK)
        self.ended = not part
        self.data += part
        return bool(part)

    def need(self, n: int) -> bool:
        """Whether there are n bytes from the start on."""
        if self.size is not None and self.start + n > self.size:
            return False
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.start += n


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Bad(Exception):
    pass


def _headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without colon")
        found[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found


def _check(name: str, data: bytes, digest: str | None) -> None:
    kind, _, value = (digest or "").partition(":")
    if kind.lower() == "sha1" and base32_sha1(data) != value:
        raise Bad(f"{name} digest differs")


def _head_end(source: Source, at: int) -> int:
    """Where the header lines from a place on end. A line without a colon, as another version line is, or HEAD bytes without an end are Bad, so no more is looked at than may be a header."""
    line = at
    while True:
        while (end := source.data.find(b"\r\n", line, at + HEAD)) < 0 and len(source.data) - at < HEAD and source.more():
            pass
        if end < 0:
            raise Bad("header without end")
        if end == line:
            return end - 2
        if source.data.find(b":", line, end) < 0:
            raise Bad("header line without colon")
        line = end + 2


def _plain(source: Source, at: int = 0) -> tuple[int, dict, dict, bytes]:
    """The record at a place: (length, headers, HTTP headers, payload). Raises Bad."""
    source.need(at + 10)
    if not VERSION.match(source.data, at):
        raise Bad("no version line")
    end = _head_end(source, at + 10)
    headers = _headers(bytes(source.data[at + 10 : end]))
    if not re.fullmatch("[0-9]{1,15}", headers.get("content-length", "")):
        raise Bad("no content length")
    first, n = end + 4, int(headers["content-length"])
    if n > MOST_BYTES:
        raise Bad("record too long")
    if not source.need(first + n + 4):
        raise Bad("record cut short")
    if source.data[first + n : first + n + 4] != b"\r\n\r\n":
        raise Bad("record without end")
    block = bytes(source.data[first : first + n])
    _check("block", block, headers.get("warc-block-digest"))
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http"):
        head, mark, payload = block.partition(b"\r\n\r\n")
        http = _headers(head.partition(b"\r\n")[2]) if mark else {}
    if headers.get("warc-type") == "response":
        _check("payload", payload, headers.get("warc-payload-digest"))
    return first + n + 4 - at, headers, http, payload


def _member(source: Source, at: int = 0) -> tuple[int, list[tuple[dict, dict, bytes]]]:
    """The gzip member at a place: (length, its records). Raises Bad."""
    source.need(at + 3)
    if source.data[at : at + 3] != MAGIC:
        raise Bad("no gzip member")
    z, out, held, k = zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof:
            if k >= len(source.data) and not source.more():
                raise Bad("member cut short")
            part = bytes(source.data[k : k + CHUNK])
            out.append(z.decompress(part, MOST_BYTES + 1 - held))
            held += len(out[-1])
            if held > MOST_BYTES:
                raise Bad("member too long")
            k += len(part)
    except zlib.error as e:
        raise Bad(f"member: {e}") from None
    inner = Source(_once(b"".join(out)), held)
    found = []
    while inner.need(1):
        n, *rest = _plain(inner)
        found.append(tuple(rest))
        inner.skip(n)
    if not found:
        raise Bad("member without a record")
    return k - len(z.unused_data) - at, found


def _once(data: bytes) -> Callable[[int], bytes]:
    parts = [data]
    return lambda n: parts.pop() if parts else b""


def salvage(read: Callable[[int], bytes], size: int | None = None) -> Iterator[Record | Gap]:
    """Records and gaps of a file, in order, covering every byte; size: that of the file, where it is known."""
    source = Source(read, size)
    while source.need(1):
        begin, at, why, found = source.start, 0, "", None
        while found is None:
            try:
                n, found = _either(source, at)
            except Bad as e:
                why, at = why or str(e), _next_mark(source, at + 1)
                if at == len(source.data):
                    n, found = 0, []
        source.skip(at)
        if source.start > begin:
            yield Gap(begin, source.start - begin, why)
        for one in found:
            yield Record(source.start, n, *one)
        source.skip(n)


def _either(source: Source, at: int) -> tuple[int, list[tuple[dict, dict, bytes]]]:
    source.need(at + 3)
    if source.data[at : at + 3] == MAGIC:
        return _member(source, at)
    n, *rest = _plain(source, at)
    return n, [tuple(rest)]


def _next_mark(source: Source, at: int) -> int:
    """Where the next gzip member or version line may begin; the end of the file if nowhere. Bytes that hold none are let go."""
    while not (m := MARK.search(source.data, at)):
        source.skip(max(at, len(source.data) - 6))
        at = 0
        if not source.more():
            return len(source.data)
    if m.start() < CHUNK:
        return m.start()
    source.skip(m.start())
    return 0


ROWS = "file string, offset long, length long, reason string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string"


def _page(name: str | None) -> int | None:
    m = re.fullmatch("<urn:x-page:(-?[0-9]+)>", name or "")
    return int(m[1]) if m else None


def _reader(with_payload: bool):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_payload else []))
    names = [x.split()[0] for x in ROWS.split(", ")] + ["payload"] * with_payload

    def row(file: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (file, x.offset, x.length, x.reason, *[None] * (6 + with_payload))
        h, kind = x.headers, x.headers.get("warc-type")
        size, digest = len(x.payload), base32_sha1(x.payload)
        if kind == "revisit":
            size, digest = int(x.http.get("content-length", 0)), h.get("warc-payload-digest", "").removeprefix("sha1:")
        url = h.get("warc-target-uri")
        return (file, x.offset, x.length, None, kind, _page(h.get("warc-record-id")), None if url is None else urllib.parse.unquote(url), _page(h.get("warc-refers-to")), size, digest, *([x.payload] if with_payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for b in batches:
            for file in b.column(0).to_pylist():
                store, at = open_fs(file)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as f:
                    for x in salvage(f.read, store.get_file_info(at).size):
                        rows.append(row(file, x))
                        held += 200 + (len(rows[-1][-1] or b"") if with_payload else 0)
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return run


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in files: ROWS and, if asked for, the payload. A gap has a reason and no record type."""
    ship(files.sparkSession)
    tasks = max(1, min(READ_TASKS, files.count()))  # a number, as otherwise so short a list would be read by one task
    return files.select("file").repartition(tasks).mapInArrow(_reader(with_payload), ROWS + ", payload binary" * with_payload)


def restore(files: DataFrame, with_payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of archives that write() has made, both from a written table; an error if records are missing or more than were written."""
    found = common.cut(read(files, with_payload), "warc-records")
    records, gaps = found.where("record_type is not null"), found.where("record_type is null").select("file", "offset", "length", "reason")
    written, back = files.agg(F.sum("records")).first()[0] or 0, records.count()
    if written != back:
        raise ValueError(f"{written} records written and {back} read back; {gaps.count()} gaps")
    return records, gaps


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = restore(write(common.table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as body from pages
), d as (
  select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as hex from p
), g as (
  select hex, max(page_id) as last from d group by hex
)
select d.page_id, d.payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d.hex, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), 'string_agg', '') as payload_digest,
  case when d.page_id is distinct from g.last and g.last is not null then 'revisit' else 'response' end as record_type,
  case when d.page_id is distinct from g.last then g.last end as refers_to
from d join g using (hex)
"""
