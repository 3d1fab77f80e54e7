"""Web archives: a writer with revisit records and a reader that salvages damaged files.

Archives are gzip files with one member per record (or plain files), written and read as streams by tasks on the shared
folder.  When a member does not inflate, a header does not parse, a length does not fit or a
digest differs, the reader looks for the next place where a valid member begins (or the
next version line in plain files), goes on from there, and reports the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, column
from panelspark.session import scratch_path, written

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/[01]\.[0-9]+\r?\n")
MEMBER = b"\x1f\x8b\x08"
_HTTP_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.IGNORECASE)
READ_BYTES = 1 << 20
FIRST_BYTES = 1 << 9
# Where a record may begin: a member or, in plain files, a version line.
VERSION_MARK = re.compile(rb"WARC/")
MARKS = re.compile(rb"\x1f\x8b\x08|WARC/")
MARK_BYTES = 5
# In plain files a header block longer than this is damage, apart from its target address, which has any length.
MAX_HEADER = 1 << 16
TARGET = b"warc-target-uri:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record; a revisit keeps the HTTP header (with the full length) and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20]+", "%20", url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_text(hashlib.sha1(block).digest())}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damage(Exception):
    pass


class MemberDamage(Damage):
    """The packed bytes themselves are broken."""


def parse_record(data: bytes) -> dict:
    """A whole record (version line to end of block) as fields and block; raises ``Damage``."""
    if not VERSION_LINE.match(data):
        raise Damage("version line")
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise Damage("header")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Damage("length")
    length = int(fields["content-length"])
    if len(rest) < length or rest[length:].strip(b"\r\n"):
        raise Damage("length")
    fields["block"] = rest[:length]
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != digest_text(hashlib.sha1(fields["block"]).digest()):
        raise Damage("digest")
    http, _, payload = fields["block"].partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", fields["block"])
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "revisit":
        # The payload is the one revisited; the kept HTTP header says how long it is.
        told = _HTTP_LENGTH.search(http + b"\r\n")
        fields |= {"payload": None, "payload_bytes": int(told[1]) if told else None, "payload_digest": stated or None}
        return fields
    found = digest_text(hashlib.sha1(payload).digest())
    if stated and stated != found:
        raise Damage("payload digest")
    return fields | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}


class _Source:
    """A window over a byte stream that grows forward and is cut from behind."""

    def __init__(self, stream):
        self.stream, self.buffer, self.start, self.ended = stream, bytearray(), 0, False

    def more(self) -> bool:
        if self.ended:
            return False
        got = self.stream.read(READ_BYTES)
        self.ended = not got
        self.buffer += got
        return bool(got)

    def cut(self, n: int) -> None:
        del self.buffer[:n]
        self.start += n

    def fill(self, n: int) -> None:
        while len(self.buffer) < n and self.more():
            pass

    def find(self, mark: bytes, at: int) -> int:
        """Place of the next ``mark`` from ``at`` on, reading as far as needed; -1 at the end."""
        while True:
            k = self.buffer.find(mark, at)
            if k >= 0:
                return k
            at = max(at, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return -1

    def seek(self, marks: re.Pattern) -> None:
        """Cut up to the next mark behind the first byte, or to the end; what is passed is dropped block by block."""
        self.cut(1)
        while True:
            found = marks.search(self.buffer)
            if found:
                return self.cut(found.start())
            self.cut(max(0, len(self.buffer) - MARK_BYTES + 1))
            if not self.more():
                return self.cut(len(self.buffer))


class _Member:
    """The inflated bytes of the member at the front of a source, as a stream.

    Reads little at first, so a false mark is cheap.
    """

    def __init__(self, source: _Source):
        self.source, self.end, self.step = source, 0, FIRST_BYTES
        self.inflater = zlib.decompressobj(31)

    def read(self, _: int) -> bytes:
        while not self.inflater.eof:
            if self.end == len(self.source.buffer) and not self.source.more():
                raise MemberDamage("cut member")
            piece = bytes(self.source.buffer[self.end : self.end + self.step])
            self.step = min(2 * self.step, READ_BYTES)
            try:
                out = self.inflater.decompress(piece)
            except zlib.error as e:
                raise MemberDamage("member") from e
            self.end += len(piece) - len(self.inflater.unused_data)
            if out:
                return out
        return b""

    def pass_by(self) -> None:
        """Drop the packed bytes read so far."""
        self.source.cut(self.end)
        self.end = 0


def _header_end(source: _Source, at: int, most: int) -> int:
    """Place of the blank line after the header at ``at``; raises ``Damage``.

    Only one address is free of the bound ``most``, so a false mark is given up soon.
    """
    line, room, addressed = at, most, False
    while True:
        while len(source.buffer) - line < len(TARGET) and source.more():
            pass
        if source.buffer[line - 2 : line + 2] == b"\r\n\r\n" and line > at:
            return line - 2
        if not addressed and source.buffer[line : line + len(TARGET)].lower() == TARGET:
            addressed = True
            end = source.find(b"\n", line)
        else:
            while (end := source.buffer.find(b"\n", line, line + room)) < 0:
                if len(source.buffer) - line >= room or not source.more():
                    break
            room -= end + 1 - line
        if end < 0:
            raise Damage("header")
        line = end + 1


def _plain(source: _Source, at: int, most: int = MAX_HEADER) -> tuple[bytes, int]:
    """The plain record at ``at`` and the place after it."""
    gap = _header_end(source, at, most)
    found = _HTTP_LENGTH.search(bytes(source.buffer[at : gap + 2]))
    if not found:
        raise Damage("length")
    end = gap + 4 + int(found[1])
    while len(source.buffer) < end + 4 and source.more():
        pass
    if len(source.buffer) < end:
        raise Damage("cut record")
    data = bytes(source.buffer[at:end])
    while end < len(source.buffer) and source.buffer[end] in b"\r\n":
        end += 1
    return data, end


def _records(source: _Source) -> Iterator[tuple[str, object]]:
    """``("record", fields)`` and ``("bad", reason)`` of the member at the front of a source; cuts it off.

    One record to a member is the rule: it counts once the member has ended well.  A member that
    goes on with further records is read on like a plain archive, each record by its own checks,
    and its packed bytes are dropped as they are passed.
    """
    stream = _Member(source)
    inner = _Source(stream)
    waiting = bad = None
    several = False
    try:
        while True:
            inner.fill(16)
            ends = len(inner.buffer) - len(inner.buffer.lstrip(b"\r\n"))
            if ends:
                inner.cut(ends)
                continue
            if not inner.buffer:
                break
            opens = VERSION_LINE.match(inner.buffer)
            try:
                if not opens:
                    raise Damage("version line")
                # A member that inflates may have a header of any length.
                data, end = _plain(inner, 0, sys.maxsize)
                fields = parse_record(data)
            except MemberDamage:
                raise
            except Damage as e:
                if waiting is None and not several and not opens:
                    raise
                bad = bad or str(e)
                inner.seek(VERSION_MARK)
                continue
            several = several or waiting is not None or bad is not None
            if waiting is not None:
                yield "record", waiting
            if bad is not None:
                yield "bad", bad
            waiting, bad = fields, None
            inner.cut(end)
            if several:
                stream.pass_by()
    except MemberDamage:
        if several and waiting is not None:
            yield "record", waiting
        raise
    if bad is not None and not several:
        raise Damage("length" if waiting is not None else bad)
    if waiting is not None:
        yield "record", waiting
    stream.pass_by()
    if bad is not None:
        yield "bad", bad


def salvage(stream) -> Iterator[tuple[str, object]]:
    """``("record", fields)`` and ``("gap", (start, end, reason))`` in file order.

    Memory holds one record (packed and not) and one block of what is searched after damage.  Bytes of a
    gap are those of the file, packed as they are.
    """
    source = _Source(stream)
    gap: tuple[int, str] | None = None
    while source.buffer or source.more():
        source.fill(16)
        start = source.start
        try:
            if source.buffer[:1] == MEMBER[:1]:
                for kind, what in _records(source):
                    if kind == "bad":
                        gap = gap or (start, what)
                        continue
                    if gap is not None:
                        yield "gap", (gap[0], max(start, gap[0]), gap[1])
                        gap = None
                    yield "record", what
                    start = source.start
            else:
                if not VERSION_LINE.match(source.buffer):
                    raise Damage("no record begins here")
                data, end = _plain(source, 0)
                fields = parse_record(data)
                if gap is not None:
                    yield "gap", (gap[0], source.start, gap[1])
                    gap = None
                source.cut(end)
                yield "record", fields
        except Damage as e:
            gap = gap or (source.start, str(e))
            # The next valid start is checked by the next turn of the loop.
            source.seek(MARKS)
    if gap is not None:
        yield "gap", (gap[0], source.start, gap[1])


def _writer(root: str, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(root)
        path, out, count = None, None, 0
        try:
            for batch in batches:
                for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        # A name of its own for each attempt: only listed files are read.
                        path = f"{base}/{uuid.uuid4().hex}.warc{'.gz' if packed else ''}"
                        out = files.open_output_stream(path, compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    data = record(kind, page_id, url, payload, refers_to, digest_text(bytes.fromhex(sha1)))
                    out.write(member(data) if packed else data)
                    count += 1
        finally:
            if out is not None:
                out.close()
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return run


def write_archives(df: DataFrame, root: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, packed: bool = True) -> DataFrame:
    """Archives below ``root`` (a folder all executors share); returns the table of files (path, records).

    Of pages with equal payloads of at least ``min_bytes`` the one with the smallest id is a
    response and the others revisit it; rows equal in id and payload are responses each, and so are
    pages without an id if none of their group has one.  Null pages have an empty payload.
    """
    spark = df.sparkSession
    bound_batches(spark)
    files, base = pyarrow.fs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    raw = F.encode(F.coalesce(column(html), F.lit("")), "UTF-8")
    pages = df.select(column(id).alias("page_id"), column(url).alias("url"), column(html).alias("html"), F.sha1(raw).alias("sha1"))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    # Sums per digest are partial before they move; only digests of several pages are joined back.
    seen = pages.where(size >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    shared = seen.where("n > 1").select("sha1", "first_id")
    joined = pages.join(shared, "sha1", "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (size >= min_bytes)
    records = joined.select("page_id", "url", "html", "sha1", F.when(other, F.col("first_id")).alias("refers_to"))
    listed = records.mapInArrow(_writer(root, packed), "path string, records long")
    return written(listed, "warc-files")[0]


def _reader(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(root)
        kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["path", "kind", "fields", "payload", "payload_bytes", "payload_digest", "gap_start", "gap_end", "reason"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for kind, what in salvage(stream):
                        if kind == "gap":
                            rows.append((path, "gap", None, None, None, None, *what))
                        else:
                            payload, size, digest = (what.pop(k) for k in ("payload", "payload_bytes", "payload_digest"))
                            held += len(what.pop("block"))
                            fields = list(what.items())
                            rows.append((path, what.get("warc-type"), fields, payload if payloads else None, size, digest, None, None, None))
                        if held > READ_BYTES * 4 or len(rows) >= 500:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def read_archives(files: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the files listed in ``files`` (path), one row each.

    ``kind`` is the record type or ``gap``; ``fields`` has the header by lower-case name,
    ``payload`` the content without its HTTP header (null for revisits, or if not asked for). Gaps have
    the byte range and what failed first.  An empty list or an empty file gives no rows.
    """
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = files.select("path").repartition(n)
    schema = "path string, kind string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, gap_start long, gap_end long, reason string"
    return dealt.mapInArrow(_reader(root, payloads), schema)


def page_records(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (bare), record_type, refers_to."""
    number = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), "<urn:page:(-?[0-9]+)>", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = records.where("kind in ('response', 'revisit')")
    return rows.select(
        as_id(F.col("fields")["warc-record-id"]).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        as_id(F.col("fields")["warc-refers-to"]).alias("refers_to"),
    )


def archived(df: DataFrame, **names) -> DataFrame:
    """Write all pages as archives in the scratch folder and read their records back."""
    root = scratch_path(df.sparkSession, "warc")
    files = write_archives(df, root, **names)
    return page_records(read_archives(files, root, payloads=False))
