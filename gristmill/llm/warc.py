"""WARC archives: a writer with revisit records and a salvage reader.

The reader checks every gzip member (CRC and length), every record's version
line, headers, length and digest. A file may hold plain records and members, and a
member many records, in any mixture. After a failed check the reader searches for
the next version line or the next member, whichever comes first, reads on from
there and logs the bytes between as a quarantined gap. Within a member it
searches the content, so a bad record costs no other record of its member. Of a
member that is itself broken or cut short, the records before (and after, where it
still inflates) the damage are kept if a block digest of their own confirms them. Files and members are read
through sliding windows, so memory is one record, not one file.

Archives are written by tasks through pyarrow's file systems into the shared
folder under names that hold the task attempt; only files listed in the
manifest, which Spark commits, are read, so retries and lost executors leave at
most unlisted files behind.

Edge cases: null html is an empty payload, null url an empty target; rows with
equal payload and equal page_id are all responses; a null page_id counts as the
smallest. Damaged records never stop a read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
STEP = 1 << 18
FILE_BYTES = 16 << 20
_FIRST = 1 << 14
_SMALL = 1 << 10
#: A payload that so many rows have is looked up without bringing its rows together.
COMMON = 1000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_EMPTY = digest(b"")


def record(kind: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None = None, named: tuple[int, str] | None = None) -> bytes:
    """One WARC record; a revisit has headers only and names the page that it repeats.

    ``named`` is the payload's (length, digest) where it is known, so that a revisit needs no payload.
    """
    body = payload if kind == "response" else b""
    length, name = named or (len(payload), digest(payload))
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url), "WARC-Payload-Digest": f"sha1:{name}", "WARC-Block-Digest": f"sha1:{name if body else _EMPTY}", "X-Payload-Length": length,
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = len(body)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


class Tape:
    """A window on a random-access file."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.buf = f, size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from offset."""
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if offset < self.base or offset + n > self.base + len(self.buf):
            self.base, self.buf = offset, self.f.read_at(min(max(n, STEP), self.size - offset), offset)
        return self.buf[offset - self.base : offset - self.base + n]

    def some(self, offset: int, n: int) -> bytes:
        """Up to n bytes from offset, fewer where the window ends: what follows is read when it is asked for."""
        have = self.base + len(self.buf) - offset
        return self.at(offset, min(n, have) if offset >= self.base and have > 0 else n)

    def find(self, pattern: re.Pattern, start: int, upto: int | None = None) -> int:
        """Offset of the next match that begins in [start, upto), or upto (the end of the file)."""
        upto = self.size if upto is None else upto
        while start < upto:
            got = self.at(start, STEP)
            if m := pattern.search(got):
                return min(start + m.start(), upto)
            if start + len(got) >= self.size:
                break
            start += max(1, len(got) - 16)
        return upto


class Member(Tape):
    """A window that moves forward over the content of the gzip member at ``start``.

    ``end`` is the file's offset behind the member, or behind what could be inflated
    of it; then ``problem`` names the failed check.
    """

    def __init__(self, file: Tape, start: int):
        self.file, self.start, self.end, self.base, self.step = file, start, start, 0, STEP
        for self.step in (STEP, _SMALL):  # an error loses the output of a whole step, so a damaged member is read in small ones
            self.problem, self.size, held = "", 0, []
            for piece in self._inflated():
                self.size += len(piece)
                if self.size <= STEP:
                    held.append(piece)
            if not self.problem:
                break
        short = self.size <= STEP
        self.buf, self.rest = b"".join(held) if short else b"", iter(()) if short else self._inflated()

    def _inflated(self) -> Iterator[bytes]:
        z, at, n = zlib.decompressobj(31), self.start, min(_FIRST, self.step)
        while not z.eof:
            chunk, n = self.file.some(at, n), min(2 * n, self.step)  # most members are short, and what a chunk has behind them is copied
            if not chunk:
                self.problem = "truncated member"
                return
            spare, tail = z.copy() if self.step == _SMALL else None, chunk
            try:
                while tail and not z.eof:
                    yield z.decompress(tail, 0 if spare else STEP)
                    tail = z.unconsumed_tail
            except zlib.error as e:
                self.problem = str(e)
                if spare:
                    yield from self._bytewise(spare, at, chunk)
                return
            at += len(chunk) - len(z.unused_data)
            self.end = max(self.end, at)  # a second reading, for the content, does not go to the end

    def _bytewise(self, z, at: int, chunk: bytes) -> Iterator[bytes]:
        """What comes before the damage in the chunk."""
        for k in range(len(chunk)):
            try:
                yield z.decompress(chunk[k : k + 1])
            except zlib.error:
                return
            self.end = max(self.end, at + k + 1)

    def at(self, offset: int, n: int) -> bytes:
        parts, have = [self.buf], self.base + len(self.buf)
        while have < min(offset + n, self.size):
            parts.append(next(self.rest))
            have += len(parts[-1])
        if len(parts) > 1:
            self.buf = b"".join(parts)
            drop = min(offset - self.base, len(self.buf))
            self.base, self.buf = self.base + drop, self.buf[drop:]
        return self.buf[offset - self.base : offset - self.base + n]


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, bytes used) of the record at the start of data; ValueError names the failed check."""
    if not VERSION.match(data):
        raise ValueError("version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("headers")
    head = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("header line")
        head[k.strip().lower()] = v.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("length")
    stop = end + 4 + int(head["content-length"])
    block = data[end + 4 : stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest(block):
        raise ValueError("digest")
    return head, block, stop + 4


_GZIP = re.compile(re.escape(MAGIC))
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:\s*(\d+)\r\n")


def record_at(tape: Tape, i: int) -> tuple[dict[str, str], bytes, int]:
    """``parse`` of the record at i, of as many bytes as it says it has."""
    n = _FIRST
    while True:
        data = tape.at(i, n)
        try:
            return parse(data)
        except ValueError as e:
            end = data.find(b"\r\n\r\n")
            said = _LENGTH.search(data[: end + 2]) if end >= 0 else None
            most = end + 8 + int(said[1]) if said else STEP
            if str(e) not in ("headers", "record end") or not n < most <= max(tape.size - i, STEP) or len(data) < n:
                raise
            n = most


def content(m: Member) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, failed check) of a member, in offsets of its content."""
    i, lost, reason = 0, None, ""
    while i < m.size:
        try:
            head, block, used = record_at(m, i)
            if m.problem and not head.get("warc-block-digest", "").startswith("sha1:"):
                raise ValueError(m.problem)
        except ValueError as e:
            if lost is None:
                lost, reason = i, str(e)
            i = m.find(VERSION, i + 1)
            continue
        if lost is not None:
            yield "gap", lost, i, reason
            lost = None
        yield "record", i, i + used, head, block
        i += used
    if lost is not None:
        yield "gap", lost, m.size, reason


def salvage(f, size: int) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, failed check, place) in file order.

    A member's records have the member's place in the file. ``place`` is None, or
    the gap's (start, end) in the content of a member that holds records too.
    """
    tape, i = Tape(f, size), 0
    lost, reason = None, ""  # start of the gap that is open, and why

    def gap(until: int) -> Iterator[tuple]:
        nonlocal lost
        if lost is not None and lost < until:
            yield "gap", lost, until, reason, None
        lost = None

    while i < size:
        after = i + 1  # a version line is sought from here
        try:
            if tape.at(i, 3) == MAGIC:
                m, some, early = Member(tape, i), False, []
                after = max(after, m.end)
                for what, a, z, *rest in content(m):
                    if what == "record" and not some:
                        some = True
                        yield from gap(i)
                        yield from early
                    if what == "record":
                        yield "record", i, m.end, *rest
                    else:
                        early = [("gap", i, m.end, *rest, (a, z))]
                        if some:
                            yield from early
                if m.problem or not some:
                    raise ValueError(m.problem or "no record in the member")
                i = m.end
            else:
                head, block, used = record_at(tape, i)
                yield from gap(i)
                yield "record", i, i + used, head, block
                i += used
        except ValueError as e:
            if lost is None:
                lost, reason = i, str(e)
            i = tape.find(VERSION, after, tape.find(_GZIP, i + 1))
    yield from gap(size)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Manifest (path, records) of the archives of rows (page_id, url, html, record_type, refers_to)."""

    def task(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        ctx, n, out, path, count, size = TaskContext.get(), 0, None, "", 0, 0
        manifest = pa.schema([("path", pa.string()), ("records", pa.int64())])

        def shut():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count]}, schema=manifest)

        for b in batches:
            for page, url, payload, kind, refers, length, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, count, size, n = f"{root}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{n}.warc.gz", 0, 0, n + 1
                    out = fs.open_output_stream(path, compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(kind, page, url or "", payload or b"", refers, (length, base64.b32encode(bytes.fromhex(sha)).decode()))
                data = z.compress(data) + z.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    yield shut()
                    out = None
        if out is not None:
            yield shut()

    payload = F.coalesce("html", F.lit("")).cast("binary")
    body = F.when(F.col("record_type") == "response", payload)  # a revisit's stays where it is
    return rows.select("page_id", "url", body.alias("payload"), "record_type", "refers_to", F.octet_length(payload).alias("length"), F.sha1(payload).alias("sha")).mapInArrow(task, "path string, records long")


_READ = "path string, start long, stop long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string, gap_start long, gap_stop long"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for every record; gaps have a ``problem`` and no record_type.

    gap_start and gap_stop are offsets in the content of a member, null outside members.
    """
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _READ.split(", ")])

    def number(x: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", x)
        return int(m[1]) if m else None

    def task(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with fs.open_input_file(path) as f:
                    for what, start, end, head, *block in salvage(f, f.size()):
                        if what == "gap":
                            rows.append((path, start, end, None, None, None, None, None, head, *(block[0] or (None, None))))
                            continue
                        kind = head.get("warc-type", "")
                        payload = block[0]
                        full = kind != "revisit"
                        rows.append((path, start, end, number(head.get("warc-record-id", "")), len(payload) if full else int(head.get("x-payload-length", 0)), digest(payload) if full else head.get("warc-payload-digest", "")[5:], kind, number(head.get("warc-refers-to", "")), None, None, None))
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return manifest.select("path").mapInArrow(task, _READ)


def with_types(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """record_type and refers_to: of equal payloads the largest page_id is the response.

    Rows go by their payload's digest; those of a payload that COMMON rows or more have
    are told by a broadcast of such payloads (at most one for COMMON rows) and spread.
    """
    rows = pages.select("page_id", "url", "html").withColumn("_k", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    least = F.lit(-(1 << 63))
    twice = scratch.keep(rows.groupBy("_k").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "twice")
    common = twice.filter(F.col("_n") >= COMMON).select(F.col("_k").alias("_c"), F.col("_first").alias("_common"))
    seldom = twice.filter(F.col("_n") < COMMON).select(F.col("_k").alias("_s"), F.col("_first").alias("_seldom"))
    out = rows.join(F.broadcast(common), F.col("_k") == F.col("_c"), "left")
    out = out.withColumn("_at", F.when(F.col("_c").isNull(), F.col("_k")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))  # such a name is no digest
    out = out.join(seldom.hint("shuffle_hash"), F.col("_at") == F.col("_s"), "left").withColumn("_first", F.coalesce("_common", "_seldom"))
    again = F.coalesce("page_id", least) < F.coalesce("_first", least)
    return out.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def op7(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    scratch = Scratch(spark)
    folder = f"{scratch.root}/warc"
    manifest = scratch.keep(write_archives(with_types(pages, scratch), folder), "manifest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read_archives(manifest.repartition(n), folder).filter("problem is null")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
