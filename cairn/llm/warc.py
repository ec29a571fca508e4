"""WARC writing and a salvage reader.

Writer: one gzip member per record, one archive per task, moved into place when complete, so a repeated task replaces its
own file. Reader: streams an archive, checks each record (member, version line, lengths, block and payload digests) and
after a failed check looks for the next member or version line that does parse; the bytes in between are logged as a gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common

REVISIT_MIN = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 20
BROADCAST_GROUPS = 50_000  # groups of equal payloads whose responses are broadcast, some 10 MB; beyond that they are joined
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


# -- records
def record_id(page_id, row: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NS, f'{page_id}/{row}')}>"


def encode_record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {_clean(v)}".encode() for k, v in [*head, ("Content-Length", str(len(block)))]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(v: str) -> str:
    return v.replace("\r", " ").replace("\n", " ")


def page_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, refers_url, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url or "urn:none"),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Payload-Bytes", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is None:
        head.append(("X-No-Url", "1"))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Target-URI", refers_url or "urn:none"), ("X-Refers-To-Page", str(refers_to))]
    return encode_record(head, block)


class Damaged(Exception):
    """A record that fails a check."""


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of exactly one record, or Damaged."""
    if not _VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("no end of header")
    head: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise Damaged("header line without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no length") from None
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise Damaged("length differs")
    check(head, block)
    return head, block


def check(head: dict[str, str], block: bytes) -> None:
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and hashlib.sha1(block).hexdigest() != want[5:].lower():
        raise Damaged("block digest differs")
    want = head.get("warc-payload-digest", "")
    if want.startswith("sha1:") and head.get("warc-type") == "response" and hashlib.sha1(payload_of(block)).hexdigest() != want[5:].lower():
        raise Damaged("payload digest differs")


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


# -- salvage reader
class _Window:
    """A forward view of a stream: bytes from `at` on, read as needed. What was passed is dropped a read block at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.buf, self.pos, self.at, self.ended = stream, b"", 0, 0, False

    def need(self, n: int) -> bool:
        """Whether at least n bytes are there."""
        if len(self.buf) - self.pos < n and not self.ended:
            got = [self.buf[self.pos :]]
            have = len(got[0])
            while have < n:
                more = self.stream.read(max(_READ, n - have))
                if not more:
                    self.ended = True
                    break
                got.append(bytes(more))
                have += len(more)
            self.buf, self.pos = b"".join(got), 0
        return len(self.buf) - self.pos >= n

    def take(self, start: int, end: int) -> bytes:
        """Bytes start to end from here, as far as they were read."""
        return self.buf[self.pos + start : self.pos + end]

    def find(self, what: bytes, start: int = 0) -> int:
        k = self.buf.find(what, self.pos + start)
        return k - self.pos if k >= 0 else -1

    def left(self) -> int:
        return len(self.buf) - self.pos

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n


class _Inflated:
    """The gzip member at the window's start as a stream; used: its bytes read so far. A fault ends it and is kept."""

    def __init__(self, w: _Window) -> None:
        self.w, self.d, self.used, self.fault = w, zlib.decompressobj(31), 0, ""
        self.out, self.marks = 0, deque()  # bytes given out; those before each part that was read, and where it starts

    def done(self, out: int) -> None:
        """Move the window to the last part that starts within the first `out` bytes given out."""
        to = 0
        while self.marks and self.marks[0][0] <= out:
            to = self.marks.popleft()[1]
        if to:
            self.w.skip(to)
            self.used -= to
            self.marks = deque((o, u - to) for o, u in self.marks)

    def read(self, n: int) -> bytes:
        while not self.d.eof and not self.fault:
            part = self.d.unconsumed_tail
            if not part:
                if not self.w.need(self.used + 1):
                    self.fault = "member is cut off"
                    break
                part = self.w.take(self.used, self.used + (1 << 16))
                self.marks.append((self.out, self.used))
                self.used += len(part)
            try:
                out = self.d.decompress(part, n)
            except zlib.error as e:
                self.fault = f"gzip: {str(e)[:60]}"
                break
            if self.d.eof:
                self.used -= len(self.d.unused_data)
            if out:
                self.out += len(out)
                return out
        return b""


def _member(w: _Window) -> Iterator[tuple]:
    """Records and gaps of the gzip member at the window's start, which may hold any number of them; the window moves along.

    A record that ends the member counts once the member's own checksum holds. What goes wrong later raises Damaged, with
    the window near the last whole record's end and never past it, or at the end of the member if it is whole but holds no record.
    """
    at, z, found, lost = w.at, _Inflated(w), False, ""
    inner = _Window(z)
    while inner.need(1):
        try:
            data, used = _plain(inner)
            head, block = decode_record(data)
            if not inner.need(used + 1) and z.fault:
                raise Damaged(z.fault)
        except Damaged as e:
            lost = lost or str(e)
            _seek(inner)
            continue
        if lost:
            yield "gap", at, w.at + z.used, lost
            lost = ""
        yield "record", at, head, block
        found = True
        inner.skip(used)
        z.done(inner.at)
    if z.fault:
        raise Damaged(z.fault)
    if not found:
        w.skip(max(0, z.used - 1))
        raise Damaged(lost or "empty member")
    w.skip(z.used)
    if lost:
        yield "gap", at, w.at, lost


def _plain(w: _Window) -> tuple[bytes, int]:
    """The bytes of the uncompressed record at the window's start, or Damaged. Header lines may have any length."""
    w.need(16)
    if not _VERSION.match(w.take(0, 16)):
        raise Damaged("no version line")
    n, at = None, 10
    while True:
        end = w.find(b"\r\n", at)
        while end < 0:
            have = w.left()
            if not w.need(have + 1):
                raise Damaged("no end of header")
            end = w.find(b"\r\n", max(at, have - 1))
        line = w.take(at, end)
        at = end + 2
        if not line:
            break
        name, sep, value = line.partition(b":")
        if not sep:
            raise Damaged("header line without a colon")
        if name.strip().lower() == b"content-length":
            n = int(value) if value.strip().isdigit() else None
    if n is None:
        raise Damaged("no length")
    size = at + n + 4
    if not w.need(size):
        raise Damaged("record is cut off")
    return w.take(0, size), size


def read_records(stream) -> Iterator[tuple]:
    """("record", offset, headers, block) for each whole record, ("gap", start, end, reason) for each run of lost bytes.

    Works on gzip members of one record or many and on plain records, mixed too; records of one member have its offset.
    Memory: one record and one read block. An empty stream gives nothing; a stream without any record gives one gap.
    Repeated records are given each.
    """
    w = _Window(stream)
    lost_from, reason = None, ""
    while w.need(1):
        start, got = w.at, False
        try:
            if w.need(2) and w.take(0, 2) == b"\x1f\x8b":
                for event in _member(w):
                    if lost_from is not None:
                        yield "gap", lost_from, start, reason
                        lost_from = None
                    got = True
                    yield event
                continue
            data, used = _plain(w)
            head, block = decode_record(data)
        except Damaged as e:
            if lost_from is None:
                lost_from, reason = w.at if got else start, str(e)
            _seek(w)
            continue
        if lost_from is not None:
            yield "gap", lost_from, w.at, reason
            lost_from = None
        yield "record", w.at, head, block
        w.skip(used)
    if lost_from is not None:
        yield "gap", lost_from, w.at, reason


def _seek(w: _Window) -> None:
    """Move at least a byte on, to the next place where a member or a version line may start."""
    w.skip(1)
    while True:
        w.need(_READ)
        found = [k for k in (w.find(b"\x1f\x8b\x08"), w.find(b"WARC/1.")) if k >= 0]
        if found:
            w.skip(min(found))
            return
        if w.ended:
            w.skip(w.left())
            return
        w.skip(max(1, w.left() - 7))


# -- Spark
def with_revisits(pages: DataFrame, least: int = REVISIT_MIN) -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to, refers_url.

    Of rows with equal payloads of at least `least` bytes, those with the largest page_id are responses (all of them if
    rows repeat that id), the others revisits; null ids revisit the largest id of their group, if there is one.
    Groups of two or more are found from (digest, page_id, url) alone with partial sums. Up to BROADCAST_GROUPS of them go to
    all tasks and no payload is moved; more are joined by digest, rows of hot digests spread over salts.
    """
    p = pages.select("page_id", "url", common.utf8("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    keyed = p.withColumn("n", F.octet_length("payload"))
    groups = (
        keyed.filter(F.col("n") >= least).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("page_id", "url")).alias("top"))
        .filter("k > 1 and top.page_id is not null")
        .select("digest", "k", F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url"))
    )
    groups = common.cut(groups, "equal-payloads")
    if groups.count() <= BROADCAST_GROUPS:
        out = keyed.join(F.broadcast(groups.drop("k")), "digest", "left")
    else:
        hot = [r["digest"] for r in groups.orderBy(F.desc("k")).limit(1000).filter("k > 20000").select("digest").collect()]
        out = common.salted_join(keyed, groups.drop("k"), "digest", hot)
    revisit = F.col("top_id").isNotNull() & (F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("top_id"))
    return out.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("top_id")).alias("refers_to"), F.when(revisit, F.col("top_url")).alias("refers_url"),
    )


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write the pages' records below folder; returns path, records, bytes per archive (already written)."""
    common.ship(pages.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId()
        final = f"{folder}/part-{part:06d}.warc.gz"
        draft = f"{final}.{TaskContext.get().taskAttemptId()}.tmp"
        n = size = 0
        with common.fs_open(draft, "w") as f:
            for b in batches:
                for r in b.to_pylist():
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = z.compress(page_record(r["page_id"], r["url"], r["payload"], r["digest"], r["kind"], r["refers_to"], r["refers_url"], date)) + z.flush()
                    f.write(data)
                    n, size = n + 1, size + len(data)
        common.fs_move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return common.cut(with_revisits(pages).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


READ_SCHEMA = "path string, at long, gap_end long, reason string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record (reason null) and per quarantined gap (reason set) of the archives named in manifest.path.

    An archive is one task's work and is streamed. payloads: also return the payload bytes of responses.
    """

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                held = 0
                with common.fs_open(path, "r") as f:
                    for kind, at, x, y in read_records(f):
                        if kind == "gap":
                            rows.append((path, at, x, y) + (None,) * 7)
                        else:
                            rows.append((path, at, None, None, *_fields(x, y, payloads)))
                            held += len(rows[-1][-1] or b"") + 300
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 4 * common.parts(spark))).mapInArrow(run, READ_SCHEMA)


def _fields(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = head.get("warc-type")
    num = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
    payload = payload_of(block) if kind == "response" else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
    size = len(payload) if payload is not None else num("x-payload-bytes")
    url = None if "x-no-url" in head else head.get("warc-target-uri")
    return num("x-page-id"), url, kind, digest, size, num("x-refers-to-page"), payload if payloads else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
