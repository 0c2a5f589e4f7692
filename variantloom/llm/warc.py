"""Operator 2: WARC writing, and a reader that salvages damaged archives.

Records are written as gzip members of their own through Spark's text writer, so
archives go to any store that Spark writes to: a row is a member without its last
byte, and the line separator supplies that byte, which is zero in every member
below 16 MB (its trailer ends with the size); longer ones are followed by an empty
member, which ends with a zero as well.

The reader takes whole archives, compressed or not, and checks every record: the
member's CRC, the version line, the header block, Content-Length, the payload's
digest and the end of the record. After a failed check it searches for the next
place where a valid record can begin, a gzip member's magic or a version line, and
goes on there; what lies between is quarantined as a gap with its bytes' range and
the reason. Inside a member the search is for the next version line, in what could be
inflated of it. Members are inflated and parsed piece by piece, so a worker holds an
archive's bytes, one record and one batch of results.

Defined cases: a null payload is the empty payload; equal and null ids are written
one by one; an empty table makes no archives and reads as no records; payloads may
hold any bytes, version lines included (they are passed over by Content-Length), and
be as long as a row can be; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small, table

VERSION = b"WARC/1.1\r\n"
#: Payloads shorter than this are written whole even if an earlier record holds the same bytes.
MIN_REVISIT = 1000
#: Bytes of payload in an archive, at most about; small inputs make as many archives as shuffles have parts.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
_MAGIC = re.compile(rb"\x1f\x8b\x08")
_BLANK = re.compile(rb"\r\n\r\n")
#: Why parse() fails where the record may go on behind the data that there is.
SHORT = "record is cut off"
#: Inflated bytes that are taken at a time, at most; bytes that a version line may need.
_PIECE, _LINE = 1 << 20, 16
#: Bytes of members, payloads or gaps in one batch that a worker gives back, about.
BATCH_BYTES = 4 << 20
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes
    compressed: bool

    @property
    def payload(self) -> bytes:
        """The block without its HTTP header, if it has one."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """The record of a page: a response, or a revisit that names the record with the same payload and holds none itself."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1_label(payload)), ("WARC-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return encode([*head, ("WARC-Block-Digest", sha1_label(http))], http)
    block = http + payload
    return encode([*head, ("WARC-Block-Digest", sha1_label(block))], block)


def parse(data, at: int, compressed: bool) -> tuple[Record | None, int, str]:
    """(record, end, "") of the record at a place of any bytes-like object, or (None, at, reason)."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        return None, at, "no version line"
    blank = _BLANK.search(data, line.end() - 2)
    if not blank:
        return None, at, "header block does not end"
    stop = blank.start()
    headers: dict[str, str] = {}
    last = ""
    for raw in bytes(data[line.end() : stop]).split(b"\r\n"):
        text = raw.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            headers[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            return None, at, "bad header line"
        last = name.lower()
        headers.setdefault(last, value.strip())
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers:
        return None, at, "no type or length"
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        return None, at, SHORT if end + 4 > len(data) else "record does not end where its length says"
    block = bytes(data[begin:end])
    record = Record(at, end + 4, headers, block, compressed)
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want != sha1_label(block):
        return None, at, "block digest differs"
    want = headers.get("warc-payload-digest", "")
    if want.startswith("sha1:") and headers["warc-type"] != "revisit" and want != sha1_label(record.payload):
        return None, at, "payload digest differs"
    return record, end + 4, ""


class Member:
    """The records of the gzip member at a place, inflated and parsed piece by piece.

    Iterating gives the valid records; then ``end`` is where the member ends (or could no longer be inflated), ``reason``
    says why it is not sound, if so, and ``inner`` why some of its content is no record. What was parsed is let go, so
    the content that is held at once is that of one record. Of a member that is not sound, records count whose own
    digests are right (of one that is only cut off, all whole ones), but not one that is all there is in it.
    """

    def __init__(self, data, at: int):
        self.data, self.at, self.end, self.reason, self.inner = data, at, at, "", ""
        self.size = self.found = 0

    def _pieces(self) -> Iterator[bytes]:
        z, pos, window, n = zlib.decompressobj(31), self.at, 1 << 13, len(self.data)
        while not z.eof and pos < n:
            kept, took = z.copy(), min(window, n - pos)
            try:
                piece = z.decompress(self.data[pos : pos + took], _PIECE)
            except zlib.error as e:
                # The bytes before the failure, in ever smaller steps from the state before this window.
                z, step = kept, took >> 1
                while step and pos < n:
                    kept = z.copy()
                    try:
                        piece = z.decompress(self.data[pos : pos + step])
                        pos += min(step, n - pos)
                    except zlib.error:
                        z, step, piece = kept, step >> 1, b""
                    yield piece
                self.end, self.reason = pos, f"member: {e}"
                return
            pos, window = pos + took - len(z.unconsumed_tail) - len(z.unused_data), min(window * 2, 1 << 18)
            yield piece
        self.end = pos
        if not z.eof:
            self.reason = "member is cut off"

    def __iter__(self) -> Iterator[Record]:
        buf, pieces, over, at, first, waiting = bytearray(), self._pieces(), False, 0, None, []
        need = 0
        while True:
            while len(buf) - at < max(need, 1) and not over:
                piece = next(pieces, None)
                over = piece is None
                if at > _PIECE or at == len(buf):
                    del buf[:at]
                    at = 0
                buf += piece or b""
                self.size += len(piece or b"")
            if at >= len(buf):
                break
            record, end, why = parse(buf, at, True)
            if record is None and not over and (why in (SHORT, "header block does not end") or len(buf) - at < _LINE):
                need = max(2 * (len(buf) - at), _LINE)
                continue
            need = 0
            if record is None:
                self.inner = self.inner or why
                line = _VERSION_LINE.search(buf, at + 1)
                at = line.start() if line else max(at + 1, len(buf) - (0 if over else _LINE))
                continue
            at, self.found = end, self.found + 1
            whole = end - record.offset
            if self.found == 1:
                first = (record, whole)
                continue
            if first:
                waiting, first = [first[0]], None
            waiting.append(record)
            yield from (r for r in waiting if _vouched(r))
            waiting = [r for r in waiting if not _vouched(r)]
        if first and not (self.reason and self.size == first[1]):
            waiting.append(first[0])
        if not self.reason.startswith("member:"):
            yield from waiting
        else:
            yield from (r for r in waiting if _vouched(r))


def _vouched(r: Record) -> bool:
    """Whether a digest of its own was checked for a record."""
    return r.headers.get("warc-block-digest", "").startswith("sha1:") or r.headers["warc-type"] != "revisit" and r.headers.get("warc-payload-digest", "").startswith("sha1:")


def _mark(r: Record) -> bytes:
    return hashlib.sha1(repr(sorted(r.headers.items())).encode() + r.block).digest()


def salvaged(data) -> Iterator[Record | tuple[int, int, str]]:
    """The records of an archive that pass every check, and the gaps (begin, end, reason) between them, as they are found.

    ``data`` is any bytes-like object; no copy is made of it, and no record is held after it was given out. The gap of a
    member that is not sound overlaps the records that were recovered from it.
    """
    data = memoryview(data)
    at, bad, why, line, n = 0, None, "", -1, len(data)
    # Marks of the records of the last broken member and where it failed: stored blocks show the same records as plain ones.
    broken, until = set(), 0
    while at < n:
        if _MAGIC.match(data, at):
            one, marks = Member(data, at), set()
            for r in one:
                if bad is not None:
                    yield bad, at, why
                    bad = None
                marks.add(_mark(r))
                r.offset, r.end = at, one.end
                yield r
            if not one.reason:
                if bad is not None:
                    yield bad, at, why
                    bad = None
                if one.inner:
                    yield at, one.end, one.inner
                at = one.end
                continue
            reason = one.reason
            if marks:
                broken, until = marks, one.end
        elif _VERSION_LINE.match(data, at):
            record, end, reason = parse(data, at, False)
            if record is not None and at < until and _mark(record) in broken:
                at = end
                continue
            if record is not None:
                if bad is not None:
                    yield bad, at, why
                    bad = None
                yield record
                at = end
                continue
        else:
            reason = "no member or version line"
        if bad is None:
            bad, why = at, reason
        # The next place where a member or a record can begin.
        if line <= at:
            found = _VERSION_LINE.search(data, at + 1)
            line = found.start() if found else n
        magic = _MAGIC.search(data, at + 1, line + 3)
        at = magic.start() if magic else line
    if bad is not None:
        yield bad, n, why


def salvage(data: bytes) -> Salvage:
    """salvaged() as two lists; a record of a member says the member's place."""
    out = Salvage()
    for x in salvaged(data):
        (out.records if isinstance(x, Record) else out.gaps).append(x)
    return out


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for page_id, url, payload, kind, ref in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
            m = member(page_record(page_id.as_py(), url.as_py(), payload.as_py(), kind.as_py(), ref.as_py()))
            out.append((m if m[-1] == 0 else m + _EMPTY)[:-1])
            held += len(m)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def _reader(with_payload: bool):
    return lambda batches: _read(batches, with_payload)


def _row(path: str, x: Record | tuple[int, int, str], data, with_payload: bool) -> tuple:
    if not isinstance(x, Record):
        a, b, why = x
        return (path, a, b, why, *[None] * 6, bytes(data[a:b]) if with_payload else None)
    h = x.headers
    kind, size, label = h["warc-type"], h.get("warc-payload-length", ""), h.get("warc-payload-digest", "")
    payload = None if kind == "revisit" else x.payload
    hexed = base64.b32decode(label[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", label) else hashlib.sha1(x.payload).hexdigest()
    return (path, x.offset, x.end, None, kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), hexed, int(size) if payload is None and size.isdecimal() else len(x.payload), payload if with_payload else None)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["archive", "start", "stop", "fault", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data, path, rows, held = memoryview(content.as_buffer()), path.as_py(), [], 0
            for x in salvaged(data):
                rows.append(_row(path, x, data, with_payload))
                held += 400 + len(rows[-1][-1] or b"")
                if held > BATCH_BYTES:
                    yield _batch(rows, names)
                    rows, held = [], 0
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages(page_id, url, html) as gzipped WARC archives under a path of any store Spark writes to.

    Of the pages with equal payloads of min_revisit bytes or more, that of the greatest id is a response and the others
    revisit it; where several rows have that id, all of them are responses.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload"))
    same = p.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("_rows"))
    same = materialize(same.where("_rows > 1 and first is not null").drop("_rows"), "warc-same")
    total = p.agg(F.sum("n")).first()[0] or 0
    p = p.join(small(same), ["digest", "n"], "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    p = p.select("page_id", "url", "payload", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    # Rows are dealt by id and digest, so a task that is run again writes the same archive.
    p = p.repartition(n, F.xxhash64("page_id", "payload"))
    members = p.mapInArrow(_written, "member binary").select(F.col("member").cast("string").alias("member"))
    members.write.option("lineSep", "\x00").text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under a path, and the gaps between them (rows with a fault; payload: the bytes skipped).

    Without payloads, records are checked all the same. An archive is one cell of a table (2 GB at most, as Spark reads
    whole files); beyond it a task holds one record's content and a batch of about BATCH_BYTES.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload), "archive string, start long, stop long, fault string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back, and tell what each record says."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    got = read_archives(spark, path, with_payload=False).where("fault is null")
    return got.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number(F.col("refers_to"))).alias("refers_to"))


#: DuckDB's version of what op2_warc must return.
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> top THEN top END AS refers_to FROM r"""
