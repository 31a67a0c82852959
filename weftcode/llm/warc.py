"""WARC archives: a writer on Spark's file output and a reader that salvages.

Writing. Each record is its own gzip member (as .warc.gz wants it). A member ends with
the length of its content, whose last byte is zero below 16 MB; that byte is the line
separator of Spark's text output, which therefore writes archives to any file
system that Spark knows. (A longer record gets an empty member after it, which ends
in zeros too.) Payloads are compared by SHA-1, in an aggregation that combines on
the map side; of equal ones the smallest id is the response, the others revisit it.

Reading. A record must have a version line, a length that fits, its end mark
and digests that agree; a member must decompress and its checksum agree. If not, the reader looks for the next
gzip member or version line from which a record can be read, goes on there and logs the
bytes between as a gap. It does the same inside a member's content, and of a member that is cut off or damaged
it keeps the records before that (of a damaged one, those whose digests agree). It reads compressed and plain archives.
Archives are read as they lie, line by line, one task a file: a worker holds a record (or member) and as much again, not the archive.

Defined results: a null payload is empty. A null URL is written as the record's own
name. Rows that repeat an id: with equal payloads each is a response (or each a
revisit), with different ones they are separate records. A null id is never what others
revisit if there is another; its record has a name from its digest and page_id null. An
empty table makes archives without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, load
from .packing import few

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 1000
MIN_REVISIT_BYTES = 0
NAME = re.compile(r"<urn:x-page:(-?\d+)>")


def digest(data: bytes) -> str:
    """Base32 SHA-1, upper case, without a label."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:sha1:{payload_digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record with its end mark."""
    found = digest(payload)
    name = name_of(page_id, found)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name.strip("<>")
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{found}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if revisit:
        lines.append(("WARC-Profile", PROFILE))
        if refers_to is not None:
            lines.append(("WARC-Refers-To", name_of(refers_to, found)))
    lines.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of the data, followed by an empty one if it would not end in a zero."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + member(b"")


@dataclass
class Record:
    start: int
    end: int
    headers: dict
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(ValueError):
    pass


class Short(Damaged):
    """What more bytes might mend."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the plain record at this place."""
    line = data.find(b"\r\n", at, at + 32)
    if not re.fullmatch(rb"WARC/\d\.\d", data[at : max(line, at)]):
        raise (Short if line < 0 and len(data) - at < 32 else Damaged)("no version line")
    stop = data.find(b"\r\n\r\n", line)
    if stop < 0:
        raise Short("headers do not end")
    headers: dict[str, str] = {}
    for x in data[line + 2 : stop].decode("utf-8", "replace").split("\r\n"):
        k, colon, v = x.partition(":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[k.strip().lower()] = v.strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no length")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise (Short if end + 4 > len(data) else Damaged)("the block does not end where its length says")
    block = data[begin:end]
    check(headers, "warc-block-digest", block)
    if headers.get("warc-type") == "response" and headers.get("content-type", "").startswith("application/http"):
        check(headers, "warc-payload-digest", block.partition(b"\r\n\r\n")[2])
    return headers, block, end + 4


def check(headers: dict, name: str, data: bytes) -> None:
    label, _, value = headers.get(name, "").partition(":")
    if label.lower() == "sha1" and value.upper() != digest(data):
        raise Damaged(f"{name} differs")


CUT = "the member is cut off"


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content, end and problem of the gzip member at this place; if it has a problem, what comes before that."""
    d, out, pos = zlib.decompressobj(31), [], at
    view = memoryview(data)
    while not d.eof:
        part = view[pos : pos + (1 << 16)]
        if not part:
            return b"".join(out), pos, CUT
        try:
            out.append(d.decompress(part))
        except zlib.error as x:
            return b"".join(prefix(view[at:], pos - at)), pos, f"the member is damaged ({x})"
        pos += len(part)
    return b"".join(out), pos - len(d.unused_data), ""


def prefix(view: memoryview, good: int):
    """What a damaged member gives up to its damage, which lies after so many bytes that can be read."""
    d = zlib.decompressobj(31)
    yield from (d.decompress(view[k : min(k + (1 << 16), good)]) for k in range(0, good, 1 << 16))
    for k in range(good, len(view)):
        try:
            yield d.decompress(view[k : k + 1])
        except zlib.error:
            return


STARTS = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
VERSIONS = re.compile(rb"WARC/\d\.\d\r\n")


def records_at(data: bytes, at: int, plain: bool, done: bool) -> tuple[list[Record | Gap], int, str]:
    """What begins here, its end and its problem: a plain record, or what a member holds (an empty one: nothing).

    Records of a member, and gaps between them, have the member's place in the file. Of a
    damaged member only those records count that have a block digest, which agrees. plain: members are not looked
    into. Without done there may be more data.
    """
    if plain or data[at : at + 3] != b"\x1f\x8b\x08":
        headers, block, end = parse_record(data, at)
        return [Record(at, end, headers, block)], end, ""
    content, end, problem = inflate(data, at)
    if problem == CUT and not done:
        raise Short(problem)
    found = list(salvage(content, plain=True))
    if problem:
        found = [x for x in found if isinstance(x, Record) and (problem == CUT or "warc-block-digest" in x.headers)]
        if not found:
            raise Damaged(problem)
    out: list[Record | Gap] = []
    for x in found:
        if isinstance(x, Record):
            out.append(Record(at, end, x.headers, x.block))
        else:
            out.append(Gap(at, end, f"{x.reason} (bytes {x.start} to {x.end} of the member's content)"))
    return out, end, problem


#: Bytes that are read on at least.
PIECE = 1 << 20


def salvage(source, plain: bool = False):
    """Yield each Record that can be read and a Gap for each stretch of bytes that can't; plain: no members are looked for.

    source is bytes, or pieces of them, of which no more are held than the largest record needs.
    """
    pieces = iter([source] if isinstance(source, (bytes, bytearray, memoryview)) else source)
    starts = VERSIONS if plain else STARTS
    data, base, at, done = b"", 0, 0, False
    gap: tuple[int, str] | None = None  # where bytes begin that can't be read, and why; the search goes on at at
    while not done:
        more = [data[at:]]
        base, at, size, want = base + at, 0, 0, max(PIECE, len(data) - at)
        done = True
        for piece in pieces:
            more.append(piece)
            size += len(piece)
            if size >= want:
                done = False
                break
        data = b"".join(more)
        try:
            while at < len(data):
                if gap is None:
                    try:
                        found, end, reason = records_at(data, at, plain, done)
                        yield from (replace(x, start=base + x.start, end=base + x.end) for x in found)
                        if not reason:
                            at = end
                            continue
                    except Damaged as x:
                        if isinstance(x, Short) and not done:
                            raise
                        reason = str(x)
                    gap, at = (base + at, reason), at + 1
                for m in starts.finditer(data, at):
                    at = m.start()
                    try:
                        good = any(isinstance(x, Record) for x in records_at(data, at, plain, done)[0])
                    except Damaged as x:
                        if isinstance(x, Short) and not done:
                            raise
                        good = False
                    if good:
                        yield Gap(gap[0], base + at, gap[1])
                        gap = None
                        break
                    at += 1
                else:
                    if not done:
                        at = max(at, len(data) - 16)  # the first bytes of a start may be there
                        break
                    at = len(data)
        except Short:
            pass  # read on
    if gap is not None:
        yield Gap(gap[0], base + len(data), gap[1])


def with_verdicts(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, refers_to, revisit)"""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    seen = rows.filter(F.octet_length("payload") >= min_bytes).select("id", F.unhex(F.sha1("payload")).alias("sha"))
    first = seen.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    first = Workspace(pages.sparkSession).table(first, "repeated")  # so that the planner may split the join where a payload is hot
    again = seen.join(first, "sha").filter("first is not null and (id is null or id <> first)")
    again = again.select(F.col("id").alias("i"), F.col("sha").alias("s"), F.col("first").alias("refers_to")).distinct()
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    out = keyed.join(again, keyed.id.eqNullSafe(again.i) & (keyed.sha == again.s), "left")
    return out.select("id", "url", "payload", "refers_to", F.col("s").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, where: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> None:
    """One record per row, as compressed archives in a folder."""

    def kernel(batches):
        for b in few(batches):
            out = [member(record(*x[:4], revisit=x[4], date=date))[:-1] for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])

    rows = with_verdicts(pages, id_col, url_col, html_col, min_bytes)
    members = rows.mapInArrow(kernel, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(where)


RECORDS = "file string, start long, end long, problem string, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, where: str, with_payload: bool = False) -> DataFrame:
    """One row per record and one per gap; a gap has a problem and no record_type."""
    schema = RECORDS + ", payload binary" * with_payload

    def page(name: str) -> int | None:
        m = NAME.fullmatch(name)
        return int(m[1]) if m else None

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (path, x.start, x.end, x.reason) + (None,) * (6 + with_payload)
        h, kind, payload = x.headers, x.headers.get("warc-type"), x.payload
        if kind == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", x.block)
            size, payload = int(length[1]) if length else None, None
            found = h.get("warc-payload-digest", "").partition(":")[2] or None
        else:
            size, found = len(payload), digest(payload)
        refers = page(h["warc-refers-to"]) if "warc-refers-to" in h else None
        return (path, x.start, x.end, None, page(h.get("warc-record-id", "")), kind, h.get("warc-target-uri"), size, found, refers) + (payload,) * with_payload

    def kernel(batches):
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        names = [x.split()[0] for x in schema.split(", ")]

        def batch(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        lines = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        for (path, size), mine in groupby(lines, key=lambda r: r[:2]):
            rows = []
            for x in salvage(joined_lines((r[2] for r in mine), size)):
                rows.append(row(path, x))
                if len(rows) == 256:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return raw_lines(spark, where).mapInArrow(kernel, schema)


def raw_lines(spark: SparkSession, where: str) -> DataFrame:
    """(path, size, line): the bytes of each file as they lie, cut at line feeds, in order and in one task a file.

    Hadoop's pass-through codec, set for the names' last part, keeps a file whole and its bytes as they are, also
    where the name says that it is compressed. A name without a dot has no such part: that file is one line.
    """
    files = spark.read.format("binaryFile").load(where)
    end = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    kinds = [r[0] for r in files.select(end.alias("end")).distinct().collect()]  # a few ends of names
    codec, parts = spark._jvm.org.apache.hadoop.io.compress, []
    for kind in kinds:
        mine = files.filter(end == kind)
        if not kind:
            parts.append(mine.select("path", F.col("length").alias("size"), F.col("content").alias("line")))
            continue
        places = where if len(kinds) == 1 else [r[0] for r in mine.select("path").collect()]
        options = {"lineSep": "\n", "io.compression.codecs": codec.PassthroughCodec.CLASSNAME, codec.PassthroughCodec.OPT_EXTENSION: kind}
        text = spark.read.options(**options).text(places)
        parts.append(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string, size long, line binary")


def joined_lines(lines, size: int):
    """The bytes of a file of this size from its lines, in pieces; the last line may end in a line feed or not."""
    held, n, total = [], 0, -1
    for line in lines:
        held.append(line)
        n += len(line) + 1
        if n >= PIECE:
            yield (b"\n" if total >= 0 else b"") + b"\n".join(held)
            total, held, n = total + n, [], 0
    if held:
        yield (b"\n" if total >= 0 else b"") + b"\n".join(held)
        total += n
    if total < size and size:
        yield b"\n"


def op8_warc(spark, sf_dir: str) -> DataFrame:
    where = Workspace(spark).path("archives")
    write_archives(load(spark, sf_dir, "pages"), where)
    # nothing is damaged that was written just now: a gap is an error, not a row less
    whole = F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "file", "problem")).cast("boolean"))
    found = read_archives(spark, where).filter(whole)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, ((k // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p
""",
}
