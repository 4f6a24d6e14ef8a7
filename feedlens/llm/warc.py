"""WARC archives: a writer that stores repeated payloads once, and a reader that salvages damaged archives.

The writer builds whole records with DataFrame functions, compresses each as a gzip member and lets Spark's
text sink store the bytes, so any file system that Spark writes can hold them and its commit protocol covers
lost executors. The sink's line separator is an empty gzip member. The reader takes plain archives and
archives of gzip members.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.llm.shared import short_batches

#: A payload of fewer bytes is always stored in full.
REVISIT_BYTES = 1000
_END = "\r\n\r\n"
#: A gzip member without content.
EMPTY_MEMBER = b"\x1f\x8b\x08\0\0\0\0\0\0\x03\x03\0\0\0\0\0\0\0\0\0"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORD = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("bytes", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def plan_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages as (page_id, url, payload, payload_bytes, payload_digest, refers_to).

    Of records with equal payloads of `least` bytes and more, that with the largest page_id is stored and
    the others refer to it. Payloads are equal whose length, SHA-1 and SHA-256 are; only those that occur twice
    are joined.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    rows = rows.withColumn("_content", F.when(F.col("payload_bytes") >= least, F.unhex(F.sha2("payload", 256))))
    large = rows.where(F.col("payload_bytes") >= least)
    stored = large.groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.col("_content").alias("_same")).agg(F.max("page_id").alias("_stored"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    both = rows.join(stored, (rows["payload_digest"] == stored["_digest"]) & (rows["payload_bytes"] == stored["_bytes"]) & (rows["_content"] == stored["_same"]), "left")
    refers = F.when(F.col("page_id") < F.col("_stored"), F.col("_stored")).when(F.col("page_id").isNull() & F.col("_stored").isNotNull(), F.col("_stored"))
    return both.withColumn("refers_to", refers).drop("_digest", "_bytes", "_same", "_content", "_stored")


def _header(name: str, value) -> F.Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_text(rows: DataFrame) -> DataFrame:
    """One column `record`: each row as the bytes of a WARC record."""
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    body = F.when(revisit, F.lit(_HTTP).cast("binary")).otherwise(F.concat(F.lit(_HTTP).cast("binary"), F.col("payload")))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _header("WARC-Record-ID", name("page_id")),
        _header("WARC-Target-URI", uri), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("X-Payload-Length", F.col("payload_bytes").cast("string")), _header("WARC-Refers-To", F.when(revisit, name("refers_to"))),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("body"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", F.octet_length("body").cast("string")), F.lit("\r\n"),
    )
    return rows.withColumn("body", body).select(F.concat(head.cast("binary"), F.col("body"), F.lit(_END).cast("binary")).alias("record"))


def _members(batches):
    import pyarrow as pa

    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.column(0).slice(a, 512)
            packed = []
            for record in part:
                engine = zlib.compressobj(4, zlib.DEFLATED, 31)
                packed.append(engine.compress(record.as_py()) + engine.flush())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES, records_per_file: int = 20_000) -> None:
    """Write one record per row of pages to archives of gzip members under `path`.

    Null html is an empty payload, a null url leaves the target out, a null page_id is named null. Repeated
    rows are stored as often as they occur. An empty table writes no record; other columns are ignored.
    """
    short_batches(pages.sparkSession)
    members = record_text(plan_revisits(pages, least)).mapInArrow(_members, "member binary")
    sink = members.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    sink.option("maxRecordsPerFile", records_per_file).text(path)


# ---------------------------------------------------------------- reading

_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_VERSION_LINE = re.compile(rb"\nWARC/1\.[01]\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_MEMBER = b"\x1f\x8b\x08"
#: Bytes that are read at a time, and most that one step inflates to.
_STEP, _GROWTH = 1 << 14, 1 << 17
#: Bytes of a record's header, and of what a gzip member has before its content, at most.
HEADER, MEMBER_HEAD = 1 << 16, 1 << 10
#: Bytes of a member's records that a task holds; a member that goes on after them is quarantined.
MOST = 1 << 28
#: Bytes that attempts may read in vain, as a multiple of the archive's size; what is left after that is a gap.
VAIN = 64


def _head(data, at: int, end: int, limit: int | None = None) -> tuple[int, int] | str:
    """Where the header lines of the record at `at` begin and where they end; no other version line lies before limit."""
    if not (version := _VERSION.match(data, at, end)):
        return "no version line"
    blank = _HEAD_END.search(data, version.end() - 1, min(end, at + HEADER, end if limit is None else limit + 2))
    return (version.end(), blank.start()) if blank else "unterminated header"


def _fields(data, head: tuple[int, int]) -> dict[str, str] | str:
    """The header lines by name, with a content length."""
    fields = {}
    for line in bytes(data[head[0] : head[1]]).splitlines():
        key, colon, value = line.partition(b":")
        if line and not colon:
            return "malformed header line"
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    return fields if size.isascii() and size.isdigit() and len(size) < 19 else "no content length"


def _declared(data, at: int, end: int, limit: int | None = None) -> int:
    """Bytes of the record at a place by its header, 0 without a sound one."""
    head = _head(data, at, end, limit)
    fields = _fields(data, head) if not isinstance(head, str) else head
    return 0 if isinstance(fields, str) else head[1] - at + int(fields["content-length"]) + 8


def _parse(data, at: int, end: int, limit: int | None = None) -> tuple[dict, int] | str:
    """The record at `at` as (fields, its end), or why there is none."""
    head = _head(data, at, end, limit)
    if isinstance(head, str):
        return head
    fields = _fields(data, head)
    if isinstance(fields, str):
        return fields
    first = _HEAD_END.match(data, head[1]).end()
    last = first + int(fields["content-length"])
    if last > end:
        return "truncated block"
    close = _HEAD_END.match(data, last, end)
    if not close:
        return "no end of record"
    block = bytes(data[first:last])
    if (want := _sha1(fields.get("warc-block-digest", ""))) and hashlib.sha1(block).hexdigest() != want:
        return "block digest differs"
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    revisit = fields.get("warc-type") == "revisit"
    want = _sha1(fields.get("warc-payload-digest", ""))
    got = want if revisit else hashlib.sha1(payload).hexdigest()
    if want and got != want:
        return "payload digest differs"
    declared = fields.get("x-payload-length", "")
    n = int(declared) if revisit and declared.isdigit() else len(payload)
    row = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": got, "payload_bytes": n, "payload": payload, "checked": bool(_sha1(fields.get("warc-block-digest", "")))}
    return row, close.end()


def _sha1(digest: str) -> str | None:
    """A SHA-1 digest field, in hex or in base32, as lower-case hex; None for other algorithms and for none."""
    kind, _, value = digest.rpartition(":")
    if kind.lower() not in ("", "sha1"):
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    if re.fullmatch(r"[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return value if kind else None  # a damaged digest differs from any


class _Member:
    """The gzip member at a place, inflated no further than its records ask for."""

    def __init__(self, data: bytes, at: int):
        self.view, self.start, self.at, self.engine = memoryview(data), at, at, zlib.decompressobj(31)
        self.content, self.wrong, self.inflated = bytearray(), "", 0

    @property
    def ended(self) -> bool:
        return bool(self.engine.eof or self.wrong)

    @property
    def end(self) -> int:
        return self.at - len(self.engine.unused_data)

    def reach(self, size: int) -> None:
        """Inflate until there are `size` bytes of content, or no more of them."""
        while len(self.content) < size and not self.ended:
            given = self.engine.unconsumed_tail
            if not given and self.at < len(self.view):
                given = self.view[self.at : self.at + _STEP]
                self.at += len(given)
            try:
                more = self.engine.decompress(given, _GROWTH)
            except zlib.error as e:
                self.wrong = f"bad member: {str(e)[:60]}"
                return
            self.content += more
            self.inflated += len(more)
            if not more and not self.engine.eof and self.at >= len(self.view) and not self.engine.unconsumed_tail:
                self.wrong = "truncated member"
            elif not self.inflated and self.at - self.start > MEMBER_HEAD + _STEP:
                self.wrong = "bad member: no content"

    def records(self, most: int = MOST) -> tuple[list[dict], str]:
        """The whole records that the content opens with, and why they end before it does."""
        rows, held = [], 0
        while True:
            self.reach(1)
            if not self.content and self.ended:
                return rows, self.wrong
            self.reach(64)
            if _VERSION.match(self.content):
                self.reach(HEADER)
            size = _declared(self.content, 0, len(self.content))
            if held + size > most:
                return rows, f"records of more than {most} bytes"
            self.reach(size)
            found = _parse(self.content, 0, len(self.content))
            if isinstance(found, str):
                return rows, self.wrong or found
            rows.append(found[0])
            held += len(found[0]["payload"])
            del self.content[: found[1]]


def _member_head(data: bytes, at: int) -> bool:
    """Whether a gzip member's head at this place is one that writers of archives make: no reserved flags, and soon over."""
    if at + 10 > len(data) or data[at + 3] & 0xE0:
        return False
    flags, place = data[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for flag in (8, 16):  # name and comment, each up to a zero byte
        if flags & flag:
            place = data.find(b"\0", place, at + MEMBER_HEAD) + 1
            if not place:
                return False
    return place <= at + MEMBER_HEAD


class _Next:
    """The next place of a pattern from a growing position on, so that the bytes are searched once."""

    def __init__(self, find):
        self.find, self.at = find, -1

    def after(self, at: int) -> int | None:
        if self.at is not None and self.at <= at:
            self.at = self.find(at + 1)
        return self.at


def salvage(data: bytes, most: int = MOST) -> Iterator[dict]:
    """Records of one archive, and a row of status `gap` for every byte range that no record covers.

    Where a check fails, the next version line or gzip member that opens a valid record is searched for; the
    bytes in between become one gap with the reason of the first failure. A member may hold several records:
    the first one has the member's bytes, the others none. Records that inflate whole before the break of a
    torn member and fit their block digest have its offset and no bytes; the member itself is part of a gap.

    A member is inflated only as far as its records ask for. One whose records exceed `most` bytes counts as torn
    there, a header has HEADER bytes at most, and a gzip head MEMBER_HEAD. Time is linear in the archive, whatever the
    damage: once attempts have read VAIN times its size in vain, what is left is one gap.
    """
    at, end, gap, why, vain = 0, len(data), None, "", 0
    places = (_Next(lambda i: x.start() if (x := _VERSION.search(data, i)) else None), _Next(lambda i: x if (x := data.find(_MEMBER, i)) >= 0 else None))
    lines = _Next(lambda i: x.start() if (x := _VERSION_LINE.search(data, i)) else None)

    def quarantined(upto: int) -> Iterator[dict]:
        if gap is not None and upto > gap:
            yield {"offset": gap, "bytes": upto - gap, "status": "gap", "reason": why}

    while at < end:
        rows, upto, wrong, cost = [], at, "", 0
        if data[at : at + 3] == _MEMBER:
            member = _Member(data, at) if _member_head(data, at) else None
            rows, wrong = member.records(most) if member else ([], "bad member: no head")
            cost = member.inflated + member.at - at if member else 0
            if not rows and not wrong:  # padding
                yield from quarantined(at)
                gap, at = None, member.end
                continue
            if wrong:  # the member's own checksum is not reached
                rows = [r for r in rows if r["checked"]]
            else:
                upto = member.end
        else:
            found = _parse(data, at, end, lines.after(at))
            if isinstance(found, str):
                wrong = found
                cost = _declared(data, at, end, lines.after(at)) if wrong.endswith("digest differs") else 0
            else:
                rows, upto = [found[0]], found[1]
        if wrong:
            vain += cost
            if rows:  # a gap ends before the records that were found in it
                yield from quarantined(at)
                gap = None
                yield from ({"offset": at, "bytes": 0, "status": "ok", "reason": None} | row for row in rows)
            if gap is None:
                gap, why = at, wrong
            at = min((x for x in (p.after(at) for p in places) if x is not None), default=end)
            if vain > VAIN * end + MOST:
                at = end
            continue
        yield from quarantined(at)
        gap = None
        for k, row in enumerate(rows):
            yield {"offset": at, "bytes": 0 if k else upto - at, "status": "ok", "reason": None} | row
        at = upto
    yield from quarantined(end)


def _archives(batches):
    import pyarrow as pa

    names = RECORD.fieldNames()
    schema = pa.schema([(n, {"archive": pa.string(), "payload": pa.binary()}.get(n) or (pa.int64() if n in ("offset", "bytes", "payload_bytes") else pa.string())) for n in names])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows, held = [], 0
            for row in salvage(content.as_py()):
                rows.append(row | {"archive": path.as_py()})
                held += len(row.get("payload") or b"")
                if held > 8 << 20 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the archives under `path`, as RECORD.

    status is ok or gap; a gap carries its offset, bytes and reason. An archive is read by one task, so
    archives should be some hundred MB at most, as `write` makes them. Empty archives give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").where("length(content) > 0")
    return files.mapInArrow(_archives, RECORD)


def gaps(records: DataFrame) -> DataFrame:
    """The log of what read() could not cover: archive, offset, bytes, reason."""
    return records.where("status = 'gap'").select("archive", "offset", "bytes", "reason")
