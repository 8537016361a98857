"""WARC archives: writing with revisit records, and a salvage reader (operator 3).

Every record is a gzip member of its own, as the format asks, so damage to one leaves the others readable.  Members are made in Arrow
batches and written by Spark's text writer as they are, an empty member standing between two.  Equal payloads are found by SHA-256; the least page_id of a
digest is an aggregate, so a digest shared by a third of all pages is pre-aggregated and its join is split by AQE.  Files are bounded by records and bytes:
pages are written by size class, with fewer records a file the larger they are.

Reading takes archive files as bytes through Spark's binaryFile source and walks them record by record.  After a failed check (a damaged
gzip member, header, length or digest) the reader searches for the next valid member or version line, goes on there, and reports the
skipped bytes as a quarantined gap.  The round trip writes gaps, and revisits whose response is missing or differs, to a quarantine table and fails
if there are any: nothing is left out silently.

Null html is an empty payload; a null url has no target header; rows with a null page_id are written and come back with a null page_id.  Rows
that share page_id and payload are all responses where theirs is the least page_id.  An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ._store import cut, delete, drop, fresh_path

SEPARATOR = "\r\n\r\n"
LEAST_REVISIT_BYTES = 100
#: Files hold at most so many records of pages up to so many bytes: 256 MB in any class, but for single pages that are larger.
SIZE_CLASSES = ((1 << 17, 2000), (1 << 24, 16), (1 << 62, 1))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:paperloom:page:"


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response) of each page."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)}
    )
    small = pages.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = small.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = small.join(first, "payload_digest").filter("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    return pages.join(later, ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def _gzip(data: bytes = b"") -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


@F.arrow_udf(BinaryType())
def _member(records: pa.Array) -> pa.Array:
    return pa.array([_gzip(r.as_py().encode()) for r in records], pa.binary())


def write_archives(pages: DataFrame, path: str, compressed: bool = True) -> None:
    """Write one record per page into archive files in folders under path."""
    rows = with_revisits(pages)
    revisit = F.col("refers_to").isNotNull()
    ident = F.concat(F.lit(_ID), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), ident),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: "), digest),
        F.when(~revisit, F.concat(F.lit("WARC-Block-Digest: "), digest)),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: " + _ID), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    record = F.concat(head, F.lit(SEPARATOR), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string"))).alias("n")).first()["n"] or 0
    least = -1
    for n, (most, records_per_file) in enumerate(SIZE_CLASSES):
        own = rows.filter((F.col("payload_bytes") > least) & (F.col("payload_bytes") <= most))
        if compressed:
            own = own.select(_member(F.concat(record, F.lit(SEPARATOR))).cast("string").alias("value"))
            writer = own.write.option("encoding", "ISO-8859-1").option("lineSep", _gzip().decode("latin-1"))
        else:
            writer = own.select(record.alias("value")).write.option("lineSep", SEPARATOR)
        writer.option("maxRecordsPerFile", records_per_file).text(f"{path}/class-{n}")
        if largest <= most:
            break
        least = most


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The named fields of a record head at ``at`` and where its block starts, or None."""
    if not data.startswith(b"WARC/1.", at):
        return None
    following = data.find(b"\r\nWARC/1.", at)
    stop = data.find(b"\r\n\r\n", at, following + 4 if following >= 0 else len(data))
    if stop < 0:
        return None
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, stop + 4


def salvage_plain(data: bytes, base: int = 0) -> Iterator[tuple]:
    """("record", offset, fields, block) and ("gap", start, end, reason) of uncompressed archive bytes."""
    at, end = 0, len(data)
    while at < end:
        reason, head = "no record head", _header(data, at)
        if head:
            fields, start = head
            stop = start + int(fields["content-length"])
            if stop > end:
                reason = "block cut short"
            elif data[stop : stop + 4] != b"\r\n\r\n" and stop != end:
                reason = "wrong length"
            else:
                block, want = data[start:stop], fields.get("warc-block-digest", "")
                if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
                    reason = "block digest differs"
                else:
                    yield "record", base + at, fields, block
                    at = min(end, stop + 4)
                    continue
        following = _next_head(data, at + 1)
        following = end if following < 0 else following
        yield "gap", base + at, base + following, reason
        at = following


def _next_head(data: bytes, at: int) -> int:
    """Where the next record head begins that is whole, or -1."""
    while (at := data.find(b"WARC/1.", at)) >= 0 and _header(data, at) is None:
        at += 1
    return at


class _Ahead:
    """The first place at or behind a moving one that ``find`` gives; it is looked for again only when it is passed, so a file is searched once."""

    def __init__(self, data: bytes, find: Callable[[bytes, int], int]):
        self.data, self.find, self.at = data, find, None

    def __call__(self, at: int) -> int:
        if self.at is None or 0 <= self.at < at:
            self.at = self.find(self.data, at)
        return self.at


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What a gzip member at ``at`` yields, where it ends, and whether it is whole."""
    stream, out, i, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while i < len(data) and not stream.eof:
            out.append(stream.decompress(view[i : i + 65_536]))
            i += 65_536
    except zlib.error:
        return b"".join(out), i, False
    return b"".join(out), min(i, len(data)) - len(stream.unused_data), stream.eof


def _next_member(data: bytes, at: int) -> int:
    """Where the next gzip member begins that opens with a version line, or -1."""
    view = memoryview(data)
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(view[at : at + 4096], 7) == b"WARC/1.":
                return at
        except zlib.error:
            pass
        at += 1
    return -1


def salvage(data: bytes) -> Iterator[tuple]:
    """As salvage_plain, for plain archives and those of gzip members; in members, offsets are the member's own.

    Of a damaged member the records before the damage are kept; the search goes on with the next member that begins well.
    """
    at, end = 0, len(data)
    member, head = _Ahead(data, _next_member), _Ahead(data, _next_head)
    while at < end:
        if data.startswith(b"\x1f\x8b\x08", at):
            body, stop, whole = _inflate(data, at)
            if whole:
                for item in salvage_plain(body):
                    yield ("record", at, *item[2:]) if item[0] == "record" else ("gap", at, stop, item[3])
                at = stop
                continue
            for item in salvage_plain(body):
                if item[0] == "record":
                    yield "record", at, *item[2:]
            reason = "damaged member"
        elif _header(data, at):
            stop = member(at)
            stop = end if stop < 0 else stop
            yield from salvage_plain(data[at:stop], at)
            at = stop
            continue
        else:
            reason = "no member or version line"
        following = min((x for x in (member(at + 1), head(at + 1)) if x >= 0), default=end)
        yield "gap", at, following, reason
        at = following


_ROW = "file string, at bigint, gap_end bigint, gap_reason string, record_id string, record_type string, refers_to string, target string, payload_bytes bigint, payload_digest string, claimed_digest string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record and per quarantined gap (gap_end and gap_reason set) of the archives under path."""

    def run(batches):
        for batch in batches:
            for path_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for kind, at, *rest in salvage(data.as_py()):
                    if kind == "gap":
                        rows.append({"file": path_, "at": at, "gap_end": rest[0], "gap_reason": rest[1]})
                        continue
                    fields, block = rest
                    row = {"file": path_, "at": at, "record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"], "refers_to": fields.get("warc-refers-to"), "target": fields.get("warc-target-uri")}
                    row |= {"payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest(), "claimed_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None}
                    rows.append(row | {"payload": block} if with_payload else row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    columns = [c.strip().split(" ") for c in _ROW.split(",")]
    schema = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in columns] + ([("payload", pa.binary())] if with_payload else []))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, _ROW + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response it refers to; its digest is checked against the one the revisit claims.
    """
    spark, ident = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    path = fresh_path(spark, "warc")
    write_archives(pages, path)

    def number(c):
        return F.nullif(F.regexp_extract(c, r"page:([^>]*)>", 1), F.lit("")).cast(ident)

    read = cut(read_archives(spark, path).withColumns({"page_id": number("record_id"), "refers_to": number("refers_to")}), "op3-records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    response = read.filter("record_type = 'response'")
    target = response.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")).dropDuplicates(["refers_to", "d"])
    revisit = read.filter("record_type = 'revisit'").join(target.withColumnRenamed("d", "claimed_digest"), ["refers_to", "claimed_digest"], "left")
    revisit = revisit.select("page_id", F.col("n").alias("payload_bytes"), F.col("claimed_digest").alias("payload_digest"), "record_type", "refers_to")
    out = cut(response.select(columns).unionByName(revisit), "op3-result")
    lost = cut(read.filter("gap_reason is not null").select("file", "at", "gap_end", "gap_reason").unionByName(out.filter("payload_bytes is null").select(F.col("page_id").cast("string").alias("record_id"), F.lit("no response for revisit").alias("gap_reason")), allowMissingColumns=True), "op3-quarantine")
    n = lost.count()
    if n:
        raise RuntimeError(f"{n} gaps in the archives under {path}: see {lost._paperloom_path}")
    drop(read, lost)
    delete(spark, path)
    return out
