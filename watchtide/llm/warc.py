"""WARC archives: one gzip member per record, repeated payloads as revisits, and a splittable reader.

Reader tasks take byte ranges. A task scans its range for the gzip magic, decodes the first bytes of a candidate,
and accepts it if they are a WARC header; from there it follows the members one by one. A record belongs to the range
in which its member starts, wherever it ends, so every record is read once.

Files are read and written through pyarrow's file systems, so the folder may be any that all executors reach.

Defined cases: a null payload is empty; a null page_id sorts last and is written as an empty name; rows that share the
smallest page_id of a payload are all responses; a header is as long as it is; a member whose header is right but whose rest is broken is a row
of type `damaged` without a payload; bytes that belong to no member are skipped; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchtide.llm.text import pick, steps
from watchtide.session import checkpoint_dir, cut_lineage

MAGIC = b"\x1f\x8b\x08"
#: Bytes asked of the file system at once.
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, level: int = 6) -> bytes:
    name = "" if page_id is None else page_id
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{name}>", "WARC-Date": date}
    if url:
        fields["WARC-Target-URI"] = "".join(c for c in url if c not in "\r\n")
    fields["WARC-Payload-Digest"] = f"sha1:{payload_digest(payload)}"
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'' if refers_to is None else refers_to}>"}
    fields["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, http if revisit else http + payload, level)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): of equal payloads of at least so many bytes, the smallest page_id is the response."""
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1("html"))))
    first = rows.select("digest", "page_id").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("refers_to")).where("n > 1 AND digest IS NOT NULL").drop("n")
    out = rows.join(first, "digest", "left")
    return out.select("page_id", "url", "html", "refers_to", F.coalesce(F.coalesce(F.col("page_id") > F.col("refers_to"), F.col("refers_to").isNotNull()), F.lit(False)).alias("revisit"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record per row, a file per task; gives (path, size). A file appears under its name when it is whole, so a task may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = files.FileSystem.from_uri(folder)
        task = TaskContext.get()
        path = f"{place}/part-{task.partitionId():06d}.warc.gz"
        part = f"{place}/.{task.taskAttemptId()}-{uuid.uuid4().hex}"
        size, out = 0, None
        for batch in steps(batches, "html"):
            if batch.num_rows and out is None:
                system.create_dir(place, recursive=True)
                out = system.open_output_stream(part)
            for page_id, url, html, refers_to, again in zip(*(c.to_pylist() for c in batch.columns)):
                data = page_record(page_id, url, html.encode(), refers_to, again, date, level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            system.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "size"])

    return cut_lineage(revisits(pages, least_bytes).mapInArrow(run, "path string, size long"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the archives in a folder."""
    system, place = files.FileSystem.from_uri(folder)
    found = system.get_file_info(files.FileSelector(place, recursive=True))
    return spark.createDataFrame([(x.path, x.size) for x in found if x.is_file and x.path.endswith((".warc.gz", ".warc"))], "path string, size long")


class Window:
    """Bytes of a file from any place on, read ahead in blocks."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes from `place` on."""
        if place < self.start or place + n > self.start + len(self.data):
            self.source.seek(place)
            self.start, self.data = place, self.source.read(min(max(n, READ), max(0, self.size - place)))
        return self.data[place - self.start : place - self.start + n]


def header_at(window: Window, place: int) -> bool:
    """Does a member with a WARC header start here?"""
    data = window.at(place, 4096)
    if data[:3] != MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def next_member(window: Window, place: int, end: int) -> int | None:
    """First place from here on, before `end`, where a record starts."""
    while place < end:
        data = window.at(place, min(READ, end - place + len(MAGIC) - 1))
        found = data.find(MAGIC)
        if found < 0:
            if len(data) < len(MAGIC):
                return None
            place += len(data) - len(MAGIC) + 1
            continue
        place += found
        if place < end and header_at(window, place):
            return place
        place += 1
    return None


def member(window: Window, place: int) -> tuple[bytes | None, int]:
    """(content, place after it); no content if the member is broken, then the place after its magic."""
    packer, parts, at = zlib.decompressobj(31), [], place
    try:
        while not packer.eof:
            data = window.at(at, READ)
            if not data:
                return None, place + 1
            parts.append(packer.decompress(data))
            at += len(data)
    except zlib.error:
        return None, place + 1
    return b"".join(parts), at - len(packer.unused_data)


def parsed(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(fields by lower-case name, block), or nothing if the record is not whole."""
    split = content.find(b"\r\n\r\n")
    if split < 0:
        return None
    fields: dict[str, str] = {}
    name = ""
    for line in content[:split].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    size = fields.get("content-length", "")
    block = content[split + 4 :]
    if not size.isdigit() or len(block) < int(size):
        return None
    return fields, block[: int(size)]


def read_range(source, size: int, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes | None]]:
    """(place, length, fields, block) of the records that start in the range."""
    window, place = Window(source, size), start
    while (place := next_member(window, place, end)) is not None:
        content, after = member(window, place)
        found = parsed(content) if content is not None else None
        yield place, after - place, *(found or ({"warc-type": "damaged"}, None))
        place = after


def read(archives: DataFrame, folder: str, split: int = 32 << 20) -> DataFrame:
    """Records of the archives (path, size): path, place, length, record_type, record_id, refers_to, uri, date, digest, content_length, payload.

    `payload` is what follows the HTTP header of a response; revisits have none, but the length and digest of theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = files.FileSystem.from_uri(folder)
        names = ["path", "place", "length", "record_type", "record_id", "refers_to", "uri", "date", "digest", "content_length", "payload"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for place, length, fields, block in read_range(source, size, start, min(size, start + split)):
                        payload, content_length = block, None
                        if block is not None and fields.get("content-type", "").startswith("application/http"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            found = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            content_length = int(found[0]) if found else len(payload)
                        if fields["warc-type"] == "revisit":
                            payload = None
                        elif payload is not None:
                            content_length = len(payload)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        if payload is not None and digest is not None and digest != payload_digest(payload):
                            fields, payload = fields | {"warc-type": "damaged"}, None
                        rows.append((path, place, length, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), digest, content_length, payload))
                        held += len(payload or b"")
                        if held > READ * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ranges = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    n = archives.select(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    return ranges.repartition(int(n)).mapInArrow(run, "path string, place long, length long, record_type string, record_id string, refers_to string, uri string, date string, digest string, content_length long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """The records, revisits with the payload of the response they refer to."""
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "digest", F.col("payload").alias("found")).dropDuplicates(["refers_to", "digest"])
    return records.join(first, ["refers_to", "digest"], "left").withColumn("payload", F.coalesce("payload", "found")).select(*records.columns)


def page_of(name: str) -> Column:
    """The page_id in a record's name."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the cluster's shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
