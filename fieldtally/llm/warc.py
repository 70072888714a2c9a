"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, with repeated payloads as revisits.

An archive is one row: tasks gather records up to ``ARCHIVE_BYTES`` and Spark's text sink
writes one compressed file a row, so archives appear only when their task has succeeded
and lie wherever the cluster can write.  Reading takes whole files and steps from record
to record by their declared lengths; contents are never searched for separators.

Null payloads are empty ones, null or blank URLs are written ``-`` and have no target in
the WARC, bytes below 21 in a URL are percent-encoded.  A record with a null key never
names a revisit's target while another key has the same payload; rows equal in key and
payload are all of the type that key has.  Empty tables give empty folders.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import store

#: Bytes after which a task begins its next archive; a longer record has one for itself.
ARCHIVE_BYTES = 32 << 20
#: A payload of more than one part in so many of all records is met by broadcast: fewer than so many can exist.
HOT_SHARE = 1000
#: Header of the fetched page that carries the key of its row.
KEY_FIELD = "X-Source-Key"

# The formats' own words.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_RECORDS = ("archive string, offset long, version int, url string, ip string, date string, mime string, status string, "
               "length long, block binary, error string")
CONVERTED = ("archive string, offset long, key string, record_id string, warc_type string, warc_date string, uri string, "
             "ip string, content_type string, head_bytes long, payload_bytes long, payload_digest string, "
             "payload_sha256 binary, truncated boolean, block binary")
WARC_RECORDS = ("archive string, offset long, warc_type string, record_id string, warc_date string, uri string, "
                "content_type string, payload_digest string, refers_to_id string, refers_to_key string, key string, "
                "payload_bytes long, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Archives as rows, rows as archives.

def write_archives(rows: DataFrame, path: str, start: Callable[[], Callable], separator: str, *,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One compressed file an archive: ``start()`` gives a task its functions (opening bytes by name, bytes of a row)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        opening, record = start()
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                for row in batch.slice(k, 100).to_pylist():
                    if not parts:
                        parts = [opening(f"archive-{task:05d}-{number:05d}", number)]
                        size = 0
                    parts.append(record(row))
                    size += len(parts[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([separator.encode().join(parts)])], names=["value"])
                        parts, number = [], number + 1
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([separator.encode().join(parts)])], names=["value"])

    (rows.mapInArrow(gather, "value binary")
     # The sink writes a string's bytes as they are, and the separator after each.
     .select(F.col("value").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", separator).option("compression", "gzip").text(path))


def read_archives(spark: SparkSession, path: str, schema: str,
                  parse: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Every record of every file of a folder, by ``parse(name, content)``."""
    columns = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("path")[k].as_py().rsplit("/", 1)[-1]
                content, rows, size = batch.column("content")[k].as_py(), [], 0
                if content[:2] == b"\x1f\x8b":
                    content = unzip(content)
                for row in parse(name, content):
                    rows.append(row)
                    size += 200 + sum(len(v) for v in row if isinstance(v, bytes))
                    if size > 4 << 20:
                        yield _batch(rows, columns)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, columns)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def unzip(content: bytes) -> bytes:
    """All members of a gzip file, each record or the whole file being one."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(wbits=31)
        parts.append(one.decompress(content) + one.flush())
        content = one.unused_data
    return b"".join(parts)


# ARC

def _token(value, empty: str = "-") -> str:
    """``value`` as one word of a header line."""
    kept = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", value or "")
    return kept or empty


def arc_record(version: int, url, ip, date, mime, block: bytes, *, status="200", offset=0, name="-") -> bytes:
    """A record's header line, in the fields of its version, and its block."""
    before = [_token(url), _token(ip, "0.0.0.0"), date, _token(mime, "no-type")]
    if version == 2:
        before += [_token(status), base32_sha1(block), "-", str(offset), name]
    return " ".join([*before, str(len(block))]).encode() + b"\n" + block


def arc_opening(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 Archive\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}.arc", "0.0.0.0", date, "text/plain", block, name=name)


def write_arc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
              date: str = "20260101000000", versions: tuple[int, ...] = (1, 2), archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pages as HTTP answers in ARC files, whose versions take turns within a task."""

    def start():
        now = {"version": versions[0]}

        def opening(name: str, number: int) -> bytes:
            now["version"] = versions[number % len(versions)]
            return arc_opening(now["version"], name, date)

        def record(row: dict) -> bytes:
            body = row["payload"] or b""
            named = "" if row["key"] is None else f"{KEY_FIELD}: {row['key']}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(body)}\r\n\r\n"
            return arc_record(now["version"], row["url"], None, date, "text/html", head.encode() + body)

        return opening, record

    rows = pages.select(pages[key].cast("string").alias("key"), pages[url].cast("string").alias("url"),
                        pages[payload].cast("string").cast("binary").alias("payload"))
    write_archives(rows, path, start, "\n", archive_bytes=archive_bytes)


def parse_arc(name: str, content: bytes) -> Iterator[tuple]:
    """Records of an ARC by version-specific header lines and declared lengths.

    A header line that cannot be read gives a record with ``error`` set whose block
    holds all bytes up to the next line that can; a block that the file's end cuts
    off is kept as far as it goes and is shorter than its ``length``.
    """
    at, version, fields, end = 0, 1, ARC_FIELDS[1].split(), len(content)
    opened = False
    while at < end:
        if content[at:at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        stop = content.find(b"\n", at)
        line = content[at:stop if stop >= 0 else end].rstrip(b"\r").decode("utf-8", "replace")
        if not opened or line.startswith("filedesc://"):
            # The version, and with it the fields of each line, stand in the block after the first line.
            own = content[stop + 1:stop + 4096].split(b"\n")[:2] if stop >= 0 else []
            if len(own) == 2 and re.fullmatch(rb"[12] \d+ .*", own[0].rstrip(b"\r"), re.S):
                version = int(own[0][:1])
                named = own[1].decode("utf-8", "replace").split()
                fields = named if named[:1] == ["URL"] and named[-1:] == ["Archive-length"] else ARC_FIELDS[version].split()
            opened = True
        values = _arc_line(line, fields)
        if values is None:
            nxt = stop
            while nxt >= 0:
                after = content.find(b"\n", nxt + 1)
                found = after >= 0 and _arc_line(content[nxt + 1:after].rstrip(b"\r").decode("utf-8", "replace"), fields)
                if found and ":" in found["URL"]:  # text may look like a header line, but hardly with a scheme
                    break
                nxt = after
            stop = end if nxt < 0 else nxt + 1
            yield (name, at, version, None, None, None, None, None, stop - at, content[at:stop], "unreadable header line")
            at = stop
            continue
        size, begin = int(values["Archive-length"]), (stop + 1 if stop >= 0 else end)
        yield (name, at, version, values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"],
               values.get("Result-code"), size, content[begin:begin + size], None)
        at = begin + size


def _arc_line(line: str, fields: list[str]) -> dict[str, str] | None:
    """Fields of a header line; blanks inside the URL, which is first, stay in it."""
    values = line.rsplit(" ", len(fields) - 1)
    if len(values) != len(fields) or not re.fullmatch(r"\d{1,18}", values[-1]):
        return None
    found = dict(zip(fields, values))
    return found if found["URL"] and re.fullmatch(r"\d{4,14}", found["Archive-date"]) else None


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files, compressed or not, in the columns of ``ARC_RECORDS``."""
    return read_archives(spark, path, ARC_RECORDS, parse_arc)


# Conversion

def warc_date(date: str | None) -> str:
    """ISO time of 4 to 14 digits of an ARC date; missing parts are the least ones, impossible dates the epoch."""
    from datetime import datetime

    full = (date or "") + "00000101000000"[len(date or ""):]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except ValueError:
        return "1970-01-01T00:00:00Z"


def http_head(block: bytes) -> int:
    """Bytes of the HTTP header that a block begins with, its empty line included; 0 if it has none."""
    if not block.startswith(b"HTTP/"):
        return 0
    end = re.search(rb"\r?\n\r?\n", block)
    return end.end() if end else len(block)


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb"[ \t]*:[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def convert_record(arc: tuple, with_block: bool = True) -> tuple:
    """The WARC record equivalent to an ARC record: identifier, time, type, digests and declared content.

    The identifier is a name-based UUID of archive, place and block, so another run over
    the same archive gives the same.  ``filedesc`` becomes ``warcinfo``; an HTTP answer
    ``response``; all else, name lookups and unreadable bytes included, ``resource``.
    """
    archive, offset, _, url, ip, date, mime, _, length, block, _ = arc
    head = http_head(block)
    payload = block[head:]
    if (url or "").startswith("filedesc://"):
        kind, content = "warcinfo", "application/warc-fields"
        block = f"software: archive converter\r\nformat: {WARC_VERSION}\r\noriginal: {url[11:]}\r\n".encode()
        payload = block
    elif head:
        kind, content = "response", "application/http; msgtype=response"
    else:
        kind, content = "resource", mime if mime and "/" in mime else "application/octet-stream"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive} {offset} {hashlib.sha1(block).hexdigest()}")
    return (archive, offset, http_field(block[:head], KEY_FIELD), f"urn:uuid:{name}", kind, warc_date(date),
            None if url in (None, "-") or kind == "warcinfo" else url, None if ip in (None, "0.0.0.0", "-") else ip, content,
            head, len(payload), base32_sha1(payload), hashlib.sha256(payload).digest(), len(arc[9]) < length,
            block if with_block else None)


def convert(spark: SparkSession, path: str, *, blocks: bool = True) -> DataFrame:
    """WARC records, in the columns of ``CONVERTED``, of the ARC files of a folder; without blocks where only digests count."""

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        return (convert_record(r, blocks) for r in parse_arc(name, content))

    return read_archives(spark, path, CONVERTED, parse)


def revisits(records: DataFrame, *, key_type: str = "long", least_bytes: int = 0) -> DataFrame:
    """(archive, offset, refers_to_id, refers_to_key) of each response whose payload a greater key has too.

    Payloads are equal if size and SHA-256 are.  Keys are counted before they meet; the
    few payloads that many records share are met by broadcast, so no task gets all of one.
    """
    narrow = store(records.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least_bytes)).select(
        "archive", "offset", F.col("key").cast(key_type).alias("key"), "record_id",
        F.struct("payload_bytes", "payload_sha256").alias("payload")), "warc-digests")
    groups = store(narrow.groupBy("payload").agg(
        F.count(F.lit(1)).alias("n"), F.max("key").alias("refers_to_key"),
        F.max_by("record_id", "key").alias("refers_to_id")).where("n > 1 AND refers_to_key IS NOT NULL"), "warc-groups")
    all_rows = narrow.count()
    hot = groups.where(F.col("n") * HOT_SHARE > all_rows).drop("n")
    other = groups.where(F.col("n") * HOT_SHARE <= all_rows).drop("n")
    met = narrow.join(F.broadcast(hot), "payload").unionByName(narrow.join(other, "payload"))
    return met.where(~F.col("key").eqNullSafe(F.col("refers_to_key"))).select(
        "archive", "offset", "refers_to_id", F.col("refers_to_key").cast("string").alias("refers_to_key"))


def arc_to_warc(spark: SparkSession, source: str, path: str, *, key_type: str = "long", least_bytes: int = 0,
                archive_bytes: int = ARCHIVE_BYTES) -> None:
    """The ARC files of a folder as WARC files in another; of equal payloads the greatest key's is the response.

    Blocks are read in the second pass only and stay where they are as long as the
    planner may broadcast the list of revisits, whose size it knows.
    """
    found = store(revisits(convert(spark, source, blocks=False), key_type=key_type, least_bytes=least_bytes), "warc-revisits")
    write_warc(convert(spark, source).where("warc_type <> 'warcinfo'").join(found, ["archive", "offset"], "left"), path,
               archive_bytes=archive_bytes)


# WARC

def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without its closing empty lines, which stand between records."""
    lines = [WARC_VERSION, *(f"{n}: {v}" for n, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def write_warc(records: DataFrame, path: str, *, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Converted records, with ``refers_to_id`` set for revisits, as WARC files that each begin with a ``warcinfo``."""

    def start():
        def opening(name: str, number: int) -> bytes:
            block = f"software: archive converter\r\nformat: {WARC_VERSION}\r\n".encode()
            return warc_record([("WARC-Type", "warcinfo"), ("WARC-Filename", f"{name}.warc"), ("WARC-Date", "1970-01-01T00:00:00Z"),
                                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                                ("Content-Type", "application/warc-fields")], block)

        def record(row: dict) -> bytes:
            again, block = row["refers_to_id"], row["block"]
            if again:  # keeps the HTTP header, whose Content-Length tells the payload's size
                block = block[:row["head_bytes"]]
            return warc_record([
                ("WARC-Type", "revisit" if again else row["warc_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"),
                ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]),
                ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
                ("WARC-Truncated", "unspecified" if row["truncated"] else None),
                ("WARC-Profile", REVISIT_PROFILE if again else None), ("WARC-Refers-To", f"<{again}>" if again else None),
                ("X-Refers-To-Key", row["refers_to_key"]), ("X-Payload-Length", str(row["payload_bytes"])),
                ("Content-Type", row["content_type"])], block)

        return opening, record

    write_archives(records, path, start, "\r\n\r\n", archive_bytes=archive_bytes)


def parse_warc(name: str, content: bytes) -> Iterator[tuple]:
    """Records of a WARC by their declared lengths; digests are counted anew from what was read."""
    at, end = 0, len(content)
    while at < end:
        if content[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"{name}: no WARC record at byte {at}")
        fields = {}
        for line in content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = content[stop + 4:stop + 4 + size]
        if len(block) < size:
            raise ValueError(f"{name}: the record at byte {at} is cut off")
        head = http_head(block)
        payload = block[head:]
        kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response" and digest != base32_sha1(payload):
            raise ValueError(f"{name}: the payload at byte {at} is not what its digest says")
        length = fields.get("x-payload-length") or (http_field(block[:head], "Content-Length") if kind == "revisit" else None)
        yield (name, at, kind, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-date"), fields.get("warc-target-uri"),
               fields.get("content-type"), digest, fields.get("warc-refers-to", "").strip("<>") or None,
               fields.get("x-refers-to-key"), http_field(block[:head], KEY_FIELD), int(length) if length else len(payload), payload)
        at = stop + 4 + size


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of WARC files in the columns of ``WARC_RECORDS``; a cut-off or changed record raises."""

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        return (r if payloads else (*r[:-1], None) for r in parse_warc(name, content))

    return read_archives(spark, path, WARC_RECORDS, parse)
