"""WARC archives: a writer with revisit records, and a reader that splits archives by byte ranges.

Archives are gzip files with a member for each record, in a folder that all executors share. Tasks write
them under names of their own, and only those listed in the writer's result, which committed tasks return,
are archives; files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import shared_dir, written

#: Fixed values of the formats.
MAGIC, END, VERSION = b"\x1f\x8b\x08", b"\r\n\r\n", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:cairn:page:"
#: Bytes of an archive after which a task begins another; of a split; and read at once.
ARCHIVE_BYTES, SPLIT_BYTES, READ_BYTES = 256_000_000, 8_000_000, 1_000_000
#: Digests of several rows that are sent to every task, at most: some 100 bytes each.
SENT_DIGESTS = 300_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with only the HTTP header that came before it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{PAGE_URN}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else f"<{PAGE_URN}{refers_to}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, sent_digests: int = SENT_DIGESTS) -> DataFrame:
    """Archives of pages (page_id, url, html), a record for each row; returns path, bytes, records of each archive.

    The payload is the html in UTF-8, empty if null. Of equal payloads of least_bytes or more, the row with the
    largest page_id is the response and the others revisit it; smaller payloads are all responses, and so are
    rows that repeat a response's id or have equal payloads and no id at all. Digests find equal payloads; those with
    several rows are written first and counted: up to sent_digests of them go to every task, and no payload is
    shuffled; more are joined, where AQE splits a digest that very many rows share. Null and empty tables, urls and ids are
    written as they are; a payload is held whole by one task; other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    keys = pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).alias("size")).where(F.col("size") >= least_bytes)
    keepers = keys.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    keepers = written(keepers)
    keepers = F.broadcast(keepers) if keepers.count() <= sent_digests else keepers
    marked = rows.join(keepers, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = opened(folder)
        filesystem.create_dir(base, recursive=True)
        out = None
        done: list[tuple[str, int, int]] = []
        for batch in arrow:
            for page_id, url, data, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                packed = member(record(page_id.as_py(), url.as_py(), data.as_py(), refers_to.as_py(), date))
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", size, n))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "bytes", "records"])

    return written(marked.mapInArrow(run, "path string, bytes long, records long"))


class Range:
    """A file's bytes from a place on, read as far as they are asked for and forgotten behind."""

    def __init__(self, file, begin: int):
        self.file, self.begin, self.held, self.over = file, begin, bytearray(), False
        file.seek(begin)

    def upto(self, end: int) -> None:
        """Hold everything before `end`, as far as the file goes."""
        while not self.over and self.begin + len(self.held) < end:
            got = self.file.read(max(READ_BYTES, end - self.begin - len(self.held)))
            self.over = not got
            self.held += got

    def forget(self, at: int) -> None:
        """Drop what lies before a place."""
        if at - self.begin > READ_BYTES:
            del self.held[: at - self.begin]
            self.begin = at

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place from `at` on and before `end` where `what` begins, or -1."""
        self.upto(end + len(what) - 1)
        i = self.held.find(what, at - self.begin, end - self.begin + len(what) - 1)
        return -1 if i < 0 else self.begin + i

    def unpacked(self, at: int, most: int | None = None) -> tuple[bytes, int] | None:
        """The gzip member at a place and where it ends; with `most`, only its first bytes. None if it is none.

        Members are short, and what is fed behind a member's end is copied: parts start small and double.
        """
        z, out, place, n, step = zlib.decompressobj(31), [], at, 0, 4096
        try:
            while not z.eof and (most is None or n < most):
                self.upto(place + step)
                part = bytes(self.held[place - self.begin : place - self.begin + step])
                if not part:
                    return None if most is None else (b"".join(out), place)
                out.append(z.decompress(part, (most - n) if most else 0))
                n += len(out[-1])
                if most and z.unconsumed_tail:
                    break
                place, step = place + len(part), min(2 * step, READ_BYTES)
            return b"".join(out), place - len(z.unused_data)
        except zlib.error:
            return None


@dataclass(frozen=True)
class Record:
    head: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Corrupt:
    """A member that begins as a record does, and can't be read to its end."""

    at: int


def parsed(data: bytes) -> list[Record] | None:
    """The records of a member, one behind the other, if they are whole: headers can be read and blocks have the lengths they say."""
    out, begin = [], 0
    while begin < len(data):
        if not data.startswith(VERSION, begin) or (i := data.find(END, begin)) < 0:
            return None
        head = {}
        for line in data[begin:i].decode("utf-8", "replace").split("\r\n")[1:]:
            k, colon, v = line.partition(":")
            if not colon:
                return None
            head[k.strip().lower()] = v.strip()
        if "warc-type" not in head or not head.get("content-length", "").isdigit():
            return None
        block = i + len(END)
        begin = block + int(head["content-length"])
        if not data.startswith(END, begin):
            return None
        out.append(Record(head, data[block:begin]))
        begin += len(END)
    return out


def records(file, begin: int, end: int) -> Iterator[Record | Corrupt]:
    """The records of members that start in [begin, end) of an archive, and such members that are broken.

    Every place with the magic of a gzip member is a candidate. It is a member of records if what it unpacks
    to begins as a record does, if it unpacks whole with the right check sum, and if all headers can be
    read and fit the lengths. The scan goes on behind a member, and one byte further after a candidate that is none.
    """
    source, at = Range(file, begin), begin
    while at < end and (at := source.find(MAGIC, at, end)) >= 0:
        source.forget(at)
        first = source.unpacked(at, len(VERSION))
        begins = first is not None and first[0].startswith(VERSION)
        whole = source.unpacked(at) if begins else None
        found = parsed(whole[0]) if whole else None
        yield from found or ([Corrupt(at)] if begins else [])
        at = whole[1] if found else at + 1


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """A row for each record of archives (path, bytes): record_id, record_type, target_uri, date, payload_digest, refers_to, payload_bytes, error and, if asked for, payload.

    Tasks take byte ranges of split_bytes and own the records that start inside, so an archive of any size is
    read in parallel; a record that reaches over its range's end is read on. Digest and length of a response are those of the
    payload as read, of a revisit those that its headers give for the full payload; its payload is null. A member may hold several
    records, which belong to the task where it starts. One that is broken or cut off gives a row with `error` alone, and what
    follows is read on; bytes between members that begin no record are skipped. Archives listed twice are read twice;
    memory holds a split and one member, whatever the archive's size.
    """
    names = ["record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "payload_bytes", "error"] + ["payload"] * payload

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for path, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end"))):
                filesystem, at = opened(path)
                with filesystem.open_input_file(at) as file:
                    out = []
                    for r in records(file, begin, end):
                        out.append((*[None] * 7, f"member at byte {r.at} of {path} can't be read", None) if isinstance(r, Corrupt) else _row(r))
                        if len(out) == 200:
                            yield _batch(out, names)
                            out = []
                    yield _batch(out, names)

    splits = archives.select("path", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("begin"))
    ranges = splits.select("path", "begin", F.least(F.col("begin") + split_bytes, "size").alias("end"))
    dealt = ranges.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4))
    return dealt.mapInArrow(run, "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, error string" + ", payload binary" * payload)


def _row(r: Record) -> tuple:
    http, _, body = r.block.partition(END)
    uri = lambda k: r.head[k].strip("<>") if k in r.head else None
    kind = r.head["warc-type"]
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        digest = r.head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size, body = int(length[1]) if length else None, None
    else:
        if not r.head.get("content-type", "").startswith("application/http"):
            body = r.block
        digest, size = base32_sha1(body), len(body)
    return uri("warc-record-id"), kind, uri("warc-target-uri"), r.head.get("warc-date"), digest, uri("warc-refers-to"), size, None, body


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(columns, types, names)], names)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read again; a record that can't be read is an error."""
    archives = write_archives(pages, shared_dir(pages.sparkSession), least_bytes)
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE_URN) + 1}) as {pages.schema['page_id'].dataType.simpleString()})")
    page_id = F.when(F.col("error").isNotNull(), F.raise_error("error")).otherwise(page("record_id"))
    return read_archives(archives, payload=False).select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
