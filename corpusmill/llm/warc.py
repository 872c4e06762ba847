"""WARC archives: a writer with revisit records and a salvage reader.

Archives are files of gzip members, one record each, of at most about `ARCHIVE_BYTES`.  They are written to the shared
folder through its own file system (pyarrow), under names that no other attempt of a task has.  A table of what finished
tasks wrote, committed by Spark, is the manifest: only its archives are read back, so a task that ran twice counts once.

The salvage reader takes bytes as they come.  A member (or, in plain files, a record) that fails its checks - gzip CRC,
length, version line, headers, block digest - doesn't end the file: the reader looks for the next place where a valid
member or version line begins, recovers what follows, and logs the bytes between as a quarantined gap.  Of a damaged
member, what could be inflated is searched for records in the same way; those with a sound block digest are kept.

round_trip() fails if the archives hold a gap or another number of records than was written.

Null html: an empty payload.  Null url: the record has no target URI.  Null page_id: a record without that field, a
response unless its payload is that of a page with an id.  Repeated rows are written each; rows of the smallest page_id
of a payload are all responses.  Very long pages are one record each.  An empty table makes no archive and no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, storage

ARCHIVE_BYTES = 16 << 20
VERSION = b"WARC/1.1"
_MEMBER = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None = None) -> bytes:
    """One record.  A revisit has no block of its own: the payload is that of the record it refers to."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{url}:{payload_digest}')}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.encode('unicode_escape').decode() if any(c < ' ' for c in url) else url}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member of its own, without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and where it ends; raises Damaged if any check fails."""
    if data[at : at + 5] != b"WARC/":
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers don't end")
    lines = data[at:end].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged("unknown version")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        try:
            headers[name.strip().lower().decode("ascii")] = value.strip().decode()
        except UnicodeDecodeError as e:
            raise Damaged("a header that isn't text") from e
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise Damaged("no length or type")
    begin = end + 4
    stop = begin + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the record doesn't end where it says")
    block = data[begin:stop]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest(block):
        raise Damaged("block digest")
    return headers, block, stop + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What a gzip member holds, where it ends, and what is wrong with it, if anything; then the end is unknown."""
    z, out, to = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if to >= len(data):
                return b"".join(out), len(data), "the member doesn't end"
            # little by little, so that little is lost where it breaks
            out.append(z.decompress(data[to : to + (1 << 12)]))
            to += 1 << 12
    except zlib.error as e:
        # byte by byte through the piece that broke
        z = zlib.decompressobj(31)
        sound, to = [z.decompress(data[at:to])], to
        try:
            for k in range(to, min(len(data), to + (1 << 12))):
                sound.append(z.decompress(data[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(sound), len(data), str(e)
    return b"".join(out), min(to, len(data)) - len(z.unused_data), None


class _Next:
    """The next place of a mark at or after a position, found once."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.at = data, mark, -1

    def __call__(self, at: int) -> int:
        if self.at < at:
            self.at = self.data.find(self.mark, at)
            if self.at < 0:
                self.at = len(self.data)
        return self.at


def _records(text: bytes, checked: bool) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """Sound records of inflated text, and what the first unsound one lacks; checked: only those with a block digest."""
    found, problem, at, following = [], None, 0, _Next(text, b"WARC/1.")
    while at < len(text):
        try:
            headers, block, end = parse(text, at)
            if checked and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("no block digest in a damaged member")
        except Damaged as e:
            problem = problem or str(e)
            at = following(at + 1)
            continue
        found.append((headers, block))
        at = end
    return found, problem


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", from, to, (headers, block)) of every sound record and ("gap", from, to, reason) of all other bytes.

    A damaged member is a gap, before which the records that were recovered from it come.
    """
    at, bad, reason = 0, None, ""
    member_at, version_at = _Next(data, _MEMBER), _Next(data, b"WARC/1.")
    while at < len(data):
        found, problem, end, bounded = [], None, len(data), True
        if data.startswith(_MEMBER, at):
            text, end, problem = inflate(data, at)
            bounded = problem is None
            found, inner = _records(text, not bounded)
            problem = problem or inner
        else:
            try:
                headers, block, end = parse(data, at)
                found = [(headers, block)]
            except Damaged as e:
                problem, bounded = str(e), False
        if not bounded:
            end = min(member_at(at + 1), version_at(at + 1))
        if problem is None or found:
            if bad is not None:
                yield "gap", bad, at, reason
                bad = None
            for x in found:
                yield "record", at, end, x
        if problem is not None and bad is None:
            bad, reason = at, problem
        at = end
    if bad is not None:
        yield "gap", bad, len(data), reason


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers of a block."""
    return block.partition(b"\r\n\r\n")[2]


def _digests(batches):
    for batch in batches:
        payloads = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), batch.column("html").cast(pa.string()), pa.array([digest(x) for x in payloads]), pa.array([len(x) for x in payloads], pa.int64())],
            names=["page_id", "url", "html", "payload_digest", "payload_bytes"],
        )


def _writer(root: str, archive_bytes: int):
    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        # no two attempts of a task share a name
        attempt = uuid.uuid4().hex
        buffer, size, made = [], 0, []

        def flush():
            nonlocal buffer, size
            name = f"{attempt}-{len(made):05d}.warc.gz"
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                for x in buffer:
                    out.write(x)
            made.append((name, len(buffer), size))
            buffer, size = [], 0

        system.create_dir(base, recursive=True)
        for batch in batches:
            for page_id, url, html, sha, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = member(record("response" if first is None else "revisit", page_id, url, payload, sha, first))
                buffer.append(data)
                size += len(data)
                if size >= archive_bytes:
                    flush()
        if buffer:
            flush()
        if made:
            name, records, n = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(records, pa.int64()), pa.array(n, pa.int64())], names=["archive", "records", "bytes"])

    return run


def write(pages: DataFrame, root: str, min_payload_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every page to archives under `root`; the manifest (archive, records, bytes) is returned.

    Only digests that more than one page has are joined back, so the join is small unless copies abound; copies of one
    payload may be a third of all rows, which the adaptive join splits, since the other side has one row for each.
    """
    rows = pages.select("page_id", "url", "html").mapInArrow(kernel.freed(_digests), "page_id long, url string, html string, payload_digest string, payload_bytes long")
    keys = pages.select("page_id", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where(F.octet_length("html") >= min_payload_bytes)
    firsts = keys.groupBy(F.sha1(F.col("html").cast("binary")).alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    key = F.when(F.col("payload_bytes") >= min_payload_bytes, F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    joined = rows.withColumn("key", key).join(firsts, "key", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    written = joined.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to")).mapInArrow(kernel.freed(_writer(root, archive_bytes)), "archive string, records long, bytes long")
    return storage.save(written, "manifest")


_READ = "archive string, start long, stop long, problem string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _rows(path: str, data: bytes, want_payload: bool) -> Iterator[pa.RecordBatch]:
    rows = []
    for what, start, stop, found in salvage(data):
        if what == "gap":
            rows.append((path, start, stop, found, None, None, None, None, None, None, None))
        else:
            headers, block = found
            payload = payload_of(block)
            revisit = headers["warc-type"] == "revisit"
            page, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
            rows.append((
                path, start, stop, None, int(page) if page is not None else None, headers.get("warc-target-uri"), headers["warc-type"],
                headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload),
                int(headers.get("x-payload-length", 0)) if revisit else len(payload),
                int(first) if first is not None else None, payload if want_payload and not revisit else None,
            ))
        if len(rows) >= 2000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _reader(want_payload: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from _rows(path, content.as_py(), want_payload)

    return run


def _listed(root: str):
    """Rows of the archives that a manifest names."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                yield from _rows(name, data, False)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def read(spark, root: str, want_payload: bool = False) -> DataFrame:
    """Records and gaps of all archives under a folder; `problem` is null for records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return files.select("path", "content").mapInArrow(kernel.freed(_reader(want_payload)), _READ)


def round_trip(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and compare how many."""
    spark = pages.sparkSession
    root = storage.fresh_path(spark, "warc")
    manifest = write(pages, root, min_payload_bytes)
    archives = manifest.count()
    found = storage.save(manifest.repartition(max(1, archives)).mapInArrow(kernel.freed(_listed(root)), _READ).drop("payload"), "archived")
    written = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    read_back = found.agg(F.count_if(F.col("problem").isNull()).alias("records"), F.count_if(F.col("problem").isNotNull()).alias("gaps")).first()
    if read_back["records"] != written or read_back["gaps"]:
        raise RuntimeError(f"{written} records were written, {read_back['records']} read back, with {read_back['gaps']} gaps")
    storage.remove(spark, root)
    storage.drop(manifest)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
