"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges to tasks; a task scans its
range for gzip magic, accepts a candidate only if it decodes to a WARC version line and complete
headers, of whatever length, and owns the records that start inside its range, reading past its end
for the last one. It fails if their number isn't the number that the manifest's starts give its range.

Files go to the folder that Spark shares, through pyarrow's file systems, each under a name that
only its task attempt uses; readers take the names that the written manifest holds, so that files
of lost or repeated attempts are never read.

Cases: null html is an empty payload; urls, headers and payloads may have any length, and a record is
held by one task. Equal payloads with one page_id that is the largest are all
response; a null page_id is never a target and, with an equal payload elsewhere, revisits. Empty
tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize, scratch_path

#: Payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 0
#: Bytes of a split, and the most splits that a task reads one after the other.
SPLIT, SPLITS_A_TASK = 4 << 20, 64
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
#: Bytes that a candidate's headers are decoded by.
_PIECE = 1 << 16

FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, name: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{name}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{name}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{name}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + packer.flush()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html, refers_to); returns the manifest (path, size, records, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name, starts, size = f"pages-{uuid.uuid4().hex}.warc.gz", array("q"), 0
        out = None
        for batch in batches:
            html = pc.fill_null(batch.column("html"), "").cast(pa.binary())
            for i in range(batch.num_rows):
                payload = html[i].as_py()
                out = out or files.open_output_stream(f"{root}/{name}", compression=None)
                data = record(batch.column("page_id")[i].as_py(), batch.column("url")[i].as_py(), payload, digest(payload), batch.column("refers_to")[i].as_py())
                out.write(data)
                starts.append(size)
                size += len(data)
        if out:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([len(starts)], pa.int64()), pa.array([starts], pa.list_(pa.int64()))], names=["path", "size", "records", "starts"])

    return materialize(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, size long, records long, starts array<long>"), "manifest")


def _headers(text: bytes) -> dict[str, str] | None:
    """Names in lower case; None if ``text`` doesn't begin a WARC record."""
    lines = text.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    pairs = [x.partition(b":") for x in lines[1:] if x]
    if not all(sep for _, sep, _ in pairs):
        return None
    return {k.decode("ascii", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


class _Source:
    """Bytes of a file from a place on, read in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, place: int, n: int = _READ) -> bytes:
        self.file.seek(place)
        return self.file.read(min(n, self.size - place))


def _begins(source: _Source, place: int) -> bool:
    """Whether a gzip member that decodes to WARC headers starts at ``place``."""
    decoder, text, at, stop = zlib.decompressobj(31), bytearray(), place, -1
    try:
        while stop < 0 and not decoder.eof:
            data = decoder.unconsumed_tail or source.at(at, 1 << 12)
            if not data:
                break
            at += 0 if decoder.unconsumed_tail else len(data)
            known = len(text)
            text += decoder.decompress(data, _PIECE)
            if len(text) >= 7 and not text.startswith(b"WARC/1."):
                return False
            stop = text.find(b"\r\n\r\n", max(0, known - 3))
    except zlib.error:
        return False
    head = bytes(text[: max(0, stop)])
    return stop >= 0 and (found := _headers(head)) is not None and "warc-type" in found and found.get("content-length", "").isdigit()


def _member(source: _Source, place: int) -> tuple[bytes, int]:
    """The decoded member at ``place`` and the place after it."""
    decoder, parts, at = zlib.decompressobj(31), [], place
    while not decoder.eof:
        data = source.at(at)
        if not data:
            raise ValueError("archive ends inside a record")
        parts.append(decoder.decompress(data))
        at += len(data)
    return b"".join(parts), at - len(decoder.unused_data)


def records_in(source: _Source, start: int, end: int) -> Iterator[bytes]:
    """Decoded records whose members start in [start, end)."""
    place = start
    while place < min(end, source.size):
        # a candidate may begin at the last byte of a piece, so pieces overlap by two
        window = source.at(place, min(_READ, end - place) + 2)
        found = window.find(MAGIC)
        if found < 0:
            place += max(1, len(window) - 2)
        elif place + found >= end:
            return
        elif not _begins(source, place + found):
            place += found + 1
        else:
            text, place = _member(source, place + found)
            yield text


def parsed(text: bytes) -> tuple:
    """A row of FIELDS. A revisit's payload size is in the HTTP headers that it repeats."""
    head, _, rest = text.partition(b"\r\n\r\n")
    names = _headers(head) or {}
    block = rest[: int(names["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page, refers = names.get("x-page-id"), names.get("x-refers-to-page-id")
    return page and int(page), names.get("warc-target-uri"), names["warc-type"], size, names["warc-payload-digest"].removeprefix("sha1:"), refers and int(refers), payload if names["warc-type"] == "response" else None


def read_archives(spark: SparkSession, manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """Every record of the archives in ``manifest`` (path, size, starts), with its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in FIELDS.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split(" ")[1]] for x in FIELDS.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for part in batch.to_pylist():
                files, path = _filesystem(part["path"])
                rows, held, read = [], 0, 0
                with files.open_input_file(path) as file:
                    for text in records_in(_Source(file, part["size"]), part["start"], part["start"] + split):
                        rows.append(parsed(text))
                        read += 1
                        held += len(text)
                        if held > _READ * 16:
                            yield made(rows)
                            rows, held = [], 0
                if read != part["records"]:
                    raise ValueError(f"{read} records read of {part['records']} in {part['path']} from {part['start']}")
                if rows:
                    yield made(rows)

    splits = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    starts = manifest.select("path", F.explode("starts").alias("at")).groupBy("path", (F.col("at") - F.col("at") % split).alias("start")).agg(F.count("*").alias("records"))
    splits = splits.join(starts, ["path", "start"], "left").fillna(0, "records")
    # a split is a tiny row, so the number of tasks follows from the archives' bytes, not from Spark's
    total = manifest.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 0
    tasks = max(min(total, 8 * spark.sparkContext.defaultParallelism), -(-total // SPLITS_A_TASK), 1)
    return splits.repartition(int(tasks)).mapInArrow(run, FIELDS)


def deduplicated(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Adds refers_to: the largest page_id with an equal payload, where that is another page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload).alias("name"), F.octet_length(payload).alias("n"))
    large = rows.where(F.col("n") >= least)
    groups = materialize(large.groupBy("name").agg(F.max("page_id").alias("target"), F.count("*").alias("c")).where("c > 1 and target is not null").select("name", "target"), "payloads")
    joined = attach(rows, groups, "name")
    other = ~F.col("page_id").eqNullSafe(F.col("target")) & F.col("target").isNotNull() & (F.col("n") >= least)
    return joined.select("page_id", "url", "html", F.when(other, F.col("target")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives and reads them back: the records, with their payloads."""
    spark = pages.sparkSession
    manifest = write_archives(deduplicated(pages), scratch_path(spark, "warc"))
    return read_archives(spark, manifest)
