"""WARC archives as seekable Zstandard bundles.

Each task writes one bundle: WARC records grouped into independent Zstandard frames of about ``frame_bytes``, then a
skippable frame with the record table (record id, frame, offset and length inside the frame), then the seek table of
the public seekable Zstandard format (compressed and plain size of each frame). Any record can be read by seeking to
its frame; any Zstandard reader can read the whole bundle.

Of records with equal payloads of at least ``revisit_bytes`` the one with the smallest id is a response and the others
are revisits without a body that refer to it; smaller payloads are always responses. Equal payloads are found by their
SHA-256, combined before the shuffle; only digests that occur twice or more are joined back, so a payload that a third
of all pages share is one row on that side.

Defined results: null html is an empty payload; null url leaves out the target; a null id is the id ``null`` and
revisits a payload that another id has; rows with the same id and payload are all responses if the id is the smallest;
an empty table writes no bundle; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm.files import locate, output_folder, read_part, whole_file

# Fixed values of the seekable Zstandard format.
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SKIPPABLE_RECORD_TABLE = 0x184D2A50
SEEKABLE_FOOTER = 0x8F92EAB1

PLACES = "page_id long, bundle string, frame int, frame_start long, frame_length long, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Compressed bytes that one task reads, about.
READ_BYTES = 1 << 23
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(
    pages: DataFrame, *, id_column: str = "page_id", html: str = "html", url: str = "url", revisit_bytes: int = 100
) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null for responses)."""
    body = F.coalesce(F.col(html), F.lit(""))
    hashed = pages.select(
        F.col(id_column).alias("page_id"),
        F.col(url).alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
    )
    large = hashed.where(F.col("payload_bytes") >= revisit_bytes).select("page_id", "payload_digest")
    shared = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    shared = cut_lineage(shared.where((F.col("copies") > 1) & F.col("first_id").isNotNull()).drop("copies"))
    joined = hashed.join(shared, "payload_digest", "left")
    return joined.withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    ).drop("first_id")


def record_bytes(page_id, url, html: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit has no body but names the length and digest of its payload."""
    body = b"" if refers_to is not None else html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(html)}",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if refers_to is None:
        lines.append("Content-Type: text/html; charset=utf-8")
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def split_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        first, *rest = plain[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in rest)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, plain[start:stop]
        at = stop + 4


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def _writer(folder: str, frame_bytes: int, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in _INPUT]))
        first = next(rows, None)
        if first is None:
            return
        bundle = f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        sizes: list[tuple[int, int]] = []
        places: list[tuple] = []
        with whole_file(bundle) as out:
            position, held, frame = 0, 0, []

            def flush():
                nonlocal position, held, frame
                packed = packer.compress(b"".join(record for _, record in frame))
                out.write(packed)
                offset = 0
                for page_id, record in frame:
                    places.append((page_id, bundle, len(sizes), position, len(packed), offset, len(record)))
                    offset += len(record)
                sizes.append((len(packed), offset))
                position, held, frame = position + len(packed), 0, []

            while first is not None:
                page_id, url, html, digest, refers_to = first
                record = record_bytes(page_id, url, html.encode(), digest, refers_to, date)
                if frame and held + len(record) > frame_bytes:
                    flush()
                frame.append((page_id, record))
                held += len(record)
                first = next(rows, None)
            flush()
            table = json.dumps([[p[0], p[2], p[5], p[6]] for p in places]).encode()
            out.write(_skippable(SKIPPABLE_RECORD_TABLE, packer.compress(table)))
            entries = b"".join(struct.pack("<II", *pair) for pair in sizes)
            out.write(_skippable(SKIPPABLE_SEEK_TABLE, entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE_FOOTER)))
        for start in range(0, len(places), 10_000):
            columns = list(zip(*places[start : start + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLACE_TYPES)], _PLACE_NAMES)

    return write


_INPUT = ["page_id", "url", "html", "payload_digest", "refers_to"]
_PLACE_NAMES = ["page_id", "bundle", "frame", "frame_start", "frame_length", "offset", "length"]
_PLACE_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def write_bundles(
    marked: DataFrame,
    *,
    folder: str | None = None,
    frame_bytes: int = 1 << 20,
    level: int = 3,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write the rows of ``mark_revisits`` in id order; one row per record with its place in the bundles."""
    folder = folder or output_folder(marked.sparkSession, "warc")
    system, path = locate(folder)
    system.create_dir(path, recursive=True)  # a folder without bundles is an empty archive
    ordered = marked.select(*_INPUT).repartitionByRange("page_id", "payload_digest")
    ordered = ordered.sortWithinPartitions("page_id", "payload_digest", "url")
    return cut_lineage(ordered.mapInArrow(_writer(folder, frame_bytes, level, date), PLACES))


def _footer(bundle: str, size: int) -> list[tuple[int, int]]:
    """Compressed and plain length of each frame, from the seek table at the end of a bundle of ``size`` bytes."""
    count, _, magic = struct.unpack("<IBI", read_part(bundle, size - 9, 9))
    if magic != SEEKABLE_FOOTER:
        raise ValueError(f"{bundle} has no seek table")
    return list(struct.iter_unpack("<II", read_part(bundle, size - 9 - 8 * count, 8 * count)))


def seek_table(bundle: str, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed length, plain length) of each frame of a bundle of ``size`` bytes."""
    frames, start = [], 0
    for packed, plain in _footer(bundle, size):
        frames.append((start, packed, plain))
        start += packed
    return frames


def record_table(bundle: str, size: int) -> list[tuple]:
    """(record id, frame, offset in the frame, length) of each record of a bundle of ``size`` bytes."""
    start = sum(packed for packed, _ in _footer(bundle, size))
    magic, length = struct.unpack("<II", read_part(bundle, start, 8))
    if magic != SKIPPABLE_RECORD_TABLE:
        raise ValueError(f"{bundle} has no record table")
    return [tuple(row) for row in json.loads(zstandard.ZstdDecompressor().decompress(read_part(bundle, start + 8, length)))]


def _bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, size) of the bundles in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.col("path").alias("bundle"), F.col("length").alias("size"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, frame, frame_start, frame_length) of every frame, read from the bundles' seek tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (bundle, number, start, packed)
                for bundle, size in zip(*[c.to_pylist() for c in batch.columns])
                for number, (start, packed, _) in enumerate(seek_table(bundle, size))
            ]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLACE_TYPES[1:5])], _PLACE_NAMES[1:5])

    return _bundles(spark, folder).mapInArrow(read, ", ".join(PLACES.split(", ")[1:5]))


def record_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where every record is (``PLACES``), read from the bundles' record and seek tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, size in zip(*[c.to_pylist() for c in batch.columns]):
                starts = seek_table(bundle, size)
                rows = [(i, bundle, frame, *starts[frame][:2], offset, length) for i, frame, offset, length in record_table(bundle, size)]
                columns = list(zip(*rows)) or [()] * len(_PLACE_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLACE_TYPES)], _PLACE_NAMES)

    return _bundles(spark, folder).mapInArrow(read, PLACES)


def _urn(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def parse_frame(packed: bytes) -> list[tuple]:
    """Records of one frame as tuples of RECORDS; a damaged payload is an error."""
    found = []
    for headers, body in split_records(zstandard.ZstdDecompressor().decompress(packed)):
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = headers["WARC-Type"]
        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        refers_to = _urn(headers["WARC-Refers-To"]) if kind == "revisit" else None
        length = int(headers["X-Payload-Length"])
        found.append((_urn(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, refers_to, length, digest, body))
    return found


def read_frames(wanted: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The records of some frames (bundle, frame_start, frame_length); bodies only if ``payloads``.

    Frames are dealt to as many tasks as their bytes ask for, whatever the few rows that name them weigh.
    """
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, start, length in zip(*[c.to_pylist() for c in batch.columns]):
                records = parse_frame(read_part(bundle, start, length))
                columns = [list(c) for c in zip(*records)]
                if not payloads:
                    columns[-1] = [None] * len(records)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    wanted = cut_lineage(wanted.select("bundle", "frame_start", "frame_length"))
    size = wanted.agg(F.coalesce(F.sum("frame_length"), F.lit(0))).first()[0]
    return wanted.repartition(1 + size // READ_BYTES).mapInArrow(read, RECORDS)


def read_bundles(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    """Every record of the bundles in a folder, found by their seek tables; bodies only if ``payloads``."""
    return read_frames(frames(spark, folder), payloads=payloads)


def read_records(spark: SparkSession, folder: str, ids: DataFrame, *, id_column: str = "page_id") -> DataFrame:
    """Records of the given ids alone, found by the bundles' record tables: only their frames are read."""
    wanted = ids.select(F.col(id_column).alias("page_id")).distinct()
    hit = record_places(spark, folder).join(wanted, "page_id", "left_semi")
    hit = hit.select("bundle", "frame_start", "frame_length").distinct()
    return read_frames(hit, payloads=True).join(wanted, "page_id", "left_semi")
