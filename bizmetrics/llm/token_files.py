"""Token-id files: documents encoded by a public tokenizer, coded by ``range_coder`` and read back.

A file holds the documents of one range of ids, in ascending id order, as chunks of about ``CHUNK_IDS`` ids that end
with a document: magic, length of the document table, the table (ids, lengths), then the coded ids. Files and chunks
have a manifest with their sums, from which every document's absolute position follows without reading a file.

Text is cut at ASCII white space before it reaches the tokenizer, whose own pre-tokenizer never joins text across white
space, and the ids of each different word are kept, so a frequent word is tokenized once per worker.

Defined results: null and empty texts are the end id alone; null ids come first; rows with equal ids stand side by
side in order of their text's hash; an empty table writes no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm.files import output_folder, read_part, whole_file
from bizmetrics.llm.range_coder import pack_chunk, unpack_chunk
from bizmetrics.llm.text import rows_per_batch

MAGIC = b"IDCHUNK1"
CHUNK_IDS = 1 << 22
KEPT_WORDS = 200_000  # words of one generation; a worker keeps two
READ_BYTES = 1 << 23  # coded bytes that one task reads, about
TEXTS_AT_ONCE = 500  # texts that a task gets from Spark and tokenizes together
BETWEEN = "<|endoftext|>"  # a special token of the tokenizer
MANIFEST = "file string, part int, chunk int, offset long, length long, n_docs long, n_ids long"


class WordEncoder:
    """Ids of texts as bytes of little-endian 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # bytes.split: space, \\t, \\n, \\v, \\f, \\r
        split = [(text or "").encode().split() for text in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) > KEPT_WORDS and new:  # a cache, not a limit on words: those in use come over from the older one
            self.older, self.known = self.known, {}
            new = set().union(*split)
        known = self.known
        if again := new.intersection(self.older):
            known.update((word, self.older[word]) for word in again)
            new -= again
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _learn(self, words: list[bytes]) -> None:
        """Tokenize many words in few calls: with a special token between them, whose id marks where each word ends."""
        plain = [w for w in words if b"<|" not in w]
        for start in range(0, len(plain), 512):
            some = plain[start : start + 512]
            joined = BETWEEN.join(w.decode() for w in some) + BETWEEN
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.between)
            for word, begin, end in zip(some, np.concatenate([[0], ends[:-1] + 1]).tolist(), ends.tolist()):
                self.known[word] = ids[begin:end].tobytes()
        for word in words:
            if b"<|" in word:
                found = self.tokenizer.encode(word.decode(), add_special_tokens=False)
                self.known[word] = np.array(found.ids, "<u4").tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _document_table(ids: list[int | None], lengths: list[int]) -> bytes:
    known = np.array([i is not None for i in ids], np.uint8)
    numbers = np.array([i or 0 for i in ids], "<i8")
    return zlib.compress(struct.pack("<Q", len(ids)) + known.tobytes() + numbers.tobytes() + np.array(lengths, "<i8").tobytes(), 1)


def _read_table(data: bytes) -> tuple[list[int | None], np.ndarray]:
    plain = zlib.decompress(data)
    (n,) = struct.unpack_from("<Q", plain)
    known = np.frombuffer(plain, np.uint8, n, 8)
    numbers = np.frombuffer(plain, "<i8", n, 8 + n)
    return [int(i) if k else None for i, k in zip(numbers, known)], np.frombuffer(plain, "<i8", n, 8 + 9 * n)


def _writer(folder: str, tokenizer: str, end_id: int):
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        rows = (
            row
            for batch in batches
            for some in (batch.slice(at, TEXTS_AT_ONCE) for at in range(0, batch.num_rows, TEXTS_AT_ONCE))
            for row in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()))
        )
        first = next(rows, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.ids"
        made = []
        with whole_file(name) as out:
            position, ids, lengths, texts, held = 0, [], [], [], 0

            def flush():
                nonlocal position, ids, lengths, texts, held
                table = _document_table(ids, lengths)
                joined, texts = b"".join(texts), []  # the texts' own ids are not kept beside the chunk's
                coded = pack_chunk(np.frombuffer(joined, "<u4"))
                chunk = MAGIC + struct.pack("<Q", len(table)) + table + coded
                out.write(chunk)
                made.append((name, part, len(made), position, len(chunk), len(ids), held))
                position, ids, lengths, texts, held = position + len(chunk), [], [], [], 0

            while first is not None:
                doc_id, coded = first
                coded += end
                ids.append(doc_id)
                lengths.append(len(coded) // 4)
                texts.append(coded)
                held += lengths[-1]
                if held >= CHUNK_IDS:
                    flush()
                first = next(rows, None)
            if ids:
                flush()
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["file", "part", "chunk", "offset", "length", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    return write


def write_ids(
    docs: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text: str = "text", end_id: int = 1, folder: str | None = None
) -> DataFrame:
    """Write the files; the manifest, one row per chunk, with ``start``: the ids of all chunks before it."""
    folder = folder or output_folder(docs.sparkSession, "token-ids")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    with rows_per_batch(docs.sparkSession, TEXTS_AT_ONCE):
        manifest = cut_lineage(ordered.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST))
    # One row per file meets in one task; chunks are summed inside their file.
    files = manifest.groupBy("part").agg(F.sum("n_ids").alias("file_ids"))
    before = F.sum("file_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", F.coalesce(before, F.lit(0)).alias("file_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("start", F.coalesce(inside, F.lit(0))).join(files, "part")
    return placed.withColumn("start", F.col("start") + F.col("file_start")).drop("file_start")


def read_chunk(file: str, offset: int, length: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and token ids of one chunk."""
    data = read_part(file, offset, length)
    if data[:8] != MAGIC:
        raise ValueError(f"{file} has no chunk at {offset}")
    (table_length,) = struct.unpack_from("<Q", data, 8)
    doc_ids, lengths = _read_table(data[16 : 16 + table_length])
    return doc_ids, lengths, unpack_chunk(data[16 + table_length :])


def read_ids(manifest: DataFrame, *, ids: bool = True) -> DataFrame:
    """Documents of the manifest's files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length, start in zip(*[c.to_pylist() for c in batch.columns]):
                doc_ids, lengths, tokens = read_chunk(file, offset, length)
                raw = tokens.astype("<u4")
                ends = np.cumsum(lengths)
                for at in range(0, len(doc_ids), 2_000):
                    some = range(at, min(at + 2_000, len(doc_ids)))
                    parts = [raw[ends[i] - lengths[i] : ends[i]] for i in some]
                    columns = [
                        pa.array([doc_ids[i] for i in some], pa.int64()),
                        pa.array([int(start + ends[i] - lengths[i]) for i in some], pa.int64()),
                        pa.array([int(lengths[i]) for i in some], pa.int64()),
                        pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                        pa.array([p.tolist() if ids else None for p in parts], pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
    # As many tasks as the coded bytes ask for, whatever the few rows of the manifest weigh.
    size = manifest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    chunks = manifest.select("file", "offset", "length", "start").repartition(1 + size // READ_BYTES)
    return chunks.mapInArrow(read, schema)
