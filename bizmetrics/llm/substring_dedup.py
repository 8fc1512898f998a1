"""Substring dedup with a count-min prefilter.

A window is ``width`` consecutive words of a document. Every word goes that is covered by a window whose words also start earlier:
in a smaller document, or earlier in the same one. Windows are judged on the input.

1. The ids and texts are written to the shared folder; a file of that copy and a row's number in it name the row from now on.
2. Every task makes count-min sketches of its windows: in each of ``DEPTH`` rows the cells that occur, and which occur more than
   once. A sketch covers ``SKETCH_WINDOWS`` windows at most and is cut into slices of the cell space.
3. The sketches of a slice are merged in one task. Each sketch gets back those of its cells whose merged count is 2 or more.
4. A second pass over the texts keeps the windows whose smallest cell is repeated: all that are, and a few that collide. Only
   these are grouped, exactly, by 128 bits of their words. Within a sketch's reach one occurrence of each goes on, the others have
   an earlier one already, so a window that a third of all documents hold is one entry per sketch.
5. Each file gets the windows to remove, and a last pass cuts the words.

The cell space grows with the text, so the share of colliding windows stays the same at every size. Every sketch has an entry per
slice: slices first grow wider with the text and then more, so these entries are few and long, and a merging task's memory is
bounded. No sketch is ever whole in one place, nothing is broadcast and nothing reaches the driver but the number of bytes. What is
shuffled is about 3 bytes per window and 24 per repeated one, never a text. A pass over a file looks up one sketch's cells at a time
and the windows to remove once per piece of text, so its time does not depend on how the table is dealt into files.

Defined results: null and blank texts have no words (0, 0, null text stays null, blank becomes empty); a null id comes first; rows with
the same id are ordered by a hash of their text, and rows that agree in both are one document, all cut alike; a text of
fewer than ``width`` words stays; an untouched text is its words joined by one space as well; an empty table gives no rows; ids
are integers; other columns stay as they are, except those named ``n_words``, ``n_removed`` and ``kept_text``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as arrow_dataset
import pyarrow.fs as arrow_fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm.files import locate, output_folder
from bizmetrics.llm.hashing import Piece, mix, pieces
from bizmetrics.llm.text import rows_per_batch

WIDTH = 20
#: Rows of the sketch: a window's count is estimated by the least of as many cells.
DEPTH = 2
#: Cells per row of the sketch, per byte of text (a window starts about every six bytes).
CELLS_PER_BYTE = 0.5
#: Windows that a sketch covers, and that a task holds, at most (a longer document is a sketch of its own).
SKETCH_WINDOWS = 1 << 21
#: Text that a task which groups windows, or merges a slice, answers for. Beyond ``SLICES`` slices those grow wider first, up to
#: ``WIDEST_SLICE_BYTES`` (a table of 64 MB).
SLICE_BYTES = 1 << 24
WIDEST_SLICE_BYTES = 1 << 27
SLICES = 1 << 6
_TEXTS_PER_BATCH = 256
_ROWS_PER_BATCH, _BYTES_PER_BATCH = 1024, 1 << 22

#: Per lane the base of a polynomial over words, modulo 2^64; 5 modulo 8, so its powers differ in a low bit.
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a lane's base, and those of its inverse."""
    if lane not in _powers or len(_powers[lane][0]) < n:
        steps = [np.full(n, b, np.uint64) for b in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64))]
        for s in steps:
            s[:1] = 1
        _powers[lane] = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _powers[lane]


class _Windows:
    """The windows of a piece of texts."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, first: int, width: int) -> None:
        self.words, self.offsets, self.first, self.width = words, offsets, first, width
        self.per_text = np.maximum(np.diff(offsets) - width + 1, 0)
        self.bounds = np.append(0, np.cumsum(self.per_text))  # windows of text i are bounds[i] .. bounds[i + 1]

    def __len__(self) -> int:
        return int(self.bounds[-1])

    @cached_property
    def at(self) -> np.ndarray:
        """First words, as numbers in the piece."""
        return np.arange(len(self)) + np.repeat(self.offsets[:-1] - self.bounds[:-1], self.per_text)

    def texts_and_starts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their texts, as numbers in the batch, and first words, as numbers in the text."""
        text = np.repeat(np.arange(len(self.per_text)), self.per_text)[some]
        return text + self.first, self.at[some] - self.offsets[text]

    def hashes(self, lane: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The two lanes are independent."""
        at, n = self.at[some], len(self.words)
        powers, inverse = _powers_of(lane, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * powers[:n], out=sums[1:])
        return mix((sums[at + self.width] - sums[at]) * inverse[at])


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes + np.uint64(row)) >> np.uint64(64 - bits)


def _windows(column: pa.Array, width: int) -> Iterator[_Windows]:
    """Of each piece of a text column with a window its windows."""
    for piece in pieces(column):
        found = _Windows(piece.word_hashes(), piece.offsets, piece.first, width)
        if len(found):
            yield found


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack_cells(cells: np.ndarray) -> bytes:
    """Ascending cells as zstd-compressed gaps."""
    gaps = np.diff(cells, prepend=np.uint64(0))
    size = 2 if not len(gaps) or int(gaps.max()) < 1 << 16 else 8
    return bytes([size]) + _zstd()[0].compress(gaps.astype(f"<u{size}").tobytes())


def _unpack_cells(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_zstd()[1].decompress(packed[1:]), f"<u{packed[0]}").astype(np.uint64), dtype=np.uint64)


def _arrow_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded length and size: a batch of its own costs more than most rows."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= _ROWS_PER_BATCH or size >= _BYTES_PER_BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


#: A sketch is named by its file and the row that it begins at.
_SKETCH = pa.schema(
    [("slice", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("cells", pa.binary()), ("repeated", pa.binary())]
)


def _sketches(batches: Iterator[pa.RecordBatch], *, width: int, bits: int, slice_bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """From (file, row, id, text): per sketch, row of the sketch and slice the cells, and which of them occur more than once.

    A slice's number starts with the sketch's row. A text's windows are all in one sketch.
    """
    held: list[np.ndarray] = []
    here, start, count = None, None, 0

    def sketch() -> Iterator[tuple]:
        nonlocal held, count
        hashes = np.concatenate(held) if held else np.empty(0, np.uint64)
        held, count = [], 0
        for row in range(DEPTH if len(hashes) else 0):
            cells, times = np.unique(_cells(hashes, row, bits), return_counts=True)
            in_slice = cells >> np.uint64(bits - slice_bits)
            starts = np.flatnonzero(np.append(True, in_slice[1:] != in_slice[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(cells))):
                number = row << slice_bits | int(in_slice[a])
                local = cells[a:b] - (in_slice[a] << np.uint64(bits - slice_bits))
                yield number, here, start, _pack_cells(local), np.packbits(times[a:b] > 1).tobytes()

    def rows() -> Iterator[tuple]:
        nonlocal here, start, count
        for batch in batches:
            files, places = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b in _file_runs(files):
                if files[a] != here:
                    yield from sketch()
                    here = files[a]
                for found in _windows(batch.column(3).slice(a, b - a), width):
                    if not held:
                        start = int(places[a + found.first])
                    held.append(found.hashes(0))
                    count += len(found)
                    if count >= most:
                        yield from sketch()
        yield from sketch()

    yield from _arrow_batches(rows(), _SKETCH)


_CELLS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("slice", pa.int64()), ("cells", pa.binary())])


def _merge_slices(batches: Iterator[pa.RecordBatch], *, local_bits: int) -> Iterator[pa.RecordBatch]:
    """From the sketches, ordered by slice: each one's cells whose count over all sketches of the slice is 2 or more.

    A slice's sketches wait, packed, until its counts are complete.
    """
    here, waiting = None, []
    counts = np.zeros(1 << local_bits, np.uint8)

    def answers() -> Iterator[tuple]:
        nonlocal waiting
        for file, start, packed in waiting:
            cells = _unpack_cells(packed)
            cells = cells[counts[cells.astype(np.int64)] > 1]
            if len(cells):
                yield file, start, here, _pack_cells(cells)
        waiting = []

    def rows() -> Iterator[tuple]:
        nonlocal here
        for batch in batches:
            for number, file, start, packed, repeated in zip(*[c.to_pylist() for c in batch.columns]):
                if number != here:
                    yield from answers()
                    here = number
                    counts[:] = 0
                cells = _unpack_cells(packed).astype(np.int64)
                once_or_twice = 1 + np.unpackbits(np.frombuffer(repeated, np.uint8), count=len(cells))
                counts[cells] = np.minimum(counts[cells] + once_or_twice, 2)
                waiting.append((file, start, packed))
        yield from answers()

    yield from _arrow_batches(rows(), _CELLS)


def _mail(rows: DataFrame, name: str) -> str:
    """Rows with a column ``file``, written so that the readers of a file find its own: the folder."""
    folder = output_folder(rows.sparkSession, name)
    rows.repartition("file").write.partitionBy("file").parquet(folder)
    return folder


def _letters(folder: str, file: str, columns: list[str]) -> pa.Table | None:
    """The rows mailed to a file, or None."""
    system, path = locate(f"{folder}/file={file}")
    if system.get_file_info(path).type != arrow_fs.FileType.Directory:
        return None
    return arrow_dataset.dataset(path, format="parquet", filesystem=system).to_table(columns=columns)


class _Cells:
    """A set of cells, ascending. Those with the same leading bits are next to each other, a few at most."""

    def __init__(self, cells: np.ndarray, bits: int) -> None:
        lead_bits = min(bits, len(cells).bit_length(), 23)
        self.cells, self.shift = cells, np.uint64(bits - lead_bits)
        self.ends = np.zeros((1 << lead_bits) + 1, np.uint32)
        np.cumsum(np.bincount((cells >> self.shift).astype(np.int64), minlength=1 << lead_bits), out=self.ends[1:])

    def holds(self, cells: np.ndarray) -> np.ndarray:
        found = np.zeros(len(cells), bool)
        lead = (cells >> self.shift).astype(np.int64)
        at, end = self.ends[lead], self.ends[1:][lead]
        some = np.flatnonzero(at < end)
        at, end, wanted = at[some].astype(np.int64), end[some], cells[some]
        while len(some):
            known = self.cells[at]
            found[some[known == wanted]] = True
            at += 1
            on = np.flatnonzero((known < wanted) & (at < end))
            some, at, end, wanted = some[on], at[on], end[on], wanted[on]
        return found


class _Repeated:
    """The repeated cells of a file's sketches. They stay packed but for the sketch at hand."""

    def __init__(self, folder: str, file: str, bits: int, slice_bits: int) -> None:
        letters = _letters(folder, file, ["start", "slice", "cells"])
        self.bits, self.slice_bits, self.letters = bits, slice_bits, {}
        for start, number, packed in zip(*[c.to_pylist() for c in letters.columns]) if letters is not None else ():
            self.letters.setdefault(start, []).append((number, packed))
        self.starts = np.array(sorted(self.letters), np.int64)
        self.here, self.sets = None, []

    def ranges(self, rows: np.ndarray) -> Iterator[tuple[int, int, list[_Cells]]]:
        """Of ascending rows those of each sketch, and per row of the sketch its cells.

        A sketch without repeated cells has no letter. Its rows get the cells of the one before, none of which they have.
        """
        a, b = np.searchsorted(self.starts, rows[[0, -1]], "right") - 1
        for k in range(max(a, 0), b + 1):
            first = np.searchsorted(rows, self.starts[k]) if k > a else 0
            last = np.searchsorted(rows, self.starts[k + 1]) if k < b else len(rows)
            yield int(first), int(last), self._sketch(int(self.starts[k]))

    def _sketch(self, start: int) -> list[_Cells]:
        if start != self.here:
            found: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in range(DEPTH)]
            self.here, self.sets = start, []
            for number, packed in sorted(self.letters[start]):
                row, part = divmod(number, 1 << self.slice_bits)
                found[row].append(_unpack_cells(packed) + np.uint64(part << self.bits - self.slice_bits))
            self.sets = [_Cells(np.concatenate(cells), self.bits) for cells in found]
        return self.sets


#: A candidate window is its words' key and its start; a document of candidates is its id, a digest of its text, its row in the file and
#: the number of its windows.
_PLACE = np.dtype([("id", "<i8"), ("digest", "<u8"), ("row", "<u4"), ("n", "<u4")])
_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
_GROUPED = pa.schema([("bucket", pa.int64()), ("file", pa.string()), ("keys", pa.binary()), ("starts", pa.binary()), ("docs", pa.binary())])
_REMOVED = pa.schema([("file", pa.string()), ("rows", pa.binary()), ("starts", pa.binary())])


def _later(keys: np.ndarray, docs: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows have an earlier one of equal words among these. ``doc`` is each window's place in ``docs``."""
    # Documents by id, then digest; those equal in both are one document.
    ranked = np.lexsort((docs["digest"], docs["id"]))
    steps = (docs["id"][ranked[1:]] != docs["id"][ranked[:-1]]) | (docs["digest"][ranked[1:]] != docs["digest"][ranked[:-1]])
    rank = np.empty(len(docs), np.uint64)
    rank[ranked] = np.append(False, steps).cumsum()[: len(docs)]
    a, b = np.ascontiguousarray(keys["a"]), keys["b"]
    order = np.argsort(a)
    same = a[order[1:]] == a[order[:-1]]
    some = order[np.append(same, False) | np.append(False, same)]  # most windows are alone here
    later = np.zeros(len(keys), bool)
    if not len(some):
        return later
    a, b = a[some], b[some]
    if (b[1:] != b[:-1])[a[1:] == a[:-1]].any():  # keys that agree in one half only
        order = np.lexsort((b, a))
        some, a, b = some[order], a[order], b[order]
    place = rank[doc[some]] << np.uint64(32) | starts[some].astype(np.uint64)
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    lead = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(some))))
    later[some] = place != lead
    return later


def _digest(text: bytes, no_id: bool) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, person=b"null" if no_id else b"").digest(), "little")


_NO_ID = -(1 << 63)


def _candidates(
    batches: Iterator[pa.RecordBatch], *, folder: str, width: int, bits: int, slice_bits: int, bucket_bits: int, most: int
) -> Iterator[pa.RecordBatch]:
    """From (file, row, id, text): the windows estimated to be repeated, packed by bucket of their key.

    Of equal windows that are held together only the first goes on. The others are known to be later: they go to a bucket below 0,
    whose windows are removed whatever the others say.
    """
    held: list[tuple] = []
    owners: list[tuple] = []
    here, count, cells = None, 0, None

    def hand_on() -> Iterator[tuple]:
        nonlocal held, owners, count
        if not held:
            return
        keys, starts, doc = (np.concatenate(c) for c in zip(*held))
        docs = np.array([(*owner, 0) for owner in owners], _PLACE)
        held, owners, count = [], [], 0
        bucket = (keys["a"] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
        later = _later(keys, docs, doc, starts)
        if later.any():
            aside = -1 - zlib.crc32(here.encode()) % (1 << bucket_bits)
            yield aside, here, b"", starts[later].tobytes(), _runs(docs, doc[later])
        stay = np.flatnonzero(~later)
        stay = stay[np.argsort(bucket[stay], kind="stable")]
        edges = np.flatnonzero(np.append(True, bucket[stay][1:] != bucket[stay][:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(stay))):
            part = stay[a:b]
            yield int(bucket[part[0]]), here, keys[part].tobytes(), starts[part].tobytes(), _runs(docs, doc[part])

    def rows() -> Iterator[tuple]:
        nonlocal here, cells, count
        for batch in batches:
            files = batch.column(0).to_pylist()
            places, ids = batch.column(1).to_numpy(), batch.column(2)
            texts = batch.column(3).cast(pa.large_binary())
            for a, b in _file_runs(files):
                if files[a] != here:
                    yield from hand_on()
                    here = files[a]
                    cells = _Repeated(folder, here, bits, slice_bits)
                for found in _windows(batch.column(3).slice(a, b - a), width):
                    hashes, hits = found.hashes(0), []
                    own = places[a + found.first : a + found.first + len(found.per_text)]
                    for first, last, sets in cells.ranges(own):
                        hit = np.arange(found.bounds[first], found.bounds[last])
                        for row, of_row in enumerate(sets):
                            hit = hit[of_row.holds(_cells(hashes[hit], row, bits))]
                        hits.append(hit)
                    hit = np.concatenate(hits) if hits else np.empty(0, np.int64)
                    if not len(hit):
                        continue
                    keys = np.empty(len(hit), _KEY)
                    keys["a"], keys["b"] = hashes[hit], found.hashes(1, hit)
                    of_hit, starts = found.texts_and_starts(hit)
                    of_hit += a
                    change = np.append(True, of_hit[1:] != of_hit[:-1])
                    held.append((keys, starts.astype(np.uint32), np.cumsum(change) - 1 + len(owners)))
                    for i in of_hit[change].tolist():
                        known = ids[i].as_py()
                        owners.append((_NO_ID if known is None else known, _digest(texts[i].as_py(), known is None), places[i]))
                    count += len(keys)
                    if count >= most:
                        yield from hand_on()
        yield from hand_on()

    yield from _arrow_batches(rows(), _GROUPED)


def _file_runs(files: list[str]) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[start]:
            yield start, i
            start = i


def _runs(docs: np.ndarray, doc: np.ndarray) -> bytes:
    """Documents of neighbouring windows, each once with its number of windows."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    found = docs[doc[first]]
    found["n"] = np.diff(np.append(first, len(doc)))
    return found.tobytes()


def _group_exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the candidates, ordered by bucket: per file the windows that have an earlier one of equal words."""
    here, held = None, []

    def group() -> Iterator[tuple]:
        nonlocal held
        if not held:
            return
        files, keys, starts, docs = zip(*held)
        held = []
        ends = np.cumsum([len(k) for k in keys])
        keys, starts, docs = np.concatenate(keys), np.concatenate(starts), np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), docs["n"])
        later = _later(keys, docs, doc, starts)
        for file, a, b in zip(files, np.append(0, ends), ends):
            gone = np.flatnonzero(later[a:b]) + a
            if len(gone):
                yield file, docs["row"][doc[gone]].tobytes(), starts[gone].tobytes()

    def rows() -> Iterator[tuple]:
        nonlocal here
        for batch in batches:
            for bucket, file, keys, starts, docs in zip(*[c.to_pylist() for c in batch.columns]):
                starts, docs = np.frombuffer(starts, "<u4"), np.frombuffer(docs, _PLACE)
                if bucket < 0:
                    yield file, np.repeat(docs["row"], docs["n"]).tobytes(), starts.tobytes()
                    continue
                if bucket != here:
                    yield from group()
                    here = bucket
                held.append((file, np.frombuffer(keys, _KEY), starts, docs))
        yield from group()

    yield from _arrow_batches(rows(), _REMOVED)


def _removed_windows(folder: str, file: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows and starts of a file's windows to remove, by row."""
    letters = _letters(folder, file, ["rows", "starts"])
    if letters is None:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    rows, starts = (np.concatenate([np.frombuffer(b, "<u4") for b in letters[c].to_pylist()]) for c in ("rows", "starts"))
    order = np.argsort(rows, kind="stable")
    return rows[order], starts[order]


def _kept(piece: Piece, texts: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Per text of a piece the words removed and the bytes kept, and all those bytes; from the removed windows' texts and starts."""
    n = len(piece.starts)
    begun = np.zeros(n + 1, np.int64)
    begun[piece.offsets[texts] + starts + 1] = 1
    np.cumsum(begun, out=begun)  # removed windows that start before a word
    stays = begun[1:] == begun[np.maximum(np.arange(1, n + 1) - width, 0)]
    words = np.flatnonzero(stays)
    before = np.append(0, np.cumsum(stays))[piece.offsets]  # kept words before each text
    # A word's end is followed by white space unless it is the last of a text; one byte of that stays, as a space.
    spaced = np.ones(len(words), bool)
    spaced[before[1:][before[1:] > before[:-1]] - 1] = False
    first, end = piece.starts[words], piece.ends[words]
    data = piece.data.copy()
    data[end[spaced]] = 32
    inside = np.zeros(len(data) + 2, np.int8)
    inside[first] += 1
    inside[end + spaced] -= 1
    sizes = np.append(0, np.cumsum(end + spaced - first))[before]
    return np.diff(piece.offsets) - np.diff(before), np.diff(sizes), data[np.cumsum(inside[: len(data)], dtype=np.int8).view(bool)].tobytes()


def _cut(batches: Iterator[pa.RecordBatch], *, folder: str, width: int, text_at: int) -> Iterator[pa.RecordBatch]:
    """From (file, row, other columns): the other columns with n_words, n_removed and kept_text."""
    here, gone = None, None
    for batch in batches:
        files, rows, column = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.uint32), batch.column(text_at)
        counts, cuts, sizes, kept = [], [], [], []
        for a, b in _file_runs(files):
            if files[a] != here:
                here = files[a]
                gone = _removed_windows(folder, here)
            for piece in pieces(column.slice(a, b - a)):
                n = len(piece.offsets) - 1
                own = rows[a + piece.first : a + piece.first + n]
                low, high = (np.searchsorted(gone[0], own, side) for side in ("left", "right"))
                texts = np.repeat(np.arange(n), high - low)
                ends = np.cumsum(high - low)
                which = np.arange(len(texts)) + np.repeat(low - (ends - (high - low)), high - low)
                removed, size, text = _kept(piece, texts, gone[1][which], width)
                counts.append(np.diff(piece.offsets))
                cuts.append(removed)
                sizes.append(size)
                kept.append(text)
        counts, cuts, sizes = (np.concatenate([np.empty(0, np.int64), *c]) for c in (counts, cuts, sizes))
        offsets = pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64))
        text = pa.LargeStringArray.from_buffers(len(batch), offsets, pa.py_buffer(b"".join(kept)))
        text = pc.if_else(column.is_valid(), text.cast(pa.string()), pa.scalar(None, pa.string()))
        columns = [pa.array(counts, pa.int64()), pa.array(cuts, pa.int64()), text]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], [*batch.schema.names[2:], "n_words", "n_removed", "kept_text"])


def substring_dedup(
    docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, sketch_windows: int = SKETCH_WINDOWS
) -> DataFrame:
    """``docs`` with n_words, n_removed (words covered by a window that also starts earlier) and kept_text.

    ``sketch_windows`` bounds what a task holds at once; it does not change the result.
    """
    if width < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    plain = docs.drop("n_words", "n_removed", "kept_text")
    # Under names that no column of the table can clash with.
    named = {c: f"c{i}" for i, c in enumerate(plain.columns)}
    copy = cut_lineage(plain.select(*[F.col(f"`{c}`").alias(name) for c, name in named.items()]))
    id_column, text = named[id_column], named[text]
    total = copy.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = max(16, math.ceil(math.log2(max(1, total) * CELLS_PER_BYTE)))
    bucket_bits = min(bits - 12, max(0, math.ceil(math.log2(max(1, total) / SLICE_BYTES))))
    slice_bits = min(bucket_bits, max(math.ceil(math.log2(SLICES)), math.ceil(math.log2(max(1, total) / WIDEST_SLICE_BYTES))))
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    texts = copy.select(*place, F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("body"))

    def grouped(rows: DataFrame, by: str, parts: int) -> DataFrame:
        number = F.when(F.col(by) < 0, -1 - F.col(by)).otherwise(F.col(by)).cast("int")
        return rows.repartitionById(parts, number).sortWithinPartitions(by)

    def ddl(schema: pa.Schema) -> str:
        kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
        return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)

    with rows_per_batch(spark, _TEXTS_PER_BATCH):
        sketches = texts.mapInArrow(partial(_sketches, width=width, bits=bits, slice_bits=slice_bits, most=sketch_windows), ddl(_SKETCH))
        merge = partial(_merge_slices, local_bits=bits - slice_bits)
        cells = _mail(grouped(sketches, "slice", DEPTH << slice_bits).mapInArrow(merge, ddl(_CELLS)), "cells")
        find = partial(
            _candidates, folder=cells, width=width, bits=bits, slice_bits=slice_bits, bucket_bits=bucket_bits, most=sketch_windows
        )
        candidates = texts.mapInArrow(find, ddl(_GROUPED))
        removed = _mail(grouped(candidates, "bucket", 1 << bucket_bits).mapInArrow(_group_exactly, ddl(_REMOVED)), "removed")
    kinds = ", ".join(f"{c} {kind}" for c, kind in copy.dtypes)
    cut = partial(_cut, folder=removed, width=width, text_at=2 + copy.columns.index(text))
    done = copy.select(*place, *copy.columns).mapInArrow(cut, f"{kinds}, n_words long, n_removed long, kept_text string")
    return done.toDF(*plain.columns, "n_words", "n_removed", "kept_text")
