"""Adaptive context-mixing range coder for token ids, all blocks of a chunk side by side in numpy.

A block is ``BLOCK`` ids with its own adaptive state, reset at its start, so blocks decode independently. For every
id two contexts, the last id (order 1) and the last two (order 2), each predict the id that followed them last, with a
confidence from 1 to 3. The pair of confidences selects adaptive weights that mix three sources of probability: the
order-2 prediction, the order-1 prediction, and the order-0 distribution of the chunk (its frequency table). The mixed
interval drives a range coder with 64-bit low and range that writes 32-bit words; carries go back into the words
already written and are resolved at the end.

Encoder and decoder run the same model code step by step: step t handles the t-th id of every block at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LANES = 1024  # blocks side by side: bounds memory
CONTEXT_1, CONTEXT_2 = 11, 12  # bits of the context tables
TOTAL_BITS = 20  # the order-0 table sums to 2 ** TOTAL_BITS
MAX_ID = (1 << 19) - 1
_COUNTED = 1 << 18  # ids counted at once
_LOW_RANGE = np.uint64(1 << 32)
_32 = np.uint64(32)
_WORD = np.uint64((1 << 32) - 1)


class FrequencyTable:
    """Order-0 distribution: ids that occur, with integer weights of at least 1 that sum to 2 ** TOTAL_BITS."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        size = int(ids[-1]) + 1 if len(ids) else 1
        ends = np.cumsum(weights)
        self.start = np.zeros(size, np.uint64)
        self.width = np.zeros(size, np.uint64)
        self.start[ids] = ends - weights
        self.width[ids] = weights
        self.owner = np.repeat(ids, weights).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray) -> FrequencyTable:
        size = int(ids.max()) + 1
        counts = np.zeros(size, np.int64)
        for start in range(0, len(ids), _COUNTED):  # numpy counts a wider copy of its input
            counts += np.bincount(ids[start : start + _COUNTED], minlength=size)
        used = np.flatnonzero(counts)
        total = 1 << TOTAL_BITS
        if len(used) > total // 2:
            raise ValueError("too many different ids for the frequency table")
        weights = 1 + (counts[used] * (total - len(used)) // counts.sum()).astype(np.int64)
        weights[np.argmax(weights)] += total - weights.sum()
        return cls(used, weights)

    def pack(self) -> bytes:
        deltas = np.diff(self.ids, prepend=0).astype("<u4").tobytes()
        return zlib.compress(deltas + self.weights.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> FrequencyTable:
        both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(2, -1)
        return cls(np.cumsum(both[0]), both[1])


class _Model:
    """Adaptive state of some blocks side by side; 32-bit integers throughout."""

    def __init__(self, lanes: int):
        self.seen_1 = np.zeros(lanes << CONTEXT_1, np.int32)  # (id + 1) << 2 | confidence
        self.seen_2 = np.zeros(lanes << CONTEXT_2, np.int32)
        self.hit_2 = np.full(lanes * 16, 1 << 15, np.int32)  # chance of the order-2 prediction, of 2 ** 16
        self.hit_1 = np.full(lanes * 16, 1 << 14, np.int32)  # chance of the order-1 prediction, if order 2 fails
        lane = np.arange(lanes, dtype=np.int32)
        self.base_1, self.base_2, self.base_h = lane << CONTEXT_1, lane << CONTEXT_2, lane * 16

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        """Set the predictions and their shares of 2 ** 16 for the next id of the first len(last) blocks."""
        k = len(last)
        near = last * _MIX_1  # wraps around, as a hash may
        self.at_1 = (near >> 16 & (1 << CONTEXT_1) - 1) + self.base_1[:k]
        self.at_2 = (near + before * _MIX_2 >> 16 & (1 << CONTEXT_2) - 1) + self.base_2[:k]
        self.v1, self.v2 = self.seen_1.take(self.at_1), self.seen_2.take(self.at_2)
        self.id_1, self.id_2 = (self.v1 >> 2) - 1, (self.v2 >> 2) - 1
        self.sure_1, self.sure_2 = self.v1 & 3, self.v2 & 3
        self.at_h = (self.sure_2 << 2 | self.sure_1) + self.base_h[:k]
        self.p2, self.p1 = self.hit_2.take(self.at_h), self.hit_1.take(self.at_h)
        self.use_1 = (self.sure_1 > 0) & (self.id_1 != self.id_2)
        self.share_2 = self.p2 * (self.sure_2 > 0)
        # Both chances in 15 bits, so the product fits 31 bits; a share of 0 could not be coded.
        self.share_1 = np.maximum((65536 - self.share_2 >> 1) * (self.p1 >> 1) >> 14, 1) * self.use_1

    def update(self, ids: np.ndarray) -> None:
        right_2, right_1 = self.id_2 == ids, self.id_1 == ids
        fresh = ids * 4 + 5
        changed = np.where(self.sure_2 > 1, self.v2 - 1, fresh)
        self.seen_2[self.at_2] = np.where(right_2, self.v2 + (self.sure_2 < 3), changed)
        changed = np.where(self.sure_1 > 1, self.v1 - 1, fresh)
        self.seen_1[self.at_1] = np.where(right_1, self.v1 + (self.sure_1 < 3), changed)
        # Steps of a 32nd keep both chances between 31 and 65536 - 31 of 65536. A chance whose prediction was missing
        # or the same as that of order 2 moves too, in encoder and decoder alike.
        self.hit_2[self.at_h] = self.p2 + (right_2 * _UP + 31 - self.p2 >> 5)
        self.hit_1[self.at_h] = self.p1 + (right_1 * _UP + 31 - self.p1 >> 5)


_MIX_1, _MIX_2, _UP = np.int32(0x5BD1E995), np.int32(0x2545F491), np.int32(65505)


def _ordered(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Ids as (step, block), padded with 0 at the end of the last block, and the length of that block."""
    blocks = -(-len(ids) // BLOCK)
    last_length = len(ids) - (blocks - 1) * BLOCK
    steps = np.zeros((BLOCK, blocks), np.int32)
    steps[:, : blocks - 1] = ids[: (blocks - 1) * BLOCK].reshape(blocks - 1, BLOCK).T
    steps[:last_length, blocks - 1] = ids[(blocks - 1) * BLOCK :]
    return steps, last_length


def encode(ids: np.ndarray, table: FrequencyTable) -> list[bytes]:
    """One payload per block of ids, in order."""
    payloads: list[bytes] = []
    for start in range(0, len(ids), BLOCK * LANES):
        payloads += _encode(ids[start : start + BLOCK * LANES], table)
    return payloads


def _encode(ids: np.ndarray, table: FrequencyTable) -> list[bytes]:
    steps, last_length = _ordered(ids)
    lanes = steps.shape[1]
    model = _Model(lanes)
    low = np.zeros(lanes, np.uint64)
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    longest = last_length if lanes == 1 else BLOCK
    words = np.zeros((lanes, longest + 4 + longest // 8), np.uint64)  # word 0 stays free for a carry
    used = np.ones(lanes, np.int64)
    last = before = np.zeros(lanes, np.int32)

    def put(which, start, width, bits):
        """Narrow the interval of the blocks ``which`` to ``width`` parts of 2 ** bits from ``start``."""
        r = span[which] >> np.uint64(bits)
        moved = low[which] + r * start
        if (over := moved < low[which]).any():
            carried = np.flatnonzero(over) if isinstance(which, slice) else which[over]
            words[carried, used[carried] - 1] += np.uint64(1)
        low[which] = moved
        span[which] = r * width
        small = np.flatnonzero(span[which] < _LOW_RANGE)
        if len(small):
            full = small if isinstance(which, slice) else which[small]
            words[full, used[full]] = low[full] >> _32
            used[full] += 1
            low[full] <<= _32
            span[full] <<= _32

    for t in range(longest):
        k = lanes if t < last_length else lanes - 1
        now = steps[t, :k]
        model.predict(last[:k], before[:k])
        right_2 = model.id_2 == now  # without a prediction the id is -1
        right_1 = (model.id_1 == now) & ~right_2
        other = ~(right_2 | right_1)
        both = model.share_2 + model.share_1
        start = np.where(other, both, model.share_2 * right_1)
        width = np.where(other, 65536 - both, np.where(right_2, model.share_2, model.share_1))
        put(slice(0, k), start.astype(np.uint64), width.astype(np.uint64), 16)
        rest = np.flatnonzero(other)
        put(rest, table.start[now[rest]], table.width[now[rest]], TOTAL_BITS)
        model.update(now)
        before, last = last, now
    rows = np.arange(lanes)
    words[rows, used], words[rows, used + 1] = low >> _32, low & _WORD
    used += 2
    words = words[:, : int(used.max())]  # what no block has written stays untouched, and takes no memory
    for column in range(words.shape[1] - 1, 0, -1):
        words[:, column - 1] += words[:, column] >> _32
    words &= _WORD
    return [words[lane, 1 : used[lane]].astype("<u4").tobytes() for lane in range(lanes)]


def decode(payloads: list[bytes], n_ids: int, table: FrequencyTable) -> np.ndarray:
    """The ``n_ids`` ids of all payloads in order."""
    parts = [
        _decode(payloads[b : b + LANES], min(n_ids - b * BLOCK, LANES * BLOCK), table) for b in range(0, len(payloads), LANES)
    ]
    return np.concatenate([np.empty(0, np.int32), *parts])


def _decode(payloads: list[bytes], n_ids: int, table: FrequencyTable) -> np.ndarray:
    lanes = len(payloads)
    last_length = n_ids - (lanes - 1) * BLOCK
    longest = last_length if lanes == 1 else BLOCK
    words = np.zeros((lanes, max(len(p) for p in payloads) // 4 + 2), np.uint64)
    for lane, payload in enumerate(payloads):
        words[lane, : len(payload) // 4] = np.frombuffer(payload, "<u4")
    model = _Model(lanes)
    ahead = words[:, 0] << _32 | words[:, 1]  # code value less low
    used = np.full(lanes, 2, np.int64)
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.zeros((BLOCK, lanes), np.int32)
    last = before = np.zeros(lanes, np.int32)

    def take(which, r, start, width):
        ahead[which] -= r * start
        span[which] = r * width
        small = np.flatnonzero(span[which] < _LOW_RANGE)
        if len(small):
            full = small if isinstance(which, slice) else which[small]
            ahead[full] = ahead[full] << _32 | words[full, used[full]]
            used[full] += 1
            span[full] <<= _32

    for t in range(longest):
        k = lanes if t < last_length else lanes - 1
        model.predict(last[:k], before[:k])
        r = span[:k] >> np.uint64(16)
        spot = np.minimum(ahead[:k] // r, np.uint64(65535)).astype(np.int32)
        right_2 = spot < model.share_2
        both = model.share_2 + model.share_1
        right_1 = ~right_2 & (spot < both)
        other = spot >= both
        start = np.where(other, both, model.share_2 * right_1)
        width = np.where(other, 65536 - both, np.where(right_2, model.share_2, model.share_1))
        take(slice(0, k), r, start.astype(np.uint64), width.astype(np.uint64))
        now = np.where(right_2, model.id_2, model.id_1)
        rest = np.flatnonzero(other)
        r = span[rest] >> np.uint64(TOTAL_BITS)
        place = np.minimum(ahead[rest] // r, np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
        found = table.owner[place]
        take(rest, r, table.start[found], table.width[found])
        now[rest] = found
        model.update(now)
        out[t, :k] = now
        before, last = last, now
    return np.ascontiguousarray(out.T).reshape(-1)[:n_ids]


def pack_chunk(ids: np.ndarray) -> bytes:
    """Frequency table and blocks of a chunk: each block with its length and the CRC32 of its ids."""
    if len(ids) and int(ids.max()) > MAX_ID:
        raise ValueError(f"ids above {MAX_ID} need wider tables")
    if not len(ids):
        return struct.pack("<QII", 0, 0, 0)
    table = FrequencyTable.of(ids)
    packed = table.pack()
    payloads = encode(ids, table)
    heads = b"".join(
        struct.pack("<II", len(p), zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes())) for b, p in enumerate(payloads)
    )
    return b"".join([struct.pack("<QII", len(ids), len(packed), len(payloads)), packed, heads, *payloads])


def unpack_chunk(data: bytes) -> np.ndarray:
    """Ids of a chunk; a block that does not match its checksum is an error."""
    n_ids, table_length, blocks = struct.unpack_from("<QII", data)
    if not n_ids:
        return np.empty(0, np.int64)
    at = 16
    table = FrequencyTable.unpack(data[at : at + table_length])
    at += table_length
    heads = list(struct.iter_unpack("<II", data[at : at + 8 * blocks]))
    at += 8 * blocks
    payloads = []
    for length, _ in heads:
        payloads.append(data[at : at + length])
        at += length
    ids = decode(payloads, n_ids, table)
    for b, (_, checksum) in enumerate(heads):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != checksum:
            raise ValueError(f"block {b} does not match its checksum")
    return ids
