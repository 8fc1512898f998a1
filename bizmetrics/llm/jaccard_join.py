"""Exact Jaccard join on word shingles by universe partitioning, and the groups its links form.

A document is the set of its distinct 5-word shingles (64-bit hashes of lower-cased words). Two sets link when
|a & b| >= threshold * |a | b|. Documents with equal sets are one class; classes are joined:

1. Universe. Shingles are counted over all documents; a fixed-size table marks the frequent ones. The universe is cut into
   segments: every rare shingle is one of its own, frequent ones share segments.
2. Rare part. A set of n shingles has at least n * threshold of them in common with any partner. It indexes its first
   n - that + 1 rare shingles in a common order, or all it has: linked sets that share any rare shingle meet in one.
3. Frequent part. Linked sets that share no rare shingle differ in all their rare ones, so their frequent parts differ in at most H - r
   shingles: H = |smaller| / 3 (at 0.75), r = the set's own rare ones. Only sets that are mostly frequent can have such
   partners. By size band (band b holds sizes 2^(b-1) .. 2^b - 1; a set also visits the next band if a partner may lie
   there) the frequent part is hashed into segments. A segment set to exact match gives one signature, its content, and is
   worth 1. A segment set to one deletion also gives the contents with one shingle left out and is worth 2 (1 if it holds one
   shingle): it still meets its partner's if they differ by one. A set indexes segments in a common order until they are
   worth H - r + 1; by the pigeonhole principle such sets share a signature. A set whose segments are worth too little also
   indexes single shingles, for which there always are enough.
4. Cost-based allocation. Each band gets the segment count and the match kind with the least expected cost: signatures
   plus meetings.
5. Buckets of equal signatures propose a link from every member to one leader. Each set's proposal of most buckets is verified on the
   full sets; where members of a bucket are still in different groups afterwards, their remaining pairs across groups are
   checked too, unless their sizes, a sketch of their differences, or in a bucket of frequent shingles the rare ones that they cannot
   share there, rule a link out. So no group is missed, thousands of near copies of one set cost one comparison each, and sets that share
   a frequent passage but little else are no pairs at all.

Groups are found by label propagation over written tables; texts, links and groups stay distributed. Buckets are dealt into
blocks, hot ones first by a salt, so none is ever whole in one task. The driver sees a
few numbers per band and a bit table of fixed size. Hash collisions can only add candidates; equality of
shingles rests on 64 bits, that of classes on 128: should two classes agree in the first 64, all is done again with another seed.

Defined results: texts under five words are one shingle, their whole sequence; texts without words are empty and link
with nothing; repeated rows are equal sets; a null id takes part and is never a group's id unless all ids are null;
an empty table gives no rows; other columns of the input are ignored or, in ``keep_one``, kept.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage, discard
from bizmetrics.llm.hashing import grams, mix, pieces, release, shingle_set
from bizmetrics.llm.text import free_names, rows_per_batch, small_or_shuffled

COUNT_BITS = 24  # bits of the shingle count table: 2 ** COUNT_BITS counters, whatever the input
COUNT_PARTS = 64
WINDOW_SHINGLES = 2_000_000  # shingles counted at once
IDENTITY_BANDS = 5  # bands up to this one (sizes under 32) use every shingle as its own segment
BLOCK_SETS = 256  # sets of a family that are compared in one task, on either side
BUCKET_SETS = 8192  # members of a bucket whose pairs are looked through in one task, on either side
EARLIER = 8  # earlier buckets of a set that each of its buckets knows
SETS_PER_SALT, MOST_SALTS = 200_000, 1024  # a bucket of frequent shingles is dealt by so many salts first


class Allocation(NamedTuple):
    segments: int  # 0: every shingle is a segment
    deletions: bool


def distance_bound(size: int, threshold: float) -> int:
    """Most shingles in which a set of ``size`` can differ from a linked set that is not smaller."""
    return math.floor(size * (1 - threshold) / threshold + 1e-9)


def bands_of(size: int, threshold: float) -> list[int]:
    own, top = size.bit_length(), math.floor(size / threshold + 1e-9).bit_length()
    return list(range(own, top + 1))


def allocate(band: int, sets: int, share: float, threshold: float) -> Allocation:
    """The cheapest way to index the frequent parts of a band of ``sets`` sets when that share of shingles is frequent."""
    if band <= IDENTITY_BANDS:
        return Allocation(0, False)
    share = min(share, 0.999)
    best = None
    for segments, deletions in ((1 << band, False), (1 << band - 1, False), (1 << band - 2, True)):
        cost = 0.0
        for size in (1 << band - 1, 3 << band - 2, (1 << band) - 1):
            need = distance_bound(size, threshold) + 1
            occupied = segments * -math.expm1(-size / segments)
            held = size / occupied
            worth = 1 + (held > 1) * (1 - 1 / held) if deletions else 1.0
            if occupied * worth < 1.1 * need:
                cost = math.inf
                break
            taken = need / worth
            rows = taken * (1 + held * (worth - 1)) if deletions else taken
            # Sets without a common origin meet if all that is left of the segment is frequent in both.
            meetings = share ** max(held - 1 - deletions, 0) * math.log2(2 + sets * share)
            cost += rows * (1 + meetings)
        if best is None or cost < best[0]:
            best = (cost, Allocation(segments, deletions))
    return best[1] if best[0] < math.inf else Allocation(0, False)


def _salt(*parts: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little"))


def least_overlap(size: int, threshold: float) -> int:
    """Fewest shingles that a set of ``size`` shares with any set it links with."""
    return math.ceil(size * threshold - 1e-9)


def rare_signatures(shingles: np.ndarray, hot: np.ndarray, threshold: float) -> np.ndarray:
    """Linked sets that share a shingle which is not ``hot`` share one of these."""
    rare = np.sort(mix(shingles[~hot] ^ _salt(-2)))
    return rare[: len(shingles) - least_overlap(len(shingles), threshold) + 1]


def hot_signatures(shingles: np.ndarray, hot: np.ndarray, plan: dict[int, Allocation], threshold: float) -> np.ndarray:
    """Linked sets that share no shingle but ``hot`` ones share one of these."""
    size, shingles = len(shingles), shingles[hot]
    need = distance_bound(size, threshold) - (size - len(shingles)) + 1
    found = [np.empty(0, np.uint64)]
    for band in bands_of(size, threshold) if need > 0 and len(shingles) >= least_overlap(size, threshold) else ():
        segments, deletions = plan.get(band) or allocate(band, 0, 0.0, threshold)
        salt = _salt(band, segments, deletions)
        if not segments:
            found.append(np.sort(mix(shingles ^ salt))[:need])
            continue
        element = mix(shingles ^ salt)
        segment = (element >> np.uint64(20)) % np.uint64(segments)
        order = np.argsort(segment, kind="stable")
        edge = np.flatnonzero(np.diff(segment[order].astype(np.int64), prepend=-1))
        ids = segment[order][edge]
        mixed = mix(element[order])
        content = np.add.reduceat(mixed, edge)
        held = np.diff(np.append(edge, len(order)))
        if deletions:
            worth = np.minimum(held, 2)
            rank = np.argsort(mix(ids ^ salt), kind="stable")
            taken = rank[: np.searchsorted(np.cumsum(worth[rank]), need) + 1]
            chosen = np.zeros(len(edge), bool)
            chosen[taken] = True
            owner = np.repeat(np.arange(len(edge)), held)
            less = chosen[owner] & (held[owner] > 1)
            contents = np.concatenate([content[chosen], content[owner[less]] - mixed[less]])
            places = np.concatenate([ids[chosen], ids[owner[less]]])
            found.append(np.unique(mix(contents ^ mix(places + salt))))
            enough = worth.sum() >= need
        else:
            found.append(np.sort(mix(content ^ mix(ids + salt)))[:need])
            enough = len(edge) >= need
        if not enough:
            found.append(np.sort(mix(shingles ^ _salt(band, -1)))[:need])
    return np.concatenate(found)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text."""
    for piece in pieces(column):
        hashes = piece.word_hashes(lower=True)
        spread = grams(hashes, width)
        for text, (start, stop) in enumerate(zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist())):
            yield piece.first + text, shingle_set(hashes, spread, start, stop, width)


def _class_id(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def odd_sketch(shingles: np.ndarray) -> bytes:
    """A bit per cell: whether the set has an odd number of shingles there. About as many cells as shingles, or twice that.

    Two sketches differ in no more cells than the sets differ in shingles, whatever they have in common. A longer sketch becomes
    the next shorter one by laying its halves over each other.
    """
    band = len(shingles).bit_length()
    cells = 1 << max(6, band + (band < 8))
    places = (mix(shingles ^ _salt(-3)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=cells).astype(np.uint8) & 1).tobytes()


def differences(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Fewest shingles in which the sets i and j can differ, pair by pair."""
    size = np.array([len(one) for one in sketches])
    place, rows = np.zeros(len(sketches), np.int64), {}
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        place[own] = np.arange(len(own))
        rows[n] = np.frombuffer(b"".join(sketches[k] for k in own.tolist()), np.uint64).reshape(len(own), -1)
    found = np.zeros(len(i), np.int64)
    longer = size[i] >= size[j]
    i, j = np.where(longer, i, j), np.where(longer, j, i)
    for n in rows:
        for m in rows:
            some = np.flatnonzero((size[i] == n) & (size[j] == m)) if m <= n else ()
            for at in range(0, len(some), 50_000):
                part = some[at : at + 50_000]
                one = rows[n][place[i[part]]]
                while one.shape[1] > rows[m].shape[1]:
                    half = one.shape[1] // 2
                    one = one[:, :half] ^ one[:, half:]
                found[part] = np.bitwise_count(one ^ rows[m][place[j[part]]]).sum(1)
    return found


_DESCRIBED = "doc_id long, text_key long, n int, class_id long, class_check long, sketch binary, part int, counts binary"


def _describe(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """A row per document, and per task ``COUNT_PARTS`` rows with its part of the shingle counts."""
    names = ["doc_id", "text_key", "n", "class_id", "class_check", "sketch", "part", "counts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def rows_batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint16)
        seen: set[int] = set()
        fresh: list[np.ndarray] = []
        held = 0

        def count() -> None:
            nonlocal fresh, held
            if fresh:
                places, times = np.unique(_counter(np.concatenate(fresh)), return_counts=True)
                counts[places] = np.minimum(counts[places].astype(np.int64) + times, 65535)
            fresh, held = [], 0

        for batch in batches:
            ids, keys, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for row, shingles in _sets(batch.column(1), width):
                name, check = _class_id(shingles, seed) if len(shingles) else (None, None)
                sketch = odd_sketch(shingles) if name is not None else None
                rows.append((ids[row], keys[row], len(shingles), name, check, sketch, None, None))
                if name is not None and name not in seen:  # copies count once per task
                    seen.add(name)
                    fresh.append(shingles)
                    held += len(shingles)
                    if held >= WINDOW_SHINGLES:
                        count()
            yield rows_batch(rows)
        count()
        if seen:
            parts = np.split(counts, COUNT_PARTS)
            yield rows_batch([(None, None, None, None, None, None, i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(parts)])
        del counts
        release()

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, _DESCRIBED)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)


def _frequent(described: DataFrame, shingles: int) -> tuple[np.ndarray, float]:
    """Which counters stand out, and the share of all counted shingles that they hold.

    Counts of one part are added up as they stream by. The result has a fixed size.
    """
    mean = shingles / (1 << COUNT_BITS)
    limit = mean + 6 * math.sqrt(mean) + 8

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(*[c.to_pylist() for c in batch.columns]):
                one = np.frombuffer(zlib.decompress(packed), np.uint16)
                sums[part] = sums[part] + one if part in sums else one.astype(np.int64)
        rows = [(part, np.packbits(t > limit).tobytes(), int(t[t > limit].sum()), int(t.sum())) for part, t in sums.items()]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "bits", "hot", "total"])

    parts = described.where(F.col("part").isNotNull()).select("part", "counts").repartition(COUNT_PARTS, "part")
    table = np.zeros(1 << COUNT_BITS, bool)
    size, hot, total = (1 << COUNT_BITS) // COUNT_PARTS, 0, 0
    for row in parts.mapInArrow(merge, "part int, bits binary, hot long, total long").collect():
        table[row.part * size : (row.part + 1) * size] = np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
        hot, total = hot + row.hot, total + row.total
    return np.packbits(table), hot / max(total, 1)


#: A member of a bucket: ``spare`` is the number of its rare shingles in a bucket of frequent ones, -1 in one of a rare shingle.
_MEMBER = ["signature", "class_id", "n", "spare"]


def _salted(names: np.ndarray, salts: int) -> np.ndarray:
    """What a class adds to its frequent signatures: one of ``salts`` values."""
    return mix(mix(names.view(np.uint64)) % np.uint64(salts)) if salts > 1 else np.zeros(len(names), np.uint64)


def _index(docs: DataFrame, shared, width: int, threshold: float, salts: int, seed: int) -> DataFrame:
    """(signature, class_id, n, spare) of every class; classes repeated within a task are indexed once. Frequent signatures are salted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, packed = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, rows = [np.empty(0, np.uint64)], []
            for _, shingles in _sets(batch.column(1), width):
                if not len(shingles) or (name := _class_id(shingles, seed)[0]) in seen:
                    continue
                seen.add(name)
                counter = _counter(shingles)
                hot = (packed[counter >> 3] >> (7 - (counter & 7)).astype(np.uint8) & 1).astype(bool)
                rare, frequent = rare_signatures(shingles, hot, threshold), hot_signatures(shingles, hot, plan, threshold)
                keys += [rare, frequent + _salted(np.array([name]), salts)]
                rows.append((name, len(shingles), -1, len(rare)))
                rows.append((name, len(shingles), int(len(hot) - hot.sum()), len(frequent)))
            owners = np.array(rows, np.int64).reshape(-1, 4)
            name, size, spare = (np.repeat(owners[:, c], owners[:, 3]) for c in range(3))
            yield _members(np.concatenate(keys), name, size, spare)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "signature long, class_id long, n int, spare int")


def _members(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, spares: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(keys.view(np.int64)), pa.array(names), pa.array(sizes.astype(np.int32)), pa.array(spares.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, _MEMBER)


def _possible(n: np.ndarray, spare: np.ndarray, other_n: np.ndarray, other_spare: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs can link: by their sizes and, in a bucket of frequent shingles, if they share none of their rare ones."""
    differ = np.floor((n + other_n) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    return (np.minimum(n, other_n) >= threshold * np.maximum(n, other_n) - 1e-9) & ((spare < 0) | (spare + other_spare <= differ))


_BUCKET = "signature long, leader long, leader_n int, leader_spare int, class_id long, n int, spare int, fits boolean"


def _buckets(index: DataFrame, threshold: float, salts: int) -> DataFrame:
    """Of signatures that several classes share: each member with the leader, the one with the fewest rare shingles.

    Salted buckets have a leader each, and those of one signature meet in a second round.
    """

    def meet(salted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[c.to_numpy() for c in b.columns] for b in batches]
            if not parts:
                return
            keys, names, sizes, spares = (np.concatenate(c) for c in zip(*parts))
            del parts
            order = np.argsort(keys)
            same = keys[order[1:]] == keys[order[:-1]]
            several = np.append(same, False) | np.append(False, same)
            if salted:
                several |= spares[order] >= 0
            order = order[several]
            order = order[np.lexsort((names[order], spares[order], keys[order]))]
            keys, names, sizes, spares = (c[order] for c in (keys, names, sizes, spares))
            if len(keys):
                again = np.append(False, (keys[1:] == keys[:-1]) & (names[1:] == names[:-1]))
                keys, names, sizes, spares = (c[~again] for c in (keys, names, sizes, spares))
                first = np.append(True, keys[1:] != keys[:-1])
                lead = np.flatnonzero(first)[np.cumsum(first) - 1]
                rows = np.flatnonzero(~first | (salted & (spares >= 0)))
                lead = lead[rows]
                fits = _possible(sizes[rows], spares[rows], sizes[lead], spares[lead], threshold)
                if salted:
                    keys = np.where(spares >= 0, keys.view(np.uint64) - _salted(names, salts), keys.view(np.uint64)).view(np.int64)
                columns = [keys[rows], names[lead], sizes[lead], spares[lead], names[rows], sizes[rows], spares[rows], fits]
                for at in range(0, len(rows), 100_000):
                    some = [pa.array(c[at : at + 100_000]) for c in columns]
                    yield pa.RecordBatch.from_arrays(some, [c.split()[0] for c in _BUCKET.split(", ")])
            release()

        return run

    if salts == 1:
        return cut_lineage(index.repartition("signature").mapInArrow(meet(False), _BUCKET))
    first = cut_lineage(index.repartition("signature").mapInArrow(meet(True), _BUCKET))
    own = F.col("leader") == F.col("class_id")
    second = first.where(own).select(*_MEMBER).repartition("signature").mapInArrow(meet(False), _BUCKET)
    both = cut_lineage(first.where(~own).unionByName(second))
    discard(first)
    return both


def _blocks(families: DataFrame) -> DataFrame:
    """(class_id, family, block): a family, which is all that buckets connect, is dealt into blocks of about ``BLOCK_SETS`` sets."""
    sizes = families.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    member = families.join(sizes, "label").select(
        F.col("node").alias("class_id"),
        F.col("label").alias("family"),
        F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_SETS)).cast("int").alias("block"),
    )
    return cut_lineage(member)


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, member: DataFrame, width: int, threshold: float, seed: int) -> DataFrame:
    """Links among ``pairs`` (a, b, a_label, b_label): enough of them to join the labels that all of them would join.

    The pairs of two blocks of ``member`` meet in one task with the sets they need, so a set travels once per block it is compared
    with and not once per pair. A pair whose labels earlier links of the task already join is not compared again.
    """
    of_a, of_b = (
        member.select(F.col("class_id").alias(c), F.col("family").alias(f"{c}_family"), F.col("block").alias(f"{c}_block")) for c in "ab"
    )
    dealt = pairs.join(of_a, "a").join(of_b, "b").withColumn("family", F.col("a_family"))
    dealt = dealt.withColumns({"i": F.least("a_block", "b_block"), "j": F.greatest("a_block", "b_block")})
    dealt = cut_lineage(dealt.select("family", "i", "j", F.lit(1).alias("kind"), "a", "b", "a_label", "b_label"))
    cell = ["family", "i", "j"]
    wanted = dealt.select(*cell, F.col("a").alias("class_id")).union(dealt.select(*cell, F.col("b").alias("class_id")))
    placed = wanted.distinct().join(classes.select("class_id", "id", F.col("text_key").alias("key")), "class_id")
    placed = cut_lineage(placed)
    same = docs["doc_id"].eqNullSafe(placed["id"]) & (docs["text_key"] == placed["key"])
    texts = docs.join(small_or_shuffled(placed), same).select("text", "class_id", *cell)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, root = None, {}, {}

        def find(label: int) -> int:
            while (above := root.get(label, label)) != label:
                root[label] = root.get(above, above)
                label = root[label]
            return label

        for batch in batches:
            linked = []
            sets = dict(_sets(batch.column(8), width))  # empty for the rows of pairs
            for row, (*at, kind, a, b, a_label, b_label) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:8]])):
                if at != here:
                    here, held, root = at, {}, {}
                if not kind:
                    if len(sets[row]) and _class_id(sets[row], seed)[0] == a:  # else another text with the same id
                        held[a] = sets[row]
                    continue
                low, high = find(a_label), find(b_label)
                if low == high:
                    continue
                one, other = held[a], held[b]
                if min(len(one), len(other)) < threshold * max(len(one), len(other)) - 1e-9:
                    continue
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if shared >= threshold * (len(one) + len(other) - shared) - 1e-9:
                    linked.append((a, b))
                    root[high] = low
            columns = list(zip(*linked)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])
        held.clear()
        release()

    # Texts travel, not their sets: compressed, they are smaller than their shingles.
    absent = [F.lit(None).cast("bigint").alias(c) for c in ("b", "a_label", "b_label")]
    rows = texts.select(*cell, F.lit(0).alias("kind"), F.col("class_id").alias("a"), *absent, "text")
    rows = rows.unionByName(dealt.withColumn("text", F.lit(None).cast("string")))
    ordered = rows.repartition(*cell).sortWithinPartitions(*cell, "kind")
    found = cut_lineage(ordered.mapInArrow(compare, "a long, b long").distinct())
    discard(dealt, placed)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); the label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so paths
    shorten by more than half. Every round is written; the loop ends when no label changes.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    both = both.unionByName(both.select(F.col("near").alias("node"), F.col("node").alias("near")))
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label")))
    while True:
        known = labels.select(F.col("node").alias("near"), F.col("label").alias("near_label"))
        heard = both.join(known, "near").groupBy("node").agg(F.min("near_label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        nearer = cut_lineage(lower.join(jump, "label").select("node", F.least("label", "above").alias("label"), "old"))
        changed = nearer.where(F.col("label") != F.col("old")).limit(1).count()
        discard(labels)
        labels = nearer.select("node", "label")
        if not changed:
            return labels


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of at most ``EARLIER`` signatures as a matrix, and which of its cells are filled."""
    filled = np.arange(EARLIER) < pc.list_value_length(lists).to_numpy()[:, None]
    matrix = np.zeros(filled.shape, np.int64)
    matrix[filled] = lists.flatten().to_numpy()
    return matrix, filled


def _met_before(earlier: np.ndarray, filled: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs i, j have an earlier bucket in common."""
    found = np.zeros(len(i), bool)
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        both = (filled[a][:, :, None] & filled[b][:, None, :]) & (earlier[a][:, :, None] == earlier[b][:, None, :])
        found[at : at + 50_000] = both.any((1, 2))
    return found


def _across(buckets: DataFrame, classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b, a_label, b_label) of one bucket in different groups that are not ruled out.

    Sketches rule out most sets that share some passages but differ too much elsewhere, before any pair is made. Members of a
    large bucket are dealt into blocks, and every two blocks meet in a task of their own.

    Near copies share many signatures, but make few pairs more than once: of buckets with equal members one is looked through, and
    each member knows the ``EARLIER`` buckets before this one in its own list. Two members that see a common one among them are a
    pair of that bucket, or of one before it; the first bucket that they share always makes it.
    """
    members = buckets.select(*_MEMBER).unionByName(
        buckets.select("signature", F.col("leader").alias("class_id"), F.col("leader_n").alias("n"), F.col("leader_spare").alias("spare")).distinct()
    )
    grouped = members.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    grouped = cut_lineage(grouped.withColumn("label", F.coalesce("label", "class_id")))
    frequent = F.col("spare") >= 0
    members = [F.count(F.lit(1)).alias("size"), F.min(frequent).alias("all_frequent"), F.max(frequent).alias("any_frequent")]
    # Members may be there twice: a sum of 44-bit hashes, which cannot reach 64 bits, sees what the other cancels.
    members += [F.bit_xor(F.xxhash64("class_id")).alias("members_0"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "class_id"), 20)).alias("members_1")]
    mixed = grouped.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), *members).where("low != high")
    mixed = mixed.groupBy("size", "all_frequent", "any_frequent", "members_0", "members_1").agg(F.min("signature").alias("signature"))
    mixed = cut_lineage(mixed.select("signature", F.ceil(F.col("size") / BUCKET_SETS).cast("int").alias("blocks")))
    # Buckets of rare shingles come first: they rule out no pair that one of frequent shingles lets pass.
    before = Window.partitionBy("class_id").orderBy(frequent, "signature").rowsBetween(-EARLIER, -1)
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j"))
    )
    dealt = grouped.join(mixed, "signature").withColumn("earlier", F.collect_list("signature").over(before))
    dealt = dealt.join(classes.select("class_id", "sketch"), "class_id")
    dealt = dealt.withColumn("own", own).withColumn("cell", F.explode(cells))
    columns = ["signature", "i", "j", "own", "label", "class_id", "n", "spare"]
    dealt = dealt.select("signature", "cell.i", "cell.j", "own", "label", "class_id", "n", "spare", "earlier", "sketch")

    def distinct(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(4)], ["a", "b", "a_label", "b_label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sketches = [], []
        for batch in batches:
            parts.append([batch.column(c).to_numpy().astype(np.int64) for c in columns] + list(_padded(batch.column("earlier"))))
            sketches += batch.column("sketch").to_pylist()
        if not parts:
            return
        key, first, second, own, label, name, size, spare, earlier, filled = (np.concatenate(c) for c in zip(*parts))
        del parts
        # Within a cell by the rare shingles that a partner may not share: partners are the rows before a place.
        order = np.lexsort((spare, second, first, key))
        key, first, second, own, label, name, size, spare = (c[order] for c in (key, first, second, own, label, name, size, spare))
        sketches, earlier, filled = [sketches[k] for k in order.tolist()], earlier[order], filled[order]
        edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        found, held = [], 0
        for start, stop in zip(edges.tolist(), np.append(edges[1:], len(key)).tolist()):
            room = size[start:stop] * ((1 - threshold) / threshold) - spare[start:stop] + 1e-9
            for low in range(start, stop, 256):  # blocks of rows bound the memory
                some = slice(low, min(low + 256, stop))
                high = stop if spare[start] < 0 else start + int(np.searchsorted(spare[start:stop], room[low - start : some.stop - start].max(), "right"))
                if high <= low:
                    continue
                rest = slice(low, high)
                open_ = label[some, None] != label[None, rest]
                if first[start] != second[start]:
                    open_ &= own[some, None] != own[None, rest]
                i, j = np.nonzero(open_ & _possible(size[some, None], spare[some, None], size[None, rest], spare[None, rest], threshold))
                i, j = i[j > i] + low, j[j > i] + low
                if len(i):
                    least = differences(sketches[low:high], i - low, j - low)
                    possible = least <= (size[i] + size[j]) * ((1 - threshold) / (1 + threshold)) + 1e-9
                    i, j = i[possible], j[possible]
                if len(i):
                    new = ~_met_before(earlier, filled, i, j)
                    i, j = i[new], j[new]
                if len(i):
                    swap = name[i] > name[j]
                    a, b = np.where(swap, j, i), np.where(swap, i, j)
                    found.append(np.stack([name[a], name[b], label[a], label[b]], 1))
                    held += len(a)
            if held > 300_000:
                found = [distinct(found)]
                held = 0
                if len(found[0]) > 300_000:
                    yield batch_of(found.pop())
        if found:
            yield batch_of(distinct(found))
        release()

    pairs = dealt.repartition("signature", "i", "j").mapInArrow(run, "a long, b long, a_label long, b_label long")
    found = cut_lineage(pairs.distinct())
    discard(grouped, mixed)
    return found


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.75
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    if not 0.5 < threshold < 1:
        raise ValueError("threshold must be between 0.5 and 1")
    source = _source(docs, id_column, text)
    with rows_per_batch(docs.sparkSession, 1_000):
        rows, named = _grouped(source, width, threshold)
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    known = cut_lineage(named.join(smallest, "label").select("class_id", "component_id"))
    return rows.join(known, "class_id", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _source(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))


def _grouped(source: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Every row with its class (doc_id, text_key, n, class_id), and every class with its group (class_id, id, text_key, label)."""
    for seed in itertools.count():
        described = cut_lineage(_describe(source, width, seed))
        rows = described.where(F.col("part").isNull())
        place = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
        checks = [F.min("class_check").alias("low"), F.max("class_check").alias("high")]
        sketch = F.min("sketch").alias("sketch")
        classes = cut_lineage(rows.where("n > 0").groupBy("class_id").agg(place, F.max("n").alias("n"), sketch, *checks))
        if classes.where("low != high").isEmpty():
            break
    classes = classes.select("class_id", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("text_key"), "n", "sketch")
    band = F.length(F.bin(F.col("n").cast("bigint")))
    per_band = classes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    bands = per_band.collect()  # one row per band: at most 31
    hot, share = _frequent(described, sum(row.shingles for row in bands))
    plan = {row.band: allocate(row.band, row.sets, share, threshold) for row in bands}
    salts = min(MOST_SALTS, 1 + sum(row.sets for row in bands) // SETS_PER_SALT)
    shared = source.sparkSession.sparkContext.broadcast((plan, hot))

    buckets = _buckets(_index(source, shared, width, threshold, salts, seed), threshold, salts)
    shared.unpersist()
    proposed = buckets.where("fits").groupBy(F.col("leader").alias("a"), F.col("class_id").alias("b"))
    proposed = proposed.agg(F.count(F.lit(1)).alias("shared"), F.min((F.col("spare") >= 0).cast("int")).alias("frequent"))
    families = components(cut_lineage(buckets.select(F.col("leader").alias("a"), F.col("class_id").alias("b")).distinct()))
    # The leader met in most buckets is the likeliest copy; of a template's near copies most meet the same, the one nearest to it.
    best = proposed.groupBy("b").agg(F.min(F.struct((-F.col("shared")).alias("shared"), "frequent", "a")).alias("best"))
    first = cut_lineage(best.select(F.col("best.a").alias("a"), "b", F.col("best.a").alias("a_label"), F.col("b").alias("b_label")))
    member = _blocks(families)
    discard(families)
    links = _verify(source, classes, first, member, width, threshold, seed)
    labels = components(links)

    apart = cut_lineage(_across(buckets, classes, labels, threshold).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    more = _verify(source, classes, apart, member, width, threshold, seed)
    links = cut_lineage(links.unionByName(more))
    discard(buckets, member, first, apart)
    labels = components(links)

    named = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return rows, cut_lineage(named.select("class_id", "id", "text_key", F.coalesce("label", "class_id").alias("label")))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.75) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, and of those that with the smallest text hash.

    Rows that agree in id and text are one document, of which one row stays unless it has no words. A row goes only for its own
    text's links, whatever other rows have its id.
    """
    source = _source(docs, id_column, text)
    with rows_per_batch(docs.sparkSession, 1_000):
        rows, named = _grouped(source, width, threshold)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    winners = named.groupBy("label").agg(F.min(order).alias("winner"))
    winners = winners.select("label", F.col("winner.id").alias("winner_id"), F.col("winner.text_key").alias("winner_key"))
    won = named.join(winners, "label").select("class_id", "winner_id", "winner_key")
    judged = rows.where("n > 0").join(won, "class_id")
    is_winner = F.col("doc_id").eqNullSafe(F.col("winner_id")) & (F.col("text_key") == F.col("winner_key"))
    key, body, count = free_names(docs, "key", "body", "count")
    # Of each (id, text): whether it goes, and how many rows it has. Other rows are not listed.
    listed = judged.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(body)).agg(
        F.min(is_winner).alias("wins"), F.count(F.lit(1)).alias(count)
    )
    listed = cut_lineage(listed.where(~F.col("wins") | (F.col(count) > 1)))
    same = F.col(id_column).cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(body))
    kept = docs.join(listed.drop("wins"), same, "left_anti")
    (row,) = free_names(docs, "row")
    repeated = docs.join(listed.where("wins").drop("wins", count), same)
    repeated = repeated.withColumn(row, F.row_number().over(Window.partitionBy(key, body).orderBy(text))).where(F.col(row) == 1)
    return kept.unionByName(repeated.select(*docs.columns)).select(*docs.columns)
