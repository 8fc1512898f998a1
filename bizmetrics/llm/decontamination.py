"""Benchmark decontamination: n-gram seeds find candidates, Smith-Waterman alignment scores them.

Benchmark items are a stated query set, taken in blocks of ``items_per_block``; each block is searched in all
documents. Words are lower-cased (A-Z) and broken at white space and ASCII punctuation; in scripts without spaces (Han, kana,
Thai, Lao, Khmer, Burmese, Tibetan) every character is a word. Every n-gram of an item is a seed, so
what is found in a document depends on that document and the item alone. One pass finds the seeds in each document,
merges seeds on neighbouring diagonals into passages, and aligns each passage with its item word by word: match 2,
mismatch -1, gap -1, local. The score is the best alignment over 2 x the item's words, 1 for an exact copy; edits,
insertions and deletions lower it gradually. A pair is reported from ``threshold`` on. A passage that holds too few of the
item's words to reach the threshold is not aligned.

Nothing about documents leaves their task but the found pairs; what is sent out is one block of items with its seeds.

Defined results: null and empty texts match nothing; items under ``min_words`` words are found where all their
words stand in a row (score 1, the first such place), and those under ``min_exact_words`` words match nothing; equal items are each reported; rows with equal ids are searched separately; empty tables give no rows; other columns of
the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm.hashing import PUNCTUATION_TOO, Piece, grams, pieces

FOUND = "doc_id long, item_id long, score double, passage_start long, passage_end long"
MATCH, MISMATCH, GAP = 2, -1, -1


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    found = []
    for piece in pieces(pa.array(texts, pa.large_string()), PUNCTUATION_TOO, characters=True):
        hashes = piece.word_hashes(lower=True)
        found += [hashes[a:b] for a, b in zip(piece.offsets, piece.offsets[1:])]
    return found


class GramIndex:
    """Membership of n-grams in a sorted array; a fixed bit table answers most misses at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that hold a key, and the key's number."""
        maybe = np.flatnonzero(self.table[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        right = self.keys[at] == hashes[maybe]
        return maybe[right], at[right]


def _hits(piece: Piece, hashes: np.ndarray, index: GramIndex, width: int):
    """For each text with a key: its number, positions, key numbers, and word hashes."""
    positions, keys = index.find(grams(hashes, width))
    owner = np.searchsorted(piece.offsets, positions, "right") - 1
    inside = positions + width <= piece.offsets[owner + 1]
    positions, keys, owner = positions[inside], keys[inside], owner[inside]
    for text, start, stop in _runs(owner):
        low = piece.offsets[text]
        yield piece.first + text, positions[start:stop] - low, keys[start:stop], hashes[low : piece.offsets[text + 1]]


def _runs(values: np.ndarray):
    """(value, start, stop) of each run of equal neighbours."""
    if len(values):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
        for start, stop in zip(edges[:-1], edges[1:]):
            yield int(values[start]), int(start), int(stop)


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Best Smith-Waterman score of two word sequences. One numpy row per item word."""
    row = np.zeros(len(passage) + 1, np.int64)
    steps = np.arange(len(passage) + 1) * -GAP
    best = 0
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the passage
        best = max(best, int(row.max()))
    return best


def passages(in_item: np.ndarray, in_text: np.ndarray, item_length: int, text_length: int) -> list[tuple[int, int]]:
    """Ranges of the text that seeds point to: the item's length and half as much on both sides, merged where they meet."""
    slack = item_length // 2 + 1
    begin = np.maximum(in_text - in_item - slack, 0)
    end = np.minimum(in_text - in_item + item_length + slack, text_length)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin.tolist(), end.tolist())):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _table(seeds: list[tuple[int, int, int]]):
    """Index of the seeds' hashes; seeds of key k are start[k] .. start[k + 1] of the items and their places."""
    seeds = sorted(seeds)
    hashes = np.array([s[0] for s in seeds], np.uint64)
    index = GramIndex(hashes)
    start = np.append(np.searchsorted(hashes, index.keys), len(seeds))
    return index, start, np.array([s[1] for s in seeds], np.int64), np.array([s[2] for s in seeds], np.int64)


def _search(source: DataFrame, block, threshold: float, width: int) -> DataFrame:
    def aligned(piece: Piece, hashes: np.ndarray):
        ids, words, (index, seed_start, seed_item, seed_place), _ = block.value
        for text, positions, keys, own_hashes in _hits(piece, hashes, index, width):
            lengths = seed_start[keys + 1] - seed_start[keys]
            entry = np.repeat(seed_start[keys] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            entry += np.arange(lengths.sum())
            items, in_item, in_text = seed_item[entry], seed_place[entry], np.repeat(positions, lengths)
            order = np.argsort(items, kind="stable")
            for item, start, stop in _runs(items[order]):
                chosen = order[start:stop]
                own = words[item]
                scored = [
                    (align(own, own_hashes[a:b]) / (MATCH * len(own)), -a, b)
                    for a, b in passages(in_item[chosen], in_text[chosen], len(own), len(own_hashes))
                    if np.isin(own, own_hashes[a:b]).sum() / len(own) >= threshold  # else no alignment reaches it
                ]
                score, begin, end = max(scored, default=(-1.0, 0, 0))
                if score >= threshold:
                    yield text, ids[item], score, -begin, end

    def copied(piece: Piece, hashes: np.ndarray):
        ids, _, _, short = block.value
        for size, (index, start, items, _) in short.items():
            for text, positions, keys, _ in _hits(piece, hashes, index, size):
                for key, first in zip(*np.unique(keys, return_index=True)):
                    for item in items[start[key] : start[key + 1]]:
                        yield text, ids[item], 1.0, int(positions[first]), int(positions[first]) + size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            rows = []
            for piece in pieces(batch.column(1), PUNCTUATION_TOO, characters=True):
                hashes = piece.word_hashes(lower=True)
                for find in (aligned, copied):
                    rows += [(doc_ids[text].as_py(), *found) for text, *found in find(piece, hashes)]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "score", "passage_start", "passage_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return source.select("doc_id", "text").mapInArrow(search, FOUND)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 3,
    min_words: int = 8,
    min_exact_words: int = 3,
    threshold: float = 0.4,
    items_per_block: int = 5_000,
) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, and the aligned passage's word range."""
    if min_words < width or min_exact_words < 1:
        raise ValueError("min_words must be at least width and min_exact_words at least 1")
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).toLocalIterator()
    found = spark.createDataFrame([], FOUND)
    while block := list(islice(items, items_per_block)):
        words = item_words([row.text for row in block])
        ids = [row.id for row in block]
        seeds = [(int(h), i, p) for i, w in enumerate(words) if len(w) >= min_words for p, h in enumerate(grams(w, width))]
        whole: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(words):
            if min_exact_words <= len(w) < min_words:
                whole.setdefault(len(w), []).append((int(grams(w, len(w))[0]), i, 0))
        table = ids, words, _table(seeds), {size: _table(own) for size, own in whole.items()}
        found = found.unionByName(_search(source, spark.sparkContext.broadcast(table), threshold, width))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    All rows of a found id go; a null id is never removed. The ids are written first, so Spark knows their size when
    it picks the join.
    """
    leaks = contaminated(docs, benchmark, id_column=id_column, **options).select(F.col("doc_id").alias(id_column))
    leaks = cut_lineage(leaks.distinct())
    return docs.join(leaks, id_column, "left_anti")
