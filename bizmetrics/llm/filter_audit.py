"""Filter interaction audit: what each filter removes, in every order the filters can run in, from sorted posting lists.

``posting_lists`` keeps, for every part of a table and every range of row ids, the ascending ids that fail each filter (and
those that carry each flag, such as a good label). ``interactions`` merges these lists range by range: the union of every
subset of filters grows by one galloping merge from a smaller subset's union, and the ids that a filter removes after a
subset are its list less that union, found by galloping as well. Only sizes leave a range; sizes of ranges add up to those
of the part. ``filter_audit`` reads every order's steps off these sums.

A range holds at most ``2 ** RANGE_BITS`` ids, so a part that holds a third of all rows is many ranges, and no list grows
with the table. One order's step needs its filter and the set of filters before it: ``k * 2 ** (k - 1)`` sums per part.

Defined results for ``five_filters``: null texts are empty; null and missing ``lang`` are the part ``""``; rows with equal ids are separate rows;
a row without an id equals no smaller id and is nobody's smaller id; a document is good (toxic) if any of its labels says
1; labels without an id or of unknown documents are ignored. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm import text as T

#: A posting list covers 2 ** RANGE_BITS neighbouring row ids at most.
RANGE_BITS = 17
#: Orders grow with the factorial of the number of filters.
MOST_FILTERS = 7
_STRIDE = 64


def gallop(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each key in ``ids``, both ascending: steps from the place of a key before it double, then halve."""
    n = len(ids)
    low = np.repeat(np.searchsorted(ids, keys[::_STRIDE]), _STRIDE)[: len(keys)]
    if not n:
        return low
    reach = np.ones(len(keys), np.int64)
    while True:
        probe = low + reach - 1
        behind = (probe < n) & (ids[np.minimum(probe, n - 1)] < keys)
        if not behind.any():
            break
        low = np.where(behind, probe + 1, low)
        reach = np.where(behind, 2 * reach, reach)
    high = np.minimum(low + reach - 1, n)
    while (between := low < high).any():
        middle = low + high >> 1
        less = between & (ids[np.minimum(middle, n - 1)] < keys)
        low = np.where(less, middle + 1, low)
        high = np.where(between & ~less, middle, high)
    return low


def among(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which keys occur in ``ids`` (both ascending)."""
    if not len(ids):
        return np.zeros(len(keys), bool)
    return ids[np.minimum(gallop(keys, ids), len(ids) - 1)] == keys


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two ascending lists: the shorter one gallops through the longer one."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    places = gallop(few, many)
    new = places == len(many)
    new[~new] = many[places[~new]] != few[~new]
    return np.insert(many, places[new], few[new])


def posting_lists(rows: DataFrame, names: Sequence[str], *, part: str = "part") -> DataFrame:
    """(part, id_range, n_rows, a list per name): ascending ids of the rows where the boolean column holds.

    ``rows`` is written first, so every list is made with the same ids.
    """
    numbered = cut_lineage(rows.select(part, *names)).withColumn("row_id", F.monotonically_increasing_id())
    lists = [F.sort_array(F.collect_list(F.when(F.col(n), F.col("row_id")))).alias(n) for n in names]
    ranges = F.shiftright("row_id", RANGE_BITS).alias("id_range")
    return numbered.groupBy(part, ranges).agg(F.count(F.lit(1)).alias("n_rows"), *lists)


def interactions(postings: DataFrame, filters: Sequence[str], flags: Sequence[str] = (), *, part: str = "part") -> DataFrame:
    """For every part, filter and set of filters before it (a bit mask): rows, rows removed before, here, and with each flag."""
    k, lists = len(filters), [*filters, *flags]
    sums = ["n_rows", "before", "removed", *flags]
    names = [part, "filter", "prior", *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, n_rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (name, n) in enumerate(zip(parts, n_rows)):
                ids = [batch.column(2 + i)[row].values.to_numpy() for i in range(len(lists))]
                failing, flagged = ids[:k], ids[k:]
                marks = [[among(one, flag) for flag in flagged] for one in failing]
                union = [np.empty(0, np.int64)]
                for subset in range(1, 1 << k):  # the subset without its highest filter comes earlier
                    top = subset.bit_length() - 1
                    union.append(merged(union[subset ^ 1 << top], failing[top]))
                found = []
                for f in range(k):
                    for prior in range(1 << k):
                        if not prior >> f & 1:
                            here = ~among(failing[f], union[prior])
                            counts = [int((here & mark).sum()) for mark in marks[f]]
                            found.append((name, f, prior, n, len(union[prior]), int(here.sum()), *counts))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)

    kind = dict(postings.dtypes)[part]
    schema = f"`{part}` {kind}, filter long, prior long, " + ", ".join(f"`{c}` long" for c in sums)
    merged_ranges = postings.select(part, "n_rows", *lists).mapInArrow(run, schema)
    return merged_ranges.groupBy(part, "filter", "prior").agg(*[F.sum(c).alias(c) for c in sums])


def filter_audit(rows: DataFrame, filters: Sequence[str], flags: Sequence[str] = (), *, part: str = "part") -> DataFrame:
    """One row per part, order of the filters, and step in it.

    ``filters`` and ``flags`` name boolean columns: true where a row fails, or carries the flag. Names of one letter make
    readable orders (joined without a separator). ``<flag>_lost`` counts flagged rows removed at the step; ``shapley`` sums
    what the step's filter removes over all orders.
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    sums = interactions(posting_lists(rows, [*filters, *flags], part=part), filters, flags, part=part)
    others = F.shiftleft(F.lit(1), k) - 1 - F.expr("shiftleft(1, cast(filter as int))")
    # Orders that run exactly the filters of ``prior`` before this one.
    weights = F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)])
    own = Window.partitionBy(part, "filter")
    sums = sums.withColumns(
        {
            "failing": F.max(F.when(F.col("prior") == 0, F.col("removed"))).over(own),
            "unique_fails": F.max(F.when(F.col("prior") == others, F.col("removed"))).over(own),
            "shapley": F.sum(F.col("removed") * F.get(weights, F.bit_count("prior"))).over(own),
        }
    )
    steps = []
    for order in permutations(range(k)):
        label, prior = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((label, step, f, prior))
            prior |= 1 << f
    # k! * k rows, whatever the table.
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter long, prior long")
    return sums.join(F.broadcast(orders), ["filter", "prior"]).select(
        part,
        "filter_order",
        "step",
        (F.col("n_rows") - F.col("before") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *[F.col(flag).alias(f"{flag}_lost") for flag in flags],
        "shapley",
    )


#: Filters of the query: too short, repetitive, shouting, symbols, copy of a smaller id.
FIVE = ("A", "B", "C", "D", "E")


def five_filters(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """part, A to E (true: fails), good and toxic for every row of ``docs``.

    A: under 100 words; B: distinct words under 80 % of the words; C: capitals A-Z over 10 % of the code points; D: one of
    ``# $ % & * |``; E: the text of a smaller id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counts = T.bind(T.words(F.col(text)), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(body) - F.length(F.regexp_replace(body, "[A-Z]", ""))
    judged = docs.select(
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.col(id_column).alias("doc_id"),
        F.unhex(F.md5(body)).alias("digest"),
        counts.alias("words"),
        (100 * capitals > 10 * F.length(body)).alias("C"),
        body.rlike(r"[#$%&*|]").alias("D"),
    )
    judged = judged.select(
        "part",
        "doc_id",
        "digest",
        (F.col("words.all") < 100).alias("A"),
        (100 * F.col("words.distinct") < 80 * F.col("words.all")).alias("B"),
        "C",
        "D",
    )
    judged = cut_lineage(judged)  # texts are read once
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where(F.col("first") < F.col("last")).select("digest", "first")
    flagged = labels.select(
        F.col(id_column).alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")
    )
    flagged = flagged.where("doc_id is not null and (good or toxic)").groupBy("doc_id")
    flagged = flagged.agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = judged.join(firsts, "digest", "left").join(flagged, "doc_id", "left")
    no = F.lit(False)
    return joined.select(
        "part",
        "A",
        "B",
        "C",
        "D",
        F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"),
        F.coalesce("good", no).alias("good"),
        F.coalesce("toxic", no).alias("toxic"),
    )
