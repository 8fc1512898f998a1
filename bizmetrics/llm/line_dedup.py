"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines with at least one word among them; its key is the MD5 of the three lines. For each
key the first occurrence (lowest document, then lowest position) stays. All later occurrences are merged into the set
of positions they cover, and those lines go. A removed line always has an earlier equal line, so one copy of every
repeated passage stays.

Only keys that occur more than once leave the first aggregation, and it combines before its shuffle, so a passage
that a third of all documents share is one row per task there.

Defined results: null texts have no lines (0 lines, null text); texts under three lines have no windows and stay; rows
with the same id and text count as one document and are all cut alike; a null id comes first; an empty table gives no
rows; other columns of the input stay as they are, except those named ``n_lines``, ``n_removed`` and ``kept_text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm import text as T
from bizmetrics.llm.text import free_names

WIDTH = 3


def windows(lines: Column) -> Column:
    """Array of (pos, key) for every window of three consecutive lines that holds a word."""

    def of(bound):
        starts = F.sequence(F.lit(0), F.size(bound) - WIDTH)
        joined = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(bound, i + 1, WIDTH), "\n").alias("key")))
        with_words = F.filter(joined, lambda w: w["key"].rlike(T.NOT_SPACE))
        return F.transform(with_words, lambda w: F.struct(w["pos"].alias("pos"), F.unhex(F.md5(w["key"])).alias("key")))

    return F.when(F.size(lines) >= WIDTH, T.bind(lines, of))


def line_dedup(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_removed and kept_text."""
    lines = F.split(F.col(text), "\n")
    body = F.unhex(F.md5(F.col(text)))
    occurrences = docs.where(F.col(text).isNotNull()).select(
        F.struct(F.col(id_column).alias("id"), body.alias("body")).alias("doc"), F.inline(windows(lines))
    )
    place = F.struct("doc", "pos")
    # Combined before the shuffle: one row per key and task.
    firsts = occurrences.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = firsts.where(F.col("first") != F.col("last")).select("key", "first")
    later = occurrences.join(repeated, "key").where(place != F.col("first"))
    covered = F.array_distinct(
        F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + WIDTH - 1)))
    )
    plain = docs.drop("n_lines", "n_removed", "kept_text")
    key, digest, own, gone = free_names(plain, "key", "digest", "own_digest", "gone")
    cuts = later.groupBy("doc").agg(covered.alias(gone))
    cuts = cuts.select(F.col("doc.id").alias(key), F.col("doc.body").alias(digest), gone)
    kept = T.bind(
        F.col(gone),
        lambda cut: F.filter(lines, lambda line, i: ~F.coalesce(F.array_contains(cut, i), F.lit(False))),
    )
    same = F.col(id_column).eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest))
    return (
        plain.withColumn(own, body)
        .join(cuts, same, "left")
        .withColumns(
            {
                "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint"),
                "n_removed": F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("bigint"),
                "kept_text": F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
            }
        )
        .drop(key, digest, own, gone)
    )
