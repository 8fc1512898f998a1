"""Mixing sources to target weights by weighted fair queueing.

Each source serves its documents in a shuffled order (MD5 of a seed and the id), twice over. The virtual finish time
of a copy is its source's cumulative words up to and including it, divided by the source's target. All copies are
sorted by finish time across sources and the sequence is cut at the total budget, so every source comes within one
document of its target.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating; together they get ``share`` times all words; a
target stops at ``most`` times its source's words and the excess goes to the others by weight, until none is above.
That is a common level times the weight, capped; sorting sources by the level at which they fill up gives it in one
pass over the source table.

Running sums never put a source into one task: documents are dealt into buckets by the leading bits of their shuffle
key, a source's buckets are summed first, and the sums inside a bucket start from the bucket's offset. The global cut
works the same way over ranges of finish time.

Defined results: null texts have size 0; a document of size 0 takes 0; a source of size 0 has target 0; null sources
are one source; rows with equal ids are separate documents in an arbitrary but fixed order of their size; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm import text as T
from bizmetrics.llm.text import free_names, small_or_shuffled

# Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
ROWS_PER_BUCKET = 5_000
FINISHES = ("first_finish", "second_finish")


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) with weight and target.

    One row per source meets in one task here: a table of sources, not of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = F.col("cap") / F.col("weight")
    by_fill = Window.orderBy(fill, F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("weight", F.get(table, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    # The level if this source and all that fill up later are open: the first level under its own fill level holds.
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighted.withColumn("budget", budget).withColumn("level", level).withColumn("place", F.row_number().over(by_fill))
    found = F.min(F.when(F.col("level") <= fill, F.struct("place", "level"))).over(Window.partitionBy())
    return levels.withColumn("common", found["level"]).select(
        "source",
        "source_size",
        "weight",
        F.coalesce(F.least(F.col("cap"), F.col("common") * F.col("weight")), F.col("cap")).alias("target"),
    )


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` over ``order`` within ``keys``; ``bucket`` must ascend with ``order``."""
    bucket_sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucket_sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    renamed = offsets.select(*[F.col(c).alias(f"_{c}_") for c in [*keys, bucket]], "_offset")
    same = [df[c].eqNullSafe(renamed[f"_{c}_"]) for c in [*keys, bucket]]
    summed = df.withColumn("_inside", F.sum(value).over(inside))
    return (
        summed.join(renamed, same)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside", *[f"_{c}_" for c in [*keys, bucket]])
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = "mix",
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, the copies' finish times, text_hash."""
    sized = cut_lineage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source).alias("source"),
            T.n_words(F.col(text)).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")))).alias("shuffle"),
            F.xxhash64(text).alias("text_hash"),
        )
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    wanted = targets(per_source.select("source", "source_size"), weights=weights, share=share, most=most)
    wanted = cut_lineage(wanted.select(F.col("source").alias("_source"), "source_size", "target"))
    bits = max(0, (max(1, sized.count()) // ROWS_PER_BUCKET).bit_length())
    lead = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("bigint")
    queued = _running(
        sized.withColumn("bucket", F.shiftright(lead, 32 - min(bits, 32))),
        ["source"],
        "bucket",
        [F.col("shuffle"), F.col("doc_id"), F.col("size")],
        "size",
        "served",
    )
    with_target = queued.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    finish = F.when(F.col("target") > 0, F.col("served") / F.col("target"))
    again = F.when(F.col("target") > 0, (F.col("served") + F.col("source_size")) / F.col("target"))
    timed = cut_lineage(with_target.withColumn("first_finish", finish).withColumn("second_finish", again).drop("bucket"))
    cut = _cut(timed, share)
    counts = [
        F.when(F.coalesce(_place(finish, copy) <= cut, F.lit(False)), F.col("size")).otherwise(F.lit(0))
        for copy, finish in enumerate(FINISHES)
    ]
    return timed.withColumn("taken", (counts[0] + counts[1]).cast("bigint")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", *FINISHES, "text_hash"
    )


def mixed_documents(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every document as often as the mix takes it: not at all, once, or twice.

    Rows that agree in id and text are one document here, taken as often as all of them together.
    """
    mixed = mix_sources(docs, id_column=id_column, text=text, **options)
    key, body, times, rows, copy = free_names(docs, "key", "body", "times", "rows", "copy")
    copies = mixed.where("taken > 0").select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(body), F.expr("taken div size").cast("int").alias(times)
    )
    copies = cut_lineage(copies.groupBy(key, body).agg(F.sum(times).cast("int").alias(times), F.count(F.lit(1)).alias(rows)))
    same = F.col(id_column).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(body))
    joined = docs.join(small_or_shuffled(copies), same)
    single = joined.where(F.col(rows) == 1)
    several = joined.where(F.col(rows) > 1).dropDuplicates([key, body])
    return (
        single.unionByName(several).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
    )


def _place(finish: str, copy: int) -> Column:
    """Place of a copy in the mixed sequence; null for copies that never run."""
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~"))
    fields = [F.col(finish).alias("finish"), name.alias("source"), F.col("shuffle"), F.lit(copy).alias("copy")]
    return F.when(F.col(finish).isNotNull() & (F.col("size") > 0), F.struct(*fields))


def _cut(timed: DataFrame, share: float) -> Column:
    """Place of the last copy within the budget.

    The sequence is range-sorted and written; the sums of its partitions show which one crosses the budget, and only
    that partition is summed row by row.
    """
    budget = timed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * share
    places = F.explode(F.array(*[_place(finish, copy) for copy, finish in enumerate(FINISHES)]))
    sequence = timed.select("size", places.alias("place")).where(F.col("place").isNotNull())
    sequence = cut_lineage(sequence.orderBy("place").withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    sums = sequence.groupBy(part.alias("part")).agg(F.sum("size").alias("words"), F.max("place").alias("last"))
    running = F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    # One row per partition of the sort.
    ends = sums.withColumn("end", running)
    crossing = ends.where(F.col("end") > budget).orderBy("part").first()
    if crossing is None:
        last = sequence.agg(F.max("place").alias("place")).first().place
    else:
        inside = F.sum("size").over(Window.partitionBy(part).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
        before = sequence.where(part == crossing.part).withColumn("end", inside + (crossing.end - crossing.words))
        last = before.where(F.col("end") <= budget).agg(F.max("place").alias("place")).first().place
        if last is None:
            last = ends.where(F.col("part") < crossing.part).agg(F.max("last").alias("place")).first().place
    if last is None:
        return F.lit(None).cast("struct<finish:double,source:string,shuffle:string,copy:int>")
    return F.struct(
        F.lit(last.finish).alias("finish"), F.lit(last.source).alias("source"), F.lit(last.shuffle).alias("shuffle"), F.lit(last["copy"]).alias("copy")
    )
