"""CSV and Parquet scans with explicit types and pandas' missing-value tokens.

CSV columns are found by the name in each file's own header, so files of one table may differ in the order and number of
their columns. A field that does not hold what its column should costs that field, not the row; ``stage_csv`` gathers such
fields with their file, column and text in the pass that reads the rows.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from bizmetrics.functions.lineage import new_table
from bizmetrics.sources.schemas import TABLES

# The function run by Python workers travels with the plan, so workers need not have this package.
register_pickle_by_value(sys.modules[__name__])

# The texts pandas reads as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession,
    path,
    table: str | StructType,
    date_format: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Scan CSV files with a header row each as one of the four tables (or any schema).

    Every column is read as text and cast afterwards; ``csv_rejects`` counts the fields that this loses. Unused columns are
    never parsed. ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    schema = _schema(table)
    raw = _raw_csv(spark, path, schema.names, multi_line)
    return raw.select(*[_typed(f.name, f.dataType, date_format).alias(f.name) for f in schema.fields])


def csv_rejects(
    spark: SparkSession, path, table: str | StructType, date_format: str | None = None, multi_line: bool = False
) -> DataFrame:
    """One row: per column, how many fields had text that is no missing token and did not cast, or only with rounding."""
    schema = _schema(table)
    raw = _raw_csv(spark, path, schema.names, multi_line)
    return raw.agg(*[F.count(_reason(f, date_format)).alias(f.name) for f in _checked(schema)])


@dataclass(frozen=True)
class StagedCsv:
    """CSV files as typed rows, the fields that were lost (file, column, text, reason), and their number by column."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def stage_csv(
    spark: SparkSession,
    path,
    table: str | StructType,
    date_format: str | None = None,
    multi_line: bool = False,
    folder: str | None = None,
) -> StagedCsv:
    """Read CSV files once, and write rows and rejects as Parquet to ``folder`` (default: the checkpoint folder).

    The reason of a reject is ``unreadable`` (the value is missing then) or ``rounded`` (money with more decimals than the
    column keeps; the value is the rounded one).
    """
    schema = _schema(table)
    raw = _raw_csv(spark, path, schema.names, multi_line, file="_file")
    checked = _checked(schema)
    # One step each for texts, values and reasons, so that every text is compared, cast and judged once per field.
    texts = raw.select("*", *[_present(f.name).alias(f"_present_{i}") for i, f in enumerate(schema.fields)])
    place = {f.name: i for i, f in enumerate(schema.fields)}
    values = texts.select(
        "*",
        *[_value(F.col(f"_present_{i}"), f.dataType, date_format).alias(f"_value_{i}") for i, f in enumerate(schema.fields)],
        *[_exact(F.col(f"_present_{place[f.name]}")).alias(f"_exact_{place[f.name]}") for f in checked if _is_money(f)],
    )
    reasons = {f.name: f"_reason_{place[f.name]}" for f in checked}
    judged = values.select(
        *[f.name for f in checked],
        "_file",
        *[f"_value_{i}" for i in range(len(schema.fields))],
        *[_lost(f, *[F.col(f"_{part}_{place[f.name]}") for part in ("present", "value", "exact")]).alias(reasons[f.name]) for f in checked],
    )
    counted = Observation()
    sums = [F.count(reasons[f.name]).alias(f.name) for f in checked]
    observed = judged.observe(counted, F.count(F.lit(1)).alias("_rows"), *sums)
    lost = [
        F.when(
            F.col(reasons[f.name]).isNotNull(),
            F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("text"), F.col(reasons[f.name]).alias("reason")),
        )
        for f in checked
    ]
    nothing = F.array().cast("array<struct<column:string,text:string,reason:string>>")
    typed = observed.select(
        *[F.col(f"_value_{i}").alias(f.name) for i, f in enumerate(schema.fields)],
        F.col("_file"),
        (F.array_compact(F.array(*lost)) if lost else nothing).alias("_rejects"),
    )
    folder = folder or new_table(spark)
    typed.write.parquet(folder)
    staged = spark.read.schema(typed.schema).parquet(folder)
    rejects = staged.where(F.size("_rejects") > 0).select(F.col("_file").alias("file"), F.inline("_rejects"))
    counts = {name: n for name, n in counted.get.items() if name != "_rows" and n}
    return StagedCsv(staged.select(*schema.names), rejects, counts)


def read_parquet(spark: SparkSession, path, table: str | StructType | None = None) -> DataFrame:
    """Scan Parquet; NaN becomes NULL so that comparisons treat it as missing.

    With a table name the listed columns are selected and keep their stored types.
    """
    df = spark.read.parquet(path)
    names = _schema(table).names if table is not None else df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.nanvl(F.col(c), F.lit(None).cast(kinds[c])).alias(c)
            if isinstance(kinds.get(c), (DoubleType, FloatType))
            else F.col(c)
            for c in names
        ]
    )


def _schema(table: str | StructType) -> StructType:
    return TABLES[table] if isinstance(table, str) else table


def csv_headers(spark: SparkSession, path) -> DataFrame:
    """(path, header) of every CSV file, read by the executors: of each file no more than its first row."""

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = []
            for uri in batch.column(0).to_pylist():
                if uri.startswith("file:/") and not uri.startswith("file://"):
                    uri = "file://" + uri.removeprefix("file:")
                try:
                    system, name = arrow_fs.FileSystem.from_uri(uri)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    headers.append(None)  # a store that only Spark reads
                    continue
                with system.open_input_stream(name) as stream:
                    headers.append(next(csv.reader(io.TextIOWrapper(stream, "utf-8-sig", newline="")), []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(headers, pa.list_(pa.string()))], ["path", "header"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    return files.mapInArrow(first_rows, "path string, header array<string>")


def _raw_csv(spark: SparkSession, path, names: list[str], multi_line: bool = False, file: str | None = None) -> DataFrame:
    """The named columns as text, and the file's path if a name for it is given. Files with one header are one scan."""
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    groups: dict[tuple[str, ...], list[str]] = {}
    for found in csv_headers(spark, path).collect():  # names of files and columns, no rows of the tables
        header = found.header
        if header is None:
            header = spark.read.csv(found.path, **options).columns
        groups.setdefault(tuple(header), []).append(found.path)
    if not groups:
        raise ValueError(f"no CSV file with a header in {path}")
    parts = []
    for header, files in sorted(groups.items()):
        if absent := [n for n in names if n not in header]:
            raise ValueError(f"no column {', '.join(absent)} in the header of {files[0]}")
        taken = set()
        fields = []
        for i, name in enumerate(header):  # of equal names the first counts
            fields.append(StructField(f"_unused_{i}" if name.lower() in taken or name not in names else name, StringType()))
            taken.add(name.lower() if name in names else "")
        rows = spark.read.schema(StructType(fields)).csv(path if len(groups) == 1 else files, **options)
        origin = [F.col("_metadata.file_path").alias(file)] if file else []
        parts.append(rows.select(*names, *origin))
    return reduce(DataFrame.unionByName, parts)


def _checked(schema: StructType) -> list[StructField]:
    return [f for f in schema.fields if not isinstance(f.dataType, StringType)]


def _reason(field: StructField, date_format: str | None) -> Column:
    """Why a field's text is not what the typed column holds; missing if it is."""
    text = _present(field.name)
    return _lost(field, text, _value(text, field.dataType, date_format), _exact(text))


def _lost(field: StructField, text: Column, value: Column, exact: Column) -> Column:
    """The reason, from the text without missing tokens, the typed value and, for money, all decimals of the text."""
    reason = F.when(text.isNotNull() & value.isNull(), F.lit("unreadable"))
    if _is_money(field):
        reason = reason.when(exact.isNotNull() & (exact != value), F.lit("rounded"))
    return reason


def _is_money(field: StructField) -> bool:
    return isinstance(field.dataType, DecimalType)


def _exact(text: Column) -> Column:
    return text.try_cast(DecimalType(38, 18))


def _present(name: str) -> Column:
    return F.when(~F.col(name).isin(*MISSING), F.col(name))


def _typed(name: str, kind: DataType, date_format: str | None) -> Column:
    return _value(_present(name), kind, date_format)


def _value(text: Column, kind: DataType, date_format: str | None) -> Column:
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, DateType):
        return F.try_to_date(text, date_format) if date_format else text.try_cast("date")
    if isinstance(kind, DoubleType):
        number = text.try_cast("double")
        return F.nanvl(number, F.lit(None).cast("double"))
    if isinstance(kind, IntegerType):
        # A whole-number column with gaps is written with decimals ("12.0"); flags may be True/False.
        number = text.try_cast("double")
        exact = F.when(number == F.floor(number), number.try_cast("int"))
        return reduce(
            lambda otherwise, word: F.when(F.lower(text) == word[0], F.lit(word[1])).otherwise(otherwise),
            (("true", 1), ("false", 0)),
            exact,
        )
    return text.try_cast(kind)
