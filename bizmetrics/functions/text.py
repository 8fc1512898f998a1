"""Text for answers: amounts and tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizmetrics.functions.numeric import round_float


def amount(col, currency: str = "") -> Column:
    """Whole amount with thousands separators; the fraction is cut off, a missing amount is 0."""
    value = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(currency), F.format_number(F.coalesce(value.cast("bigint"), F.lit(0)), 0))


def one_decimal(col) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.format_string("%.1f", round_float(F.coalesce(value.cast("double"), F.lit(0.0)), 1))


def markdown_table(rows: Column, titles: Sequence[str], cells: Callable[[Column], Sequence[Column]]) -> Column:
    """Markdown table of an array of structs; a missing cell reads Unknown."""

    def line(row: Column) -> Column:
        texts = [F.coalesce(c.cast("string"), F.lit("Unknown")) for c in cells(row)]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |"))

    head = F.array(F.lit(f"| {' | '.join(titles)} |"), F.lit("| " + " | ".join([":---"] * len(titles)) + " |"))
    return F.concat_ws("\n", F.concat(head, F.transform(rows, line)))
