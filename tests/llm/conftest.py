from __future__ import annotations

import pytest

# More columns than the operators name, with names that they use inside.
EXTRA = {"key": "k", "size": 3, "row": 1, "n_lines": -1, "score": 0.5, "label": "x", "target": 2.0, "quality_score": 1.0, "taken": 9}


def english(start: int, n: int) -> str:
    """n words, different for every start."""
    return " ".join(f"word{start}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls in every column, empty, blank and long texts, repeated rows and ids, and extra columns."""
    long_text = "\n".join(f"word{i} and more of it" for i in range(8_000))
    base = english(1, 60)
    rows = [
        (1, base, "en", "a", 10),
        (1, base, "en", "a", 10),
        (2, base.replace("word1x5 ", "changed "), "de", "b", 10),
        (3, None, "fr", "a", None),
        (4, "", "xx", None, 0),
        (5, " \n\t \n", None, "a", 4),
        (6, long_text, "en", "c", len(long_text)),
        (None, english(2, 30), None, None, 5),
        (None, None, None, None, None),
        (7, "Only four words here", "es", "b", 20),
        (8, "only FOUR words here", "es", "c", 20),
        (9, "x", "en", "a", 1),
        (10, "*** ### $$$ " * 40, "en", "a", 480),
        (2, english(3, 50), "en", "b", 99),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit(value) for name, value in EXTRA.items()})


@pytest.fixture(scope="session")
def tricky_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (10, 0, 0), (10, 0, 1), (None, 1, 0), (6, None, None), (77, 0, 0), (4, 5, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
