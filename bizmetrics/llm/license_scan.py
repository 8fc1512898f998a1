"""Licence scan: lines and whole texts compared with licence templates by the Dice coefficient of word bigrams.

A unit is one line of a document, or the whole document (``line_no`` -1). Units and templates are normalised to lower
case words of ASCII letters and digits; a set holds the distinct pairs of neighbouring words. Dice(a, b) >= t is only possible when
|a| * t / (2 - t) <= |b| <= |a| * (2 - t) / t, so each template is listed once for every size its partner can have,
and units meet templates by an equality join on their size: a unit no template could match meets none.

Defined results: null texts, texts without two words and empty tables give no rows; a unit that matches several
templates equally well gets the smallest template_id; repeated rows of a document give its rows once; other columns
of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.llm import text as T

#: Template tables up to this many rows are sent to every executor; larger ones are joined by shuffling.
BROADCAST_TEMPLATES = 10_000

# Notices by which texts state their licence.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-3-clause-terms": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "isc-terms": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-terms": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring normalised words."""
    normal = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    pairs = T.bind(
        F.split(normal, " "),
        lambda w: F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))
        ),
    )
    return F.array_distinct(pairs)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = sorted(templates.items())
    return spark.createDataFrame(rows, "template_id string, template string").select(
        "template_id", bigrams(F.col("template")).alias("template_bigrams")
    )


def partner_sizes(threshold: float) -> Column:
    """All set sizes with which a template can reach the threshold."""
    size = F.size("template_bigrams")
    low = F.greatest(F.ceil(size * threshold / (2 - threshold) - 1e-9), F.lit(1))
    return F.sequence(low.cast("bigint"), F.floor(size * (2 - threshold) / threshold + 1e-9).cast("bigint"))


def license_scan(
    docs: DataFrame,
    templates: DataFrame | None = None,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
) -> DataFrame:
    """Best template of every unit that reaches the threshold: doc_id, line_no, template_id, dice."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if templates is None:
        templates = template_table(docs.sparkSession, TEMPLATES)
    listed = templates.withColumn("size", F.explode(partner_sizes(threshold)))
    if templates.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        listed = F.broadcast(listed)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    units = F.concat(
        F.array(F.struct(F.lit(-1).alias("line_no"), F.col("text").alias("unit"))),
        F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), line.alias("unit"))),
    )
    sized = (
        source.select("doc_id", F.inline(units))
        .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), bigrams(F.col("unit")).alias("bigrams"))
        .withColumn("size", F.size("bigrams").cast("bigint"))
        .where(F.col("size") > 0)
    )
    shared = F.size(F.array_intersect("bigrams", "template_bigrams"))
    dice = 2 * shared / (F.col("size") + F.size("template_bigrams"))
    best = F.min(F.struct((-F.col("dice")).alias("below"), "template_id", "dice"))
    return (
        sized.join(listed, "size")
        .withColumn("dice", dice)
        .where(F.col("dice") >= threshold)
        .groupBy("doc_id", "line_no")
        .agg(best.alias("best"))
        .select("doc_id", "line_no", "best.template_id", "best.dice")
    )
