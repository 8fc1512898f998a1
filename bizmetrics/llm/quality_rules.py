"""Quality rules: repetition and length rules, then divergence from the language's histograms.

Two histograms describe a document: its characters by class and its words by common word of its language. Each is
compared with the histogram of all documents of that language by Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1), and its common words also with those of the other languages. Only built-in expressions run; words are hashed to 64 bits inside one document to find
repeated windows.

Defined results: a null text has no words and fails the base rules; a null or unknown language has no reference and
is judged by the base rules alone; texts shorter than a guard skip that comparison; repeated rows are judged alike;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm import text as T

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "with", "this", "by", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}

#: Character classes in the order in which they are counted; what none of them matches is the last class.
CHARACTER_CLASSES = {
    "lower": "[a-z]+",
    "space": T.SPACE + "+",
    "upper": "[A-Z]+",
    "punctuation": r"[.,;:!?'\"()-]+",
    "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+",
}

WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(starts):
        reach = F.transform(
            starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def starts_of(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return T.bind(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def count(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            T.bind(starts_of(hashes), covered)
        )

    def windows(hashed):
        return F.transform(
            F.sequence(F.lit(0), F.size(hashed) - WINDOW),
            lambda i: F.xxhash64(F.slice(hashed, i + 1, WINDOW)),
        )

    per_word = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(
        T.bind(per_word, lambda hashed: T.bind(windows(hashed), count))
    )


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with class_counts, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    The array ``_words`` stays for later steps.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(T.NOT_SPACE))
    measured = docs.withColumns(
        {"_words": T.words(F.col(text)), "_lines": lines, "class_counts": _class_counts(body)}
    ).withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": (F.length(body) - F.get("class_counts", F.lit(list(CHARACTER_CLASSES).index("space")))).cast("bigint"),
            "n_symbols": F.get("class_counts", F.lit(list(CHARACTER_CLASSES).index("symbol"))),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).drop("_lines")


def _class_counts(body: Column) -> Column:
    """Code points of each character class, then of all others. Each class is taken out before the next is counted."""

    def take(rest: Column, patterns: list[str], lengths: list[Column]) -> Column:
        if not patterns:
            return F.array(*[a - b for a, b in zip(lengths, lengths[1:])], lengths[-1])
        return T.bind(
            F.regexp_replace(rest, patterns[0], ""),
            lambda left: take(left, patterns[1:], [*lengths, F.length(left).cast("bigint")]),
        )

    return take(body, list(CHARACTER_CLASSES.values()), [F.length(body).cast("bigint")])


def _common_counts(words: Column, language: Column) -> Column:
    """For each language of ``COMMON_WORDS`` the counts of its common words, then of all other words; null without a language."""
    listed_words = {w for ws in COMMON_WORDS.values() for w in ws}
    forms = sorted(listed_words | {w.upper() for w in listed_words} | {w.capitalize() for w in listed_words})
    hits = F.concat_ws("  ", F.filter(words, lambda w: w.isin(forms)))

    def counts(joined, listed):
        found = F.transform(
            F.array(*[F.lit(w) for w in listed]),
            lambda w: (
                (F.length(joined) - F.length(F.replace(joined, F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))))
                / (F.length(w) + 2)
            ).cast("bigint"),
        )
        return T.bind(
            found,
            lambda c: F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))),
        )

    of_all = T.bind(
        F.concat(F.lit(" "), F.lower(hits), F.lit(" ")),
        lambda joined: F.array(*[counts(joined, listed) for listed in COMMON_WORDS.values()]),
    )
    return F.when(language.isin(sorted(COMMON_WORDS)), of_all)


def _of_own(counts: Column, language: Column) -> Column:
    """The counts for the document's language."""
    place = F.array_position(F.array(*[F.lit(k) for k in COMMON_WORDS]), language).cast("int") - 1
    return F.when(language.isin(sorted(COMMON_WORDS)), F.get(counts, place))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null where one of them is missing or empty."""

    def total(histogram):
        return F.aggregate(histogram, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")

    def part(p, q):
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def both(sums):
        terms = F.zip_with(
            counts,
            reference,
            lambda a, b: part(a / sums["a"], b / sums["b"]) + part(b / sums["b"], a / sums["a"]),
        )
        divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
        return F.when((sums["a"] > 0) & (sums["b"] > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))

    return T.bind(F.struct(total(counts).alias("a"), total(reference).alias("b")), both)


def quality_rules(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    max_class_distance: float = 0.25,
    max_word_distance: float = 0.6,
    max_other_share: float = 0.7,
    language_margin: float = 0.3,
    min_chars: int = 200,
    min_words: int = 100,
) -> DataFrame:
    """One row per document: the base measures, both distances, and whether the document is kept.

    A document is also dropped when its common words are another language's: its distance to that language is at most
    ``max_other_share`` of the distance that a text without any common word has there, and so measured it lies
    ``language_margin`` nearer than to its own language.

    The references are the summed histograms of every document of a language that passes the base rules. One pass
    over the texts writes the counts (a few dozen integers per document); references and verdicts come from them.
    """
    source = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(language).alias("lang")
    )
    counted = cut_lineage(
        base_measures(source)
        .withColumn("language_counts", _common_counts(F.col("_words"), F.col("lang")))
        .withColumn("word_counts", _of_own(F.col("language_counts"), F.col("lang")))
        .drop("_words", "text")
    )
    sums = [
        F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)]).alias(f"{name}_reference")
        for name, size in (("class_counts", len(CHARACTER_CLASSES) + 1), ("word_counts", 17))
    ]
    known = F.col("lang").isin(sorted(COMMON_WORDS))
    references = counted.where(known & ~F.col("base_failed")).groupBy("lang").agg(*sums)
    without = F.array(*[F.lit(0).cast("bigint")] * 16, F.lit(1).cast("bigint"))
    references = cut_lineage(references.withColumn("farthest", distance(without, F.col("word_counts_reference"))))
    entry = F.struct("lang", F.struct(F.col("word_counts_reference").alias("reference"), "farthest"))
    by_language = references.agg(F.map_from_entries(F.collect_list(entry)))
    # At most one row per language of COMMON_WORDS; each holds the references of all.
    references = cut_lineage(references.withColumn("by_language", by_language.scalar()))
    judged = (
        counted.join(F.broadcast(references), "lang", "left")
        .withColumns(
            {
                "class_distance": distance(F.col("class_counts"), F.col("class_counts_reference")),
                "word_distance": distance(F.col("word_counts"), F.col("word_counts_reference")),
                "n_chars": F.aggregate("class_counts", F.lit(0).cast("bigint"), lambda a, x: a + x),
            }
        )
    )

    def nearer(place: int, name: str) -> Column:
        other = F.try_element_at("by_language", F.lit(name))
        return (F.col("lang") != name) & T.bind(
            F.struct(distance(F.get("language_counts", F.lit(place)), other["reference"]).alias("d"), other["farthest"].alias("farthest")),
            lambda o: (o["d"] <= max_other_share * o["farthest"])
            & (o["d"] * F.col("farthest") < (F.col("word_distance") - language_margin * F.col("farthest")) * o["farthest"]),
        )

    foreign = F.lit(False)
    for place, name in enumerate(COMMON_WORDS):
        foreign = foreign | F.coalesce(nearer(place, name), F.lit(False))
    far = ((F.col("n_words") >= min_words) & foreign) | (
        F.coalesce((F.col("n_chars") >= min_chars) & (F.col("class_distance") > max_class_distance), F.lit(False))
    ) | F.coalesce((F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance), F.lit(False))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
        "class_distance",
        "word_distance",
    )
