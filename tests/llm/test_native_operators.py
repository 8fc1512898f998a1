"""Licence scan, quality rules, line dedup and mixing: defined results in odd cases; SQL twins are in test_oracle.py."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bizmetrics.llm.license_scan import TEMPLATES, license_scan
from bizmetrics.llm.line_dedup import line_dedup
from bizmetrics.llm.quality_rules import COMMON_WORDS, quality_rules, repeated_words
from bizmetrics.llm.source_mixing import mix_sources, mixed_documents, targets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_license_scan_finds_edited_notices_and_the_smallest_template_of_equals(spark):
    gpl = TEMPLATES["gpl-3.0-notice"]
    rows = [
        (1, "Some text\nReleased under the MIT License!\nmore text", "x"),
        (2, gpl.replace("software", "program") + "\nother words", "x"),
        (3, gpl.replace(",", "\n"), "x"),
        (4, None, "x"),
        (5, "", "x"),
        (6, "license", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, template_id string")
    found = {(r.doc_id, r.line_no, r.template_id) for r in license_scan(docs).collect()}
    assert (1, 1, "mit") in found and (2, 0, "gpl-3.0-notice") in found
    assert (3, -1, "gpl-3.0-notice") in found and {d for d, _, _ in found} == {1, 2, 3}
    assert license_scan(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        license_scan(docs, threshold=0.0)


def test_license_scan_on_odd_documents(tricky):
    assert license_scan(tricky).columns == ["doc_id", "line_no", "template_id", "dice"]
    assert license_scan(tricky).count() == 0


def test_repeated_words_against_brute_force(spark):
    texts = ["a b c d e f", "a b c d e a b c d e", "a a a a a a a", "x y " * 9, "", "a b c d", "p q r s t u " * 2 + "z"]
    frame = spark.createDataFrame([(i, words(t)) for i, t in enumerate(texts)], "i int, w array<string>")
    got = {r.i: r.n for r in frame.select("i", repeated_words(F.col("w")).alias("n")).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + d for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for d in range(5)}
        assert got[i] == len(covered), text


def test_quality_rules_on_odd_documents(tricky):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules(tricky).collect()}
    assert rows[3, 0].base_failed and not rows[3, 0].kept and rows[None, 0].base_failed
    assert rows[1, 60].kept and rows[6, 40_000].base_failed is False and not rows[10, 120].kept
    assert quality_rules(tricky).count() == tricky.count()
    assert rows[None, 30].class_distance is None and rows[None, 30].kept
    assert quality_rules(tricky.limit(0)).collect() == []


def test_quality_rules_drop_what_differs_from_the_language(spark):
    plain = [(i, f"the people of the town and the river in a {i} story that is told to {i} of them by one", "en") for i in range(60)]
    odd = [(100, " ".join(f"@@{i}//" for i in range(200)), "en")]
    docs = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert not kept[100] and all(kept[i] for i in range(60))


def test_quality_rules_drop_a_text_in_another_language_than_stated(spark):
    rng = random.Random(5)

    def text(language, n=200):
        return " ".join(rng.choice(COMMON_WORDS[language]) if rng.random() < 0.3 else f"wo{rng.choice('abcdefgh')}{rng.choice('klmnop')}r" for _ in range(n))

    right = [(i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 20)]
    wrong = [(100, text("de"), "en"), (101, text("en"), "fr"), (102, text("fr"), "es"), (103, text("es"), "de")]
    unjudged = [(200, text("de", 60), "en"), (201, text("de"), "xx"), (202, text("de"), None)]
    docs = spark.createDataFrame(right + wrong + unjudged, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert {i for i in kept if not kept[i]} == {i for i, _, _ in wrong}


def test_line_dedup_keeps_one_copy_and_merges_overlaps(spark):
    a = [f"line {i}" for i in range(6)]
    rows = [
        (1, "\n".join(a)),
        (2, "\n".join(["new", *a[:5], "end"])),
        (3, "\n".join(a[:2])),
        (4, "same\n" * 4 + "same"),
        (5, "\n\n\n\n"),
        (6, None),
        (7, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("gone", F.lit("x"))
    out = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert out[1].kept_text == "\n".join(a) and out[1].n_removed == 0
    assert out[2].kept_text == "new\nend" and out[2].n_removed == 5
    assert out[3].n_removed == 0 and out[4].kept_text == "same" and out[4].n_removed == 4
    assert out[5].n_removed == 0 and out[6].n_lines == 0 and out[6].kept_text is None and out[7].kept_text == ""
    assert out[1].gone == "x" and out[1].key == 1
    assert line_dedup(docs.limit(0)).collect() == []


def test_line_dedup_on_odd_documents(tricky):
    out = line_dedup(tricky)
    assert out.count() == tricky.count()
    assert set(tricky.columns) <= set(out.columns)


@pytest.mark.parametrize("sizes", [[10, 0, 5], [1], [100, 1, 1, 1], [7, 7, 7, 7, 7], [0, 0]])
def test_targets_against_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in targets(frame).collect()}
    weight = {f"s{i}": (5, 2, 1)[i % 3] for i in range(len(sizes))}
    cap = {f"s{i}": 2.0 * s for i, s in enumerate(sizes)}
    budget, open_sources, want = 1.5 * sum(sizes), set(cap), {}
    while open_sources:
        level = (budget - sum(want.values())) / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if level * weight[s] > cap[s] + 1e-12}
        want |= {s: cap[s] for s in over} if over else {s: level * weight[s] for s in open_sources}
        open_sources -= over or open_sources
    assert got == pytest.approx(want)


def test_mixing_comes_near_its_targets(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = mix_sources(docs).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    again = {(r.doc_id, r.taken) for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixing_odd_documents(tricky):
    rows = mix_sources(tricky).collect()
    assert len(rows) == tricky.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    mixed = mixed_documents(tricky)
    assert mixed.columns == tricky.columns
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mix_sources(tricky.limit(0)).collect() == [] and mixed_documents(tricky.limit(0)).collect() == []
    assert mixed_documents(tricky.where("text is null")).collect() == []
