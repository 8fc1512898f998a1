"""Filter audit, spelling variants and substring dedup against brute force, and in odd cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import english
from pyspark.sql import functions as F

from bizmetrics.llm import catalog
from bizmetrics.llm.filter_audit import FIVE, among, filter_audit, five_filters, gallop, merged
from bizmetrics.llm.spelling_variants import Acceptor, near_words, one_edit_pairs, roots_of, spelling_variants, word_counts
from bizmetrics.llm.substring_dedup import _KEY, _PLACE, _cut, _later, _merge_slices, _sketches, substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------------------------------------- filter audit


def test_galloping_agrees_with_plain_search():
    rng = np.random.default_rng(5)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (300, 7), (7, 300), (2_000, 2_000), (500, 100_000)]:
        a, b = (np.unique(rng.integers(0, 4 * max(n, m, 1), k)) for k in (n, m))
        assert (gallop(a, b) == np.searchsorted(b, a)).all()
        assert (merged(a, b) == np.union1d(a, b)).all() and (merged(b, a) == np.union1d(a, b)).all()
        assert (among(a, b) == np.isin(a, b)).all()
    far = np.array([1, 2, 3, 10_000_000])
    assert gallop(far, np.arange(0, 1_000_000)).tolist() == [1, 2, 3, 1_000_000]


def audit_by_hand(rows, k, n_flags):
    """rows: (part, fails of k filters, flags)."""
    found = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        removals = Counter()
        for order in permutations(range(k)):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fails = sum(r[1][f] for r in here)
                only = sum(r[1][f] and sum(r[1]) == 1 for r in here)
                lost = [sum(r[2][i] for r in gone) for i in range(n_flags)]
                found[part, order, step] = [len(left), len(gone), fails - len(gone), only, *lost]
                removals[f] += len(gone)
        for (p, order, step), row in found.items():
            if p == part:
                row.append(removals[order[step - 1]])
    return found


def test_audit_against_every_order_run_by_hand(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", "y", "y"]), [rng.random() < p for p in (0.1, 0.5, 0.9, 0.02)], [rng.random() < 0.4]) for _ in range(700)]
    rows += [("none", [False] * 4, [True]), ("all", [True] * 4, [True])]
    names = "PQRS"
    frame = spark.createDataFrame([(p, *f, *g) for p, f, g in rows], "place string, P boolean, Q boolean, R boolean, S boolean, g boolean")
    audit = filter_audit(frame.repartition(5), list(names), ["g"], part="place")
    assert audit.columns == ["place", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "g_lost", "shapley"]
    got = {(r.place, tuple(names.index(c) for c in r.filter_order), r.step): list(r)[3:] for r in audit.collect()}
    assert got == audit_by_hand(rows, 4, 1)
    assert len(got) == 4 * 24 * 4
    assert filter_audit(frame.limit(0), list(names), ["g"], part="place").count() == 0
    with pytest.raises(ValueError):
        filter_audit(frame, [])


def five_by_hand(docs, labels):
    smallest = {}
    for r in docs:
        if r.doc_id is not None:
            smallest[r.text or ""] = min(r.doc_id, smallest.get(r.text or "", r.doc_id))
    good, toxic = ({r.doc_id for r in labels if r[kind] == 1 and r.doc_id is not None} for kind in ("quality", "toxic"))
    rows = []
    for r in docs:
        text, w = r.text or "", words(r.text)
        fails = [
            len(w) < 100,
            100 * len(set(w)) < 80 * len(w),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            r.doc_id is not None and smallest[text] < r.doc_id,
        ]
        rows.append((r.lang or "", fails, [r.doc_id in good, r.doc_id in toxic]))
    return rows


def test_five_filters_on_odd_documents(spark, tricky, tricky_labels):
    more = spark.createDataFrame([(40, "", "en"), (41, None, ""), (42, "SHOUT " * 120, "en"), (None, "SHOUT " * 120, "en")], "doc_id long, text string, lang string")
    docs = tricky.unionByName(more, allowMissingColumns=True)
    rows = five_by_hand(docs.collect(), tricky_labels.collect())
    got = [(r.part, [r[c] for c in FIVE], [r.good, r.toxic]) for r in five_filters(docs, tricky_labels).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(rows, key=key)
    audit = filter_audit(five_filters(docs, tricky_labels), FIVE, ("good", "toxic")).collect()
    assert {(r.part, tuple(FIVE.index(c) for c in r.filter_order), r.step): list(r)[3:] for r in audit} == audit_by_hand(rows, 5, 2)
    empty = five_filters(docs.limit(0), tricky_labels)
    assert filter_audit(empty, FIVE, ("good", "toxic")).count() == 0
    assert five_filters(docs, tricky_labels.limit(0)).where("good or toxic").count() == 0


# ------------------------------------------------------------------------------------------ spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_by_hand(vocabulary):
    """Words that meet after one deletion, or one deletion and the word itself, checked."""
    holes = defaultdict(set)
    for w in vocabulary:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    return {(a, b) for met in holes.values() for a in met for b in met if one_edit(a, b)}


def test_acceptor_is_minimal_and_numbers_its_words():
    listed = sorted({"tap", "taps", "top", "tops", "", "t"})
    a = Acceptor(listed)
    assert len(a.out) == len({(a.final[s], tuple(sorted(a.out[s].items()))) for s in range(len(a.out))})
    for number, word in enumerate(listed):
        state, total = a.start, 0
        for c in word:
            state, before = a.out[state][c]
            total += before
        assert a.final[state] and total == number
    # "ap(s)" and "op(s)" end alike: start, t, a/o, p, s
    assert len(a.out) == 5


def test_composition_finds_each_pair_once():
    rng = random.Random(3)
    for letters, longest in (("ab", 7), ("abc", 6), ("abcdefgh", 4), ("aéÿ×", 5)):
        listed = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(150)})
        pairs = [(listed[a], listed[b]) for a, b in one_edit_pairs(listed)]
        assert all(len(u) <= len(v) for u, v in pairs)
        assert len(pairs) == len({frozenset(p) for p in pairs})
        assert {(u, v) for p in pairs for u, v in (p, p[::-1])} == near_by_hand(listed)


def test_composition_of_very_long_words():
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefg") for _ in range(30_000))
    listed = sorted({long, long[:15_000] + long[15_001:], long[:-1] + "z", "z" + long[1:]})
    assert {frozenset((listed[a], listed[b])) for a, b in one_edit_pairs(listed)} == {frozenset((long, w)) for w in listed if w != long}


def test_near_words_across_partitions(spark):
    rng = random.Random(4)
    listed = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(1_500)})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(listed)], "word string, n long")
    got = [(r.word, r.near) for r in near_words(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_hand(listed)


def counted_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            counts[word] += 1
    return counts


def variants_by_hand(counts):
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(set)
    for a, b in near_by_hand(vocabulary):
        near[a].add(b)
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        if best is not None and vocabulary[best] >= 5 * n:
            form[w] = best
    rows = set()
    for w, n in vocabulary.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, n, len(near[w]), form.get(w), vocabulary.get(form.get(w)), root))
    return rows


def test_query_equals_brute_force_over_the_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in catalog.op12_spelling_variants(spark, medium).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == variants_by_hand(counted_by_hand(docs))


def test_variants_with_chains_ties_and_odd_documents(spark, tricky):
    planted = {"correct": 700, "corect": 120, "corekt": 20, "coreky": 4, "xorrect": 140, "gamma×": 9, "Ünüber": 30, "ünüber": 6}
    text = " ".join(f"{w}," for w, n in planted.items() for _ in range(n))
    odd = "A" * 70_000 + " " + "a" * 69_999
    extra = spark.createDataFrame([(100 + i, text) for i in range(2)] + [(200 + i, odd) for i in range(5)] + [(300, "CORRECT études")], "doc_id long, text string")
    docs = tricky.unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.word: r.n for r in word_counts(docs).collect()} == counted_by_hand(rows)
    got = {tuple(r) for r in spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == variants_by_hand(counted_by_hand(rows))
    by_word = {r[0]: r for r in got}
    assert by_word["corekt"][3] == "corect" and by_word["corekt"][5] == "correct" and by_word["correct"][3] is None
    assert by_word["ünüber"][3] == "Ünüber" or by_word["ünüber"][3] is None
    assert spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(docs, ratio=1)


def test_roots_of_long_chains(spark):
    frame = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 37 else None) for i in range(38)], "word string, form string")
    assert {(r.word, r.root) for r in roots_of(frame).collect()} == {(f"w{i}", "w37") for i in range(37)}
    assert roots_of(frame.where("form is null")).count() == 0


# ------------------------------------------------------------------------------------------- substring dedup


def removed_by_hand(rows, width):
    """rows: (doc_id, text), ids differ. Kept words and number of removed ones per id."""
    texts = {i: words(t) for i, t in rows}
    seen, gone = set(), defaultdict(set)
    for i in sorted(texts, key=lambda i: (i is not None, i)):
        for p in range(len(texts[i]) - width + 1):
            window = tuple(texts[i][p : p + width])
            if window in seen:
                gone[i].update(range(p, p + width))
            seen.add(window)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in texts.items()}


def test_substrings_against_brute_force(spark):
    rng = random.Random(6)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(3, 60))] for k in range(12)]
    rows = [(None, " ".join(passages[0] * 2)), (-5, None), (-4, ""), (-3, " \n\t"), (-2, "a b   c"), (0, "same " * 90)]
    for i in range(1, 140):
        body = [f"own{i}x{k}" for k in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(body)))
    rows += [(200 + k, rows[20 + k][1]) for k in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for width, held in ((5, 50), (20, 1_000_000), (1, 300)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text or "") for r in substring_dedup(docs, width=width, sketch_windows=held).collect()}
        assert got == removed_by_hand(rows, width), width
    with pytest.raises(ValueError):
        substring_dedup(docs, width=0)


def test_substrings_of_odd_documents(spark, tricky):
    clash = tricky.withColumns({c: F.lit(1) for c in ("file", "c0", "_metadata", "n_removed", "Kept_Text")})
    got = substring_dedup(clash).collect()
    assert len(got) == tricky.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.text].append((r.n_words, r.n_removed, r.kept_text))
    first = english(1, 60)
    assert by[1, first] == [(60, 0, first)] * 2  # repeated rows are one document: both stay
    edited = first.replace("word1x5 ", "changed ")
    assert by[2, edited] == [(60, 54, " ".join(edited.split()[:6]))]
    assert by[3, None] == [(0, 0, None)] and by[4, ""] == [(0, 0, "")] and by[5, " \n\t \n"] == [(0, 0, "")]
    assert by[None, None] == [(0, 0, None)] and by[10, "*** ### $$$ " * 40][0][:2] == (120, 117 + 0)
    assert all(r.key == "k" and r._metadata == 1 and r.file == 1 for r in got)
    assert substring_dedup(clash.limit(0)).count() == 0


def test_a_passage_that_a_third_of_all_documents_share(spark):
    shared = english(9, 70)
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(shared + " "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("only "), F.col("id"))).alias("text"),
    )
    got = substring_dedup(docs.repartition(9), sketch_windows=500).where("n_removed > 0")
    assert got.count() == 999 and got.where("n_removed = 70 and kept_text = cast(doc_id as string)").count() == 999


def test_removed_windows_are_looked_up_once_per_piece_of_text(tmp_path, monkeypatch):
    """Not once per row: that reads through all removed windows of the file each time, so its time grew with the square of a file."""
    own = " ä\n{0}a  {0}b\t{0}c \x0b{0}d {0}e\x0c "
    texts = [None if i % 50 == 7 else " \n" if i % 50 == 8 else own.format(i) for i in range(1_000)]
    gone = [(i, start) for i, t in enumerate(texts) for start in ((0,), (2, 3), (), (1, 4))[i % 4] if t and t.strip()]
    rows, starts = (np.array(c, "<u4").tobytes() for c in zip(*random.Random(1).sample(gone, len(gone))))
    (tmp_path / "file=f").mkdir()
    pq.write_table(pa.table({"rows": [rows], "starts": [starts]}), tmp_path / "file=f" / "part-0.parquet")
    calls, search = [], np.searchsorted

    def counted(*args, **options):
        calls.append(len(args[0]))
        return search(*args, **options)

    monkeypatch.setattr(np, "searchsorted", counted)
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"] * n), pa.array(range(n), pa.int64()), pa.array(range(n)), pa.array(texts)], ["file", "row", "c0", "c1"]
    )
    got = [r for b in _cut(iter([batch.slice(0, 600), batch.slice(600)]), folder=str(tmp_path), width=2, text_at=3) for r in b.to_pylist()]
    assert len(calls) < 20
    for i, (text, r) in enumerate(zip(texts, got, strict=True)):
        cut = {start + k for row, start in gone if row == i for k in (0, 1)}
        kept = None if text is None else " ".join(w for k, w in enumerate(words(text)) if k not in cut)
        assert r == {"c0": i, "c1": text, "n_words": len(words(text)), "n_removed": len(cut), "kept_text": kept}


def test_entries_of_small_sketches_travel_together():
    """Every sketch has an entry per slice, so their number outgrows the text's: a batch for each of them took most of the time."""
    texts = [" ".join(f"t{i % 400}w{k}" for k in range(60)) for i in range(800)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"f{i // 50}" for i in range(800)]), pa.array(range(800), pa.int64()), pa.array(range(800)), pa.array(texts)],
        ["file", "row", "id", "body"],
    )
    sketches = pa.Table.from_batches(_sketches(iter([batch]), width=20, bits=20, slice_bits=4, most=1 << 21)).sort_by("slice")
    assert len(sketches) == 16 * 2 * 16
    answers = list(_merge_slices(iter(sketches.to_batches()), local_bits=16))
    assert sum(len(a) for a in answers) == 16 * 2 * 16 and len(answers) <= 2  # each text comes twice, in two files


def test_later_windows_against_brute_force():
    rng = np.random.default_rng(3)
    keys, doc = np.empty(5_000, _KEY), np.sort(rng.integers(0, 60, 5_000))
    keys["a"], keys["b"] = rng.integers(0, 40, 5_000), rng.integers(0, 30, 5_000)  # many agree in one half only
    docs = np.array([(rng.integers(-5, 5), rng.integers(0, 3), i, 0) for i in range(60)], _PLACE)
    starts = rng.integers(0, 50, 5_000).astype(np.uint32)
    place = [(docs["id"][d], docs["digest"][d], s) for d, s in zip(doc, starts)]
    least = {}
    for key, p in zip(keys.tolist(), place):
        least[key] = min(p, least.get(key, p))
    assert _later(keys, docs, doc, starts).tolist() == [p > least[key] for key, p in zip(keys.tolist(), place)]
