"""Joins, models and file formats against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bizmetrics.llm import catalog, hashing, html_extraction, jaccard_join, range_coder, token_files, warc
from bizmetrics.llm.decontamination import align, contaminated, decontaminate, item_words
from bizmetrics.llm.files import locate, output_folder
from bizmetrics.llm.jaccard_join import keep_one, near_duplicates
from bizmetrics.llm.quality_model import keep_good, score_quality
from bizmetrics.llm.token_files import read_ids, write_ids


@pytest.fixture(autouse=True)
def package_for_workers(spark, small):
    catalog.table(spark, small, "labels")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups_by_brute_force(rows, threshold=75):
    sets = {}
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n_families=12, members=10):
    """Texts of 1 to 300 words in families of copies with few or many edits, some sharing a passage."""
    rng = random.Random(seed)
    passage = [f"common{i}" for i in range(70)]
    rows = []
    for f in range(n_families):
        size = rng.choice([1, 3, 6, 8, 12, 30, 40, 70, 130, 300])
        base = [f"w{f}x{i}" for i in range(size)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, size // 40), max(1, size // 25)])):
                text[rng.randrange(len(text))] = f"e{rng.random()}"
            if rng.random() < 0.3:
                text += passage
            rows.append((len(rows) + 1, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_jaccard_groups_against_brute_force(spark, seed):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == groups_by_brute_force(rows)


@pytest.mark.parametrize("plan", [None, (0, False), (1, False), (2, True), (6, False)])
def test_linked_sets_share_a_signature_under_every_allocation(plan):
    """Also with far too few segments, where single shingles take over."""
    rng = np.random.default_rng(5)
    for size in [1, 2, 3, 4, 9, 31, 33, 64, 100, 127, 500]:
        for _ in range(20):
            whole = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            cut = int(rng.integers(0, jaccard_join.distance_bound(size, 0.75) + 1))
            fresh = int(rng.integers(0, cut + 1))
            other = np.concatenate([whole[cut:], rng.integers(0, 1 << 63, fresh, dtype=np.uint64)])
            one, other = np.unique(whole), np.unique(other)
            shared = len(np.intersect1d(one, other))
            if not len(other) or shared < 0.75 * (len(one) + len(other) - shared):
                continue
            hot = set(rng.choice(whole, size // 2).tolist()) | (set(whole[cut:].tolist()) if rng.random() < 0.6 else set())
            allocation = {}
            if plan:
                allocation = {b: jaccard_join.Allocation(0 if plan[0] == 0 else max(1, (1 << b) >> plan[0]), plan[1]) for b in range(1, 12)}
            marks = [np.array([int(x) in hot for x in s], bool) for s in (one, other)]
            rare = [jaccard_join.rare_signatures(s, m, 0.75) for s, m in zip((one, other), marks)]
            frequent = [jaccard_join.hot_signatures(s, m, allocation, 0.75) for s, m in zip((one, other), marks)]
            if len(np.intersect1d(one[~marks[0]], other[~marks[1]])):
                assert len(np.intersect1d(*rare)), (size, cut, fresh)
            else:
                assert len(np.intersect1d(*frequent)), (size, cut, fresh)
                n, spare = (np.array(c) for c in zip(*[(len(s), (~m).sum()) for s, m in zip((one, other), marks)]))
                assert jaccard_join._possible(n[:1], spare[:1], n[1:], spare[1:], 0.75).all()


def test_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(8)
    sets = []
    for size in (1, 5, 40, 63, 64, 120, 127, 128, 130, 500, 520, 1_000):
        whole = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for cut in (0, size // 8, size // 3):
            sets.append(np.unique(np.concatenate([whole[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])))
    i, j = np.triu_indices(len(sets), 1)
    least = jaccard_join.differences([jaccard_join.odd_sketch(s) for s in sets], i, j)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (least <= true).all()
    size = np.array([len(s) for s in sets])
    kin = (i // 3 == j // 3) & (size[i] >= 40) & (true <= 0.5 * size[i])  # such as a threshold has to tell apart
    assert kin.sum() > 8 and (least[kin] >= 0.6 * true[kin]).all()


@pytest.mark.parametrize("salts", [1, 3])
def test_sets_that_share_a_frequent_passage_are_no_pairs(spark, salts, monkeypatch):
    """Three quarters of every set are one template: all meet in its signatures, nobody links, and no pair is compared."""
    template, n = [f"t{i}" for i in range(90)], 600
    rows = [(i, " ".join(template + [f"own{i}x{k}" for k in range(30)])) for i in range(n)]
    rows += [(n + i, " ".join(template[: 60 + i] + [f"other{i}"])) for i in range(20)]  # near copies of parts of it
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(jaccard_join, "SETS_PER_SALT", n // salts + 100 if salts > 1 else 200_000)
    monkeypatch.setattr(jaccard_join, "BUCKET_SETS", 100 if salts > 1 else 8192)
    counted = []
    verify = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda docs, classes, pairs, *a: counted.append(pairs.count()) or verify(docs, classes, pairs, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == groups_by_brute_force(rows)
    assert sum(counted) < 4 * n


def test_a_pair_of_many_buckets_is_made_about_once(spark, monkeypatch):
    """Thirty sets meet in two hundred buckets of changing members, over sixteen tasks: each pair is there, few come twice."""
    rng, n = random.Random(7), 30
    met = [(s * 7919, sorted(rng.sample(range(n), 25))) for s in range(200)]
    rows = [(s, some[0], 100, -1, c, 100, -1, True) for s, some in met for c in some[1:]]
    rows += [(s + 1, *row) for s, *row in rows]  # every bucket twice
    buckets = spark.createDataFrame(rows, jaccard_join._BUCKET)
    classes = spark.createDataFrame([(c, bytes(16)) for c in range(n)], "class_id long, sketch binary")
    labels = spark.createDataFrame([], "node long, label long")
    made, frame = spark.sparkContext.accumulator(0), type(buckets)
    plain = frame.mapInArrow

    def counting(df, run, schema):
        def counted(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(df, counted, schema)

    monkeypatch.setattr(frame, "mapInArrow", counting)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = sorted((r.a, r.b) for r in jaccard_join._across(buckets, classes, labels, 0.75).collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert made.value < 2 * len(got)


def test_near_copies_of_a_template_meet_its_nearest_set_first(spark, monkeypatch):
    """Sets that link with the template but not with each other are joined by one comparison each, before any other pair is made."""
    rng, template = random.Random(4), [f"t{i}" for i in range(150)]
    rows = [(1000, " ".join(template))]
    for k in range(80):
        text = list(template)
        for place in rng.sample(range(10, 140, 10), 4):
            text[place] = f"e{k}x{place}"
        rows.append((k, " ".join(text)))
    made, across = [], jaccard_join._across

    def counting(*given):
        made.append((found := across(*given)).count())
        return found

    monkeypatch.setattr(jaccard_join, "_across", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == groups_by_brute_force(rows) and len({c for _, c in got.values()}) == 1
    assert made == [0]


def test_null_ids_and_shared_ids_are_judged_by_their_own_text(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(k)) for k in range(30)] + [(None, text(0)), (5, text(0)), (6, text(1)), (7, text(2)), (7, text(3)), (7, text(40)), (7, text(40)), (8, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text.split("x")[0]) for r in keep_one(docs).collect())
    # Groups 0 to 3 have a row with an id; 4 to 29 have only their row without; text 40 is there twice under one id.
    want = [("5", "w0"), ("6", "w1"), ("7", "w2"), ("7", "w3"), ("7", "w40"), ("8", ""), ("8", "")] + [("None", f"w{k}") for k in range(4, 30)]
    assert kept == sorted(want)


def test_jaccard_on_odd_documents(tricky):
    rows = near_duplicates(tricky).collect()
    assert len(rows) == tricky.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)] and by[9] == [(1, 9)]
    assert by[7] == by[8][:1] == [(1, 7)] and by[1] == [(56, 1)] * 2 and sorted(by[2]) == [(46, 2), (56, 1)]
    kept = keep_one(tricky)
    assert kept.columns == tricky.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, None, None, 7, 9, 10]))
    assert near_duplicates(tricky.limit(0)).collect() == [] and keep_one(tricky.limit(0)).collect() == []


def test_decontamination_finds_copies_and_edits_and_leaves_the_rest(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"q{i}n{k}" for k in range(40))) for i in range(5)] + [(9, None), (10, "too short"), (11, "")]
    filler = " ".join(f"plain{k}" for k in range(300))
    edited = items[1][1].split()
    for k in rng.sample(range(40), 8):
        edited[k] = "changed"
    del edited[20]
    docs = [
        (1, filler + " " + items[0][1].upper() + "! " + filler),
        (2, filler + " " + " ".join(edited)),
        (3, filler),
        (4, None),
        (5, ""),
        (6, "q2n1 q2n2 q2n3 " + filler),
        (None, items[3][1]),
        (7, "too short"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(-1)).withColumn("score", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in contaminated(frame, bench, items_per_block=3).collect()}
    assert set(found) == {(1, 0), (2, 1), (None, 3)}
    assert found[1, 0] == 1.0 and 0.5 < found[2, 1] < 0.9
    clean = decontaminate(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(["3", "4", "5", "6", "7", "None"])
    assert contaminated(frame, bench.limit(0)).collect() == [] and contaminated(frame.limit(0), bench).collect() == []


def test_decontamination_of_one_document_does_not_depend_on_the_others(spark):
    item = [f"q{k}" for k in range(30)]
    half = [(i, f"plain{i} begins " + " ".join(item[:15]) + f" and ends {i}") for i in range(20)]
    other = [(100 + i, " ".join(f"plain{i}x{k}" for k in range(60))) for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for full in ([], [(99, "here " + " ".join(item) + " there")]):
        docs = spark.createDataFrame(half + other + full, "doc_id long, text string")
        found = {r.doc_id: r.score for r in contaminated(docs, bench).collect()}
        assert found == {i: 0.5 for i, _ in half} | {i: 1.0 for i, _ in full}


def test_decontamination_finds_short_items_and_scripts_without_spaces(spark):
    items = [
        (1, "What is the capital of France?"),
        (2, "Who wrote it"),
        (3, "Yes"),
        (4, "法国的首都是哪一座城市?"),
        (5, "フランスの首都はどこですか"),
        (6, "เมืองหลวงของฝรั่งเศสคือเมืองอะไร"),
        (7, "what is THE capital of france"),
        (8, "法国首都"),
    ]
    docs = [
        (1, "Question: what is the capital of France? Paris. What is the capital of France"),
        (2, "what is the capital city of France"),
        (3, "what is the capital of"),
        (4, "Yes who wrote it"),
        (5, "我想知道,法国的首都是哪一座城市。巴黎"),
        (6, "問題:フランスの首都はどこですか?パリ"),
        (7, "คำถาม เมืองหลวงของฝรั่งเศสคือเมืองอะไร ปารีส"),
        (8, "今天天气很好"),
        (9, "France"),
        (10, "Python法国首都abc"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.passage_start, r.passage_end) for r in contaminated(frame, bench).collect()}
    assert set(found) == {(1, 1), (1, 7), (4, 2), (5, 4), (6, 5), (7, 6), (10, 8)}
    assert {score for score, _, _ in found.values()} == {1.0}
    assert found[1, 1] == (1.0, 1, 7) and found[4, 2] == (1.0, 1, 4)
    assert (4, 3) in {(r.doc_id, r.item_id) for r in contaminated(frame, bench, min_exact_words=1).collect()}
    cut = [len(w) for w in item_words(["Python语言3.0、よい", "한국어 문장", "née 😀 x", None, "語"])]
    assert cut == [7, 2, 3, 0, 1]


def test_alignment_against_the_textbook_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 4, int(rng.integers(1, 12))).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                near = table[i, j] + (2 if a[i] == b[j] else -1)
                table[i + 1, j + 1] = max(0, near, table[i, j + 1] - 1, table[i + 1, j] - 1)
        assert align(a, b) == table.max()


def test_classifier_on_held_out_labels_and_odd_documents(spark, medium, tricky, tricky_labels):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    scored = score_quality(spark.read.parquet(f"{medium}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in scored)
    assert right >= 0.95 * len(scored) and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in scored)
    odd = score_quality(tricky, tricky_labels).collect()
    assert len(odd) == tricky.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in score_quality(tricky, tricky_labels.limit(0)).collect()} == {0.5}
    assert keep_good(tricky, tricky_labels).columns == tricky.columns
    assert score_quality(tricky.limit(0), tricky_labels).collect() == []


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("kind", ["even", "skewed", "one", "cycle"])
def test_range_coder_round_trips(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "even": lambda: rng.integers(0, 49_408, n),
        "skewed": lambda: rng.zipf(1.3, n) % 49_408,
        "one": lambda: np.full(n, 7),
        "cycle": lambda: np.arange(n) % 11,
    }[kind]().astype(np.int64)
    packed = range_coder.pack_chunk(ids)
    assert (range_coder.unpack_chunk(packed) == ids).all()
    if n == 9000 and kind in ("one", "cycle"):
        assert len(packed) < n / 4
    if n == 9000 and kind in ("even", "skewed"):
        damaged = bytearray(packed)
        _, table_length, blocks = struct.unpack_from("<QII", packed)
        (last,) = struct.unpack_from("<I", packed, 16 + table_length + 8 * (blocks - 1))
        damaged[len(packed) - last] ^= 255
        with pytest.raises(ValueError, match="checksum"):
            range_coder.unpack_chunk(bytes(damaged))


def test_token_files_against_the_tokenizer(tricky):
    from tokenizers import Tokenizer

    path = catalog.default_tokenizer()
    plain = Tokenizer.from_file(path)
    rows = read_ids(write_ids(tricky, path)).orderBy("start").collect()
    texts = defaultdict(list)
    for r in tricky.collect():
        texts[r.doc_id].append(plain.encode(r.text or "", add_special_tokens=False).ids + [1])
    start = 0
    for r in rows:
        assert r.start == start and r.ids in texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts[r.doc_id].remove(r.ids)
        start += r.n_tokens
    assert not any(texts.values())
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    assert read_ids(write_ids(tricky.limit(0), path)).collect() == []


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, None), (4, "u\r\nx: y", "<p>short"), (8, "u", "<p>short"), (None, "u", big), (9, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(1))
    folder = output_folder(spark, "warc")
    places = warc.write_bundles(warc.mark_revisits(pages), folder=folder, frame_bytes=500)
    got = {r.page_id: r for r in warc.read_bundles(spark, folder, payloads=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 5: ("revisit", 1), 3: ("response", None), 4: ("response", None), 8: ("response", None), None: ("revisit", 1), 9: ("response", None),
    }
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert got[page_id].payload_bytes == len(raw) and got[page_id].payload_digest == hashlib.sha256(raw).hexdigest()
        assert bytes(got[page_id].payload) == (b"" if got[page_id].record_type == "revisit" else raw)
    plain = lambda rows: {(*r[:1], r[1].rsplit("/", 1)[1], *r[2:]) for r in rows}
    assert plain(warc.record_places(spark, folder).collect()) == plain(places.collect())
    one = warc.read_records(spark, folder, spark.createDataFrame([(9,)], "page_id long")).collect()
    assert [bytes(r.payload) for r in one] == [b"x" * 3_000_000]
    bundle = places.first().bundle
    system, path = locate(bundle)
    starts = {(r.frame_start, r.frame_length) for r in places.where(F.col("bundle") == bundle).collect()}
    assert {(s, n) for s, n, _ in warc.seek_table(bundle, system.get_file_info(path).size)} == starts
    empty = output_folder(spark, "warc")
    warc.write_bundles(warc.mark_revisits(pages.limit(0)), folder=empty)
    assert warc.read_bundles(spark, empty).collect() == []


def test_warc_bundles_are_read_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2_000)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    folder = output_folder(spark, "warc")
    warc.write_bundles(warc.mark_revisits(pages), folder=folder, frame_bytes=1_000)
    read = warc.read_bundles(spark, folder)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 5 and read.count() == 400


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu entry</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy things</div>
<article><h1>Title &amp; more {0}</h1><p>First <b>bold</b>
 part {0} with several words in it<br>and more<p>Second &lt;part&gt; &#233; {0} of the long text</article>
<footer>&copy; footer</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, "u", PAGE.format(i)) for i in range(30)] + [(100, None, None), (101, "u", ""), (102, "u", "<p"), (103, "u", "<nav>only a menu</nav>")]
    rows += [(104, "u", PAGE.format("x" * 200_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r for r in html_extraction.extract(pages, train_pages=20).collect()}
    assert out[7].text == "Title & more 7\nFirst bold part 7 with several words in it and more\nSecond <part> é 7 of the long text"
    assert all(out[i].n_chars == len(out[i].text) for i in out)
    assert [out[i].text for i in (100, 101, 102, 103)] == [""] * 4 and out[104].n_chars > 600_000
    assert html_extraction.extract(pages.limit(0)).collect() == []


def test_html_extraction_of_a_site_without_article_elements(spark):
    long = "a long enough sentence of the story of page {0} that goes on for some time and says what happened"
    page = (
        '<html><body class="right-sidebar"><div class="menu"><ul><li><a href="/a">Home of {0}</a></li></ul></div><div class="story">'
        "<h2>Story {0}</h2><p>" + long + "</p><p>" + long + " again</p></div><div class=\"footer\"><p>Imprint</p></div></body></html>"
    )
    pages = spark.createDataFrame([(i, "u", page.format(i)) for i in range(40)], "page_id long, url string, html string")
    for r in html_extraction.extract(pages).collect():
        assert long.format(r.page_id) in r.text and "Imprint" not in r.text and "Home of" not in r.text


def test_html_labels_ignore_words_on_the_whole_page():
    assert html_extraction.structural_label(("html", "body", ".right", ".sidebar", "article", ".has", ".comments", "p")) == 1
    assert html_extraction.structural_label(("html", "body", "article", "div", ".comments", "p")) == 0
    assert html_extraction.structural_label(("html", "body", "article", "footer", "p")) == 0


def test_html_blocks_of_broken_markup():
    texts = [text for _, text, _ in html_extraction.blocks("<p>a<p>b <i>c</i>\n d</p> e < f &amp &am <script>x</script><img alt='>'>g<td>h</p>i<!-- x")]
    assert texts == ["a", "b c d", "e < f & &am g", "h", "i"]


def test_lstm_gradient_is_right():
    net = {k: v.astype(np.float64) for k, v in html_extraction.new_network(1).items()}
    rng = np.random.default_rng(0)
    wide = html_extraction.PATH_SIZE + html_extraction.WORD_SIZE + html_extraction.SIZES
    inputs, mask = rng.normal(0, 1, (4, 2, wide)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    labels = np.array([[1, 0], [0, 1], [1, 1], [0, 0]], float)

    def loss():
        p = html_extraction.probabilities(net, inputs, mask)
        return -((labels * np.log(p) + (1 - labels) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = html_extraction._gradients(net, inputs, mask, labels)
    for name in net:
        at = tuple(0 for _ in net[name].shape)
        old = net[name][at]
        net[name][at] = old + 1e-3
        up = loss()
        net[name][at] = old - 1e-3
        down = loss()
        net[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4), name


def test_word_hashes_match_words():
    texts = ["a b", None, "", "  x\ty ", "b", "A", "é a", "c"]
    seen: dict[str, int] = {}
    for piece in hashing.pieces(pa.array(texts)):
        hashes = piece.word_hashes(lower=True)
        for i, (start, stop) in enumerate(zip(piece.offsets, piece.offsets[1:])):
            own = words((texts[piece.first + i] or "").replace("A", "a"))
            assert stop - start == len(own)
            for word, h in zip(own, hashes[start:stop].tolist()):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pipeline_keeps_its_promises(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "benchmark_decontamination", "source_mixing", "token_files"]
    docs = catalog.table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) <= set(texts)


def test_the_near_duplicate_stage_keeps_the_smallest_id_of_each_group(spark, small):
    docs = catalog.table(spark, small, "documents")
    groups = groups_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    kept = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, first) in groups.items() if i == first)


def test_the_token_stage_writes_what_the_tokenizer_gives(spark, small):
    from tokenizers import Tokenizer

    docs = catalog.table(spark, small, "documents").where("doc_id % 3 = 0")
    plain, start = Tokenizer.from_file(catalog.default_tokenizer()), 0
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["token_files"](spark, docs, small).collect()}
    for row in docs.orderBy("doc_id").collect():
        ids = np.array([*plain.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        found = got.pop(row.doc_id)
        assert (found.start, found.n_tokens, found.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, small, tricky, stage):
    out = stage(spark, tricky, small)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == tricky.columns
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {r.doc_id for r in tricky.select("doc_id").collect()}
    else:
        assert out.count() == tricky.count()
    assert stage(spark, tricky.limit(0), small).collect() == []


def test_known_words_are_bounded_and_those_in_use_stay(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 50)
    encode = token_files.WordEncoder(catalog.default_tokenizer())
    learnt, learn = defaultdict(int), encode._learn

    def counted(words):
        for word in words:
            learnt[word] += 1
        learn(words)

    monkeypatch.setattr(encode, "_learn", counted)
    for start in range(40):
        text = "always " + " ".join(f"w{start}x{i}" for i in range(20))
        (got,) = encode([text])
        whole = [encode.tokenizer.encode(word, add_special_tokens=False).ids for word in text.split()]
        assert np.frombuffer(got, "<u4").tolist() == [i for ids in whole for i in ids]
        assert len(encode.known) + len(encode.older) <= 2 * (50 + 21)
    assert learnt[b"always"] == 1


def test_token_files_get_few_texts_at_once(spark, monkeypatch):
    given, cut = [], token_files.cut_lineage

    def cut_lineage(df):
        given.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return cut(df)

    monkeypatch.setattr(token_files, "cut_lineage", cut_lineage)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    assert read_ids(write_ids(docs, catalog.default_tokenizer())).count() == 40
    assert given == [token_files.TEXTS_AT_ONCE]


def test_frequencies_are_counted_in_parts(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 900, 5_000).astype("<u4")
    whole = range_coder.pack_chunk(ids)
    widest, bincount = [], np.bincount

    def counted(values, **options):
        widest.append(len(values))
        return bincount(values, **options)

    monkeypatch.setattr(range_coder, "_COUNTED", 700, raising=False)
    monkeypatch.setattr(np, "bincount", counted)
    assert range_coder.pack_chunk(ids) == whole and max(widest) == 700
    assert (range_coder.unpack_chunk(whole) == ids).all()
