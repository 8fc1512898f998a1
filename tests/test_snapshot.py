"""Versions of a snapshot folder: whole or not there, whoever writes and whenever a writer dies."""

import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import checkpoint_folder
from bizmetrics.plans import report as r
from bizmetrics.sources.schemas import TABLES
from bizmetrics.sources.snapshot import Snapshots, fingerprint, input_files, load_or_build, read_report


def writer(spark, value):
    return lambda content: spark.range(value).write.parquet(f"{content}/t")


def rows(spark, version):
    return spark.read.parquet(f"{version.path}/t").count()


def tables_left(spark):
    folder = checkpoint_folder(spark).removeprefix("file:")
    return sorted(p.name for p in Path(folder).glob("table-*"))


def one_row(spark, value):
    return spark.range(1).select(F.struct(F.lit(value).alias("v"), F.lit("2024-02-01").cast("date").alias("d")).alias("sales"))


def test_readers_see_whole_versions_only(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "s"))
    assert snapshots.latest() is None and list(snapshots.versions()) == []
    first = snapshots.commit(writer(spark, 3), "a")
    assert (first.number, rows(spark, snapshots.latest())) == (1, 3)

    def dies(content):
        spark.range(7).write.parquet(f"{content}/t")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        snapshots.commit(dies, "a")
    assert snapshots.latest() == first
    second = Snapshots(spark, str(tmp_path / "s")).commit(lambda c: writer(spark, 5)(c) or {"lines": 5}, "b")
    assert second.number == 2 and snapshots.latest() == second and snapshots.latest().notes == {"lines": 5}
    assert snapshots.latest("a") == first and snapshots.latest("c") is None


def test_a_version_that_lost_files_is_passed_over(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "s"))
    first, second = (snapshots.commit(writer(spark, n)) for n in (3, 5))
    part = next(p for p in (tmp_path / "s" / "versions" / second.name / "content" / "t").glob("part-*"))
    part.unlink()
    assert snapshots.latest() == first
    (tmp_path / "s" / "versions" / first.name / "whole.json").unlink()
    assert snapshots.latest() is None
    assert snapshots.commit(writer(spark, 8)).number == 3


def test_two_writers_get_two_numbers(spark, tmp_path):
    path, ready, made = str(tmp_path / "s"), threading.Barrier(4), []

    def write(n):
        def content(folder):
            spark.range(n).write.parquet(f"{folder}/t")
            ready.wait(60)

        made.append(Snapshots(spark, path).commit(content, str(n)))

    threads = [threading.Thread(target=write, args=(n,)) for n in (2, 3, 4, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(v.number for v in made) == [1, 2, 3, 4]
    found = list(Snapshots(spark, path, keep=9).versions())
    assert [v.number for v in found] == sorted((v.number for v in found), reverse=True)
    assert all(rows(spark, v) == int(v.made_from) for v in found) and found[0].number == 4


def test_old_versions_go_but_not_those_still_needed(spark, tmp_path):
    folder = tmp_path / "s"
    snapshots = Snapshots(spark, str(folder), keep=2, grace_hours=0)
    base = snapshots.commit(writer(spark, 1))
    unneeded = snapshots.commit(writer(spark, 2))
    for n in (3, 4, 5):
        time.sleep(0.01)
        last = snapshots.commit(lambda c, n=n: writer(spark, n)(c) or {"needs": [base.name]})
    kept = {p.name for p in (folder / "versions").iterdir()}
    assert base.name in kept and last.name in kept and unneeded.name not in kept and len(kept) == 3
    assert [v.number for v in snapshots.versions()] == [5, 4]
    (folder / "versions" / base.name / "whole.json").unlink()
    assert snapshots.latest() is None
    with pytest.raises(ValueError):
        Snapshots(spark, str(folder), keep=0)


def test_fingerprints_tell_options_and_files_apart(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("a\n1\n")
    paths = {"sales": str(folder)}
    table = spark.createDataFrame([("2024-01-26", "x")], "ds string, name string")
    same = fingerprint(spark, paths, {"k": 3, "holidays": table})
    assert same == fingerprint(spark, paths, {"holidays": table.select("*"), "k": 3})
    others = {fingerprint(spark, paths, {"k": 4, "holidays": table}), fingerprint(spark, paths, {"k": 3, "holidays": table.limit(0)})}
    (folder / "b.csv").write_text("a\n1\n")
    others.add(fingerprint(spark, paths, {"k": 3, "holidays": table}))
    (folder / "b.csv").write_text("a\n1\n2\n")
    others.add(fingerprint(spark, paths, {"k": 3, "holidays": table}))
    assert len(others | {same}) == 5
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in input_files(spark, str(folder)).collect()} == {("a.csv", 4), ("b.csv", 6)}


def test_a_report_is_built_once_per_fingerprint(spark, tmp_path):
    path, built = str(tmp_path / "report"), []

    def build(value):
        def made():
            built.append(value)
            return one_row(spark, value)

        return made

    assert read_report(spark, f"{path}/none") is None
    assert load_or_build(spark, path, build(1), made_from="x").first().sales.v == 1
    assert load_or_build(spark, path, build(2), made_from="x").first().sales.v == 1
    assert load_or_build(spark, path, build(3), made_from="y").first().sales.v == 3
    assert load_or_build(spark, path, build(4), made_from="x").first().sales.v == 1
    assert load_or_build(spark, path, build(5), True, "x").first().sales.v == 5

    def fails():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        load_or_build(spark, path, fails, True, "x")
    saved = load_or_build(spark, path, build(6), made_from="x")
    assert saved.first() == one_row(spark, 5).first() and saved.schema.simpleString() == one_row(spark, 5).schema.simpleString()
    assert built == [1, 3, 5]


def test_a_report_follows_its_files_and_options(spark, tmp_path):
    paths = {}
    for name, schema in TABLES.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(",".join(schema.names) + "\n")
        paths[name] = str(path)
    line = {"date": "2024-01-01", "product_id": "P", "product_name": "N", "customer_id": "C", "customer_name": "N", "region": "R"}

    def add_sale(amount):
        values = line | {"revenue": amount, "margin_pct": "20"}
        with open(paths["sales"], "a") as out:
            out.write(",".join(str(values.get(c, 1)) for c in TABLES["sales"].names) + "\n")

    options = {"forecaster": "growth", "models": False}
    before = tables_left(spark)
    load = lambda **more: r.load_report(spark, paths, str(tmp_path / "saved"), **options | more).first()
    add_sale(10)
    assert load().sales.total_revenue_last_month == 10
    add_sale(5)
    assert load().sales.total_revenue_last_month == 15
    assert load(forecaster="seasonal").sales.forecast_model == "growth"  # one date: nothing seasonal to fit
    assert len(list((tmp_path / "saved" / "log").glob("*.json"))) == 3
    add_sale("lots")
    with pytest.raises(ValueError, match="sales.revenue"):
        load()
    assert load(allow_rejects=True).sales.total_revenue_last_month == 15
    assert tables_left(spark) == before  # what the report was made of is gone
