"""Manifest, published tables and the log-structured store, crashes included."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake import schemas
from auditlake.operators import history
from auditlake.sinks.store import LogStore, Manifest, Published
from auditlake.streaming import watch

VERSIONS = "project string, root string, path string, version bigint, op string, content string"
NUMBERS = T.StructType([T.StructField(c, T.IntegerType()) for c in "kv"])


def highest(base, delta):
    return base.unionByName(delta.drop("_delta")).groupBy("k").agg(F.max("v").alias("v"))


def crash(*_):
    raise OSError("writer lost")


def test_manifest_keeps_the_first_of_two_commits(spark, tmp_path):
    one, two = Manifest(spark, str(tmp_path)), Manifest(spark, str(tmp_path))
    assert one.read() == (0, {})
    one.commit(0, {"a": 1})
    with pytest.raises(FileExistsError):
        two.commit(0, {"a": 2})
    assert two.read() == (1, {"a": 1})
    assert [p.name for p in (tmp_path / "manifest").iterdir() if not p.name.endswith(".crc")] == [f"{1:020d}.json"]


def test_published_table_is_never_missing(spark, tmp_path, monkeypatch):
    table = Published(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        table.read()
    for i in range(4):
        table.publish(spark.range(i + 1), i)
    table.publish(spark.range(99), 3)  # a batch again
    assert table.read().count() == 4
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", crash)
        with pytest.raises(OSError):
            table.publish(spark.range(50), 4)
    assert Published(spark, str(tmp_path)).read().count() == 4
    table.publish(spark.range(6), 4)
    assert table.read().count() == 6
    assert len(table.manifest.versions()) == 2


def test_store_equals_recomputation(spark, tmp_path):
    rng = random.Random(1)
    store = LogStore(spark, str(tmp_path), NUMBERS, ["k"], highest, buckets=8)
    assert store.read().collect() == []
    store.compact()
    want: dict[int, int] = {}
    for i in range(6):
        rows = [(rng.randrange(30), rng.randrange(100)) for _ in range(12)]
        store.append(spark.createDataFrame(rows, NUMBERS), i)
        store.append(spark.createDataFrame([(0, 1000)], NUMBERS), i)  # delivered again
        for k, v in rows:
            want[k] = max(v, want.get(k, -1))
        assert {r.k: r.v for r in store.read().collect()} == want
        if i % 2:
            store.compact()
            assert store.pending() == 0
            assert {r.k: r.v for r in LogStore(spark, str(tmp_path), NUMBERS, ["k"], highest, 8).read().collect()} == want
    store.append(spark.createDataFrame([], NUMBERS), 6)
    assert store.pending() == 0
    store.vacuum()
    assert {r.k: r.v for r in store.read().collect()} == want
    assert not [p for p in (tmp_path / "data").iterdir() if p.name.startswith("delta")]


def test_compaction_rewrites_touched_buckets_alone(spark, tmp_path):
    store = LogStore(spark, str(tmp_path), NUMBERS, ["k"], highest, buckets=16)
    store.append(spark.range(200).selectExpr("cast(id AS int) AS k", "0 AS v"))
    store.compact()
    first = store.manifest.read()[1]["base"]
    store.append(spark.createDataFrame([(7, 5)], NUMBERS))
    store.compact()
    second = store.manifest.read()[1]["base"]
    assert len(first) == 16 and sum(first[b] != second[b] for b in first) == 1
    store.vacuum()
    assert store.read().agg(F.sum("v"), F.count("*")).first()[:] == (5, 200)


def test_crash_between_data_and_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path), NUMBERS, ["k"], highest, buckets=4)
    store.append(spark.createDataFrame([(1, 1), (2, 2)], NUMBERS), 0)
    for step in (lambda: store.append(spark.createDataFrame([(1, 9)], NUMBERS), 1), store.compact):
        with monkeypatch.context() as m:
            m.setattr(Manifest, "commit", crash)
            with pytest.raises(OSError):
                step()
        assert sorted(map(tuple, store.read().collect())) == [(1, 1), (2, 2)]
    store.append(spark.createDataFrame([(1, 9)], NUMBERS), 1)
    store.compact()
    store.vacuum()
    assert sorted(map(tuple, store.read().collect())) == [(1, 9), (2, 2)]
    data = [p for p in (tmp_path / "data").iterdir()]
    assert len(data) == 1  # what the lost writers left is gone


def rows_of_versions():
    return [("p", "", "a.py", 1, "write", "eval(1)"), ("p", "", "b.py", 2, "write", "eval(2)"),
            ("p", "", "a.py", 3, "write", "x = 1"), ("p", "", "b.py", 4, "write", "\neval(3)"),
            ("p", "", "c.py", 5, "write", "eval(4)"), ("p", "", "c.py", 6, "remove", ""),
            ("p", "", "c.py", 5, "write", "eval(4)"), ("q", "", "a.py", 7, "write", "eval(5)\neval(6)"),
            ("p", "", "package.json", 8, "write", "{}"), ("p", "", "old.py", 9, "remove", "")]


@pytest.mark.parametrize("order", [None, 3, 4])
def test_current_view_equals_recomputation(spark, tmp_path, make_files, make_findings, order):
    """Over several batches, late ones included, before and after compaction."""
    rows = rows_of_versions()
    if order is not None:
        random.Random(order).shuffle(rows)
    roots = make_files({".gitignore": ""})
    base = make_findings([("OLD", "LOW", "a.py", 1), ("LINT", "LOW", "z.py", 1), ("GONE", "LOW", "old.py", 1)])
    view = watch.CurrentFindings(spark, str(tmp_path / "view"), buckets=4)
    view.start(base)
    key = ["project", "rule_id", "file", "line"]
    for i in range(0, len(rows), 3):
        view.change(spark.createDataFrame(rows[i : i + 3], VERSIONS), roots, i)
        view.change(spark.createDataFrame(rows[i : i + 3], VERSIONS), roots, i)
        if i == 3:
            view.store.compact()
        seen = spark.createDataFrame(list(dict.fromkeys(rows[: i + 3])), VERSIONS)
        want = watch.current_findings(watch.watched_versions(seen), watch.rescan(seen, roots), base)
        assert sorted(map(tuple, view.read().select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    before = sorted(map(tuple, view.read().collect()), key=repr)
    view.store.compact()
    view.store.vacuum()
    assert sorted(map(tuple, view.read().collect()), key=repr) == before


def test_stream_of_changes_and_totals(spark, tmp_path, make_files):
    source = str(tmp_path / "in")
    rows = rows_of_versions()
    for part in (rows[:4], rows[4:7], rows[7:]):
        spark.createDataFrame(part, VERSIONS).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).parquet(source)

    view = watch.CurrentFindings(spark, str(tmp_path / "view"), buckets=4)
    view.follow(stream(), make_files({".gitignore": ""}), str(tmp_path / "cp"), compact_every=2,
                available_now=True).awaitTermination()
    assert sorted((r.project, r.file, r.line) for r in view.read().collect()) == [
        ("p", "b.py", 2), ("q", "a.py", 1), ("q", "a.py", 2)]
    assert view.store.pending() == 1
    watch.start_published_total(stream(), str(tmp_path / "sum"), str(tmp_path / "cp2"), True).awaitTermination()
    totals = Published(spark, str(tmp_path / "sum")).read().collect()
    assert {r.project: r.scanned_files for r in totals} == {"p": 6, "q": 1}


def test_events_that_come_twice_count_once(spark, tmp_path, make_files):
    source = str(tmp_path / "in")
    schema = VERSIONS + ", ts timestamp"
    rows = [(*r, "2024-01-01 00:00:%02d" % i) for i, r in enumerate(rows_of_versions()[:5])]
    for part in (rows[:3], rows[:4], rows, rows[2:]):
        df = spark.createDataFrame(part, VERSIONS + ", ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    watch.start_rescan(watch.delivered_once(stream, "ts"), make_files({".gitignore": ""}), out,
                       str(tmp_path / "cp"), available_now=True).awaitTermination()
    log = spark.read.parquet(f"{out}/changes")
    assert sorted((r.path, r.version) for r in log.collect()) == sorted((r[2], r[3]) for r in rows)
    assert spark.read.parquet(f"{out}/findings").count() == 4


def test_history_is_trimmed_on_disk(spark, tmp_path):
    kept = history.history_store(spark, str(tmp_path), buckets=2)

    def runs(low, high, score=5.0):
        return spark.range(low, high).selectExpr(
            "'p' AS project", "id AS run_seq", "cast(null AS timestamp_ntz) AS ts", "1L AS scanned_files",
            "0L AS total_findings", "0L AS critical", "0L AS high", "0L AS medium", "0L AS low",
            f"cast({score} AS double) AS health_score", "map('security', 0L) AS domains", "true AS passed")

    for low in range(0, 200, 50):
        kept.append(runs(low, low + 50))
    assert kept.read().count() == 90
    kept.append(runs(199, 200, 7.5))  # the same run again replaces itself
    kept.compact()
    kept.vacuum()
    assert spark.read.parquet(str(tmp_path / "data" / "*")).count() == 90
    rows = {r.run_seq: r.health_score for r in kept.read().collect()}
    assert sorted(rows) == list(range(110, 200)) and rows[199] == 7.5 and rows[198] == 5.0
    assert kept.schema == T.StructType.fromDDL(schemas.SNAPSHOTS) and Path(tmp_path / "manifest").is_dir()
