"""Reports are made and parsed by many tasks, whatever the files they come from."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from auditlake.operators import findings as fd
from auditlake.operators import normalise
from auditlake.sinks import reports as sink
from checks import corpus

PART = "p_partkey int, p_name string, p_brand string, p_type string, p_size int"


def _part_folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def _spread(reports):
    """Reports held by each task that holds any."""
    held = reports.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    return [r.n for r in held.collect()]


def test_one_file_of_parts_feeds_many_tasks(spark, tmp_path):
    folder = _part_folder(spark, tmp_path, [(i, f"n{i}", "B", "T", i % 50) for i in range(1, 2001)])
    held = _spread(corpus.reports(spark, folder))
    assert sum(held) == 2000 * len(corpus.REPORTS)
    assert len(held) >= 16 and max(held) <= sum(held) / 8
    assert normalise.normalise(corpus.reports(spark, folder)).rdd.getNumPartitions() >= 16


def test_equal_and_null_keys_spread_too_and_stay(spark, tmp_path):
    rows = [(7, "a", "B", "T", 3)] * 1000 + [(None, "b", "B", "T", 4)] * 1000
    folder = _part_folder(spark, tmp_path, rows)
    reports = corpus.reports(spark, folder, "ruff")
    held = _spread(reports)
    assert sum(held) == 2000 and len(held) >= 16 and max(held) <= 250
    assert reports.where("project IS NULL").count() == 1000


def test_a_compact_report_counts_its_summary_once(spark, make_findings):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def once(n):
        counted.add(1)
        return n

    findings = make_findings([("A", "HIGH", "a.py", 1), ("B", "LOW", "b.py", 2)])
    scanned = spark.createDataFrame([("p", 5)], "project string, scanned_files bigint")
    summary = fd.severity_summary(findings, scanned)
    rows = sink.compact_report(findings, summary.withColumn("total", once("total"))).orderBy("section", "number").collect()
    said = json.loads("".join(r.text for r in rows))
    assert said["scanned"] == 5 and [f["rule"] for f in said["findings"]] == ["A", "B"]
    assert counted.value == 1


def test_a_filter_on_the_tool_spares_the_payloads_of_others(spark, tmp_path):
    folder = _part_folder(spark, tmp_path, [(i, "n", "B", "T", 3) for i in range(2, 42)])
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(payload):
        read.add(1)
        return payload

    reports = corpus.reports(spark, folder).withColumn("payload", counted("payload"))
    found = normalise.normalise(reports)
    ruled = found.where(F.col("tool").isin("ruff", "mypy")).select("tool", "sev_rank", "rule_id").collect()
    assert {(r.tool, r.sev_rank, r.rule_id) for r in ruled} == {("ruff", 3, "LINT-RUFF-F3"), ("mypy", 2, "TYPE-MYPY-note")}
    assert len(ruled) == 80
    assert read.value == 80
    # one name for both kinds of trivy reports
    assert found.where("tool = 'trivy'").count() == 80


def test_only_findings_of_file_scoped_tools_are_shuffled(spark, make_findings):
    findings = make_findings([
        ("R1", "LOW", "a.py", 1, "m", "", "lint", "ruff"), ("R2", "LOW", "b.py", 1, "m", "", "lint", "ruff"),
        ("R3", "LOW", "b.py", 1, "m", "", "sca", "trivy"), ("R1", "LOW", "a.py", 1, "m", "", "lint", "ruff")])
    changed = spark.createDataFrame([("p", "a.py")] * 2, "project string, path string")
    reports = spark.createDataFrame([("p", "/work/p")], "project string, root string")
    kept = normalise.only_changed(findings, changed, reports)
    assert sorted(r.rule_id for r in kept.collect()) == ["R1", "R1", "R3"]
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    assert "Join" not in plan.children().head().toString()
    # changes are as many as findings: they are not repeated for salts
    assert "Join LeftOuter, ((project" in plan.toString()
    assert all("_salt" not in line for line in plan.toString().splitlines() if "file#" in line and "Join" in line)
