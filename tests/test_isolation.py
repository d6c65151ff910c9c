"""A failing domain leaves all others as they are."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.plans.isolate import run_isolated
from auditlake.plans.options import ScanOptions
from auditlake.plans.registry import Domain, Registry
from auditlake.plans.scan import scan_projects


def notes(files, options):
    """Every file is a finding."""
    fixed = {"rule_id": "N", "severity": "LOW", "message": "m", "snippet": "", "fix": "", "domain": "notes",
             "tool": "notes", "category": "", "url": ""}
    numbers = {"sev_rank": "int", "line": "int", "rule_seq": "int", "sub_seq": "int", "match_start": "bigint"}
    return files.select("project", F.col("path").alias("file"), *[F.lit(v).alias(k) for k, v in fixed.items()],
                        *[F.lit(3).cast(t).alias(k) for k, t in numbers.items()])


def at_build(files, options):
    raise RuntimeError("cannot be built")


def in_a_task(files, options):
    return notes(files, options).withColumn("message", F.when(F.col("line") == 3, F.raise_error("broken row")))


def in_python(files, options):
    @F.udf("string")
    def fail(x):
        raise KeyError("lost key")

    return notes(files, options).withColumn("message", fail("file"))


def probe():
    raise OSError("not reachable")


@pytest.fixture()
def files(make_files):
    return make_files({"a.py": "eval(x)", "b.py": "x"}).unionByName(make_files({"c.py": "eval(y)"}, "q"))


def registry_with(*domains):
    registry = Registry()
    for domain in domains:
        registry.register(domain)
    return registry


@pytest.mark.parametrize("measured", [False, True])
def test_failing_domains_leave_the_others(files, measured):
    registry = registry_with(
        Domain("notes", scan=notes), Domain("build", scan=at_build), Domain("task", scan=in_a_task),
        Domain("python", scan=in_python), Domain("probe", scan=notes, available=probe),
        Domain("absent", scan=notes, available=lambda: False))
    names = ("security", "notes", "build", "task", "python", "probe", "absent")
    out = scan_projects(files, ScanOptions(domains=names, measured=measured), registry=registry)
    assert sorted((r.project, r.domain, r.file) for r in out.findings.collect()) == [
        ("p", "notes", "a.py"), ("p", "notes", "b.py"), ("p", "security", "a.py"),
        ("q", "notes", "c.py"), ("q", "security", "c.py")]
    rows = {r.domain: r for r in out.domain_results.where("project = 'p'").collect()}
    assert set(rows) == set(names) - {"absent"}
    for name, said in (("build", "cannot be built"), ("task", "broken row"), ("python", "lost key"),
                       ("probe", "not reachable")):
        row = rows[name]
        assert row.error.startswith(f"Domain '{name}' crashed: ") and said in row.error and "\n" not in row.error
        assert (row.tool, row.version, row.time, row.findings, row.passed) == (name, "", 0.0, 0, False)
    assert rows["notes"].time > 0 and rows["notes"].findings == 2 and rows["notes"].passed
    assert (rows["security"].time > 0) == measured
    errors = out.errors.collect()
    assert len(errors) == 8 and all(r.failed for r in errors)


def test_a_failing_report_job_fails_its_domains_alone(files, spark):
    reports = spark.createDataFrame([("p", "", "ruff", "", "[]", "", 0)], schemas.REPORTS)
    broken = reports.withColumn("payload", F.when(F.col("returncode") == 0, F.raise_error("payload store is gone")))
    out = scan_projects(files, ScanOptions(domains=("security", "lint"), measured=True), reports=broken)
    assert {r.domain for r in out.findings.collect()} == {"security"}
    assert {r.domain for r in run_isolated(spark, {"x": lambda: out.findings})[0].found.collect()} == {"security"}


def test_runs_are_concurrent_timed_and_counted(spark, make_findings):
    meet = threading.Barrier(4, timeout=60)

    def build():
        meet.wait()  # passes only if four domains are built at once
        time.sleep(0.1)
        return make_findings([("A", "HIGH", "f", 1), ("B", "LOW", "f", 2)])

    def fails():
        raise ValueError("x\nsecond line")

    runs = run_isolated(spark, {**{f"d{i}": build for i in range(4)}, "bad": fails})
    assert [r.name for r in runs] == ["d0", "d1", "d2", "d3", "bad"]
    for run in runs[:4]:
        assert run.error is None and run.seconds > 0.1 and (run.findings, run.bad) == (2, 1)
        assert run.found.count() == run.findings
    assert runs[4].error == "x" and runs[4].found is None and runs[4].seconds == 0
    assert run_isolated(spark, {}) == []


def test_no_domain_at_all(files):
    out = scan_projects(files, ScanOptions(domains=("build",)), registry=Registry({"build": Domain("build", scan=at_build)}))
    assert out.findings.collect() == []
    assert {r.error for r in out.domain_results.collect()} == {"Domain 'build' crashed: cannot be built"}
