from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import findings as fd


def test_sort_is_by_severity_file_line(make_findings):
    df = make_findings([("A", "LOW", "a", 1), ("B", "HIGH", "b", 9), ("C", "HIGH", "a", 2),
                        ("D", "CRITICAL", "z", 1), ("E", "ODD", "a", 1)])
    assert [r.rule_id for r in fd.sort_findings(df).collect()] == ["D", "C", "B", "A", "E"]


def test_summary_keeps_clean_projects(spark, make_findings):
    scanned = spark.createDataFrame([("p", 3), ("q", 2)], "project string, scanned_files bigint")
    df = make_findings([("A", "HIGH", "a", 1), ("B", "INFO", "a", 1)])
    rows = {r.project: r for r in fd.severity_summary(df, scanned).collect()}
    assert (rows["p"].high, rows["p"].total, rows["p"].passed) == (1, 2, False)
    assert (rows["q"].total, rows["q"].passed, rows["q"].scanned_files) == (0, True, 2)
    lines = {r.project: r.summary for r in fd.summary_line(
        fd.severity_summary(df, scanned)).collect()}
    assert lines["p"] == "[FAIL] 3 files scanned, 2 findings (0C/1H/0M)"


def test_gate_levels(spark, make_findings):
    projects = spark.createDataFrame([("p",), ("q",)], "project string")
    rows = fd.gate(make_findings([("A", "MEDIUM", "a", 1)]), projects).collect()
    failed = {(r.project, r.level) for r in rows if r.failed}
    assert failed == {("p", "medium"), ("p", "low"), ("p", "any")}


def test_top_findings_counts_the_rest(make_findings):
    df = make_findings([(f"R{i:02d}", "HIGH", f"f{i:02d}", i) for i in range(30)])
    rows = fd.top_findings(df).collect()
    assert len(rows) == 20 and {r.more for r in rows} == {10}
    assert [r.rule_id for r in sorted(rows, key=lambda r: r.position)] == [
        f"R{i:02d}" for i in range(20)]


def test_fix_guidance_takes_first_non_empty(make_findings):
    df = make_findings([("A", "HIGH", "b", 1, "m", "late"), ("A", "HIGH", "a", 1, "m", ""),
                        ("A", "HIGH", "a", 2, "m", "early"), ("B", "LOW", "a", 1, "m", "")])
    assert [(r.rule_id, r.fix) for r in fd.fix_guidance(df).collect()] == [("A", "early")]


def test_domain_summary_with_crash(spark, make_findings):
    executed = spark.createDataFrame(
        [("p", "security", "builtin", "1", 0.5), ("p", "lint", "ruff", "", 1.0),
         ("p", "sca", "trivy", "", 1.0)],
        "project string, domain string, tool string, version string, time double")
    errors = spark.createDataFrame([("p", "sca", "boom")], "project string, domain string, error string")
    df = make_findings([("A", "HIGH", "a", 1), ("S", "LOW", "a", 1, "m", "", "sca", "trivy")])
    rows = {r.domain: (r.findings, r.passed, r.error)
            for r in fd.domain_summary(df, executed, errors).collect()}
    assert rows == {"security": (1, False, ""), "lint": (0, True, ""), "sca": (0, False, "boom")}


def test_explain(make_files, make_findings, spark):
    files = make_files({"a.py": "\n".join(f"l{i}" for i in range(1, 13))})
    df = make_findings([("R", "HIGH", "a.py", 2, "first"), ("R", "HIGH", "a.py", 2, "second")])
    asked = spark.createDataFrame(
        [("p", "R", "a.py", 2), ("p", "R", "a.py", 9)], "project string, rule_id string, path string, line int")
    rows = {r.line: r for r in fd.explain(asked, df, files).collect()}
    assert rows[2].message == "first"
    assert rows[2].context.split("\n")[0] == "   1 | l1"
    assert rows[2].context.split("\n")[-1] == "   7 | l7"
    assert rows[9].error == "Finding R at a.py:9 not found" and rows[9].context is None


def test_strict_findings(spark):
    requested = spark.createDataFrame(
        [("p", "lint"), ("p", "security"), ("p", "magic")], "project string, domain string")
    available = spark.createDataFrame([("p", "security")], "project string, domain string")
    assert [r.rule_id for r in fd.missing_tools(requested, available).collect()] == ["TOOL-MISSING-LINT"]
    assert [r.rule_id for r in fd.unknown_domains(requested).collect()] == ["DOMAIN-UNKNOWN-MAGIC"]


def test_domain_selection(spark):
    rows = spark.createDataFrame(
        [("a", ["lint", "magic"], ["security"]), ("b", [], ["security", "sca"]), ("c", None, None)],
        "project string, configured array<string>, recommended array<string>")
    got = {}
    for r in fd.select_domains(rows).collect():
        got.setdefault(r.project, []).append(r.domain)
    assert got["a"] == ["lint"] and got["b"] == ["security", "sca"] and len(got["c"]) == 7


def test_file_results(make_files, make_findings):
    files = make_files({"a.py": "", "b.py": ""})
    rows = {r.path: (r.findings, r.passed)
            for r in fd.file_results(make_findings([("A", "HIGH", "a.py", 1)]), files).collect()}
    assert rows == {"a.py": (1, False), "b.py": (0, True)}


def test_scanned_total(spark):
    one = spark.createDataFrame([("p", 3), ("q", None)], "project string, scanned_files bigint")
    rows = {r.project: r.scanned_files for r in fd.scanned_total(one, one).collect()}
    assert rows == {"p": 6, "q": 0}


def test_severity_rank(spark):
    df = spark.createDataFrame([("HIGH",), ("odd",)], "s string")
    assert [r[0] for r in df.select(fd.severity_rank(F.col("s"))).collect()] == [1, 99]
