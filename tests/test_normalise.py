from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.operators import normalise as nm
from auditlake.sources import reports as rp


@pytest.fixture()
def make_reports(spark):
    def make(*rows):
        """(tool, payload[, target, stderr, returncode, project])"""
        out = []
        for tool, payload, *rest in rows:
            target, err, code, project = [*rest, *["", "", 0, "p"][len(rest):]]
            text = payload if isinstance(payload, str) or payload is None else json.dumps(payload)
            out.append((project, "/w/p", tool, target, text, err, code))
        return spark.createDataFrame(out, schemas.REPORTS)

    return make


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize("tool", list(nm.NORMALISERS))
@pytest.mark.parametrize("payload", ["not json", "", "null", "{}", "[]", "[null]", "[1, \"x\"]", None])
def test_bad_payloads_give_nothing_and_never_fail(make_reports, tool, payload):
    df = nm.NORMALISERS[tool](make_reports((tool, payload)))
    # an empty item is a finding with defaults; anything else is nothing
    assert all(r.message == "" for r in df.collect())


def test_ruff(make_reports):
    df = nm.NORMALISERS["ruff"](make_reports(("ruff", [
        {"code": "E501", "filename": "a.py", "location": {"row": 3}, "message": "long", "fix": None},
        {"code": None, "message": "syntax"},
        {"code": "F401", "filename": "b.py", "location": {"row": 1}, "message": "m", "fix": {"message": "Rm"}},
    ])))
    rows = [(r.rule_id, r.severity, r.file, r.line, r.snippet, r.fix)
            for r in df.orderBy("match_start").collect()]
    assert rows == [("LINT-RUFF-E501", "MEDIUM", "a.py", 3, "E501", ""),
                    ("LINT-RUFF-UNKNOWN", "LOW", "", 0, "", ""),
                    ("LINT-RUFF-F401", "LOW", "b.py", 1, "F401", "Rm")]


def test_eslint_paths_and_rule_ids(make_reports):
    msgs = [{"ruleId": "no-x", "severity": 2, "line": 4, "message": "m", "source": "s" * 99},
            {"ruleId": None, "severity": 1, "message": "parse"}, {"message": "none"}]
    df = nm.NORMALISERS["eslint"](make_reports(("eslint", [
        {"filePath": "/w/p/src/a.js", "messages": msgs}, {"filePath": "/w/pq/b.js", "messages": msgs[:1]}])))
    rows = [(r.rule_id, r.severity, r.file, len(r.snippet)) for r in df.orderBy("match_start").collect()]
    assert rows == [("LINT-ESLINT-no-x", "HIGH", "src/a.js", 80), ("LINT-ESLINT-None", "MEDIUM", "src/a.js", 0),
                    ("LINT-ESLINT-unknown", "MEDIUM", "src/a.js", 0), ("LINT-ESLINT-no-x", "HIGH", "/w/pq/b.js", 80)]


def test_clippy_lines(make_reports):
    lines = "\n".join(json.dumps(x) for x in [
        {"reason": "compiler-message", "message": {"level": "error", "code": {"code": "c"}, "message": "m",
         "spans": [{"file_name": "a.rs", "line_start": 7, "text": [{"text": "t" * 90}]}]}},
        {"reason": "compiler-message", "message": {"level": "warning", "code": None, "message": "w", "spans": []}},
        {"reason": "compiler-message", "message": {"level": "note", "message": "n"}},
        {"reason": "build-finished"},
    ]) + "\nbroken {compiler-message"
    rows = [(r.rule_id, r.severity, r.file, r.line, len(r.snippet))
            for r in nm.NORMALISERS["clippy"](make_reports(("clippy", lines))).orderBy("match_start").collect()]
    assert rows == [("LINT-CLIPPY-c", "HIGH", "a.rs", 7, 80), ("LINT-CLIPPY-unknown", "MEDIUM", "", 0, 0)]


def test_text_reports(make_reports):
    df = make_reports(
        ("mypy", "a.py:3:1: error: bad: type\r\nb.py:4:2: note: see\nFound 1 error"),
        ("tsc", "x.ts(5,9): error TS2345: no\ny.ts(1,1): warning TS1: w"))
    rows = sorted((r.rule_id, r.severity, r.file, r.line, r.message) for r in nm.normalise(df).collect())
    assert rows == [("TYPE-MYPY-error", "HIGH", "a.py", 3, "bad: type"), ("TYPE-MYPY-note", "MEDIUM", "b.py", 4, "see"),
                    ("TYPE-TSC-TS1", "MEDIUM", "y.ts", 1, "w"), ("TYPE-TSC-TS2345", "HIGH", "x.ts", 5, "no")]


def test_pyright_and_biome_and_go(make_reports):
    df = make_reports(
        ("pyright", {"generalDiagnostics": [{"severity": "error", "file": "a.py", "message": "m",
                                             "range": {"start": {"line": 0}}}]}),
        ("biome", {"diagnostics": [{"category": "c", "file": {"path": "a.js"}, "location": {"span": [55, 60]},
                                    "description": "d"}, {"location": None}]}),
        ("golangci-lint", {"Issues": [{"FromLinter": "vet", "Pos": {"Filename": "a.go", "Line": 2},
                                       "Text": "t", "SourceLines": ["s"]}]}))
    rows = {(r.tool, r.rule_id, r.line) for r in nm.normalise(df).collect()}
    assert rows == {("pyright", "TYPE-PYRIGHT-unknown", 0), ("biome", "LINT-BIOME-c", 55),
                    ("biome", "LINT-BIOME-unknown", 0), ("golangci-lint", "LINT-GO-vet", 2)}


@pytest.mark.parametrize("severity, impact, expected", [
    ("ERROR", "", "HIGH"), ("WARNING", "", "MEDIUM"), ("INFO", "", "LOW"), ("ODD", "", "MEDIUM"),
    (None, None, "MEDIUM"), ("INFO", "HIGH", "HIGH"), ("ERROR", "LOW", "LOW")])
def test_sast_severity(make_reports, severity, impact, expected):
    item = {"check_id": "c", "path": "a", "start": {"line": 1},
            "extra": {"severity": severity, "metadata": {"impact": impact, "references": ["u", "v"]}}}
    row = one(nm.NORMALISERS["semgrep"](make_reports(("opengrep", {"results": [item]}))))
    assert (row.severity, row.tool, row.url, row.message) == (expected, "opengrep", "u", "c")


def test_sca(make_reports):
    vulns = [{"VulnerabilityID": "CVE-1", "Severity": "UNKNOWN", "PkgName": "x", "InstalledVersion": "1",
              "FixedVersion": "2", "Title": "t"},
             {"Severity": "CRITICAL", "Description": "d" * 200}]
    rows = nm.NORMALISERS["trivy"](make_reports(("trivy", {"Results": [{"Target": "lock"}, {"Target": "lock", "Vulnerabilities": vulns}]})))
    a, b = rows.orderBy("match_start").collect()
    assert (a.severity, a.message, a.fix) == ("LOW", "x@1: t", "Update x from 1 to 2")
    assert (b.rule_id, b.severity, b.fix) == ("SCA-UNKNOWN", "CRITICAL", "")
    assert b.message == "@: " + "d" * 120


def test_iac_single_and_list(make_reports):
    block = {"results": {"failed_checks": [{"check_id": "C", "severity": None, "file_line_range": [4, 9],
                                            "guideline": "g"}]}}
    for payload in (block, [block]):
        row = one(nm.NORMALISERS["checkov"](make_reports(("checkov", payload))))
        assert (row.rule_id, row.severity, row.line, row.fix, row.url) == ("IAC-C", "MEDIUM", 4, "g", "g")


def test_container_severity_defaults(make_reports):
    items = [{"ID": "A"}, {"ID": "B", "Severity": "UNKNOWN"}, {"ID": "C", "Severity": "ODD"}]
    df = nm.NORMALISERS["trivy-config"](make_reports(("trivy-config", {"Results": [{"Misconfigurations": items}]}, "d/Dockerfile")))
    assert [(r.severity, r.file, r.tool) for r in df.orderBy("match_start").collect()] == [
        ("MEDIUM", "d/Dockerfile", "trivy"), ("LOW", "d/Dockerfile", "trivy"), ("MEDIUM", "d/Dockerfile", "trivy")]


def test_errors_and_status(make_reports):
    df = make_reports(
        ("trivy", "{}", "", "e" * 300, 1), ("trivy", "{}", "", "fine", 0), ("checkov", "{}", "", "x", 1),
        ("checkov", "{}", "", "x", 2), ("semgrep", {"errors": [{"message": "oops"}, {"code": 3}]}),
        ("biome", "not json"), ("mypy", "not json"), ("opengrep", ""))
    errors = sorted((r.error, r.domain, r.failed) for r in nm.report_errors(df).collect())
    assert errors == [('SAST: oops', "sast", False), ('SAST: {"code":3}', "sast", False), ("checkov: x", "iac", False),
                      ("trivy: " + "e" * 200, "sca", False), ("unparseable report of biome", "lint", True)]
    status = rp.parse_status(make_reports(("ruff", ""), ("ruff", "{"), ("ruff", "[]"), ("mypy", "x")))
    assert [r.status for r in status.collect()] == ["empty", "unparseable", "ok", "ok"]


def test_tool_preference_and_labels(make_reports, spark):
    df = make_reports(("eslint", "[]"), ("biome", "{}"), ("pyright", "{}"), ("semgrep", "{}"),
                      ("opengrep", "{}"), ("ruff", "[]"))
    kept = rp.preferred_tools(df)
    assert sorted(r.tool for r in kept.collect()) == ["eslint", "opengrep", "pyright", "ruff"]
    asked = spark.createDataFrame([("p", d) for d in ("lint", "typecheck", "sca")], "project string, domain string")
    labels = {r.domain: r.tool for r in nm.tools_used(kept, asked).collect()}
    assert labels == {"lint": "ruff, eslint", "typecheck": "pyright", "sca": "none"}


def test_overrides_and_changed_files(make_findings, spark):
    df = make_findings([
        ("LINT-RUFF-E1", "LOW", "a.py", 1, "m", "", "lint", "ruff"),
        ("LINT-RUFF-W1", "LOW", "b.py", 1, "m", "", "lint", "ruff"),
        ("IAC-C1", "LOW", "x.tf", 1, "m", "", "iac", "checkov"),
        ("LINT-ESLINT-a", "LOW", "a.py", 1, "m", "", "lint", "eslint")])
    kept = nm.apply_overrides(df, ["E"], ["C1"])
    assert sorted(r.rule_id for r in kept.collect()) == ["LINT-ESLINT-a", "LINT-RUFF-E1"]
    changed = spark.createDataFrame([("p", "a.py")], "project string, path string")
    none = spark.createDataFrame([], schemas.REPORTS)
    assert sorted(r.rule_id for r in nm.only_changed(df, changed, none).collect()) == ["IAC-C1", "LINT-RUFF-E1"]


@pytest.mark.parametrize("empty_scope", ["full", "none"])
def test_changed_files_of_absolute_and_unscoped_reports(make_findings, spark, empty_scope):
    """Absolute names count as changed; a project that fell back to a full scan keeps everything."""
    scoped = make_findings([
        ("R1", "LOW", "/work/p/src/a.py", 1, "m", "", "lint", "ruff"),
        ("R2", "LOW", "/work/p/src/b.py", 1, "m", "", "lint", "ruff"),
        ("R3", "LOW", "src/a.py", 1, "m", "", "typecheck", "mypy"),
        ("R4", "LOW", "/work/p/src/a.py", 1, "m", "", "typecheck", "pyright"),
        ("R5", "LOW", "web/x.js", 1, "m", "", "lint", "eslint"),
        ("R6", "LOW", "web/y.js", 1, "m", "", "lint", "biome"),
        ("R7", "LOW", "any", 1, "m", "", "sca", "trivy")])
    free = make_findings([
        ("Q1", "LOW", "src/b.pyi", 1, "m", "", "lint", "ruff"),
        ("Q2", "LOW", "web/App.vue", 1, "m", "", "lint", "eslint"),
        ("Q3", "LOW", "any", 1, "m", "", "sca", "trivy")], "q")
    paths = spark.createDataFrame(
        [("p", "src/a.py"), ("p", "web/x.js"), ("p", "gone.py")], "project string, path string")
    reports = spark.createDataFrame(
        [("p", "/work/p/", "ruff", "", "[]", "", 0), ("q", "/work/q", "ruff", "", "[]", "", 0)], schemas.REPORTS)
    kept = nm.only_changed(scoped.unionByName(free), paths, reports, empty_scope).collect()
    mine = {"R1", "R3", "R4", "R5", "R7", "Q3"}
    assert {r.rule_id for r in kept} == (mine | {"Q1", "Q2"} if empty_scope == "full" else mine)
    assert len(kept) == len({r.rule_id for r in kept})


def test_rulesets_choose_reports_of_analysers(make_reports):
    reports = make_reports(("semgrep", "{}"), ("opengrep", "{}"), ("ruff", "[]"))
    assert rp.of_rulesets(reports, ["p/ci"]).count() == 3  # no column says what was run
    tagged = reports.withColumn("ruleset", F.when(F.col("tool") == "semgrep", "p/ci"))
    kept = lambda names: sorted(r.tool for r in rp.of_rulesets(tagged, names).collect())
    assert kept([]) == ["opengrep", "ruff", "semgrep"]
    assert kept(["p/ci"]) == ["ruff", "semgrep"] and kept(["auto"]) == ["opengrep", "ruff"]
