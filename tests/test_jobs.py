"""Sources, scopes, whole scans, streams and sinks."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.operators import findings as fd
from auditlake.operators import rules
from auditlake.operators.selection import scanned_counts
from auditlake.plans.options import ScanOptions
from auditlake.plans.registry import Domain, Registry, run_domain
from auditlake.plans.scan import scan_projects
from auditlake.sinks import reports as sink
from auditlake.sources import changes as ch
from auditlake.sources import files as fl
from auditlake.operators import normalise
from auditlake.sources import reports as rp
from auditlake.streaming import watch

KEY = "sk-" + "ab12" * 12


# --------------------------------------------------------------------- sources
def test_read_tree_and_lanes(spark, tmp_path):
    for path, data in {"web/src/a.js": b"eval(x)\xff\n", "web/.gitignore": b".env\n", "web/cfg/.env": b"A=1",
                       "api/docs/readme.md": b"x", "api/node_modules/q.js": b"eval(1)",
                       "web/pkg/__init__.py": b"exec(y)"}.items():
        target = tmp_path / "tree" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    files = fl.read_tree(spark, str(tmp_path / "tree"))
    rows = {(r.project, r.path): r.content for r in files.collect()}
    assert rows["web", "src/a.js"] == "eval(x)\ufffd\n" and rows["api", "docs/readme.md"] is None
    with pytest.raises(Exception, match="missing"):
        fl.read_tree(spark, str(tmp_path / "missing"))
    fl.write_files(files, str(tmp_path / "table"))
    table = fl.read_files(spark, str(tmp_path / "table"))
    lanes = {r.path: r.lane for r in table.collect()}
    assert lanes == {"src/a.js": "source", ".gitignore": "root", "cfg/.env": "source",
                     "docs/readme.md": "other", "node_modules/q.js": "skipped", "pkg/__init__.py": "source"}
    assert sorted((r.rule_id, r.file) for r in rules.scan(table).collect()) == [
        ("SEC-003", "pkg/__init__.py"), ("SEC-003", "src/a.js")]
    assert rules.scan(table, skipped_dirs=[]).count() == 2  # q.js is listed without its text,
    unread = rules.unread_files(table, skipped_dirs=[]).collect()  # which is said
    assert [(r.project, r.file, r.error) for r in unread] == [("api", "node_modules/q.js", "not read")]
    assert rules.unread_files(table).count() == 0
    (broken,) = fl._read_texts(iter([pd.DataFrame({"path": [str(tmp_path / "gone.js")], "wanted": [True], "size": [1]})]))
    assert broken["content"][0] is None and broken["unread"][0].startswith("read error")
    everything = fl.read_tree(spark, str(tmp_path / "tree"), lanes=("root", "source", "skipped"))
    assert rules.scan(everything, skipped_dirs=[]).count() == 3
    side = rules.side_inputs(table)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lane" in side and "= root" in side


def test_read_reports(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "ruff.json").write_text("[\n]")
    row = rp.read_reports(spark, str(tmp_path)).first()
    assert (row.project, row.tool, row.payload) == ("p1", "ruff", "[\n]")
    (tmp_path / "p1" / "trivy-config").mkdir()
    body = '{"Results": [{"Misconfigurations": [{"ID": "X", "Severity": "HIGH"}]}]}'
    for name in ("api", "web"):
        (tmp_path / "p1" / "trivy-config" / f"{name}.json").write_text(body)
        (tmp_path / "p1" / "trivy-config" / f"{name}.run").write_text('{"target": "%s/Dockerfile", "version": "0.5"}' % name)
    (tmp_path / "p1" / "trivy.json").write_text("{}")
    (tmp_path / "p1" / "trivy.run").write_text('{"stderr": "no db", "returncode": 2, "root": "/w", "time": 1.5}')
    reports = rp.read_reports(spark, str(tmp_path))
    assert sorted(r.file for r in normalise.normalise(reports).collect()) == ["api/Dockerfile", "web/Dockerfile"]
    assert [r.error for r in normalise.report_errors(reports).collect()] == ["trivy: no db"]
    assert {(r.tool, r.root, r.version, r.time) for r in reports.collect()} == {
        ("ruff", "", "", 0.0), ("trivy", "/w", "", 1.5), ("trivy-config", "", "0.5", 0.0)}


def test_stored_reports_are_pruned_by_tool(spark, tmp_path):
    rows = [("p", "", t, "", "[]", "", 0) for t in ("ruff", "eslint", "biome")]
    rp.write_reports(spark.createDataFrame(rows, schemas.REPORTS), str(tmp_path / "r"))
    table = spark.read.parquet(str(tmp_path / "r"))
    plan = normalise.NORMALISERS["ruff"](rp.preferred_tools(table))._jdf.queryExecution().executedPlan().toString()
    assert "= ruff)" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rp.preferred_tools(table).count() == 2


@pytest.fixture()
def change_rows(spark):
    rows = [("p", "", "staged", "b.py", 0), ("p", "", "unstaged", "b.py", 1), ("p", "", "untracked", "a.py", 2),
            ("p", "", "staged", "  ", 3), ("p", "origin/main", "committed", "z.py", 4)]
    return spark.createDataFrame(rows, schemas.CHANGES)


def test_scopes(change_rows, make_files):
    assert sorted(r.path for r in ch.uncommitted(change_rows).collect()) == ["a.py", "b.py"]
    assert [r.path for r in ch.pull_request(change_rows).collect()] == ["z.py"]
    files = make_files({"a.py": "", "c.py": ""}).unionByName(make_files({"q.py": ""}, "q"))
    scoped = ch.in_scope(files, change_rows, "incremental")
    assert sorted(r.path for r in scoped.collect()) == ["a.py", "q.py"]
    none = ch.in_scope(files, change_rows, "incremental", empty_scope="none")
    assert [r.path for r in none.collect()] == ["a.py"]
    assert sorted(r.path for r in ch.in_scope(files, change_rows).collect()) == ["a.py", "c.py", "q.py"]


# ----------------------------------------------------------------------- scans
def test_whole_scan(spark, make_files, change_rows):
    files = make_files({"a.py": "eval(1)", "c.py": "eval(2)", "Dockerfile": "FROM x", "requirements.txt": "x"})
    reports = spark.createDataFrame(
        [("p", "", "ruff", "", '[{"code":"E1","filename":"c.py","message":"m"}]', "", 0),
         ("p", "", "trivy-config", "Dockerfile", '{"Results":[{"Misconfigurations":[{"ID":"D"}]}]}', "", 0)],
        schemas.REPORTS)
    out = scan_projects(files, ScanOptions(strict=True), reports=reports)
    got = sorted((r.rule_id, r.file) for r in out.findings.collect())
    assert got == [("CONTAINER-D", "Dockerfile"), ("LINT-RUFF-E1", "c.py"), ("SEC-003", "a.py"), ("SEC-003", "c.py"),
                   ("TOOL-MISSING-SAST", ""), ("TOOL-MISSING-SCA", ""), ("TOOL-MISSING-TYPECHECK", "")]
    results = {r.domain: (r.tool, r.findings, r.passed) for r in out.domain_results.collect()}
    assert results == {"security": ("builtin", 2, False), "lint": ("ruff", 1, True), "container": ("trivy-config", 1, True)}
    assert out.summary.first().scanned_files == 3  # two sources and the Dockerfile
    assert out.gate.first().failed
    changed = scan_projects(files, ScanOptions(domains=("security", "lint"), scan_mode="incremental"),
                            changes=change_rows, reports=reports)
    assert [(r.rule_id, r.file) for r in changed.findings.collect()] == [("SEC-003", "a.py")]


def test_unknown_domain_only_in_strict_mode(make_files):
    files = make_files({"a.py": "x"})
    opts = {"domains": ("security", "magic")}
    assert scan_projects(files, ScanOptions(**opts)).findings.count() == 0
    strict = scan_projects(files, ScanOptions(strict=True, **opts)).findings.collect()
    assert [r.rule_id for r in strict] == ["DOMAIN-UNKNOWN-MAGIC"]


def test_registry(make_files):
    rule = rules.pattern_rule("MY-1", "todo", "Note", severity="LOW")
    registry = Registry()
    assert registry.get("notes") is None
    registry.register(Domain("notes", lambda f, o: f))
    registry.register(Domain("notes", lambda f, o: rules.scan(f, rules=[rule], domain="notes", tool="notes")))
    files = make_files({"a.py": "todo"})
    out = scan_projects(files, ScanOptions(domains=("notes",)), registry=registry)
    assert [(r.rule_id, r.domain) for r in out.findings.collect()] == [("MY-1", "notes")]
    with pytest.raises(ValueError, match="lacks columns"):
        run_domain(Domain("bad", lambda f, o: f), files, ScanOptions())


def test_options_are_checked():
    with pytest.raises(ValueError):
        ScanOptions(scan_mode="sometimes")


# --------------------------------------------------------------------- streams
VERSIONS = "project string, root string, path string, version bigint, op string, content string"


def version_rows():
    return [("p", "", "a.py", 1, "write", "eval(1)"), ("p", "", "b.py", 2, "write", "eval(2)"),
            ("p", "", "a.py", 3, "write", "x = 1"), ("p", "", "b.py", 4, "write", "\neval(3)"),
            ("p", "", "c.py", 5, "write", "eval(4)"), ("p", "", "c.py", 6, "remove", ""),
            ("p", "", "package.json", 7, "write", '{"dependencies":{"x-internal":"1"}}')]


def test_stream_equals_batch(spark, tmp_path, make_files, make_findings):
    source = str(tmp_path / "in")
    rows = version_rows()
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, VERSIONS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", 1).parquet(source)
    roots = make_files({".gitignore": ""})
    query = watch.start_rescan(stream, roots, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "findings")).drop("batch_id")
    log = spark.read.parquet(str(tmp_path / "out" / "changes"))
    assert log.select("batch_id").distinct().count() == 2
    batch = watch.rescan(spark.createDataFrame(rows, VERSIONS), roots)
    key = ["file", "version", "line", "rule_id"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    base = make_findings([("OLD", "LOW", "a.py", 1), ("LINT", "LOW", "z.py", 1), ("PKG", "LOW", "package.json", 0)])
    now = watch.current_findings(log, found, base).collect()
    assert sorted((r.rule_id, r.file, r.line) for r in now) == [
        ("LINT", "z.py", 1), ("PKG", "package.json", 0), ("SEC-003", "b.py", 2)]
    totals = watch.start_scanned_total(
        spark.readStream.schema(VERSIONS).parquet(source), str(tmp_path / "sum"), str(tmp_path / "cp2"), True)
    totals.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sum")).first().scanned_files == 5


def test_snapshots(spark, make_files):
    files = make_files({"a.py": "", ".env.x": "", "build": "", "dist/a.py": "", "package.json": "", "build/x/b.js": ""})
    assert sorted(r.path for r in watch.snapshot(files).collect()) == [".env.x", "a.py"]
    schema = "project string, path string, mtime int"
    old = spark.createDataFrame([("p", "a", 5), ("p", "b", 5), ("p", "c", 5)], schema)
    new = spark.createDataFrame([("p", "a", 4), ("p", "b", 5), ("p", "d", 1)], schema)
    diff = {r.path: r.change for r in watch.snapshot_diff(old, new).collect()}
    assert diff == {"a": "modified", "c": "removed", "d": "added"}


# ------------------------------------------------------------------ whole scan
def test_scan_reports_errors_of_executed_domains(spark, make_files):
    """Unparseable payloads fail their domain; excluded folders and other domains give no errors."""
    from auditlake.plans.options import ScanOptions
    from auditlake.plans.scan import scan_projects

    files = make_files({"a.py": "x = 1", "vendor/package.json": "[]", "pkg/package.json": "[1]", "package-lock.json": "{}"})
    reports = spark.createDataFrame(
        [("p", "", "trivy", "", "not json", "", 0, "0.5", 2.0), ("p", "", "ruff", "", "[]", "", 0, "0.9", 1.5)],
        schemas.REPORTS + ", version string, time double")
    out = scan_projects(files, ScanOptions(exclude_patterns=("vendor",), domains=("security", "lint", "sca")), reports=reports)
    assert sorted((r.domain, r.error, r.failed) for r in out.errors.collect()) == [
        ("sca", "unparseable report of trivy", True), ("security", "pkg/package.json: package.json is not an object", False)]
    rows = {r.domain: (r.tool, r.version, r.time, r.passed, r.error) for r in out.domain_results.collect()}
    assert rows["sca"] == ("trivy", "0.5", 2.0, False, "unparseable report of trivy")
    assert rows["lint"] == ("ruff", "0.9", 1.5, True, "")
    assert rows["security"][0] == "builtin" and rows["security"][3]
    out = scan_projects(files, ScanOptions(domains=("lint", "typecheck", "sca")), reports=reports)
    assert {r.domain for r in out.errors.collect()} == {"sca"}


def test_reports_are_read_once_for_findings_and_once_for_errors(spark, make_files, tmp_path):
    from auditlake.operators import normalise

    spark.createDataFrame([("p", "", "ruff", "", "[]", "", 0)], schemas.REPORTS).write.parquet(str(tmp_path / "r"))
    reports = spark.read.parquet(str(tmp_path / "r"))
    for out in (normalise.normalise(reports), normalise.report_errors(reports)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_scope_plans_gather_nothing_in_one_task(spark, change_rows, make_files, tmp_path):
    make_files({"a.py": "", "c.py": ""}).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    for scope in ("full", "none"):
        df = ch.in_scope(files, change_rows, "incremental", empty_scope=scope)
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


# ----------------------------------------------------------------------- sinks
def documents(fragments):
    texts = {}
    for r in fragments.orderBy("project", "section", "number").collect():
        texts[r.project] = texts.get(r.project, "") + r.text
    return {p: json.loads(t) for p, t in texts.items()}


@pytest.fixture()
def scanned(make_files):
    files = make_files({"a.py": f"k = '{KEY}'\neval(\"x\")", "package.json": '{"dependencies":{"x-internal":"1"}}'})
    files = files.unionByName(make_files({"ok.py": "x = 1"}, "clean"))
    found = rules.scan(files)
    return found, fd.severity_summary(found, scanned_counts(files))


def test_json_document(scanned):
    docs = documents(sink.json_report(*scanned))
    assert docs["clean"] == {"passed": True, "scanned_files": 1, "findings": [],
                             "summary": {"critical": 0, "high": 0, "medium": 0, "low": 0, "total": 0}}
    assert [f["rule_id"] for f in docs["p"]["findings"]] == ["SEC-001", "SEC-003", "SEC-012"]
    assert docs["p"]["findings"][1]["snippet"] == 'eval("x")'


def test_sarif_document(scanned):
    docs = documents(sink.sarif_report(*scanned))
    run = docs["p"]["runs"][0]
    assert docs["p"]["version"] == "2.1.0" and docs["clean"]["runs"][0]["results"] == []
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SEC-001", "SEC-003", "SEC-012"]
    assert [r["level"] for r in run["results"]] == ["error", "error", "warning"]
    assert run["results"][2]["locations"][0]["physicalLocation"]["region"] == {"startLine": 0}


def test_compact_document(scanned, spark):
    domains = spark.createDataFrame(
        [("p", "security", "builtin", "1", 0.5, 3, False)],
        "project string, domain string, tool string, version string, time double, findings bigint, passed boolean")
    docs = documents(sink.compact_report(*scanned, domains))
    assert docs["clean"] == {"status": "pass", "scanned": 1,
                             "summary": {"critical": 0, "high": 0, "medium": 0, "total": 0}}
    assert docs["p"]["domains"]["security"]["findings"] == 3
    assert docs["p"]["findings"][0]["sev"] == "C" and "domain" not in docs["p"]["findings"][0]


def test_written_document_spans_part_files(spark, make_findings, tmp_path):
    df = make_findings([(f"R{i % 7}", "LOW", f"f{i:04d}", i) for i in range(500)])
    summary = fd.severity_summary(df, spark.createDataFrame([("p", 1)], "project string, scanned_files bigint"))
    sink.write_documents(sink.json_report(df, summary), str(tmp_path / "out"), partitions=4)
    parts = sorted((tmp_path / "out" / "project=p").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and [f["line"] for f in doc["findings"]] == list(range(500))


def test_packed_documents_are_read_by_ranges(spark, make_findings, tmp_path):
    df = make_findings([(f"R{i % 7}", "LOW", f"f{i:04d}é", i) for i in range(500)])
    names = F.explode(F.sequence(F.lit(1), F.lit(40))).alias("copy")
    small = make_findings([("A", "HIGH", "a\\nb", 3)]).select("*", names).withColumn(
        "project", F.format_string("q%02d", "copy")).drop("copy")
    found = df.unionByName(small)
    scanned = found.groupBy("project").agg(F.lit(1).cast("bigint").alias("scanned_files")).unionByName(
        spark.createDataFrame([("empty", 0)], "project string, scanned_files bigint"))
    folder = str(tmp_path / "packed")
    report = sink.json_report(found, fd.severity_summary(found, scanned))
    sink.pack_documents(report, folder, partitions=5)
    assert len(list((tmp_path / "packed" / "texts").glob("part=*/part-*"))) <= 5
    index = sink.document_index(spark, folder)
    rows = index.collect()
    # a large document has several pieces, small ones share a file
    assert sorted(r.piece for r in rows if r.project == "p") == list(range(sum(r.project == "p" for r in rows)))
    assert sum(r.project == "p" for r in rows) > 1 and len({r.file for r in rows}) <= 5

    def read(where):
        got = sink.read_documents(index.where(where)).orderBy("project", "piece", "block").collect()
        docs = {}
        for r in got:
            docs[r.project] = docs.get(r.project, b"") + bytes(r.bytes)
        return {p: json.loads(d) for p, d in docs.items()}

    assert [f["line"] for f in read("project = 'p'")["p"]["findings"]] == list(range(500))
    one = read("project = 'q17'")
    assert list(one) == ["q17"] and [f["line"] for f in one["q17"]["findings"]] == [3]
    everything = read("true")
    assert len(everything) == 42 and everything["empty"]["findings"] == []
    with pytest.raises(AnalysisException):
        sink.pack_documents(report, folder)


def test_table_sink(make_findings, spark, tmp_path):
    folder = str(tmp_path / "t")
    sink.write_table(make_findings([("A", "LOW", "a", 1)]), folder, by=("domain",))
    sink.write_table(make_findings([("B", "LOW", "a", 1)]), folder, by=("domain",))
    assert spark.read.parquet(folder).where(F.col("domain") == "security").count() == 2
