"""History, profiles, plans, triage and usage."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.operators import history, planner, profile, triage, usage


# -------------------------------------------------------------------- history
@pytest.mark.parametrize("c, h, m, lo, score", [
    (0, 0, 0, 0, 10.0), (1, 0, 0, 0, 8.0), (10, 0, 0, 0, 0.0), (1, 1, 0, 0, 7.0), (0, 0, 1, 3, 9.4)])
def test_health_score(spark, c, h, m, lo, score):
    row = spark.range(1).select(history.health_score(*[F.lit(x) for x in (c, h, m, lo)]).alias("s")).first()
    assert row.s == score


def make_history(spark, scores, project="p"):
    return spark.createDataFrame([(project, i, s) for i, s in enumerate(scores)],
                                 "project string, run_seq bigint, health_score double")


@pytest.mark.parametrize("scores, text", [
    ([10.0, 6.7], "↓ -3.3"), ([6.0, 7.0], "↑ +1.0"), ([7.0, 7.5], "→ stable"), ([9.0], ""),
    ([1.0, 10.0, 10.0], "→ stable")])
def test_trend(spark, scores, text):
    assert history.trend(make_history(spark, scores)).first().trend == text


def test_retention_follows_append_order(spark):
    kept = history.retain(make_history(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), 3)
    assert sorted(r.run_seq for r in kept.collect()) == [2, 3, 4]


def test_snapshots_with_clean_run(spark):
    found = spark.createDataFrame(
        [("p", 1, "security", "CRITICAL"), ("p", 1, "lint", "LOW"), ("p", 1, "lint", "LOW")],
        "project string, run_seq bigint, domain string, severity string")
    runs = spark.createDataFrame([("p", 1, None, 4), ("p", 2, None, 4)],
                                 "project string, run_seq bigint, ts timestamp_ntz, scanned_files bigint")
    one, two = history.snapshots(found, runs).orderBy("run_seq").collect()
    assert (one.domains, one.health_score, one.passed) == ({"lint": 2, "security": 1}, 7.8, False)
    assert (two.domains, two.health_score, two.passed, two.total_findings) == ({}, 10.0, True, 0)


def test_unreadable_history_is_empty(spark):
    full = '{"timestamp": "2024-05-01T10:00:00", "domains": {"lint": 3}, "low": 3}'
    lines = spark.createDataFrame([("p", 1, "{"), ("p", 2, '{"critical": 2}'), ("p", 3, full)],
                                  "project string, run_seq bigint, payload string")
    row, last = history.read_history(lines).orderBy("run_seq").collect()
    assert (row.critical, row.health_score, row.passed) == (2, 0.0, False)
    assert (row.ts, row.domains) == (None, {})
    assert (str(last.ts), last.domains, last.low) == ("2024-05-01 10:00:00", {"lint": 3}, 3)


# -------------------------------------------------------------------- profiles
def profile_of(make_files, tree):
    return profile.profile(make_files(tree)).first()


def test_python_profile(make_files):
    p = profile_of(make_files, {"requirements.txt": "FastAPI\n", "main.py": "x"})
    assert p.languages == ["python"] and p.frameworks == ["fastapi"]
    assert p.recommended_domains == ["security", "lint", "sast", "typecheck", "sca"]


def test_typescript_profile(make_files):
    deps = json.dumps({"dependencies": {"react": "1", "next": "1", "nextra": "1"}, "devDependencies": {"vitest": "1"}})
    p = profile_of(make_files, {"package.json": deps, "tsconfig.json": "{}", "src/app.tsx": "x",
                                "Dockerfile": "FROM x", "tests/app.test.tsx": "t"})
    assert p.frameworks == ["nextjs", "react", "vitest"] and p.primary_language == "typescript"
    assert p.has_dockerfile and p.has_tests and p.existing_tools == ["tsc"]
    assert p.recommended_domains[-1] == "container"


@pytest.mark.parametrize("tree, field, value", [
    ({"terraform/main.tf": "x"}, "has_iac", True), ({"a.Dockerfile": ""}, "has_dockerfile", True),
    ({"sub/docker-compose.yml": ""}, "has_dockerfile", True), ({"tests/a.py": ""}, "has_tests", False),
    ({"tests/test_a.py": ""}, "has_tests", True), ({"x.csproj": ""}, "languages", []),
    ({"node_modules/a.js": ""}, "languages", []), ({"a.rs": "", "b.go": ""}, "primary_language", "go"),
    ({"readme.txt": ""}, "recommended_domains", ["security"]),
    ({".eslintrc.json": "", "biome.json": "", "pyproject.toml": "[tool.ruff]\n[tool.pytest.ini_options]"},
     "existing_tools", ["biome", "eslint", "pytest", "ruff"]),
    ({"sub/pyproject.toml": "[tool.mypy]"}, "existing_tools", []),
    ({"package.json": "broken {"}, "frameworks", []),
    ({"app.js": "", "requirements.txt": "django", "Pipfile": "flask"}, "frameworks", ["django", "flask"]),
])
def test_profile_facts(make_files, tree, field, value):
    assert profile_of(make_files, tree)[field] == value


def test_linters(make_files):
    rows = profile.relevant_linters(make_files({"a.py": "", "b.rs": "", "c.tsx": ""})).collect()
    assert sorted(r.linter for r in rows) == ["biome", "clippy", "eslint", "ruff"]


# ----------------------------------------------------------------------- plans
def changes(spark, *paths):
    return spark.createDataFrame([("p", p, i) for i, p in enumerate(paths)],
                                 "project string, path string, seq bigint")


@pytest.mark.parametrize("paths, domains", [
    (["src/main.py"], "lint,sast,security,typecheck"), (["Dockerfile", "docker-compose.yml"], "container,iac,security"),
    (["package.json", "yarn.lock"], "sca,security"), (["terraform/main.tf"], "iac,security"),
    (["main.tf"], "security"), (["k8s/a.yaml"], "security"), (["infra/a.YAML"], "iac,security"),
    (["README.md"], "security"), (["x/infra"], "security"), (["prod.env"], "security")])
def test_plan_domains(spark, paths, domains):
    assert planner.reasoning(changes(spark, *paths)).first().domains == domains


def test_empty_change_set_has_no_plan(spark):
    empty = changes(spark, "x").where("false")
    assert planner.reasoning(empty).count() == 0 and planner.priority_files(empty).count() == 0


def test_reasoning(spark):
    paths = [f"src/auth{i}.py" for i in range(7)] + ["go.sum"]
    row = planner.reasoning(changes(spark, *paths)).first()
    assert row.reasoning == (
        "Security-sensitive files changed: " + ", ".join(paths[:5])
        + "; Dependency files changed — SCA scan recommended")
    assert planner.reasoning(changes(spark, "a.md")).first().reasoning == "Standard code changes"


def test_suggestions(spark):
    plan = changes(spark, "src/auth.py", "b.md")
    offered = spark.createDataFrame(
        [("p", "domain", 0, "sca"), ("p", "domain", 1, "lint"), ("p", "priority_file", 0, "b.md"),
         ("p", "priority_file", 1, "gone.py"), ("p", "priority_file", 2, "src/auth.py"),
         *[("p", "risk_area", i, f"r{i}") for i in range(7)], ("other", "domain", 0, "x")],
        "project string, kind string, pos int, value string")
    rows = {(r.part, r.value) for r in planner.merge_suggestions(plan, offered).where("origin = 'suggested'").collect()}
    assert rows == {("domain", "sca"), ("priority_file", "b.md"),
                    ("reasoning", "; AI risk areas: r0, r1, r2, r3, r4")}


# ---------------------------------------------------------------------- triage
def test_verdicts(make_findings):
    df = make_findings([
        ("SEC-001", "CRITICAL", "src/config.ts", 1), ("SEC-003", "HIGH", "tests/test_utils.js", 5),
        ("SEC-007", "LOW", "src/api.ts", 10), ("SEC-001", "CRITICAL", "fixtures/Mock.ts", 1),
        ("LINT-X", "LOW", "vendor/a.js", 1)])
    rows = {(r.rule_id, r.file): r for r in triage.verdicts(df).collect()}
    assert rows["SEC-001", "src/config.ts"].confidence == 0.95
    assert rows["SEC-003", "tests/test_utils.js"].explanation == "Finding is in test/example code"
    assert rows["SEC-007", "src/api.ts"].is_true_positive
    fixture = rows["SEC-001", "fixtures/Mock.ts"]
    assert (fixture.confidence, fixture.explanation) == (0.6, "Likely false positive: fixture context")
    assert not rows["LINT-X", "vendor/a.js"].is_true_positive


def test_review(make_findings, spark):
    projects = spark.createDataFrame([("p",), ("clean",)], "project string")
    df = triage.verdicts(make_findings([("SEC-001", "CRITICAL", "a.ts", 1), ("SEC-003", "HIGH", "tests/a.js", 5)]))
    rows = {r.project: r for r in triage.review(df, projects).collect()}
    assert rows["p"].risk_level == "critical" and rows["clean"].risk_level == "none"
    assert rows["p"].actions == ("Fix CRITICAL findings immediately before merging | "
                                 "Consider suppressing 1 likely false positive(s)")
    assert rows["clean"].actions == ""


def test_external_verdicts(make_findings, spark):
    df = triage.verdicts(make_findings([("A", "HIGH", "a", 1), ("B", "HIGH", "b", 1), ("C", "LOW", "a", 1)]))
    external = spark.createDataFrame(
        [("p", 2, False, None, "no", 1), ("p", 2, None, 0.5, None, 2), ("p", 9, False, 0.1, "x", 3)],
        "project string, id bigint, tp boolean, confidence double, reason string, seq bigint")
    rows = {r.rule_id: r for r in triage.merge_verdicts(df, external).collect()}
    assert (rows["B"].is_true_positive, rows["B"].confidence, rows["B"].explanation) == (False, 0.5, "no")
    assert rows["A"].is_true_positive and rows["C"].number == 3


def test_review_packet(make_findings, make_files):
    files = make_files({"a.py": "l1\nl2\nl3\nl4\nl5\nl6"})
    df = make_findings([("A", "HIGH", "a.py", 4, "msg"), ("B", "LOW", "", 0, "tool")])
    rows = {r.rule_id: r.packet for r in triage.review_packet(df, files).collect()}
    assert rows["A"] == "[1] HIGH A: msg\n    File: a.py:4\n    Context:\nl2\nl3\nl4\nl5\nl6\n"
    assert rows["B"] == "[2] LOW B: tool\n    File: :0\n"


# ----------------------------------------------------------------------- usage
def calls(spark, rows):
    return spark.createDataFrame(
        [("r", i, p, "", a, b, 0, "") for i, (p, a, b) in enumerate(rows)], schemas.USAGE)


def test_cost_and_totals(spark):
    df = usage.cost(calls(spark, [("anthropic", 100, 50), ("openai", 200, 100), ("other", 1, 1)]))
    rows = {r.provider: r for r in df.collect()}
    assert rows["anthropic"].cost_usd == pytest.approx(0.00105)
    assert rows["anthropic"].cost_microdollars in (1049, 1050) and rows["openai"].cost_microdollars == 0
    total = usage.totals(df).first()
    assert (total.calls, total.input_tokens, total.output_tokens, total.cost_usd) == (3, 301, 151, 0.00114)


def test_budget_stops_after_the_call_that_reaches_it(spark):
    df = usage.cost(calls(spark, [("anthropic", 0, 20000)] * 6))
    rows = usage.budget_gate(df, 1.0).orderBy("seq").collect()
    assert [r.refused for r in rows] == [False, False, False, False, True, True]
