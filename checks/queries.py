"""The registered queries: one per operator, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import text as tx
from auditlake.functions.scale import ensure_checkpoint_dir, scratch_folder, stored
from auditlake.operators import findings as fd
from auditlake.operators import (
    history, lines, normalise, planner, profile, rules, selection, triage, usage,
)
from auditlake.plans import scan as plan
from auditlake.plans.options import ScanOptions
from auditlake.plans.registry import Domain, Registry
from auditlake.sinks import reports as sink
from auditlake.sinks.store import Published
from auditlake.sources import changes as ch
from auditlake.sources import files as fl
from auditlake.sources import reports as rp
from auditlake.streaming import watch
from checks import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FINDING = ["project", "rule_id", "severity", "file", "line", "message", "snippet", "fix"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scan(spark: SparkSession, sf: str, *rule_ids: str, sub: int | None = None) -> DataFrame:
    chosen = rules.rules_of(*rule_ids, sub=sub) if rule_ids else rules.ALL_RULES
    return rules.scan(corpus.files(spark, sf), corpus.root_files(spark, sf), chosen)


# ------------------------------------------------------------ A sources, scope
@query
def files_corpus(spark, sf):
    return corpus.files(spark, sf).select(
        "project", "path", F.length("content").cast("bigint").alias("n_chars"), "mtime"
    )


@query
def scan_paths(spark, sf):
    paths = corpus.changes(spark, sf).where(F.col("kind") == "committed")
    chosen = ch.only_paths(corpus.files(spark, sf), paths)
    return selection.eligible_files(chosen).select("project", "path")


@query
def scope_uncommitted(spark, sf):
    return ch.uncommitted(corpus.changes(spark, sf)).orderBy("project", "path")


@query
def scope_pr(spark, sf):
    return ch.pull_request(corpus.changes(spark, sf), "origin/dev").select("project", "path", "seq")


@query
def scope_mode_fallback(spark, sf):
    scoped = ch.in_scope(corpus.files(spark, sf), corpus.changes(spark, sf), "incremental")
    return scoped.select("project", "path")


@query
def reports_parse_status(spark, sf):
    return rp.parse_status(corpus.reports(spark, sf)).groupBy("project", "tool", "status").agg(
        F.count("*").alias("reports")
    )


@query
def side_inputs(spark, sf):
    roots = corpus.root_files(spark, sf)
    ignores = fl.ignore_lines(roots).select("project", F.lit("ignore").alias("kind"), "pattern")
    configs = fl.registry_configs(roots).select(
        "project", F.lit("registry").alias("kind"), F.lit(".npmrc").alias("pattern")
    )
    return ignores.unionByName(configs)


# --------------------------------------------------------------- B selection
@query
def path_parts(spark, sf):
    return selection.with_path_columns(corpus.files(spark, sf)).select(
        "project", "path", "name", "suffix"
    )


@query
def skip_dirs(spark, sf):
    files = corpus.files(spark, sf)
    return files.select(
        "project", "path", selection.in_skipped_dir(F.col("path")).alias("skipped")
    )


@query
def eligible_files(spark, sf):
    return selection.eligible_files(corpus.files(spark, sf)).select("project", "path", "suffix")


@query
def scanned_counts(spark, sf):
    return selection.scanned_counts(corpus.files(spark, sf))


# ------------------------------------------------------------------- C lines
@query
def file_lines(spark, sf):
    return lines.file_lines(corpus.files(spark, sf))


@query
def line_context(spark, sf):
    return lines.line_context(corpus.files(spark, sf), 1, 1).select(
        "project", "path", "line", F.md5("context").alias("context_md5")
    )


@query
def snippets(spark, sf):
    return lines.file_lines(corpus.files(spark, sf)).select(
        "project", "path", "line", tx.snippet(F.col("text")).alias("snippet")
    )


# ------------------------------------------------------------------- D rules
@query
def sec001_secrets(spark, sf):
    return _scan(spark, sf, "SEC-001").select(*FINDING, "sub_seq", "match_start")


@query
def secrets_by_label(spark, sf):
    return _scan(spark, sf, "SEC-001").groupBy("message").agg(F.count("*").alias("findings"))


def _register_rule(name: str, rule_id: str, sub: int | None = None) -> None:
    QUERIES[name] = lambda spark, sf: _scan(spark, sf, rule_id, sub=sub).select(*FINDING)


_register_rule("sec002_env_committed", "SEC-002")
_register_rule("sec003_eval", "SEC-003")
_register_rule("sec004_sql_injection", "SEC-004")
_register_rule("sec005_express", "SEC-005", 0)
_register_rule("sec005_fastapi", "SEC-005", 1)
_register_rule("sec006_cors", "SEC-006")
_register_rule("sec007_http_url", "SEC-007")
_register_rule("sec008_admin_route", "SEC-008")
_register_rule("sec009_localstorage", "SEC-009")
_register_rule("sec010_console_env", "SEC-010")
_register_rule("sec011_service_role", "SEC-011")
_register_rule("sec012_internal_names", "SEC-012", 0)
_register_rule("sec012_scoped_no_registry", "SEC-012", 1)


@query
def all_findings(spark, sf):
    return _scan(spark, sf).select(*FINDING, "rule_seq", "sub_seq", "match_start")


TOKEN_PATTERN = r'(?i)(?<![\p{L}\p{N}_])token\s*=\s*"[0-9a-f]{40}"'


@query
def custom_token_rule(spark, sf):
    rule = rules.pattern_rule(
        "CUSTOM-TOKEN", TOKEN_PATTERN, "Hex token", severity="HIGH",
        fix="Move to environment variables.", trigger=rules.any_word("token"),
    )
    return rules.scan(corpus.files(spark, sf), rules=[rule]).select(*FINDING)


# ------------------------------------------------------ E findings algebra
def _merged(spark, sf):
    """Built-in findings plus the findings of all tools."""
    return fd.merge(_scan(spark, sf), normalise.normalise(corpus.reports(spark, sf)))


def _scanned(spark, sf):
    return selection.scanned_counts(corpus.files(spark, sf))


@query
def merged_findings(spark, sf):
    return _merged(spark, sf).select(*FINDING, "domain", "tool", "category", "url")


@query
def sorted_findings(spark, sf):
    return fd.sort_findings(stored(_merged(spark, sf))).select(
        "project", "severity", "sev_rank", "file", "line", "domain", "rule_id"
    )


@query
def severity_summary(spark, sf):
    return fd.severity_summary(_scan(spark, sf), _scanned(spark, sf))


@query
def gate_by_level(spark, sf):
    return fd.gate(_scan(spark, sf), _scanned(spark, sf))


def _executed(spark, sf):
    """Every third project ran no type checker and no container scan."""
    # a few rows a project, used twice below
    tools = stored(corpus.reports(spark, sf).where(
        ~F.col("tool").isin("mypy", "pyright", "tsc", "trivy-config")
        | (F.substring("project", 5, 2).cast("int") % 3 > 0)
    ).select("project", "tool").distinct())
    found = tools.select("project", rp.domain_of(F.col("tool")).alias("domain")).distinct()
    used = normalise.tools_used(tools, found)
    builtin = _scanned(spark, sf).select(
        "project", F.lit("security").alias("domain"), F.lit("builtin").alias("tool")
    )
    return builtin.unionByName(used).select(
        "project", "domain", "tool", F.lit("1").alias("version"), F.lit(0.0).alias("time")
    )


@query
def domain_summary(spark, sf):
    return fd.domain_summary(_merged(spark, sf), _executed(spark, sf))


def _requested(spark, sf):
    """Every project asks for all domains and one nobody knows."""
    names = F.explode(F.array(*[F.lit(d) for d in [*catalog.DOMAINS, "quantum"]]))
    return _scanned(spark, sf).select("project", names.alias("domain"))


@query
def strict_missing(spark, sf):
    available = _executed(spark, sf).select("project", "domain")
    return fd.missing_tools(_requested(spark, sf), available).select(
        "project", "rule_id", "severity", "message", "domain", "category"
    )


@query
def strict_unknown(spark, sf):
    return fd.unknown_domains(_requested(spark, sf)).select(
        "project", "rule_id", "severity", "message", "domain", "category"
    )


@query
def domain_selection(spark, sf):
    """Projects with a root pyproject configure their domains; others take the advice."""
    roots = corpus.root_files(spark, sf)
    prof = profile.profile(corpus.files(spark, sf), roots)
    configured = F.when(
        F.array_contains("existing_tools", "ruff"),
        F.array(F.lit("security"), F.lit("sast"), F.lit("quantum")),
    )
    projects = prof.select(
        "project", configured.alias("configured"),
        F.col("recommended_domains").alias("recommended"),
    )
    return fd.select_domains(projects)


@query
def run_errors(spark, sf):
    reports = corpus.reports(spark, sf, "semgrep", "trivy", "checkov")
    return normalise.report_errors(reports).select("project", "domain", "error")


@query
def first_errors(spark, sf):
    """The first ten errors of each project."""
    errors = normalise.report_errors(corpus.reports(spark, sf)).select("project", "domain", "error")
    return fd.first_errors(errors).select("project", "position", "domain", "error")


@query
def scanned_total(spark, sf):
    files = corpus.files(spark, sf)
    return fd.scanned_total(_scanned(spark, sf), profile.dockerfile_counts(files))


@query
def top_findings(spark, sf):
    return fd.top_findings(stored(_scan(spark, sf))).select(
        "project", "position", "rule_id", "file", "line", "message", "more"
    )


@query
def fix_guidance(spark, sf):
    return fd.fix_guidance(_merged(spark, sf))


@query
def rule_catalogue(spark, sf):
    return fd.rule_catalogue(_merged(spark, sf)).select("project", "rule_id", "message", "level")


@query
def explain_findings(spark, sf):
    """Ask for an eval finding on the last line of every file."""
    files = corpus.files(spark, sf)
    asked = files.select(
        "project", F.lit("SEC-003").alias("rule_id"), "path",
        F.size(tx.split_lines(F.col("content"))).alias("line"),
    )
    return fd.explain(asked, _scan(spark, sf, "SEC-003"), files)


@query
def file_results(spark, sf):
    files = selection.eligible_files(corpus.files(spark, sf))
    return fd.file_results(_scan(spark, sf), files)


@query
def summary_line(spark, sf):
    return fd.summary_line(fd.severity_summary(_scan(spark, sf), _scanned(spark, sf)))


# ------------------------------------------------------------ F normalisers
def _register_normaliser(name: str, tool: str) -> None:
    QUERIES[name] = lambda spark, sf: normalise.NORMALISERS[tool](
        corpus.reports(spark, sf, tool)
    ).select(*FINDING, "domain", "tool", "category", "url")


for _name, _tool in {
    "norm_ruff": "ruff", "norm_eslint": "eslint", "norm_biome": "biome",
    "norm_clippy": "clippy", "norm_golangci": "golangci-lint", "norm_mypy": "mypy",
    "norm_pyright": "pyright", "norm_tsc": "tsc", "norm_sast": "semgrep",
    "norm_sca": "trivy", "norm_iac": "checkov", "norm_container": "trivy-config",
}.items():
    _register_normaliser(_name, _tool)


def _mixed_tools(spark, sf):
    """Projects differ in the tools they ran: some have ruff for eslint, tsc for mypy."""
    reports = corpus.reports(spark, sf, "eslint", "biome", "mypy", "pyright", "semgrep")
    number = F.substring("project", 5, 2).cast("int")
    tool = F.col("tool")
    return reports.withColumn(
        "tool",
        F.when((tool == "eslint") & (number % 2 == 1), "ruff")
        .when((tool == "mypy") & (number % 3 == 1), "tsc")
        .otherwise(tool),
    )


@query
def tool_preference(spark, sf):
    return rp.preferred_tools(_mixed_tools(spark, sf)).groupBy("project", "tool").agg(
        F.count("*").alias("reports")
    )


def _every_tool(spark, sf):
    """Reports of all tools; even projects have opengrep beside semgrep, some lack eslint or mypy."""
    number = F.substring("project", 5, 2).cast("int")
    tool = F.col("tool")
    reports = corpus.reports(spark, sf)
    both = reports.where((tool == "semgrep") & (number % 2 == 0)).withColumn("tool", F.lit("opengrep"))
    return reports.where(
        ~((tool == "eslint") & (number % 2 == 1)) & ~((tool == "mypy") & (number % 3 == 1))
    ).unionByName(both)


@query
def tool_preference_all(spark, sf):
    """All three pairs: eslint before biome, mypy before pyright, opengrep before semgrep."""
    return rp.preferred_tools(_every_tool(spark, sf)).groupBy("project", "tool").agg(
        F.count("*").alias("reports")
    )


@query
def domain_tools_used_all(spark, sf):
    reports = rp.preferred_tools(_every_tool(spark, sf))
    names = F.explode(F.array(*[F.lit(d) for d in dict.fromkeys(catalog.TOOL_DOMAIN.values())]))
    asked = reports.select("project").distinct().select("project", names.alias("domain"))
    return normalise.tools_used(reports, asked)


@query
def preferred_findings(spark, sf):
    """Findings a domain of the preferred tools' reports, opengrep among them."""
    found = normalise.normalise(rp.preferred_tools(_every_tool(spark, sf)))
    return found.groupBy("project", "domain", "tool").agg(F.count("*").alias("findings"))


@query
def sast_rulesets(spark, sf):
    """Analysers ran several rulesets; two of them are asked for, other tools keep their findings."""
    size = F.substring("project", 5, 2).cast("int") % 4
    names = F.element_at(F.array(*map(F.lit, ["p/ci", "p/python", "auto"])), size)
    reports = corpus.reports(spark, sf, "semgrep", "trivy").withColumn("ruleset", F.when(size > 0, names))
    found = normalise.normalise(rp.of_rulesets(reports, ["p/ci", "auto"]), ["semgrep", "trivy"])
    return found.groupBy("project", "tool").agg(F.count("*").alias("findings"))


@query
def tool_overrides(spark, sf):
    reports = corpus.reports(spark, sf, "ruff", "checkov")
    found = normalise.normalise(reports, ["ruff", "checkov"])
    kept = normalise.apply_overrides(found, ["E1", "F"], ["CKV_7", "CKV_20"])
    return kept.select("project", "rule_id", "file", "line")


@query
def incremental_tools(spark, sf):
    """All tools; odd projects report absolute names, every fifth project has no changes."""
    number = F.substring("project", 5, 2).cast("int")
    absolute = F.col("tool").isin("ruff", "biome", "mypy", "pyright") & (number % 2 == 1)
    reports = corpus.reports(spark, sf).withColumn(
        "payload",
        F.when(absolute, F.replace("payload", F.lit("src/p"), F.concat("root", F.lit("/src/p"))))
        .otherwise(F.col("payload")),
    )
    changed = corpus.parts(spark, sf).select(
        F.expr(corpus.PROJECT_SQL.format(n="p_partkey % 21")).alias("project"),
        F.expr("concat('src/p', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '.js' END)")
        .alias("path"),
    ).where(number % 5 != 0)
    found = normalise.only_changed(normalise.normalise(reports), changed, reports)
    return found.select("project", "rule_id", "file", "tool")


@query
def domain_tools_used(spark, sf):
    reports = rp.preferred_tools(_mixed_tools(spark, sf))
    names = F.explode(F.array(F.lit("lint"), F.lit("typecheck"), F.lit("sast"), F.lit("sca")))
    asked = reports.select("project").distinct().select("project", names.alias("domain"))
    return normalise.tools_used(reports, asked)


# ---------------------------------------------------------------- G history
def _snapshots(spark, sf):
    return history.snapshots(corpus.run_findings(spark, sf), corpus.runs(spark, sf))


@query
def health_score(spark, sf):
    return _snapshots(spark, sf).select(
        "project", "run_seq", "critical", "high", "medium", "low", "health_score"
    )


@query
def run_snapshots(spark, sf):
    counts = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("domains")),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )
    return _snapshots(spark, sf).select(
        "project", "run_seq", "ts", "scanned_files", "total_findings", "critical", "high",
        "medium", "low", "health_score", "passed", counts.alias("domains"),
    )


@query
def history_retention(spark, sf):
    return history.retain(_snapshots(spark, sf)).select("project", "run_seq", "health_score")


@query
def history_last_n(spark, sf):
    """History stored as JSON lines without some fields, read back, last ten."""
    stored = _snapshots(spark, sf).select(
        "project", "run_seq",
        F.when(F.col("run_seq") % 13 == 0, F.lit("broken {"))
        .otherwise(
            F.to_json(F.struct("total_findings", "critical",
                               F.when(F.col("run_seq") % 2 == 0, F.col("health_score"))
                               .alias("health_score")))
        ).alias("payload"),
    )
    return history.last_runs(history.read_history(stored)).select(
        "project", "run_seq", "age", "total_findings", "critical", "low", "health_score", "passed"
    )


@query
def health_trend(spark, sf):
    return history.trend(_snapshots(spark, sf))


# --------------------------------------------------------------- H profiling
@query
def lang_markers(spark, sf):
    return profile.marker_languages(corpus.root_files(spark, sf))


@query
def lang_by_suffix(spark, sf):
    return profile.suffix_languages(corpus.files(spark, sf))


@query
def frameworks_py(spark, sf):
    roots = corpus.root_files(spark, sf)
    return profile.python_frameworks(roots, profile.languages(corpus.files(spark, sf), roots))


@query
def frameworks_js(spark, sf):
    return profile.js_frameworks(corpus.root_files(spark, sf))


@query
def has_tests(spark, sf):
    return profile.path_flags(corpus.files(spark, sf)).select("project", "has_tests")


@query
def existing_tools(spark, sf):
    return profile.existing_tools(corpus.root_files(spark, sf))


@query
def has_dockerfile(spark, sf):
    return profile.path_flags(corpus.files(spark, sf)).select(
        "project", "has_dockerfile", "has_iac"
    )


def _profile(spark, sf):
    prof = profile.profile(corpus.files(spark, sf), corpus.root_files(spark, sf))
    for c in ("languages", "frameworks", "existing_tools", "recommended_domains"):
        prof = prof.withColumn(c, F.array_join(c, ","))
    return prof


@query
def primary_language(spark, sf):
    return _profile(spark, sf).select("project", "primary_language")


@query
def relevant_linters(spark, sf):
    return profile.relevant_linters(corpus.files(spark, sf))


@query
def recommended_domains(spark, sf):
    return _profile(spark, sf).select("project", "recommended_domains")


@query
def project_profile(spark, sf):
    return _profile(spark, sf)


# ----------------------------------------------------------------- I planner
def _uncommitted(spark, sf):
    return corpus.changes(spark, sf).select("project", "path", "seq").distinct()


@query
def plan_domains(spark, sf):
    return planner.plan_domains(_uncommitted(spark, sf))


@query
def plan_priority_files(spark, sf):
    return planner.priority_files(_uncommitted(spark, sf))


@query
def plan_reasoning(spark, sf):
    return planner.reasoning(_uncommitted(spark, sf))


def _suggestions(spark, sf):
    """Outside suggestions, one per document: a domain, a file or a risk area."""
    return corpus.table(spark, sf, "documents").select(
        F.expr(corpus.PROJECT_SQL.format(n="doc_id % 21")).alias("project"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'priority_file' ELSE 'risk_area' END")
        .alias("kind"),
        F.col("doc_id").alias("pos"),
        F.expr(
            "CASE doc_id % 3 WHEN 0 THEN concat('dom', cast(doc_id % 4 as varchar(20))) "
            f"WHEN 1 THEN {corpus.PATH_SQL} ELSE concat('area ', lang) END"
        ).alias("value"),
    )


@query
def plan_merge_external(spark, sf):
    return planner.merge_suggestions(_uncommitted(spark, sf), _suggestions(spark, sf))


# ------------------------------------------------------------------ J triage
def _triaged(spark, sf):
    return triage.verdicts(_merged(spark, sf))


VERDICT = ["is_true_positive", "confidence", "explanation"]


@query
def triage_verdicts(spark, sf):
    return _triaged(spark, sf).select(
        "project", "rule_id", "severity", "file", "line", *VERDICT, "suggested_fix"
    )


@query
def triage_risk(spark, sf):
    return triage.review(_triaged(spark, sf), _scanned(spark, sf)).select(
        "project", "true_positives", "false_positives", "risk_level"
    )


@query
def triage_actions(spark, sf):
    return triage.review(_triaged(spark, sf), _scanned(spark, sf)).select(
        "project", "summary", "actions"
    )


@query
def triage_split(spark, sf):
    good, bad = triage.split(_triaged(spark, sf))
    both = good.withColumn("side", F.lit("tp")).unionByName(bad.withColumn("side", F.lit("fp")))
    return both.groupBy("project", "rule_id", "side").agg(F.count("*").alias("findings"))


@query
def review_packet(spark, sf):
    return triage.review_packet(_scan(spark, sf), corpus.files(spark, sf))


EXTERNAL_SQL = {
    "id": "cast(doc_id as bigint) {div} 21 + 1",
    "tp": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 = 0 END",
    "confidence": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE cast(doc_id % 100 as double) / 100 END",
    "reason": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('seen in ', lang) END",
    "seq": "doc_id",
}


def _external_verdicts(spark, sf):
    return corpus.table(spark, sf, "documents").select(
        F.expr(corpus.PROJECT_SQL.format(n="doc_id % 21")).alias("project"),
        *[F.expr(sql.format(div="div")).alias(c) for c, sql in EXTERNAL_SQL.items()],
    )


@query
def triage_merge_external(spark, sf):
    triaged = triage.verdicts(_scan(spark, sf))
    return triage.merge_verdicts(triaged, _external_verdicts(spark, sf)).select(
        "project", "number", "rule_id", "file", "line", *VERDICT
    )


# ------------------------------------------------------------------- K usage
def _costed(spark, sf):
    return usage.cost(corpus.usage(spark, sf))


@query
def usage_cost(spark, sf):
    return _costed(spark, sf).select(
        "registry", "seq", "provider", "input_tokens", "output_tokens", "cost_usd",
        "cost_microdollars",
    )


@query
def usage_totals(spark, sf):
    return usage.totals(_costed(spark, sf))


@query
def usage_by_provider(spark, sf):
    return usage.by_provider(_costed(spark, sf))


@query
def usage_budget_gate(spark, sf):
    return usage.budget_gate(_costed(spark, sf), 0.05).select(
        "registry", "seq", F.col("spent_before").cast("double").alias("spent_before"), "refused"
    )


# --------------------------------------------------------------- L streaming
@query
def watch_snapshot(spark, sf):
    return watch.snapshot(corpus.files(spark, sf))


@query
def snapshot_diff(spark, sf):
    """Against a later state: some files gone, some new, some touched."""
    old = watch.snapshot(corpus.files(spark, sf))
    path = F.col("path")
    new = old.where(~path.endswith(".jsx")).select(
        "project",
        F.when(path.endswith(".ts"), F.concat(path, F.lit("x"))).otherwise(path).alias("path"),
        F.when(path.endswith(".py"), F.expr("mtime - interval '1' hour"))
        .otherwise(F.col("mtime")).alias("mtime"),
    )
    return watch.snapshot_diff(old, new)


def _events_versions(spark, sf):
    return corpus.versions_of(corpus.table(spark, sf, "events"))


@query
def rescan_changed(spark, sf):
    """Batch twin of ``stream_rescan``."""
    return watch.rescan(_events_versions(spark, sf), corpus.root_files(spark, sf)).select(
        "project", "file", "version", "rule_id", "line", "message"
    )


def _event_stream(spark, sf):
    schema = corpus.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run_stream(spark, sf):
    """Drive the events table through the rescan stream; returns its output folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/rescan-{uuid.uuid4().hex}"
    started = watch.start_rescan(
        corpus.versions_of(_event_stream(spark, sf)), corpus.root_files(spark, sf), folder,
        f"{folder}/checkpoint", available_now=True,
    )
    started.awaitTermination()
    return folder


@query
def stream_rescan(spark, sf):
    folder = _run_stream(spark, sf)
    return spark.read.parquet(f"{folder}/findings").select(
        "project", "file", "version", "rule_id", "line", "message"
    )


@query
def current_findings(spark, sf):
    versions = _events_versions(spark, sf)
    changes = watch.watched_versions(versions)
    rescanned = watch.rescan(versions, corpus.root_files(spark, sf))
    return watch.current_findings(changes, rescanned, _scan(spark, sf)).select(
        "project", "rule_id", "severity", "file", "line", "message"
    )


@query
def stream_scanned_total(spark, sf):
    """Running count of rescans, driven as a stream to its end."""
    folder = f"{ensure_checkpoint_dir(spark)}/totals-{uuid.uuid4().hex}"
    started = watch.start_scanned_total(
        corpus.versions_of(_event_stream(spark, sf)), f"{folder}/totals",
        f"{folder}/checkpoint", available_now=True,
    )
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/totals").select("project", "scanned_files")


# ------------------------------------------------------------------- M sinks
def _documents(make, spark, sf, **more):
    found = stored(_scan(spark, sf))
    summary = fd.severity_summary(found, _scanned(spark, sf))
    return make(found, summary, **more)


@query
def report_json(spark, sf):
    return _documents(sink.json_report, spark, sf)


@query
def report_sarif(spark, sf):
    return _documents(sink.sarif_report, spark, sf)


@query
def report_compact(spark, sf):
    merged = stored(_merged(spark, sf))
    summary = fd.severity_summary(merged, _scanned(spark, sf))
    domains = fd.domain_summary(merged, _executed(spark, sf))
    return sink.compact_report(merged, summary, domains)


@query
def report_index(spark, sf):
    """Packed JSON documents, read back by ranges: bytes by the index and as read."""
    folder = scratch_folder(spark, "packed")
    sink.pack_documents(_documents(sink.json_report, spark, sf), folder)
    index = sink.document_index(spark, folder)
    read = sink.read_documents(index).groupBy("project").agg(
        F.sum(F.octet_length("bytes")).alias("bytes_read"),
        F.sum(F.regexp_count(F.col("bytes").cast("string"), F.lit("\n"))).alias("fragments"),
    )
    return index.groupBy("project").agg(F.sum("length").alias("bytes")).join(read, "project")


# -------------------------------------------------------- N, compositions
@query
def scan_pr(spark, sf):
    """Pull-request scan: scope, rules and summary in one plan."""
    outcome = plan.scan_projects(
        corpus.files(spark, sf),
        ScanOptions(domains=("security",), scan_mode="pr", base_ref="origin/dev"),
        changes=corpus.changes(spark, sf),
        root_files=corpus.root_files(spark, sf),
    )
    return outcome.summary


@query
def scan_all_domains(spark, sf):
    """Full scan over recommended domains with tool reports, per domain."""
    outcome = plan.scan_projects(
        corpus.files(spark, sf),
        ScanOptions(strict=True),
        reports=corpus.reports(spark, sf),
        root_files=corpus.root_files(spark, sf),
    )
    return outcome.findings.groupBy("project", "domain", "severity").agg(
        F.count("*").alias("findings")
    )


@query
def findings_table(spark, sf):
    """Findings written as a table by domain, and read back."""
    folder = scratch_folder(spark, "findings")
    sink.write_table(_merged(spark, sf), folder, by=("domain",))
    return spark.read.parquet(folder).groupBy("project", "domain", "severity").agg(
        F.count("*").alias("findings")
    )


@query
def scan_errors(spark, sf):
    """Errors of a scan over all domains; broken payloads fail theirs."""
    outcome = plan.scan_projects(
        corpus.files(spark, sf),
        ScanOptions(domains=tuple(catalog.DOMAINS)),
        reports=corpus.reports(spark, sf),
        root_files=corpus.root_files(spark, sf),
    )
    return outcome.errors.select("project", "domain", "error", "failed")


def _undocumented(files, options):
    """A custom domain: every Markdown file is a finding."""
    found = files.where(F.col("path").endswith(".md"))
    fixed = {
        "rule_id": "DOC-001", "severity": "LOW", "message": "Unreviewed document", "snippet": "",
        "fix": "", "domain": "docs", "tool": "docs", "category": "style", "url": "",
    }
    numbers = {"sev_rank": ("int", 3), "line": ("int", 0), "rule_seq": ("int", 0),
               "sub_seq": ("int", 0), "match_start": ("bigint", 0)}
    return found.select(
        "project", F.col("path").alias("file"),
        *[F.lit(v).alias(k) for k, v in fixed.items()],
        *[F.lit(v).cast(t).alias(k) for k, (t, v) in numbers.items()],
    )


@query
def custom_domain(spark, sf):
    """A registered domain of one's own within a scan."""
    registry = Registry()
    registry.register(Domain("docs", scan=_undocumented))
    outcome = plan.scan_projects(
        corpus.files(spark, sf), ScanOptions(domains=("docs", "security")),
        root_files=corpus.root_files(spark, sf), registry=registry,
    )
    return outcome.findings.where("domain = 'docs'").select("project", "file", "rule_id", "severity", "tool")


def _broken_task(files, options):
    """A custom domain that fails inside its tasks."""
    return _undocumented(files, options).withColumn(
        "message", F.when(F.length("file") > 0, F.raise_error("no rules loaded")).otherwise(F.lit("")))


def _broken_build(files, options):
    """A custom domain that fails before it has a plan."""
    raise RuntimeError("no configuration")


def _broken_probe():
    raise OSError("tool not answering")


@query
def isolated_domains(spark, sf):
    """Domains that fail at build, in a task and when probed, beside ones that work."""
    registry = Registry()
    registry.register(Domain("docs", scan=_undocumented))
    registry.register(Domain("badbuild", scan=_broken_build))
    registry.register(Domain("badtask", scan=_broken_task))
    registry.register(Domain("badprobe", scan=_undocumented, available=_broken_probe))
    outcome = plan.scan_projects(
        corpus.files(spark, sf),
        ScanOptions(domains=("security", "docs", "badbuild", "badtask", "badprobe"), measured=True),
        root_files=corpus.root_files(spark, sf), registry=registry,
    )
    crash = F.regexp_extract("error", "crashed: .*?(no configuration|no rules loaded|tool not answering)", 1)
    return outcome.domain_results.select(
        "project", "domain", "tool", (F.col("time") > 0).alias("timed"), "findings", "passed",
        crash.alias("crash"),
    )


# -------------------------------------------------- stores that are kept up to date
def _scratch(spark, name):
    return scratch_folder(spark, name).removesuffix("/rows")


@query
def maintained_findings(spark, sf):
    """The current view from a store: first scan, a stream of changes, compaction, an old batch again."""
    folder = _scratch(spark, "current")
    view = watch.CurrentFindings(spark, f"{folder}/view")
    view.start(_scan(spark, sf))
    roots = corpus.root_files(spark, sf)
    started = view.follow(
        corpus.versions_of(_event_stream(spark, sf)), roots, f"{folder}/checkpoint", available_now=True)
    started.awaitTermination()
    view.store.compact()
    view.change(_events_versions(spark, sf), roots, batch_id=0)
    return view.read().select("project", "rule_id", "severity", "file", "line", "message")


@query
def stream_rescan_once(spark, sf):
    """Every event is delivered twice; findings are those of one delivery."""
    twice = _event_stream(spark, sf)
    twice = twice.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    versions = corpus.versions_of(twice, "ts")
    folder = _scratch(spark, "once")
    started = watch.start_rescan(
        watch.delivered_once(versions, "ts"), corpus.root_files(spark, sf), folder,
        f"{folder}/checkpoint", available_now=True,
    )
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/findings").select(
        "project", "file", "version", "rule_id", "line", "message"
    )


@query
def published_totals(spark, sf):
    """Running totals, read as the latest published version."""
    folder = _scratch(spark, "published")
    started = watch.start_published_total(
        corpus.versions_of(_event_stream(spark, sf)), f"{folder}/totals", f"{folder}/checkpoint",
        available_now=True,
    )
    started.awaitTermination()
    return Published(spark, f"{folder}/totals").read().select("project", "scanned_files")


@query
def history_store_retention(spark, sf):
    """History appended to its store in two halves, trimmed on disk, read back."""
    kept = history.history_store(spark, _scratch(spark, "history"))
    runs = stored(_snapshots(spark, sf))
    late = F.col("run_seq") > F.lit(45)
    kept.append(runs.where(~late))
    kept.compact()
    kept.append(runs.where(late))
    kept.compact()
    return kept.read().select("project", "run_seq", "health_score")
