"""The whole scan as one lazy plan: scope, domains, findings, errors, rollups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import __version__
from auditlake.functions.scale import salted_filter, stored
from auditlake.operators import findings as fd
from auditlake.operators import normalise, profile, rules
from auditlake.operators.selection import eligible_files
from auditlake.plans.isolate import reason, run_isolated
from auditlake.plans.options import ScanOptions
from auditlake.plans.registry import Registry, run_domain
from auditlake.schemas import FINDINGS
from auditlake.sources import changes as ch
from auditlake.sources import reports as rp

#: The job that reads all tools' reports in one pass.
TOOL_REPORTS = "tool reports"

@dataclass
class ScanOutcome:
    """DataFrames of one scan.

    Findings are computed when one of them is used; :meth:`stored` does so once for
    all. The domains of each project are settled beforehand and stored.
    """

    findings: DataFrame
    errors: DataFrame
    executed: DataFrame
    scanned: DataFrame
    options: ScanOptions

    def stored(self) -> ScanOutcome:
        """Scan now, once: findings become a table that all rollups read."""
        return replace(self, findings=stored(self.findings))

    @cached_property
    def summary(self) -> DataFrame:
        return fd.severity_summary(self.findings, self.scanned)

    @cached_property
    def domain_results(self) -> DataFrame:
        """One row an executed domain; one whose report cannot be read has failed."""
        failed = self.errors.where("failed").select("project", "domain", "error")
        return fd.domain_summary(self.findings, self.executed, failed)

    @cached_property
    def gate(self) -> DataFrame:
        levels = fd.gate(self.findings, self.scanned)
        return levels.where(F.col("level") == self.options.fail_on)


def builtin_scan(
    files: DataFrame, root_files: DataFrame | None = None, options: ScanOptions | None = None
) -> DataFrame:
    """Sorted findings of the built-in rules only."""
    opts = options or ScanOptions()
    found = rules.scan(
        files, root_files, public_scopes=opts.public_scopes, skipped_dirs=opts.exclude_patterns
    )
    return fd.sort_findings(stored(found))


def requested_domains(
    files: DataFrame, root_files: DataFrame, options: ScanOptions
) -> DataFrame:
    """(project, domain) rows asked for: configured names, else recommended ones."""
    if options.domains:
        names = F.explode(F.array(*[F.lit(d) for d in options.domains]))
        return files.select("project").distinct().select("project", names.alias("domain"))
    return profile.profile(files, root_files).select(
        "project", F.explode("recommended_domains").alias("domain")
    )


def scan_projects(
    files: DataFrame,
    options: ScanOptions | None = None,
    changes: DataFrame | None = None,
    reports: DataFrame | None = None,
    root_files: DataFrame | None = None,
    registry: Registry | None = None,
) -> ScanOutcome:
    """Scan many projects over all their domains.

    Custom domains run at once, each behind a failure boundary of its own
    (:mod:`auditlake.plans.isolate`): one that raises gives an error row and a failed
    domain row, and all other findings stay. With ``options.measured`` the built-in scan and
    the tool reports run that way too, so that times and failures are known for them.
    """
    opts = options or ScanOptions()
    reg = registry or Registry()
    roots = files if root_files is None else root_files
    scoped = files
    if opts.scan_mode != "full" and changes is not None:
        scoped = ch.in_scope(files, changes, opts.scan_mode, opts.base_ref, opts.empty_scope)

    # few rows a project, used by every part below
    asked = stored(requested_domains(files, roots, opts).distinct())
    projects = stored(files.select("project").distinct())
    wanted = asked.where(F.col("domain").isin(*reg.names()))

    jobs: dict[str, Callable[[], DataFrame]] = {}
    parts = []
    available = projects.withColumn("domain", F.lit("security"))
    ran = available.select(
        "project", "domain", F.lit("builtin").alias("tool"), F.lit(__version__).alias("version"),
        F.lit(0.0).alias("time"), F.lit(0).alias("rank"),
    )
    errors = rules.dependency_errors(scoped, opts.exclude_patterns).select(
        "project", F.lit("security").alias("domain"),
        F.concat("file", F.lit(": "), "error").alias("error"), F.lit(False).alias("failed"),
    ).unionByName(
        rules.unread_files(scoped, opts.exclude_patterns).select(
            "project", F.lit("security").alias("domain"),
            F.concat("file", F.lit(": "), "error").alias("error"), F.lit(True).alias("failed"),
        )
    )
    security = reg.get("security")
    if security is not None and security.scan is None:
        jobs["security"] = lambda: rules.scan(
            scoped, roots, public_scopes=opts.public_scopes, skipped_dirs=opts.exclude_patterns
        )
    if reports is not None:
        reports = rp.of_rulesets(reports, opts.tool_overrides.get("sast", {}).get("rulesets", ()))
        # tool choice is applied to the findings: one lookup instead of one per tool
        replaced = stored(rp.replaced_tools(reports))
        by_tools = salted_filter(
            normalise.normalise(reports), replaced, ["project", "tool"], ["file", "line"], anti=True
        )
        by_tools = normalise.apply_overrides(
            by_tools,
            opts.tool_overrides.get("lint", {}).get("ruff", {}).get("select", ()),
            opts.tool_overrides.get("iac", {}).get("skip", ()),
        )
        if opts.scan_mode != "full" and changes is not None:
            paths = ch.scope_paths(changes, opts.scan_mode, opts.base_ref)
            by_tools = normalise.only_changed(by_tools, paths, reports, opts.empty_scope)
        jobs[TOOL_REPORTS] = lambda: by_tools
        tools = stored(rp.tool_runs(reports).join(replaced, ["project", "tool"], "left_anti"))
        with_tool = tools.select("project", rp.domain_of(F.col("tool")).alias("domain")).distinct()
        available = available.unionByName(with_tool)
        ran = ran.unionByName(normalise.domain_runs(tools).withColumn("rank", F.lit(1)))
        errors = errors.unionByName(normalise.report_errors(rp.preferred_tools(reports)))
    if not opts.measured:
        parts += [build() for build in jobs.values()]
        jobs = {}
    custom: dict[str, int] = {}
    crashed: dict[str, str] = {}
    for rank, domain in enumerate(reg.custom(), 2):
        try:
            there = domain.available()
        except Exception as exc:
            crashed[domain.name] = reason(exc)
            there = True
        if there:
            custom[domain.name] = rank
            if domain.name not in crashed:
                jobs[domain.name] = partial(run_domain, domain, scoped, opts)
    seconds: dict[str, float] = {}
    for run in run_isolated(files.sparkSession, jobs):
        seconds[run.name] = run.seconds
        if run.error is not None:
            crashed[run.name] = run.error
        else:
            parts.append(run.found)
    if seconds.get("security"):
        ran = ran.withColumn(
            "time", F.when(F.col("rank") == 0, F.lit(seconds["security"])).otherwise(F.col("time")))
    for name, rank in custom.items():
        mine = projects.withColumn("domain", F.lit(name))
        available = available.unionByName(mine)
        ran = ran.unionByName(mine.select(
            "project", "domain", F.lit(name).alias("tool"), F.lit("").alias("version"),
            F.lit(0.0 if name in crashed else seconds[name]).alias("time"), F.lit(rank).alias("rank"),
        ))
    for name, error in crashed.items():
        lost = projects.withColumn("domain", F.lit(name))
        if name == TOOL_REPORTS:  # all domains whose tools reported
            lost = with_tool
        errors = errors.unionByName(lost.select(
            "project", "domain",
            F.concat(F.lit("Domain '"), F.col("domain"), F.lit(f"' crashed: {error}")).alias("error"),
            F.lit(True).alias("failed"),
        ))
    if not parts:
        parts.append(files.sparkSession.createDataFrame([], FINDINGS))
    found = fd.merge(*parts)
    if opts.domains:
        found = found.where(F.col("domain").isin(*opts.domains))
    else:
        found = salted_filter(found, wanted, ["project", "domain"], ["file", "line"])

    if opts.strict:
        found = found.unionByName(fd.missing_tools(wanted, available, reg.names()))
        if opts.domains:
            found = found.unionByName(fd.unknown_domains(asked, reg.names()))

    # of several that ran a domain, the built-in one, then report tools, then custom ones
    executed = (
        ran.groupBy("project", "domain")
        .agg(F.min_by(F.struct("tool", "version", "time"), "rank").alias("run"))
        .join(wanted, ["project", "domain"], "left_semi")
        .select("project", "domain", "run.*")
    )
    counted = [
        eligible_files(scoped, opts.exclude_patterns)
        .groupBy("project").agg(F.count("*").alias("scanned_files"))
    ]
    if reports is not None and (not opts.domains or "container" in opts.domains):
        docker = profile.dockerfile_counts(files)
        counted.append(
            docker.join(
                executed.where(F.col("domain") == "container").select("project"),
                "project", "left_semi",
            )
        )
    zero = projects.withColumn("scanned_files", F.lit(0).cast("bigint"))
    return ScanOutcome(
        findings=found,
        errors=salted_filter(errors, wanted, ["project", "domain"], ["error"]),
        executed=executed,
        scanned=fd.scanned_total(zero, *counted),
        options=opts,
    )
