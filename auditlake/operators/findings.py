"""Findings algebra: union, order, rollups, gate, catalogues, explanations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions.scale import stored, top_n
from auditlake.functions.sql import array
from auditlake.operators.lines import numbered_context
from auditlake.schemas import FINDING_COLUMNS, FINDING_ORDER


def severity_rank(severity: Column) -> Column:
    place = F.array_position(F.expr(array(catalog.SEVERITIES)), severity)
    return F.when(place > 0, (place - 1).cast("int")).otherwise(catalog.UNKNOWN_RANK)


def order_key() -> Column:
    return F.struct(*FINDING_ORDER)


def merge(*parts: DataFrame) -> DataFrame:
    """Bag union of findings; duplicates stay."""
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def sort_findings(findings: DataFrame) -> DataFrame:
    """Severity, file, line per project; ties keep rule order.

    A range-partitioned global sort: its sampling reads ``findings`` once more,
    so pass a stored table.
    """
    return findings.orderBy("project", *FINDING_ORDER)


# ------------------------------------------------------------------- rollups
def _severity_counts() -> list[Column]:
    counts = [
        F.count_if(F.col("severity") == s).alias(s.lower()) for s in catalog.SEVERITIES[:4]
    ]
    return [*counts, F.count("*").alias("total")]


def severity_summary(findings: DataFrame, scanned: DataFrame) -> DataFrame:
    """Counts per severity and pass flag, zero rows for clean projects.

    ``scanned`` has (project, scanned_files). Both sides hold one row per
    project when they meet.
    """
    counts = findings.groupBy("project").agg(*_severity_counts())
    names = [s.lower() for s in catalog.SEVERITIES[:4]] + ["total"]
    joined = scanned.join(counts, "project", "full_outer")
    zero = F.lit(0).cast("bigint")
    out = joined.select(
        "project",
        F.coalesce("scanned_files", zero).alias("scanned_files"),
        *[F.coalesce(n, zero).alias(n) for n in names],
    )
    return out.withColumn("passed", (F.col("critical") == 0) & (F.col("high") == 0))


def gate(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Fail flag per project and gate level (critical/high/medium/low/any)."""
    worst = findings.groupBy("project").agg(F.min("sev_rank").alias("_worst"))
    level = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("level"), F.lit(r).alias("limit"))
                for n, r in catalog.GATE_LEVELS.items()
            ]
        )
    )
    return (
        projects.select("project").distinct().join(worst, "project", "left")
        .select("project", "_worst", level.alias("g"))
        .select(
            "project",
            F.col("g.level").alias("level"),
            F.coalesce(F.col("_worst") <= F.col("g.limit"), F.lit(False)).alias("failed"),
        )
    )


def domain_summary(
    findings: DataFrame, executed: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """One row per executed (project, domain): tool, version, time, findings, passed.

    ``errors`` (project, domain, error) marks domains that crashed: no findings
    count, not passed.
    """
    counts = findings.groupBy("project", "domain").agg(
        F.count("*").alias("findings"),
        F.bool_or(F.col("sev_rank") <= 1).alias("_bad"),
    )
    out = executed.join(counts, ["project", "domain"], "left")
    crashed = F.lit(None).cast("string")
    if errors is not None:
        first = errors.groupBy("project", "domain").agg(F.min("error").alias("_error"))
        out = out.join(first, ["project", "domain"], "left")
        crashed = F.col("_error")
    return out.select(
        "project",
        "domain",
        "tool",
        "version",
        "time",
        F.when(crashed.isNotNull(), F.lit(0)).otherwise(F.coalesce("findings", F.lit(0)))
        .cast("bigint").alias("findings"),
        (crashed.isNull() & ~F.coalesce("_bad", F.lit(False))).alias("passed"),
        F.coalesce(crashed, F.lit("")).alias("error"),
    )


def scanned_total(*counts: DataFrame) -> DataFrame:
    """Sum of scanned files over the domains that report a number."""
    rows = reduce(
        DataFrame.unionByName, [c.select("project", "scanned_files") for c in counts]
    )
    return rows.groupBy("project").agg(
        F.sum(F.coalesce("scanned_files", F.lit(0))).cast("bigint").alias("scanned_files")
    )


def summary_line(summary: DataFrame) -> DataFrame:
    text = F.format_string(
        "[%s] %d files scanned, %d findings (%dC/%dH/%dM)",
        F.when(F.col("passed"), "PASS").otherwise("FAIL"),
        F.col("scanned_files"), F.col("total"),
        F.col("critical"), F.col("high"), F.col("medium"),
    )
    return summary.select("project", text.alias("summary"))


def file_results(findings: DataFrame, scanned_files: DataFrame | None = None) -> DataFrame:
    """Findings count and pass flag per file; clean files too when given."""
    per_file = findings.groupBy("project", F.col("file").alias("path")).agg(
        F.count("*").alias("findings"), F.bool_or(F.col("sev_rank") <= 1).alias("_bad")
    )
    if scanned_files is not None:
        per_file = scanned_files.select("project", "path").join(
            per_file, ["project", "path"], "left"
        )
    return per_file.select(
        "project", "path",
        F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"),
        (~F.coalesce("_bad", F.lit(False))).alias("passed"),
    )


# -------------------------------------------------------------------- reports
def top_findings(findings: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` findings per project plus how many more there are.

    Reads ``findings`` twice (ranking and totals, each with a partial step
    before its shuffle): pass a stored table.
    """
    totals = findings.groupBy("project").agg(F.count("*").alias("_total"))
    return (
        top_n(findings, ["project"], FINDING_ORDER, n, out="position")
        .join(totals, "project")
        .withColumn("more", F.greatest(F.col("_total") - n, F.lit(0)).cast("bigint"))
        .drop("_total")
    )


def first_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    return top_n(errors, ["project"], ["domain", "error"], n, out="position")


def fix_guidance(findings: DataFrame) -> DataFrame:
    """First non-empty fix text per rule of a project, in findings order."""
    return (
        findings.where(F.col("fix") != "")
        .groupBy("project", "rule_id")
        .agg(F.min_by("fix", order_key()).alias("fix"))
    )


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("CRITICAL", "HIGH"), "error")
        .when(severity == "MEDIUM", "warning")
        .otherwise("note")
    )


def rule_catalogue(findings: DataFrame) -> DataFrame:
    """First message and level per rule of a project, in findings order."""
    first = F.min_by(F.struct("message", "severity"), order_key())
    return (
        findings.groupBy("project", "rule_id")
        .agg(first.alias("_first"), F.min(order_key()).alias("first_at"))
        .select(
            "project", "rule_id",
            F.col("_first.message").alias("message"),
            sarif_level(F.col("_first.severity")).alias("level"),
            "first_at",
        )
    )


def explain(requests: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """Look up (project, rule_id, path, line) requests with numbered code lines.

    The first finding that fits is shown; a request without one gets an error
    text instead.
    """
    key = ["project", "rule_id", "path", "line"]
    asked = requests.select(*key).distinct()
    fields = ["severity", "message", "fix", "snippet", "domain"]
    located = stored(
        findings.withColumnRenamed("file", "path")
        .join(asked, key, "left_semi")
        .groupBy(*key)
        .agg(F.min_by(F.struct(*fields), F.struct(
            *[c if c != "file" else "path" for c in FINDING_ORDER])).alias("_f"))
    )
    context = numbered_context(located, files, 4, 5, numbered=True)
    missing = F.concat(
        F.lit("Finding "), F.col("rule_id"), F.lit(" at "), F.col("path"), F.lit(":"),
        F.col("line").cast("string"), F.lit(" not found"),
    )
    return (
        asked.join(located, key, "left")
        .join(context, ["project", "path", "line"], "left")
        .select(
            *key,
            *[F.col(f"_f.{f}").alias(f) for f in fields],
            F.when(F.col("_f").isNotNull(), F.coalesce("context", F.lit(""))).alias("context"),
            F.when(F.col("_f").isNull(), missing).alias("error"),
        )
    )


# ------------------------------------------------------------ domains and errors
def _message_findings(
    rows: DataFrame, rule_prefix: str, message: tuple[str, str], fix: Column, category: str
) -> DataFrame:
    name = F.col("domain")
    return rows.select(
        "project",
        F.concat(F.lit(rule_prefix), F.upper(name)).alias("rule_id"),
        F.lit("HIGH").alias("severity"),
        F.lit(1).alias("sev_rank"),
        F.lit("").alias("file"),
        F.lit(0).alias("line"),
        F.concat(F.lit(message[0]), name, F.lit(message[1])).alias("message"),
        F.lit("").alias("snippet"),
        fix.alias("fix"),
        "domain",
        F.lit("").alias("tool"),
        F.lit(category).alias("category"),
        F.lit("").alias("url"),
        F.lit(0).alias("rule_seq"),
        F.lit(0).alias("sub_seq"),
        F.lit(0).cast("bigint").alias("match_start"),
    )


def missing_tools(
    requested: DataFrame, available: DataFrame, registered: Sequence[str] | None = None
) -> DataFrame:
    """Strict mode: registered domains that were asked for but have no tool."""
    names = catalog.DOMAINS if registered is None else registered
    known = requested.where(F.col("domain").isin(*names))
    gone = known.select("project", "domain").distinct().join(
        available.select("project", "domain").distinct(), ["project", "domain"], "left_anti"
    )
    fix = F.concat(F.lit("Install the required tool for domain "), F.col("domain"))
    return _message_findings(
        gone, "TOOL-MISSING-",
        ("Domain '", "' is enabled but its tool is not installed"), fix, "tooling",
    )


def unknown_domains(requested: DataFrame, registered: Sequence[str] | None = None) -> DataFrame:
    """Strict mode: configured domain names nobody registered."""
    names = list(catalog.DOMAINS if registered is None else registered)
    rows = requested.select("project", "domain").distinct().where(~F.col("domain").isin(*names))
    fix = F.lit(
        "Check the configured domains — valid domains: " + ", ".join(catalog.DOMAINS)
    )
    return _message_findings(
        rows, "DOMAIN-UNKNOWN-",
        ("Unknown domain '", "' specified in configuration"), fix, "config",
    )


def select_domains(projects: DataFrame, registered: Sequence[str] | None = None) -> DataFrame:
    """Domains to run per project: configured, else recommended, else all.

    ``projects`` has (project, configured array, recommended array). Unknown
    configured names are ignored.
    """
    names = F.array(*[F.lit(d) for d in (catalog.DOMAINS if registered is None else registered)])
    configured = F.when(F.size("configured") > 0, F.col("configured"))
    recommended = F.when(F.size("recommended") > 0, F.col("recommended"))
    chosen = F.filter(
        F.coalesce(configured, recommended, names), lambda d: F.array_contains(names, d)
    )
    return projects.select("project", F.explode(F.array_distinct(chosen)).alias("domain"))
