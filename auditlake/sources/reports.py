"""Reports of external tools: reading payloads, parse status, tool choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions.sql import lookup

LINE_TOOLS = ["clippy", "mypy", "tsc"]


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Read report files, one row per report.

    A report is ``<project>/<tool>.<ext>``, or ``<project>/<tool>/<name>.<ext>`` where a
    tool has several, such as one for each Dockerfile. A file beside it with the same
    name and the ending ``.run`` may hold what a payload lacks, as a JSON object:
    ``root``, ``target``, ``stderr``, ``returncode``, ``version``, ``time``, ``ruleset``.
    """
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    path = F.input_file_name()
    named = raw.select(
        F.regexp_replace(path, r"\.[^./]*$", "").alias("stem"),
        path.endswith(".run").alias("is_run"), "value",
    )
    run = (
        "struct<root string, target string, stderr string, returncode int, version string, "
        "time double, ruleset string>"
    )
    runs = named.where("is_run").select("stem", F.from_json("value", run).alias("run"))
    parts = F.split("stem", "/")
    last, above = F.element_at(parts, -1), F.element_at(parts, -2)
    several = above.isin(*catalog.TOOL_DOMAIN)
    return named.where("NOT is_run").join(runs, "stem", "left").select(
        F.when(several, F.element_at(parts, -3)).otherwise(above).alias("project"),
        F.coalesce("run.root", F.lit("")).alias("root"),
        F.when(several, above).otherwise(last).alias("tool"),
        F.coalesce("run.target", F.when(several, last).otherwise("")).alias("target"),
        F.col("value").alias("payload"),
        F.coalesce("run.stderr", F.lit("")).alias("stderr"),
        F.coalesce("run.returncode", F.lit(0)).alias("returncode"),
        F.coalesce("run.version", F.lit("")).alias("version"),
        F.coalesce("run.time", F.lit(0.0)).alias("time"),
        F.col("run.ruleset").alias("ruleset"),
    )


def parse_status(reports: DataFrame) -> DataFrame:
    """Add ``status``: ``empty``, ``unparseable`` or ``ok``."""
    empty = F.coalesce(F.col("payload"), F.lit("")) == ""
    bad = ~F.col("tool").isin(*LINE_TOOLS) & F.try_parse_json("payload").isNull()
    return reports.withColumn(
        "status", F.when(empty, "empty").when(bad, "unparseable").otherwise("ok")
    )


def domain_of(tool: Column) -> Column:
    pairs = [F.lit(x) for kv in catalog.TOOL_DOMAIN.items() for x in kv]
    return F.element_at(F.create_map(*pairs), tool)


def replaced_tools(reports: DataFrame) -> DataFrame:
    """(project, tool) rows whose reports a preferred tool's reports replace."""
    pairs = {better: other for better, other in catalog.TOOL_PREFERENCE}
    other = F.expr(lookup(pairs, "tool"))
    return (
        reports.select("project", other.alias("tool")).where(F.col("tool").isNotNull()).distinct()
    )


def tool_runs(reports: DataFrame) -> DataFrame:
    """(project, tool, version, time) of the tools that reported.

    ``version`` (the largest) and ``time`` (the sum, seconds) come from the columns of
    that name where reports have them, else they are empty and 0.
    """
    def held(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in reports.columns else default

    return reports.groupBy("project", "tool").agg(
        F.max(held("version", F.lit(""))).alias("version"),
        F.sum(held("time", F.lit(0.0)).cast("double")).alias("time"),
    )


def of_rulesets(reports: DataFrame, rulesets: Sequence[str]) -> DataFrame:
    """Static analysers' reports on the named rulesets alone; other tools' reports all stay.

    ``ruleset`` says what a report was run with; one that does not say was run with the
    default set ``auto``. Without names, or without that column, all reports stay.
    """
    if not rulesets or "ruleset" not in reports.columns:
        return reports
    analysers = [t for t, d in catalog.TOOL_DOMAIN.items() if d == "sast"]
    used = F.coalesce("ruleset", F.lit("auto"))
    return reports.where(~F.col("tool").isin(*analysers) | used.isin(*rulesets))


def preferred_tools(reports: DataFrame) -> DataFrame:
    """Keep the preferred tool where a project has reports of both of a pair.

    Only reports of replaceable tools meet the lookup; the others pass
    untouched, so a later filter on one tool reaches the stored table.
    """
    tool = F.col("tool")
    replaceable = [other for _, other in catalog.TOOL_PREFERENCE]
    free = reports.where(~tool.isin(*replaceable))
    contested = reports.where(tool.isin(*replaceable))
    kept = contested.join(replaced_tools(reports), ["project", "tool"], "left_anti")
    return free.unionByName(kept.select(*reports.columns))


def write_reports(reports: DataFrame, folder: str, mode: str = "append") -> None:
    """Store reports by tool: each normaliser then reads its own tool's files only."""
    reports.write.mode(mode).partitionBy("tool").parquet(folder)
