"""Change planner: which domains and files a change set calls for.

A change set is (project, path, seq) rows; file contents are never read. A
project's file list can be huge, so plans stay in rows; only fixed-size things
(domain names, the first five priority files) are gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import text as tx
from auditlake.functions.scale import top_n


def _array_map(table: dict[str, list[str]]):
    pairs = []
    for key, values in table.items():
        pairs += [F.lit(key), F.array(*[F.lit(v) for v in values])]
    return F.create_map(*pairs)


def plan_domains(changes: DataFrame) -> DataFrame:
    """Distinct (project, domain) rows; ``security`` whenever anything changed."""
    low = F.lower("path")
    name = tx.path_name(low)
    suffix = tx.path_suffix(name)
    none = F.array().cast("array<string>")
    iac = suffix.isin(*catalog.IAC_PLAN_SUFFIXES) & F.arrays_overlap(
        tx.path_parts(low), F.array(*[F.lit(d) for d in catalog.IAC_PLAN_DIRS])
    )
    domains = F.concat(
        F.array(F.lit("security")),
        F.coalesce(F.try_element_at(_array_map(catalog.PLAN_BY_NAME), name), none),
        F.coalesce(F.try_element_at(_array_map(catalog.PLAN_BY_SUFFIX), suffix), none),
        F.when(iac, F.array(F.lit("iac"))).otherwise(none),
    )
    return changes.select("project", F.explode(F.array_distinct(domains)).alias("domain")).distinct()


def domain_lists(plans: DataFrame) -> DataFrame:
    """Sorted domain array per project (at most one entry per known domain)."""
    return plans.groupBy("project").agg(
        F.sort_array(F.collect_set("domain")).alias("domains")
    )


def priority_files(changes: DataFrame) -> DataFrame:
    """Security-sensitive paths with their place in the change list."""
    sensitive = tx.contains_any(F.lower("path"), catalog.SENSITIVE_PATH_PARTS)
    return changes.where(sensitive).select("project", "path", "seq")


def reasoning(changes: DataFrame) -> DataFrame:
    """Plan text per project: first five priority files and domain sentences."""
    first = (
        top_n(priority_files(changes), ["project"], ["seq", "path"], 5)
        .groupBy("project")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "path"))).alias("_p"))
    )
    lists = domain_lists(plan_domains(changes))
    shown = F.array_join(F.transform("_p", lambda p: p["path"]), ", ")
    parts = F.concat_ws(
        "; ",
        F.when(F.col("_p").isNotNull(),
               F.concat(F.lit("Security-sensitive files changed: "), shown)),
        *[
            F.when(F.array_contains("domains", d), F.lit(text))
            for d, text in catalog.PLAN_SENTENCES.items()
        ],
    )
    return lists.join(first, "project", "left").select(
        "project",
        F.array_join("domains", ",").alias("domains"),
        F.coalesce(F.nullif(parts, F.lit("")), F.lit("Standard code changes")).alias("reasoning"),
    )


def merge_suggestions(changes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Plan rows after outside suggestions: (project, part, value, origin).

    ``suggestions`` has (project, kind, pos, value) with kinds ``domain``,
    ``priority_file`` and ``risk_area``. New domains and priority files are
    added if not planned already, files only if they are in the change set; the
    first five risk areas are added to the reasoning as one row.
    """
    planned = (
        plan_domains(changes).select("project", F.lit("domain").alias("part"),
                                     F.col("domain").alias("value"))
        .unionByName(
            priority_files(changes).select(
                "project", F.lit("priority_file").alias("part"), F.col("path").alias("value")
            )
        )
        .distinct()
    )
    paths = changes.select("project", F.col("path").alias("value")).distinct()
    touched = changes.select("project").distinct()
    offered = suggestions.join(touched, "project", "left_semi")
    named = offered.select("project", F.col("kind").alias("part"), "value").distinct()
    domains = named.where(F.col("part") == "domain")
    files = named.where(F.col("part") == "priority_file").join(
        paths, ["project", "value"], "left_semi"
    )
    new = domains.unionByName(files).join(planned, ["project", "part", "value"], "left_anti")
    risks = (
        top_n(offered.where(F.col("kind") == "risk_area"), ["project"], ["pos", "value"], 5)
        .groupBy("project")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "value"))).alias("_r"))
        .select(
            "project", F.lit("reasoning").alias("part"),
            F.concat(F.lit("; AI risk areas: "),
                     F.array_join(F.transform("_r", lambda r: r["value"]), ", ")).alias("value"),
        )
    )
    return (
        planned.withColumn("origin", F.lit("plan"))
        .unionByName(new.withColumn("origin", F.lit("suggested")))
        .unionByName(risks.withColumn("origin", F.lit("suggested")))
    )
