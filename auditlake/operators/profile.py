"""Project profiles: languages, frameworks, tools, infrastructure, domains.

Path-only facts never read file contents; contents are read for a handful of
root manifests. Every per-project gathering is a set over a fixed vocabulary.
``root_files`` may name a smaller table that holds the root-level files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import text as tx
from auditlake.functions.sql import array, array_lookup, lookup
from auditlake.operators.selection import is_dockerfile, with_path_columns
from auditlake.sources.files import root_only


def _lookup(table: dict[str, str], key: str) -> Column:
    """Value of a small fixed table for a column, null if absent."""
    return F.expr(lookup(table, key))


def marker_languages(root_files: DataFrame) -> DataFrame:
    rows = root_only(root_files).select(
        "project", _lookup(catalog.MARKER_LANGUAGES, "path").alias("language")
    )
    return rows.where(F.col("language").isNotNull()).distinct()


def suffix_languages(files: DataFrame) -> DataFrame:
    parts = tx.path_parts(F.col("path"))
    skipped = F.arrays_overlap(parts, F.expr(array(catalog.UNPROFILED_DIRS)))
    rows = with_path_columns(files.select("project", "path")).where(~skipped).select(
        "project", _lookup(catalog.SUFFIX_LANGUAGES, "suffix").alias("language")
    )
    return rows.where(F.col("language").isNotNull()).distinct()


def languages(files: DataFrame, root_files: DataFrame) -> DataFrame:
    return marker_languages(root_files).unionByName(suffix_languages(files)).distinct()


def python_frameworks(root_files: DataFrame, langs: DataFrame) -> DataFrame:
    """Framework names found in the root Python manifests of Python projects."""
    python = langs.where(F.col("language") == "python").select("project").distinct()
    text = F.lower("content")
    hits = F.array_compact(
        F.array(*[F.when(text.contains(p), F.lit(f)) for p, f in catalog.PYTHON_FRAMEWORKS.items()])
    )
    return (
        root_only(root_files).where(F.col("path").isin(*catalog.PYTHON_MANIFESTS))
        .join(python, "project", "left_semi")
        .select("project", F.explode(hits).alias("framework"))
        .distinct()
    )


def js_frameworks(root_files: DataFrame) -> DataFrame:
    """Frameworks by exact dependency name in the root ``package.json``."""
    names = F.concat(
        *[
            F.coalesce(
                F.json_object_keys(F.get_json_object("content", f"$.{s}")),
                F.array().cast("array<string>"),
            )
            for s in ("dependencies", "devDependencies")
        ]
    )
    valid = F.try_parse_json("content").isNotNull()
    return (
        root_only(root_files).where((F.col("path") == "package.json") & valid)
        .select("project", F.explode(names).alias("_name"))
        .select("project", _lookup(catalog.JS_FRAMEWORKS, "_name").alias("framework"))
        .where(F.col("framework").isNotNull())
        .distinct()
    )


def existing_tools(root_files: DataFrame) -> DataFrame:
    roots = root_only(root_files)
    by_file = roots.select("project", _lookup(catalog.TOOL_CONFIG_FILES, "path").alias("tool"))
    sections = F.array_compact(
        F.array(
            *[
                F.when(F.col("content").contains(s), F.lit(t))
                for s, t in catalog.PYPROJECT_SECTIONS.items()
            ]
        )
    )
    by_section = roots.where(F.col("path") == "pyproject.toml").select(
        "project", F.explode(sections).alias("tool")
    )
    return by_file.where(F.col("tool").isNotNull()).unionByName(by_section).distinct()


def path_flags(files: DataFrame) -> DataFrame:
    """has_tests / has_dockerfile / has_iac per project, from names only."""
    named = with_path_columns(files.select("project", "path"))
    low = F.lower("name")
    docker = is_dockerfile(F.col("name")) | low.isin(*catalog.COMPOSE_NAMES)
    return named.groupBy("project").agg(
        F.bool_or(tx.contains_any(low, catalog.TEST_NAME_PARTS)).alias("has_tests"),
        F.bool_or(docker).alias("has_dockerfile"),
        F.bool_or(F.col("suffix").isin(*catalog.IAC_PROFILE_SUFFIXES)).alias("has_iac"),
    )


def dockerfile_counts(files: DataFrame) -> DataFrame:
    """Files the container domain scans, per project."""
    named = with_path_columns(files.select("project", "path"))
    return (
        named.where(is_dockerfile(F.col("name")))
        .groupBy("project").agg(F.count("*").alias("scanned_files"))
    )


def primary_language(langs: Column) -> Column:
    """typescript, javascript, python, else the first by name, else unknown."""
    choice = F.when(F.size(langs) == 0, F.lit("unknown")).otherwise(F.array_min(langs))
    for name in ("python", "javascript", "typescript"):
        choice = F.when(F.array_contains(langs, name), F.lit(name)).otherwise(choice)
    return choice


def recommended_domains(
    langs: Column, has_manifest: Column, has_dockerfile: Column, has_iac: Column
) -> Column:
    any_lang = F.size(langs) > 0
    typed = F.array_contains(langs, "python") | F.array_contains(langs, "typescript")
    return F.array_compact(
        F.array(
            F.lit("security"),
            F.when(any_lang, "lint"),
            F.when(any_lang, "sast"),
            F.when(typed, "typecheck"),
            F.when(has_manifest, "sca"),
            F.when(has_dockerfile, "container"),
            F.when(has_iac, "iac"),
        )
    )


def relevant_linters(files: DataFrame) -> DataFrame:
    """Linters that handle at least one suffix of the project (all files count)."""
    named = with_path_columns(files.select("project", "path"))
    linter = F.explode(F.expr(array_lookup(catalog.LINTERS_BY_SUFFIX, "suffix")))
    return named.select("project", linter.alias("linter")).distinct()


def profile(files: DataFrame, root_files: DataFrame | None = None) -> DataFrame:
    """One summary row per project."""
    roots = files if root_files is None else root_files
    langs = languages(files, roots)

    def as_set(rows: DataFrame, value: str, out: str) -> DataFrame:
        return rows.groupBy("project").agg(F.sort_array(F.collect_set(value)).alias(out))

    frameworks = python_frameworks(roots, langs).unionByName(js_frameworks(roots))
    manifest = (
        root_only(roots).groupBy("project")
        .agg(F.bool_or(F.col("path").isin(*catalog.SCA_MANIFESTS)).alias("_manifest"))
    )
    out = (
        path_flags(files)
        .join(as_set(langs, "language", "languages"), "project", "left")
        .join(as_set(frameworks, "framework", "frameworks"), "project", "left")
        .join(as_set(existing_tools(roots), "tool", "existing_tools"), "project", "left")
        .join(manifest, "project", "left")
    )
    none = F.array().cast("array<string>")
    out = out.select(
        "project",
        *[F.coalesce(c, none).alias(c) for c in ("languages", "frameworks", "existing_tools")],
        "has_dockerfile", "has_iac", "has_tests",
        F.coalesce("_manifest", F.lit(False)).alias("_manifest"),
    )
    return out.select(
        "project", "languages", "frameworks", "existing_tools",
        "has_dockerfile", "has_iac", "has_tests",
        primary_language(F.col("languages")).alias("primary_language"),
        recommended_domains(
            F.col("languages"), F.col("_manifest"), F.col("has_dockerfile"), F.col("has_iac")
        ).alias("recommended_domains"),
    )
