"""Scan scope: change lists, path lists and the fallback to a full scan.

A ``changes`` table holds one row per (project, kind, path): kinds ``staged``,
``unstaged``, ``untracked`` for uncommitted work and ``committed`` for commits
since ``base_ref``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scale import salted_filter
from auditlake.functions.text import SPACE

UNCOMMITTED = ["staged", "unstaged", "untracked"]
DEFAULT_BASE = "origin/main"


def _named(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("path").rlike(f"^{SPACE}*[^{SPACE[1:-1]}]"))


def uncommitted(changes: DataFrame) -> DataFrame:
    """Distinct paths with uncommitted changes; blank lines are dropped."""
    return (
        _named(changes)
        .where(F.col("kind").isin(*UNCOMMITTED))
        .select("project", "path")
        .distinct()
    )


def pull_request(changes: DataFrame, base_ref: str = "") -> DataFrame:
    """Paths changed since ``base_ref``, in list order (``seq``)."""
    return (
        _named(changes)
        .where((F.col("kind") == "committed") & (F.col("base_ref") == (base_ref or DEFAULT_BASE)))
        .select("project", "path", "seq")
    )


def scope_paths(changes: DataFrame, mode: str, base_ref: str = "") -> DataFrame:
    """Distinct (project, path) that a scan in this mode looks at."""
    scope = uncommitted(changes) if mode == "incremental" else pull_request(changes, base_ref)
    return scope.select("project", "path").distinct()


def only_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files named in ``paths`` (project, path); unknown paths are dropped.

    (project, path) is unique in ``files`` and therefore never hot. Whether the paths
    are broadcast or both sides are shuffled is left to the planner.
    """
    return files.join(paths.select("project", "path").distinct(), ["project", "path"], "left_semi")


def in_scope(
    files: DataFrame,
    changes: DataFrame,
    mode: str = "full",
    base_ref: str = "",
    empty_scope: str = "full",
) -> DataFrame:
    """Files a scan in this mode reads.

    A project without any change in scope is scanned in full; pass
    ``empty_scope='none'`` to scan nothing of it instead. Changed files and the files
    of such projects are two disjoint reads: the first can drop unchanged files before
    texts move, the second meets one row a project.
    """
    if mode == "full":
        return files
    paths = scope_paths(changes, mode, base_ref)
    changed = only_paths(files, paths)
    if empty_scope == "none":
        return changed
    untouched = salted_filter(files, paths, ["project"], ["path"], anti=True)
    return changed.unionByName(untouched.select(*changed.columns))
